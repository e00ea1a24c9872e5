"""Quality rules: an isolation forest over rule statistics of documents.

`statistics` counts per document what rule-based filters look at; `fit` draws
the rows of each isolation tree, 256 as the method has it, from all labelled rows and
calibrates the anomaly threshold on the labels of all of them; `judge` adds the verdict.

Defined results: null text counts as empty and has zeros everywhere; such rows fail
the base rules (fewer than 50 words). Rows are independent, so repeated rows get
equal results. With no labelled rows there is no forest and the base rules decide
alone. Texts of any length are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
#: Columns that `statistics` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_marks")
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Trees of a forest, and rows that each is grown on.
TREES, TREE_ROWS = 200, 256
#: Scores are summed up by so many bins first, so that no task sorts them all.
BINS = 1 << 16
#: A clean document lost counts this many times a junk one kept, when the threshold is chosen.
CLEAN_WEIGHT = 10.0


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words in three-word windows found twice or more, the first included; distinct words)."""
    n, ids = len(words), {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if n < 4:
        return 0, len(ids)
    _, pair = np.unique(codes[:-1] * len(ids) + codes[1:], return_inverse=True)
    _, which, times = np.unique(pair[:-1] * len(ids) + codes[2:], return_inverse=True, return_counts=True)
    twice = times[which] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum()), len(ids)


def measure(raw: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = raw.split()
    solid = b"".join(words)
    letters = np.frombuffer(solid, np.uint8)
    chars = int(((letters & 0xC0) != 0x80).sum())
    kinds = np.bincount(letters, minlength=256)
    upper = int(kinds[65:91].sum())
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    seen, dups, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            dups += line in seen
            seen.add(line)
    repeats, distinct = repeated_words(words)
    return len(words), chars, sum(int(kinds[ord(c)]) for c in SYMBOLS), dups, repeats, lines, distinct, upper, marks


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` without `text`, with the columns COUNTS of each whole text."""

    def make():
        def each(batch):
            rows = [measure(raw) for raw in common.as_bytes(batch.column(text))]
            columns = np.array(rows, np.int64).T
            return common.replaced(batch, [text], **{c: pa.array(v) for c, v in zip(COUNTS, columns, strict=True)})

        return each

    kept = df.drop(*COUNTS)
    return common.arrow_map(kept, make, kept.drop(text).withColumns({c: F.lit(0).cast("long") for c in COUNTS}).schema)


def features(x: np.ndarray) -> np.ndarray:
    """Ratios that the trees split on, from COUNTS in columns; independent of a text's length where they can be.

    Shares of repeated lines and words are squared, so that cuts fall among the large ones more often; none counts as usual beforehand.
    """
    words, chars, symbols, dups, repeats, lines, distinct, upper, marks = x.T.astype(float)
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.column_stack([symbols / n, (dups / np.maximum(lines, 1)) ** 2, (repeats / n) ** 2, chars / n, upper / c, marks / n, distinct / n * np.log1p(n)])


def base_failed(x: np.ndarray) -> np.ndarray:
    return (x[:, 0] < MIN_WORDS) | (100 * x[:, 4] > MAX_REPEAT_PERCENT * x[:, 0])


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n items."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays [tree, node]; the children of node i are 2i+1 and 2i+2."""

    column: np.ndarray  # -1 at leaves
    cut: np.ndarray
    path: np.ndarray  # at leaves, the path length
    norm: float
    threshold: float

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = 7, draws: list[np.ndarray] | None = None) -> Forest:
        """Trees on `size` rows of `x` each, or on `draws`, the rows of `x` (by number) that each tree has."""
        rng = np.random.default_rng(seed)
        size = min(size, len(x))
        depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (depth + 1) - 1
        column, cut, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, x[draws[t] if draws else rng.choice(len(x), size, replace=False)])]
            while todo:
                node, level, part = todo.pop()
                low, high = part.min(0), part.max(0)
                open_ = np.flatnonzero(high > low)
                if level == depth or len(part) < 2 or not len(open_):
                    path[t, node] = level + mean_path(len(part))
                    continue
                k = rng.choice(open_)
                column[t, node], cut[t, node] = k, rng.uniform(low[k], high[k])
                left = part[:, k] <= cut[t, node]
                todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        return cls(column, cut, path, max(float(mean_path(size)), 1e-9), 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score, 0 to 1: 2 ** -(mean path / expected path)."""
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for column, cut, path in zip(self.column, self.cut, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                k = column[at]
                inner = k >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + 1 + (x[rows, k] > cut[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.column) / self.norm)

    def calibrate(self, x: np.ndarray, junk: np.ndarray, clean_weight: float) -> None:
        """The threshold with the least weighted error rate on labelled rows; 1 (nothing is anomalous) if one class is absent."""
        if not junk.any() or junk.all():
            return
        s = self.score(x)
        order = np.argsort(-s, kind="stable")
        s, j = s[order], junk[order]
        gain = np.cumsum(j) / j.sum() - clean_weight * np.cumsum(~j) / (~j).sum()
        last = np.append(s[1:] < s[:-1], True)
        best = int(np.argmax(np.where(last, gain, -np.inf)))
        self.threshold = float((s[best] + s[best + 1]) / 2 if best + 1 < len(s) else s[best]) if gain[best] > 0 else 1.0


def drawn(rows: DataFrame, n: int, trees: int, size: int) -> DataFrame:
    """(tree, COUNTS): `size` rows for each tree, those of all `n` with the least hashes for it."""
    share = min(1 << 30, int((1 << 30) * (2 * size + 64) / n))  # twice as many as needed go into the ranking
    each = rows.select("doc_id", *COUNTS, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("h", F.xxhash64("tree", "doc_id", *COUNTS))
    few = each.where(F.pmod("h", F.lit(1 << 30)) < share)
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("h", "doc_id", *COUNTS))
    return few.withColumn("nth", nth).where(F.col("nth") <= size).select("tree", "nth", *COUNTS)


def least_error(scored: DataFrame, clean_weight: float) -> float:
    """What `Forest.calibrate` gives, over a table (score, junk) of any size: running counts by bins, then within them."""
    by_score = common.materialize(scored.groupBy("score").agg(F.sum(F.col("junk").cast("long")).alias("j"), F.sum((~F.col("junk")).cast("long")).alias("c")).withColumn("bin", F.floor(F.col("score") * BINS)), "rules-scores")
    whole = by_score.agg(F.sum("j").alias("j"), F.sum("c").alias("c")).first()
    if not whole.j or not whole.c:
        common.forget(by_score)
        return 1.0
    # one row for each bin, BINS at most
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = by_score.groupBy("bin").agg(F.sum("j").alias("j"), F.sum("c").alias("c"))
    bins = bins.select("bin", *(F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}_above") for x in "jc"))
    within = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    j, c = (F.col(f"{x}_above") + F.sum(x).over(within) for x in "jc")
    gains = by_score.join(bins, "bin").select((j / whole.j - clean_weight * c / whole.c).alias("gain"), "score")
    best = gains.agg(F.max(F.struct("gain", "score")).alias("x")).first().x
    below = by_score.where(F.col("score") < best.score).agg(F.max("score").alias("s")).first().s
    common.forget(by_score)
    return 1.0 if best.gain <= 0 else float(best.score if below is None else (best.score + below) / 2)


def learn(counted: DataFrame, labels: DataFrame, *, clean_weight: float = CLEAN_WEIGHT, trees: int = TREES, size: int = TREE_ROWS) -> Forest | None:
    """Forest and threshold from all labelled rows of `counted` (doc_id, COUNTS); labels: doc_id, quality.

    Only rows that pass the base rules count: the others are decided already. A document
    labelled more than once takes its lowest label. The driver holds the trees' rows alone.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = ~((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    rows = common.materialize(counted.where(passed).join(marks, "doc_id").select("doc_id", (F.col("quality") == 0).alias("junk"), *COUNTS), "rules-labelled")
    n = rows.count()
    if n < 2:
        common.forget(rows)
        return None
    got = drawn(rows, n, trees, size).toPandas().sort_values(["tree", "nth"])
    x, of = got[list(COUNTS)].to_numpy(np.int64), got["tree"].to_numpy()
    forest = Forest.grow(features(x), trees=trees, size=min(size, n), draws=[np.flatnonzero(of == t) for t in range(trees)])

    def make():
        def each(batch):
            score = forest.score(features(np.column_stack([batch.column(c).to_numpy() for c in COUNTS])))
            return pa.RecordBatch.from_arrays([batch.column("junk"), pa.array(score)], ["junk", "score"])

        return each

    forest.threshold = least_error(common.arrow_map(rows.select("junk", *COUNTS), make, "junk boolean, score double"), clean_weight)
    common.forget(rows)
    return forest


def fit(docs: DataFrame, labels: DataFrame, *, clean_weight: float = CLEAN_WEIGHT, trees: int = TREES) -> Forest | None:
    """As `learn`, from the whole texts of all labelled documents (doc_id, text; doc_id, quality)."""
    return learn(statistics(docs.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")), labels, clean_weight=clean_weight, trees=trees)


def judged(counted: DataFrame, forest: Forest | None) -> DataFrame:
    """`counted`, rows with COUNTS, with base_failed, anomaly (score) and kept."""

    def make():
        def each(batch):
            x = np.column_stack([batch.column(c).to_numpy() for c in COUNTS])
            failed = base_failed(x)
            score = forest.score(features(x)) if forest else np.zeros(len(x))
            kept = ~failed & (score < forest.threshold if forest else True)
            return common.replaced(batch, [], base_failed=pa.array(failed), anomaly=pa.array(score), kept=pa.array(kept))

        return each

    added = {"base_failed": F.lit(True), "anomaly": F.lit(0.0), "kept": F.lit(True)}
    return common.arrow_map(counted, make, counted.withColumns(added).schema)


def judge(df: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """`df` without `text`, with COUNTS, base_failed, anomaly (score) and kept."""
    return judged(statistics(df.drop("base_failed", "anomaly", "kept"), text), forest)
