"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a text's distinct words, pairs of neighbouring words, and pairs with one or two words between them, hashed to
32 bits; each counts once, so a text's length does not thin out what one passage says. A word also stands by its first four,
five and six letters, so that forms of it that the sample lacks share what others have shown. Every coordinate has a learning rate
of its own, and the L1 bound leaves only features that many texts speak for: the weights are a short sorted list of numbers
and values, which a task looks up.

Texts are hashed where they lie, and only the numbers of a sample go to the one task that learns. The sample is bounded in
rows and in bytes of text, both parameters; texts of more than `common.SAMPLE_TEXT_BYTES` are scored but not learnt from.

Defined results: null and empty texts have no features and score the bias alone; where there is no labelled row the score is
0.5, as it is where the sample has none. Rows are independent, repeated ones get equal scores; a document with more than one
label counts as toxic if one of them says so. Whole texts are read. The column that is added replaces one of its name, other
columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

WORD = regex.compile(r"\w+")
#: Words from the first to the second of a pair.
STEPS = (1, 2, 3)
#: Letters of a word's beginnings.
STEMS = (4, 5, 6)
#: Odd multipliers that mix two hashes, one pair of them for each step. Fixed values.
MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Labelled rows that are learnt from, and bytes of their texts, at most about.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 64 << 20
#: Learning rate, its delay, bounds that draw weights to zero, passes over the sample.
ALPHA, BETA, L1, L2, ROUNDS = 0.5, 1.0, 8.0, 1.0, 3
REMEMBERED = 400_000


class Hashes(dict):
    """word -> hashes of it and of its beginnings, 0 where it is shorter; forgets all when it grows past its bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        value = xxh64_intdigest(word, 3), *(xxh64_intdigest(word[:k], k) if len(word) >= k else 0 for k in STEMS)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def hashed(text: str, known: Hashes) -> np.ndarray:
    """The features of a text, each as often as it occurs."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint32)
    rows = np.array([known[x] for x in words], np.uint64)
    w, stems = rows[:, 0], rows[:, 1:].ravel()
    parts = [w * MIX[0], stems[stems > 0]]
    for k in STEPS:
        parts.append((w[:-k] * MIX[k] + w[k:]) * MIX[0])
    return (np.concatenate(parts) >> np.uint64(32)).astype(np.uint32)


def features(text: str, known: Hashes) -> np.ndarray:
    """The distinct features of a text, in ascending order."""
    return np.unique(hashed(text, known))


class Weights:
    """Sorted feature numbers with their weights, none of them zero, and the bias."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray, bias: float):
        self.numbers, self.values, self.bias = numbers, values, bias
        self.upper = np.zeros(1 << 16, bool)  # upper halves of the numbers: few features pass
        self.upper[numbers >> 16] = True

    def score(self, found: np.ndarray) -> float:
        """Probability of label 1 for a text's features."""
        found = np.unique(found[self.upper[found >> 16]])
        at = np.searchsorted(self.numbers, found)
        hit = at < len(self.numbers)
        hit[hit] = self.numbers[at[hit]] == found[hit]
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.values[at[hit]].sum()), -35, 35))))


def train_ftrl(docs: list[np.ndarray], labels: np.ndarray, *, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, rounds: int = ROUNDS) -> Weights:
    """Weights after `rounds` passes; a text is its distinct features, each with value 1. The bias is not drawn to zero.

    A weight leaves zero once gradients, none of them over 1, add up to more than l1: features of fewer texts than that
    takes in all passes stay at zero whatever happens, and are left out beforehand.
    """
    numbers, times = np.unique(np.concatenate([np.empty(0, np.uint32), *docs]), return_counts=True)
    numbers = numbers[times * float(rounds) > l1]
    del times
    bias = len(numbers)
    rows = []
    for doc in docs:
        at = np.searchsorted(numbers, doc)
        at[at == bias] = 0
        rows.append(np.append(at[numbers[at] == doc] if bias else at[:0], bias))
    bound = np.append(np.full(bias, l1), 0.0)
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weigh(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= bound[i], 0.0, (np.sign(z[i]) * bound[i] - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(rounds):
        for i, label in zip(rows, labels, strict=True):
            w = weigh(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            rate = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - rate * w
            n[i] += g * g
    w = weigh(slice(None))
    on = np.flatnonzero(w[:-1])
    return Weights(numbers[on], w[on], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Weights | None:
    """Weights learnt from a sample of the labelled documents (doc_id, text; doc_id, label 0 or 1)."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    size = docs.select(F.least(F.octet_length("text"), F.lit(common.SAMPLE_TEXT_BYTES)).alias("n")).agg(F.avg("n")).first()[0] or 1.0
    sample = common.labelled_sample(docs, marks, int(min(sample_rows, max(1, sample_bytes / size))))

    def numbered():
        known = common.keep(("words",), Hashes)

        def each(batch):
            found = [features(t, known).tobytes() for t in common.as_texts(batch.column("text"))]
            return common.replaced(batch, ["text"], features=pa.array(found, pa.binary()))

        return each

    def learn(table: pa.Table) -> bytes:
        found = [np.frombuffer(x, np.uint32) for x in table.column("features").to_pylist()]
        w = train_ftrl(found, table.column("label").to_numpy().astype(float))
        return common.packed(numbers=w.numbers, values=w.values, bias=np.float64(w.bias))

    rows = common.arrow_map(sample.select("doc_id", "text", "label"), numbered, "doc_id string, label int, features binary" if dict(docs.dtypes)["doc_id"] == "string" else "doc_id long, label int, features binary")
    raw = common.in_one_task(rows.withColumn("mixed", F.xxhash64("doc_id")), learn, ["mixed", "doc_id", "features"])
    if not raw:
        return None
    w = common.unpacked(raw)
    return Weights(w["numbers"], w["values"], float(w["bias"]))


def score(df: DataFrame, weights: Weights | None, text: str = "text", to: str = "score") -> DataFrame:
    """`df` without `text`, with the probability of label 1 in column `to`."""

    def make():
        known = common.keep(("words",), Hashes)

        def each(batch):
            out = [weights.score(hashed(t, known)) if weights else 0.5 for t in common.as_texts(batch.column(text))]
            return common.replaced(batch, [text], **{to: pa.array(out, pa.float64())})

        return each

    kept = df.drop(to)
    return common.arrow_map(kept, make, kept.drop(text).withColumn(to, F.lit(0.0)).schema)
