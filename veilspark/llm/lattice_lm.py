"""Language-model scoring: the marginal probability of a text over all its segmentations.

The pieces and their scores come from an existing vocabulary file (a parameter). A word is
written as "▁" and its letters; every way to cut it into pieces - and characters into byte
pieces - is weighed by the file's scores, and a log-space forward recursion over the lattice
sums them. A score is minus a rank and stands for a probability falling as 1 / rank.

This marginal is what the model knows about any word. What it learns is how often words occur
in the training texts: with c the word's count, N all counts, V distinct ones and G the share
that the lattice gives to the word among all words (or to the end of a text), a token's
probability is (c + (V + 1) G) / (N + V + 1). A text's is the product over its words and one
end. A word-unigram base score with add-half smoothing is given beside it.

Every distinct word is solved once, in a table of words that stays distributed. What is
shipped to executors is bounded: words that occur often enough that there are `COMMON` of them
at most, with their values. The others meet theirs in a join; which way a word goes changes
no result.

Defined results: null text counts as empty and has one token, its end. A-Z are lower-cased,
words are runs of anything but ASCII white space, of any length: long ones are solved block by
block. Rows are independent and may repeat. With no training text every count is 0, and the
file's scores alone make the model. An empty table gives an empty result. Columns of `df`
other than the text pass through, whatever their names; those of the result are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words that are shipped to executors, at most.
COMMON = 150_000
#: Words a worker counts before it lets go of them.
REMEMBERED = 200_000
#: Share of ends among the tokens of texts of which nothing is known.
END_SHARE = 0.001
MARK = "▁"
LN10 = math.log(10.0)
#: Cells of lattices that are held at a time.
GRID = 1 << 16
#: Counts are sorted into this many buckets for each doubling.
FINE = 16


class Pieces:
    """A vocabulary: byte pieces 0-255, then the others; log-probabilities of all."""

    def __init__(self, names: list[str], logs: list[float]):
        self.names, self.logs = names, np.asarray(logs, float)
        self.chars: dict[int, float] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {}
        for k in range(model.get_piece_size()):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
                found[model.id_to_piece(k)] = -model.get_score(k)
        names = [f"<0x{b:02X}>" for b in range(256)] + list(found)
        weights = [1 / (len(found) + 256 + 10)] * 256 + [1 / (rank + 10) for rank in found.values()]
        total = math.log(sum(weights))
        return cls(names, [math.log(w) - total for w in weights])

    def grid(self) -> Grid:
        key = len(self.names), zlib.crc32("\n".join(self.names).encode())
        if key not in _grids:
            _grids.clear()
            _grids[key] = Grid(self.names)
        return _grids[key]

    def by_bytes(self, codes: np.ndarray) -> np.ndarray:
        """ln of the probability of each character spelt in byte pieces."""
        kinds, back = np.unique(codes, return_inverse=True)
        for c in kinds.tolist():
            if c not in self.chars:
                self.chars[c] = float(self.logs[list(chr(c).encode("utf-8"))].sum())
        return np.array([self.chars[c] for c in kinds.tolist()])[back].reshape(codes.shape)

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """ln of the weight of each edge of the lattices (words, starts, lengths): its piece or, of one character, its bytes too."""
        ids = self.grid().find_all(codes)
        logs = np.where(ids >= 0, self.logs[ids], -np.inf)
        logs[:, :, 0] = np.logaddexp(logs[:, :, 0], self.by_bytes(codes))
        return logs

    def forward(self, codes: np.ndarray, block: int = GRID) -> np.ndarray:
        """ln of the summed weight of all ways through each word: forward recursion in log space.

        codes: characters of words of one length, a row each. Of a long word a block of characters at a time is
        looked at; only the sums at the last places, as far back as a piece reaches, go from block to block.
        """
        n, reach = codes.shape[1], min(self.grid().longest, codes.shape[1])
        last = np.full((len(codes), 1), 0.0)  # sums at the places before the block, the nearest last
        for start in range(0, n, block):
            end, first = min(n, start + block), start + 1 - last.shape[1]
            logs = self.edges(codes[:, first:end])
            longest = logs.shape[2]
            sums = np.full((len(codes), end - first + 1), -np.inf)
            sums[:, : last.shape[1]] = last
            for j in range(start - first + 1, end - first + 1):
                back = np.arange(1, min(longest, j) + 1)
                sums[:, j] = log_sum(sums[:, j - back] + logs[:, j - back, back - 1])
            last = sums[:, -reach:]
        return last[:, -1]

    def marginals(self, words: list[str]) -> np.ndarray:
        """ln of the summed probability of all segmentations of each word, by forward recursion in log space."""
        out = np.empty(len(words))
        for rows, codes in by_length(words):
            out[rows] = self.forward(codes)
        return out


#: The table of the vocabulary in use, some 5 MB, for all tasks of a worker.
_grids: dict[tuple[int, int], Grid] = {}


class Grid:
    """Finds the pieces at every place of many words at once, by rolling hashes in an open table."""

    BASE, SPREAD, SLOTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 20

    def __init__(self, names: list[str]):
        self.longest = max([len(x) for x in names[256:]], default=1)
        self.keys, self.slots = np.zeros(len(names), np.uint64), np.full(1 << self.SLOTS, -1, np.int32)
        for k, name in enumerate(names[256:], 256):
            h = 0
            for c in name:
                h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.keys[k] = h
        taken = self.slots.tolist()
        for k, i in enumerate((self.keys * self.SPREAD >> np.uint64(64 - self.SLOTS)).tolist()):
            if k >= 256:
                while taken[i] >= 0:
                    i = (i + 1) & ((1 << self.SLOTS) - 1)
                taken[i] = k
        self.slots = np.array(taken, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Pieces of hashes; -1 where there is none."""
        at = (h * self.SPREAD >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        out = self.slots[at]
        open_ = np.nonzero((out >= 0) & (self.keys[out] != h))
        while len(open_[0]):
            at[open_] = (at[open_] + 1) & ((1 << self.SLOTS) - 1)
            out[open_] = self.slots[at[open_]]
            again = (out[open_] >= 0) & (self.keys[out[open_]] != h[open_])
            open_ = tuple(x[again] for x in open_)
        return out

    def find_all(self, codes: np.ndarray) -> np.ndarray:
        """Piece numbers (words, starts, lengths)."""
        n = codes.shape[1]
        longest = min(self.longest, n)
        ids = np.full((*codes.shape, longest), -1, np.int32)
        h = np.zeros(codes.shape, np.uint64)
        for k in range(1, longest + 1):
            h = h[:, : n - k + 1] * self.BASE + codes[:, k - 1 :].astype(np.uint64) + np.uint64(1)
            ids[:, : n - k + 1, k - 1] = self.find(h)
        return ids


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, character codes) of words of one length each, as many as fit in GRID cells at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = int(sizes[order[at]])
        end = min(int(np.searchsorted(sizes[order], n, side="right")), at + max(1, GRID // max(n, 1)))
        rows = order[at:end]
        yield rows, np.frombuffer("".join(words[k] for k in rows.tolist()).encode("utf-32-le"), np.uint32).reshape(len(rows), n)
        at = end


def log_sum(x: np.ndarray) -> np.ndarray:
    """ln of the sum of exp over the last axis; each row has a finite value."""
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


def count_words(texts: DataFrame, text: str, train: str) -> DataFrame:
    """(word, c, seen): counts in the rows where `train` holds, and in all; the empty word counts ends, one for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def pack() -> pa.RecordBatch:
            words = list(learnt.keys() | held.keys())
            c = [learnt.get(w, 0) for w in words]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array([n + held.get(w, 0) for w, n in zip(words, c, strict=True)], pa.int64())], ["word", "c", "seen"])
            learnt.clear()
            held.clear()
            return out

        for batch in batches:
            for raw, own in zip(batch.column(text), batch.column(train).to_pylist(), strict=True):
                counts = learnt if own else held
                counts.update((raw.as_buffer().to_pybytes() if raw.is_valid else b"").lower().split())
                counts[b""] += 1
                if len(learnt) + len(held) > REMEMBERED:
                    yield pack()
        if learnt or held:
            yield pack()

    rows = texts.select(F.col(text).cast("binary").alias(text), train)
    return rows.mapInArrow(run, "word string, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def bucket(c: Column) -> Column:
    return F.floor(F.log2(c) * FINE)


def marginals(words: DataFrame, pieces: Pieces) -> DataFrame:
    """`words` with lattice: ln of the marginal of each word over its segmentations, 0 for the empty one."""

    def make():
        def each(batch):
            names = batch.column("word").to_pylist()
            own = [MARK + w for w in names if w]
            values = iter(pieces.marginals(own).tolist())
            return common.replaced(batch, [], lattice=pa.array([next(values) if w else 0.0 for w in names], pa.float64()))

        return each

    return common.arrow_map(words, make, words.withColumn("lattice", F.lit(0.0)).schema)


def score(df: DataFrame, train: Column, vocabulary: str, *, text: str = "text", common_words: int = COMMON) -> DataFrame:
    """`df` without `text`, with n_tokens, n_known, train_tokens, base_score and score (log10).

    train: which rows are learnt from. vocabulary: path of a sentencepiece model file.
    """
    uid, own, rest, flag = common.unused(df, "uid", "own", "rest", "flag")
    pieces = Pieces.load(vocabulary)
    counted = common.materialize(count_words(df.select(text, F.coalesce(train, F.lit(False)).alias(flag)), text, flag), "lm-counts")
    # a row for each bucket of counts: some hundreds, whatever the input's size
    found = counted.groupBy(bucket(F.col("seen")).alias("b")).agg(F.count("*").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum("c").alias("s")).collect()
    levels = sorted(((r.b, r.n) for r in found), reverse=True)
    v, total = sum(r.v for r in found), sum(r.s for r in found)
    least, taken = (levels[0][0] + 1 if levels else 0), 0
    for b, n in levels:
        if taken + n > common_words:
            break
        least, taken = b, taken + n

    # the marginals of all words sum to 1: the pieces that begin a word have the share that the others leave, where a word stops
    prior = v + 1
    given = F.when(F.col("word") == "", F.lit(END_SHARE)).otherwise((1 - END_SHARE) * F.exp("lattice"))
    # a marginal can be too small for a double: of a word without a count its ln is taken by itself
    deep = F.col("lattice") + math.log((1 - END_SHARE) * prior)
    ln = F.when((F.col("c") == 0) & (F.col("word") != ""), deep).otherwise(F.log(F.col("c") + prior * given)) - math.log(total + prior)
    base = F.log(F.col("c") + 0.5) - math.log(total + 0.5 * (v + 1))
    valued = common.materialize(marginals(counted, pieces).select("word", (F.col("c") > 0).alias("known"), base.alias("base"), ln.alias("ln"), "seen"), "lm-words")
    common.forget(counted)
    often = valued.where((bucket(F.col("seen")) >= least) | (F.col("word") == "")).drop("seen").toArrow().combine_chunks()
    key = ("lattice", common.uuid.uuid4().hex)

    def make():
        from pyspark import TaskContext

        def load() -> dict[bytes, tuple[bool, float, float]]:
            return dict(zip(often.column("word").cast(pa.binary()).to_pylist(), zip(*(often.column(c).to_pylist() for c in ("known", "base", "ln")), strict=True), strict=True))

        values, task, row = common.keep(key, load), TaskContext.get().partitionId() << 33, 0

        def each(batch):
            nonlocal row
            out, words, times, ends = [], [], [], [0]
            for raw in batch.column(text):
                counts = Counter((raw.as_buffer().to_pybytes() if raw.is_valid else b"").lower().split())
                (known, base, ln), tokens = values[b""], 1 + counts.total()
                seen = int(known)
                for word, n in counts.items():
                    if (x := values.get(word)) is None:
                        words.append(word)
                        times.append(n)
                    else:
                        seen += n * x[0]
                        base += n * x[1]
                        ln += n * x[2]
                ends.append(len(words))
                out.append((tokens, seen, base, ln))
            first, row = task + row, row + batch.num_rows
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            sums = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["tokens", "seen", "base", "ln"])
            looked = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int32())], ["word", "n"])
            return common.replaced(batch, [text], **{uid: pa.array(range(first, first + batch.num_rows), pa.int64()), own: sums, rest: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), looked)})

        return each

    out = df.drop("n_tokens", "n_known", "train_tokens", "base_score", "score").withColumn(text, F.col(text).cast("binary"))
    added = {uid: F.lit(0).cast("long"), own: F.expr("named_struct('tokens', 0L, 'seen', 0L, 'base', 0D, 'ln', 0D)"), rest: F.expr("cast(array() as array<struct<word:string,n:int>>)")}
    rows = common.materialize(common.arrow_map(out, make, out.drop(text).withColumns(added).schema), "lm-rows")
    looked_up = rows.select(F.col(uid).alias("uid"), F.inline(rest))
    rare = valued.where((bucket(F.col("seen")) < least) & (F.col("word") != ""))
    more = looked_up.join(rare, "word").groupBy("uid").agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("seen"), F.sum(F.col("n") * F.col("base")).alias("base"), F.sum(F.col("n") * F.col("ln")).alias("ln"))
    rows, more = rows.drop(rest).alias("r"), more.alias("m")
    joined = rows.join(more, F.col(f"r.{uid}") == F.col("m.uid"), "left")
    plus = lambda name: F.col(f"r.{own}.{name}") + F.coalesce(F.col(f"m.{name}"), F.lit(0))
    return joined.select(
        *(F.col(f"r.`{c}`") for c in out.columns if c != text),
        F.col(f"r.{own}.tokens").alias("n_tokens"),
        plus("seen").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (plus("base") / LN10).alias("base_score"),
        (plus("ln") / LN10).alias("score"),
    )
