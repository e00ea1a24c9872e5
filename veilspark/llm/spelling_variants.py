"""Spelling variants: words one edit apart, by a forward and a reversed sorted dictionary.

Two words that differ by one inserted, deleted or replaced code point share the half that the edit leaves intact. So each word
stands in two dictionaries, twice in each: as a word of its own length r, and as the longer one beside words of length r =
length - 1. The forward one is sorted by r and the first half of r, the reversed one by r and the last half; words that share
this key are a block, and two near words of a pair of lengths always share one. Blocks are read as ranges of a sorted
partition. Skewed ones, of over BLOCK words, are subdivided first by Spark, and within a task by SMALL, in the same way: what
follows the shared half is halved again, and so on until words share all but one place. Pairs in a small block are verified by
the lengths of their common beginning and end, many blocks at a time.

Each pair is found in one block only: a block of the reversed dictionary takes pairs whose common beginning ends within the
first half, and subdivisions keep such a bound. Every step is exact.

Defined results: null texts have no words, an empty table has no rows. A null doc_id counts as empty text in the hash. Rows
that repeat a document count each time. Words of any length are taken whole. Only doc_id and text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Shortest word, least occurrences, one of how many runs loses a code point.
MIN_CHARS, MIN_TIMES, MANGLED = 7, 2, 31
#: How many times as frequent a form must be.
FORM_FACTOR = 10
#: Words of a block above which Spark subdivides it, and above which a task does.
BLOCK, SMALL = 2048, 24
#: Pairs verified at a time, and letters of the longest rest that is compared in the common table.
PAIRS, WIDE = 1 << 18, 48


def runs(text: Column, shortest: int = MIN_CHARS) -> Column:
    """Runs of letters of `shortest` code points or more, A-Z in lower case."""
    return F.regexp_extract_all(common.ascii_lower(text), F.lit(rf"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))


def mangled(doc_id: Column, run: Column, every: int = MANGLED) -> Column:
    """The run, or if `every` divides the hash of id and run, the run without the code point that the hash names."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def dictionary(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_times: int = MIN_TIMES, every: int = MANGLED) -> DataFrame:
    """(word, n) of a table (doc_id, text): what its runs give, how often."""
    each = docs.select("doc_id", F.explode(runs(F.col("text"), min_chars)).alias("run")).select(mangled(F.col("doc_id"), F.col("run"), every).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= min_chars) & (F.col("n") >= min_times))


def halved(rows: DataFrame) -> DataFrame:
    """The two dictionaries of (word, n, key, r, rest, below): rows of the half that is shared, and what is left of each.

    `rest` has r letters, or r + 1 where the word is the longer; `below`: pairs count whose rests share fewer letters at their beginnings.
    """
    half = "(r div 2)"
    sides = F.array(
        F.struct(
            F.expr(f"concat(key, '>', left(rest, {half}))").alias("key"),
            F.expr(f"r - {half}").alias("r"),
            F.expr(f"substring(rest, {half} + 1)").alias("rest"),
            F.expr(f"below - {half}").alias("below"),
        ),
        F.struct(
            F.expr(f"concat(key, '<', right(rest, r - {half}))").alias("key"),
            F.expr(half).alias("r"),
            F.expr(f"left(rest, length(rest) - r + {half})").alias("rest"),
            F.expr(f"least(below, {half})").alias("below"),
        ),
    )
    return rows.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.*")


def blocks(words: DataFrame, size: int = BLOCK) -> list[DataFrame]:
    """Tables (word, n, key, r, rest, below) of blocks of two words or more; none has over `size` unless its words share all but one place."""
    n = F.length("word")
    rows = words.withColumn("r", F.explode(F.array(n, n - 1))).select("word", "n", F.col("r").cast("string").alias("key"), "r", F.col("word").alias("rest"), (F.col("r") + 1).alias("below"))
    done, name = [], "variants-dictionary"
    while True:
        rows = common.materialize(halved(rows).where("below > 0"), name)
        done.append(rows)
        crowded = common.materialize(rows.where("r > 1").groupBy("key").count().where(F.col("count") > size).select("key"), "variants-crowded")
        if crowded.isEmpty():
            return done
        done[-1] = rows.join(crowded, "key", "left_anti")
        rows, name = rows.join(crowded, "key"), "variants-subdivided"


def near_pairs(rests: list[str], longer: np.ndarray, left: np.ndarray, right: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Which of the pairs (left, right) of rests, all distinct, are one edit apart with a common beginning of under `below` letters."""
    size = np.fromiter(map(len, rests), np.int64, len(rests))
    out = np.zeros(len(left), bool)
    a, b = size[left], size[right]
    open_ = ~(longer[left] & longer[right])  # these are another length's
    tall = np.maximum(a, b) > WIDE
    for k in np.flatnonzero(open_ & tall):
        out[k] = one_edit(rests[left[k]], rests[right[k]], below[k])
    k = np.flatnonzero(open_ & ~tall)
    if not len(k):
        return out
    width = int(np.maximum(a[k], b[k]).max()) + 1
    table = np.frombuffer("".join(x[:WIDE].ljust(width) if len(x) < width else x[:width] for x in rests).encode("latin-1"), np.uint8).reshape(-1, width)
    x, y, a, b = table[left[k]], table[right[k]], a[k], b[k]
    short = np.minimum(a, b)
    same = x == y
    start = np.minimum(np.where(same.all(1), width, np.argmin(same, 1)), short)
    # the ends: the longer one without its letter at `start` must equal the shorter one, or both without theirs
    at = np.arange(width)
    grown_x, grown_y = (a > b)[:, None] & (at >= start[:, None]), (b > a)[:, None] & (at >= start[:, None])
    shift = lambda t: np.concatenate([t[:, 1:], np.full((len(t), 1), 32, np.uint8)], 1)
    equal = np.where(grown_x, shift(x), x) == np.where(grown_y, shift(y), y)
    equal |= (a == b)[:, None] & (at == start[:, None])
    out[k] = equal.all(1) & (start < below[k])
    return out


def one_edit(a: str, b: str, below: int) -> bool:
    """As `near_pairs`, for two rests that may be very long."""
    if len(a) < len(b):
        a, b = b, a
    x, y = np.frombuffer(a.encode("latin-1"), np.uint8), np.frombuffer(b.encode("latin-1"), np.uint8)
    differ = np.flatnonzero(x[: len(y)] != y)
    start = int(differ[0]) if len(differ) else len(y)
    return start < below and bool((x[start + 1 :] == y[start + (len(a) == len(b)) :]).all())


def subdivided(members: list[int], rests: list[str], r: int, below: int, size: int = SMALL) -> Iterator[tuple[list[int], list[str], int]]:
    """(members, their rests, below) of blocks that hold every pair of `members` one edit apart just once; small ones, or such as share all but one place."""
    if len(members) <= size or r < 1:
        yield members, rests, below
        return
    half = r // 2
    if r == 1:  # words of one length differ in this place alone; the others share a first or a last letter with the longer ones
        same = [k for k, x in enumerate(rests) if len(x) == 1]
        if len(same) > 1:
            yield [members[k] for k in same], [rests[k] for k in same], below
        found: dict[tuple[int, str], list[int]] = {}
        for k, x in enumerate(rests):
            found.setdefault((1, x[0]), []).append(k)
            found.setdefault((0, x[-1]), []).append(k)
        for (side, _), ks in found.items():
            left = below - 1 if side else min(below, 1)
            short = [k for k in ks if len(rests[k]) == 1]
            for one in short if left > 0 else ():
                # a doubled letter shares the first and the last: it counts among those that share the first
                others = [k for k in ks if len(rests[k]) == 2 and (side or rests[k][0] != rests[one])]
                if others:
                    yield [members[k] for k in (one, *others)], [rests[k][1:] if side else rests[k][:-1] for k in (one, *others)], left
        return
    first: dict[str, list[int]] = {}
    last: dict[str, list[int]] = {}
    for k, x in enumerate(rests):
        first.setdefault(x[:half], []).append(k)
        last.setdefault(x[len(x) - r + half :], []).append(k)
    if below > half:
        for ks in first.values():
            if len(ks) > 1:
                yield from subdivided([members[k] for k in ks], [rests[k][half:] for k in ks], r - half, below - half, size)
    for ks in last.values():
        if len(ks) > 1:
            yield from subdivided([members[k] for k in ks], [rests[k][: len(rests[k]) - r + half] for k in ks], half, min(below, half), size)


class Links:
    """Pairs of the words of one task, gathered until PAIRS of them are verified together."""

    def __init__(self, small: int = SMALL):
        self.small = small
        self.words, self.times, self.rests, self.longer, self.left, self.right, self.below, self.held = [], [], [], [], [], [], [], 0

    def add(self, words: list[str], times: list[int], rests: list[str], r: int, below: int) -> None:
        for members, own, bound in subdivided(list(range(len(words))), rests, r, below, self.small):
            base, m = len(self.words), len(members)
            self.words += [words[k] for k in members]
            self.times += [times[k] for k in members]
            self.longer += [len(rests[k]) > r for k in members]
            self.rests += own
            i, j = np.triu_indices(m, 1)
            self.left.append(base + i)
            self.right.append(base + j)
            self.below.append(np.full(len(i), bound))
            self.held += len(i)

    def take(self) -> pa.RecordBatch:
        """(word, near, near_n) of both directions of the pairs so far that are one edit apart."""
        left, right, below = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.left, self.right, self.below))
        ok = near_pairs(self.rests, np.array(self.longer, bool), left, right, below)
        a, b = np.concatenate([left[ok], right[ok]]), np.concatenate([right[ok], left[ok]])
        words, times = pa.array(self.words, pa.string()), np.array(self.times, np.int64)
        self.__init__(self.small)
        return pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(times[b])], ["word", "near", "near_n"])


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the blocks that lie one after another in a sorted partition; a block is held at a time."""
    links, key, rows = Links(), None, []

    def close() -> None:
        if len(rows) > 1:
            links.add([x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], rows[0][3], rows[0][4])

    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "rest", "r", "below")), strict=True):
            if k != key:
                close()
                key, rows = k, []
                if links.held >= PAIRS:
                    yield links.take()
            rows.append(row)
    close()
    yield links.take()


def links(words: DataFrame, size: int = BLOCK) -> DataFrame:
    """(word, near, near_n) for every ordered pair of the distinct `words` (word, n) that are one edit apart."""
    out = None
    for table in blocks(words, size):
        sorted_ = table.repartition("key").sortWithinPartitions("key", "rest").select("key", "word", "n", "rest", "r", "below")
        found = sorted_.mapInArrow(scanned, "word string, near string, near_n long")
        out = found if out is None else out.unionByName(found)
    return out


def roots(forms: DataFrame, most: int, factor: int = FORM_FACTOR, least: int = MIN_TIMES) -> DataFrame:
    """(word, root) of (word, form): where the chain of forms ends. Chains are short, as n grows `factor` times at each step up to `most`."""
    out = forms.select("word", F.col("form").alias("root"))
    steps = max(1, ceil(log(max(most, 2) / least, factor)) + 1)
    for _ in range(max(1, ceil(log(steps, 2)))):
        at = common.materialize(out, "variants-roots")
        a, b = at.alias("a"), at.alias("b")
        out = a.join(b, F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"))
    return out


def group(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_times: int = MIN_TIMES, every: int = MANGLED, factor: int = FORM_FACTOR, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of a table (doc_id, text).

    form: the most frequent near word, the smallest of equals, if it is `factor` times as frequent; root: where forms lead.
    """
    words = common.materialize(dictionary(docs.select("doc_id", "text"), min_chars=min_chars, min_times=min_times, every=every), "variants-words")
    found = links(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(found, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= factor * F.col("n")
    near = common.materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "variants-near")
    most = near.agg(F.max("n")).first()[0] or 0
    ends = roots(near.where("form is not null"), most, factor, min_times)
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
