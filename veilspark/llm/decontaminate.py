"""Benchmark decontamination: BM25 over an inverted index of test items, searched by every passage.

The test items are indexed by the longer of their two parts, question and answer: postings in
order of item, cut into blocks, each with the greatest score it can give. Every training text
is cut into overlapping passages, and each passage is a query: `Index.search` is block-max
WAND, which retrieves every item whose score reaches `threshold` of its part's score for
itself, or less where a part that has `overlap` of its shingles can score less: the words that
the missing shingles may take with them, the dearest first, are taken off. So a text whose copy
of the longer part lies in one passage is never lost, however rare the words that differ, and
the other part may lie anywhere. Retrieved items are verified on the whole text: `overlap` or
more of the question's five-word shingles must be in it, and of the answer's; what has fewer
words than a shingle must be there word for word.

Document frequencies, mean and greatest length are counted over all items, so the shards that
an item is indexed in change nothing. Items come in shards of at most SHARD (their number is
counted first). The driver builds one
index at a time and hands it to Spark as a broadcast variable; each worker goes through the
shards in turn, one in memory at a time, so what any process holds is bounded whatever the
table's size, and the texts are read once.

Defined results: null and empty texts, and texts without a word, are clean. Items that are
null or without a word are left out. Repeated items are each reported. Rows of `docs` are
independent; an empty table on either side gives an empty or a clean result. Extra columns
pass through; the names of RESULT are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = regex.compile(r"[\p{L}\p{N}]+")
SHINGLE = 5
K1, B = 1.2, 0.75
#: Share of an item's score for itself from which it is retrieved; share of its shingles from which it counts as leaked.
THRESHOLD, OVERLAP = 0.5, 0.8
#: Items in a shard, and blocks that a shard's postings are cut into, at most.
SHARD, BLOCKS = 8_192, 128
#: Words of a passage, at least; passages start every half of it.
PASSAGE = 128
#: Words of a text that are searched at a time.
SLAB = 1 << 16
RESULT = ("contaminated", "hits")


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


#: Where sentences end: at a mark before white space, or at a line's end. Fixed values, as the SQL twin has them.
SENTENCE = regex.compile(r"(?<=[.!?])[\x09-\x0D\x20]+|\n")


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence of several is the answer; a single sentence has none."""
    parts = [p for p in SENTENCE.split(text) if TOKEN.search(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def each_shingle(ws: list[str]) -> Iterator[str]:
    """The shingles of a list of words in order; a list of fewer words is one."""
    return (" ".join(ws[k : k + SHINGLE]) for k in range(max(1, len(ws) - SHINGLE + 1)) if ws)


def shingles(ws: list[str]) -> set[str]:
    return set(each_shingle(ws))


def removable(ws: list[str], share: dict[str, float], overlap: float) -> float:
    """What of the shares of its words a part may lack at most and still have `overlap` of its shingles.

    A word is missing only if all shingles that hold it are; a shingle takes SHINGLE words with it at most, so the words'
    numbers of shingles add up to no more than that for each missing one. Fractions of words are allowed: a bound, not a choice.
    """
    own = shingles(ws)
    missing = max(j for j in range(len(own) + 1) if not j or (len(ws) >= SHINGLE and (len(own) - j) / len(own) >= overlap))
    hold: Counter[str] = Counter()
    for s in own:
        hold.update(set(s.split(" ")))
    room, out = SHINGLE * missing, 0.0
    for w in sorted((w for w in share if hold[w] <= missing), key=lambda w: share[w] / hold[w], reverse=True):
        taken = min(1.0, room / hold[w])
        out += share[w] * taken
        room -= taken * hold[w]
        if room <= 0:
            break
    return out


@dataclass
class Corpus:
    """Counts over all items, of the parts that they are indexed by."""

    items: int
    mean: float
    longest: int
    spread: dict[str, int]  # word -> items that have it

    @classmethod
    def of(cls, entries: list[list[str]]) -> Corpus:
        return cls(len(entries), sum(map(len, entries)) / len(entries), max(map(len, entries)), Counter(w for ws in entries for w in set(ws)))


@dataclass
class Index:
    ids: list[int]
    terms: dict[str, int]  # word -> number, from 1
    items: np.ndarray  # postings: item numbers, in order within each term
    scores: np.ndarray  # and their shares of the item's score for itself
    first: np.ndarray  # where each term's postings start
    block: int  # items in a block
    peaks: np.ndarray  # (terms, blocks): the greatest score a term gives in a block
    need: np.ndarray  # what each item's threshold is a share of; the scores are divided by it
    parts: list[tuple[set[str], ...]]  # shingles of item, question, answer
    short: list[tuple[bool, ...]]  # which of these have fewer words than a shingle
    passage: int

    @classmethod
    def build(cls, rows: list[tuple[int, str]], corpus: Corpus | None = None, threshold: float = THRESHOLD, overlap: float = 1.0) -> Index | None:
        """The index of (item_id, text) rows; `corpus`: what was counted over all items, of which these may be a part."""
        split = [(i, words(t), t) for i, t in rows if t and TOKEN.search(t)]
        if not split:
            return None
        # items that share words get numbers close together, which keeps the peaks of blocks low
        split.sort(key=lambda x: (sorted(x[1], key=lambda w: (len(w), w))[:3], x[0] is None, x[0]))
        three = [(ws, *map(words, question_and_answer(t))) for _, ws, t in split]
        entries = [max(x[1:], key=len) for x in three]
        corpus = corpus or Corpus.of(entries)
        terms: dict[str, int] = {}
        counts = [Counter(terms.setdefault(w, len(terms) + 1) for w in ws) for ws in entries]
        spread = np.array([0, *(corpus.spread[w] for w in terms)])
        idf = np.log1p((corpus.items - spread + 0.5) / (spread + 0.5))
        postings: list[tuple[int, int, float]] = []
        need = np.ones(len(split))
        for d, (c, ws) in enumerate(zip(counts, entries, strict=True)):
            norm = K1 * (1 - B + B * len(ws) / corpus.mean)
            own = {k: idf[k] * tf * (K1 + 1) / (tf + norm) for k, tf in c.items()}
            whole = sum(own.values())
            least = 1 - removable(ws, {w: own[terms[w]] / whole for w in set(ws)}, overlap)
            need[d] = min(1.0, least * (1 - 1e-6) / threshold)
            postings += [(k, d, s / whole / need[d]) for k, s in own.items()]
        postings.sort()
        term, items, scores = (np.array(c) for c in zip(*postings, strict=True))
        n = len(split)
        block = -(-n // BLOCKS)
        peaks = np.zeros((len(terms) + 1, -(-n // block)), np.float32)
        np.maximum.at(peaks, (term, items // block), scores)
        parts, short = [tuple(map(shingles, x)) for x in three], [tuple(len(ws) < SHINGLE for ws in x) for x in three]
        return cls([i for i, _, _ in split], terms, items, scores, np.searchsorted(term, np.arange(len(terms) + 2)), block, peaks, need, parts, short, max(PASSAGE, 2 * corpus.longest))

    def wand(self, query: np.ndarray, block: int, threshold: float) -> list[int]:
        """Items of one block whose score for the distinct terms `query` reaches the threshold."""
        low, high, out = block * self.block, (block + 1) * self.block, []
        cursors = []  # [item, posting, end, peak]
        for k in query:
            a, z = self.first[k], self.first[k + 1]
            at = a + np.searchsorted(self.items[a:z], low)
            if at < z and self.items[at] < high:
                cursors.append([int(self.items[at]), int(at), int(z), float(self.peaks[k, block])])
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for c in cursors:
                bound += c[3]
                if bound >= threshold:
                    pivot = c[0]
                    break
            if pivot < 0:
                break
            if cursors[0][0] == pivot and sum(self.scores[c[1]] for c in cursors if c[0] == pivot) >= threshold:
                out.append(pivot)
            # cursors before the pivot move up to it; once all are there, they move past it
            target = pivot + 1 if cursors[0][0] == pivot else pivot
            moved = []
            for item, at, end, peak in cursors:
                while item < target:
                    at += 1
                    item = int(self.items[at]) if at < end else high
                if item < high:
                    moved.append([item, at, end, peak])
            cursors = moved
        return out

    def search(self, codes: np.ndarray, threshold: float) -> dict[int, list[int]]:
        """passage -> items, for the passages of a text given as term numbers (0: in no item).

        Passage p is the words from p * half to (p + 2) * half. Blocks whose summed peaks stay
        below the threshold are skipped for all passages at once.
        """
        half, found = self.passage // 2, {}
        known = np.flatnonzero(codes)
        if not len(known):
            return found
        part = known // half
        last = max(0, (len(codes) - 1) // half - 1)
        # every word is in two passages, except at the ends
        at = np.concatenate([np.minimum(part, last), np.clip(part - 1, 0, last)])
        pairs = np.unique(at * len(self.peaks) + np.concatenate([codes[known]] * 2))
        passage, term = np.divmod(pairs, len(self.peaks))
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        bounds = np.add.reduceat(self.peaks[term], starts, axis=0)
        for row, block in np.argwhere(bounds >= threshold - 1e-4):
            end = starts[row + 1] if row + 1 < len(starts) else len(term)
            if hit := self.wand(term[starts[row] : end], int(block), threshold):
                found.setdefault(int(passage[starts[row]]), []).extend(hit)
        return found

    def leaks(self, text: str, threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item id, shares of its shingles, its question's and its answer's that the text has) in order of id."""
        ws, found = words(text), set()
        codes = np.fromiter((self.terms.get(w, 0) for w in ws), np.int64, len(ws))
        half = self.passage // 2
        step = max(SLAB // half, 1) * half
        for k in range(0, max(len(ws) - half, 1), step):
            for items in self.search(codes[k : k + step + half], threshold).values():
                found.update(items)
        if not found:
            return []
        wanted = set().union(*(p for d in found for p in self.parts[d]))
        there = {s for s in each_shingle(ws) if s in wanted}
        if any(any(self.short[d]) for d in found):
            whole = f" {' '.join(ws)} "
            there |= {s for d in found for p, few in zip(self.parts[d], self.short[d], strict=True) if few for s in p if f" {s} " in whole}
        out = []
        for d in found:
            shares = tuple(len(p & there) / len(p) if p else 1.0 for p in self.parts[d])
            if min(shares[1:]) >= overlap:
                out.append((self.ids[d], *shares))
        return sorted(out, key=lambda x: (x[0] is None, x))


def entry_words(rows: DataFrame) -> DataFrame:
    """(item_id, text, size, word): the words in the part that each item is indexed by; size: how many there are with repeats."""

    def make():
        def each(batch):
            out = []
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws = max(map(words, question_and_answer(t)), key=len) if t and TOKEN.search(t) else []
                out += [(i, t, len(ws), w) for w in sorted(set(ws))]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["item_id", "text", "size", "word"])

        return each

    return common.arrow_map(rows, make, "item_id long, text string, size long, word string")


def shards(items: DataFrame, size: int = SHARD, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[Index]:
    """Indexes over all of `items` (item_id, text), each of about `size` at most, one after another.

    With more than one shard, words are counted over all items in a table, of which the driver gets a shard's at a time.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n = -(-rows.count() // size)
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    order = lambda found: sorted(((r.item_id, r.text) for r in found), key=lambda x: (x[0] is None, x))
    if n > 1:
        each = entry_words(rows)
        spread = common.materialize(each.groupBy("word").agg(F.count("*").alias("n")), "items-spread")
        # an item's size is told once, by its first word
        once = each.groupBy("item_id", "text").agg(F.max("size").alias("size"), (F.count("*") / F.countDistinct("word")).alias("times"))
        total = once.agg(F.sum("times").alias("items"), F.sum(F.col("times") * F.col("size")).alias("words"), F.max("size").alias("longest")).first()
    for k in range(n):
        if n == 1:
            index = Index.build(order(rows.collect()), None, threshold, overlap)
        elif not total["items"]:
            return
        else:
            here = rows.where(shard == k)
            counted = spread.join(entry_words(here).select("word").distinct(), "word").collect()
            corpus = Corpus(int(total["items"]), total["words"] / total["items"], total["longest"], {r.word: r.n for r in counted})
            index = Index.build(order(here.collect()), corpus, threshold, overlap)
        if index:
            yield index
    if n > 1:
        common.forget(spread)


def mark(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, overlap: float = OVERLAP, text: str = "text", size: int = SHARD) -> DataFrame:
    """`docs` with hits (array of item_id, overlap, question, answer, by id) and contaminated."""
    names = ("item_id", "overlap", "question", "answer")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in names[1:])]))
    out = docs.drop(*RESULT).withColumn("hits", F.expr("cast(array() as array<struct<item_id:bigint,overlap:double,question:double,answer:double>>)"))
    boxes = [docs.sparkSession.sparkContext.broadcast(index) for index in shards(items, size, threshold, overlap)]

    def make():
        def each(batch):
            texts = batch.column(text)
            hits = [[] for _ in range(len(texts))]
            for box in boxes:
                index = box.value
                for own, t in zip(hits, texts, strict=True):
                    if t.is_valid:
                        own += [dict(zip(names, x, strict=True)) for x in index.leaks(t.as_py(), threshold, overlap)]
                if len(boxes) > 1:  # the next one takes its place
                    box.__dict__.pop("_value", None)
            return common.replaced(batch, ["hits"], hits=pa.array(hits, kind))

        return each

    if boxes:
        out = common.arrow_map(out, make, out.schema)
    return out.withColumn("hits", F.array_sort("hits")).withColumn("contaminated", F.size("hits") > 0)
