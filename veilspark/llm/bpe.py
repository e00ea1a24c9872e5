"""Byte-pair encodings of public tokenizer files, without the library that ships them.

Both operators read a tokenizer's JSON file (a parameter; never copied here) and
run its merges themselves:

* ``count_tokens`` - a heap of merge ranks over a linked list of symbols; a text's
  count is its initial symbols less its merges, and no identifiers are made;
* ``encode`` / ``decode`` - a merge queue with stale entries, giving identifiers;
  the queues of all pieces that some texts bring anew are popped together (``Queues``),
  long pieces have a heap each; decoding concatenates vocabulary strings.

Defined results: null and empty text give 0 tokens, no identifiers and an empty
decoded text. Strings of special tokens inside a text become that token, which is
the library's default. Rows are independent: repeated rows and ids, extra columns
and empty tables need no care. Words of any length cost n log n.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Unicode white space, spelt out as engines disagree on \s for U+001C..U+001F. Fixed values.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Code points that this machine's tables may hold for letters or numbers and those of Unicode 16 do not. Fixed values.
NEWER = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: Capitals of Unicode 16 and 17: first, last, first small letter. Fixed values.
CAPITALS = "1C89 1C89 1C8A, A7CB A7CB 0264, A7CC A7CC A7CD, A7CE A7CE A7CF, A7D2 A7D2 A7D3, A7D4 A7D4 A7D5, A7DA A7DA A7DB, A7DC A7DC 019B, 10D50 10D65 10D70, 16EA0 16EB8 16EBB"
#: The pre-tokenizer patterns of the two files, alternatives that cannot clash put in order of frequency. Fixed values.
PIECES = rf" ?\p{{L}}+| ?\p{{N}}+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORDS = rf"\p{{L}}+|\p{{N}}|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Pieces a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: The same where their ids are remembered packed, which takes less than two thirds of the memory.
REMEMBERED_PACKED = 300_000


def ranges() -> list[tuple[int, int]]:
    return [(int(a, 16), int(z or a, 16)) for a, _, z in (r.partition("-") for r in NEWER.split())]


#: The characters of NEWER, as a class; and capitals with their small letters.
NEW = regex.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in ranges()) + "]")
SMALL = {first + k: small + k for first, last, small in ([int(x, 16) for x in r.split()] for r in CAPITALS.split(",")) for k in range(last - first + 1)}


def latin(text: str) -> bool:
    """Whether no character is beyond U+00FF: a quick test, as none of NEWER or CAPITALS is within."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def of_unicode_16(pattern: str) -> str:
    """`pattern` with letters and numbers less those of NEWER."""
    newer = NEW.pattern
    return pattern.replace(r"\p{L}", rf"[\p{{L}}--{newer}]").replace(r"\p{N}", rf"[\p{{N}}--{newer}]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Bytes that print stand for themselves; the others take the letters from U+0100 on, in order.
    """
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Merges:
    """A tokenizer file: symbols, ranked merges, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged: dict[int, int] = {}  # both symbols in one integer -> rank and new symbol in one
        for rank, (a, b) in enumerate(steps):
            pair = self.vocab[a] << 20 | self.vocab[b]
            self.merged.setdefault(pair, rank << 20 | self.vocab[a + b])
        letters = byte_letters()
        self.symbol = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.lowers = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {"normalizers": []}).get("normalizers", []))
        pattern = WORDS if self.lowers else PIECES
        # sets that are differences match slowly: texts without a character of NEWER go by the plain ones, with equal results
        self.pattern, self.exact = regex.compile(pattern), regex.compile("(?V1)" + of_unicode_16(pattern))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        back = {c: b for b, c in enumerate(letters)}
        self.strings: list[bytes] = [b""] * (max([*self.vocab.values(), *self.specials.values()]) + 1)
        for s, i in self.vocab.items():
            self.strings[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        for s, i in self.specials.items():
            self.strings[i] = s.encode()

    def normal(self, text: str) -> str:
        if not self.lowers:
            return text
        # each character alone is lowered, so a capital sigma never takes its final form
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text if latin(text) else text.translate(SMALL)

    def pieces(self, text: str) -> list[str]:
        text = self.normal(text)
        return (self.pattern if latin(text) or not NEW.search(text) else self.exact).findall(text)

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        if not raw:
            return []
        symbol = self.symbol
        ids = [symbol[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return ids

    def merge(self, ids: list[int]) -> int:
        """Merges `ids` in place, lowest rank first and leftmost among equals; gives the number of merges.

        The symbol list is doubly linked by position. The heap holds rank and position in one
        integer; an entry is stale when the pair at its position no longer has that rank.
        Symbols merged away become -1.
        """
        n, find = len(ids), self.merged.get
        bits = n.bit_length()
        mask, heap = (1 << bits) - 1, []
        for i in range(n - 1):
            if (found := find(ids[i] << 20 | ids[i + 1])) is not None:
                heap.append(found >> 20 << bits | i)
        if not heap:
            return 0
        heapify(heap)
        after, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            top = heappop(heap)
            i = top & mask
            j, a = after[i], ids[i]
            if a < 0 or j >= n:
                continue
            found = find(a << 20 | ids[j])
            if found is None or found >> 20 != top >> bits:
                continue
            ids[i] = a = found & 0xFFFFF
            ids[j] = -1
            done += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := find(a << 20 | ids[k])) is not None:
                    heappush(heap, found >> 20 << bits | i)
            h = before[i]
            if h >= 0 and (found := find(ids[h] << 20 | a)) is not None:
                heappush(heap, found >> 20 << bits | h)
        return done

    def count(self, piece: str) -> int:
        ids = self.symbols(piece)
        return len(ids) - self.merge(ids)

    def encode(self, piece: str) -> tuple[int, ...]:
        ids = self.symbols(piece)
        return tuple(i for i in ids if i >= 0) if self.merge(ids) else tuple(ids)

    def packed(self, piece: str) -> bytes:
        """As `encode`, as 32-bit integers."""
        return array("i", self.encode(piece)).tobytes()

    def parts(self, text: str) -> list[tuple[int, list[str]]]:
        """(special id or -1, pieces) in order."""
        if self.split is None or not any(s in text for s in self.specials):
            return [(-1, self.pieces(text))]
        out = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                out.append((self.specials[part], []))
            elif part:
                out.append((-1, self.pieces(part)))
        return out


class Queues:
    """The merge queues of many short pieces, popped together: a column of each array is a piece, a row a position.

    A queue has a slot for each position: rank and position in one integer. In each round every queue gives its least
    entry; one whose symbols are no longer those of its rank is stale and dropped. A new entry takes the place of the
    one its position had, which is stale by then. Symbols are linked by position; those merged away become -1.
    """

    #: Bytes of the longest pieces of each array; a position takes POSITION bits. Pieces of an array at most. Fixed values.
    WIDTHS, POSITION, MANY = (8, 12, 16, 32), 5, 16_384
    PAD, NONE = (1 << 20) - 1, np.int32(2**31 - 1)

    def __init__(self, merges: Merges):
        self.merges = merges
        self.symbol, self.last = np.array(merges.symbol), np.array(merges.last)
        n = 1 + max(found >> 20 for found in merges.merged.values()) if merges.merged else 1
        self.left, self.right, self.into = np.zeros((3, n), np.int64)
        # pair -> rank: open addressing, a quarter full at most
        bits = max(4, (4 * n).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        found = np.fromiter(merges.merged.values(), np.int64, len(merges.merged))
        pairs = np.fromiter(merges.merged, np.int64, len(found))
        ranks = found >> 20
        self.left[ranks], self.right[ranks], self.into[ranks] = pairs >> 20, pairs & 0xFFFFF, found & 0xFFFFF
        for pair, at, rank in zip(pairs.tolist(), self.slot(pairs).tolist(), ranks.tolist(), strict=True):
            while self.pairs[at] >= 0:
                at = at + 1 & self.mask
            self.pairs[at], self.rank[at] = pair, rank

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NONE for those that do not merge."""
        at = self.slot(pairs)
        seen = self.pairs[at]
        same = seen == pairs
        out = np.where(same, self.rank[at], self.NONE)
        rest = np.flatnonzero(~same & (seen >= 0))
        while len(rest):
            at[rest] = step = at[rest] + 1 & self.mask
            seen = self.pairs[step]
            same = seen == pairs[rest]
            out[rest[same]] = self.rank[step[same]]
            rest = rest[~same & (seen >= 0)]
        return out

    def merged(self, raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces after their merges, in order, and how many each has."""
        n = len(raw)
        lengths = np.fromiter(map(len, raw), np.int64, n)
        ends, piece = np.cumsum(lengths), np.arange(n)
        letters = np.frombuffer(b"".join(raw), np.uint8)
        ids = np.full((width + 1) * n, self.PAD)  # its last row, PAD, is what lies before and after a piece
        place = (np.arange(len(letters)) - np.repeat(ends - lengths, lengths)) * n + np.repeat(piece, lengths)
        ids[place] = self.symbol[letters]
        ids[(lengths - 1) * n + piece] = self.last[letters[ends - 1]]
        row = np.arange(width + 1)
        after, before = np.repeat(np.minimum(row + 1, width), n), np.repeat(np.where(row, row - 1, width), n)
        found = self.ranks(ids[:-n] << 20 | ids[n:])
        queue = np.where(found < self.NONE, found << self.POSITION | np.repeat(row[:-1], n).astype(np.int32), self.NONE)
        while True:
            top = queue.reshape(width, n).min(axis=0)
            some = np.flatnonzero(top < self.NONE)
            if not len(some):
                break
            top = top[some].astype(np.int64)
            i, rank = top & (1 << self.POSITION) - 1, top >> self.POSITION
            here = i * n + some
            queue[here] = self.NONE
            there = after[here] * n + some
            good = (ids[here] == self.left[rank]) & (ids[there] == self.right[rank])  # the others are stale
            some, i, rank, here, there = some[good], i[good], rank[good], here[good], there[good]
            ids[here] = a = self.into[rank]
            ids[there] = -1
            after[here] = k = after[there]
            before[k * n + some] = i
            found = self.ranks(a << 20 | ids[k * n + some])
            fresh = found < self.NONE
            queue[here[fresh]] = found[fresh] << self.POSITION | i[fresh]
            h = before[here]
            found = self.ranks(ids[h * n + some] << 20 | a)
            fresh = found < self.NONE
            queue[(h * n + some)[fresh]] = found[fresh] << self.POSITION | h[fresh]
        out = ids[:-n].reshape(width, n).T
        kept = (out >= 0) & (out < self.PAD)
        return out[kept].astype(np.int32), kept.sum(axis=1)

    def packed(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """piece -> its ids as 32-bit integers."""
        pieces = list(pieces)
        raw = list(map(str.encode, pieces))
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(lengths, kind="stable")
        out, first = {}, 0
        for width, last in zip(self.WIDTHS, np.searchsorted(lengths[order], self.WIDTHS, side="right").tolist(), strict=True):
            for k in range(first, last, self.MANY):
                some = order[k : min(k + self.MANY, last)].tolist()
                ids, counts = self.merged([raw[i] for i in some], width)
                flat, ends = ids.tobytes(), [0, *(np.cumsum(counts) * ids.itemsize).tolist()]
                out.update(zip([pieces[i] for i in some], [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], strict=True))
            first = last
        out.update((pieces[i], self.merges.packed(pieces[i])) for i in order[first:].tolist())
        return out


class Remembered(dict):
    """piece -> what `make` gives for it; forgets all when it grows past its bound."""

    def __init__(self, make, bound: int = REMEMBERED):
        super().__init__()
        self.make, self.bound = make, bound
        self.long: list[str] = []  # what `learn` must not keep

    def learn(self, pieces: set[str], make_all: Callable[[set[str]], dict[str, bytes]]) -> None:
        """Knows all of `pieces` until the next call: those at hand stay, `make_all` gives the others.

        Before it would grow past its bound it forgets what is not among `pieces`.
        """
        for p in [p for p in self.long if p not in pieces]:
            del self[p]
        new = pieces.difference(self)
        if len(self) + len(new) > self.bound:
            known = {p: self[p] for p in pieces if p in self}
            self.clear()
            self.update(known)
        self.update(make_all(new))
        self.long = [p for p in pieces if len(p) > 64]

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= 64:  # long pieces are rare and would take the memory
            if len(self) >= self.bound:
                self.clear()
            self[piece] = value
        return value


def _tokenizer(path: str, what: str) -> tuple[Merges, Remembered]:
    def load():
        merges = Merges(path)
        gc.freeze()  # the vocabulary stays as it is: collections need not walk it
        return merges, Remembered(getattr(merges, what))

    return common.keep(("bpe", path, what), load)


def _encoder(path: str) -> tuple[Merges, Remembered, Queues]:
    def load():
        merges = Merges(path)
        queues = Queues(merges)
        gc.freeze()
        return merges, Remembered(merges.packed, REMEMBERED_PACKED), queues

    return common.keep(("bpe", path, "packed"), load)


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """`df` without `text`, with the number of tokens of each whole text in column `to`.

    tokenizer: path of the JSON file, the same on every machine.
    """

    def make():
        merges, counts = _tokenizer(tokenizer, "count")

        def each(batch):
            out = [sum(1 if special >= 0 else sum(map(counts.__getitem__, pieces)) for special, pieces in merges.parts(t)) for t in common.as_texts(batch.column(text))]
            return common.replaced(batch, [text], **{to: pa.array(out, pa.int64())})

        return each

    kept = df.drop(to)
    return common.arrow_map(kept, make, kept.drop(text).withColumn(to, F.lit(0).cast("long")).schema)


def _encoded(merges: Merges, known: Remembered, queues: Queues, texts: list[str]) -> pa.ListArray:
    parts = [merges.parts(t) for t in texts]
    known.learn(set().union(*(pieces for found in parts for _, pieces in found)), queues.packed)
    flat, ends = [], [0]
    for found in parts:
        raw = [array("i", [special]).tobytes() if special >= 0 else b"".join(map(known.__getitem__, pieces)) for special, pieces in found]
        flat += raw
        ends.append(ends[-1] + sum(map(len, raw)) // 4)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))


def encode(df: DataFrame, tokenizer: str, text: str = "text", to: str = "ids") -> DataFrame:
    """`df` without `text`, with the token ids of each whole text in column `to` (array of int)."""

    def make():
        merges, known, queues = _encoder(tokenizer)

        def each(batch):
            return common.replaced(batch, [text], **{to: _encoded(merges, known, queues, common.as_texts(batch.column(text)))})

        return each

    kept = df.drop(to)
    return common.arrow_map(kept, make, kept.drop(text).withColumn(to, F.array().cast("array<int>")).schema)


def text_of(strings: list[bytes], ids: list[int]) -> str:
    return b"".join(map(strings.__getitem__, ids)).decode("utf-8", "replace")


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """As `decode` of `encode`, in one pass: `df` without `text`, with `ids` and the text they stand for in column `decoded`."""

    def make():
        merges, known, queues = _encoder(tokenizer)

        def each(batch):
            found, lists = [], _encoded(merges, known, queues, common.as_texts(batch.column(text)))
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
            found = [text_of(merges.strings, values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return common.replaced(batch, [text], **{ids: lists, decoded: pa.array(found, pa.string())})

        return each

    kept = df.drop(ids, decoded)
    return common.arrow_map(kept, make, kept.drop(text).withColumns({ids: F.array().cast("array<int>"), decoded: F.lit("")}).schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """`df` with the text of `ids` in column `to`: vocabulary strings, concatenated; bad UTF-8 is replaced."""

    def make():
        strings = _encoder(tokenizer)[0].strings

        def each(batch):
            column = batch.column(ids)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)
            out = [text_of(strings, values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return common.replaced(batch, [to], **{to: pa.array(out, pa.string())})

        return each

    kept = df.drop(to)
    return common.arrow_map(kept, make, kept.withColumn(to, F.lit("")).schema)
