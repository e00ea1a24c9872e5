"""Display form of texts in scripts that run from right to left: letters in their joined shapes, lines in visual order.

Shaping gives each Arabic letter the form that its neighbours call for, and lam with alef their ligature; vowel marks go. Lines
are then reordered by the implicit levels of the Unicode bidirectional algorithm (UAX #9): weak types W1-W7, neutrals N1 and N2,
levels I1 and I2, reversal of L1 and L2, mirrored brackets. Explicit embeddings and isolates count as neutrals, and pairs
of brackets (N0) are not resolved. A line's direction is that of its first strong letter.

Each character of the display form keeps the range of the source that it came from, so what is found in it can be told in the
source's offsets. Tables are derived from Python's Unicode data. All lines of some texts are worked on at once, as numpy arrays:
characters by their numbers, and runs of one kind by their ends, so no step takes a character at a time.

Defined results: null text gives null; a text without a right-to-left character is its own display form, and is not scanned
again; line ends stay where they are; a range that was torn apart by reordering goes back to the smallest range that holds it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pieces import offsets, pieces

#: Characters of scripts that run from right to left, and their presentation forms.
RIGHT_TO_LEFT = r"[֐-ࣿיִ-﷿ﹰ-ﻼ]"
#: Brackets that are mirrored. Fixed values.
MIRRORED = dict(zip("()[]{}<>«»", ")(][}{><»«", strict=True))
DISPLAY = "struct<text:string,first:array<int>,last:array<int>>"
LAM = "ل"
#: Positions in a word that presentation forms have names for.
FORMS = ("isolated", "final", "initial", "medial")


@cache
def shapes() -> tuple[dict[str, dict[str, str]], dict[str, dict[str, str]]]:
    """(letter -> form -> presentation form, alef -> form -> ligature with lam), from the compatibility decompositions."""
    letters: dict[str, dict[str, str]] = {}
    ligatures: dict[str, dict[str, str]] = {}
    for code in (*range(0xFB50, 0xFDFE), *range(0xFE70, 0xFEFD)):
        form, *source = unicodedata.decomposition(chr(code)).split() or [""]
        form, source = form.strip("<>"), [chr(int(s, 16)) for s in source]
        if form not in FORMS:
            continue
        if len(source) == 1:
            letters.setdefault(source[0], {}).setdefault(form, chr(code))
        elif len(source) == 2 and source[0] == LAM and unicodedata.bidirectional(source[1]) == "AL" and code >= 0xFEF5:
            ligatures.setdefault(source[1], {})[form] = chr(code)
    return letters, ligatures


#: Kinds of characters, by number; all others are neutral, as 0 is.
KINDS = ("N", "L", "R", "AL", "EN", "AN", "ES", "CS", "ET", "NSM", "WS", "BN", "S", "B")
N, L, R, AL, EN, AN, ES, CS, ET, NSM, WS, BN, S, B = range(len(KINDS))
#: The level of what is left after W7 and N2, by the line's direction.
LEVELS = np.array([[0, 0, 1, 1, 2, 2], [0, 2, 1, 1, 2, 2]], np.uint8)
BREAK = ord("\n")


@cache
def kinds(planes: int) -> np.ndarray:
    """The kind of each character of the first planes."""
    number = {k: n for n, k in enumerate(KINDS)}
    return np.array([number.get(unicodedata.bidirectional(chr(c)) or "L", N) for c in range(planes << 16)], np.uint8)


@cache
def joining() -> tuple[np.ndarray, ...]:
    """Letters of the first plane by number (0: none); for each, its FORMS, whether it joins on and back, and its ligatures with lam, isolated and final."""
    letters, ligatures = shapes()
    number, known = np.zeros(1 << 16, np.uint8), ["ـ", *letters]
    forms, joins = np.zeros((len(FORMS), len(known) + 1), np.uint32), np.zeros((2, len(known) + 1), bool)
    with_lam = np.zeros((2, len(known) + 1), np.uint32)
    for k, c in enumerate(known, 1):
        number[ord(c)] = k
        forms[:, k] = [ord(letters.get(c, {}).get(form, c)) for form in FORMS]
        joins[:, k] = [form in letters.get(c, ()) or c == "ـ" for form in ("initial", "final")]
        with_lam[:, k] = [ord(ligatures[c][form]) if c in ligatures else 0 for form in ("isolated", "final")]
    return number, forms, *joins, with_lam


@cache
def mirrors() -> np.ndarray:
    return np.array([ord(MIRRORED.get(chr(c), chr(c))) for c in range(256)], np.uint32)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chars(found: np.ndarray) -> str:
    return found.astype(np.uint32, copy=False).tobytes().decode("utf-32-le", "surrogatepass")


def kinds_of(found: np.ndarray) -> np.ndarray:
    return kinds(int(found.max(initial=0) >> 16) + 1)[found]


def runs(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of chosen places begin and end; neither the first place nor the last is chosen."""
    turns = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
    return turns[::2], turns[1::2]


def spread(to: np.ndarray, start: np.ndarray, end: np.ndarray, chosen: np.ndarray, values: np.ndarray) -> None:
    """Puts a value for each run of chosen places."""
    to[chosen] = np.repeat(values, end - start)


def joined(found: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters in their joined forms, and the place each comes from first; vowel marks belong to the letter before."""
    number, forms, joins_on, joins_back, with_lam = joining()
    place = np.flatnonzero((kind != NSM) | (found < 0x0600) | (found > 0x08FF))
    out = found[place]
    letter = number[np.minimum(out, 0xFFFF)]
    after = np.append(letter[1:], letter.dtype.type(0))
    pair = (out == ord(LAM)) & (with_lam[0] != 0)[after]
    on = joins_on[letter] & joins_back[after] & ~pair
    before = np.append(False, on[:-1])  # whether the character before reaches out to this one
    form = (before & joins_back[letter]) + 2 * on.astype(np.uint8)  # as FORMS counts them
    out = np.where(letter > 0, forms[form, letter], out)
    at = np.flatnonzero(pair)
    if len(at):
        out[at] = with_lam[before[at].astype(np.uint8), after[at]]
        out, place = np.delete(out, at + 1), np.delete(place, at + 1)
    return out, place


def levels_of(kind: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The embedding level of each character of lines that have a break before and after them; breaks have level 0."""
    ends = np.flatnonzero(breaks)
    strong = np.flatnonzero((kind == L) | (kind == R) | (kind == AL) | breaks)
    first = np.append(kind[strong[1:]], np.uint8(B))[breaks[strong]]  # after each break, the first strong letter
    base = ((first == R) | (first == AL)).astype(np.uint8)
    lines = np.diff(np.append(ends, len(kind)))
    edges = np.repeat(base + np.uint8(L), lines)
    t = np.where(breaks, edges, kind)  # before a line's first place stands its direction

    chosen = t == NSM  # W1: marks take the type before them
    if chosen.any():
        start, end = runs(chosen)
        spread(t, start, end, chosen, t[start - 1])
    numbers = np.flatnonzero(t == EN)  # W2, W3: numbers after Arabic letters, Arabic letters as right-to-left
    if len(numbers):
        strong = np.flatnonzero((t == L) | (t == R) | (t == AL))
        t[numbers[t[strong[np.searchsorted(strong, numbers) - 1]] == AL]] = AN
    t[t == AL] = R
    at = np.flatnonzero((t == ES) | (t == CS))  # W4: one separator between numbers
    if len(at):
        left = t[at - 1]
        here = (left == t[at + 1]) & ((left == EN) | (left == AN) & (t[at] == CS))
        t[at[here]] = left[here]
    chosen = t == ET  # W5: terminators beside numbers; W6: the others are neutral
    if chosen.any():
        start, end = runs(chosen)
        spread(t, start, end, chosen, np.where((t[start - 1] == EN) | (t[end] == EN), np.uint8(EN), np.uint8(N)))
    numbers = np.flatnonzero(t == EN)  # W6, W7
    if len(numbers):
        strong = np.flatnonzero((t == L) | (t == R))
        t[numbers[t[strong[np.searchsorted(strong, numbers) - 1]] == L]] = L
    t[t > AN] = N
    chosen = t == N
    start, end = runs(chosen)  # N1, N2
    edge = edges[start]
    left, right = (np.where(x == L, np.uint8(L), np.uint8(R)) for x in (t[start - 1], np.where(breaks[end], edge, t[end])))
    spread(t, start, end, chosen, np.where(left == right, left, edge))

    edges -= L  # from here on the lines' own levels
    out = LEVELS.ravel()[edges * np.uint8(LEVELS.shape[1]) + t]
    apart = (kind == S) | (kind == B)
    chosen = (kind == WS) | (kind == BN)  # L1: separators, and blanks before them or at the end of the line
    start, end = runs(chosen)
    last = chosen.copy()
    spread(last, start, end, chosen, apart[end] | breaks[end])
    last |= apart
    out = np.where(last, edges, out)
    out[breaks] = 0
    return out


def visual(level: np.ndarray) -> np.ndarray:
    """Which character stands at each place when runs of level 2, then those of 1 and more, are turned (L2)."""
    order = np.arange(len(level))
    within = order.copy()
    for to, chosen in ((within, level > 1), (order, level > 0)):
        start, end = runs(chosen)
        to[chosen] = np.repeat(start + end - 1, end - start) - np.flatnonzero(chosen)
    return within[order]


def display_all(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Display forms of some texts, one after the other; the first and last source place of each character, counted within its text; how many each has."""
    found = codes("\n".join(["", *texts, ""]))
    out, place = joined(found, kinds_of(found))
    breaks = out == BREAK
    level = levels_of(kinds_of(out), breaks)
    at = np.flatnonzero((level == 1) & (out < 256))
    out[at] = mirrors()[out[at]]
    order = visual(level)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])  # the breaks around the texts
    here = np.searchsorted(place, begin)
    counts = np.diff(here) - 1
    order = np.delete(order, here)
    start = np.repeat(begin[:-1] + 1, counts)
    last = np.append(place[1:], len(found)) - 1
    return chars(out[order]), (place[order] - start).astype(np.int32), (last[order] - start).astype(np.int32), counts


def shaped(text: str) -> tuple[list[str], list[int], list[int]]:
    """Characters in their joined forms, and the first and last source place of each; vowel marks belong to the letter before."""
    found = codes(text)
    out, place = joined(found, kinds_of(found))
    return list(chars(out)), place.tolist(), (np.append(place[1:], len(found))[: len(place)] - 1).tolist()


def levels(line: list[str]) -> list[int]:
    """The embedding level of each character of one line."""
    kind = np.pad(kinds_of(codes("".join(line))), 1, constant_values=B)
    breaks = np.zeros(len(kind), bool)
    breaks[[0, -1]] = True
    return levels_of(kind, breaks)[1:-1].tolist()


def display(text: str) -> tuple[str, list[int], list[int]]:
    """(display form, first and last source place of each of its characters)."""
    line, first, last, _ = display_all([text])
    return line, first.tolist(), last.tolist()


def parted(whole: str, counts: np.ndarray) -> list[str]:
    ends = np.cumsum(counts).tolist()
    return [whole[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def some(texts: list[str | None]) -> pa.Array:
    """DISPLAY of some texts, as Arrow's struct; all their lines are worked on at once, as arrays."""
    whole, first, last, counts = display_all([t or "" for t in texts])
    absent = np.array([t is None for t in texts], bool)
    places = [pa.ListArray.from_arrays(offsets(counts.tolist()), pa.array(p), mask=pa.array(absent)) for p in (first, last)]
    return pa.StructArray.from_arrays([pa.array(parted(whole, counts), pa.string(), mask=absent), *places], ["text", "first", "last"])


def displayed(text: Column) -> Column:
    """struct(text, first, last) of texts with right-to-left characters, null for the others; one Arrow call, some texts at a time."""

    @F.arrow_udf(DISPLAY)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for at, n in pieces(texts):
                yield some(texts.slice(at, n).to_pylist())

    return F.when(text.rlike(RIGHT_TO_LEFT), run(F.when(text.rlike(RIGHT_TO_LEFT), text)))


@cache
def bare() -> tuple[np.ndarray, dict[str, str]]:
    """(letter of each character of the first plane, ligature -> lam and alef)."""
    letters, ligatures = shapes()
    table = np.arange(1 << 16, dtype=np.uint32)
    for base, by in letters.items():
        table[[ord(shape) for shape in by.values()]] = ord(base)
    return table, {shape: LAM + alef for alef, by in ligatures.items() for shape in by.values()}


def undone_one(text: str, first: np.ndarray | None) -> str:
    """A display form in the source's order and bare letters; without places, in its own order."""
    table, ligatures = bare()
    found = codes(text)
    if first is not None:
        place = np.full(first.max(initial=-1) + 1, -1)
        place[first] = np.arange(len(first))
        found = found[place[place >= 0]]
    text = chars(np.where(found > 0xFFFF, found, table[np.minimum(found, 0xFFFF)]))
    for shape, pair in ligatures.items():
        text = text.replace(shape, pair)
    return text


def undone(text: Column, first: Column) -> Column:
    """Display forms put back in the source's order and bare letters, without vowel marks; mirrored brackets stay so."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, firsts in batches:
            for at, n in pieces(texts):
                both = zip(texts.slice(at, n).to_pylist(), firsts.slice(at, n), strict=True)
                yield pa.array([None if t is None else undone_one(t, f.values.to_numpy() if f.is_valid else None) for t, f in both], pa.string())

    return run(text, first)


def spans_back(spans: Column, shown: Column, text: Column) -> Column:
    """Spans of the display form in the source `text`: the smallest range that holds what each character came from."""

    def one(s: Column) -> Column:
        size = s["end"] - s["start"]
        start, end = F.array_min(F.slice(shown["first"], s["start"] + 1, size)), F.array_max(F.slice(shown["last"], s["start"] + 1, size)) + 1
        return s.withField("start", start).withField("end", end).withField("text", F.substr(text, start + 1, end - start))

    return F.array_sort(F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), one))
