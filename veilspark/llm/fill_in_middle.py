"""Fill-in-middle: each text is cut into prefix, middle and suffix and written with the suffix before the middle.

A batch's texts lie one after another in one Arrow UTF-8 buffer and are worked on together: a table of byte classes
and the classes of adjacent bytes mark where units (code points, words or lines) begin; running counts of the marks,
set back at each text's start, number the units; a sorted search finds the bytes of all cuts. Buffers are read in
windows, so that besides the texts a task holds a window's counts only. Pieces are ranges of the same buffer.

`cuts` draws four numbers from a SHA-256 of seed and key: where prefix and middle end, whether a text stays plain, and
which order it takes. Forms: plain (the text), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), each
part after its marker. A text that holds a marker stays plain, so `restore` can tell the parts by the markers alone.

Defined results: null and empty texts have no unit and stay plain, as an empty output; a null key counts as empty
text in the hash; repeated rows get equal results. Columns that are added replace those of the same name, others pass
through. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 1
#: Of 100 texts as many stay plain, and of 100 others as many put the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
#: Bytes whose unit counts are held at a time.
WINDOW = 1 << 22
#: Classes of bytes: those that go on with a character, white space, ends of lines, all others.
GOES_ON, SPACE, END, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = GOES_ON
CLASS[[9, 11, 12, 13, 32]] = SPACE
CLASS[10] = END
#: unit -> whether one begins at a byte of class [1] after a byte of class [0].
BEGINS = {unit: np.zeros((4, 4), bool) for unit in ("char", "word", "line")}
BEGINS["char"][:, [SPACE, END, OTHER]] = True
BEGINS["word"][[SPACE, END], OTHER] = True
BEGINS["line"][END, [SPACE, END, OTHER]] = True


class Units:
    """The units of the texts data[ends[i]:ends[i + 1]]: running numbers, each of them one beginning."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str = "char", window: int = WINDOW):
        self.data, self.window, self.begins = data, window, BEGINS[unit].ravel()
        self.first, self.last = int(ends[0]), int(ends[-1])
        self.heads = ends[:-1][ends[1:] > ends[:-1]]

    def _windows(self):
        """(first byte, last, units begun before, running count of units at each byte)."""
        before = 0
        for a in range(self.first, self.last, self.window):
            z = min(a + self.window, self.last)
            kinds = CLASS[self.data[a - 1 : z]] if a > self.first else np.append(np.uint8(END), CLASS[self.data[a:z]])
            mark = self.begins[kinds[:-1] * np.uint8(4) + kinds[1:]]
            here = self.heads[np.searchsorted(self.heads, a) : np.searchsorted(self.heads, z)]
            mark[here - a] = True
            count = np.cumsum(mark, dtype=np.int32)
            yield a, z, before, count
            before += int(count[-1])

    def before(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before each of the bytes `at`, in ascending order."""
        out = np.zeros(len(at), np.int64)
        for a, z, n, count in self._windows():
            i, j = np.searchsorted(at, a, side="right"), np.searchsorted(at, z, side="right")
            out[i:j] = n + count[at[i:j] - a - 1]
        return out

    def starts(self, number: np.ndarray) -> np.ndarray:
        """The byte at which each of the units `number` (from 0, ascending) begins; the buffer's end for those past the last."""
        out = np.full(len(number), self.last, np.int64)
        for a, _, n, count in self._windows():
            i, j = np.searchsorted(number, n), np.searchsorted(number, n + int(count[-1]))
            out[i:j] = a + np.searchsorted(count, number[i:j] - n + 1)
        return out


def buffers(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts with null as empty, their bytes, where each begins and the last ends)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return texts, np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8), ends


def pieces(texts: pa.Array, *bounds: np.ndarray) -> list[pa.Array]:
    """The runs of bytes between neighbouring `bounds` of each text, which must cover it; nothing is copied but what is taken."""
    k = len(bounds) - 1
    flat = np.append(np.column_stack(bounds[:-1]).ravel(), bounds[-1][-1:]).astype(np.int64)
    every = pa.LargeStringArray.from_buffers(len(flat) - 1, pa.py_buffer(flat), texts.buffers()[2])
    rows = np.arange(len(bounds[0])) * k
    return [every.take(pa.array(rows + j)) for j in range(k)]


def written(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*(pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts), pa.scalar("", pa.large_string()))


def numbers(key: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of eight digits of the hex SHA-256 of seed, colon and key, as whole numbers."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rearranged(texts: pa.Array, h: list[np.ndarray], *, unit: str, markers: tuple[str, str, str], plain_percent: int, suffix_first_percent: int, window: int = WINDOW) -> dict[str, pa.Array]:
    """The columns of `transform` for a batch of texts and their four drawn numbers."""
    texts, data, ends = buffers(texts)
    found = Units(data, ends, unit, window)
    number = found.before(ends)
    base, n = number[:-1], np.diff(number)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    at = found.starts(np.column_stack([base + low, base + high]).ravel()).reshape(-1, 2)
    prefix, middle, suffix = pieces(texts, ends[:-1], np.minimum(at[:, 0], ends[1:]), np.minimum(at[:, 1], ends[1:]), ends[1:])
    marked = np.zeros(len(texts), bool)
    for m in markers:
        marked |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[2] % 100 >= 100 - plain_percent)
    first = h[3] % 100 < suffix_first_percent
    p, s, m = markers
    form = np.where(plain, "plain", np.where(first, "spm", "psm"))
    moved = pc.if_else(pa.array(first), written(s, suffix, p, prefix, m, middle), written(p, prefix, s, suffix, m, middle))
    return {
        "n": pa.array(n),
        "form": pa.array(form.tolist(), pa.string()),
        "prefix_units": pa.array(low, mask=plain),
        "middle_units": pa.array(high - low, mask=plain),
        "output": pc.if_else(pa.array(plain), texts, moved).cast(pa.string()),
    }


def transform(df: DataFrame, *, key: str = "doc_id", text: str = "text", unit: str = "char", seed: int = SEED, markers: tuple[str, str, str] = MARKERS, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """`df` without `text`, with n (units), form, prefix_units, middle_units (null if plain) and output.

    Units: char (code points), word (with the white space after it) or line (with its end).
    """
    if unit not in BEGINS:
        raise ValueError(f"no unit {unit!r}")
    if not all(markers) or any(overlap(a, b) for a in markers for b in markers):
        raise ValueError("no marker may be empty, hold another or end as one begins")
    added = {"n": F.lit(0).cast("long"), "form": F.lit(""), "prefix_units": F.lit(None).cast("long"), "middle_units": F.lit(None).cast("long"), "output": F.lit("")}
    kept = df.drop(*(c for c in added if c != text))
    drawn = common.unused(kept, "h1", "h2", "h3", "h4")

    def make():
        def each(batch):
            h = [batch.column(c).to_numpy() for c in drawn]
            out = rearranged(batch.column(text), h, unit=unit, markers=markers, plain_percent=plain_percent, suffix_first_percent=suffix_first_percent)
            return common.replaced(batch, [text, *drawn], **out)

        return each

    schema = kept.drop(text).withColumns(added).schema
    return common.arrow_map(kept.withColumns(dict(zip(drawn, numbers(F.col(key), seed), strict=True))), make, schema)


def overlap(a: str, b: str) -> bool:
    """Whether an end of marker `a` is a beginning of marker `b`, or one holds the other."""
    return (a != b and (a in b or b in a)) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))


def rebuilt(output: pa.Array, form: pa.Array, markers: tuple[str, str, str]) -> pa.Array:
    """The texts that gave a batch of outputs."""
    output, _, ends = buffers(output)
    start, end = ends[:-1], ends[1:]
    plain = pc.equal(form, "plain").to_numpy(zero_copy_only=False)
    first = pc.equal(form, "spm").to_numpy(zero_copy_only=False)
    size = [len(m.encode()) for m in markers]
    p, s, m = (np.where(plain, 0, pc.find_substring(output, x).to_numpy(zero_copy_only=False)) + start for x in markers)
    if (np.minimum(np.minimum(p, s), m) < start).any() or ((np.where(first, p, s) > m) & ~plain).any():
        raise ValueError("an output lacks a marker")
    # bounds in the order of the output: first marker, its part, second marker, its part, third marker, middle
    second, width = np.where(first, p, s), np.where(first, size[0], size[1])
    low = np.where(plain, start, start + np.where(first, size[1], size[0]))
    bounds = (start, low, np.where(plain, start, second), np.where(plain, start, second + width), np.where(plain, start, m), np.where(plain, start, m + size[2]), end)
    _, a, _, b, _, c = pieces(output, *bounds)
    first = pa.array(first)
    moved = written(pc.if_else(first, b, a), c, pc.if_else(first, a, b))
    return pc.if_else(pa.array(plain), output, moved).cast(pa.string())


def restore(df: DataFrame, *, output: str = "output", form: str = "form", to: str = "restored", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """`df` with the texts rebuilt from `output` and `form` in column `to`; `output` goes."""
    kept = df.drop(to)

    def make():
        def each(batch):
            return common.replaced(batch, [output], **{to: rebuilt(batch.column(output), batch.column(form), markers)})

        return each

    return common.arrow_map(kept, make, kept.drop(output).withColumn(to, F.lit("")).schema)
