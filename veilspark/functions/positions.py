"""Positions through changes of a text: run-length maps from a cleaned text, or a chunk of one, back to the original.

A cleaning step replaces the matches of a pattern. Its map has a breakpoint where a kept stretch or a replaced one begins,
so it grows with the edits and not with the text. Positions go back by binary search for their stretch: within a kept one
they keep their distance, within a replaced one they are interpolated. Several steps keep a map each, taken from the last
to the first.

Defined results: null text has no cleaned form and no maps; an empty one has maps with the end alone. A position past
the cleaned end keeps its distance from the original's end; where a step has dropped characters, a position is that of the
next one kept, and the end of a span that of its last character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from .pieces import offsets, pieces

#: at: where a stretch begins in the cleaned text; source: in the original; size: its length there. The last one is the end.
MAP = "struct<at:array<int>,source:array<int>,size:array<int>>"
CLEANED = f"struct<text:string,maps:array<{MAP}>>"
#: Steps of the library's own clean-ups: (pattern, replacement). Fixed values.
MARKDOWN = ((r"[*#_\[\]]", ""),)
LINES = ((r"\r\n?", "\n"), (r"[ \t]+", " "), ("[​-‍﻿]", ""))
BLANKS = ((r"\s+", " "), ("[​-‍﻿]", ""), (r"^\s+|\s+$", ""))


def one_step(text: str, pattern: re.Pattern[str], replacement: str) -> tuple[str, dict[str, list[int]]]:
    """(the text with all matches replaced, the map back)."""
    at, source, size, out = [], [], [], []
    done = here = 0

    def stretch(new: int, old: int) -> None:
        nonlocal here
        if new:
            at.append(here)
            source.append(done)
            size.append(old)
            here += new

    for m in pattern.finditer(text):
        if m.end() > m.start():
            stretch(m.start() - done, m.start() - done)
            out.append(text[done : m.start()])
            done = m.start()
            stretch(len(replacement), m.end() - done)
            out.append(replacement)
            done = m.end()
    stretch(len(text) - done, len(text) - done)
    out.append(text[done:])
    return "".join(out), {"at": [*at, here], "source": [*source, len(text)], "size": [*size, 0]}


def some(texts: list[str | None], ready: list[tuple[re.Pattern[str], str]]) -> pa.Array:
    """CLEANED of some texts, as Arrow's struct; null for a null text in both fields."""
    clean: list[str | None] = []
    parts: dict[str, list[np.ndarray]] = {"at": [], "source": [], "size": []}
    for t in texts:
        for pattern, replacement in ready if t is not None else ():
            t, one = one_step(t, pattern, replacement)
            for name, places in one.items():
                parts[name].append(np.array(places, np.int32))
        clean.append(t)
    lists = [pa.ListArray.from_arrays(offsets([len(p) for p in part]), pa.array(np.concatenate([np.zeros(0, np.int32), *part]))) for part in parts.values()]
    maps = pa.StructArray.from_arrays(lists, list(parts))
    first = offsets([0 if t is None else len(ready) for t in clean])
    absent = pa.array([t is None for t in clean], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(clean, pa.string()), pa.ListArray.from_arrays(first, maps, mask=absent)], ["text", "maps"])


def cleaned(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    """struct(text, maps): the text after the steps, and the map of each; one Arrow call, some texts at a time."""

    @F.arrow_udf(CLEANED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = [(re.compile(p), r) for p, r in steps]
        for texts in batches:
            for at, n in pieces(texts):
                yield some(texts.slice(at, n).to_pylist(), ready)

    return run(text)


def _before(one: Column, p: Column) -> Column:
    """Where position `p` of a cleaned text lies before one step."""
    n = F.size(one["at"])

    def halve(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = ((low + high + 1) / 2).cast("int")
        right = F.get(one["at"], middle) <= p
        return F.struct(F.when(right, middle).otherwise(low).alias("low"), F.when(right, high).otherwise(F.greatest(low, middle - 1)).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), (n - 1).alias("high")), halve, lambda r: r["low"])

    def inside(i: Column) -> Column:
        start, source = F.get(one["at"], i), F.get(one["source"], i)
        return F.when(i == n - 1, source + p - start).otherwise(source + F.floor((p - start).cast("long") * F.get(one["size"], i) / (F.get(one["at"], i + 1) - start)).cast("int"))

    return tx.bind(found, inside)


def original(maps: Column, p: Column) -> Column:
    """Where position `p` of a cleaned text lies in the original."""
    return F.aggregate(F.reverse(maps), p.cast("int"), lambda q, one: tx.bind(F.struct(one.alias("m"), q.alias("q")), lambda x: _before(x["m"], x["q"])).cast("int"))


def spans_back(spans: Column, maps: Column, text: Column) -> Column:
    """Spans of a cleaned text in the original `text`: its offsets and characters."""

    def one(s: Column) -> Column:
        start = original(maps, s["start"])
        end = F.when(s["end"] > s["start"], original(maps, s["end"] - 1) + 1).otherwise(start)
        return tx.bind(F.struct(s.alias("s"), start.alias("a"), end.alias("z")), lambda x: x["s"].withField("start", x["a"]).withField("end", x["z"]).withField("text", F.substr(text, x["a"] + 1, x["z"] - x["a"])))

    return F.array_sort(F.transform(spans, one))
