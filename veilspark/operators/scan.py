"""Span extraction: every match of a rule pack, with offsets, as one array column.

Spark finds all matches but not where they are. The gaps between matches come from `split`
on the same pattern, so a running sum over gaps and matches gives each start; all of it is
JVM-side (`native`). Packs with many rules or dense patterns scan faster in one Arrow call
over Python's `re` (`arrow`). Both give the same spans: offsets are code points, ends are
exclusive, and spans are sorted by (start, -score, order of rule, order of match).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from operator import itemgetter
from re import _constants as sre
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.pieces import offsets, pieces
from ..functions.rules import Profile, Rule
from ..functions.validate import VALIDATORS

#: The first three fields are the sort key of the overlap folds.
SPAN = "start int, neg_score double, ord int, end int, type string, text string, score double, method string"
SPANS = f"array<struct<{SPAN.replace(' int', ':int').replace(' double', ':double').replace(' string', ':string')}>>"
#: Rules up to which the native scan is the default.
NATIVE_RULES = 12


def span(start: Column, end: Column, kind: Column, text: Column, score: Column, method: Column, order: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        (-score).cast("double").alias("neg_score"),
        order.cast("int").alias("ord"),
        end.cast("int").alias("end"),
        kind.alias("type"),
        text.alias("text"),
        score.cast("double").alias("score"),
        method.alias("method"),
    )


def empty() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, rule: Rule, order: int = 0) -> Column:
    """Spans of one rule, in order of start."""
    pattern = F.lit(rule.java)
    sofar = "struct<pos:int,out:" + SPANS + ">"

    def fold(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            start = F.struct(F.lit(0).alias("pos"), empty().alias("out")).cast(sofar)

            def step(acc: Column, i: Column) -> Column:
                hit = F.get(found, i)
                at = acc["pos"] + F.length(F.get(gaps, i))
                if rule.group:
                    part = F.regexp_extract(hit, rule.java, rule.group)
                    one = tx.bind(part, lambda p: tx.bind(at + F.position(p, hit) - 1, lambda s: span(s, s + F.length(p), F.lit(rule.type), p, F.lit(rule.score), F.lit(rule.method), F.lit(order))))
                else:
                    one = span(at, at + F.length(hit), F.lit(rule.type), hit, F.lit(rule.score), F.lit(rule.method), F.lit(order))
                return F.struct((at + F.length(hit)).alias("pos"), F.concat(acc["out"], F.array(one)).alias("out")).cast(sofar)

            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])

        # the gaps are only looked for where there are matches
        return F.when(F.size(found) == 0, empty()).otherwise(tx.bind(F.split(text, rule.java, -1), with_gaps))

    out = tx.bind(F.regexp_extract_all(text, pattern, F.lit(0)), fold)
    if rule.needs:
        out = F.when(text.contains(rule.needs), out).otherwise(empty())
    if rule.validator:
        out = F.filter(out, lambda s: F.coalesce(VALIDATORS[rule.validator](s["text"]), F.lit(False)))
    return out


def scan_native(text: Column, lang: Column, rules: tuple[Rule, ...]) -> Column:
    parts = []
    for k, rule in enumerate(rules):
        found = matches(text, rule, k)
        parts.append(F.when(lang.isin(*rule.langs), found).otherwise(empty()) if rule.langs else found)
    return F.coalesce(F.array_sort(F.concat(*parts)), empty()) if parts else empty()


DIGIT = re.compile(r"\d")


def digit(op, value) -> bool:
    if op is sre.LITERAL:
        return chr(value).isdecimal()
    return op is sre.RANGE and 48 <= value[0] <= value[1] <= 57 or op is sre.CATEGORY and value is sre.CATEGORY_DIGIT


@cache
def least_digits(pattern: str) -> int:
    """How many digits any match of a pattern has at least: a text with fewer has none, which is quicker to see than to search."""

    def least(parts) -> int:
        n = 0
        for op, value in parts:
            if op is sre.LITERAL:
                n += digit(op, value)
            elif op is sre.IN:
                n += all(digit(*x) for x in value)
            elif op is sre.BRANCH:
                n += min(map(least, value[1]))
            elif op is sre.SUBPATTERN:
                n += least(value[-1])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                n += value[0] * least(value[2])
        return n  # what else there is, such as look-around, counts as none

    return least(_parser.parse(pattern))


#: Classes of ASCII characters, as tables that make a character of the class "a" and any other byte a blank. Fixed values.
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = tuple(frozenset(map(ord, c)) for c in (UPPER, UPPER + DIGITS, UPPER + UPPER.lower() + DIGITS))
TABLES = tuple(bytes(97 if b in c else 32 for b in range(256)) for c in CLASSES)


@cache
def least_runs(pattern: str, ignore_case: bool = False) -> tuple[int, ...]:
    """For each of CLASSES, how many of its characters in a row any match of a pattern has at least.

    A part of a pattern is (longest run, run at its start, run at its end, whether all it matches is of the class).
    """

    def within(op, value, c) -> bool:
        if op is sre.LITERAL:
            return value in c
        return op is sre.RANGE and value[1] < 128 and c.issuperset(range(value[0], value[1] + 1))

    def then(a, b):
        return max(a[0], b[0], a[2] + b[1]), a[1] + b[1] * a[3], b[2] + a[2] * b[3], a[3] and b[3]

    def least(parts, c):
        out = nothing
        for op, value in parts:
            one = (0, 0, 0, False)  # what is not known to be of the class
            if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
                one = nothing
            elif op is sre.LITERAL and within(op, value, c) or op is sre.IN and all(within(*x, c) for x in value):
                one = (1, 1, 1, True)
            elif op is sre.BRANCH:
                ways = [least(x, c) for x in value[1]]
                one = (*(min(w[k] for w in ways) for k in range(3)), all(w[3] for w in ways))
            elif op is sre.SUBPATTERN and not value[1] & re.IGNORECASE:
                one = least(value[-1], c)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                inner = least(value[2], c)
                if inner[3]:
                    one = (*(value[0] * inner[0],) * 3, True)
                elif value[0]:
                    one = inner
            out = then(out, one)
        return out

    nothing, parsed = (0, 0, 0, True), _parser.parse(pattern)
    if ignore_case or parsed.state.flags & re.IGNORECASE:
        return (0,) * len(CLASSES)  # letters beyond ASCII fold to some of its letters
    return tuple(least(parsed, c)[0] for c in CLASSES)


#: Makes every digit of ASCII a zero: what is left is the shape of a text. Strings of a shape that are kept apart at most.
ZEROS, SHAPES = bytes.maketrans(b"123456789", b"0" * 9), 32
#: Characters of texts up to which searching them costs no more than looking at their runs and shape.
SHORT = 64


@cache
def least_shapes(pattern: str, ignore_case: bool = False) -> tuple[bytes, ...]:
    """Strings of which the shape of any match of a pattern has one at least, digits beyond ASCII aside; none if there are no such."""

    def better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
        if not b or "" in b:
            return a
        b = {x for x in b if not any(y in x for y in b if y != x)}
        return max((a, b), key=lambda x: (min(map(len, x)), -len(x))) if a else b

    def times(a: set[str], b: set[str], n: int = 1) -> set[str] | None:
        for _ in range(n):
            a = {x + y for x in a for y in b}
            if len(a) > SHAPES:
                return None
        return a

    def walk(parts) -> tuple[set[str] | None, set[str] | None]:
        """All strings that the parts match, if they are few, and the best of what any match has."""
        chain, best, whole = {""}, None, True
        for op, value in parts:
            step, inside, after = None, None, {""}
            if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
                step = {""}
            elif op is sre.LITERAL:
                step = {"0" if 48 <= value <= 57 else chr(value)}
            elif op is sre.IN and all(digit(*x) for x in value):
                step = {"0"}
            elif op is sre.IN and all(x is sre.LITERAL for x, _ in value):
                step = {"0" if 48 <= x <= 57 else chr(x) for _, x in value}
            elif op is sre.BRANCH:
                ways = [walk(x) for x in value[1]]
                step = set().union(*(w[0] for w in ways)) if all(w[0] is not None for w in ways) else None
                inside = set().union(*(w[1] for w in ways)) if all(w[1] for w in ways) else None
            elif op is sre.SUBPATTERN and not value[1] & re.IGNORECASE:
                step, inside = walk(value[-1])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and 0 < value[0] <= 64:
                one, inside = walk(value[2])
                least = one and times({""}, one, value[0])
                if least and value[0] == value[1]:
                    step = least
                elif least:
                    chain, after = times(chain, least) or least, least
            longer = times(chain, step) if step is not None else None
            if longer is None:
                best, chain, whole = better(better(best, chain), step or inside), after, False
            else:
                chain = longer
        return chain if whole else None, better(best, chain)

    parsed = _parser.parse(pattern)
    if ignore_case or parsed.state.flags & re.IGNORECASE:
        return ()
    return tuple(sorted(x.encode() for x in walk(parsed)[1] or ()))


def digits_of(text: str) -> int:
    try:
        raw = text.encode("latin-1")  # which has no digits but those of ASCII
    except UnicodeEncodeError:
        return len(DIGIT.findall(text))
    return len(raw) - len(raw.translate(None, DIGITS.encode()))


def searched(text: str, ready: list[tuple[int, Rule, re.Pattern[str]]]) -> Iterator[tuple[int, Rule, re.Pattern[str]]]:
    """Those of the rules that may match: they need no more digits than the text has, no longer runs, and no shape it lacks."""
    digits, raw = digits_of(text), text.encode("utf-8", "replace")
    shape = raw.translate(ZEROS)
    plain = digits == shape.count(b"0")
    runs: dict[tuple[int, int], bool] = {}
    shown: dict[int, bytes] = {}

    def has(c: int, n: int) -> bool:
        if (c, n) not in runs:
            if c not in shown:
                shown[c] = raw.translate(TABLES[c])
            runs[c, n] = b"a" * n in shown[c]
        return runs[c, n]

    for k, r, pattern in ready:
        if least_digits(r.pattern) > digits or (r.needs and r.needs not in text):
            continue
        if len(text) <= SHORT:
            yield k, r, pattern
            continue
        if not all(n < 2 or has(c, n) for c, n in enumerate(least_runs(r.pattern, r.ignore_case))):
            continue
        shapes = least_shapes(r.pattern, r.ignore_case)
        if not (shapes and plain) or any(x in shape for x in shapes):
            yield k, r, pattern


def found(texts: list[str | None], langs: list[str | None], ready: list[tuple[int, Rule, re.Pattern[str]]]) -> pa.Array:
    """The spans of some texts, as an Arrow list for each; no row of Python objects outlives its text."""
    counts, start, ord_, end, hit = [], [], [], [], []
    for t, language in zip(texts, langs, strict=True):
        out = []
        for k, r, pattern in searched(t, [x for x in ready if not x[1].langs or language in x[1].langs]) if t else ():
            g, worse = r.group, -r.score
            out += [(m.start(g), worse, k, m.end(g), m.group(g)) for m in pattern.finditer(t)]
        out.sort(key=itemgetter(0, 1, 2, 3))
        counts.append(len(out))
        start += [s[0] for s in out]
        ord_ += [s[2] for s in out]
        end += [s[3] for s in out]
        hit += [s[4] for s in out]
    rules = [r for _, r, _ in ready]
    of = pa.array(ord_, pa.int32())
    each = {"start": pa.array(start, pa.int32()), "neg_score": pa.array([-r.score for r in rules], pa.float64()).take(of), "ord": of, "end": pa.array(end, pa.int32()), "type": pa.array([r.type for r in rules], pa.string()).take(of), "text": pa.array(hit, pa.string()), "score": pa.array([r.score for r in rules], pa.float64()).take(of), "method": pa.array([r.method for r in rules], pa.string()).take(of)}
    return pa.ListArray.from_arrays(offsets(counts), pa.StructArray.from_arrays(list(each.values()), list(each)))


def scan_arrow(text: Column, lang: Column, rules: tuple[Rule, ...]) -> Column:
    """The same spans by one Arrow UDF, some texts at a time; validators still run JVM-side."""

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ready = [(k, r, re.compile(r.pattern, re.IGNORECASE if r.ignore_case else 0)) for k, r in enumerate(rules)]
        for texts, langs in batches:
            for at, n in pieces(texts):
                yield found(texts.slice(at, n).to_pylist(), langs.slice(at, n).to_pylist(), ready)

    checked = [(k, r) for k, r in enumerate(rules) if r.validator]
    out = find(text, lang)
    if not checked:
        return out

    def good(s: Column) -> Column:
        ok = F.lit(True)
        for name in sorted({r.validator for _, r in checked}):
            ok = F.when(s["ord"].isin(*(k for k, r in checked if r.validator == name)), F.coalesce(VALIDATORS[name](s["text"]), F.lit(False))).otherwise(ok)
        return ok

    return F.filter(out, good)


def scan(text: Column, lang: Column, profile: Profile, backend: str = "auto") -> Column:
    """All spans of a profile's rules in a text; null text has none. Languages without rules use English ones."""
    if backend not in ("auto", "native", "arrow"):
        raise ValueError(f"no scan backend {backend!r}")
    backend = profile.backend if backend == "auto" else backend
    native = backend == "native" or backend == "auto" and len(profile.rules) <= NATIVE_RULES
    return (scan_native if native else scan_arrow)(text, tx.pattern_language(F.coalesce(lang, F.lit("en")), profile.languages), profile.rules)


#: Cheap marks of places that may hold something: fixed values.
MARKS = (Rule("email", "@"), Rule("phone", r"\d{3}"), Rule("card", r"\d{4}"), Rule("date", r"\d{2}[/-]"), Rule("ip", r"\d{1,3}\.\d{1,3}"))


def candidate_regions(df: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 20) -> DataFrame:
    """(key, line, start, end, kinds): merged stretches of each line around cheap marks, in offsets of the line.

    What lies outside cannot match a rule that needs one of the marks.
    """
    from .resolve import regions

    lines = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "body"))
    found = lines.select(key, "line", F.length("body").alias("n"), F.explode(scan_native(F.col("body"), F.lit("en"), MARKS)).alias("s"))
    wide = found.select(F.struct(key, "line").alias("place"), F.greatest(F.col("s.start") - reach, F.lit(0)).alias("start"), F.least(F.col("s.end") + reach, "n").alias("end"), "s.type")
    return regions(wide, "place").select(f"place.{key}", "place.line", "start", "end", "kinds")
