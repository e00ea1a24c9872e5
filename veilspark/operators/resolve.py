"""Overlap resolution: policies over a text's spans, as folds of one array column.

Policies differ on purpose; each is named. All take spans sorted by (start, -score, rule
order), so ties keep the order of detection, and give spans sorted by start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from . import intervals
from .scan import SPANS, empty

#: Types whose neighbours may be parts of one entity, and how far apart they may be.
MERGE_GAP = 3
MERGEABLE = ("PERSON", "AR_NAME", "ADDRESS", "LOCATION", "ORGANIZATION", "DATE")


def _last(kept: Column) -> Column:
    return F.element_at(kept, -1)


def _put(kept: Column, s: Column) -> Column:
    return F.concat(kept, F.array(s))


def _swap(kept: Column, s: Column) -> Column:
    return F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))


def _fold(spans: Column, step: Callable[[Column, Column], Column]) -> Column:
    """A fold whose state is the spans kept so far; the first span is always kept."""
    return F.aggregate(spans, empty(), lambda kept, s: F.when(F.size(kept) == 0, F.array(s)).otherwise(step(kept, s)).cast(SPANS))


def greedy_first(spans: Column) -> Column:
    """A span stays if it starts at or after the end of the last one that stayed."""
    return _fold(spans, lambda kept, s: F.when(s["start"] >= _last(kept)["end"], _put(kept, s)).otherwise(kept))


def sweep_replace(spans: Column) -> Column:
    """Of overlapping spans a strictly better score replaces the current one."""
    return _fold(spans, lambda kept, s: F.when(s["start"] >= _last(kept)["end"], _put(kept, s)).when(s["score"] > _last(kept)["score"], _swap(kept, s)).otherwise(kept))


def sweep_margin(spans: Column) -> Column:
    """As sweep_replace, but better by over 0.1, or longer with at least the score."""

    def better(s: Column, c: Column) -> Column:
        return (s["score"] > c["score"] + 0.1) | ((F.length(s["text"]) > F.length(c["text"])) & (s["score"] >= c["score"]))

    return _fold(spans, lambda kept, s: F.when(s["start"] >= _last(kept)["end"], _put(kept, s)).when(better(s, _last(kept)), _swap(kept, s)).otherwise(kept))


def score_first_sweep(spans: Column) -> Column:
    """Best score first; a later span stays if it starts after the current one, or replaces it if better by over 0.1.

    Loses lower-scored spans that lie before a better one, as specified.
    """
    order = F.array_sort(spans, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["ord"] - b["ord"]))
    kept = _fold(order, lambda kept, s: F.when(s["start"] >= _last(kept)["end"], _put(kept, s)).when(s["score"] > _last(kept)["score"] + 0.1, _swap(kept, s)).otherwise(kept))
    return F.array_sort(kept)


def touching_sweep(spans: Column) -> Column:
    """Spans that touch count as overlapping; the better score stays."""
    return _fold(spans, lambda kept, s: F.when(s["start"] > _last(kept)["end"], _put(kept, s)).when(s["score"] > _last(kept)["score"], _swap(kept, s)).otherwise(kept))


def interval_union(spans: Column) -> Column:
    """Overlapping or touching spans become one: the union's extent, the best-scored one's other fields.

    The text is that of the best-scored span; `with_text` takes the union's.
    """

    def join(kept: Column, s: Column) -> Column:
        c = _last(kept)
        best = F.when(s["score"] > c["score"], s).otherwise(c)
        return _swap(kept, best.withField("start", F.least(c["start"], s["start"])).withField("end", F.greatest(c["end"], s["end"])))

    return _fold(spans, lambda kept, s: F.when(s["start"] <= _last(kept)["end"], join(kept, s)).otherwise(_put(kept, s)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two spans."""
    both = F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]), F.lit(0))
    whole = a["end"] - a["start"] + b["end"] - b["start"] - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def by_iou(spans: Column, least: float = 0.5, min_score: float = 0.0) -> Column:
    """A span is new unless one kept has IoU of `least` or more; the first such with a lower score is replaced.

    Spans come by their starts, so one kept that ends before a span starts meets no later one either: only those still open are
    compared. A `least` of 0 or below meets spans that lie apart, so all stay open.
    """

    def step(kept: Column, s: Column) -> Column:
        alike = F.exists(kept, lambda k: iou(k, s) >= least)
        at = F.array_position(F.transform(kept, lambda k: (iou(k, s) >= least) & (k["score"] < s["score"])), True)
        return F.when(~alike, _put(kept, s)).when(at > 0, F.transform(kept, lambda k, i: F.when(i == at - 1, s).otherwise(k))).otherwise(kept)

    good = F.filter(spans, lambda s: s["score"] >= min_score)
    if least <= 0:
        return F.array_sort(_fold(good, step))
    sofar = f"struct<done:{SPANS},open:{SPANS}>"

    def sweep(acc: Column, s: Column) -> Column:
        shut = F.filter(acc["open"], lambda k: k["end"] <= s["start"])
        done = F.when(F.size(shut) > 0, F.concat(acc["done"], shut)).otherwise(acc["done"])
        return F.struct(done.alias("done"), bind(F.filter(acc["open"], lambda k: k["end"] > s["start"]), lambda kept: step(kept, s)).alias("open")).cast(sofar)

    start = F.struct(empty().alias("done"), empty().alias("open")).cast(sofar)
    return F.array_sort(F.aggregate(good, start, sweep, lambda acc: F.concat(acc["done"], acc["open"])))


def keep_all(spans: Column) -> Column:
    return spans


POLICIES: dict[str, Callable[[Column], Column]] = {
    "greedy_first": greedy_first,
    "sweep_replace": sweep_replace,
    "sweep_margin": sweep_margin,
    "score_first_sweep": score_first_sweep,
    "touching_sweep": touching_sweep,
    "interval_union": interval_union,
    "iou": by_iou,
    "all": keep_all,
}


def resolve(spans: Column, policy: str) -> Column:
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}; there are {', '.join(POLICIES)}")
    return POLICIES[policy](spans)


def with_text(spans: Column, text: Column) -> Column:
    """Spans whose text is what the document has at their extent."""
    return F.transform(spans, lambda s: s.withField("text", F.substr(text, s["start"] + 1, s["end"] - s["start"])))


def merge_adjacent(spans: Column, text: Column, gap: int = MERGE_GAP) -> Column:
    """Neighbours of one mergeable type at most `gap` characters apart become one; two phones at any distance.

    The first's type, the best score, both methods, the text between them included.
    """

    def join(kept: Column, s: Column) -> Column:
        c = _last(kept)
        score = F.greatest(c["score"], s["score"])
        return _swap(kept, c.withField("end", F.greatest(c["end"], s["end"])).withField("score", score).withField("neg_score", -score).withField("method", F.concat_ws("+", c["method"], s["method"])))

    def near(c: Column, s: Column) -> Column:
        same = (c["type"] == s["type"]) & c["type"].isin(*MERGEABLE) | c["type"].isin("ADDRESS", "LOCATION") & s["type"].isin("ADDRESS", "LOCATION") | (c["type"] == "TITLE") & (s["type"] == "PERSON")
        return same & (s["start"] - c["end"] <= gap) | c["type"].contains("PHONE") & s["type"].contains("PHONE")

    return with_text(_fold(spans, lambda kept, s: F.when(near(_last(kept), s), join(kept, s)).otherwise(_put(kept, s))), text)


#: What does not belong to an entity at its beginning and at its end. Fixed values.
OPENERS = "\"'«([{"
CLOSERS = "\"'»)]}.,;:"


def trim_bounds(spans: Column, openers: str = OPENERS, closers: str = CLOSERS) -> Column:
    """Spans without white space around them, then without openers before and closers behind; spans of nothing else go."""

    def trim(s: Column) -> Column:
        bare = F.regexp_replace(s["text"], r"(?U)^\s+", "")
        left = F.ltrim(F.regexp_replace(bare, r"(?U)\s+$", ""), F.lit(openers))
        indent = F.length(s["text"]) - F.length(bare)
        cut = indent + F.length(F.regexp_replace(bare, r"(?U)\s+$", "")) - F.length(left)
        clean = F.rtrim(left, F.lit(closers))
        return s.withField("start", s["start"] + cut).withField("end", s["start"] + cut + F.length(clean)).withField("text", clean)

    return F.filter(F.transform(spans, trim), lambda s: s["text"] != "")


def whole_words(spans: Column, text: Column) -> Column:
    """Spans that do not begin or end inside a word."""
    letter = r"(?U)^\w\w$"
    return F.filter(spans, lambda s: ~(((s["start"] > 0) & F.substr(text, s["start"], F.lit(2)).rlike(letter)) | F.substr(text, s["end"], F.lit(2)).rlike(letter)))


def best_of_repeats(spans: Column, length: int = 5, hits: int = 2) -> Column:
    """Of short texts found more than `hits` times with one type, only the best-scored, first one."""

    def alike(s: Column) -> Column:
        return F.filter(spans, lambda o: (o["type"] == s["type"]) & (o["text"] == s["text"]))

    def best(s: Column) -> Column:
        return F.array_min(F.transform(alike(s), lambda o: F.struct(o["neg_score"].alias("n"), o["start"].alias("s"), o["ord"].alias("o"))))

    return F.filter(spans, lambda s: (F.length(s["text"]) >= length) | (F.size(alike(s)) <= hits) | (best(s) == F.struct(s["neg_score"].alias("n"), s["start"].alias("s"), s["ord"].alias("o"))))


def post_filter(spans: Column, lang: Column, least: float = 0.0) -> Column:
    """Without spans that lack a type, score too low, or are a single common word, and without short numbers and times that have no letter."""
    from ..functions.validate import common_word

    def good(s: Column) -> Column:
        single = F.regexp_count(s["text"], F.lit(r"(?U)\S+")) <= 1
        short = s["type"].isin("CARDINAL", "TIME") & (F.length(F.trim(s["text"])) < 4) & ~s["text"].rlike(r"\p{L}")
        return s["type"].isNotNull() & (s["score"] >= least) & ~(common_word(s["text"], lang) & single) & ~short

    return F.filter(spans, good)


#: Beginnings of payment tokens, organisations taken for persons, and words of places. Fixed values.
TOKEN_PREFIXES = ("tok_", "pi_", "ch_", "pm_", "cus_", "sub_", "in_", "si_", "seti_", "src_", "prv_", "acct_")
KNOWN_ORGANIZATIONS = (
    "visa", "mastercard", "amex", "american express", "discover", "diners club", "jcb", "unionpay", "maestro", "cirrus", "hsbc", "barclays", "citibank", "chase", "wells fargo",
    "bank of america", "santander", "bbva", "bnp", "paribas", "société générale", "crédit agricole", "deutsche bank",
)
PLACE_WORDS = ("street", "avenue", "road", "boulevard", "lane", "drive", "court", "circle", "square", "place", "rue", "المملكة", "مدينة", "شارع", "طريق", "حي", "منطقة")
ARABIC_PLACES = ("المملكة", "مدينة", "شارع")
LABEL_WORDS = ("email", "phone", "fax", "address")


def _has(x: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: x.contains(w))


def rewrite_types(spans: Column) -> Column:
    """Types and scores put right by their text; of several lines the first that is no label; later overlapping spans go.

    The end follows the line that stays, counted from the span's start. Organisations that begin with a digit go.
    """

    def fix(s: Column) -> Column:
        t, kind = F.btrim(s["text"], F.lit(" \t\r\n")), s["type"]
        changed = (
            F.when((kind == "AU_ACN") & t.rlike(r"^\+?\d{1,4}[-\s]?\d{6,}$"), "PHONE_NUMBER")
            .when(kind == "AU_ACN", F.when(_starts(t), "PAYMENT_TOKEN"))
            .when(kind == "ORGANIZATION", F.when(_has(F.lower(t), PLACE_WORDS), "LOCATION"))
            .when((kind == "PERSON") & _has(t, ARABIC_PLACES), "LOCATION")
            .when(_starts(t), "PAYMENT_TOKEN")
            .when((kind == "PERSON") & F.lower(t).isin(*KNOWN_ORGANIZATIONS), "ORGANIZATION")
        )
        worth = F.when(changed.isin("PHONE_NUMBER", "ORGANIZATION"), 0.95).when(changed == "LOCATION", 0.9).when(changed == "PAYMENT_TOKEN", 0.99).otherwise(s["score"])
        line = F.get(F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~_has(F.lower(x), LABEL_WORDS)), F.lit(0))
        clipped = t.contains("\n") & line.isNotNull()
        end = F.when(clipped, s["start"] + F.length(line)).otherwise(s["end"])
        return s.withField("text", F.when(clipped, line).otherwise(t)).withField("end", end).withField("type", F.coalesce(changed, kind)).withField("score", worth).withField("neg_score", -worth)

    kept = F.filter(F.transform(spans, fix), lambda s: ~((s["type"] == "ORGANIZATION") & s["text"].rlike(r"^\d")) & (s["text"] != ""))
    return greedy_first(kept)


def _starts(x: Column) -> Column:
    return F.exists(F.array(*(F.lit(p) for p in TOKEN_PREFIXES)), lambda p: x.startswith(p))


def add_unseen(spans: Column, more: Column) -> Column:
    """`spans` and those of a second pass, over another form of the text, whose text none of the first has.

    Offsets of a second pass are those of its own form; repeats within it count once.
    """
    fresh = F.filter(more, lambda m: ~F.exists(spans, lambda s: s["text"] == m["text"]))
    once = F.filter(fresh, lambda m: F.array_min(F.transform(F.filter(fresh, lambda o: o["text"] == m["text"]), lambda o: F.struct(o["start"].alias("s"), o["ord"].alias("o")))) == F.struct(m["start"].alias("s"), m["ord"].alias("o")))
    return F.concat(spans, once)


def overlap_kind(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.when((a_end <= b_start) | (b_end <= a_start), "NONE").when((a_start <= b_start) & (a_end >= b_end), "CONTAINS").when((b_start <= a_start) & (b_end >= a_end), "CONTAINED").otherwise("PARTIAL")


# ---- set forms over a table of entities (doc_id, start, end, ...) --------------------------------


def islands(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """`entities` with `island`: the number, within its document, of its group of overlapping or touching spans."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    return entities.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def regions(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Islands as rows: their extent and the kinds in them."""
    return islands(entities, key).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set("type")).alias("kinds"))


def best_in_island(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each island and base type (before the first '_') the best-scored entity; exact repeats count once."""
    once = entities.groupBy(key, "start", "end", "type", "text").agg(F.max("score").alias("score"))
    w = Window.partitionBy(key, "island", F.substring_index("type", "_", 1)).orderBy(F.desc("score"), "start", "end", "type")
    return islands(once, key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def overlapping_pairs(a: DataFrame, b: DataFrame, key: str = "doc_id", least_iou: float = 0.0) -> DataFrame:
    """Pairs of spans of one document that overlap, with their IoU; joined by bins of positions."""
    both = intervals.overlapping(a, b, key)
    return both.withColumn("iou", intervals.iou(*(F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")))).where(F.col("iou") >= least_iou)
