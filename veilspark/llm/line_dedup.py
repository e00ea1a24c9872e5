"""Line dedup: a deletion-neighbourhood join, by built-in functions only.

A line with anything but white space goes if an earlier line of the corpus equals it, or is
within the edit bound of it; order is by doc_id, then position. The bound is one edit (a
character put in, left out or changed) for each `min_chars` characters of the shorter line,
one at most: shorter lines must be equal, as most of their neighbours are there by chance.

Equal lines meet by a 128-bit hash. For near ones every distinct line gives hashed keys:

1. halves - lines one edit apart share their first or last characters;
2. frames - of lines that share a half: the line without one of QUARTERS segments;
3. variants - of lines that share a frame: that segment with each one character deleted,
   and whole. A segment of over SEGMENT characters is framed again first, so that what a
   line gives grows with its length and not with its square.

Two lines of equal length are one change apart just if a variant with the same character
position left out is equal; two whose lengths differ by one, just if the longer one's variant
is the shorter one's whole segment. So each group of equal variants needs only its earliest
member of each kind, never its pairs. Links are verified by edit distance. Every step is
exact; steps 1 and 2 only keep the neighbourhoods of lines that cannot match from being made.

Defined results: null text stays null and has no lines; text without a newline is one line;
a text whose lines all go is empty. Null doc_ids come first. Rows that repeat a doc_id and its
text share one fate, so a first line stays in each of them. Blank lines stay. An empty table
gives an empty result. Columns other than the key and the text pass through, whatever their
names, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of a line for which one edit is allowed.
MIN_CHARS = 20
QUARTERS = 4
#: Characters of a segment from which variants are made.
SEGMENT = 64


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, line) of a table (doc_id, text); version: a hash of the text."""
    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))


def hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def half_keys(line: str, n: str) -> Column:
    """Keys one of which any two lines at most one edit apart share: ends of about half a line.

    The length is a step function of n, so the keys of n and n + 1 differ at its steps only;
    there a line gives the keys of the step below as well.
    """
    pair = "array(xxhash64('first', left({line}, {q})), xxhash64('last', right({line}, {q})))"
    here, below = f"{n} div 16 * 8", f"({n} - 1) div 16 * 8"
    return F.expr(f"if({n} % 16 = 0 and {n} > 16, concat({pair.format(line=line, q=here)}, {pair.format(line=line, q=below)}), {pair.format(line=line, q=here)})")


def shared(keyed: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of `keyed` whose key other rows have too.

    The keys are written first, so both sides of the join are plain shuffles, which Spark can split where a key is hot.
    """
    often = common.materialize(keyed.groupBy(key).count().where("count > 1").select(key), f"lines-{name}")
    return keyed.join(often, key)


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(doc_id, version, pos) of the distinct lines (doc_id, version, pos, h1, halves) that have an earlier one one edit away."""
    place = ["doc_id", "version", "pos"]
    halves = shared(distinct.select(*place, "h1", F.explode("halves").alias("half")), "half", "halves")
    wanted = halves.select(*place, "h1").distinct().groupBy("doc_id", "version").agg(F.collect_list(F.struct("pos", "h1")).alias("wanted"))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    here = texts.alias("t").join(wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.version") == F.col("w.version")))
    found = here.select("t.doc_id", "t.version", split_lines(F.col("text")).alias("lines"), F.explode("wanted").alias("x")).select("doc_id", "version", "x.pos", F.expr("get(lines, x.pos)").alias("line"))
    lines = common.materialize(found.distinct().withColumn("n", F.length("line")), "lines-candidates")

    # a line stands as one of its own length, and as the longer of two that differ by one
    parts = lines.withColumn("r", F.explode(F.expr("array(n, n - 1)"))).select(*place, "r", (F.col("n") > F.col("r")).alias("longer"), F.xxhash64("r").alias("frame"), F.col("line").alias("part"))
    longest, levels = lines.agg(F.max("n")).first()[0] or 0, []
    while parts is not None:
        frames = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(QUARTERS - 1))))
        frames = frames.withColumn("a", F.expr(f"k * r div {QUARTERS}")).withColumn("z", F.expr(f"r - (k + 1) * r div {QUARTERS}"))
        segment = F.expr("substring(part, a + 1, length(part) - a - z)").alias("part")
        frames = frames.select(*place, F.expr("r - a - z").alias("r"), "longer", F.expr("xxhash64(frame, k, left(part, a), right(part, z))").alias("frame"), segment)
        levels.append(common.materialize(shared(frames, "frame", "frames"), "lines-close"))
        longest = -(-longest // QUARTERS)
        parts = levels[-1].where(F.col("r") > SEGMENT) if longest > SEGMENT else None
    close = levels[0].where(F.col("r") <= SEGMENT)
    for level in levels[1:]:
        close = close.unionByName(level.where(F.col("r") <= SEGMENT))

    size = F.length("part")
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("i"), F.concat(F.expr("part").substr(F.lit(1), i - 1), F.expr("part").substr(i + 1, size)).alias("rest")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("part").alias("rest")))
    variants = close.withColumn("v", F.explode(F.when(F.col("longer"), cut).when(size > 0, F.concat(whole, cut)).otherwise(whole)))
    # kinds: whole segment, its variant for changes, the longer line's variant
    variants = variants.withColumn("kind", F.when(F.col("longer"), 2).when(F.col("v.i") == 0, 0).otherwise(1))
    key = F.xxhash64("frame", F.when(F.col("kind") == 1, F.col("v.i")).otherwise(0), F.col("v.rest"))
    variants = common.materialize(variants.select(key.alias("variant"), "kind", F.struct(*place).alias("own")), "lines-variants")
    earliest = variants.groupBy("variant").agg(*(F.min(F.when(F.col("kind") == k, F.col("own"))).alias(f"first{k}") for k in range(3)), F.count("*").alias("n"))
    earliest = common.materialize(earliest.where("n > 1"), "lines-earliest")
    partner = F.when(F.col("kind") == 0, F.col("first2")).when(F.col("kind") == 1, F.col("first1")).otherwise(F.col("first0"))
    pairs = variants.join(earliest, "variant").select("own", partner.alias("other")).where("other < own").distinct()

    def text_of(side: str) -> DataFrame:
        return lines.select(F.struct(*place).alias(side), F.col("line").alias(f"{side}_line"))

    # the structs hold a nullable id: comparing their text form keeps nulls equal
    match = lambda a, b: F.to_json(a) == F.to_json(b)
    mine, other = text_of("mine"), text_of("theirs")
    both = pairs.join(mine, match(F.col("own"), F.col("mine"))).join(other, match(F.col("other"), F.col("theirs")))
    out = common.materialize(both.where(F.levenshtein("mine_line", "theirs_line", 1).between(0, 1)).select("own.*").distinct(), "lines-near")
    common.forget(lines, *levels, variants, earliest)
    return out


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, version, pos) of every line of `docs` (doc_id, text) that goes, and whether it is near rather than equal."""
    place = ["doc_id", "version", "pos"]
    if min_chars < 16:
        raise ValueError("lines of under 16 characters have no halves to share")
    long = F.col("n") >= min_chars
    rows = line_rows(docs).where(F.col("line").rlike(common.WORD)).withColumn("n", F.length("line"))
    first = F.min(F.struct("doc_id", "pos", "version", F.when(long, half_keys("line", "n")).alias("halves"))).alias("first")
    distinct = rows.groupBy(*hashes(F.col("line"))).agg(first, F.count("*").alias("times"))
    distinct = common.materialize(distinct.select("h1", "h2", "first.*", "times"), "lines-distinct")
    near = near_lines(docs, distinct.where("halves is not null"))
    d, x = distinct.drop("halves").alias("d"), near.alias("x")
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.version") == F.col("x.version")) & (F.col("d.pos") == F.col("x.pos"))
    flagged = d.join(x, same, "left").withColumn("near", F.col("x.pos").isNotNull()).where("near or times > 1")
    flagged = common.materialize(flagged.select("h1", "h2", F.col("d.doc_id").alias("first_id"), F.col("d.version").alias("first_version"), F.col("d.pos").alias("first_pos"), "near"), "lines-flagged")
    common.forget(distinct, near)
    each = rows.select(*place, *hashes(F.col("line"))).join(flagged, ["h1", "h2"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("version") == F.col("first_version")) & (F.col("pos") == F.col("first_pos"))
    return each.where(F.col("near") | ~is_first).select(*place, "near")


def dedup(df: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """`df` with `text` without its repeated lines, and the added columns n_lines and n_dropped."""
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    gone = dropped_lines(docs, min_chars).groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone")).alias("g")
    d, own = df.drop("n_lines", "n_dropped").alias("d"), F.col(f"d.`{text}`")
    out = d.join(gone, F.col(f"d.`{key}`").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(own) == F.col("g.version")), "left")
    lines, gone = split_lines(own), F.col("g.gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(gone.isNull(), own).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n"))
    return out.select(
        *(kept.alias(c) if c == text else F.col(f"d.`{c}`") for c in d.columns),
        F.when(own.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )
