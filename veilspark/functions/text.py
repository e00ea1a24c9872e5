"""Text preparation: Column -> Column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

#: Fixed values.
INVISIBLE = "[\\u200B-\\u200D\\uFEFF]"
LANGUAGE_ALIASES = {"english": "en", "eng": "en", "en-us": "en", "en-gb": "en", "french": "fr", "fra": "fr", "fre": "fr", "fr-fr": "fr", "arabic": "ar", "ara": "ar", "ar-sa": "ar"}
CHUNK = 4_900


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_lines(x: Column) -> Column:
    """LF line ends, single blanks, no invisible characters; newlines stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "\\r\\n?", "\n"), "[ \\t]+", " "), INVISIBLE, "")


def collapse(x: Column) -> Column:
    """Single blanks for all white space, no invisible characters, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "(?U)\\s+", " "), INVISIBLE, ""), "^(?U)\\s+|(?U)\\s+$", "")


def normalize_arabic(x: Column) -> Column:
    """One letter for the forms of alef, yeh and teh marbuta; digit groups joined."""
    folded = F.translate(x, "أإآٱىة", "اااايه")
    return F.regexp_replace(F.trim(F.regexp_replace(folded, "(?U)\\s+", " ")), "(?U)(\\d)\\s+(?=\\d)", "$1")


def strip_markdown(x: Column, limit: int = CHUNK) -> Column:
    clean = F.regexp_replace(x, r"[*#_\[\]]", "")
    return F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("..."))).otherwise(clean)


def compare_form(x: Column) -> Column:
    return F.lower(collapse(x))


def strip_token_marks(x: Column) -> Column:
    """Without the word marks of subword tokenizers and end punctuation."""
    return F.btrim(F.translate(x, "Ġ▁", ""), F.lit(".,;: "))


def json_escape(x: Column) -> Column:
    quoted = F.to_json(F.struct(x.alias("v")))
    return F.substr(quoted, F.lit(7), F.length(quoted) - 8)


def token_estimate(x: Column, most: int = 32_768) -> Column:
    return F.least(F.floor(F.length(x) / 4), F.lit(most)).cast("long")


def guess_language(x: Column) -> Column:
    """Arabic script, else French accents, else English."""
    return F.when(x.rlike("[\\u0600-\\u06FF]"), "ar").when(x.rlike("[éèêëàâùûôîïçœÉÈÊËÀÂÙÛÔÎÏÇŒ]"), "fr").otherwise("en")


def language_code(x: Column) -> Column:
    """A code from a name or region code; others stay."""
    names = F.create_map(*(F.lit(v) for kv in LANGUAGE_ALIASES.items() for v in kv))
    return F.coalesce(F.try_element_at(names, F.lower(x)), F.lower(x))


def pattern_language(x: Column, known: tuple[str, ...] = ("en", "fr", "ar")) -> Column:
    """The language whose rules apply: unsupported ones use English."""
    return F.when(x.isin(*known), x).otherwise("en")


def sentence_chunks(x: Column, limit: int = CHUNK) -> Column:
    """Chunks of whole sentences ('. ' ends one) of `limit` characters at most; longer sentences are cut."""
    pieces = F.filter(F.flatten(F.transform(F.split(x, r"(?<=\. )", -1), lambda s: F.regexp_extract_all(s, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0)))), lambda s: F.length(s) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(s) <= limit
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], s).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open")))

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def fixed_chunks(x: Column, size: int = 4_000) -> Column:
    """(offset, text) chunks of `size` characters at most that end at white space where there is any."""
    texts = F.regexp_extract_all(x, F.lit(f"(?s).{{1,{size - 1}}}(?:\\s|$)|.{{1,{size}}}"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,text:string>>").alias("out"))
    return F.aggregate(texts, start, lambda a, t: F.struct((a["at"] + F.length(t)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("offset"), t.alias("text")))).alias("out")), lambda a: a["out"])


def windows(x: Column, width: int = 512, stride: int | None = None) -> Column:
    """(offset, text) windows of `width` characters, a new one every `stride` (half the width)."""
    step = stride or width // 2
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0)), F.lit(step)), lambda i: F.struct(i.alias("offset"), F.substr(x, i + 1, F.lit(width)).alias("text")))


def map_position(kept: Column, at: Column) -> Column:
    """Where a position of a cleaned text lies in the original; `kept`: the original positions of its characters.

    Beyond the end, the last kept position plus the overhang.
    """
    n = F.size(kept)
    return F.when(n == 0, at).when(at < n, F.get(kept, at)).otherwise(F.get(kept, n - 1) + at - n + 1)


def kept_positions(x: Column, dropped: str) -> Column:
    """Original positions of the characters that a single-character pattern does not drop."""
    return F.filter(F.transform(F.split(x, ""), lambda c, i: F.when(~c.rlike(dropped) & (c != ""), i)), lambda i: i.isNotNull())


def explode_chunks(df: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode(chunks).alias("chunk", "part")).select(key, "chunk", "part.*")


def html_text(x: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags; the five named entities resolved."""
    out = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return collapse(out)


def _runs(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n, m, t): `m` chunks of one key that follow each other in a batch, numbered from `n`, joined by single blanks.

    Only chunks without blanks are joined, so that they can be told apart again; all others are runs of one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k, n, t = b.columns
            plain = pc.invert(pc.fill_null(pc.match_substring(t, " "), True))
            same = pc.fill_null(pc.equal(k[1:], k[:-1]), False)
            follows = pc.fill_null(pc.equal(pc.subtract(n[1:], n[:-1]), 1), False)
            joins = pc.and_(pc.and_(same, follows), pc.and_(plain[1:], plain[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], ~joins]))
            ends = np.append(first, b.num_rows)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), t), " ")  # null where a chunk is null
            yield pa.RecordBatch.from_arrays([k.take(pa.array(first)), n.take(pa.array(first)), pa.array(np.diff(ends), pa.int32()), joined], ["k", "n", "m", "t"])

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.mapInArrow(pack, f"k {kind}, n long, m int, t string").withColumnRenamed("k", key)


def join_chunks(chunks: DataFrame, key: str = "doc_id", order: str = "chunk", text: str = "text") -> DataFrame:
    """The chunks of each text in order, joined by single blanks: the opposite of `explode_chunks` for masked chunks.

    Chunks that lie together go through the shuffle as one row. Keys of other types than whole numbers and strings, and orders
    that are no whole numbers, go chunk by chunk, with equal results.
    """
    rows = chunks.select(key, F.col(order).alias("n"), F.col(text).alias("t"))
    whole = (ByteType, ShortType, IntegerType, LongType)
    if not (isinstance(rows.schema["n"].dataType, whole) and isinstance(rows.schema[key].dataType, (*whole, StringType))):
        parts = F.array_sort(F.collect_list(F.struct("n", "t")))
        return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias(text))

    def in_order(runs: Column) -> Column:
        apart = F.forall(F.sequence(F.lit(1), F.size(runs)), lambda i: (i == F.size(runs)) | (F.get(runs, i)["n"] >= F.get(runs, i - 1)["n"] + F.get(runs, i - 1)["m"]))
        # runs that reach into each other, of keys that come several times, are taken apart
        single = F.flatten(F.transform(runs, lambda r: F.when(r["m"] == 1, F.array(F.struct(r["n"].alias("n"), r["t"].alias("t")))).otherwise(F.transform(F.split(r["t"], " ", -1), lambda t, i: F.struct((r["n"] + i).alias("n"), t.alias("t"))))))
        return F.when(F.coalesce(apart, F.lit(False)), F.array_join(F.transform(runs, lambda r: r["t"]), " ")).otherwise(F.array_join(F.transform(F.array_sort(single), lambda p: p["t"]), " "))

    found = _runs(rows.withColumn("n", F.col("n").cast("long")), key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "m", "t"))).alias("runs"))
    return found.select(key, bind(F.col("runs"), in_order).alias(text))
