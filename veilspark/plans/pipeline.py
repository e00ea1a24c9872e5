"""Detection, masking and statistics over a table of texts: one narrow stage, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bidi, jsontext, mask, positions, score
from ..functions import text as tx
from ..functions.pieces import small_batches
from ..functions.rules import Profile, profile
from ..operators.resolve import add_unseen, resolve, with_text
from ..operators.scan import scan


def spans(text: Column, lang: Column, rules: Profile, backend: str = "auto") -> Column:
    """Scored, unresolved spans of a profile."""
    found = scan(text, lang, rules, backend)
    return F.array_sort(score.with_context(found, text, rules.context)) if rules.context else found


#: Characters of a block that parts of a long text are cut from, as a power of two: a cut reads from where it is cut.
BLOCK_BITS = 11


def redacted(text: Column, entities: Column, kind: str) -> Column:
    """The text with each entity (sorted) replaced by its mask, rebuilt from the gaps.

    Where a policy leaves overlapping entities, as `iou` does, what a later one adds is masked too.
    """
    if kind not in mask.MASKS:
        raise ValueError(f"no mask {kind!r}; there are {', '.join(mask.MASKS)}")
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    size = 1 << BLOCK_BITS
    blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.length(text), BLOCK_BITS)), lambda i: F.substr(text, F.shiftleft(i, BLOCK_BITS) + 1, F.lit(size)))

    def rebuilt(blocks: Column) -> Column:
        def cut(at: Column, n: Column) -> Column:
            within = at.bitwiseAND(F.lit(size - 1))
            return F.coalesce(F.when(within + n <= size, F.substr(F.get(blocks, F.shiftright(at, BLOCK_BITS)), within + 1, n)), F.substr(text, at + 1, n))

        def step(acc: Column, s: Column) -> Column:
            before = F.when(s["start"] > 0, cut(s["start"] - 1, F.lit(1))).otherwise("")
            gap = cut(acc["pos"], s["start"] - acc["pos"])
            fresh = F.when(s["start"] >= acc["pos"], F.array(gap, mask.MASKS[kind](s["type"], s["text"], before)))
            tail = F.when(s["end"] > acc["pos"], F.array(mask.MASKS[kind](s["type"], cut(acc["pos"], s["end"] - acc["pos"]), before)))
            return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], F.coalesce(fresh, tail, F.array().cast("array<string>"))).alias("out"))

        return F.aggregate(entities, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["pos"] + 1, F.length(text))))

    return F.when(F.size(entities) > 0, tx.bind(blocks, rebuilt)).otherwise(text)


def statistics(entities: Column) -> Column:
    """total, entity_types (TYPE_method -> count), unique_types, methods, counts (TYPE -> count)."""

    def counted(keys: Column) -> Column:
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(keys)), lambda k: F.struct(k, F.size(F.filter(keys, lambda x: x == k)).cast("long"))))

    kinds = F.transform(entities, lambda s: s["type"])
    both = F.transform(entities, lambda s: F.concat_ws("_", s["type"], s["method"]))
    return F.struct(
        F.size(entities).cast("long").alias("total_entities"),
        counted(both).alias("entity_types"),
        counted(kinds).alias("entity_counts"),
        F.array_sort(F.array_distinct(kinds)).alias("unique_types"),
        F.array_sort(F.array_distinct(F.transform(entities, lambda s: s["method"]))).alias("detection_methods"),
    )


def detect(df: DataFrame, name: str | Profile = "light", *, text: str = "text", lang: str = "lang", policy: str | None = None, backend: str = "auto", learnt: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """`df` with `entities`: the profile's spans, validated, scored and resolved. Null text has none.

    With `learnt`, thresholds by (method, type), spans below these are dropped as well.
    """
    rules = name if isinstance(name, Profile) else profile(name)
    language = F.col(lang) if lang in df.columns else tx.guess_language(F.col(text))
    policy = policy or rules.policy
    out = df.withColumn("__spans", spans(F.col(text), language, rules, backend))
    kept = resolve(score.above_learnt(score.above(F.col("__spans"), rules.thresholds), learnt or {}), policy)
    if policy == "interval_union":
        kept = with_text(kept, F.col(text))
    return out.withColumn("entities", kept).drop("__spans")


def analyze(df: DataFrame, name: str | Profile = "light", *, text: str = "text", lang: str = "lang", policy: str | None = None, masks: str | None = None, backend: str = "auto") -> DataFrame:
    """`df` with entities, masked_text, statistics, has_pii and success."""
    rules = name if isinstance(name, Profile) else profile(name)
    out = detect(df, rules, text=text, lang=lang, policy=policy, backend=backend)
    if (policy or rules.policy) == "all":
        raise ValueError("overlapping spans cannot be masked: name a policy that resolves them")
    return out.withColumns({"masked_text": redacted(F.col(text), F.col("entities"), masks or rules.mask), "statistics": statistics(F.col("entities")), "has_pii": F.size("entities") > 0, "success": F.col(text).isNotNull()})


def entities(df: DataFrame, name: str | Profile = "light", *, key: str = "doc_id", text: str = "text", lang: str = "lang", policy: str | None = None, backend: str = "auto") -> DataFrame:
    """A row for each entity: key, ord, type, text, start, end, score, method, lang. Texts without one give none."""
    found = detect(df, name, text=text, lang=lang, policy=policy, backend=backend)
    language = F.col(lang) if lang in df.columns else tx.guess_language(F.col(text))
    rows = found.select(key, language.alias("lang"), F.posexplode("entities").alias("n", "e"))
    return rows.select(key, F.col("n").alias("ord"), "e.type", "e.text", "e.start", "e.end", "e.score", "e.method", "lang")


def detect_cleaned(df: DataFrame, steps: tuple[tuple[str, str], ...], name: str | Profile = "light", *, text: str = "text", lang: str = "lang", backend: str = "auto") -> DataFrame:
    """As `detect`, but the texts are scanned after clean-up steps; offsets and text of the entities are the original's."""
    body, language = F.col(text), F.col(lang) if lang in df.columns else tx.guess_language(F.col(text))
    clean = df.withColumn("__clean", positions.cleaned(body, steps)).withColumn("__lang", language).withColumn("__text", F.col("__clean.text"))
    found = detect(clean, name, text="__text", lang="__lang", backend=backend)
    return found.withColumn("entities", positions.spans_back(F.col("entities"), F.col("__clean.maps"), body)).drop("__clean", "__lang", "__text")


def detect_displayed(df: DataFrame, name: str | Profile = "light", *, text: str = "text", lang: str = "lang", policy: str | None = None, backend: str = "auto") -> DataFrame:
    """As `detect`, with a second scan of the display form of texts with right-to-left characters.

    What the second scan finds goes back to the source's offsets; where the first has no entity of its text it is added, and
    the policy decides among those that overlap. Texts without such characters have the result of `detect`.
    """
    rules = name if isinstance(name, Profile) else profile(name)
    body, language = F.col(text), F.col(lang) if lang in df.columns else tx.guess_language(F.col(text))
    out = small_batches(df).withColumn("__shown", bidi.displayed(body)).withColumn("__first", spans(body, language, rules, backend))
    out = out.withColumn("__second", spans(F.col("__shown.text"), language, rules, backend))
    back = F.when(F.col("__shown").isNotNull(), bidi.spans_back(F.col("__second"), F.col("__shown"), body))
    both = F.coalesce(F.array_sort(add_unseen(F.col("__first"), back)), F.col("__first"))
    kept = resolve(score.above(both, rules.thresholds), policy or rules.policy)
    if (policy or rules.policy) == "interval_union":
        kept = with_text(kept, body)
    return out.withColumn("entities", kept).drop("__shown", "__first", "__second")


def entities_by_chunk(df: DataFrame, name: str | Profile = "chunked", *, key: str = "doc_id", text: str = "text", lang: str = "lang", size: int = 4_000, backend: str = "auto") -> DataFrame:
    """A row for each entity of each chunk, as `entities`, with the chunk's number; offsets are those of the whole text."""
    language = F.col(lang) if lang in df.columns else tx.guess_language(F.col(text))
    chunks = df.select(key, language.alias("lang"), F.posexplode(tx.fixed_chunks(F.col(text), size)).alias("chunk", "part"))
    found = detect(chunks.select(key, "lang", "chunk", F.col("part.offset").alias("offset"), F.col("part.text").alias("text")), name, backend=backend)
    rows = found.select(key, "lang", "chunk", "offset", F.posexplode("entities").alias("ord", "e"))
    return rows.select(key, "chunk", "ord", "e.type", "e.text", (F.col("offset") + F.col("e.start")).alias("start"), (F.col("offset") + F.col("e.end")).alias("end"), "e.score", "e.method", "lang")


def deduplicated(df: DataFrame, name: str | Profile = "light", *, text: str = "text", lang: str = "lang", masks: str | None = None) -> DataFrame:
    """As `analyze`, each distinct (text, language) analysed once and joined back: for tables of many copies."""
    keys = df.withColumn("text_sha256", F.sha2(F.col(text), 256))
    once = analyze(keys.select("text_sha256", text, lang).dropDuplicates(["text_sha256", lang]), name, text=text, lang=lang, masks=masks).drop(text)
    once = once.withColumnRenamed("text_sha256", "__sha256").withColumnRenamed(lang, "__lang")
    # null texts have a null hash, and are kept as `analyze` keeps them
    same = F.col("text_sha256").eqNullSafe(F.col("__sha256")) & F.col(lang).eqNullSafe(F.col("__lang"))
    out = keys.join(once, same).drop("__sha256", "__lang")
    return out.select("text_sha256", *(c for c in out.columns if c != "text_sha256"))


def redact_columns(df: DataFrame, name: str | Profile = "light", *, lang: str = "en", masks: str | None = None) -> DataFrame:
    """Every string of every column, however nested, masked."""
    rules = name if isinstance(name, Profile) else profile(name)

    def use(x: Column) -> Column:
        found = resolve(score.above(scan(x, F.lit(lang), rules, "native"), rules.thresholds), rules.policy)
        return tx.bind(found, lambda e: redacted(x, e, masks or rules.mask))

    return df.select(*(mask.on_strings(F.col(f.name), f.dataType, use).alias(f.name) for f in df.schema.fields))


def redact_json(df: DataFrame, column: str, name: str | Profile = "light", *, lang: str = "en", masks: str | None = None) -> DataFrame:
    """`df` with every string leaf of the JSON texts in `column`, whatever their shape, masked; what is no JSON is masked as a text."""
    rules = name if isinstance(name, Profile) else profile(name)

    def use(x: Column) -> Column:
        found = resolve(score.above(scan(x, F.lit(lang), rules, "native"), rules.thresholds), rules.policy)
        return tx.bind(F.struct(x.alias("x"), found.alias("e")), lambda b: redacted(b["x"], b["e"], masks or rules.mask))

    return df.withColumn(column, jsontext.redacted(F.col(column), use))


def chat_reply(df: DataFrame, name: str | Profile = "modular", *, query: str = "query", answer: str = "answer") -> DataFrame:
    """Query and answer analysed apart: entities of both, and each masked by its own."""
    out = df
    for column in (query, answer):
        part = analyze(out.withColumn("__lang", F.lit("en")), name, text=column, lang="__lang")
        out = part.withColumnRenamed("entities", f"{column}_entities").withColumnRenamed("masked_text", f"masked_{column}").drop("statistics", "has_pii", "success", "__lang")
    return out
