"""Queries of the staged parts: positions through changes, overlap groups, interval joins, JSON leaves; each with its SQL twin."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import bidi, jsontext, positions, score, tables, validate
from ..functions.pieces import small_batches
from ..functions.rules import PROFILES, Profile, Rule
from ..operators import aggregates, intervals, merge, pivots, resolve
from ..sources import keyed, requests
from ..streaming import adaptive, stream
from . import pipeline, twins
from .queries import EMAIL_CASED_SQL, EMAIL_SETS_SQL, IP_LIGHT_SQL, KNN_SQL, _sets, hits, luhn_sql, only, query, read

# ---- positions -----------------------------------------------------------------------------------

FINDS = Profile("finds", (Rule("EMAIL", r"[a-zA-Z0-9.%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", needs="@"), Rule("NUMBER", r"[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{4}"), Rule("PAIR", r"[A-Z][a-z]+ [A-Z][a-z]+")), "all")
#: The library's marks of Markdown, then runs of blanks.
STEPS = (*positions.MARKDOWN, (r"[ \t]+", " "))


def _found_sql(cte: str, text: str = "t", keys: str = "doc_id") -> str:
    """CTE m: matches of FINDS in a CTE's texts with their offsets."""
    parts = []
    for rule in FINDS.rules:
        p = twins.text(rule.pattern)
        each = f"select *, unnest(range(1, length(hit) + 1)) as i from (select *, regexp_extract_all({text}, {p}) as hit, regexp_split_to_array({text}, {p}) as gap from {cte})"
        start = "cast(coalesce(list_sum(list_transform(gap[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda h: length(h))), 0) as int)"
        parts.append(f"select * exclude (hit, gap, i), {twins.text(rule.type)} as type, {start} as a, {start} + length(hit[i]) as z from ({each})")
    return f"m as ({' union all '.join(parts)})"


@query(f"""
with c as (select doc_id, text, list_transform(range(1, length(text) + 1), lambda i: {{'c': substr(text, i, 1), 'i': i - 1}}) as cs from documents where text is not null),
u as (select doc_id, text, list_filter(cs, lambda x: not regexp_matches(x.c, '[*#_\\[\\]]')) as cs from c),
k as (select doc_id, text, list_filter(list_zip(cs, list_prepend(null, cs)), lambda p: p[1] is not null and not (p[1].c in (' ', chr(9)) and coalesce(p[2].c in (' ', chr(9)), false))) as ps from u),
t as (select doc_id, text, list_transform(ps, lambda p: p[1].i) as place, array_to_string(list_transform(ps, lambda p: case when p[1].c = chr(9) then ' ' else p[1].c end), '') as t from k),
{_found_sql("t")}
select doc_id, type, cast(place[a + 1] as int) as "start", cast(place[z] + 1 as int) as "end", substr(text, cast(place[a + 1] as bigint) + 1, cast(place[z] + 1 - place[a + 1] as bigint)) as text from m""")
def spans_through_cleaning(spark, sf_dir):
    """What is found in texts without Markdown's marks and runs of blanks, where it lies in the original."""
    found = pipeline.detect_cleaned(read(spark, sf_dir, "documents"), STEPS, FINDS)
    return found.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.type", "e.start", "e.end", "e.text")


@query(f"""
with c as (select doc_id, regexp_extract_all(text, '(?s).{{1,399}}(?:\\s|$)|.{{1,400}}') as ts from documents),
e as (select doc_id, unnest(ts) as t, unnest(range(1, length(ts) + 1)) as n from c),
o as (select *, cast(coalesce(sum(length(t)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as int) as o from e),
{_found_sql("o")}
select m.doc_id, cast(n - 1 as int) as chunk, type, cast(o + a as int) as "start", cast(o + z as int) as "end", substr(d.text, o + a + 1, z - a) as text from m join documents d using (doc_id)""")
def spans_through_chunks(spark, sf_dir):
    """What is found in chunks of 400 characters, in offsets of the whole text."""
    return pipeline.entities_by_chunk(read(spark, sf_dir, "documents"), FINDS, size=400).select("doc_id", "chunk", "type", "start", "end", "text")


# ---- display forms -------------------------------------------------------------------------------

LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"
BRACKETS = "()[]{}<>«»"


def _arabic(spark, sf_dir):
    """The documents with Arabic letters for a to z, so that their lines run both ways."""
    return read(spark, sf_dir, "documents").select("doc_id", F.translate("text", LATIN, ARABIC).alias("text"), F.lit("ar").alias("lang"))


@query(f"""
with t as (select doc_id, translate(text, '{LATIN}', '{ARABIC}') as t from documents)
select doc_id, sha256(translate(t, '{BRACKETS}', '')) as restored, length(t) as n, length(t) - length(regexp_replace(t, 'ل[اأإآ]', 'x', 'g')) as joined from t""")
def display_forms_undone(spark, sf_dir):
    """Display forms put back in the source's order and bare letters; brackets apart, which are mirrored."""
    shown = small_batches(_arabic(spark, sf_dir)).withColumn("shown", bidi.displayed(F.col("text")))
    shown = shown.select("doc_id", F.length("text").cast("long").alias("n"), F.coalesce("shown.text", "text").alias("text"), "shown.first")
    bare = F.translate(bidi.undone(F.col("text"), F.col("first")), BRACKETS, "")
    return shown.select("doc_id", F.sha2(bare, 256).alias("restored"), "n", (F.col("n") - F.length("text")).alias("joined"))


@query()
def display_pass_entities(spark, sf_dir):
    """What the two scans of texts that run both ways find together, in offsets of the source."""
    found = pipeline.detect_displayed(_arabic(spark, sf_dir), only("light", "EMAIL", "IP_ADDRESS", "DATE", "CREDIT_CARD", policy="greedy_first"))
    # with `explode`, Spark would ask for texts with entities first, and so make them twice
    return found.select("doc_id", F.explode_outer("entities").alias("e")).where("e is not null").select("doc_id", "e.type", "e.start", "e.end", "e.text")


# ---- scores and kinds by context -----------------------------------------------------------------

NAME, NUMBER = r"[A-Z][a-z]+(?: [A-Z][a-z]+)?", r"[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[0-9]{4}[ -]?){3}[0-9]{3,4}|[0-9]{8,22}"


def _lines(spark, sf_dir, pattern: str):
    """The first find of a pattern in each line of the documents, with what stands around it."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.split("text", "\n", -1).alias("lines"))
    rows = rows.select("doc_id", "lang", "lines", F.posexplode("lines").alias("n", "line")).withColumn("x", F.regexp_extract("line", pattern, 0)).where("x <> ''")
    return rows.withColumn("at", F.expr("instr(line, x) - 1")).withColumn("z", F.expr("at + length(x)"))


def _lines_sql(pattern: str) -> str:
    return f"""l as (select doc_id, lang, string_split(text, chr(10)) as lines from documents),
e as (select doc_id, lang, lines, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as n from l),
f as (select *, regexp_extract(line, '{pattern}', 0) as x from e),
k as (select *, instr(line, x) - 1 as a, instr(line, x) - 1 + length(x) as z from f where x <> '')"""


def _any(words, x: str) -> str:
    return f"len(list_filter({twins.words(*words)}, lambda w: contains({x}, w)))"


def _window(width: int) -> str:
    return f"lower(substr(line, greatest(a - {width}, 0) + 1, z + {width} - greatest(a - {width}, 0)))"


@query(f"""
with {_lines_sql(NAME)},
w as (select *, contains(x, ' ') as several, lower(substr(line, greatest(a - 20, 0) + 1, a - greatest(a - 20, 0))) as before, {_window(20)} as around, lower(lines[n]) as own, lower(coalesce(lines[n - 1], '')) as prior, lower(coalesce(lines[n + 1], '')) as later from k)
select doc_id, cast(n - 1 as int) as line, x as text,
  cast(case when lang = 'fr' then 0.85 when several then 0.95 else 0.85 end as double) as person, cast(case when several then 0.9 else 0.85 end as double) as organization,
  cast(case when lang = 'fr' and {_any(score.FRENCH_TITLES, 'before')} > 0 then 0.95 else 0.85 end as double) as french_person, cast(case when lang = 'fr' and {_any(score.FRENCH_STREETS, 'around')} > 0 then 0.95 else 0.85 end as double) as french_place,
  round(cast(least(1, 0.9 + 0.3 * {_any(score.FRENCH_NEAR['FR_NAME'], 'own')} + 0.2 * ({_any(score.FRENCH_NEAR['FR_NAME'], 'case when n > 1 then prior else chr(0) end')} + {_any(score.FRENCH_NEAR['FR_NAME'], 'later')})) as double), 6) as french_name,
  round(cast(case when several then 0.9 when length(x) < 5 then 0.5 else 0.8 end as double), 6) as arabic_name, round(cast(case when several then 0.6 else 0.5 end - case when length(x) < 5 then 0.2 else 0 end as double), 6) as arabic_context
from w""")
def context_scores(spark, sf_dir):
    """What the first capitalised words of each line would score as persons, organisations and places."""
    rows = _lines(spark, sf_dir, NAME)
    x, lang = F.col("x"), F.col("lang")
    near = score.around(F.col("line"), F.col("at"), F.col("z"), 20)
    before = F.expr("lower(substr(line, greatest(at - 20, 0) + 1, at - greatest(at - 20, 0)))")
    found = {name: score.ner_score(F.lit(label), x, before, near, lang) for name, label in (("person", "PERSON"), ("organization", "ORG"), ("french_person", "PER"), ("french_place", "LOC"))}
    found["french_name"] = F.round(score.french_score(F.lit("FR_NAME"), F.col("lines"), F.col("n"), x), 6)
    found["arabic_name"] = F.round(score.arabic_score(F.lit("AR_NAME"), x, near, F.lit(False)), 6)
    found["arabic_context"] = F.round(score.arabic_context_score(F.lit("AR_NAME"), near, x), 6)
    return rows.select("doc_id", F.col("n").alias("line"), x.alias("text"), *(v.alias(k) for k, v in found.items()))


@query(rf"""
with {_lines_sql(NUMBER)},
w as (select *, {_window(50)} as around, regexp_replace(x, '[ -]', '', 'g') as clean from k),
c as (select *, length(clean) in (15, 16) and {luhn_sql('clean')} as luhn from w)
select doc_id, cast(n - 1 as int) as line, x as text,
  case when regexp_full_match(x, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') then case when x[1:3] not in ('000', '666') and x[1:3] < '900' and x[5:6] <> '00' and x[8:11] <> '0000' then 'SSN' end
    when regexp_full_match(x, '[0-9]{{2}}([- ]?[0-9]{{4}}){{5}}') or {_any(validate.ACCOUNT_WORDS, 'around')} > 0 then 'BANK_ACCOUNT' when luhn and {_any(validate.NO_CARD_WORDS, 'around')} = 0 then 'CREDIT_CARD' end as kind,
  case when length(clean) = 15 and {_any(validate.NO_CARD_WORDS, 'around')} > 0 then case when not luhn or {_any(validate.STRONG_TAX_WORDS, 'around')} > 0 then 'VAT_NUMBER' end
    when regexp_matches(x, '^\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}\b') or luhn then case when {_any(validate.CARD_WORDS, 'around')} > 0 then 'CREDIT_CARD' end when length(clean) = 20 then 'BANK_ACCOUNT' end as arabic_kind
from c""")
def financial_kinds(spark, sf_dir):
    """What the first long number of each line is by the two financial cascades."""
    rows = _lines(spark, sf_dir, NUMBER)
    near = score.around(F.col("line"), F.col("at"), F.col("z"), 50)
    name = F.when(F.length(F.regexp_replace("x", "[ -]", "")) == 20, "Arabic Bank Account")
    return rows.select("doc_id", F.col("n").alias("line"), F.col("x").alias("text"), validate.financial_kind(F.col("x"), near).alias("kind"), validate.arabic_financial_kind(F.col("x"), near, name).alias("arabic_kind"))


# ---- overlap groups ------------------------------------------------------------------------------

#: Overlapping rules of several methods and scores.
METHODS = Profile(
    "methods",
    (
        Rule("PERSON", r"[A-Z][a-z]+ [A-Z][a-z]+", 0.6, "pairs"),
        Rule("PERSON", r"[A-Z][a-z]{5,}", 0.5, "words"),
        Rule("TITLE", r"(?:The|Is|Der|La) ", 0.4, "titles"),
        Rule("ORGANIZATION", r"[A-Z][a-z]+", 0.3, "words"),
        Rule("ADDRESS_LINE", r"[0-9]{1,5} [A-Za-z]+", 0.7, "numbers"),
        Rule("LOCATION", r"(?:in|of|en|de) [a-z]+", 0.2, "places"),
        Rule("PHONE_NUMBER", r"[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{4}", 0.9, "numbers"),
        Rule("PHONE_EXTENSION", r"[0-9]{4,}", 0.95, "digits"),
        Rule("DATE", r"[0-9]{4}-[0-9]{2}", 0.8, "numbers"),
        Rule("DATE", r"[0-9]{4}", 0.8, "years"),
        Rule("FIRST_NAME", r"[A-Z][a-z]+, [a-z]+", 0.75, "commas"),
    ),
    "all",
)
METHOD_OF = "case ord " + " ".join(f"when {k} then {twins.text(r.method)}" for k, r in enumerate(METHODS.rules)) + " end"
KIN = "case when {0} in ('PERSON', 'AR_NAME', 'ORGANIZATION', 'DATE') then {0} when {0} = 'LOCATION' or contains({0}, 'ADDRESS') then 'PLACE' end"


@query(f"""
with {twins.spans(METHODS.rules)},
one as (select doc_id, "start" as a, "end" as z, type, text, max(score) as score, min({METHOD_OF}) filter (score = top) as method from (select *, max(score) over (partition by doc_id, "start", "end", type, text) as top from s) group by all),
g1 as (select *, max(z) over (partition by doc_id order by a, z, type, text rows between unbounded preceding and 1 preceding) as reach from one),
g2 as (select * exclude (reach), sum(case when reach is null or a >= reach then 1 else 0 end) over (partition by doc_id order by a, z, type, text rows unbounded preceding) as g from g1),
g3 as (select *, split_part(type, '_', 1) as base, count(*) over (partition by doc_id, g) as members, count(*) over (partition by doc_id, g, split_part(type, '_', 1)) as alike from g2),
g4 as (select *, members > 1 and alike > 1 and (base = 'PERSON' or contains(base, 'NAME')) as named, max(z) over (partition by doc_id, g, base order by a, z, type, text rows between unbounded preceding and 1 preceding) as reach from g3),
g5 as (select *, sum(case when reach is null or (not named and a >= reach) then 1 else 0 end) over (partition by doc_id, g, base order by a, z, type, text rows unbounded preceding) as part from g4),
p as (select doc_id, min(a) as a, case when bool_or(named) then arg_max(z, {{'a': a, 'z': z}}) else max(z) end as z, case when bool_or(named) then 'PERSON' else arg_min(type, {{'s': -score, 'a': a, 'z': z, 't': type}}) end as type,
  case when bool_or(named) then least(1.0::double, max(score) + count(distinct method) * 0.1::double + least(0.1::double, count(*) * 0.05::double)) else max(score) end as score, array_to_string(list_sort(list(distinct method)), '+') as method from g5 group by doc_id, g, base, part),
w as (select *, lag(type) over o as lt, lag(z) over o as lz, last_value(case when type <> 'PERSON' then type end ignore nulls) over (partition by doc_id order by a, z, type, score, method rows between unbounded preceding and 1 preceding) as head from p window o as (partition by doc_id order by a, z, type, score, method)),
j as (select *, coalesce(abs(a - lz) <= 3 and {KIN.format("lt")} = {KIN.format("type")}, false) or coalesce(lt = 'PHONE_NUMBER' and type = 'PHONE_NUMBER' or ends_with(lt, '_PHONE') and ends_with(type, '_PHONE'), false) or coalesce(type = 'PERSON' and head = 'TITLE' and lt in ('TITLE', 'PERSON'), false) as joins from w),
r as (select *, sum(case when joins then 0 else 1 end) over (partition by doc_id order by a, z, type, score, method rows unbounded preceding) as run from j),
f as (select doc_id, arg_min(a, k) as a, arg_max(z, k) as z, arg_min(type, k) as type, max(score) as score, string_agg(method, '+' order by k) as method from (select *, {{'a': a, 'z': z, 't': type, 's': score, 'm': method}} as k from r) group by doc_id, run)
select f.doc_id, a as "start", z as "end", type, round(score, 6) as score, sha256(method) as methods, substr(d.text, a + 1, z - a) as text from f join documents d using (doc_id)""")
def merged_entities(spark, sf_dir):
    """Finds of eight methods made one by groups, repeats, base types, names and neighbours."""
    docs = read(spark, sf_dir, "documents")
    out = merge.merged(hits(spark, sf_dir, METHODS, backend="arrow"), docs)
    return out.select("doc_id", "start", "end", "type", F.round("score", 6).alias("score"), F.sha2("method", 256).alias("methods"), "text")


# ---- intervals -----------------------------------------------------------------------------------


@query(f"""
with {twins.spans(METHODS.rules)}
select a.doc_id, a."start" as a_start, a."end" as a_end, a.type as a_type, b."start" as b_start, b."end" as b_end, b.type as b_type,
  round((least(a."end", b."end") - greatest(a."start", b."start")) / (a."end" - a."start" + b."end" - b."start" - least(a."end", b."end") + greatest(a."start", b."start")), 6) as iou
from s a join s b on a.doc_id = b.doc_id and a."start" < b."end" and b."start" < a."end" and a.type in ('PERSON', 'DATE') and b.type not in ('PERSON', 'DATE')
where (least(a."end", b."end") - greatest(a."start", b."start")) * 2 >= a."end" - a."start" + b."end" - b."start" - least(a."end", b."end") + greatest(a."start", b."start")""")
def overlaps_by_iou(spark, sf_dir):
    """Persons and dates with what other methods find in half of the same place or more."""
    found = hits(spark, sf_dir, METHODS, backend="arrow")
    left = F.col("type").isin("PERSON", "DATE")
    both = resolve.overlapping_pairs(found.where(left).select("doc_id", "start", "end", "type"), found.where(~left).select("doc_id", "start", "end", "type"), least_iou=0.5)
    return both.withColumn("iou", F.round("iou", 6))


@query(f"""
with {twins.spans(METHODS.rules)}
select a.doc_id, case when a."end" <= b."start" or b."end" <= a."start" then 'NONE' when a."start" <= b."start" and a."end" >= b."end" then 'CONTAINS' when b."start" <= a."start" and b."end" >= a."end" then 'CONTAINED' else 'PARTIAL' end as kind, count(*) as n
from s a join s b using (doc_id) where a.type = 'PERSON' and b.type = 'ORGANIZATION' group by all""")
def overlap_kind_counts(spark, sf_dir):
    """How the persons of a document lie to its organisations; those that lie apart are counted, not paired."""
    # two of the eight methods' types are asked for; both sides and their sizes come from one scan
    rules = replace(METHODS, rules=tuple(r for r in METHODS.rules if r.type in ("PERSON", "ORGANIZATION")))
    found = pivots.written(hits(spark, sf_dir, rules, backend="arrow").select("doc_id", "start", "end", "type"))
    kind = resolve.overlap_kind(*(F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")))
    return intervals.pair_counts(found.where("type = 'PERSON'"), found.where("type = 'ORGANIZATION'"), kind)


# ---- neighbours ----------------------------------------------------------------------------------


def _by_pivots(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    chosen = pivots.choose(e, "vec_id", "embedding")
    index = pivots.written(pivots.blocks(e, chosen, "vec_id", "embedding", pivots.BLOCK))
    return e, pivots.search(e.where("vec_id % 20 = 0"), index, chosen)


@query(KNN_SQL.format(distance="list_sum(list_transform(list_zip(cast(v as double[]), cast(embedding as double[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"))
def knn_pivots(spark, sf_dir):
    """The nearest vectors of every twentieth one, by pivots."""
    return _by_pivots(spark, sf_dir)[1].select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@query()
def knn_pivot_share(spark, sf_dir):
    """How many distances the search by pivots computed, and what share of all."""
    e, found = _by_pivots(spark, sf_dir)
    taken = found.where("rank = 1").agg(F.count("*").alias("queries"), F.sum("computed").alias("computed"))
    return taken.crossJoin(F.broadcast(e.agg(F.count("*").alias("vectors")))).withColumn("share", F.round(F.col("computed") / (F.col("queries") * F.col("vectors")), 4))


# ---- plug-ins and tables that last -----------------------------------------------------------------

PARTS = only("simple", "EMAIL", "PHONE_NUMBER", "CREDIT_CARD")
PARTS_MASKED = only("simple", "EMAIL", "PHONE_NUMBER", "CREDIT_CARD", policy="greedy_first")


@query(f"""
with {twins.spans(PARTS.rules)} select doc_id, type, text, "start", "end", score from s""")
def scan_by_table_function(spark, sf_dir):
    """The finds of a pack as rows of a table function called in SQL."""
    tables.register(spark, "veil_finds", PARTS)
    docs = read(spark, sf_dir, "documents")
    return spark.sql('select d.doc_id, f.type, f.text, f.start, f.end, f.score from {docs} d, lateral veil_finds(d.text, d.lang) f', docs=docs)


@query(f"""
with {EMAIL_SETS_SQL}, o as (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.type, b.type) as type, count(a.type) filter (b.type is not null) as tp, count(a.type) as found, count(b.type) as truth from a full outer join b on a.doc_id = b.doc_id and a.text = b.text and a.type = b.type group by 1, 2),
m as (select type, case when found > 0 then tp / found else 0 end as p, case when truth > 0 then tp / truth else 0 end as r, 2 * tp / (found + truth) as f from o)
select type, count(*) as p_n, round(sum(p), 6) as p_sum, round(avg(p), 6) as p_mean, round(min(p), 6) as p_min, round(max(p), 6) as p_max, count(*) as r_n, round(sum(r), 6) as r_sum, round(avg(r), 6) as r_mean, round(min(r), 6) as r_min, round(max(r), 6) as r_max,
  count(*) as f_n, round(sum(f), 6) as f_sum, round(avg(f), 6) as f_mean, round(min(f), 6) as f_min, round(max(f), 6) as f_max from m group by type""")
def metric_summaries(spark, sf_dir):
    """Precision, recall and F1 of each document, summed up by type with aggregates that a caller supplies."""
    pred, truth = (s.withColumn(n, F.lit(True)) for s, n in zip(_sets(spark, sf_dir), ("a", "b"), strict=True))
    both = pred.join(truth, ["doc_id", "text", "type"], "full").groupBy("doc_id", "type").agg(F.count_if(F.col("a") & F.col("b")).alias("tp"), F.count("a").alias("found"), F.count("b").alias("truth"))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    each = both.select("type", share(F.col("tp"), F.col("found")).alias("p"), share(F.col("tp"), F.col("truth")).alias("r"), share(2 * F.col("tp"), F.col("found") + F.col("truth")).alias("f"))
    out = aggregates.summarized(each, ["type"], *(aggregates.Summary(c) for c in "prf"))
    return out.select("type", *(F.col(c) if c.endswith("_n") else F.round(c, 6).alias(c) for c in out.columns if c != "type"))


def _folder(spark, name: str) -> str:
    """A new folder where all executors see it."""
    pivots.checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("""
select conv_id, turn, case when conv_id % 5 = 0 then upper(role) else role end as role, text, cast(case when conv_id % 5 = 0 then 2 else 1 end as bigint) as version from conversations
union all select -conv_id - 1, turn, role, text, 1 from conversations where conv_id % 7 = 0""")
def upserted_conversations(spark, sf_dir):
    """The conversations after an update of every fifth one, and new ones."""
    turns, path = read(spark, sf_dir, "conversations").withColumn("version", F.lit(1).cast("long")), _folder(spark, "conversations")
    keyed.upsert(turns, path, ["conv_id", "turn"], buckets=16)
    changed = turns.where("conv_id % 5 = 0").withColumns({"role": F.upper("role"), "version": F.lit(2).cast("long")})
    added = turns.where("conv_id % 7 = 0").withColumn("conv_id", -F.col("conv_id") - 1)
    keyed.upsert(changed.unionByName(added), path, ["conv_id", "turn"], buckets=16)
    return keyed.read_keyed(spark, path).select("conv_id", "turn", "role", "text", "version")


@query(twins.analysis(PARTS_MASKED))
def analysis_from_cache(spark, sf_dir):
    """The documents' analysis, for those of one language from results that an earlier run has left."""
    docs, path = read(spark, sf_dir, "documents"), _folder(spark, "results")
    keyed.analyzed_once(docs.where("lang = 'en'"), path, PARTS_MASKED)
    out = keyed.analyzed_once(docs, path, PARTS_MASKED)
    return out.select("doc_id", "masked_text", F.col("statistics.total_entities").alias("total_entities"), F.array_join("statistics.unique_types", ",").alias("types"))


# ---- JSON ----------------------------------------------------------------------------------------


@query(f"""
select 'documents' as source, doc_id as id, regexp_replace(regexp_replace(text, {EMAIL_CASED_SQL}, '[EMAIL]', 'g'), {IP_LIGHT_SQL}, '[IP_ADDRESS]', 'g') as body, n_chars as number, 'n_chars,body,meta' as keys, lang as nested from documents
union all select 'events', event_id, null, cast(json_extract(props, '$.k') as bigint), array_to_string(json_keys(props), ','), null from events""")
def redacted_json(spark, sf_dir):
    """Documents wrapped in JSON, and the events' properties, with every string leaf masked."""
    rules = only("light", "EMAIL", "IP_ADDRESS", policy="greedy_first")
    docs, events = read(spark, sf_dir, "documents"), read(spark, sf_dir, "events")
    meta = F.struct(F.array("lang", "source").alias("from"))
    wrapped = docs.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.to_json(F.struct("n_chars", F.col("text").alias("body"), meta.alias("meta"))).alias("j"))
    both = wrapped.unionByName(events.select(F.lit("events").alias("source"), F.col("event_id").alias("id"), F.col("props").alias("j")))
    done = pipeline.redact_json(both, "j", rules, masks="tag")
    number = F.coalesce(F.get_json_object("j", "$.n_chars"), F.get_json_object("j", "$.k")).cast("long")
    return done.select("source", "id", F.get_json_object("j", "$.body").alias("body"), number.alias("number"), F.array_join(F.json_object_keys("j"), ",").alias("keys"), F.get_json_object("j", "$.meta.from[0]").alias("nested"))


@query("""
with j as (select doc_id, to_json({'body': text, 'meta': {'from': [lang, source], 'n': n_chars}}) as j from documents)
select doc_id, fullkey as path, json_extract_string(atom, '$') as value from j, json_tree(j.j) where type = 'VARCHAR'""")
def json_string_leaves(spark, sf_dir):
    """Every string of documents wrapped in JSON, with its path."""
    docs = read(spark, sf_dir, "documents")
    wrapped = docs.select("doc_id", F.to_json(F.struct(F.col("text").alias("body"), F.struct(F.array("lang", "source").alias("from"), F.col("n_chars").alias("n")).alias("meta"))).alias("j"))
    return jsontext.strings(wrapped, "doc_id", "j")




# ---- thresholds that learn -----------------------------------------------------------------------

#: Rules that differ in score and method, so that feedback on some drops their finds.
DOUBTED = Profile("doubted", tuple(replace(r, score=s, method=m) for r, s, m in zip(FINDS.rules, (0.75, 0.55, 0.97), ("regex", "digits", "words"), strict=True)), "all")
_DOUBTED_SQL = "case type " + " ".join(f"when {twins.text(r.type)} then {r.score}" for r in DOUBTED.rules) + " end"


@query(f"""
with d as (select doc_id, text as t, lang is not distinct from 'en' as early from documents where text is not null), {_found_sql("d")},
f as (select m.*, coalesce(quality = 0, false) as bad from m join labels using (doc_id)),
r as (select type, early, bad, sum(cast(bad as int)) over w as wrong, count(*) over w as n from f window w as (partition by type order by early desc, doc_id, a)),
u as (select type, count(*) filter (where early and bad and wrong / n > 0.1) as one, count(*) filter (where bad and wrong / n > 0.1) as two from r group by type)
select m.doc_id, m.type, a as "start", z as "end", substr(t, a + 1, z - a) as text from m left join u using (type)
where {_DOUBTED_SQL} >= least(0.5 + 0.1 * coalesce(case when early then one else two end, 0), 0.95)""")
def adaptive_scan(spark, sf_dir):
    """The documents as a stream of two batches, each scanned by what labels have taught so far: a find in a text of low quality is wrong."""
    docs, labels, path = read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"), _folder(spark, "adaptive")
    early = F.col("lang").eqNullSafe("en")
    for part in (early, ~early):
        docs.where(part).write.mode("append").parquet(f"{path}/texts")
        finds = docs.where(part).join(labels, "doc_id").select("doc_id", "text", "lang", "quality")
        found = pipeline.detect(finds, DOUBTED).select("doc_id", (F.col("quality") == 0).alias("false_positive"), F.explode("entities").alias("e"))
        found.select("e.method", "e.type", F.struct("doc_id", "e.start"), "false_positive").toDF("method", "type", "ts", "false_positive").write.mode("append").parquet(f"{path}/feedback")
        feedback = stream.read_files(spark, f"{path}/feedback", "method string, type string, ts struct<doc_id:long,start:int>, false_positive boolean", files_per_batch=1_000_000)
        adaptive.learn(feedback.withColumn("ts", F.format_string("%019d %010d", "ts.doc_id", "ts.start")), f"{path}/learnt", f"{path}/learning")
        texts = stream.read_files(spark, f"{path}/texts", "doc_id long, text string, lang string", files_per_batch=1_000_000)
        adaptive.detect(texts, f"{path}/learnt", f"{path}/found", f"{path}/scanning", DOUBTED)
    return adaptive.results(spark, f"{path}/found").select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.type", "e.start", "e.end", "e.text")


# ---- requests ------------------------------------------------------------------------------------


@query(f"""
with t as (select 'c' || conv_id as id, text from conversations union all select 'd' || doc_id, text from documents)
select id, count(*) as texts, count(text) as answered, count(*) - count(text) as errors,
cast(coalesce(sum(length(regexp_extract_all(text, {EMAIL_CASED_SQL})) + length(regexp_extract_all(regexp_replace(text, {EMAIL_CASED_SQL}, '[EMAIL]', 'g'), {IP_LIGHT_SQL}))), 0) as bigint) as entities from t group by id""")
def request_batches(spark, sf_dir):
    """Conversations as requests of many texts and documents as requests of one, read from files of bodies and answered."""
    rules, path = only("light", "EMAIL", "IP_ADDRESS", policy="greedy_first"), _folder(spark, "requests")
    docs, turns = read(spark, sf_dir, "documents"), read(spark, sf_dir, "conversations")
    single = docs.select(F.struct("text", F.col("lang").alias("language"), F.struct(F.concat(F.lit("d"), "doc_id").alias("id")).alias("config")).alias("b"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    many = turns.groupBy("conv_id").agg(in_order.alias("texts")).select(F.struct("texts", F.struct(F.concat(F.lit("c"), "conv_id").alias("id")).alias("config")).alias("b"))
    for k, bodies in enumerate((single, many)):
        bodies.select(F.to_json("b").alias("value")).write.text(f"{path}/{k}")
    spark.dataSource.register(requests.Requests)
    both = spark.read.format("requests").load(f"{path}/0").unionByName(spark.read.format("requests").load(f"{path}/1").withColumn("request", F.concat(F.lit("c"), "request")))
    out = requests.batch_results(both, rules)
    found = F.aggregate("results", F.lit(0).cast("long"), lambda n, r: n + F.size(r["entities"]))
    return out.select(F.col("config")["id"].alias("id"), F.col("total_processed").alias("texts"), F.col("success_count").alias("answered"), F.col("error_count").alias("errors"), found.alias("entities"))


# ---- recognizers ---------------------------------------------------------------------------------

RECOGNIZED = PROFILES["recognizers"]


def _recognized_sql() -> str:
    return ", ".join(f"{{'score': {r.score}, 'hits': case when lang = {twins.text(r.langs[0])} then regexp_extract_all(t, {twins.text(r.pattern)}) end}}" for r in RECOGNIZED.rules if r.type == "PHONE_NUMBER")


@query(rf"""
with d as (select doc_id, case when lang = 'fr' then 'fr' else 'ar' end as lang, regexp_replace(text, '\+1 \(([0-9]{{3}})\) ([0-9]{{3}})-([0-9]{{3}})[0-9]', '0\1\2\3', 'g') as t from documents),
s as (select doc_id, lang, unnest([{_recognized_sql()}]) as x from d),
h as (select doc_id, lang, x.score as score, unnest(x.hits) as text from s)
select doc_id, lang, text, cast(score as double) as score, count(*) as n from h group by all""")
def recognized_phones(spark, sf_dir):
    """What the recognizers find as phones. The tables' phones are written with a nought and nine digits first, and texts that
    are not French are taken for Arabic, as the tables hold neither country's numbers."""
    docs = read(spark, sf_dir, "documents")
    local = F.regexp_replace("text", r"\+1 \(([0-9]{3})\) ([0-9]{3})-([0-9]{3})[0-9]", "0$1$2$3")
    texts = docs.select("doc_id", local.alias("text"), F.when(F.col("lang") == "fr", "fr").otherwise("ar").alias("lang"))
    return pipeline.entities(texts, RECOGNIZED, policy="all").where("type = 'PHONE_NUMBER'").groupBy("doc_id", "lang", "text", "score").agg(F.count("*").alias("n"))
