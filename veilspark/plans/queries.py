"""The registered queries of the engine, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mask, score, validate
from ..functions import text as tx
from ..functions.rules import EMAIL_PLAIN, PROFILES, Profile, Rule
from ..operators import evaluate, report, resolve, retrieve
from ..operators.scan import candidate_regions as candidate_regions_of
from ..streaming import stream
from . import pipeline, twins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(name: str, *kinds: str, policy: str = "all") -> Profile:
    """A profile with the rules of some types."""
    p = PROFILES[name]
    return Profile(f"{name}/{'+'.join(kinds)}", tuple(r for r in p.rules if r.type in kinds), policy, p.mask)


def hits(spark: SparkSession, sf_dir: str, profile: Profile, table: str = "documents", key: str = "doc_id", text: str = "text", backend: str = "auto") -> DataFrame:
    rows = read(spark, sf_dir, table)
    return pipeline.entities(rows.select(key, text, (F.col("lang") if "lang" in rows.columns else F.lit("en")).alias("lang")), profile, key=key, text=text, backend=backend)


# ---- SQL building blocks -------------------------------------------------------------------------

EMAIL_SQL = r"'(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'"
EMAIL_CASED_SQL = r"'\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'"
EMAIL_PLAIN_SQL = r"'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'"
IP_SQL = r"'\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b'"
CARD16_SQL = r"'\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b'"
PHONE_SQL = r"'(?:\+\d{1,3}[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}'"
IP_LIGHT_SQL = r"'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'"
ACCOUNT_SQL = r"'\b\d{8,17}\b'"


def found_sql(pattern: str, kind: str, table: str = "documents", columns: str = "doc_id, lang", text: str = "text") -> str:
    return f"select {columns}, '{kind}' as type, unnest(regexp_extract_all({text}, {pattern})) as text from {table}"


def luhn_sql(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when (length({d}) - i) % 2 = 0 then cast({d}[i] as int) when cast({d}[i] as int) * 2 > 9 then cast({d}[i] as int) * 2 - 9 else cast({d}[i] as int) * 2 end)) % 10 = 0"


EMAIL_IP_SQL = f"{found_sql(EMAIL_SQL, 'EMAIL')} union all {found_sql(IP_SQL, 'IP_ADDRESS')}"
SIMPLE_SQL = " union all ".join((found_sql(EMAIL_PLAIN_SQL, "EMAIL"), found_sql(PHONE_SQL, "PHONE_NUMBER"), found_sql(CARD16_SQL, "CREDIT_CARD"), found_sql(ACCOUNT_SQL, "BANK_ACCOUNT")))


# ---- spans ---------------------------------------------------------------------------------------


@query(f"select lang, type, count(*) as n, count(distinct doc_id) as docs from ({EMAIL_IP_SQL}) group by lang, type")
def pii_counts_by_lang_type(spark, sf_dir):
    found = hits(spark, sf_dir, only("api", "EMAIL", "IP_ADDRESS"))
    return found.groupBy("lang", "type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"select doc_id, text, count(*) as n from ({found_sql(EMAIL_SQL, 'EMAIL')}) group by doc_id, text")
def email_entities(spark, sf_dir):
    return report.counts(hits(spark, sf_dir, only("api", "EMAIL")), "doc_id", "text")


@query(f"select doc_id, text, count(*) as n from ({found_sql(IP_SQL, 'IP_ADDRESS')}) group by doc_id, text")
def ip_entities(spark, sf_dir):
    return report.counts(hits(spark, sf_dir, only("api", "IP_ADDRESS")), "doc_id", "text")


@query(f"select doc_id, text, count(*) as n from ({found_sql(PHONE_SQL, 'PHONE_NUMBER')}) group by doc_id, text")
def phone_entities(spark, sf_dir):
    return report.counts(hits(spark, sf_dir, only("simple", "PHONE_NUMBER")), "doc_id", "text")


@query(f"select doc_id, text, count(*) as n from ({found_sql(CARD16_SQL, 'CREDIT_CARD')}) where {luhn_sql('text')} group by doc_id, text")
def card_entities_luhn(spark, sf_dir):
    return report.counts(hits(spark, sf_dir, only("modular", "CREDIT_CARD")), "doc_id", "text")


@query(f"""
with m as (select doc_id, regexp_extract_all(text, {EMAIL_CASED_SQL}) as hit, regexp_split_to_array(text, {EMAIL_CASED_SQL}) as gap from documents),
s as (select doc_id, hit, unnest(range(1, length(hit) + 1)) as i, gap from m)
select doc_id, hit[i] as text,
  cast(coalesce(list_sum(list_transform(gap[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda h: length(h))), 0) as int) as "start",
  cast(coalesce(list_sum(list_transform(gap[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hit[1:i], lambda h: length(h))), 0) as int) as "end"
from s""")
def entity_spans(spark, sf_dir):
    return hits(spark, sf_dir, only("light", "EMAIL")).select("doc_id", "text", "start", "end")


@query(f"select doc_id, regexp_replace(text, {EMAIL_CASED_SQL}, '[EMAIL]', 'g') as masked_text from documents")
def redacted_emails(spark, sf_dir):
    p = only("light", "EMAIL", policy="greedy_first")
    return pipeline.analyze(read(spark, sf_dir, "documents"), p, masks="tag").select("doc_id", "masked_text")


@query(f"""
select doc_id, regexp_replace(regexp_replace(text, {EMAIL_CASED_SQL}, '[EMAIL]', 'g'), {IP_LIGHT_SQL}, '[IP_ADDRESS]', 'g') as masked_text from documents""")
def redacted_emails_and_ips(spark, sf_dir):
    p = only("light", "EMAIL", "IP_ADDRESS", policy="greedy_first")
    return pipeline.analyze(read(spark, sf_dir, "documents"), p, masks="tag").select("doc_id", "masked_text")


@query(f"""select doc_id, regexp_replace(text, '\\b([A-Za-z0-9._%+-]{{1,2}})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}})\\b', '\\1***@\\2', 'g') as masked_text from documents""")
def partially_masked_emails(spark, sf_dir):
    p = only("light", "EMAIL", policy="greedy_first")
    return pipeline.analyze(read(spark, sf_dir, "documents"), p, masks="partial").select("doc_id", "masked_text")


@query(f"select doc_id, text, text[1:4] || repeat('*', 8) || right(text, 4) as masked, repeat('*', greatest(length(text) - 12, 0)) as head from ({found_sql(CARD16_SQL, 'CREDIT_CARD')})")
def partially_masked_cards(spark, sf_dir):
    found = hits(spark, sf_dir, only("simple", "CREDIT_CARD"))
    return found.select("doc_id", "text", mask.partial_card(F.col("text")).alias("masked"), F.repeat(F.lit("*"), F.greatest(F.length("text") - 12, F.lit(0))).alias("head"))


@query(f"""
select d.doc_id, coalesce(n, 0) > 0 as has_pii, cast(coalesce(n, 0) as bigint) as n, case when length(d.text) > 0 then round(coalesce(n, 0) * 1000.0 / length(d.text), 6) else 0.0 end as per_1000
from documents d left join (select doc_id, count(*) as n from ({EMAIL_IP_SQL}) group by doc_id) e using (doc_id)""")
def docs_with_pii_and_density(spark, sf_dir):
    found = pipeline.detect(read(spark, sf_dir, "documents"), only("api", "EMAIL", "IP_ADDRESS"))
    n = F.size("entities").cast("long")
    return found.select("doc_id", (n > 0).alias("has_pii"), n.alias("n"), F.round(report.density(n * 1000.0, F.length("text")), 6).alias("per_1000"))


@query(f"""
select d.doc_id, case coalesce(max(case e.type when 'CREDIT_CARD' then 3 when 'BANK_ACCOUNT' then 3 when 'PHONE_NUMBER' then 2 when 'EMAIL' then 1 end), 0) when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end as risk_level, count(e.type) as n_entities
from documents d left join ({SIMPLE_SQL}) e using (doc_id) group by d.doc_id""")
def risk_by_document(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = hits(spark, sf_dir, only("simple", "EMAIL", "PHONE_NUMBER", "CREDIT_CARD", "BANK_ACCOUNT"))
    return report.risk(docs, found).select("doc_id", "risk_level", "n_entities")


@query(f"""
with k as (select doc_id, type, count(*) as n, case type when 'EMAIL' then 1 when 'PHONE_NUMBER' then 2 else 3 end as worst from ({SIMPLE_SQL}) group by doc_id, type),
r as (select doc_id, max(worst) as worst, cast(sum(n) as bigint) as n_entities, string_agg('Found ' || n || ' ' || type || '(s).', chr(10) order by type) as found from k group by doc_id)
select doc_id, case coalesce(worst, 0) when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end as risk_level, coalesce(n_entities, 0) as n_entities,
  case coalesce(worst, 0) when 0 then '{report.ADVICE["LOW"][0]}' when 1 then '{chr(10).join(report.ADVICE["MEDIUM"])}' when 2 then '{chr(10).join(report.ADVICE["HIGH"])}' else '{chr(10).join(report.ADVICE["CRITICAL"])}' end || coalesce(chr(10) || found, '') as recommendations
from documents left join r using (doc_id)""")
def risk_recommendations(spark, sf_dir):
    found = hits(spark, sf_dir, only("simple", "EMAIL", "PHONE_NUMBER", "CREDIT_CARD", "BANK_ACCOUNT"))
    return report.risk(read(spark, sf_dir, "documents"), found).withColumn("recommendations", F.array_join("recommendations", "\n"))


@query(f"""
with e as ({EMAIL_IP_SQL})
select lang, type, cast(null as varchar) as method, count(*) as n from e group by lang, type
union all select null, type, null, count(*) from e group by type
union all select null, null, 'regex', count(*) from e having count(*) > 0""")
def grouping_sets_metrics(spark, sf_dir):
    return report.metrics_cube(hits(spark, sf_dir, only("api", "EMAIL", "IP_ADDRESS")))


@query("""
select lang, count(*) as n, round(avg(n_chars), 6) as n_chars_mean, cast(sum(n_chars) as bigint) as n_chars_sum, round(stddev_samp(n_chars), 6) as n_chars_std, min(n_chars) as n_chars_min, max(n_chars) as n_chars_max,
  round(avg(words), 6) as words_mean, cast(sum(words) as bigint) as words_sum, round(stddev_samp(words), 6) as words_std, min(words) as words_min, max(words) as words_max
from (select lang, n_chars, cast(case when trim(text) = '' then 0 else length(regexp_split_to_array(trim(text), '\\s+')) end as bigint) as words from documents) group by lang""")
def per_language_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("lang", "n_chars", report.word_count(F.col("text")).alias("words"))
    out = report.per_language(docs, ["n_chars", "words"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith(("_mean", "_std"))})


@query("select doc_id, lang, n_chars from (select *, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 20")
def first_n_per_language(spark, sf_dir):
    return report.first_n(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), 20, "lang", "doc_id")


@query(f"select doc_id, type, text, count(*) as times from ({EMAIL_IP_SQL}) group by doc_id, type, text")
def best_per_type_and_text(spark, sf_dir):
    return report.best_per_text(hits(spark, sf_dir, only("api", "EMAIL", "IP_ADDRESS"))).select("doc_id", "type", "text", "times")


# ---- policies ------------------------------------------------------------------------------------


POLICY_TYPES = ("PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "DATE", "SOCIAL_SECURITY", "EMAIL")


def _policy(name: str, profile: str = "light") -> Query:
    def f(spark, sf_dir):
        p = only(profile, *POLICY_TYPES, policy=name)
        return pipeline.entities(read(spark, sf_dir, "documents"), p).select("doc_id", "type", "text", "start", "end")

    f.__name__ = f"policy_{name}"
    return f


for _name in ("greedy_first", "sweep_replace", "sweep_margin", "score_first_sweep", "touching_sweep", "interval_union", "iou"):
    query(twins.entities(only("light", *POLICY_TYPES), _name))(_policy(_name))


def _profile(name: str) -> Query:
    def f(spark, sf_dir):
        out = pipeline.analyze(read(spark, sf_dir, "documents"), name)
        return out.select("doc_id", "masked_text", F.col("statistics.total_entities").alias("total_entities"), F.array_join("statistics.unique_types", ",").alias("types"))

    f.__name__ = f"profile_{name}"
    return f


#: Profiles without a twin: their patterns need ends of words, or white space, that SQL's expressions do not have.
NO_TWIN = ("common", "fallback", "rich")
for _name, _rules in PROFILES.items():
    query(None if _name in NO_TWIN else twins.analysis(_rules, bound=_name in ("light", "code")))(_profile(_name))


@query(f"""
with c as (select doc_id, text as body, unnest(regexp_extract_all(text, {CARD16_SQL})) as t from documents),
p as (select doc_id, unnest(regexp_extract_all(text, {PHONE_SQL})) as t from documents)
select c.doc_id, c.t as card, p.t as phone from c join p using (doc_id) where contains(c.t, p.t) group by all""")
def phones_inside_cards(spark, sf_dir):
    cards, phones = (hits(spark, sf_dir, only("simple", k)).select("doc_id", "start", "end", "text") for k in ("CREDIT_CARD", "PHONE_NUMBER"))
    return resolve.overlapping_pairs(cards, phones).where(F.col("a_text").contains(F.col("b_text"))).select("doc_id", F.col("a_text").alias("card"), F.col("b_text").alias("phone")).distinct()


@query(twins.regions(only("simple", "CREDIT_CARD", "PHONE_NUMBER", "BANK_ACCOUNT")))
def region_islands(spark, sf_dir):
    found = resolve.regions(hits(spark, sf_dir, only("simple", "CREDIT_CARD", "PHONE_NUMBER", "BANK_ACCOUNT")))
    return found.select("doc_id", "island", "start", "end", F.array_join("kinds", "+").alias("kinds"))


# ---- evaluation ----------------------------------------------------------------------------------

EMAIL_SETS_SQL = f"a as (select distinct doc_id, text, type from ({found_sql(EMAIL_PLAIN_SQL, 'EMAIL')} union all {found_sql(IP_LIGHT_SQL, 'IP_ADDRESS')})), b as (select distinct doc_id, text, type from ({EMAIL_IP_SQL}))"
LOOSE = Profile("loose", (Rule("EMAIL", EMAIL_PLAIN, needs="@"), Rule("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")), "all")


def _sets(spark, sf_dir):
    keys = ("doc_id", "text", "type")
    return (hits(spark, sf_dir, p).select(*keys).distinct() for p in (LOOSE, only("api", "EMAIL", "IP_ADDRESS")))


@query(f"""
with {EMAIL_SETS_SQL}, o as (select coalesce(a.type, b.type) as type, a.type is not null and b.type is not null as tp, b.type is null as fp, a.type is null as fn from a full outer join b on a.doc_id = b.doc_id and a.text = b.text and a.type = b.type),
c as (select type, count(*) filter (tp) as tp, count(*) filter (fp) as fp, count(*) filter (fn) as fn from o group by type)
select type, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as "precision", round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when tp > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, tp + fn as support from c""")
def eval_prf_by_type(spark, sf_dir):
    pred, truth = _sets(spark, sf_dir)
    out = evaluate.by_type(evaluate.outcomes(pred, truth, on=("text", "type")))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""
with {EMAIL_SETS_SQL}, o as (select coalesce(a.type, b.type) as type, a.type is not null as p, b.type is not null as t from a full outer join b on a.doc_id = b.doc_id and a.text = b.text and a.type = b.type),
c as (select type, count(*) filter (p and t) as tp, count(*) filter (p) as np, count(*) filter (t) as nt from o group by type),
m as (select case when np > 0 then tp / np else 0 end as pr, case when nt > 0 then tp / nt else 0 end as rc, case when tp > 0 then 2.0 * tp / (np + nt) else 0 end as f1 from c),
s as (select sum(tp) as tp, sum(np) as np, sum(nt) as nt from c)
select (select round(coalesce(avg(pr), 0), 6) from m) as macro_precision, (select round(coalesce(avg(rc), 0), 6) from m) as macro_recall, (select round(coalesce(avg(f1), 0), 6) from m) as macro_f1,
  round(coalesce(case when np > 0 then tp / np end, 0), 6) as micro_precision, round(coalesce(case when nt > 0 then tp / nt end, 0), 6) as micro_recall, round(coalesce(case when tp > 0 then 2.0 * tp / (np + nt) end, 0), 6) as micro_f1 from s""")
def eval_macro_micro(spark, sf_dir):
    pred, truth = _sets(spark, sf_dir)
    out = evaluate.averages(evaluate.by_type(evaluate.outcomes(pred, truth, on=("text", "type"))))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query(f'with {EMAIL_SETS_SQL} select (select count(*) from (select * from a intersect select * from b)) as "both", (select count(*) from (select * from a except select * from b)) as only_a, (select count(*) from (select * from b except select * from a)) as only_b')
def detector_agreement(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return evaluate.agreement(a, b).select("both", "only_a", "only_b")


@query(f"with {EMAIL_SETS_SQL} select doc_id, text, type from b except select doc_id, text, type from a")
def missed_entities(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return b.join(a, ["doc_id", "text", "type"], "left_anti")


@query(f"""
with e as (select distinct doc_id, text from ({found_sql(EMAIL_SQL, 'EMAIL')})), m as (select doc_id, regexp_replace(text, {EMAIL_CASED_SQL}, '[EMAIL]', 'g') as masked from documents)
select doc_id, count(*) filter (contains(masked, e.text)) as leaks, count(*) as entities from m join e using (doc_id) group by doc_id""")
def leak_check(spark, sf_dir):
    truth = hits(spark, sf_dir, only("api", "EMAIL")).select("doc_id", "text").distinct()
    masked = pipeline.analyze(read(spark, sf_dir, "documents"), only("light", "EMAIL", policy="greedy_first"), masks="tag")
    return evaluate.leaks(masked, truth)


@query(f"""
select l.quality, l.toxic, count(*) as docs, count(*) filter (e.doc_id is not null) as with_pii
from labels l left join (select distinct doc_id from ({EMAIL_IP_SQL})) e using (doc_id) group by all""")
def labels_against_pii(spark, sf_dir):
    found = hits(spark, sf_dir, only("api", "EMAIL", "IP_ADDRESS")).select("doc_id").distinct().withColumn("hit", F.lit(True))
    return read(spark, sf_dir, "labels").join(found, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.count_if(F.col("hit").isNotNull()).alias("with_pii"))


# ---- conversations, pages ------------------------------------------------------------------------


@query("select c.conv_id, c.turn, coalesce(string_agg(p.role || ': ' || p.text, chr(10) order by p.turn), '') as context from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn < c.turn and p.turn >= c.turn - 3 and p.turn in (select turn from conversations x where x.conv_id = c.conv_id) group by c.conv_id, c.turn")
def prior_turn_context(spark, sf_dir):
    return report.prior_turns(read(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "context")


@query("select conv_id, max(turn) as turn, arg_max(role, turn) as role, arg_max(text, turn) as text from conversations group by conv_id")
def latest_turn_per_conversation(spark, sf_dir):
    return report.latest(read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query(f"select role, count(*) as turns, cast(coalesce(sum(length(regexp_extract_all(text, {EMAIL_SQL}))), 0) as bigint) as emails from conversations group by role")
def conversation_pii_by_role(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("lang", F.lit("en"))
    found = pipeline.detect(turns, only("api", "EMAIL"))
    return found.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.size("entities")).cast("long").alias("emails"))


@query()
def html_text_entities(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"), F.lit("en").alias("lang"))
    found = pipeline.detect(pages, "simple")
    return found.select("page_id", F.length("text").alias("length"), F.size("entities").alias("n"))


# ---- text ----------------------------------------------------------------------------------------


@query("select doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '[\\x{200B}-\\x{200D}\\x{FEFF}]', '', 'g')) as clean from documents")
def collapsed_whitespace(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.collapse(F.col("text")).alias("clean"))


@query("select doc_id, case when length(c) > 4900 then left(c, 4900) || '...' else c end as clean from (select doc_id, regexp_replace(text, '[*#_\\[\\]]', '', 'g') as c from documents)")
def stripped_markdown(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.strip_markdown(F.col("text")).alias("clean"))


@query("select case when regexp_matches(text, '[\\x{0600}-\\x{06FF}]') then 'ar' when regexp_matches(text, '[éèêëàâùûôîïçœÉÈÊËÀÂÙÛÔÎÏÇŒ]') then 'fr' else 'en' end as guess, lang, count(*) as n from documents group by all")
def guessed_languages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(tx.guess_language(F.col("text")).alias("guess"), "lang")
    return docs.groupBy("guess", "lang").agg(F.count("*").alias("n"))


@query("select doc_id, cast(i as int) as \"offset\", text[i + 1:i + 512] as text from (select doc_id, text, unnest(range(0, greatest(length(text), 1), 256)) as i from documents)")
def overlapping_windows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return tx.explode_chunks(docs, tx.windows(F.col("text"))).select("doc_id", "offset", "text")


@query("""
with recursive p as (select doc_id, flatten(list_transform(regexp_extract_all(text, '(?s).*?(?:\\. |$)'), lambda s: regexp_extract_all(s, '(?s).{1,500}'))) as pieces from documents),
e as (select doc_id, unnest(range(1, length(pieces) + 1)) as i, unnest(pieces) as piece from p),
r as (select doc_id, i, 0 as chunk, length(piece) as used, piece from e where i = 1
  union all select r.doc_id, e.i, case when used + length(e.piece) <= 500 then chunk else chunk + 1 end, case when used + length(e.piece) <= 500 then used else 0 end + length(e.piece), e.piece from r join e on e.doc_id = r.doc_id and e.i = r.i + 1)
select doc_id, chunk, string_agg(piece, '' order by i) as text from r group by doc_id, chunk""")
def sentence_chunks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentence_chunks(F.col("text"), 500)).alias("chunk", "text"))


@query("""
with c as (select doc_id, regexp_extract_all(text, '(?s).{1,399}(?:\\s|$)|.{1,400}') as t from documents), e as (select doc_id, unnest(t) as text, unnest(range(1, length(t) + 1)) as i from c)
select doc_id, cast(i - 1 as int) as chunk, cast(coalesce(sum(length(text)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as int) as "offset", text from e""")
def fixed_chunks(spark, sf_dir):
    return tx.explode_chunks(read(spark, sf_dir, "documents"), tx.fixed_chunks(F.col("text"), 400))


@query("select doc_id, least(length(text) // 4, 32768) as tokens, sha256(text) as text_sha256 from documents")
def token_estimates_and_hashes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("text_sha256"))


@query(f"select e.text, case when length(d) = 10 then '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] else e.text end as value, count(*) as n from (select text, regexp_replace(text, '[^0-9]', '', 'g') as d from ({found_sql(PHONE_SQL, 'PHONE_NUMBER')})) e group by all")
def normalized_phones(spark, sf_dir):
    found = hits(spark, sf_dir, only("simple", "PHONE_NUMBER"))
    return found.select("text", score.normal_value(F.col("type"), F.col("text")).alias("value")).groupBy("text", "value").agg(F.count("*").alias("n"))


@query(f"select distinct text, {luhn_sql('text')} as luhn from ({found_sql(CARD16_SQL, 'CREDIT_CARD')} union all {found_sql(ACCOUNT_SQL, 'BANK_ACCOUNT')})")
def validated_numbers(spark, sf_dir):
    from ..functions.validate import luhn

    found = hits(spark, sf_dir, only("simple", "CREDIT_CARD", "BANK_ACCOUNT"))
    return found.select("text", luhn(F.col("text")).alias("luhn")).distinct()


# ---- sinks, audit --------------------------------------------------------------------------------


@query(f"select doc_id as user_id, sha256(text) as text_sha256, cast(length(regexp_extract_all(text, {EMAIL_SQL})) as int) as n_entities from documents where doc_id % 3 <> 0 and length(regexp_extract_all(text, {EMAIL_SQL})) > 0")
def audit_log(spark, sf_dir):
    from ..sources import io

    found = pipeline.detect(read(spark, sf_dir, "documents"), only("api", "EMAIL"))
    return io.audit_rows(found, user=F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")), at=F.current_timestamp()).select("user_id", "text_sha256", "n_entities")


@query(f"select doc_id, cast(length(regexp_extract_all(text, {EMAIL_CASED_SQL})) as bigint) as n from documents")
def deduplicated_analysis(spark, sf_dir):
    out = pipeline.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), only("light", "EMAIL", policy="greedy_first"))
    return out.select("doc_id", F.col("statistics.total_entities").alias("n"))


@query("select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n, round(avg(value), 6) as mean_value from events group by all")
def json_props_profile(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("select count(*) as \"rows\", count(*) filter (text is null) as null_text, count(*) filter (lang is null) as null_lang, count(distinct lang) as langs, count(distinct source) as sources from documents")
def column_profile(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.count_if(F.col("text").isNull()).alias("null_text"), F.count_if(F.col("lang").isNull()).alias("null_lang"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"))


# ---- joins, windows, vectors ---------------------------------------------------------------------


@query("select n.n_name, count(*) as orders, round(sum(o.o_totalprice), 2) as total from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey group by n.n_name")
def fk_join(spark, sf_dir):
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select a.lang, a.source, a.n as n_short, b.n as n_long, round(b.n / a.n, 6) as ratio from (select lang, source, count(*) as n from documents where n_chars < 1000 group by all) a join (select lang, source, count(*) as n from documents where n_chars >= 1000 group by all) b on a.lang = b.lang and a.source = b.source")
def multi_key_join_ratio(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    short, long = (docs.where(c).groupBy("lang", "source").agg(F.count("*").alias(n)) for c, n in (("n_chars < 1000", "n_short"), ("n_chars >= 1000", "n_long")))
    return short.join(long, ["lang", "source"]).select("lang", "source", "n_short", "n_long", F.round(F.col("n_long") / F.col("n_short"), 6).alias("ratio"))


KNN_SQL = """
with q as (select vec_id as query_id, embedding as v from embeddings where vec_id % 20 = 0),
p as (select query_id, vec_id, {distance} as d from q cross join embeddings),
r as (select *, row_number() over (partition by query_id order by d, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, round(d, 6) as distance from r where rank <= 5"""


@query(KNN_SQL.format(distance="list_sum(list_transform(range(1, 65), lambda i: (cast(v[i] as double) - cast(embedding[i] as double)) * (cast(v[i] as double) - cast(embedding[i] as double))))"))
def knn_l2(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return retrieve.nearest(e.where("vec_id % 20 = 0"), e).withColumn("distance", F.round("distance", 6))


@query(KNN_SQL.format(distance="1 - list_cosine_similarity(cast(v as double[]), cast(embedding as double[]))"))
def knn_cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return retrieve.nearest(e.where("vec_id % 20 = 0"), e, metric="cosine").withColumn("distance", F.round("distance", 6))


@query("select time_bucket(interval '1 hour', ts) as \"start\", event_type, count(*) as n from events group by all")
def tumbling_counts(spark, sf_dir):
    return stream.windowed_counts(read(spark, sf_dir, "events"), "event_type").select("start", "event_type", "n")


@query("select s as \"start\", event_type, count(*) as n from (select event_type, unnest([time_bucket(interval '15 minutes', ts) - interval '45 minutes', time_bucket(interval '15 minutes', ts) - interval '30 minutes', time_bucket(interval '15 minutes', ts) - interval '15 minutes', time_bucket(interval '15 minutes', ts)]) as s from events) group by all")
def sliding_counts(spark, sf_dir):
    return stream.windowed_counts(read(spark, sf_dir, "events"), "event_type", slide="15 minutes").select("start", "event_type", "n")


@query("""
with f as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from f)
select user_id, min(ts) as "start", max(ts) + interval '30 minutes' as "end", count(*) as n from g group by user_id, s""")
def session_counts(spark, sf_dir):
    return stream.sessions(read(spark, sf_dir, "events"), "user_id")


@query()
def rule_registry(spark, sf_dir):
    from ..functions import hooks

    return hooks.registry(spark)


@query()
def candidate_regions(spark, sf_dir):
    found = candidate_regions_of(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "line", "start", "end", F.array_join("kinds", "+").alias("kinds"))


@query("select doc_id, text from documents where text is not null and text <> ''")
def chunks_joined_again(spark, sf_dir):
    """Fixed chunks without their last blank, joined by blanks, are the text where its white space is single blanks."""
    docs = read(spark, sf_dir, "documents").where("text is not null and text <> ''")
    pieces = docs.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("chunk", "text"))
    return tx.join_chunks(pieces)


# ---- validators and scores on fixed inputs -------------------------------------------------------


def cases(spark: SparkSession, *inputs: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in inputs], "x string")


def cases_sql(*inputs: str) -> str:
    return "(values " + ", ".join("('" + x.replace("'", "''") + "')" for x in inputs) + ") as c(x)"


ADDRESSES = ("a.b@mail.org", "Ann@sub.mail-x.fr", "a@example.com", "x@TEST.com", "me@mydomain.com", "a..b@mail.org", "12@mail.org", "1a@mail.org", "a@my_mail.org", "a@b@c.org", ".a@mail.org", "a.@mail.org", "a@-mail.org", "a@mail.org-", "no address", "", "Ann <ann@mail.org>", "a@b", "a@mail.o")
_REJECTED_SQL = "regexp_matches({x}, '(?i)(example\\.com$|test\\.com$|domain\\.com$|@.*@|\\.{{2,}}|^[0-9]+@|@.*_.*\\.)')"


@query(f"""
with a as (select x, case when contains(x, '<') and contains(x, '>') then regexp_extract(x, '<(.*?)>', 1) else x end as e from {cases_sql(*ADDRESSES)})
select x, regexp_matches(x, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') and not {_REJECTED_SQL.format(x="x")} as short,
  regexp_matches(e, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z|]{{2,}}$') and not {_REJECTED_SQL.format(x="e")}
  and length(split_part(e, '@', 1)) <= 64 and not regexp_matches(split_part(e, '@', 1), '^\\.|\\.$') and regexp_full_match(split_part(e, '@', 2), '[A-Za-z0-9.]([A-Za-z0-9.-]*[A-Za-z0-9.])?') as strict from a""")
def checked_addresses(spark, sf_dir):
    return cases(spark, *ADDRESSES).select("x", validate.email_short(F.col("x")).alias("short"), validate.email(F.col("x")).alias("strict"))


PHONES = ("+33 6 98 47 35 12", "0033698473512", "+966598473512", "+966412983547", "+971512983547", "+12125550199", "+11125550199", "+442079460958", "+440079460958", "0512983547", "051298354", "0698473512", "0098473512", "012983547", "212-555-0199", "1111198473", "12341234567", "90129012", "0112342345", "1234567", "+4915298473512", "1234567890123456")


@query(f"""
with d as (select x, case when starts_with(x, '+') then '+' else '' end || regexp_replace(x, '[^0-9]', '', 'g') as d from {cases_sql(*PHONES)}),
v as (select x, d, regexp_replace(d, '^(\\+|00)', '') as r, length(d) between 8 and 15
  and not regexp_matches(d, '0{{5}}|1{{5}}|2{{5}}|3{{5}}|4{{5}}|5{{5}}|6{{5}}|7{{5}}|8{{5}}|9{{5}}') and not regexp_matches(d, '(0123|1234|2345|3456|4567|5678|6789|7890){{2}}') as plain from d)
select x, plain, plain and case
    when regexp_matches(d, '^(\\+|00)') then case
      when r[1:3] in ('966', '971') then length(r) = 12 and r[4] in ('5', '7', '8', '9')
      when r[1:2] = '33' then length(r) = 11 and r[3] <> '0'
      when r[1:2] = '44' then length(r) in (11, 12) and r[3] <> '0'
      when r[1] = '1' then length(r) = 11 and r[2] not in ('0', '1')
      else regexp_full_match(r, '([0-9]{{1,3}})?[1-9][0-9]{{7,11}}') end
    when d[1:2] = '05' then length(d) = 10
    when d[1] = '0' then length(d) = 10 and d[2] <> '0'
    else regexp_full_match(d, '([0-9]{{1,3}})?[1-9][0-9]{{7,11}}') end as by_country from v""")
def checked_phones(spark, sf_dir):
    return cases(spark, *PHONES).select("x", validate.phone(F.col("x")).alias("plain"), validate.phone_country(F.col("x")).alias("by_country"))


VATS = ("FR12345678901", "FRXX999999999", "fr12345678901", "DE123456789", "DE 123 456 789", "DE12345678", "GB123456789", "GB123456789012", "IE1A234567B", "IEA2345678B", "BE2234567890", "EL123456789", "GR123456789", "ZZ123456789", "ZZ1234", "PL1234567890", "ATU12345678", "123456789012345", "100000000000000", "4111111111111111", "", "x")


@query(f"""
with s as (select x, replace(x, ' ', '') as s, regexp_replace(x, '[^0-9]', '', 'g') as d from {cases_sql(*VATS)}),
t as (select *, upper(s[1:2]) as c,
  d <> '' and list_sum(list_transform(range(0, length(d)), lambda i: case when i % 2 = 0 then cast(d[length(d) - i] as int) else (cast(d[length(d) - i] as int) * 2) // 10 + (cast(d[length(d) - i] as int) * 2) % 10 end)) % 10 = 0 as card,
  list_sum(list_transform(range(1, 16, 2), lambda i: try_cast(d[i] as int))) as odd, list_sum(list_transform(range(2, 16, 2), lambda i: try_cast(d[i] as int))) as even from s)
select x, not card and ((regexp_full_match(s, '[0-9]{{15}}') and odd % 11 = 0 and even % 7 = 0) or (length(s) >= 8 and case
    when c in ('DE', 'PT') then regexp_full_match(s, c || '[0-9]{{9}}') when c in ('LU', 'DK', 'FI') then regexp_full_match(s, c || '[0-9]{{8}}')
    when c = 'FR' then regexp_full_match(s, 'FR[0-9A-Z]{{2}}[0-9]{{9}}') when c = 'GB' then regexp_full_match(s, 'GB([0-9]{{9}}|[0-9]{{12}})') when c = 'IT' then regexp_full_match(s, 'IT[0-9]{{11}}')
    when c = 'ES' then regexp_full_match(s, 'ES[A-Z0-9][0-9]{{7}}[A-Z0-9]') when c = 'BE' then regexp_full_match(s, 'BE[0-9]{{10}}') when c = 'NL' then regexp_full_match(s, 'NL[0-9]{{9}}B[0-9]{{2}}')
    when c = 'AT' then regexp_full_match(s, 'ATU[0-9]{{8}}') when c = 'GR' then regexp_full_match(s, 'EL[0-9]{{9}}') when c = 'IE' then regexp_full_match(s, 'IE[0-9A-Z+*][0-9]{{7}}[A-Z]') when c = 'SE' then regexp_full_match(s, 'SE[0-9]{{12}}')
    else regexp_full_match(s, '[A-Z]{{2}}[0-9A-Z]{{8,12}}') end)) as good from t""")
def checked_vat_numbers(spark, sf_dir):
    return cases(spark, *VATS).select("x", validate.vat(F.col("x")).alias("good"))


NUMBERS = ("123-45-6789", "000-45-6789", "666-45-6789", "900-45-6789", "899-12-3456", "123-00-6789", "123-45-0000", "021000021", "011401533", "021000022", "12")


@query(f"""
with n as (select x, regexp_replace(x, '[^0-9]', '', 'g') as d from {cases_sql(*NUMBERS)})
select x, length(d) = 9 and d[1:3] not in ('000', '666') and d[1:3] < '900' and d[4:5] <> '00' and d[6:9] <> '0000' as ssn,
  length(d) = 9 and (3 * (try_cast(d[1] as int) + try_cast(d[4] as int) + try_cast(d[7] as int)) + 7 * (try_cast(d[2] as int) + try_cast(d[5] as int) + try_cast(d[8] as int)) + try_cast(d[3] as int) + try_cast(d[6] as int) + try_cast(d[9] as int)) % 10 = 0 as routing from n""")
def checked_us_numbers(spark, sf_dir):
    return cases(spark, *NUMBERS).select("x", validate.ssn(F.col("x")).alias("ssn"), validate.routing(F.col("x")).alias("routing"))


NEARBY = ("my credit card", "security code", "document id", "expiry cvv", "VAT number 12", "fiscal", "Reference #12", "tax invoice id", "none", "", "visa debit, tax number")


@query(f"""
with v as (select x, cast(regexp_matches(x, '(?i)(credit|debit|card|visa|mastercard|amex)') as int) + cast(regexp_matches(x, '(?i)(expir|cvv|security code)') as int) as a,
  cast(regexp_matches(x, '(?i)(tax|fiscal|vat|tva)') as int) + cast(regexp_matches(x, '(?i)(number|id|identifier)') as int) as b,
  cast(regexp_matches(x, '(?i)(ref|reference|invoice|document)') as int) + cast(regexp_matches(x, '(?i)(number|id|#)') as int) as c from {cases_sql(*NEARBY)})
select x, case when a + b + c = 0 then 'UNKNOWN' when a >= b and a >= c then 'CREDIT_CARD' when b >= c then 'TAX_ID' else 'REFERENCE' end as kind from v""")
def number_contexts(spark, sf_dir):
    return cases(spark, *NEARBY).select("x", score.number_context(F.col("x")).alias("kind"))


FOUND = ("EMAIL|ann@mail.org", "EMAIL|ann@mail", "PHONE_NUMBER|212-555-0199", "PHONE_NUMBER|+1 (212) 555-0199", "PHONE_NUMBER|12125550199", "CREDIT_CARD|4111111111111111", "CREDIT_CARD|4111111111111112", "SSN|123-45-6789", "SSN|123456789", "DATE|1/2/2020", "PERSON|J", "PERSON|Al", "PERSON|They", "DATE|they", "TIME|12", "TIME|early morning", "CARDINAL|twelve", "ID|A1", "ORG|the")


@query(f"""
with k as (select x, split_part(x, '|', 1) as kind, split_part(x, '|', 2) as v from {cases_sql(*FOUND)})
select x, cast(case kind when 'EMAIL' then case when contains(split_part(v, '@', 2), '.') then 0.95 else 0.5 end
    when 'PHONE_NUMBER' then case when regexp_full_match(v, '\\+?1?[0-9]{{3}}[-.]?[0-9]{{3}}[-.]?[0-9]{{4}}') then 0.9 else 0.7 end
    when 'CREDIT_CARD' then case when {luhn_sql("v")} then 0.95 else 0.6 end
    when 'SSN' then case when regexp_full_match(v, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') then 0.9 else 0.7 end else 0.8 end as double) as by_pattern,
  case when (kind in ('CARDINAL', 'TIME') and (regexp_full_match(trim(v), '[0-9]+') or regexp_matches(lower(v), '(few|many|several|countless)\\s+(hours|days|weeks|months|years)|early|late|mid'))) or kind = 'CARDINAL' then null
    else round(cast(0.8 as double) * case when length(v) < 2 then 0.5 when length(v) < 3 then 0.7 else 1 end * case when kind not in ('PERSON', 'ORG', 'GPE', 'LOC') and (length(trim(v)) < 3 or lower(v) in ('the', 'they')) then 0.8 else 1 end
      * case when length(trim(v)) < 3 and kind not in ('ID', 'AGE') then 0.5 else 1 end, 6) end as normalized from k""")
def scored_finds(spark, sf_dir):
    rows = cases(spark, *FOUND).withColumns({"kind": F.split("x", r"\|")[0], "v": F.split("x", r"\|")[1]})
    kind, v = F.col("kind"), F.col("v")
    plain = score.normalized_score(kind, v, F.lit(0.8), F.lit(1), validate.common_word(v, F.lit("en")))
    return rows.select("x", score.pattern_score(kind, v).alias("by_pattern"), F.round(plain, 6).alias("normalized"))
