"""Queries that hold validators, scores, masks and text forms against SQL on fixed inputs, and reports against SQL on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mask, score, validate
from ..functions import text as tx
from ..operators import evaluate, report, resolve
from ..operators.scan import span
from . import twins
from .queries import cases, cases_sql, hits, luhn_sql, only, query, read

ACCOUNTS = ("GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "FR1420041010050500013M02606", "ZZ82WEST12345698765432", "DEUTDEFF", "DEUTCAFF", "ROYCCAT2", "BNPAFRPP123", "BNPAQQPP", "bnpafrpp", "30002005500000157841Z25", "20041010050500013M02606", "20041010050500013M02607", "20041 01005 0500013M026 06", "")


@query(f"""
with r as (select x, upper(regexp_replace(x, '[\\s-]', '', 'g')) as s from {cases_sql(*ACCOUNTS)}),
n as (select x, s, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '12345678912345678923456789') as d from r)
select x, {twins.iban("x")} as iban, regexp_full_match(x, '[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?') and x[5:6] in ('DE', 'CA', 'FR', 'AT') as bic,
  regexp_full_match(s, '[0-9]{{10}}[0-9A-Z]{{11}}[0-9]{{2}}') and coalesce((89 * try_cast(d[1:5] as bigint) + 15 * try_cast(d[6:10] as bigint) + 3 * try_cast(d[11:21] as bigint) + try_cast(d[22:23] as bigint)) % 97 = 0, false) as rib from n""")
def checked_accounts(spark, sf_dir):
    x = F.col("x")
    return cases(spark, *ACCOUNTS).select("x", validate.iban(x).alias("iban"), validate.bic(x).alias("bic"), validate.rib(x).alias("rib"))


WALLETS = ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "bc1b", "0x52908400098527886E0F7030069857D2E4169EE7", "0x0000000000000000000000000000000000000000", "0x12", "rEb8TK3gBgk5auZkwc6sHnwrGVJH8DuaLh", "bnb136ns6lfw4zs5hg4n85vdthaad7hq5m4gtkgf23", "none", "")


@query(f"""
select x, case when x[1] in ('1', '3') then regexp_full_match(x, '[13][1-9A-HJ-NP-Za-km-z]{{33}}') when x[1:3] = 'bc1' then regexp_full_match(x, 'bc1[02-9ac-hj-np-z]{{11,71}}')
  when x[1:2] = '0x' then regexp_full_match(x, '0x[0-9a-fA-F]{{40}}') and x <> '0x' || repeat('0', 40) when x[1:3] = 'bnb' then regexp_full_match(x, 'bnb[1-9A-HJ-NP-Za-km-z]{{39}}')
  when x[1] = 'r' then regexp_full_match(x, 'r[1-9A-HJ-NP-Za-km-z]{{24,34}}') else regexp_full_match(x, '[1-9A-HJ-NP-Za-km-z]{{25,42}}') end as good from {cases_sql(*WALLETS)}""")
def checked_wallets(spark, sf_dir):
    return cases(spark, *WALLETS).select("x", validate.crypto(F.col("x")).alias("good"))


PAPERS = ("INV-2024-12345", "FAC-2024-123456", "INV-24-1", "FINV-ABC12345", "LN-2024-12345", "LOAN-ABCDEF12", "tok_abcdefghijklmnop", "tok_abc", "FUND-ABCDEFGH", "INV-123456789", "123-45-6789", "000-45-6789", "FR12345678901", "4111111111111111", "4111111111111112", "2004101005050001302606", "word", "")


@query(f"""
with p as (select x, regexp_full_match(x, '(INV|FAC)-[0-9]{{4}}-[0-9]{{5,}}|FINV-[A-Z0-9]{{8,}}') as invoice, regexp_full_match(x, '(LN|MORT)-[0-9]{{4}}-[0-9]{{5,}}|LOAN-[A-Z0-9]{{8,}}') as loan from {cases_sql(*PAPERS)})
select x, invoice, loan, regexp_full_match(x, '(tok|pi|ch)_[a-zA-Z0-9]{{16,}}') as token, regexp_full_match(x, 'INV-[0-9]{{9}}|FUND-[A-Z0-9]{{8,}}|ACC-[A-Z0-9]{{9,}}') as investment from p""")
def checked_papers(spark, sf_dir):
    names = {"invoice": "invoice_number", "loan": "loan_number", "token": "payment_token", "investment": "investment_id"}
    return cases(spark, *PAPERS).select("x", *(validate.VALIDATORS[v](F.col("x")).alias(k) for k, v in names.items()))


FORMS = ("  Hello \t World\r\nnext\rline ", "a​b﻿c", "Ġword", "▁Word.", "x; ", "", "ENGLISH", "fr-FR", "de", "per", "Gpe", "other", "123 456", "أحمد إلى آدم", "مدرسة  كبرى")


def _chars_sql(x: str) -> str:
    return x.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")


@query(f"""
select x, regexp_replace(regexp_replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g') as lines,
  lower(trim(regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'))) as compared, trim(replace(replace(x, 'Ġ', ''), '▁', ''), '.,;: ') as bare,
  case lower(x) when 'english' then 'en' when 'fr-fr' then 'fr' else lower(x) end as language, case upper(x) when 'PER' then 'PERSON' when 'GPE' then 'LOCATION' else upper(x) end as type,
  regexp_replace(trim(regexp_replace(translate(x, 'أإآٱىة', 'اااايه'), '\\s+', ' ', 'g')), '([0-9]) ([0-9])', '\\1\\2', 'g') as arabic from {_chars_sql(cases_sql(*FORMS))}""")
def text_forms(spark, sf_dir):
    x = F.col("x")
    return cases(spark, *FORMS).select("x", tx.clean_lines(x).alias("lines"), tx.compare_form(x).alias("compared"), tx.strip_token_marks(x).alias("bare"), tx.language_code(x).alias("language"), score.type_name(x).alias("type"), tx.normalize_arabic(x).alias("arabic"))


@query("select doc_id, case when text is null or trim(text) = '' then 'text is empty' when lang not in ('en', 'fr', 'ar') then 'unsupported language ' || lang end as error from documents")
def request_errors(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", validate.request_error(F.col("text"), F.col("lang")).alias("error"))


MASKED = ("EMAIL_ADDRESS|ann.smith@mail.org", "PHONE_NUMBER|212-555-0199", "CREDIT_CARD|4111-1111-1111-1111", "IBAN_FR|FR1420041010050500013M02606", "PERSON|Ann Lee", "LOCATION|Paris", "US_SSN|123-45-6789", "FR_AMOUNT|12 EUR", "SSN|1234", "OTHER|ab")


@query(f"""
with k as (select x as case_, split_part(x, '|', 1) as type, split_part(x, '|', 2) as x from {cases_sql(*MASKED)})
select case_ as x, {twins.MASKS["financial"]} as financial, {twins.MASKS["angle_tag"]} as angle_tag, {twins.MASKS["brief_tag"]} as brief_tag, {twins.MASKS["partial"]} as partial, repeat('*', length(x)) as stars, '[HASH:' || sha256(x)[1:8] || ']' as hash, x as identity, '[REDACTED]' as redacted,
  case type when 'PERSON' then '<PERSONNE>' when 'LOCATION' then '<LIEU>' when 'PHONE_NUMBER' then left(x, greatest(length(x) - 12, 0)) || repeat('*', least(12, length(x))) when 'EMAIL_ADDRESS' then left(x, greatest(length(x) - 10, 0)) || repeat('@', least(10, length(x)))
    when 'CREDIT_CARD' then left(x, greatest(length(x) - 16, 0)) || repeat('#', least(16, length(x))) when 'US_SSN' then repeat('#', least(11, length(x))) || substr(x, 12) else '<ANONYMISÉ>' end as french,
  case type when 'EMAIL_ADDRESS' then repeat('*', least(8, length(x))) || substr(x, 9) when 'CREDIT_CARD' then left(x, greatest(length(x) - 12, 0)) || repeat('*', least(12, length(x))) when 'PHONE_NUMBER' then left(x, greatest(length(x) - 6, 0)) || repeat('*', least(6, length(x)))
    when 'SSN' then left(x, greatest(length(x) - 5, 0)) || repeat('*', least(5, length(x))) else repeat('*', length(x)) end as mask_n from k""")
def masked_values(spark, sf_dir):
    kind, value = F.split("x", r"\|")[0], F.split("x", r"\|")[1]
    names = ("financial", "angle_tag", "brief_tag", "partial", "stars", "hash", "identity", "redacted", "french", "mask_n")
    return cases(spark, *MASKED).select("x", *(mask.MASKS[n](kind, value, F.lit("")).alias(n) for n in names))


# ---- reports on whole tables ---------------------------------------------------------------------

NUMBERS = only("simple", "CREDIT_CARD", "PHONE_NUMBER", "BANK_ACCOUNT")


@query(f"with {twins.spans(NUMBERS.rules)} select 'regex' as method, count(*) as total, count(*) filter (score >= 0.5) as filtered, array_to_string(list_sort(list(distinct type)), '+') as types from s having count(*) > 0")
def finds_by_method(spark, sf_dir):
    return report.by_method(hits(spark, sf_dir, NUMBERS)).withColumn("types", F.array_join("types", "+"))


@query(f"""
with {twins.spans(NUMBERS.rules)}, n as (select count(*) as found from s)
select count(*) as total_processed, any_value(found) as total_pii_found, count(*) filter (text is not null) as success_count, count(*) filter (text is null) as error_count, cast(count(*) * 0.5 as double) as total_processing_time, cast(0.5 as double) as average_time_per_text from documents, n""")
def batch_report(spark, sf_dir):
    from . import pipeline

    found = pipeline.detect(read(spark, sf_dir, "documents"), NUMBERS).withColumns({"success": F.col("text").isNotNull(), "seconds": F.lit(0.5)})
    return report.batch_summary(found)


@query(f"""
with {twins.spans(NUMBERS.rules)},
u as (select distinct doc_id, "start", "end", type, text, score from s),
f as (select *, max("end") over (partition by doc_id order by "start", "end" rows between unbounded preceding and 1 preceding) as reach from u),
g as (select *, sum(case when reach is null or "start" > reach then 1 else 0 end) over (partition by doc_id order by "start", "end" rows unbounded preceding) as island from f)
select doc_id, type, "start", "end", text from g qualify row_number() over (partition by doc_id, island, split_part(type, '_', 1) order by score desc, "start", "end", type) = 1""")
def best_in_islands(spark, sf_dir):
    return resolve.best_in_island(hits(spark, sf_dir, NUMBERS)).select("doc_id", "type", "start", "end", "text")


@query(f"""
with {twins.spans(NUMBERS.rules)}
select a.doc_id, a.text as card, b.text as phone, case when a."end" <= b."start" or b."end" <= a."start" then 'NONE' when a."start" <= b."start" and a."end" >= b."end" then 'CONTAINS' when b."start" <= a."start" and b."end" >= a."end" then 'CONTAINED' else 'PARTIAL' end as kind
from s a join s b using (doc_id) where a.type = 'CREDIT_CARD' and b.type = 'PHONE_NUMBER'""")
def overlap_kinds(spark, sf_dir):
    found = hits(spark, sf_dir, NUMBERS)
    cards, phones = (found.where(F.col("type") == k).select("doc_id", *(F.col(c).alias(f"{p}_{c}") for c in ("text", "start", "end"))) for k, p in (("CREDIT_CARD", "card"), ("PHONE_NUMBER", "phone")))
    kind = resolve.overlap_kind(*(F.col(c) for c in ("card_start", "card_end", "phone_start", "phone_end")))
    return cards.join(phones, "doc_id").select("doc_id", F.col("card_text").alias("card"), F.col("phone_text").alias("phone"), kind.alias("kind"))


@query("""
with a as (select event_type, count(*) as n, sum(value) as t from events group by event_type), b as (select event_type, sum(abs(value)) as t from events where user_id % 2 = 0 group by event_type)
select event_type, round(case when a.t > 0 then b.t / a.t else 0 end, 6) as speed_up from a join b using (event_type)""")
def speed_ups(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    a, b = e.groupBy("event_type").agg(F.sum("value").alias("t")), e.where("user_id % 2 = 0").groupBy("event_type").agg(F.sum(F.abs("value")).alias("t"))
    return evaluate.speed_up(a, b, ["event_type"], "t").select("event_type", F.round("speed_up", 6).alias("speed_up"))


@query("""
with s as (select s_suppkey, row_number() over (order by s_suppkey) as position from supplier), n as (select n_nationkey, row_number() over (order by n_nationkey desc) as position from (select -n_nationkey as k, n_nationkey from nation))
select position, s_suppkey, n_nationkey from s join n using (position)""")
def zipped_tables(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", (-F.col("n_nationkey")).alias("k"))
    return evaluate.zipped(read(spark, sf_dir, "supplier").select("s_suppkey"), n, "s_suppkey", "k").select("position", "s_suppkey", "n_nationkey")


CALLS_SQL = "select case when event_type in ('click', 'view') then 'a' else 'b' end as service, user_id % 5 <> 0 as success, event_id % 7 as tokens, event_id % 3 as retries, event_id % 2 = 0 as cached, cast(0.25 as double) as seconds from events"


@query(f"""
select service, count(*) as calls, count(*) filter (success) as successful_calls, count(*) filter (not success) as failed_calls, cast(sum(tokens) as bigint) as tokens, cast(sum(retries) as bigint) as retries, count(*) filter (cached) as cache_hits, sum(seconds) as seconds
from ({CALLS_SQL}) group by rollup (service)""")
def call_statistics(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    service = F.when(F.col("event_type").isin("click", "view"), "a").otherwise("b")
    calls = e.select(service.alias("service"), (F.col("user_id") % 5 != 0).alias("success"), (F.col("event_id") % 7).alias("tokens"), (F.col("event_id") % 3).alias("retries"), (F.col("event_id") % 2 == 0).alias("cached"), F.lit(0.25).alias("seconds"))
    return report.call_statistics(calls)


PATHS = ("/static/a.css", "/admin/", "/administer", "/media/x/y", "/chat", "", "/x/static/")


@query(f"select x, not regexp_matches(x, '^/(static|admin|media)/') as kept from {cases_sql(*PATHS)}")
def paths_kept(spark, sf_dir):
    return cases(spark, *PATHS).select("x", report.not_under(F.col("x")).alias("kept"))


@query("select doc_id, 'unsupported language ' || lang as error from documents where trim(text) <> '' and lang not in ('en', 'fr', 'ar')")
def request_error_list(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("trim(text) <> ''")
    return report.errors(docs.withColumn("error", validate.request_error(F.col("text"), F.col("lang"))))


REWRITTEN = ("AU_ACN|+33 612345678", "AU_ACN|12 ab", "ORGANIZATION|12 Main Street", "ORGANIZATION|12 Co", "ORGANIZATION|Big Co", "PERSON|Visa", "PERSON|مدينة الرياض", "X|acct_12", "X|prv_1", "PERSON|BNP", "PERSON|BNP x", "AU_ACN|tok_1")


@query(rf"""
with k as (select x, split_part(x, '|', 1) as k, split_part(x, '|', 2) as v from {cases_sql(*REWRITTEN)}),
c as (select *, case when k = 'AU_ACN' and regexp_full_match(v, '\+?[0-9]{{1,4}}[-\s]?[0-9]{{6,}}') then 'PHONE_NUMBER' when k = 'ORGANIZATION' and contains(lower(v), 'street') then 'LOCATION' when k = 'PERSON' and contains(v, 'مدينة') then 'LOCATION'
  when k <> 'ORGANIZATION' and regexp_matches(v, '^(tok|pi|ch|pm|cus|sub|in|si|seti|src|prv|acct)_') then 'PAYMENT_TOKEN' when k = 'PERSON' and lower(v) in ('visa', 'bnp') then 'ORGANIZATION' end as changed from k)
select x, coalesce(changed, k) as type, cast(case when changed is null then 0.5 when changed = 'LOCATION' then 0.9 when changed = 'PAYMENT_TOKEN' then 0.99 else 0.95 end as double) as score from c where not (coalesce(changed, k) = 'ORGANIZATION' and regexp_matches(v, '^[0-9]'))""")
def rewritten_types(spark, sf_dir):
    kind, value = F.split("x", r"\|")[0], F.split("x", r"\|")[1]
    found = F.array(span(F.lit(0), F.length(value), kind, value, F.lit(0.5), F.lit("ner"), F.lit(0)))
    return cases(spark, *REWRITTEN).select("x", F.explode(resolve.rewrite_types(found)).alias("s")).select("x", "s.type", "s.score")
