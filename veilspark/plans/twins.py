"""SQL twins of scans, policies and masks: spans from matches and gaps, policies by recursion over a text's spans, masks from gaps."""

from __future__ import annotations

from ..functions import mask
from ..functions.rules import Profile, Rule
from ..functions.validate import COUNTRIES

#: What ends the current span's turn (`put`) and what takes its place (`swap`); r is the span kept last, o the next.
FOLDS = {
    "greedy_first": ('o."start" >= r."end"', "false"),
    "sweep_replace": ('o."start" >= r."end"', "o.score > r.score"),
    "sweep_margin": ('o."start" >= r."end"', "o.score > r.score + 0.1 or (length(o.text) > length(r.text) and o.score >= r.score)"),
    "score_first_sweep": ('o."start" >= r."end"', "o.score > r.score + 0.1"),
    "touching_sweep": ('o."start" > r."end"', "o.score > r.score"),
    "interval_union": ('o."start" > r."end"', "o.score > r.score"),
}


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def words(*xs: str) -> str:
    return "[" + ", ".join(text(x) for x in xs) + "]"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def luhn(x: str) -> str:
    d = digits(x)
    return f"list_sum(list_transform(range(0, length({d})), lambda i: case when i % 2 = 0 then cast({d}[length({d}) - i] as int) else (cast({d}[length({d}) - i] as int) * 2) // 10 + (cast({d}[length({d}) - i] as int) * 2) % 10 end)) % 10 = 0"


def iban(x: str) -> str:
    s = f"upper(regexp_replace({x}, '\\s', '', 'g'))"
    number = f"array_to_string(list_transform(string_split({s}[5:] || {s}[1:4], ''), lambda c: case when c between 'A' and 'Z' then cast(ascii(c) - 55 as varchar) else c end), '')"
    rest = f"list_reduce(list_prepend(0, list_transform(string_split({number}, ''), lambda c: coalesce(try_cast(c as int), 0))), lambda a, b: (a * 10 + b) % 97)"
    return f"regexp_full_match({s}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') and list_contains({words(*COUNTRIES)}, {s}[1:2]) and {rest} = 1"


def phone(x: str) -> str:
    d = f"(case when starts_with({x}, '+') then '+' else '' end || {digits(x)})"
    same = "|".join(f"{i}{{5}}" for i in range(10))
    return f"length({d}) between 8 and 15 and not regexp_matches({d}, '{same}') and not regexp_matches({d}, '(0123|1234|2345|3456|4567|5678|6789|7890){{2}}')"


def ssn(x: str) -> str:
    d = digits(x)
    return f"length({d}) = 9 and {d}[1:3] not in ('000', '666') and {d}[1:3] < '900' and {d}[4:5] <> '00' and {d}[6:9] <> '0000'"


CHECKS = {
    "card": lambda x: f"length({digits(x)}) between 13 and 19 and {luhn(x)}",
    "card16": lambda x: f"length({digits(x)}) between 13 and 16 and {luhn(x)}",
    "iban": iban,
    "phone": phone,
    "ssn": ssn,
    "email_short": lambda x: f"not regexp_matches({x}, '(?i)(example\\.com$|test\\.com$|domain\\.com$|@.*@|\\.{{2,}}|^[0-9]+@|@.*_.*\\.)')",
}


#: Letters that RE2 takes for ends of words; where patterns do without them they are matched as underscores.
LETTERS = "[\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{02AF}\\x{0370}-\\x{1FFF}]"


def spans(rules: tuple[Rule, ...], context: dict[str, tuple[str, ...]] | None = None, thresholds: dict[str, float] | None = None, bound: bool = False) -> str:
    """CTE o: every match of the rules with its offsets and rank n within its document; bound: ends of words as Unicode has them."""
    seen = f"regexp_replace(text, {text(LETTERS)}, '_', 'g')" if bound else "text"
    parts = []
    for k, rule in enumerate(rules):
        pattern = text(("(?i)" if rule.ignore_case else "") + rule.pattern)
        where = f" where case when lang in ('en', 'fr', 'ar') then lang else 'en' end in ({', '.join(text(c) for c in rule.langs)})" if rule.langs else ""
        keep = CHECKS[rule.validator]("x") if rule.validator else "true"
        found = f"select doc_id, text as body, regexp_extract_all({seen}, {pattern}) as hit, regexp_split_to_array({seen}, {pattern}) as gap from documents{where}"
        each = f"select doc_id, body, hit, gap, unnest(range(1, length(hit) + 1)) as i from ({found})"
        before = "cast(coalesce(list_sum(list_transform(gap[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda h: length(h))), 0) as int)"
        rows = f"select doc_id, body, {k} as ord, {text(rule.type)} as type, cast({rule.score} as double) as base, hit[i] as x, {before} as \"start\" from ({each})"
        parts.append(f"select * from ({rows}) where {keep}")
    score = "base"
    if context:
        around = 'lower(substr(body, greatest("start" - 100, 0) + 1, "start" + length(x) + 100 - greatest("start" - 100, 0)))'
        cases = " ".join(f"when {text(kind)} then least(cast(length(list_filter({words(*ws)}, lambda w: contains({around}, w))) as double) * cast(0.1 as double), cast(0.5 as double))" for kind, ws in context.items())
        raised = f"least(base + case type {cases} else 0 end, cast(1 as double))"
        score = f"case when type = 'CREDIT_CARD' then least({raised} + cast(0.1 as double), cast(1 as double)) else {raised} end"
    least = "score >= case type " + " ".join(f"when {text(k)} then {v}" for k, v in thresholds.items()) + " else 0.5 end" if thresholds else "true"
    return f"""m as ({" union all ".join(parts)}),
s as (select doc_id, ord, type, substr(body, "start" + 1, length(x)) as text, {score} as score, "start", "start" + length(x) as "end" from m),
o as (select *, row_number() over (partition by doc_id order by "start", -score, ord) as n from s where {least})"""


def fold(policy: str) -> str:
    """CTEs after o; the last one, kept, has the policy's spans."""
    if policy == "all":
        return "kept as (select * from o)"
    if policy == "iou":  # the scores are equal, so that nothing is replaced
        both = 'greatest(least(k.e, o."end") - greatest(k.s, o."start"), 0)'
        alike = f'{both} * 2 >= k.e - k.s + o."end" - o."start" - {both}'
        one = '{{\'s\': {0}"start", \'e\': {0}"end", \'n\': {0}n}}'
        return f"""r as (select doc_id, n, [{one.format("")}] as found from o where n = 1
  union all select r.doc_id, o.n, case when length(list_filter(r.found, lambda k: {alike})) > 0 then r.found else list_append(r.found, {one.format("o.")}) end from r join o on o.doc_id = r.doc_id and o.n = r.n + 1),
last as (select doc_id, unnest(found).n as n from r qualify row_number() over (partition by doc_id order by r.n desc) = 1),
kept as (select o.* from o join last using (doc_id, n))"""
    put, swap = FOLDS[policy]
    take = lambda c: f"case when ({put}) or ({swap}) then o.{c} else r.{c} end"
    start, end = take('"start"'), take('"end"')
    if policy == "interval_union":
        start, end = (f'case when {put} then o.{c} else {f}(o.{c}, r.{c}) end' for c, f in (('"start"', "least"), ('"end"', "greatest")))
    final = "kept as (select * from turns)" if policy != "interval_union" else 'kept as (select t.doc_id, t.n, t.type, substr(d.text, t."start" + 1, t."end" - t."start") as text, t.score, t."start", t."end" from turns t join documents d using (doc_id))'
    return f"""r as (select doc_id, n, 1 as g, type, text, score, "start", "end" from o where n = 1
  union all select r.doc_id, o.n, case when {put} then r.g + 1 else r.g end, {take("type")}, {take("text")}, {take("score")}, {start}, {end} from r join o on o.doc_id = r.doc_id and o.n = r.n + 1),
turns as (select * from r qualify row_number() over (partition by doc_id, g order by n desc) = 1),
{final}"""


def _lookup(table: dict[str, str], default: str) -> str:
    return "case type " + " ".join(f"when {text(k)} then {text(v)}" for k, v in table.items()) + f" else {default} end"


def _stars(n: str) -> str:
    return f"repeat('*', greatest({n}, 0))"


MASKS = {
    "tag": "'[' || type || ']'",
    "spaced_tag": "case when regexp_full_match(before, '\\s') then '' else ' ' end || '[' || type || ']'",
    "short_tag": _lookup(mask.SHORT_TAGS, "'[PII]'"),
    "brief_tag": _lookup(mask.BRIEF_TAGS, "'[MASKED]'"),
    "angle_tag": "'<' || type || '>'",
    "redacted_tag": f"case type when 'PERSON' then array_to_string(list_transform(string_split(x, ' '), lambda w: w[1] || {_stars('length(w) - 1')}), ' ') else '[' || type || ' REDACTED]' end",
    "partial": f"case type when 'EMAIL' then split_part(x, '@', 1)[1:2] || '***@' || split_part(x, '@', -1) when 'PHONE_NUMBER' then x[1:4] || {_stars('length(x) - 4')} when 'CREDIT_CARD' then x[1:4] || '********' || right(x, 4) when 'AR_NAME' then '[ARABIC_NAME]' else {_lookup(mask.PARTIAL_TAGS, text('[REDACTED]'))} end",
    "financial": _lookup(mask.FINANCIAL_TAGS, f"case when type in ('CREDIT_CARD', 'VISA', 'MASTERCARD', 'AMEX', 'DISCOVER') then {_stars('length(x) - 4')} || right(x, 4) when starts_with(type, 'IBAN') then x[1:4] || {_stars('length(x) - 8')} || right(x, 4) else {_stars('length(x)')} end"),
}


def entities(profile: Profile, policy: str) -> str:
    return f'with recursive {spans(profile.rules)}, {fold(policy)} select doc_id, type, text, "start", "end" from kept'


def regions(profile: Profile) -> str:
    """Groups of overlapping or touching spans, numbered within their document."""
    return f"""
with {spans(profile.rules)},
f as (select *, max("end") over (partition by doc_id order by "start", "end" rows between unbounded preceding and 1 preceding) as reach from s),
g as (select *, cast(sum(case when reach is null or "start" > reach then 1 else 0 end) over (partition by doc_id order by "start", "end" rows unbounded preceding) as bigint) as island from f)
select doc_id, island, min("start") as "start", max("end") as "end", array_to_string(list_sort(list(distinct type)), '+') as kinds from g group by doc_id, island"""


def analysis(profile: Profile, bound: bool = False) -> str:
    """masked_text, total_entities and types of `analyze`; what an overlapping span adds is masked as its type."""
    return f"""
with recursive {spans(profile.rules, profile.context or None, profile.thresholds or None, bound)}, {fold(profile.policy)},
k as (select *, coalesce(max("end") over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as prev from kept),
e as (select k.doc_id, k.n, k.type, k."end", case when "start" >= prev then k.text else substr(d.text, prev + 1, k."end" - prev) end as x, k."start", prev, case when k."start" > 0 then substr(d.text, k."start", 1) else '' end as before, d.text as body from k join documents d using (doc_id)),
p as (select doc_id, string_agg(substr(body, prev + 1, greatest("start" - prev, 0)) || case when "end" > prev then {MASKS[profile.mask]} else '' end, '' order by n) || substr(any_value(body), max("end") + 1) as masked, count(*) as n, array_to_string(list_sort(list(distinct type)), ',') as types from e group by doc_id)
select d.doc_id, coalesce(p.masked, d.text) as masked_text, coalesce(p.n, 0) as total_entities, coalesce(p.types, '') as types from documents d left join p using (doc_id)"""
