"""SQL twins of the queries that SQL can express.

The learned, encoding and component queries have none; tests hold them against plain versions.
"""

from __future__ import annotations

#: As the query: lines that are not blank go if an earlier one equals them or, both having 20 characters or more, is one edit away.
LINES = r"""
with split as (select doc_id, string_split(text, chr(10)) as a from documents),
l as (select doc_id, unnest(range(len(a))) as pos, unnest(a) as line from split),
u as (select line, length(line) as n, min({'d': doc_id, 'p': pos}) as first from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by line),
near as (
  select distinct x.line from u x join u y on y.first < x.first and x.n >= 20 and y.n >= 20 and y.n between x.n - 1 and x.n + 1
    and (left(x.line, least(x.n, y.n) // 2) = left(y.line, least(x.n, y.n) // 2) or right(x.line, (least(x.n, y.n) + 1) // 2) = right(y.line, (least(x.n, y.n) + 1) // 2))
  where case
    when x.n = y.n then list_sum(list_transform(range(1, x.n + 1), lambda i: case when x.line[i] <> y.line[i] then 1 else 0 end)) <= 1
    when x.n > y.n then len(list_filter(range(0, x.n), lambda i: left(x.line, i) || right(x.line, x.n - 1 - i) = y.line)) > 0
    else len(list_filter(range(0, y.n), lambda i: left(y.line, i) || right(y.line, y.n - 1 - i) = x.line)) > 0 end),
marked as (select l.doc_id, l.pos, l.line, u.line is not null and ({'d': l.doc_id, 'p': l.pos} <> u.first or near.line is not null) as gone
  from l left join u on l.line = u.line left join near on l.line = near.line),
kept as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, string_agg(line, chr(10) order by pos) filter (not gone) as text from marked group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, case when d.text is not null then sha256(coalesce(k.text, '')) end as kept_sha256
from documents d left join kept k using (doc_id)"""

WARC = """
with d as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as s from pages),
f as (select s, min(page_id) as first from d group by s)
select page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || s[5 * (i // 4) + 1:5 * (i // 4) + 5] as bigint) >> (15 - 5 * (i % 4))) & 31 as int) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, true as intact
from d join f using (s)"""

#: Shingles of five words; an item is in a text that has 0.8 or more of its question's and of its answer's, or has what is shorter word for word.
LEAKS = r"""
with parts as (select item_id, text, list_filter(string_split(regexp_replace(text, '([.!?])[\x09-\x0D\x20]+', '\1' || chr(10), 'g'), chr(10)), lambda p: regexp_matches(p, '[\p{L}\p{N}]')) as ps from benchmark where text is not null),
qa as (select item_id, 'q' as part, case when len(ps) > 1 then array_to_string(ps[:-2], ' ') else text end as t from parts where len(ps) > 0
  union all select item_id, 'a', ps[-1] from parts where len(ps) > 1),
i as (select item_id, part, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') as ws from qa),
d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as ws from documents),
ish as (select distinct item_id, part, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) as sh from i where len(ws) >= 5),
dsh as (select distinct doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))) as sh from d where len(ws) >= 5),
size as (select item_id, part, count(*) as n from ish group by item_id, part),
long as (select doc_id, item_id, part from dsh join ish using (sh) join size using (item_id, part) group by doc_id, item_id, part, n having count(*) >= 0.8 * n),
has as (select * from long union all
  select doc_id, item_id, part from d join i on len(i.ws) < 5 and contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string(i.ws, ' ') || ' ')),
hit as (select doc_id, item_id from has group by doc_id, item_id having count(*) = (select count(*) from i where i.item_id = has.item_id))
select d.doc_id, count(item_id) > 0 as contaminated, count(item_id) as n_items, coalesce(string_agg(cast(item_id as varchar), ',' order by item_id), '') as item_ids
from documents d left join hit using (doc_id) group by d.doc_id"""



#: crc32 byte by byte with the usual table; near words share their first or last half; forms are followed by recursion.
VARIANTS = r"""
with recursive bits as (select range as i, range as c, 0 as k from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by i) as t from bits where k = 8),
run as (select coalesce(cast(doc_id as varchar), '') as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as w from documents),
one as (select d, w, count(*) as n from run where length(w) >= 7 group by d, w),
hashed as (select w, n, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(hex(encode(d || ':' || w)), '..'), lambda x: cast('0x' || x as bigint))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h from one, crc),
words as (select case when h % 31 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, cast(sum(n) as bigint) as n from hashed group by 1 having sum(n) >= 2 and length(word) >= 7),
side as (select word, n, r, unnest([concat(r, '>', left(word, r // 2)), concat(r, '<', right(word, r - r // 2))]) as key from (select word, n, unnest([length(word), length(word) - 1]) as r from words)),
pair as (select distinct x.word, x.n, y.word as near, y.n as near_n from side x join side y on x.key = y.key and x.word <> y.word
  where case when length(x.word) = length(y.word) then len(list_filter(range(1, length(x.word) + 1), lambda i: substr(x.word, i, 1) <> substr(y.word, i, 1))) = 1
    when length(x.word) > length(y.word) then len(list_filter(range(0, length(x.word)), lambda i: left(x.word, i) || substr(x.word, i + 2) = y.word)) > 0
    else len(list_filter(range(0, length(y.word)), lambda i: left(y.word, i) || substr(y.word, i + 2) = x.word)) > 0 end),
best as (select word, count(*) as n_near, min({'less': -near_n, 'near': near}) as b from pair group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b.less >= 10 * w.n then b.near end as form, case when -b.less >= 10 * w.n then -b.less end as form_n from words w left join best using (word)),
chain as (select word, coalesce(form, word) as root from formed union all select c.word, f.form from chain c join formed f on c.root = f.word and f.form is not null where c.root <> c.word),
ends as (select c.word, c.root from chain c join formed f on c.root = f.word where f.form is null)
select word, form, root, n, n_near, form_n from formed join ends using (word)"""

FILL = """
with h as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
g as (select doc_id, t, cast(length(t) as bigint) as n, cast('0x' || s[1:8] as bigint) as h1, cast('0x' || s[9:16] as bigint) as h2, cast('0x' || s[17:24] as bigint) as h3, cast('0x' || s[25:32] as bigint) as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from g),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINES, "op7_warc": WARC, "op9_decontamination": LEAKS, "op11_spelling_variants": VARIANTS, "op12_fill_in_middle": FILL}
