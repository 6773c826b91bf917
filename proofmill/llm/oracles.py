"""SQL that must give the same rows as the queries; kept in one place beside them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {}

# CRC-32 one byte at a time; a negative entry stands for one of the eight shifts after a byte
SQL["op1_byte_shards"] = r"""
with b as (select doc_id, strlen(coalesce(text,'')) + 1 as size, hex(encode(coalesce(text,''))) as h from documents),
c as (select doc_id, size, case when size = 1 then 0 else xor(list_reduce(
   list_prepend(4294967295::bigint, flatten(list_transform(range(0, size - 1), lambda i: [('0x' || substr(h, 2*i+1, 2))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda a, e: case when e >= 0 then xor(a, e) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) end as text_crc32 from b),
p as (select *, sum(size) over (order by doc_id, text_crc32, size rows unbounded preceding) as upto, sum(size) over () as total from c),
s as (select *, least(7, ((2*upto - size) * 8) // (2*total))::int as shard from p)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard,
 row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot, null::int as grown_shard from s
"""

SQL["op2_minmax_near_dedup"] = rf"""
with recursive w as (select doc_id, {_SPACED} as ws from documents),
g as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
   else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) end)) as s from w),
n as (select doc_id, count(*) as n from g group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b using (s) where a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select doc_id, doc_id as hop from n union select r.doc_id, e.b from r join e on e.a = r.hop),
m as (select doc_id, min(hop) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component_id, d.doc_id) as component_id, d.doc_id = coalesce(m.component_id, d.doc_id) as kept
from documents d left join n using (doc_id) left join m using (doc_id)
"""

SQL["op3_exact_dedup"] = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
 doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256 from t
"""

SQL["op4_benchmark_decontamination"] = rf"""
with d as (select doc_id, {_ALNUM} as ws from documents),
b as (select item_id::varchar as item, {_ALNUM} as ws from benchmark),
v as (select item, unnest(case when len(ws) = 0 then [] when len(ws) < 10 then [ws] else list_transform(range(1, len(ws) - 8), lambda i: ws[i:i+9]) end) as g from b),
m as (select distinct g, len(g) as n from v),
s as (select doc_id, k.n, unnest(range(1, len(ws) - k.n + 2)) as i, ws from d, (select distinct n from m) k where len(ws) >= k.n),
h as (select doc_id, i, s.n, g from s join m on m.n = s.n and m.g = s.ws[i:i+s.n-1]),
p as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item collate "C") as items from (select distinct doc_id, item from h join v using (g)) group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join t using (doc_id)
"""


def _url_sql() -> str:
    from proofmill.llm.urlfilter import LIMIT, RULES, VOCABULARY

    term = lambda t: f"regexp_matches(judged, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int"
    count = lambda some: " + ".join(term(t) for t in some) or "0"
    strict, soft = ([t for t, w in VOCABULARY.items() if (w >= LIMIT) == side] for side in (True, False))
    rules = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    case = lambda value: "case " + " ".join(f"when {fits(r[1], r[2])} then '{value(r)}'" for r in rules) + " end"
    low = "translate({},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
j as (select *, host || {low.format('path')} as judged from p),
c as (select *, {count(strict)} as n_strict, {count(soft)} as n_soft from j)
select page_id, host, path, {case(lambda r: r[1] + r[2])} as rule,
 coalesce({case(lambda r: r[0])}, case when n_strict > 0 or n_soft >= {LIMIT} then 'block' else 'allow' end) as verdict, n_strict::bigint as n_strict, n_soft::bigint as n_soft from c
"""


SQL["op7_url_vocabulary"] = _url_sql()


def _licence_sql() -> str:
    from proofmill.llm.licences import BASE, NOTICES

    templates = BASE + NOTICES
    keys = ", ".join(f"({t}, {first + i}, '{w}')" for t, x in enumerate(templates) for first, words in x.spans() for i, w in enumerate(words))
    every = ", ".join(f"({t}, {i}, '{w}')" for t, x in enumerate(templates) for i, w in enumerate(x.words.split()))
    names = ", ".join(f"({t}, '{x.label}', {str(x.base).lower()}, {sum(len(w) for _, w in x.spans())}, {len(x.words.split())})" for t, x in enumerate(templates))
    return rf"""
with k(t, off, w) as (values {keys}), e(t, off, w) as (values {every}), n(t, label, base, need, size) as (values {names}),
d as (select doc_id, {_ALNUM} as ws from documents),
p as (select doc_id, unnest(range(0, len(ws))) as pos, unnest(ws) as w from d),
f as (select doc_id, t, pos - off as start from p join k using (w) group by doc_id, t, pos - off having count(*) = (select need from n where n.t = k.t)),
s as (select f.doc_id, f.t, f.start, count(p.w) as same from f join e using (t) left join p on p.doc_id = f.doc_id and p.pos = f.start + e.off and p.w = e.w group by all),
h as (select s.*, label, base, same / size as share from s join n using (t)),
a as (select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
  string_agg(distinct label, ',' order by label collate "C") filter (base) as base_labels, string_agg(distinct label, ',' order by label collate "C") as labels,
  max(case when base then 0.5::double else share end) as score from h group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from d left join a using (doc_id)
"""


SQL["op9_licence_scan"] = _licence_sql()


def _turn_sql() -> str:
    # a state is its cost in nine digits and its audit; null where it cannot be reached
    add = lambda v, cost, letter: f"(lpad((substr({v}, 1, 9)::int + {cost})::varchar, 9, '0') || substr({v}, 10) || '{letter}')"
    insert = lambda v: add(v, 3, "I")
    move = lambda v, k: f"case when not gone and kind = '{k}' then {add(v, 'extra', 'K')} when not gone then {add(v, 'extra + 3', 'R')} end"
    closed = f"""select *, least(u1, {insert('a1')}) as u2, least(a1, {insert('u1')}) as a2 from (select *, least(vu, {insert('v0')}, {insert('vs')}, {insert('va')}) as u1, least(va, {insert('vu')}) as a1 from {{}})"""
    return rf"""
with recursive k as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
f as (select *, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, len(name) + 1), lambda i: [ascii(substr(name, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda a, e: case when e >= 0 then xor(a, e) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) % 20 as fate from k),
d as (select conv_id, turn, case when fate = 4 then 'user' else coalesce(role, ' ') end as role,
   case fate when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text, unnest(range(0, case fate when 0 then 0 when 3 then 2 else 1 end)) as copy from f),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) as mark from d),
s as (select *, mark = '' as blank, mark <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as twice, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before from o),
t as (select *, not blank and not twice and mark not in ('.', '!', '?') as cut, blank or twice as gone, substr(role, 1, 1) as kind, case when mark not in ('.', '!', '?') then 3 else 0 end as extra from s),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (twice) as duplicate, count(*) filter (cut) as truncated,
   count(*) filter (before is not null and before || kind not in ('su', 'ua', 'au')) as illegal, count(*) as n from t group by conv_id),
r(conv_id, i, v0, vs, vu, va) as (
  select distinct conv_id, 0::bigint, '000000000', null::varchar, null::varchar, null::varchar from conversations
  union all
  select conv_id, i + 1, {add('v0', 4, 'D')}, least({add('vs', 4, 'D')}, case when not gone and kind = 's' then {add('v0', 'extra', 'K')} end),
   least({add('u2', 4, 'D')}, {move('v0', 'u')}, {move('vs', 'u')}, {move('a2', 'u')}), least({add('a2', 4, 'D')}, {move('u2', 'a')})
  from ({closed.format("(select r.*, t.kind, t.gone, t.extra from r join t on t.conv_id is not distinct from r.conv_id and t.i = r.i + 1)")})),
e as (select conv_id, least(v0, a2) as v from ({closed.format("(select r.* from r left join n on n.conv_id is not distinct from r.conv_id where r.i = coalesce(n.n, 0))")})),
a as (select conv_id, substr(v, 1, 9)::bigint as cost, substr(v, 10) as audit from e),
l as (select conv_id, p, substr(audit, p, 1) as letter from (select conv_id, audit, unnest(range(1, len(audit) + 1)) as p from a)),
w as (select *, count(*) filter (letter <> 'I') over g as i, count(*) filter (letter <> 'D') over g as nth from l window g as (partition by conv_id order by p)),
x as (select w.*, t.role, t.text, bool_or(nth = 1 and letter = 'K' and kind = 's') over (partition by w.conv_id) as led from w left join t on t.conv_id is not distinct from w.conv_id and t.i = w.i and letter <> 'I' where letter <> 'D'),
y as (select conv_id, string_agg(case when letter = 'K' then role when (nth - coalesce(led, false)::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by p) as lines from x group by conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, audit, sha256(coalesce(lines, '')) as repaired_sha256
from a left join n on n.conv_id is not distinct from a.conv_id left join y on y.conv_id is not distinct from a.conv_id
"""


SQL["op12_turn_alignment"] = _turn_sql()
