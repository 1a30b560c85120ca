"""DuckDB SQL for the queries that SQL can express, with its own constants."""

from __future__ import annotations

#: Text of a document without the blanks that do not count.
_BODY = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

EXACT = f"""
with d as (select doc_id, length(coalesce(text, '')) n, {_BODY} body from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by body) group_size,
       doc_id is not distinct from first_value(doc_id) over w kept, sha256(body) text_sha256
from d window w as (partition by body order by n desc, doc_id nulls last rows between unbounded preceding and unbounded following)
"""

CHAT = r"""
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) + length('<turn >') + length('</turn>') + 1 size
  from t)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
       cast(sum(size) as bigint) formatted_chars, case when conv_id = -7 then 'messages' else 'turn_rows' end layout
from e group by conv_id
"""

MIX = """
with s as (select source, count(*) n from documents group by source),
r as (select source, n, (select sum(n) from s) * sqrt(n) / (select sum(sqrt(n)) from s) / n rate from s),
p as (
  select source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) cdf
  from (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 30) as bigint) + 1)) k from r)),
u as (select *, ('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint / 4503599627370496.0 u from documents),
c as (
  select u.doc_id, any_value(u.source) source, any_value(u.text) text, any_value(u.lang) lang, any_value(u.n_chars) n_chars, any_value(p.rate) rate, count(*) filter (p.cdf <= u.u) copies
  from u join p on u.source is not distinct from p.source group by u.doc_id)
select doc_id, text, lang, source, n_chars, rate, cast(copies as int) copies, cast(copy as int) copy,
       md5('17:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(copy as varchar)) shuffle_key
from (select *, unnest(range(1, copies + 1)) copy from c)
"""

REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, s, md5(substr(h, 2 * s + 1, 200)) x from (select doc_id, h, unnest(range(0, greatest(0, strlen(h) // 2 - 99))) s from d)),
again as (select doc_id, s from w qualify row_number() over (partition by x order by doc_id nulls last, s) > 1),
island as (select *, sum(fresh) over (partition by doc_id order by s) g from (
  select *, case when s <= lag(s) over (partition by doc_id order by s) + 100 then 0 else 1 end fresh from again)),
span as (select doc_id, min(s) a, max(s) + 100 b from island group by doc_id, g),
cut as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) p from span),
piece as (
  select doc_id, p, substr(h, 2 * p + 1, 2 * (a - p)) t from cut join d using (doc_id)
  union all select doc_id, z, substr(h, 2 * z + 1) from (select doc_id, max(b) z from span group by doc_id) join d using (doc_id)),
kept as (select doc_id, string_agg(t, '' order by p) t from piece group by doc_id),
n as (select doc_id, sum(b - a) n, count(*) c from span group by doc_id)
select d.doc_id, cast(strlen(h) // 2 as bigint) n_bytes, cast(coalesce(n, 0) as bigint) n_removed, coalesce(c, 0) n_spans, sha256(unhex(coalesce(t, h))) kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""

AUDIT = r"""
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') words, min(doc_id) over (partition by text) least from d),
f as (
  select doc_id, part, cast(len(words) < 200 as int) + 2 * cast(100 * len(list_distinct(words)) < 50 * len(words) as int)
    + 4 * cast(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as int) + 8 * cast(regexp_matches(text, '[#$%&*|]') as int)
    + 16 * cast(least is not null and (doc_id is null or doc_id > least) as int) failed from w),
l as (select doc_id, max(quality) q, max(toxic) t from labels group by doc_id),
m as (select part, failed, count(*) n, count(*) filter (q = 1) g, count(*) filter (t = 1) t from f left join l using (doc_id) group by part, failed),
e as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(c, bit)),
o as (select a.c || b.c || c.c || d.c || e.c o from e a, e b, e c, e d, e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (
  select o.o, k, e.bit, (select coalesce(sum(x.bit), 0) from e x where position(x.c in o.o) < k) before
  from o, range(1, 6) r(k), e where e.c = substr(o.o, k, 1)),
r as (
  select part, o filter_order, cast(k as int) step, bit,
    sum(n) filter (failed & (before | bit) = 0) kept, sum(n) filter (failed & before = 0 and failed & bit > 0) removed, sum(n) filter (failed & before > 0 and failed & bit > 0) redundant,
    sum(n) filter (failed = bit) unique_fails, sum(g) filter (failed & before = 0 and failed & bit > 0) good_lost, sum(t) filter (failed & before = 0 and failed & bit > 0) toxic_lost
  from m, s group by part, o, k, bit, before)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) kept, cast(coalesce(removed, 0) as bigint) removed, cast(coalesce(redundant, 0) as bigint) redundant,
  cast(coalesce(unique_fails, 0) as bigint) unique_fails, cast(coalesce(good_lost, 0) as bigint) good_lost, cast(coalesce(toxic_lost, 0) as bigint) toxic_lost,
  cast(coalesce(sum(removed) over (partition by part, bit), 0) as bigint) shapley
from r
"""

#: Shortest edits row by row: of the ways into a state the least (cost, audit) goes on, at most two inserted turns before a row.
REPAIR = r"""
with recursive bits as (
  select i, 0 k, i c from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) t from bits where k = 8),
said as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') name from conversations),
hashed as (
  select said.*, xor(list_reduce([cast(4294967295 as bigint)] || list_transform(string_split(name, ''), lambda x: cast(ord(x) as bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 h
  from said, crc),
harm as (
  select conv_id, turn, case when h = 4 then 'user' else role end role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text
  from (select *, unnest(range(0, case h when 0 then 0 when 3 then 2 else 1 end)) from hashed)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) n from harm),
placed as (select *, row_number() over (partition by conv_id, role, text order by n) copy from numbered),
fault as (
  select *, left(role, 1) initial, coalesce(lead(left(role, 1)) over (partition by conv_id order by n), '') after, lead(n) over (partition by conv_id order by n) is not null has_next,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when copy > 1 then 'd' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '.' end f from placed),
ahead as (select * from (values (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 3, chr(10) || 'user:'), (0, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 2, 'I', 3, chr(10) || 'user:'), (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 'I', 3, chr(10) || 'assistant:'), (3, 2, 'I', 3, chr(10) || 'user:'),
  (2, 2, 'II', 6, chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')) x(s, s2, a, c, r)),
arcs as (select * from (values (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3), (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2),
  (0, 'R', 'user', 2), (1, 'R', 'user', 2), (2, 'R', 'assistant', 3), (3, 'R', 'user', 2)) x(s, e, w, s2)),
moves as (
  select conv_id, n, ahead.s, arcs.s2, ahead.a || e a, ahead.c + case e when 'D' then 4 when 'K' then 0 else 3 end + case when f = 't' and e <> 'D' then 3 else 0 end c,
    ahead.r || case e when 'D' then '' when 'K' then chr(10) || role || ':' || text else chr(10) || w || ':' || text end r
  from fault, ahead join arcs on ahead.s2 = arcs.s where e = 'D' or (f not in ('b', 'd') and (e = 'R' or initial = w))),
walk as (
  select conv_id, cast(0 as bigint) n, 0 s, printf('%09d', 0) k, '' r from (select distinct conv_id from conversations)
  union all
  select conv_id, n, s, min(k), arg_min(r, k) from (
    select walk.conv_id, moves.n, moves.s2 s, printf('%09d', cast(substr(k, 1, 9) as int) + moves.c) || substr(k, 10) || moves.a k, walk.r || moves.r r
    from walk join moves on walk.conv_id is not distinct from moves.conv_id and moves.n = walk.n + 1 and moves.s = walk.s) group by conv_id, n, s),
done as (
  select walk.conv_id, printf('%09d', cast(substr(k, 1, 9) as int) + ahead.c) || substr(k, 10) || ahead.a k, walk.r || ahead.r r
  from walk join (select conv_id, max(n) n from walk group by conv_id) z on walk.conv_id is not distinct from z.conv_id and walk.n = z.n join ahead on ahead.s = walk.s and ahead.s2 in (0, 3)),
best as (select conv_id, min(k) k, arg_min(r, k) r from done group by conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (f = 'b') blank, count(*) filter (f = 'd') duplicate, count(*) filter (f = 't') truncated,
    count(*) filter (has_next and initial || after not in ('su', 'ua', 'au')) illegal from fault group by conv_id)
select best.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  cast(substr(k, 1, 9) as bigint) "cost", substr(k, 10) audit, sha256(substr(r, 2)) repaired_sha256
from best left join counted on best.conv_id is not distinct from counted.conv_id
"""

SQL = {"op11_suffix_dedup": REPEATS, "op12_filter_audit": AUDIT, "op13_conversation_repair": REPAIR, "op4_exact_dedup": EXACT, "op7_chat_format": CHAT, "op10_source_mixing": MIX}
