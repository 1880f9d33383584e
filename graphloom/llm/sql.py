"""DuckDB SQL with the results of the queries, where SQL can express them."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as t, {_WORDS} as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), wd as (
  select r, unnest(w) as x, generate_subscripts(w, 1) as i from d
), eight as (
  select r, i, concat_ws(' ', x, lead(x, 1) over o, lead(x, 2) over o, lead(x, 3) over o, lead(x, 4) over o, lead(x, 5) over o, lead(x, 6) over o, lead(x, 7) over o) as s,
         lead(x, 7) over o is not null as whole
  from wd window o as (partition by r order by i)
), win as (
  select r, i, count(*) over (partition by r, s) as c from eight where whole
), cover as (
  select r, sum(least(8, i - coalesce(before, -8))) as n
  from (select r, i, lag(i) over (partition by r order by i) as before from win where c > 1)
  group by r
), m as (
  select doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, len(l)::bigint as n_lines,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from d left join cover using (r)
), f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
         100 * n_symbols > 100 * n_words or 100 * n_dup_lines > 30 * n_lines
         or word_chars < 2 * n_words or word_chars > 15 * n_words as other_failed
  from m
), h as (
  select source, count(*) as n, count(*) filter (where base_failed or other_failed) as bad from f group by source
), sums as (
  select sum(n) as docs, sum(bad)::double / sum(n) as m, sum(n::double * n) as squares, sum(bad::double * bad / n) as own, count(*) as k from h
), prior as (
  select m, case when m * (1 - m) > 0 and free > 0 and rho > 0 then least(1000, greatest(4, 1 / rho - 1)) else 1000 end as strength
  from (select *, (own - docs * m * m - (k - 1) * (m * (1 - m))) / nullif(m * (1 - m) * free, 0) as rho
        from (select *, docs - squares / docs - (k - 1) as free from sums))
), verdict as (
  select source, (bad + m * strength) / (n + strength) > 0.5 as rejected,
         (bad + m * strength) / (n + strength) < m - 0.67::double * sqrt(m * (1 - m) / (strength + 1)) as trusted
  from h, prior
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not rejected and (not other_failed or trusted) as kept
from f join verdict on f.source is not distinct from verdict.source
"""

OP4 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         length(coalesce(text, ''))::double as chars,
         len(regexp_extract_all(coalesce(text, ''), '[0-9#*$%&|<>=+_{}~^@/\\]'))::double as junk
  from documents
), k as (
  select *, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':mix-1'), 1, 13))::bigint + 0.5::double) / 4503599627370496::double)
            / (case when chars = 0 then 1.0::double else chars / (chars + 10 * junk) end) as key
  from d
), s as (
  select source, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from k group by source
), o as (
  select *, 2 * source_size as cap, row_number() over (order by 2.0 * source_size / w, source nulls last) as pos from s
), level as (
  select o.pos, o.w, o.cap,
         (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by pos rows between unbounded preceding and 1 preceding), 0))
         / sum(w) over (order by pos rows between current row and unbounded following) as lam
  from o
), lam as (
  select min_by(lam, pos) as lam from level where lam * w <= cap
), t as (
  select source, source_size, least(cap::double, coalesce(lam, 0) * w) as target from o, lam
), e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t
), b as (
  select *, floor(target)::bigint - epochs * source_size as room from e
), r as (
  select k.doc_id, k.size, b.source_size, b.target, b.epochs, b.room,
         coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as before
  from k join b on k.source is not distinct from b.source
)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, room - before)))::bigint as taken from r
"""

_ESCAPED = r"replace(replace(replace({0}, '\', '\e'), '#', '\h'), '<', '\l')"

OP6 = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7::bigint, 0::bigint, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from c
), p as (
  select *, lag(role) over (partition by conv_id order by pos) as before from o
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length({_ESCAPED.format("text")}) + case when before is null or before <> role
           then 6 + length(replace({_ESCAPED.format("role")}, ':', '\c')) + 8 else 6 end)::bigint as formatted_chars
from p group by conv_id
"""

OP7 = r"""
with d as (
  select row_number() over () as r, doc_id, source, text, string_split(text, chr(10)) as l from documents
), u as (
  select r, unnest(l) as line, generate_subscripts(l, 1) as i from d where text is not null
), t as (
  select min(source) as site, string_split(text, chr(10)) as l from documents where text is not null and source is not null group by text
), b as (
  select line from (select site, unnest(l) as line from t) where regexp_matches(line, '[^\x20\x09-\x0D]') group by line having count(distinct site) >= 10
), s as (
  select r, count(*) as n_lines, count(*) filter (where line in (from b)) as hits,
         string_agg(line, chr(10) order by i) filter (where line not in (from b)) as kept
  from u group by r
)
select doc_id, case when s.r is null then null when hits = 0 then text else coalesce(kept, '') end as text,
       coalesce(n_lines, 0)::bigint as n_lines, coalesce(hits, 0)::bigint as n_removed
from d left join s using (r)
"""

_UNIT = "list_transform(embedding, lambda x: x::double)"
OP10 = rf"""
with recursive v as (
  select row_number() over () as r, vec_id, {_UNIT} as e from embeddings
), s as (
  select r, vec_id, e, sqrt(list_dot_product(e, e)) as n from v
  where vec_id is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and list_dot_product(e, e) > 0
), l as (
  select a.r as a, b.r as b from s a join s b
  on a.r <> b.r and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach as (
  select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a
), least_id as (
  select reach.a as r, min(v.vec_id) as id from reach join v on v.r = reach.b group by reach.a
), links as (
  select a as r, count(*) as n from l group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, least(coalesce(id, vec_id), vec_id) as component_id,
       vec_id is not distinct from least(coalesce(id, vec_id), vec_id) as kept
from v left join links using (r) left join least_id using (r)
"""

#: CRC-32 of the decimal form, bit by bit: a byte is xored in, then eight shifts (-1).
_CRC = """xor(4294967295, list_reduce(flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint))"""
OP13 = f"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) as t
  from conversations where conv_id is not null
), own as (
  select conv_id, conv_id - conv_id % 100 as base, {_CRC} % 6 as h from (select distinct conv_id from t)
), rebuilt as (
  select own.conv_id, t.n, t.t from own join t on t.conv_id = own.base and t.n <= own.h
  union all
  select own.conv_id, 1000 + t.n, t.t from own join t using (conv_id) where t.n > own.h
), convs as (
  select own.conv_id, coalesce(list(t order by n) filter (where n is not null), []) as ts from own left join rebuilt using (conv_id) group by own.conv_id
), members as (
  select conv_id, len(ts) as n, d, ts[1:d] as p from convs, unnest(range(len(ts) + 1)) u(d)
), nodes as (
  select p, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256 from members group by p, d
), kids as (
  select p[1:d - 1] as p, d - 1 as d, count(*) as n_children from nodes where d > 0 group by all
), own_values as (
  select nodes.*, coalesce(n_children, 0) as n_children, case when d > 0 then (n_convs - 1) * length(p[d].x) else 0 end as own_saved from nodes left join kids using (p, d)
), below as (
  select p[1:u.up] as p, u.up as d, sum((n_children = 0)::bigint) as n_leaves, sum(own_saved) as saved_tokens from own_values, unnest(range(d + 1)) u(up) group by all
)
select a.conv_id, a.d as depth, b.conv_id as parent_conv_id, a.n_convs, a.n_children, below.n_leaves::bigint as n_leaves, below.saved_tokens::bigint as saved_tokens, a.ends_sha256
from own_values a join below using (p, d) left join nodes b on b.d = a.d - 1 and b.p = a.p[1:a.d - 1]
"""

ORACLE: dict[str, str] = {
    "op2_quality_rules": OP2,
    "op4_mixing": OP4,
    "op6_chat_formatting": OP6,
    "op7_line_dedup": OP7,
    "op10_embedding_dedup": OP10,
    "op13_conversation_trie": OP13,
}
