"""DuckDB statement of op12: lines as lists, cuts as list slices."""

FILL_IN_MIDDLE = """
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as hex from documents),
h as (
  select doc_id, text, string_split(text, chr(10)) as parts,
    ('0x' || substr(hex, 1, 8))::bigint as h1, ('0x' || substr(hex, 9, 8))::bigint as h2,
    ('0x' || substr(hex, 25, 8))::bigint as h4
  from d),
n as (
  select *, case when text = '' then 0 when text like '%' || chr(10) then len(parts) - 1 else len(parts) end as n from h),
lines as (
  select *, list_transform(range(1, n + 1), lambda i: parts[i] || case when i < len(parts) then chr(10) else '' end) as line,
    least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b
  from n),
cut as (
  select doc_id, text, n,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
         when h4 % 100 < 50 then 'spm' else 'psm' end as form,
    array_to_string(line[1:a], '') as head, array_to_string(line[a + 1:b], '') as body, array_to_string(line[b + 1:n], '') as tail
  from lines)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(head)::bigint end as prefix_chars,
  case when form <> 'plain' then length(body)::bigint end as middle_chars,
  sha256(case form when 'psm' then '<P>' || head || '<S>' || tail || '<M>' || body
                   when 'spm' then '<S>' || tail || '<P>' || head || '<M>' || body else text end) as output_sha256,
  sha256(case when form = 'plain' then text else head || body || tail end) as restored_sha256
from cut
"""
