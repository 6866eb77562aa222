"""DuckDB statement of op11: targets by windows, and what lies below each source's quota in its shuffled streams."""

MIXING = r"""
with d as (
  select row_number() over () as row, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as number from d group by source),
w as (
  select *, case number % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 2 * source_size as cap from s),
l as (
  select *, cap::double / weight::double as full_at,
    (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over before, 0)::double)
      / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from w window before as (order by cap / weight, number rows between unbounded preceding and 1 preceding)),
t as (
  select number, source, source_size, least(cap::double, weight::double * (
    select coalesce(max(level), 1e300::double) from l where full_at >= level)) as target
  from l),
copies as (
  select d.row, d.size, t.number, t.target, epoch, md5(epoch || ':' || coalesce(cast(doc_id as varchar), '')) as dealt
  from d join t on d.source is not distinct from t.source, (values (0), (1)) e(epoch)),
spans as (
  select *, sum(size) over (partition by number order by epoch, dealt, size, row) - size as start from copies),
taken as (
  select row, sum(greatest(0, least(size, round(target) - start)))::bigint as taken from spans group by row)
select doc_id, size, source_size, target, taken
from d join t on d.source is not distinct from t.source join taken using (row)
"""
