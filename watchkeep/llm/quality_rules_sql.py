"""DuckDB statement for the quality rules."""

QUALITY_RULES = r"""
with base as (
  select row_number() over () as row, doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
lines as (
  select row, host, text, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as ws
  from (select row, host, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from base)),
real as (select *, lower(array_to_string(ws, ' ')) as norm from lines where len(ws) > 0),
dup as (select row, count(*) - count(distinct line) as n_dup from real group by row),
win as (
  select row, i, array_to_string(words[i:i+7], ' ') as w
  from (select row, words, unnest(range(1, len(words) - 6)) as i from base where len(words) > 8)),
twice as (select row, i from (select row, i, count(*) over (partition by row, w) as n from win) where n > 1),
rep as (
  select row, sum(least(8, coalesce(nxt - i, 8))) as n_rep
  from (select row, i, lead(i) over (partition by row order by i) as nxt from twice) group by row),
per_line as (select host, norm, count(distinct text) as docs from real group by host, norm),
per_host as (select host, count(distinct text) as host_docs from base group by host),
frequent as (select host, norm from per_line join per_host using (host) where docs > 5 and docs > host_docs * 0.01),
gone as (select row, sum(len(ws)) as n_gone from real join frequent using (host, norm) group by row),
m as (
  select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup, 0)::bigint as n_dup_lines,
         coalesce(n_rep, 0)::bigint as n_repeat_words, coalesce(n_gone, 0)::bigint as removed_words
  from base left join dup using (row) left join rep using (row) left join gone using (row))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       (not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)
        and n_words - removed_words >= 20 and 100 * (n_words - removed_words) >= 30 * n_words) as kept,
       removed_words
from m
"""
