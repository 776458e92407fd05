"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality
from .linededup import LEAST_LINES, MODULUS
from .mixing import MOST, SEED

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5 = rf"""
with texts as (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null),
lines as (
  select doc_id, i - 1 as i, list_extract(parts, i) as line, trim(list_extract(parts, i), {_SPACES}) <> '' as worded
  from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from texts)),
hashed as (select *, cast('0x' || substr(md5(line), 1, 7) as bigint) as h from lines),
ends as (
  select *, (h * 31 + coalesce(lag(h) over w, 0)) % {MODULUS} = 0 as is_end from hashed
  window w as (partition by doc_id order by i)),
numbered as (
  select *, coalesce(sum(cast(is_end as int)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from ends),
spans as (
  select doc_id, min(i) as f, max(i) as t from numbered group by doc_id, k having count(*) filter (where worded) >= {LEAST_LINES}
  union
  select doc_id, i, next from (select doc_id, i, lead(i) over (partition by doc_id order by i) as next from lines where worded) where next is not null),
chunks as (select doc_id, f, t, array_to_string(list_slice(parts, f + 1, t + 1), chr(10)) as chunk from spans join texts using (doc_id)),
ranked as (
  select doc_id, f, t, first_value(doc_id) over w as first_doc, first_value(t) over w as first_t, row_number() over w as place
  from chunks window w as (partition by chunk order by doc_id, f, t)),
gone as (select distinct doc_id, unnest(range(f, t + 1)) as i from ranked where place > 1 and not (doc_id = first_doc and f <= first_t)),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.i) as n_removed_lines, coalesce(string_agg(line, chr(10) order by l.i) filter (where g.i is null), '') as kept
  from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id),
runs as (
  select doc_id, count(*) as n_spans from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from gone)
  where before is null or before < i - 1 group by doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed_lines, 0) as bigint) as n_removed_lines,
       cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join kept using (doc_id) left join runs using (doc_id)
"""

_OVER = ", ".join(f"('{s}', {c!r})" for s in quality.SCORES for c in quality.GRID)
OP8 = rf"""
with docs as (select doc_id, lang, coalesce(text, '') as text from documents),
words as (
  select doc_id, i, list_extract(w, i) as a, list_extract(w, i + 1) as b, list_extract(w, i + 2) as c, len(w) as n
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, regexp_extract_all(text, '{_WORD}') as w from docs))),
grams as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as times from words where i <= n - 2),
covered as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from grams where times > 1) group by doc_id),
sizes as (select doc_id, count(*) as n_words, sum(length(a)) as word_chars from words group by doc_id),
lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(text, chr(10))) as line from docs) where trim(line, {_SPACES}) <> '' group by doc_id),
f as (
  select d.doc_id, coalesce('=' || lang, 'null') as stratum, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
         cast(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from docs d left join covered using (doc_id) left join sizes using (doc_id) left join lines using (doc_id)),
s as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         n_symbols / greatest(word_chars, 1) as symbol_share, n_dup_lines / greatest(n_lines, 1) as dup_line_share, n_repeat_words / greatest(n_words, 1) as repeat_share
  from f),
good as (select doc_id from labels group by doc_id having max(quality) = 1),
held as (select * from s where not base_failed and doc_id in (select doc_id from good)),
long as (
  select stratum, 'symbol_share' as score, symbol_share as v from held
  union all select stratum, 'dup_line_share', dup_line_share from held
  union all select stratum, 'repeat_share', repeat_share from held),
grid(score, cutoff) as (values {_OVER}),
tests as (select stratum, g.score, cutoff, count(*) as n, count(*) filter (where v > cutoff) as x from long l join grid g on l.score = g.score group by all),
levels as (select *, {quality.CONFIDENCE_MISS} / ((select count(distinct stratum) from held) * {len(quality.SCORES) * len(quality.GRID)}) as level, {quality.RISK / len(quality.SCORES)!r} as p from tests),
terms as (select stratum, score, cutoff, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))) as cdf
          from (select *, unnest(range(0, x + 1)) as k from levels where x < n * p) group by all),
proven as (select l.stratum, l.score, l.cutoff, coalesce(cdf <= level, false) as ok from levels l left join terms t on l.stratum = t.stratum and l.score = t.score and l.cutoff = t.cutoff),
bad as (select stratum, score, max(cutoff) filter (where not ok) as worst from proven group by all),
cut as (select p.stratum, p.score, min(cutoff) as cutoff from proven p join bad b on p.stratum = b.stratum and p.score = b.score where ok and cutoff > coalesce(worst, -1) group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(symbol_share > (select cutoff from cut c where c.stratum = s.stratum and c.score = 'symbol_share'), false)
       and not coalesce(dup_line_share > (select cutoff from cut c where c.stratum = s.stratum and c.score = 'dup_line_share'), false)
       and not coalesce(repeat_share > (select cutoff from cut c where c.stratum = s.stratum and c.score = 'repeat_share'), false) as kept
from s
"""

OP10 = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':{SEED}') as key
  from documents),
src as (
  select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by source),
caps as (
  select *, {MOST} * source_size as cap, {MOST} * source_size / w as ratio, sum(source_size) over () as total from src),
levels as (
  select *, (total - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by ratio, source nulls last rows between current row and unbounded following) as level
  from caps),
targets as (
  select source, source_size, least(cast(cap as double), w * max(level) over ()) as target, cap from levels),
budgets as (select *, cast(least(cap, floor(target + 0.5)) as bigint) as budget from targets),
placed as (
  select d.doc_id, d.size, b.source_size, b.target, b.budget,
         coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from d join budgets b on d.source is not distinct from b.source)
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0 else budget // source_size * size + greatest(0, least(size, budget % source_size - before)) end as bigint) as taken
from placed
"""
