"""What the queries return, as DuckDB SQL, where SQL can express it."""

from __future__ import annotations

OP2 = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key,
         row_number() over (partition by doc_id, text) as occurrence
  from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as k from sized group by source
), ranked as (
  select *, case k % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from sources
), ratios as (
  select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio from ranked
), levels as (
  select *, ((sum(source_size) over ())::double * 1.5::double
             - coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as level
  from ratios
), filled as (
  select *, (select l.level from levels l where l.level <= l.ratio order by l.ratio, l.level limit 1) as final from levels
), targets as (
  select source, source_size, least(cap, coalesce(final * weight, cap)) as target from filled
), rates as (
  select d.doc_id, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
         ('0x' || substr(md5('17:' || d.key || ':' || d.occurrence), 1, 13))::bigint / 4503599627370496.0::double as draw
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       size * (floor(rate)::bigint + case when draw < rate - floor(rate) then 1 else 0 end) as taken
from rates
"""

OP9 = """
with turns as (
  select conv_id, floor(turn / 4096)::bigint as part, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
), people as (
  select distinct conv_id, role as speaker from turns
), seen as (
  select t.*, p.speaker,
         case when t.role = p.speaker then '<|im_start|>assistant' || chr(10) else '<|im_start|>user name=' || t.role || chr(10) end as head
  from turns t join people p on t.conv_id is not distinct from p.conv_id
), placed as (
  select *, head || text || '<|im_end|>' || chr(10) as piece,
         sum(length(head) + length(text) + 11) over (partition by conv_id, speaker order by turn nulls first, role, text rows unbounded preceding) as last
  from seen
)
select conv_id, part, speaker, min(last - length(piece))::bigint as start, count(*)::bigint as n_turns, count(*) filter (where role = speaker)::bigint as n_own,
       string_agg(piece, '' order by turn nulls first, role, text) as text,
       coalesce(string_agg((last - length(text) - 11)::bigint::varchar || '-' || last::bigint::varchar, ';' order by last) filter (where role = speaker), '') as mask
from placed group by conv_id, part, speaker
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op2_source_mixing": OP2, "op9_chat_rotation": OP9}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
