"""SQL for DuckDB whose rows equal those of the queries; only where SQL can express one at the size of a test table."""

from __future__ import annotations

from . import mixing


def _tools() -> str:
    """Turns to calls and results by an as-of window, forest depth as the number of calls before in the conversation."""
    return r"""
with t as (select conv_id, turn, role, text, coalesce(role in ('user', 'system') and conv_id is not null and turn is not null, false) as is_call from conversations),
o as (select conv_id, turn, bool_or(is_call) as is_call, min(case when is_call then case when role = 'system' then 'instruct' else 'ask' end end) as name from t where conv_id is not null and turn is not null group by conv_id, turn),
w as (select conv_id, turn, max(case when is_call then turn end) over p as before, count(case when is_call then 1 end) over p as depth from o window p as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)),
b as (select t.*, w.before, w.depth from t left join w on t.conv_id = w.conv_id and t.turn = w.turn),
c as (select *, conv_id || ':' || turn as call_id, case when role = 'system' then 'instruct' else 'ask' end as name, coalesce(text, '') as prompt,
      case when role = 'system' then 300 else 400 end as most, '{"prompt":' || to_json(coalesce(text, ''))::varchar || ',"turn":' || turn || '}' as arguments from b where is_call),
e as (select *, row_number() over (partition by call_id order by name, arguments) as n,
      list_filter([case when length(prompt) < 1 then 'prompt: below 1' when length(prompt) > most then 'prompt: above ' || most end,
      case when turn < 0 then 'turn: below 0' when role = 'system' and turn > 0 then 'turn: above 0' end], lambda x: x is not null) as wrong from c),
r as (select b.conv_id, b.turn, b.text, case when b.before is not null then b.conv_id || ':' || b.before end as call_id, b.depth, o.name
      from b left join o on o.conv_id = b.conv_id and o.turn = b.before where not b.is_call)
select conv_id, turn, 'call' as kind, call_id, name, case when n = 1 then 2 * depth end as step,
  case when n > 1 then 'duplicate' when exists (select 1 from r where r.call_id = e.call_id) then 'answered' else 'unanswered' end as status,
  len(wrong) = 0 as valid, array_to_string(wrong, '; ') as errors,
  '{"arguments":' || arguments || ',"call_id":"' || call_id || '","name":"' || name || '","type":"call"}' as json from e
union all
select conv_id, turn, 'result', call_id, name, case when call_id is not null then 2 * (depth - 1) + 1 end, case when call_id is null then 'orphan' else 'linked' end,
  null, '', '{"call_id":' || coalesce('"' || call_id || '"', 'null') || ',"content":' || to_json(coalesce(text, ''))::varchar || ',"type":"result"}' from r
"""


def _top_k() -> str:
    return """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def _mix() -> str:
    """Water level over sources in closed form; each threshold by a sorted running sum instead of histograms."""
    sql = r"""
with d as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size,
  (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint) >> 2 as h from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) as sid from s0),
s2 as (select *, [5.0, 2.0, 1.0][((sid - 1) % 3 + 1)::int]::double as weight from s1),
s3 as (select *, 3 * source_size as cap, sum(source_size) over () as total, sum(weight) over (order by source_size / weight, sid rows between current row and unbounded following) as rest,
  coalesce(sum(3 * source_size) over (order by source_size / weight, sid rows between unbounded preceding and 1 preceding), 0) as used from s2),
s4 as (select *, (total - used) / rest as level from s3),
s5 as (select *, (select level from s4 x where x.level * x.weight <= x.cap order by x.source_size / x.weight, x.sid limit 1) as final from s4),
s6 as (select sid, source, source_size, coalesce(least(cap, final * weight), cap)::double as target from s5),
p as (select *, case when source_size > 0 then least(3, floor(target / source_size + 1e-12)) else 0 end::bigint as copies from s6),
x0 as (select doc_id, size, h, sid, source_size, target, copies, floor(target - copies * source_size + 1e-6)::bigint as left0, false as chosen from d join p on d.source is not distinct from p.source),
"""
    for i in range(mixing.NESTED):
        sql += f"""
f{i} as (select sid, h, sum(size) as words, any_value(left{i}) as lim from x{i} where size > 0 and not chosen and size <= left{i} group by sid, h),
g{i} as (select *, sum(words) over (partition by sid order by h) as upto from f{i}),
b{i} as (select sid, max(h) filter (upto <= lim) as top, coalesce(max(upto) filter (upto <= lim), 0) as got from g{i} group by sid),
x{i + 1} as (select x.* exclude (chosen), x.chosen or coalesce(x.size > 0 and x.size <= x.left{i} and x.h <= b.top, false) as chosen, x.left{i} - coalesce(b.got, 0) as left{i + 1} from x{i} x left join b{i} b on x.sid = b.sid),"""
    return sql.rstrip(",") + f"\nselect doc_id, size, source_size, target, (size * (copies + case when chosen and copies < 3 then 1 else 0 end))::bigint as taken from x{mixing.NESTED}"


ORACLES: dict[str, str] = {"op2_tool_call_linking": _tools(), "op3_kd_tree_top_k": _top_k(), "op4_hash_threshold_mixing": _mix()}
