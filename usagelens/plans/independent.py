"""Statements for DuckDB written from the contract rather than from the plans: other shapes, straight over the tables."""

from __future__ import annotations

#: Steps of the window that count, as the contract words it.
_W = """with recursive steps as (
  select event_id, user_id, ts, event_type, cast(json_extract(props, '$.k') as int) k, case when cast(json_extract(props, '$.k') as int) <> 0 then cast(value as decimal(18,6)) end cost
  from events where event_id % 97 <> 0),
last_seen as (select user_id, max(ts) seen from events where ts <= timestamp '2024-01-29 06:00:00' group by user_id),
kept as (select user_id from last_seen where seen >= timestamp '2024-01-22 06:00:00' and seen < timestamp '2024-01-29 05:50:00' and user_id <> 7),
inside as (select s.* from steps s where s.user_id in (select user_id from kept) and ts >= timestamp '2024-01-22 06:00:00' and ts <= timestamp '2024-01-29 06:00:00')
"""
#: A skill is silent in a month in which no line item loads it.
_SILENT = """with months as (select unnest(range(0, 8)) back),
loads as (select distinct l_partkey, date_diff('month', l_shipdate, timestamp '1999-12-01') back from lineitem),
streaks as (select p_partkey skill, coalesce((select min(m.back) from months m where exists (select 1 from loads l where l.l_partkey = p_partkey and l.back = m.back)), 8) streak from part),
retire as (select skill, streak from streaks where streak >= 4 and skill <> 17)
"""
_Z = """, costs as (select user_id, coalesce(cast(sum(cost) as double), 0) cost from inside group by user_id),
middle as (select quantile_cont(cost, 0.5) med from costs),
spread as (select quantile_cont(abs(cost - (select med from middle)), 0.5) mad from costs)
"""
#: One row a session for the audit: cost, tokens read and fresh, seconds of work, and its signals in the order of the contract.
_AUDIT = _W + _Z + """, spent as (select user_id, round(cast(sum(cost) as double), 6) cost, cast(sum(cost) as double) raw, coalesce(sum(k) filter (event_type = 'view'), 0) hit, coalesce(sum(k) filter (event_type in ('view', 'click')), 0) seen from inside group by user_id),
pauses as (select user_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) us from inside),
worked as (select user_id, floor(coalesce(sum(us) filter (us < 300000000), 0) / 1e6) busy from pauses group by user_id),
said_again as (select distinct user_id from (select user_id, k, count(*) n from inside where event_type = 'signup' group by user_id, k) where n >= 2),
signals as (
  select user_id, 1 priority, 'top' signal from (select user_id from spent order by cost desc nulls last, user_id limit 5)
  union all select user_id, 2, 'outlier' from costs, middle, spread where mad > 0 and (cost - med) / (1.4826 * mad) >= 3 and cost >= 1
  union all select user_id, 3, 'loop' from spent join worked using (user_id) where busy > 0 and raw / (busy / 60) > 0.5
  union all select user_id, 4, 'cache' from spent where seen > 0 and round(hit / seen, 6) < (select round(sum(hit) / sum(seen), 6) from spent) - 0.2
  union all select user_id, 5, 'repeat' from said_again)
"""
#: An alert fires over, under or at its threshold, as the contract says for each.
_ALERTS = {
    "weekly_budget": ("high", 50000.0, "(select cast(sum(cost) as double) from inside)", ">"),
    "monthly_budget": ("high", 150000.0, "(select cast(sum(cost) as double) from steps where ts >= timestamp '2023-12-25 06:00:00' and ts < timestamp '2024-01-29 06:00:00')", ">"),
    "cache_hit_min": ("medium", 0.6, "(select cast(sum(k) filter (event_type = 'view') as double) / sum(k) filter (event_type in ('view', 'click')) from inside)", "<"),
    "lint_max": ("medium", 100.0, "(select cast(count(*) as double) from lineitem where year(l_shipdate) = 1999 and month(l_shipdate) = 12)", ">"),
    "cost_wow": ("medium", 0.15, "(select cast(sum(cost) filter (ts >= timestamp '2024-01-22 06:00:00') as double) / cast(sum(cost) filter (ts < timestamp '2024-01-22 06:00:00') as double) - 1 from steps where ts >= timestamp '2024-01-15 06:00:00' and ts < timestamp '2024-01-29 06:00:00')", ">"),
}
SQL = {
    "audit_priority": _AUDIT + """select user_id session_id, cast(min(priority) as int) priority, count(distinct signal) signals,
  case when row_number() over (order by min(priority), any_value(s.cost) desc nulls last, user_id) <= 8 then 'treated' else 'untreated' end state from signals join spent s using (user_id) group by user_id""",
    "union_audit_signals": _AUDIT + "select user_id session_id, priority, signal from signals",
    **{f"audit_{x}_signal": _AUDIT + f"select user_id session_id from signals where signal = '{x}'" for x in ("top", "loop", "cache", "repeat")},
    "audit_outlier_signal": _W + _Z + "select user_id session_id, round((cost - med) / (1.4826 * mad), 6) z from costs, middle, spread where mad > 0 and (cost - med) / (1.4826 * mad) >= 3 and cost >= 1",
    "median_mad": _W + _Z + "select round(med, 6) median_cost, round(mad, 6) mad from middle, spread",
    "snooze_filter": _AUDIT + "select user_id session_id, signal from signals where signal || ':' || user_id not in ('cache:6', 'repeat:22', 'outlier:19')",
    **{f"alert_{n}": _W + f"select '{n}' rule, '{severity}' severity, cast({least} as double) threshold, round(x, 6) observed, coalesce(round(x, 6) {op} {least}, false) fired from (select {value} x)" for n, (severity, least, value, op) in _ALERTS.items()},
    "consecutive_never_loaded": _SILENT + "select skill, cast(streak as bigint) streak from streaks",
    "r1_retire": _SILENT + "select skill, cast(streak as bigint) streak, 'retire' action, 'medium' severity from retire",
    "r2_retire_high": _SILENT + "select skill, cast(streak as bigint) streak, 'retire' action, 'high' severity from retire where skill in (select a.p_partkey from part a, part b where a.p_partkey <> b.p_partkey and (a.p_brand, a.p_type, a.p_size) = (b.p_brand, b.p_type, b.p_size))",
    "active_time": _W + ", gaps as (select user_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) us from inside) select user_id session_id, cast(floor(coalesce(sum(us) filter (us < 300000000), 0) / 1e6) as bigint) active_seconds from gaps group by user_id",
    "duration_seconds": _W + "select user_id session_id, cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) as bigint) duration_seconds from inside group by user_id",
    "session_cost_scores": _W + _Z + "select user_id session_id, round(cost, 6) cost, round(med, 6) median_cost, round(mad, 6) mad, round((cost - med) / nullif(1.4826 * mad, 0), 6) z from costs, middle, spread",
    "cost_outliers": _W + _Z + "select user_id session_id, round(cost, 6) cost, round(med, 6) median_cost, round((cost - med) / (1.4826 * mad), 6) z from costs, middle, spread where mad > 0 and (cost - med) / (1.4826 * mad) >= 3 and cost >= 1",
    "compact_repeats": """with calls as (select event_id, user_id, ts, event_type, cast(json_extract(props, '$.k') as int) // 50 args from events where event_id % 97 <> 0),
marked as (select *, case when lag(event_type) over w = event_type and lag(args) over w = args then 0 else 1 end fresh from calls window w as (partition by user_id order by ts, event_id)),
grouped as (select *, sum(fresh) over (partition by user_id order by ts, event_id) island from marked),
placed as (select *, row_number() over (partition by user_id, island order by ts, event_id) pos, count(*) over (partition by user_id, island) n from grouped)
select user_id session_id, event_id, event_type tool, 'call' kind, cast(0 as bigint) replaced from placed where n < 3 or pos in (1, n)
union all select user_id, event_id, event_type, 'marker', n - 2 from placed where n >= 3 and pos = 2""",
    "monthly_cost": """select round(cast(sum(cast(value as decimal(18,6))) as double), 6) cost from events
where event_id % 97 <> 0 and cast(json_extract(props, '$.k') as int) <> 0 and ts >= timestamp '2023-12-25 06:00:00' and ts < timestamp '2024-01-29 06:00:00'""",
    "window_hours_guard": """with runs as (
  select case when ts >= timestamp '2024-01-22 06:00:00' then 0 else 1 end run, event_type, cast(json_extract(props, '$.k') as int) k, cast(value as decimal(18,6)) v
  from events where event_id % 97 <> 0 and ts >= timestamp '2024-01-15 06:00:00' and ts < timestamp '2024-01-29 06:00:00'),
sums as (select run, round(cast(sum(v) filter (k <> 0) as double), 6) cost, cast(sum(k) as double) tokens, round(cast(sum(k) filter (event_type = 'view') as double) / sum(k) filter (event_type in ('view', 'click')), 6) hit from runs group by run)
select round(a.cost / b.cost - 1, 6) cost_pct, round(a.tokens / b.tokens - 1, 6) tokens_pct, 168 <> 168 warn, round(a.hit - b.hit, 6) hit_rate_diff from sums a, sums b where a.run = 0 and b.run = 1""",
    "draft_cap": "select doc_id, (1 - quality) * 2 + toxic severity, row_number() over (order by (1 - quality) * 2 + toxic desc, doc_id) <= 3 drafted from labels where quality = 0 or toxic = 1",
    "rank_top_sessions": _W + "select user_id session_id, round(cast(sum(cost) as double), 6) cost, row_number() over (order by round(cast(sum(cost) as double), 6) desc nulls last, user_id) place from inside group by user_id",
    "top_sessions": _W + "select user_id session_id, round(cast(sum(cost) as double), 6) cost from inside group by user_id order by 2 desc nulls last, 1 limit 5",
    "totals": _W + """select count(distinct user_id - user_id % 10) session_count, cast(sum(k) as bigint) tokens, round(cast(sum(cost) as double), 6) cost, cast(sum(k) filter (event_type = 'view') as bigint) cache_read, cast(sum(k) filter (event_type = 'purchase') as bigint) cache_write,
  cast(sum(k) filter (event_type = 'click') as bigint) fresh_input, cast(sum(k) filter (event_type = 'signup') as bigint) output, cast(sum(k) filter (event_type = 'error') as bigint) reasoning,
  round(cast(sum(k) filter (event_type = 'view') as double) / sum(k) filter (event_type in ('view', 'click')), 6) hit_rate from inside""",
    # Straight from the events: what each type's payload must give.
    "mixed_payloads": """select event_id, event_type <> 'error' readable, case event_type when 'view' then 'step-finish' when 'purchase' then 'step-finish' when 'click' then 'tool' when 'signup' then 'text' end kind,
  case when event_type = 'view' then round(cast(cast(value as decimal(18,6)) as double), 6) end cost, case when event_type in ('view', 'purchase') then cast(k as bigint) end input_tokens, case when event_type = 'view' then cast(2 * k as bigint) end cache_read,
  case when event_type = 'click' then 't' || (k % 7) end tool, case when event_type = 'click' then 'f' || k end path, case when event_type = 'click' then case when k % 5 = 0 then 'error' else 'ok' end end status, case when event_type = 'signup' then 'say ' || k end said
from (select event_id, event_type, value, cast(json_extract(props, '$.k') as int) k from events where event_id % 97 <> 0)""",
    # Money is rounded to six places, and a ratio without a denominator is null.
    "by_model": _W + "select 'p' || (user_id % 2) || '/m' || (user_id % 5) model, count(distinct user_id) session_count, cast(sum(k) as bigint) tokens, round(cast(sum(cost) as double), 6) cost from inside group by 1",
    "daily_totals": _W + "select strftime(ts, '%Y-%m-%d') as day, round(cast(sum(cost) as double), 6) cost, cast(sum(k) as bigint) tokens, round(cast(sum(k) filter (event_type = 'view') as double) / nullif(sum(k) filter (event_type in ('view', 'click')), 0), 6) hit_rate from inside group by 1",
    "session_usage": _W + "select user_id session_id, cast(sum(k) as bigint) tokens, round(cast(sum(cost) as double), 6) cost, round(cast(coalesce(sum(k) filter (event_type = 'view'), 0) as double) / nullif(coalesce(sum(k) filter (event_type in ('view', 'click')), 0), 0), 6) hit_rate, count(*) steps from inside group by user_id",
    "api_call_count": _W + "select user_id session_id, count(*) api_calls from inside group by user_id",
    "distinct_aggregation": _W + "select event_type tool, count(distinct user_id) session_count, count(distinct (user_id % 2, user_id % 5)) models from inside group by event_type",
    "missing_pricing": _W + "select 'p' || (user_id % 2) || '/m' || (user_id % 5) model, count(*) steps_without_cost, cast(sum(k) as bigint) tokens from inside where k = 0 group by 1",
    "audit_counts": _W + "select count(distinct user_id // 10) counted, count(distinct user_id) counted_all, count(distinct user_id) filter (user_id % 10 <> 0) merged_children from inside",
    "subagent_totals": _W + "select 'agent' || (user_id % 3) agent, count(distinct user_id) child_count, round(cast(sum(cost) as double), 6) cost from inside where user_id % 10 <> 0 group by 1",
    "subagent_share_gate": _W + "select round(x, 6) share, x > 0.1 shown from (select cast(sum(cost) filter (user_id % 10 <> 0) as double) / cast(sum(cost) as double) x from inside)",
    "includes_subagents": _W + "select user_id - user_id % 10 root_id, bool_or(user_id % 10 <> 0) includes_subagents from inside group by 1",
    "small_sample_warning": _W + "select count(distinct user_id) sessions, count(distinct user_id) < 15 warn from inside",
    "cost_per_active_minute": _W + ", gaps as (select user_id, cost, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) us from inside) select user_id session_id, round(cast(sum(cost) as double) / nullif(floor(coalesce(sum(us) filter (us < 300000000), 0) / 1e6) / 60, 0), 6) cost_per_active_minute from gaps group by user_id",
    "baseline_cross": _W + _Z + "select user_id session_id, round(cost, 6) cost, round(med, 6) median_cost, round(mad, 6) mad from costs, middle, spread",
    "dedup_outlier_mark": _W + _Z + ", dear as (select user_id, round(cast(sum(cost) as double), 6) cost from inside group by user_id order by 2 desc nulls last, 1 limit 5) select user_id session_id, dear.cost, (mad > 0 and (costs.cost - med) / (1.4826 * mad) >= 3 and costs.cost >= 1) outlier from dear join costs using (user_id), middle, spread",
    "top3_models_fold": _W + ", m as (select 'p' || (user_id % 2) || '/m' || (user_id % 5) model, cast(sum(cost) as double) cost from inside group by 1), r as (select *, rank() over (order by cost desc, model) place, cost / (select sum(cost) from m) share from m) select if(place <= 3 and share >= 0.05, model, 'others') model, round(sum(cost), 6) cost from r group by 1",
    "daily_spike": _W + """, days as (select cast(ts as date) as day, cast(sum(cost) as double) cost, max(ts) >= timestamp '2024-01-22 06:00:00' and bool_and(ts >= timestamp '2024-01-22 06:00:00') now from steps where ts >= timestamp '2023-12-25 06:00:00' and ts < timestamp '2024-01-29 06:00:00' group by 1, floor(date_diff('hour', timestamp '2023-12-25 06:00:00', ts - (extract(minute from ts) * interval 1 minute)) / 168)),
base as (select quantile_cont(cost, 0.5) med from days where not now), mads as (select med, (select quantile_cont(abs(cost - base.med), 0.5) from days where not now) mad from base)
select cast(day as varchar) as day, round(cost, 6) cost, case when mad = 0 and cost > med then 10.0 when mad > 0 then least(round((cost - med) / (1.4826 * mad), 6), 10.0) end z, case when mad = 0 and cost > med then 'no spread before' when mad > 0 and (cost - med) / (1.4826 * mad) > 10 then 'capped' end note from days, mads where now""",
    # Up from each session by its id without the last digit, as far as there are sessions.
    "merge_children": _W + """, walk as (select distinct user_id id, user_id up from inside union all select id, up // 10 from walk where up >= 10 and up // 10 in (select user_id from last_seen)),
ends as (select id, min(up) up from walk group by id) select case when up < 10 then cast(up as varchar) else 'orphan' end root_id, count(distinct user_id) members, round(cast(sum(cost) as double), 6) cost from inside join ends on id = user_id group by 1""",
    "used_catalog": "select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where year(l_shipdate) = 2000 and month(l_shipdate) = 1)",
    "never_loaded": "select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where year(l_shipdate) = 2000 and month(l_shipdate) = 1)",
    "skill_usage": "select l_partkey skill, count(*) loads, count(distinct l_orderkey) sessions_used_in from lineitem where strftime(l_shipdate, '%Y-%m') = '2000-01' group by l_partkey",
    "lint_by_rule": "select rule, cast(a as bigint) violations, cast(a - b as bigint) delta from (select l_returnflag rule, count(*) filter (strftime(l_shipdate, '%Y-%m') = '1999-12') a, count(*) filter (strftime(l_shipdate, '%Y-%m') = '1999-11') b from lineitem group by 1) where a + b > 0",
    "first_turns": "select conv_id, min(turn) turn, arg_min(text, turn) text, case when arg_min(text, turn) like '/%' then nullif(regexp_extract(arg_min(text, turn), '^/([a-zA-Z0-9_-]+)', 1), '') end command from conversations where role = 'user' group by conv_id",
    "transcript_rows": "select a.conv_id, count(*) as line, any_value(a.role) as role, any_value(a.text) as text from conversations a join conversations b on a.conv_id = b.conv_id and b.turn <= a.turn group by a.conv_id, a.turn",
}
