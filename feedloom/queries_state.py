"""Queries of histories, ledgers, alerts and the duplicate check, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import scalars as S
from feedloom.operators import articles as A
from feedloom.operators import health as H
from feedloom.operators import judging as G
from feedloom.operators import ledgers as L
from feedloom.operators import rolling
from feedloom.operators import tables as K
from feedloom.operators import vectors as V
from feedloom.queries import _OVERALL, _RECENT, DATE, RESULTS, STEPS, _overall, outcomes, query, table
from feedloom.sources import feeds

SINCE = {"deploy": "2026-03-01"}

# --- histories ----------------------------------------------------------------------------------------------------


@query(_RECENT + """, c as (select edition, subject, outcome, count(*) as n, min(day) as f from near where not ok group by 1, 2, 3),
  b as (select *, row_number() over (partition by edition, subject order by n desc, f, outcome) as k, sum(n) over (partition by edition, subject) as failures from c), w as (select edition, count(distinct day) as window_days from near group by 1)
  select b.edition, subject, failures::bigint as failures, outcome as dominant, window_days from b join w on b.edition is not distinct from w.edition where k = 1 and failures >= 3""")
def r_a6_chronic(spark, at):
    return H.chronic(outcomes(spark, at))


@query(_RECENT.replace("health_history", "(select case when edition like '%1' then null else edition end as edition, run_date, results, recorded_at from health_history)") + """, b as (select edition, subject, count(*) as failures from near where not ok group by 1, 2)
  select edition, subject, failures from b where failures >= 2""")
def r_a6_chronic_nameless(spark, at):
    """Editions without a name are one entity; two failures count."""
    rows = table(spark, at, "health_history").withColumn("edition", F.expr("case when edition like '%1' then null else edition end"))
    return H.chronic(rolling.daily_results(rows), threshold=2).select("edition", "subject", "failures")


@query(_RECENT + " select edition, subject, count(*) filter (ok) as ok, count(*) as total, round(count(*) filter (ok) / count(*), 4) as rate from near group by 1, 2")
def r_a8_health_rates(spark, at):
    return H.success_rates(H.recent(outcomes(spark, at), ["edition"], "day", 7), ["edition", "subject"])


@query(_OVERALL + """, m as (select edition, max(day) as z from s group by 1), near as (select s.* from s join m on s.edition is not distinct from m.edition where m.z - day < 60),
  n as (select edition, count(*) as n, round(count(*) filter (overall >= 4) / count(*), 4) as share_high, min(overall) as low, max(overall) as top, count(*) filter (overall = 5) as fives, count(*) filter (overall = 4) as fours from near group by 1)
  select * from n where n >= 30 and share_high >= 0.9""")
def r_a10_saturation(spark, at):
    """Over 60 days, so that editions with missing days have the 30 scores that are asked for."""
    bins = lambda v: F.coalesce(F.try_element_at("histogram", F.lit(v)), F.lit(0))
    return H.saturation(_overall(spark, at), "edition", window=60).select("edition", "n", "share_high", "low", "top", bins("5.0").alias("fives"), bins("4.0").alias("fours"))


@query(RESULTS + f""", r as (select edition, d as day, coalesce(results, map {{}}) as r from latest where k = 1), e as (select edition, day, unnest(case when cardinality(r) = 0 then [null] else map_entries(r) end) as e from r)
  select edition, day, case when count(*) filter (e.key <> '' and e.value <> '') = 0 then 'unknown' when count(*) filter (e.key in ({STEPS}) and e.value <> '') > 0 and count(*) filter (e.key in ({STEPS}) and e.value = 'ok') < 2 then 'failed'
    when bool_and(e.value = 'ok') filter (e.key <> '' and e.value <> '') then 'success' else 'partial' end as status from e group by 1, 2""")
def r_p21_run_status(spark, at):
    """Of every day with a record, also of those whose record is empty."""
    rows = table(spark, at, "health_history").select("edition", rolling.calendar_day(F.col("run_date")).alias("day")).where("day is not null").distinct()
    known = H.same(rows, outcomes(spark, at).select("edition", "day", "subject", "ok"), ["edition", "day"], "left")
    return H.run_status(known, ["edition", "day"], S.FETCH_STEPS)


_ARTIFACTS = f"""select run_date, source_key as subject from articles where source_key in ({STEPS}) union select run_date, 'telegram' from digests union select run_date, 'vault' from digests where ord = 0 union select run_date, 'deploy' from digests where ord = 3"""
_ALERTS = """select run_date, case digest_id % 9 when 0 then 'notify' when 1 then 'save' when 2 then 'deploy' when 3 then 'hn' when 4 then 'rss' else 'compress' end as step,
  case digest_id % 5 when 0 then 'HTTP Error 500' when 1 then 'Errno 61' when 2 then 'json ""' when 3 then 'json {' end as error, digest_id as nr from digests where digest_id % 9 < 6"""


def _alerts(spark, at):
    rows = table(spark, at, "digests").where("digest_id % 9 < 6").selectExpr("run_date", "case digest_id % 9 when 0 then 'notify' when 1 then 'save' when 2 then 'deploy' when 3 then 'hn' when 4 then 'rss' else 'compress' end as step",
        "case digest_id % 5 when 0 then 'HTTP Error 500' when 1 then 'Errno 61' when 2 then 'json \"\"' when 3 then 'json {' end as error", "digest_id as nr")
    gate = table(spark, at, "digests").where("digest_id % 11 = 7").selectExpr("run_date", "'invariants' as step", "'x' as error", "digest_id as nr")
    return A.pick(rows.unionByName(gate), ["run_date", "step"], F.col("nr"), last=True).drop("nr")


_ALERTS_ONE = f"(select run_date, step, (arg_max(struct_pack(e := error), nr)).e as error from ({_ALERTS} union all select run_date, 'invariants', 'x', digest_id from digests where digest_id % 11 = 7) group by 1, 2)"
_OBSERVED = f"""with al as {_ALERTS_ONE}, ar as (select distinct * from ({_ARTIFACTS})), sub as (select unnest(['hatena','hn','reddit','security_blogs','rss','telegram','vault','deploy']) as subject, unnest(['hatena','hn','reddit','security_blogs','rss','notify','save','deploy']) as step),
  d as (select distinct run_date from digests where run_date is not null), o as (select d.run_date, sub.subject, case when sub.subject = 'deploy' and d.run_date in (select run_date from al where step = 'invariants') then 'invariant'
    when al.step is not null then case when lower(al.error) like '%errno 61%' then 'network' when lower(al.error) like '%http error%' then 'upstream_http' when al.error like 'json ""' then 'empty_llm' when al.error like 'json%' then 'parse' else 'other' end
    when ar.subject is not null then 'ok' end as outcome from d cross join sub left join al on al.run_date = d.run_date and al.step = sub.step left join ar on ar.run_date = d.run_date and ar.subject = sub.subject)
  select * from o where outcome is not null"""


def _observed(spark, at):
    artifacts = table(spark, at, "articles").where(F.col("source_key").isin(S.FETCH_STEPS)).selectExpr("run_date", "source_key as subject")
    for subject, rule in (("telegram", "true"), ("vault", "ord = 0"), ("deploy", "ord = 3")):
        artifacts = artifacts.unionByName(table(spark, at, "digests").where(rule).selectExpr("run_date", f"'{subject}' as subject"))
    return H.observed(table(spark, at, "digests").where("run_date is not null").select("run_date"), _alerts(spark, at), artifacts)


@query(_OBSERVED)
def r_p20_observation(spark, at):
    """What a day left behind: artifacts of articles and digests, alerts derived from digests."""
    return _observed(spark, at)


_STATE = "(select 'hn' as subject, date '2026-01-01' as last union all select 'rss', (select max(day) from outcomes) - 3 union all select null, (select max(day) from outcomes) - 8)"


@query(_RECENT + f""", f as (select distinct case when subject = 'deploy' then null else subject end as subject from near where not ok), t as (select max(day) as today from outcomes), st as {_STATE}
  select f.subject from f left join st on f.subject is not distinct from st.subject, t where st.last is null or t.today - st.last >= 7""")
def r_w10_cool_down(spark, at):
    """Findings against a stored state: one reported long ago, one three days ago, one without a name eight days ago."""
    rows = outcomes(spark, at)
    found = H.recent(rows, ["edition"], "day", 7).where("not ok").select(F.expr("case when subject = 'deploy' then null else subject end").alias("subject")).distinct()
    today = rows.agg(F.max("day").alias("t")).first().t  # one date
    state = spark.sql(f"select 'hn' as subject, date '2026-01-01' as last union all select 'rss', date '{today}' - interval 3 day union all select null, date '{today}' - interval 8 day").withColumn("last", F.to_date("last")) if today else spark.createDataFrame([], "subject string, last date")
    return H.cooled(found, state, F.lit(today))


@query(_RECENT + f""", f as (select distinct subject from near where not ok and subject <> 'deploy'), t as (select max(day) as today from outcomes), st as {_STATE}
  select subject, last from st where subject is null or subject not in (select subject from f) union all select subject, today from f, t""")
def r_k6_reported(spark, at):
    """The state after all failing subjects were reported."""
    rows = outcomes(spark, at)
    found = H.recent(rows, ["edition"], "day", 7).where("not ok and subject <> 'deploy'").select("subject").distinct()
    today = rows.agg(F.max("day").alias("t")).first().t
    state = spark.sql(f"select 'hn' as subject, date '2026-01-01' as last union all select 'rss', date '{today}' - interval 3 day union all select null, date '{today}' - interval 8 day").withColumn("last", F.to_date("last"))
    return H.reported(state, found, F.lit(today))


_ONE = RESULTS + ", one as (select subject, day, outcome, ok from outcomes where edition = (select min(edition) from outcomes)), t as (select max(day) as today from one)"
_FOUND = """, near as (select o.* from one o, t where t.today - o.day < 7), c as (select subject, outcome, count(*) as n, min(day) as f from near where not ok group by 1, 2),
  b as (select *, row_number() over (partition by subject order by n desc, f, outcome) as k, sum(n) over (partition by subject) as failures from c), found as (select subject, failures::bigint as failures, outcome as dominant, (select count(distinct day) from near) as window_days from b where k = 1 and failures >= 1)"""


def _escalated(spark, at, part):
    """The first edition's last day, observed on top of the days before."""
    rows = outcomes(spark, at)
    first = rows.agg(F.min("edition").alias("e")).first().e
    one = rows.where(F.col("edition").eqNullSafe(first)).select("day", "subject", "outcome")
    today = one.agg(F.max("day").alias("t")).first().t
    state = spark.createDataFrame([("hn", today)] if today else [], "subject string, last date")
    out = H.escalated(one.where(F.col("day") < F.lit(today)), one.where(F.col("day") == F.lit(today)).select("subject", "outcome"), state, F.lit(today), threshold=1)
    return out[part], F.lit(today)


@query(_ONE + _FOUND + " select * from found where subject <> 'hn'")
def r_c3_escalated(spark, at):
    return _escalated(spark, at, 1)[0]


@query(_ONE + ", g as (select unnest(generate_series((select min(day) from one)::timestamp, (select max(day) from one)::timestamp, interval 1 day))::date as day) select day from g where day not in (select day from one)")
def r_c3_absent(spark, at):
    return _escalated(spark, at, 2)[0]


@query(_ONE + _FOUND + """, g as (select unnest(generate_series((select min(day) from one)::timestamp, (select max(day) from one)::timestamp, interval 1 day))::date as day), a as (select max(day) as z from g where day not in (select day from one))
  select subject, today as last from found, t where subject <> 'hn' union all select 'hn', today from t union all select 'absent:' || strftime(z, '%Y-%m-%d'), today from a, t where z is not null""")
def r_c3_state(spark, at):
    return _escalated(spark, at, 3)[0]


@query(_ONE + _FOUND + """, l as (select string_agg('• <b>' || subject || '</b>：近 ' || window_days || ' 天失敗 ' || failures || ' 次（主要：' || dominant || '）' || chr(10) || '  ↳ ' || case dominant when 'network' then 'look at the network' else '' end, chr(10) order by subject) as m from found where subject <> 'hn')
  select '⚠️ feed 慢性故障偵測（' || strftime(today, '%Y-%m-%d') || '）' || chr(10) || chr(10) || m as message from l, t where m is not null""")
def r_c14_escalation_text(spark, at):
    found, today = _escalated(spark, at, 1)
    return H.escalation_text(found, today, {"network": "look at the network"})


@query(_ONE + """, g as (select unnest(generate_series((select min(day) from one)::timestamp, (select max(day) from one)::timestamp, interval 1 day))::date as day), a as (select min(day) as a, max(day) as z, count(*) as n from g where day not in (select day from one))
  select '🕳️ feed 缺席日偵測（' || strftime(today, '%Y-%m-%d') || '）' || chr(10) || chr(10) || '共 <b>' || n || '</b> 天完全沒有產出，健康表不會顯示這些日子：' || chr(10) || '• ' || strftime(a, '%Y-%m-%d') || case when n > 1 then ' ~ ' || strftime(z, '%Y-%m-%d') else '' end as message from a, t where n > 0""")
def r_c14_absence_text(spark, at):
    gaps, today = _escalated(spark, at, 2)
    return H.absence_text(gaps, today)


@query(_OVERALL + """, sc as (select edition, list(overall order by day) as series from s where overall < 5 group by 1), d as (select distinct edition, day from outcomes), i as (select edition, day, day - row_number() over (partition by edition order by day)::int as g from d),
  n as (select edition, g, count(*) as c, max(day) as z from i group by 1, 2), st as (select edition, arg_max(c, z) as streak_days from n group by 1),
  ra as (select edition, subject, count(*) filter (ok) as ok, count(*) as total from outcomes where subject <> 'deploy' or day >= date '2026-03-01' group by 1, 2),
  rr as (select edition, array_to_string(list(subject || ' ' || ok || '/' || total order by subject), ', ') as rates from ra group by 1)
  select st.edition, streak_days, array_to_string(list_transform(coalesce(series, []), lambda x: x::int::varchar), ',') as series, rates from st left join sc on st.edition is not distinct from sc.edition left join rr on st.edition is not distinct from rr.edition""")
def r_c8_status(spark, at):
    """Days in a row, scores by day (days with the best score have none here), and rates of subjects, per edition."""
    status = H.system_status(_overall(spark, at).withColumn("overall", F.when(F.col("overall") < 5, F.col("overall"))), outcomes(spark, at), "edition", SINCE)
    rate = lambda r: F.concat(r["subject"], F.lit(" "), r["ok"].cast("string"), F.lit("/"), r["total"].cast("string"))
    return status.select("edition", "streak_days", F.array_join(F.transform("series", lambda x: x.cast("int").cast("string")), ",").alias("series"), F.array_join(F.transform("rates", rate), ", ").alias("rates"))


@query(_OVERALL + """, n as (select edition, overall, row_number() over (partition by edition order by day) - 1 as i, count(*) over (partition by edition) as n from s where edition not like '%2' or day = (select min(day) from s))
  select edition, string_agg(printf('%.1f,%.1f', 4 + case when n > 1 then i / (n - 1)::double * 232 else 116 end, 4 + 32 * (1 - least(5, overall) / 5)), ' ' order by i) as points from n group by 1""")
def r_w12_sparkline(spark, at):
    s = _overall(spark, at)
    low = s.agg(F.min("day").alias("d"))
    return G.sparkline(s.join(F.broadcast(low)).where("edition not like '%2' or day = d").drop("d"), "edition")  # one row


@query(RESULTS + f""", p as (select max({DATE}) as d from health_history) select edition, run_date, recorded_at, case when {DATE} = p.d then 'ok' else results['deploy'] end as deploy, cardinality(results)::int + case when {DATE} = p.d and results['deploy'] is null and not list_contains(map_keys(results), 'deploy') then 1 else 0 end as n
  from health_history, p where results is not null""")
def r_p31_self_published(spark, at):
    """The latest day counts as published, whatever its record says."""
    rows = table(spark, at, "health_history").where("results is not null")
    day = table(spark, at, "health_history").agg(F.max(S.strict_date(F.col("run_date"))).alias("_d"))
    fixed = S.merged_map(F.col("results"), F.create_map(F.lit("deploy"), F.lit("ok")))
    out = rows.join(F.broadcast(day)).withColumn("results", F.when(S.strict_date(F.col("run_date")) == F.col("_d"), fixed).otherwise(F.col("results")))  # one row
    return out.select("edition", "run_date", "recorded_at", F.try_element_at("results", F.lit("deploy")).alias("deploy"), F.size("results").alias("n"))


@query("select item_id, run_date from dedup_items where try_cast(run_date as date) >= (select max(try_cast(run_date as date)) - 7 from dedup_items)")
def r_k4_retention(spark, at):
    rows = table(spark, at, "dedup_items").withColumn("d", F.col("run_date").try_cast("date"))
    today = rows.agg(F.max("d").alias("t")).first().t  # one date
    return K.retained(rows, "d", F.lit(today), 7).select("item_id", "run_date")


# --- ledgers of runs and usage --------------------------------------------------------------------------------------

_STATUS = "case event_id % 6 when 0 then 'skipped' when 1 then 'loaded' when 2 then 'failed' else 'ran' end"
_ENTRY = f"(select distinct event_id, edition, run_date, step, {_STATUS} as status, (event_id % 1000)::double / 7 as duration_seconds from usage_events where step <> '')"


def _entries(spark, at):
    rows = table(spark, at, "usage_events").where("step <> ''").select("event_id", "edition", "run_date", "step").distinct()
    return rows.select("*", F.expr(_STATUS).alias("status"), ((F.col("event_id") % 1000).cast("double") / 7).alias("duration_seconds"))


@query(f"select edition, run_date, step, status, round(duration_seconds, 3) as duration_seconds from (select *, row_number() over (partition by edition, run_date, step order by event_id desc) as k from {_ENTRY}) where k = 1")
def r_c9_run_ledger(spark, at):
    return L.run_ledger(_entries(spark, at), ["edition", "run_date"], F.col("event_id"))


_RUNS = f"""with e as {_ENTRY}, a as (select run_date, step, status, event_id from (select *, row_number() over (partition by run_date, step order by event_id desc) as k from e where event_id % 2 = 0) where k = 1),
  b as (select run_date, step, status, event_id from (select *, row_number() over (partition by run_date, step order by event_id desc) as k from e where event_id % 2 = 1) where k = 1)"""


def _run_sides(spark, at):
    e = _entries(spark, at)
    one = lambda odd: A.pick(e.where(F.col("event_id") % 2 == odd).select("run_date", "step", "status", "event_id"), ["run_date", "step"], F.col("event_id"), last=True).select("run_date", "step", "status", "event_id")
    return one(0), one(1)


@query(_RUNS + """ select coalesce(b.run_date, a.run_date) as run_date, coalesce(b.step, a.step) as step, case when b.step is null or (a.step is not null and b.status in ('skipped', 'loaded')) then a.status else b.status end as status,
  case when b.step is null or (a.step is not null and b.status in ('skipped', 'loaded')) then a.event_id else b.event_id end as event_id from a full join b on a.run_date is not distinct from b.run_date and a.step = b.step""")
def r_j16_run_merge(spark, at):
    """Entries of odd number are a partial run on top of those of even number."""
    return L.merged_runs(*_run_sides(spark, at), ["run_date"])


@query(_RUNS + " select run_date, bool_or(status = 'loaded') as partial from b group by 1")
def r_a16_partial(spark, at):
    return L.builds_on_prior(_run_sides(spark, at)[1], ["run_date"])


_U = "(select distinct event_id, run_date, coalesce(nullif(trim(step), ''), 'other') as step, coalesce(model, '') as model, coalesce(prompt_tokens, 0) as p, coalesce(completion_tokens, 0) as c, greatest(coalesce(total_tokens, 0), 0) as t from usage_events)"
_SIDES = f"""with u as {_U}, a as (select * from u where event_id % 3 > 0 and step not like 'r%'), b as (select * from u where event_id % 3 = 0 and (run_date > '2026-02-01' or step not like 'r%')),
  sa as (select run_date, step, count(*) as calls, sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens, sum(t)::bigint as total_tokens from a group by 1, 2), sb as (select run_date, step, count(*) as calls, sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens, sum(t)::bigint as total_tokens from b group by 1, 2),
  steps as (select * from sb union all select sa.* from sa anti join sb on sa.run_date is not distinct from sb.run_date and sa.step = sb.step)"""


def _usage_sides(spark, at):
    u = table(spark, at, "usage_events").select("event_id", "run_date", F.expr("coalesce(nullif(trim(step), ''), 'other')").alias("step"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"),
        F.greatest(F.coalesce("total_tokens", F.lit(0)), F.lit(0)).alias("total_tokens")).distinct()
    a, b = u.where("event_id % 3 > 0 and step not like 'r%'"), u.where("event_id % 3 = 0 and (run_date > '2026-02-01' or step not like 'r%')")
    agg = lambda df, key: df.groupBy("run_date", key).agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in L.SUMS[1:]])
    return agg(a, "step"), agg(b, "step"), agg(a, "model"), agg(b, "model")


@query(_SIDES + " select * from steps")
def r_j17_usage_merge(spark, at):
    """A third of the calls are a partial run; on later days it brings steps that were not stored."""
    a, b, _, _ = _usage_sides(spark, at)
    return L.merged_usage_steps(a, b, ["run_date"])


@query(_SIDES + " select run_date, sum(calls)::bigint as calls, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, sum(total_tokens)::bigint as total_tokens from steps group by 1")
def r_j17_usage_totals(spark, at):
    a, b, _, _ = _usage_sides(spark, at)
    return L.usage_totals(L.merged_usage_steps(a, b, ["run_date"]), ["run_date"])


@query(_SIDES + """, fresh as (select distinct sb.run_date from sb anti join sa on sa.run_date is not distinct from sb.run_date and sa.step = sb.step), m as (select * from a union all select b.* from b where exists (select 1 from fresh where fresh.run_date is not distinct from b.run_date))
  select run_date, model, count(*) as calls, sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens, sum(t)::bigint as total_tokens from m group by 1, 2""")
def r_j17_usage_models(spark, at):
    a, b, ma, mb = _usage_sides(spark, at)
    return L.merged_usage_models(ma, mb, a, b, ["run_date"])


_DAYS_OF_USE = f"(select run_date, count(*) as calls, sum(p)::bigint as prompt_tokens, sum(c)::bigint as completion_tokens, sum(t)::bigint as total_tokens from {_U} where run_date is not null group by 1)"


@query(f"""with d as {_DAYS_OF_USE}, r as (select *, row_number() over (order by run_date desc) as k from d), w as (select *, row_number() over (order by run_date) as i, count(*) over () as n from r where k <= 7), st as (select step, count(*) as calls, sum(t)::bigint as total_tokens from {_U} where run_date = (select max(run_date) from d) group by 1)
  select (i + 2)::int as pos, rpad(run_date, 12, ' ') || lpad(calls::varchar, 6, ' ') || lpad(format('{{:,}}', prompt_tokens), 12, ' ') || lpad(format('{{:,}}', completion_tokens), 12, ' ') || lpad(format('{{:,}}', total_tokens), 12, ' ') as line from w
  union all select 0, '📊 Token 用量（近 ' || max(n) || ' 天）' from w union all select 1, '' union all select 2, '日期              呼叫          輸入          輸出          合計'
  union all select 1000, '平均/天：' || format('{{:,}}', (sum(total_tokens) // count(*))::bigint) || ' tokens' from w
  union all select (row_number() over (order by total_tokens desc, step) + 1000)::int, '  ' || rpad(step, 12, ' ') || lpad(calls::varchar, 4, ' ') || ' 次  ' || lpad(format('{{:,}}', total_tokens), 12, ' ') || ' tokens' from st""")
def r_c15_usage_table(spark, at):
    u = table(spark, at, "usage_events").select("event_id", "run_date", F.expr("coalesce(nullif(trim(step), ''), 'other')").alias("step"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"),
        F.greatest(F.coalesce("total_tokens", F.lit(0)), F.lit(0)).alias("total_tokens")).distinct().where("run_date is not null")
    days = u.groupBy("run_date").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in L.SUMS[1:]])
    last = days.agg(F.max("run_date").alias("run_date"))
    steps = u.join(F.broadcast(last), "run_date", "left_semi").groupBy("step").agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"))  # one row
    return L.usage_table(days, steps)


# --- alerts -------------------------------------------------------------------------------------------------------

_NEW_ALERTS = "(select run_date, 'compress' as step, min(coalesce(summary, '') || repeat('x', 400)) as error from digests where run_date is not null group by 1)"


@query(f"with al as (select * from {_ALERTS_ONE} where run_date is not null), n as {_NEW_ALERTS} select * from al union all select run_date, step, left(error, 300) from n where not exists (select 1 from al where al.run_date = n.run_date and al.step = n.step)")
def r_c13_alert_guard(spark, at):
    """One step fails every day; days that had its alert keep theirs."""
    new = table(spark, at, "digests").where("run_date is not null").groupBy("run_date").agg(F.min(F.concat(F.coalesce("summary", F.lit("")), F.lit("x" * 400))).alias("error")).withColumn("step", F.lit("compress"))
    return L.alerts_recorded(_alerts(spark, at).where("run_date is not null"), new, ["run_date"])


@query(f"with al as (select * from {_ALERTS_ONE} where run_date is not null), n as {_NEW_ALERTS}, f as (select * from al where step <> 'compress' union all select run_date, step, left(error, 300) from n) select run_date, step, error from f where step <> 'invariants'")
def r_k5_alert_record(spark, at):
    """The same by force, then the gate's alerts cleared."""
    new = table(spark, at, "digests").where("run_date is not null").groupBy("run_date").agg(F.min(F.concat(F.coalesce("summary", F.lit("")), F.lit("x" * 400))).alias("error")).withColumn("step", F.lit("compress"))
    forced = L.alerts_recorded(_alerts(spark, at).where("run_date is not null"), new, ["run_date"], forced=True)
    return L.alerts_cleared(forced, forced.where("step = 'invariants'").select("run_date", "step"), ["run_date"])


@query("""select event_id, step, error from (select event_id, unnest(['hn', 'rss']) as step, unnest([event_type, null]) as error from events where event_id % 5 < 2) where step = 'hn' or event_id % 5 = 1""")
def r_s22_alert_files(spark, at):
    """Alert files of both forms, broken ones, and ones that are no objects."""
    body = F.expr("""case event_id % 5 when 0 then '{"hn": {"failed_at": "t", "error": "' || event_type || '"}}' when 1 then '{"hn": {"error": "' || event_type || '"}, "rss": "2026-01-01"}' when 2 then '[1]' when 3 then 'broken {' end""")
    return feeds.alerts_of(table(spark, at, "events").select("event_id", body.alias("body")), "event_id")


# --- the duplicate check --------------------------------------------------------------------------------------------

_LEDGER = f"""with recursive a as (select article_id, url, run_date, {DATE} as d from articles where url <> ''), f as (select url, d, min(article_id) as first from a where d is not null group by 1, 2),
  n as (select *, row_number() over (partition by url order by d) as k from f),
  chain as (select url, d, k, first, d as last, null::date as prev from n where k = 1
    union all select n.url, n.d, n.k, n.first, case when n.d - chain.last <= 7 then chain.last else n.d end, case when n.d - chain.last <= 7 then chain.last end from chain join n on n.url = chain.url and n.k = chain.k + 1),
  decided as (select a.article_id, a.url, a.run_date, case when a.article_id <> c.first or c.prev is not null then 'url_seen' else 'kept' end as decision, case when a.article_id <> c.first then a.d else c.prev end as original_date from a join chain c on a.url = c.url and a.d = c.d)"""


@query(_LEDGER + " select * from decided")
def r_c1_url_ledger(spark, at):
    """Only kept rows are remembered: an address comes back once it was last kept more than a week ago."""
    return A.ledger(table(spark, at, "articles"))


@query(_LEDGER + """ select run_date, count(*) as total, count(*) filter (decision = 'kept') as kept, count(*) filter (decision = 'url_seen') as filtered_url, count(*) filter (decision = 'semantic_dup') as filtered_semantic from decided group by 1""")
def r_a12_counters(spark, at):
    return A.counters(A.ledger(table(spark, at, "articles")))


_VEC = """with e as (select vec_id, 'u' || case when vec_id % 2 = 1 and vec_id % 10 = 1 then vec_id - 1 when vec_id % 40 = 3 then vec_id + 2 else vec_id end as url, date '2026-03-01' + (vec_id % 20)::int as d, embedding::double[] as v from embeddings),
  new as (select * from e where vec_id % 2 = 1), hist as (select * from e where vec_id % 2 = 0), today as (select date '2026-03-15' as t), near as (select h.* from hist h, today where h.d >= t - 7 and h.d < t),
  n as (select *, row_number() over (partition by url order by vec_id) = 1 as first from new), seen as (select url, max(d) as sd from near group by 1),
  sims as (select n.vec_id as q, near.d, round(list_dot_product(n.v, near.v), 6) as s, row_number() over (partition by n.vec_id order by round(list_dot_product(n.v, near.v), 10) desc, near.vec_id) as k from n, near where n.first and n.url not in (select url from seen)),
  out as (select n.vec_id as ord, n.url, case when not first or sd is not null then 'url_seen' when s >= {least} then 'semantic_dup' else 'kept' end as decision, case when not first then t when sd is not null then sd when s >= {least} then sims.d end as original_date, n.v
    from n left join seen on n.url = seen.url left join sims on n.vec_id = sims.q and sims.k = 1, today)"""


def _day(spark, at):
    e = table(spark, at, "embeddings").select("vec_id", F.expr("concat('u', case when vec_id % 2 = 1 and vec_id % 10 = 1 then vec_id - 1 when vec_id % 40 = 3 then vec_id + 2 else vec_id end)").alias("url"), F.expr("date_add(date '2026-03-01', cast(vec_id % 20 as int))").alias("day"), "embedding")
    return e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("ord"), "url", "embedding"), e.where("vec_id % 2 = 0").select("url", "day", "embedding"), F.lit("2026-03-15").cast("date")


def _decided(least):
    def run(spark, at):
        new, history, today = _day(spark, at)
        return A.decided(new, history, today, least=least)

    return run


@query(_VEC.replace("{least}", "0.8") + " select ord, url, decision, original_date from out")
def r_j8_decided_080(spark, at):
    """All odd rows are a day's batch, all even rows the history, of which a week counts."""
    return _decided(0.8)(spark, at)


@query(_VEC.replace("{least}", "0.4") + " select ord, url, decision, original_date from out")
def r_c1_decided_040(spark, at):
    return _decided(0.4)(spark, at)


@query(_VEC.replace("{least}", "0.4") + ", kept as (select url, t as day from out, today where decision = 'kept') select url, d as day from hist where url not in (select url from kept) union all select url, day from kept")
def r_k3_vector_upsert(spark, at):
    """The history after the day: kept rows are stamped with it, filtered ones leave no trace."""
    new, history, today = _day(spark, at)
    return A.remembered(history, new, A.decided(new, history, today, least=0.4), today).select("url", "day")


@query(_LEDGER + " , k as (select distinct run_date, url from decided where decision = 'kept') select run_date, url, min(article_id) as article_id from articles semi join k using (run_date, url) where url <> '' group by 1, 2")
def r_c2_replayed(spark, at):
    """The stored list of kept addresses gives the day's rows again."""
    rows = table(spark, at, "articles").select("run_date", "url", "article_id")
    kept = A.ledger(table(spark, at, "articles")).where("decision = 'kept'").select("run_date", "url")
    return A.replayed(rows, kept, by=["run_date"])


@query(f"select digest_id, {DATE} as d from digests where {DATE} >= date '2026-03-08' and {DATE} < date '2026-03-15'")
def r_w2_half_open_window(spark, at):
    return A.in_window(table(spark, at, "digests").withColumn("d", S.strict_date(F.col("run_date"))), F.lit("2026-03-15").cast("date"), 7, "d").select("digest_id", "d")


@query()
def r_d2_embedded(spark, at):
    """Titles as unit vectors by the stand-in."""
    rows = V.embedded(table(spark, at, "articles").select("article_id", "title"), "title")
    return rows.select("article_id", F.size("embedding").alias("size"), F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 3).alias("length"))


# --- orders -------------------------------------------------------------------------------------------------------

@query(f"select row_number() over (order by run_date desc) as place, run_date from {_DAYS_OF_USE} where {DATE} is not null")
def r_t2_newest_first(spark, at):
    from pyspark.sql import Window

    days = table(spark, at, "usage_events").where(S.strict_date(F.col("run_date")).isNotNull()).select("run_date").distinct()
    return days.select(F.row_number().over(Window.orderBy(F.desc("run_date"))).alias("place"), "run_date")  # one row per day


@query(f"select step, t, row_number() over (order by t desc, step) as place from (select step, sum(t)::bigint as t from {_U} group by 1)")
def r_t3_steps_by_tokens(spark, at):
    from pyspark.sql import Window

    u = table(spark, at, "usage_events").select("event_id", "run_date", F.expr("coalesce(nullif(trim(step), ''), 'other')").alias("step"), F.coalesce("model", F.lit("")).alias("model"), F.coalesce("prompt_tokens", F.lit(0)).alias("p"), F.coalesce("completion_tokens", F.lit(0)).alias("c"), F.greatest(F.coalesce("total_tokens", F.lit(0)), F.lit(0)).alias("t")).distinct()
    sums = u.groupBy("step").agg(F.sum("t").alias("t"))
    return sums.select("step", "t", F.row_number().over(Window.orderBy(F.desc("t"), "step")).alias("place"))  # one row per step


@query(RESULTS + ", r as (select subject, round(count(*) filter (ok) / count(*), 4) as rate from outcomes where subject <> 'deploy' or day >= date '2026-03-01' group by 1) select row_number() over (order by subject) as place, subject, rate from r")
def r_t7_rates_by_name(spark, at):
    from pyspark.sql import Window

    rates = H.source_rates(outcomes(spark, at), SINCE)
    return rates.select(F.row_number().over(Window.orderBy("subject")).alias("place"), "subject", "rate")  # one row per subject


@query("""with f as (select run_date as step, max(fetched_at) as m from articles where run_date is not null group by 1), e as (select step as source, lead(step) over (order by step desc) as step from f),
  n as (select e.step, max(f.m) as m from e join f on e.source = f.step group by 1) select f.step from f join n using (step) where f.m < n.m""")
def r_p29_stale(spark, at):
    """Days as steps, each made from the day after it."""
    from pyspark.sql import Window

    files = table(spark, at, "articles").where("run_date is not null").groupBy(F.col("run_date").alias("step")).agg(F.max("fetched_at").alias("mtime"))
    edges = files.select(F.col("step").alias("source"), F.lead("step").over(Window.orderBy(F.desc("step"))).alias("step"))  # one row per day
    return G.stale(files, edges)


@query(RESULTS + """, d as (select distinct edition, day from outcomes), b as (select edition, min(day) as a, max(day) as z from d group by 1), s as (select edition, unnest(generate_series(a::timestamp, z::timestamp, interval 1 day))::date as day from b),
  g as (select s.edition, max(s.day) as day from s anti join d on s.edition is not distinct from d.edition and s.day = d.day group by 1) select edition, day from g where edition not like '%1'""")
def r_w11_new_absences(spark, at):
    """Editions that end in 1 were told of their last missing day."""
    gaps = H.missing_days(outcomes(spark, at), ["edition"])
    told = gaps.where("edition like '%1'").groupBy("edition").agg(F.max("day").alias("day"))
    return G.new_absences(gaps, told)


@query("with u as (select distinct event_id, run_date, total_tokens from usage_events where run_date is not null), r as (select *, row_number() over (partition by run_date order by event_id desc) as k from u) select run_date, event_id, total_tokens from r where k = 1")
def r_r5_rerun_replaces(spark, at):
    """Days whose last call came in a second run: it replaces what the first one stored."""
    u = table(spark, at, "usage_events").where("run_date is not null").select("run_date", "event_id", "total_tokens").distinct()
    last = u.groupBy("run_date").agg(F.max("event_id").alias("event_id"))
    second = u.join(last, ["run_date", "event_id"]).select("run_date", "event_id", "total_tokens")
    return K.upserted(u.where("event_id % 2 = 0").join(last.withColumnRenamed("event_id", "_l"), "run_date").where("event_id = _l").select("run_date", "event_id", "total_tokens"), second, ["run_date"], F.col("event_id"))


_BUCKET = "'{\"calls\": ' || (event_id % 7) || ', \"total_tokens\": ' || case event_id % 3 when 0 then 'null' else cast(event_id as string) end || '}'"


@query("select event_id, case when event_id % 5 < 3 then (event_id % 7) * 2 else 0 end::bigint as calls, 0::bigint as prompt_tokens, 0::bigint as completion_tokens, case when event_id % 5 < 3 and event_id % 3 > 0 then event_id * 2 else 0 end::bigint as total_tokens from events")
def r_a4_summed_buckets(spark, at):
    """Two models, a member that is no object, and days that are a list or broken."""
    text = F.expr(f"case event_id % 5 when 3 then '[1]' when 4 then 'broken' else '{{\"a\": ' || {_BUCKET} || ', \"x\": 5, \"b\": ' || {_BUCKET} || '}}' end")
    return L.summed_buckets(table(spark, at, "events").select("event_id", text.alias("by_model")), "by_model").drop("by_model")


@query(_RUNS + """, p as (select run_date, coalesce(bool_or(status = 'loaded'), false) as partial from b group by 1),
  m as (select coalesce(b.run_date, a.run_date) as run_date, coalesce(b.step, a.step) as step, case when b.step is null or (a.step is not null and b.status in ('skipped', 'loaded')) then a.status else b.status end as status,
    case when b.step is null or (a.step is not null and b.status in ('skipped', 'loaded')) then a.event_id else b.event_id end as event_id from a full join b on a.run_date is not distinct from b.run_date and a.step = b.step)
  select m.* from m join p on m.run_date is not distinct from p.run_date where p.partial union all select b.* from b join p on b.run_date is not distinct from p.run_date where not p.partial
  union all select a.* from a where not exists (select 1 from p where p.run_date is not distinct from a.run_date)""")
def r_c11_persisted(spark, at):
    return L.persisted_runs(*_run_sides(spark, at), ["run_date"])


@query("select strftime(d, '%Y-%m') as month, string_agg(strftime(d, '%Y-%m-%d'), ',' order by d desc) as days from (select distinct o_orderdate::date as d from orders) group by 1")
def r_a17_months(spark, at):
    """Days by month, the newest first; a month has at most 31."""
    days = table(spark, at, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.array_join(F.sort_array(F.collect_list(F.date_format("d", "yyyy-MM-dd")), asc=False), ",").alias("days"))
