"""Run analytics over keyed daily histories: rates, chronic failures, streaks, gaps, saturation, usage, merges, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scalars as S


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null, with the keys of the left side; right's other columns must be new."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how).drop(*[f"_r_{k}" for k in keys])


def recent(df: DataFrame, keys: list[str], day: str, window: int) -> DataFrame:
    """Rows of the last `window` calendar days up to the latest day of each key."""
    latest = df.groupBy(*keys).agg(F.max(day).alias("_latest")) if keys else df.agg(F.max(day).alias("_latest"))
    joined = same(df, latest, keys) if keys else df.join(F.broadcast(latest))  # one row
    return joined.where((F.datediff("_latest", day) < window) & (F.datediff("_latest", day) >= 0)).drop("_latest")


def success_rates(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., ok, total, rate) of rows with a boolean ok; keys without rows are absent."""
    return outcomes.groupBy(*keys).agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("total")).withColumn("rate", F.round(F.col("ok") / F.col("total"), 4))


def most_common(df: DataFrame, keys: list[str], value: str, day: str) -> DataFrame:
    """(keys..., value, n): the most frequent value of each key, ties to the one met first."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(day, value)).alias("_first"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("_first"), F.col(value))).alias("_b"))
    return best.select(*keys, F.col(f"_b.{value}").alias(value), (-F.col("_b.m")).alias("n"))


def chronic(outcomes: DataFrame, entity: str = "edition", window: int = 7, threshold: int = 3) -> DataFrame:
    """Subjects failing on `threshold` or more of an entity's last `window` days: (entity, subject, failures, dominant,
    window_days), where window_days is the number of days with a record in the window."""
    near = recent(outcomes, [entity], "day", window)
    days = near.groupBy(entity).agg(F.count_distinct("day").alias("window_days"))
    failed = near.where("outcome <> 'ok'")
    counts = failed.groupBy(entity, "subject").agg(F.count(F.lit(1)).alias("failures")).where(F.col("failures") >= threshold)
    worst = most_common(failed, [entity, "subject"], "outcome", "day").select(entity, "subject", F.col("outcome").alias("dominant"))
    return same(same(counts, worst, [entity, "subject"]), days, [entity])


def streak(days: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """(keys..., streak_days): consecutive days up to the latest one."""
    w = Window.partitionBy(*keys).orderBy(day)
    runs = days.select(*keys, day).distinct().withColumn("_island", F.date_sub(F.col(day), F.row_number().over(w)))
    sizes = runs.groupBy(*keys, "_island").agg(F.count(F.lit(1)).alias("_n"), F.max(day).alias("_last"))
    return sizes.groupBy(*keys).agg(F.max_by("_n", "_last").alias("streak_days"))


def missing_days(days: DataFrame, keys: list[str], day: str = "day", until: Column | None = None) -> DataFrame:
    """(keys..., day): days without a record between the first and last (or before `until`), from gaps, not a full spine."""
    w = Window.partitionBy(*keys).orderBy(day)
    steps = days.select(*keys, day).where(F.col(day).isNotNull()).distinct().withColumn("_next", F.lead(day).over(w))
    end = F.coalesce(F.col("_next"), until) if until is not None else F.col("_next")
    return steps.where(F.datediff(end, day) > 1).select(*keys, F.explode(F.sequence(F.date_add(F.col(day), 1), F.date_sub(end, 1))).alias(day))


def saturation(scores: DataFrame, entity: str, window: int = 30, least_rows: int = 30, high: float = 4.0, share: float = 0.9) -> DataFrame:
    """Entities whose scores of the last days are nearly all high: (entity, n, share_high, low, top, histogram)."""
    near = recent(scores.where("overall is not null"), [entity], "day", window)
    bins = near.groupBy(entity, F.format_string("%.1f", "overall").alias("bin")).agg(F.count(F.lit(1)).alias("c")).groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", "c")))).alias("histogram"))
    out = near.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("overall") >= high) / F.count(F.lit(1)), 4).alias("share_high"), F.min("overall").alias("low"), F.max("overall").alias("top"))
    return same(out.where((F.col("n") >= least_rows) & (F.col("share_high") >= share)), bins, [entity])


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share) over non-empty keys; the window runs over one row per key."""
    counts = df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))  # one row


def usage_events(events: DataFrame) -> DataFrame:
    """The usage ledger: calls once, null or zero usage left out, blank steps are 'other'."""
    once = events.dropDuplicates(["event_id"])
    total = S.usage_total(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return once.select("event_id", "edition", "run_date", F.coalesce(S.truthy(F.col("step")), F.lit("other")).alias("step"), F.coalesce("model", F.lit("")).alias("model"),
                       zero("prompt_tokens").alias("prompt_tokens"), zero("completion_tokens").alias("completion_tokens"), total.alias("total_tokens")).where("total_tokens > 0")



def usage_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]]


def usage_levels(ledger: DataFrame) -> DataFrame:
    """Totals, by step and by model in one pass: grouping sets ((), (step), (model))."""
    return ledger.groupingSets([[], [F.col("step")], [F.col("model")]], F.col("step"), F.col("model")).agg(*usage_sums(), F.grouping_id().alias("level"))


def run_status(results: DataFrame, keys: list[str], sources: list[str]) -> DataFrame:
    """(keys..., status) from (keys..., subject, ok), one row per subject; rows with a null subject stand for a run without
    results: unknown if that is all, failed if fewer than two of its sources are ok, success if all is, else partial."""
    is_source = F.col("subject").isin(sources)
    agg = results.groupBy(*keys).agg(F.count("subject").alias("_n"), F.count_if(is_source).alias("_s"), F.count_if(is_source & F.col("ok")).alias("_o"), F.bool_and("ok").alias("_all"))
    status = F.when(F.col("_n") == 0, "unknown").when((F.col("_s") > 0) & (F.col("_o") < 2), "failed").when(F.col("_all"), "success").otherwise("partial")
    return agg.select(*keys, status.alias("status"))


# Subjects of a day and the step whose alert concerns them; an alert of the gate concerns publishing.
ALERT_STEPS = {"hatena": "hatena", "hn": "hn", "reddit": "reddit", "security_blogs": "security_blogs", "rss": "rss", "telegram": "notify", "vault": "save", "deploy": "deploy"}
GATE = "invariants"


def observed(days: DataFrame, alerts: DataFrame, artifacts: DataFrame, day: str = "run_date") -> DataFrame:
    """(day, subject, outcome) of each day in days: the class of the subject's alert, else ok if its artifact is there; no row
    without either. alerts (day, step, error; error null for an alert without text: other), one per step; artifacts (day,
    subject). Where the gate stopped a day, publishing failed by it whatever else is there."""
    subjects = F.array(*[F.struct(F.lit(k).alias("subject"), F.lit(v).alias("step")) for k, v in ALERT_STEPS.items()])
    rows = days.select(day).distinct().select(day, F.explode(subjects).alias("_s")).select(day, "_s.subject", "_s.step")
    told = alerts.select(day, "step", S.classify_error(F.col("error")).alias("_class"))
    stopped = alerts.where(F.col("step") == GATE).select(day, F.lit("deploy").alias("subject"), F.lit(True).alias("_stopped"))
    there = artifacts.select(day, "subject").distinct().withColumn("_there", F.lit(True))
    out = rows.join(told, [day, "step"], "left").join(there, [day, "subject"], "left").join(stopped, [day, "subject"], "left")
    outcome = F.when(F.col("_stopped"), "invariant").otherwise(F.coalesce("_class", F.when(F.col("_there"), "ok")))
    return out.select(day, "subject", outcome.alias("outcome")).where("outcome is not null")


def runs(histories: dict[str, DataFrame], day: str = "run_date") -> DataFrame:
    """One row per day of any history, with a struct per history (null where it has none) and absent days between.

    The last row of a day wins in each history (column _ord).
    """
    spine = None
    for h in histories.values():
        dates = h.select(S.strict_date(F.col(day)).alias("day")).where(F.col("day").isNotNull())
        spine = dates if spine is None else spine.unionByName(dates)
    spine = spine.distinct()
    out = spine.withColumn("absent", F.lit(False)).unionByName(missing_days(spine, [], "day").withColumn("absent", F.lit(True))) if histories else spine
    for name, h in histories.items():
        rest = [c for c in h.columns if c not in (day, "_ord")]
        last = h.withColumn("day", S.strict_date(F.col(day))).where(F.col("day").isNotNull()).groupBy("day").agg(F.max_by(F.struct(*rest), "_ord").alias(name))
        out = out.join(last, "day", "left")
    return out


def cooled(findings: DataFrame, state: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Findings never reported, or not within the last `days`: state has (subject, last)."""
    joined = same(findings, state.select("subject", "last"), ["subject"], "left")
    return joined.where(F.col("last").isNull() | (F.datediff(today, "last") >= days)).drop("last")


def reported(state: DataFrame, subjects: DataFrame, today: Column) -> DataFrame:
    """State (subject, last) after the subjects were reported today."""
    now = subjects.select("subject").distinct().withColumn("last", today)
    return state.join(now, state["subject"].eqNullSafe(now["subject"]), "left_anti").select("subject", "last").unionByName(now)


def absent_days(days: DataFrame, today: Column, day: str = "day") -> DataFrame:
    """(day): days without a record from the first recorded one to the day before today; from gaps, not from a full spine."""
    w = Window.orderBy(day)
    steps = days.where(F.col(day).isNotNull() & (F.col(day) < today)).select(day).distinct().withColumn("_next", F.coalesce(F.lead(day).over(w), today))
    return steps.where(F.datediff("_next", day) > 1).select(F.explode(F.sequence(F.date_add(F.col(day), 1), F.date_sub("_next", 1))).alias(day))


def escalated(history: DataFrame, results: DataFrame, state: DataFrame, today: Column, window: int = 7, threshold: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One day observed: (history, findings to report, absent days to report, state), all to be written.

    history (day, subject, outcome) with the day's results in place of what it had; nothing observed leaves all as it is. Then
    chronic failures not reported within the window, and a stretch of absent days not reported before, known by its last day.
    """
    fresh = results.select(today.alias("day"), "subject", "outcome")
    any_result = fresh.select(F.lit(True).alias("_any")).limit(1)
    kept = history.join(any_result.withColumn("day", today), "day", "left").where("_any is null").select("day", "subject", "outcome")
    after = kept.unionByName(fresh)
    found = chronic(after.withColumns({"edition": F.lit(""), "ok": F.col("outcome") == "ok"}), "edition", window, threshold).drop("edition").join(F.broadcast(any_result)).drop("_any")  # one row
    new = cooled(found, state, today, window)
    gaps = absent_days(after, today).join(F.broadcast(any_result)).drop("_any")
    mark = gaps.agg(F.max("day").alias("_z")).where("_z is not null").select(F.concat(F.lit("absent:"), F.date_format("_z", "yyyy-MM-dd")).alias("subject"))
    unseen = mark.join(state.select("subject"), "subject", "left_anti")
    told = gaps.join(F.broadcast(unseen.withColumn("_new", F.lit(True)))).select("day")  # one row
    return after, new, told, reported(state, new.select("subject").unionByName(unseen), today)


def source_rates(outcomes: DataFrame, since: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """(keys..., subject, ok, total, rate) over all days; a subject in since only counts from that day on (rows without a
    day don't count for it)."""
    rows = outcomes
    for subject, first in since.items():
        rows = rows.where((F.col("subject") != subject) | F.coalesce(F.col("day") >= F.lit(first).cast("date"), F.lit(False)))
    return success_rates(rows, [*keys, "subject"])


def system_status(scores: DataFrame, outcomes: DataFrame, entity: str, since: dict[str, str]) -> DataFrame:
    """(entity, streak_days, series, rates): days in a row up to the last with a record (0 of none), scores by day, and
    (subject, rate, ok, total) by name; an entity with none of them has no row."""
    days = streak(outcomes.where("day is not null"), [entity])
    valid = scores.where("day is not null and overall is not null")
    series = valid.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "overall"))), lambda x: x["overall"]).alias("series"))
    rates = source_rates(outcomes, since, [entity]).groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("subject", "rate", "ok", "total"))).alias("rates"))
    every = days.select(entity).unionByName(series.select(entity)).unionByName(rates.select(entity)).distinct()
    out = same(same(same(every, days, [entity], "left"), series, [entity], "left"), rates, [entity], "left")
    return out.select(entity, F.coalesce("streak_days", F.lit(0)).alias("streak_days"), F.coalesce("series", F.array().cast("array<double>")).alias("series"), "rates")


# Words of the messages (%s: name of the feed, day, subject, days of the window, failures, class, advice).
CHRONIC_HEAD, CHRONIC_LINE = "⚠️ %s 慢性故障偵測（%s）\n\n", "• <b>%s</b>：近 %s 天失敗 %s 次（主要：%s）\n  ↳ %s"
ABSENT_HEAD, ABSENT_LINE = "🕳️ %s 缺席日偵測（%s）\n\n共 <b>%s</b> 天完全沒有產出，健康表不會顯示這些日子：\n", "• %s"


def escalation_text(findings: DataFrame, today: Column, advice: dict[str, str], feed: str = "feed") -> DataFrame:
    """(message): the chronic findings of a day, by subject, with the caller's advice against a class of failures."""
    says = F.create_map(*[F.lit(x) for pair in advice.items() for x in pair]) if advice else F.create_map(F.lit(""), F.lit(""))
    line = F.format_string(CHRONIC_LINE, F.col("subject"), F.col("window_days").cast("string"), F.col("failures").cast("string"), F.col("dominant"), F.coalesce(F.try_element_at(says, F.col("dominant")), F.lit("")))
    rows = findings.groupBy().agg(F.array_sort(F.collect_list(F.struct("subject", line.alias("t")))).alias("_l")).where(F.size("_l") > 0)
    return rows.select(F.concat(F.format_string(CHRONIC_HEAD, F.lit(feed), F.date_format(today, "yyyy-MM-dd")), F.array_join(F.transform("_l", lambda x: x["t"]), "\n")).alias("message"))


def absence_text(gaps: DataFrame, today: Column, feed: str = "feed") -> DataFrame:
    """(message): a stretch of absent days by its ends; no row of none."""
    d = lambda c: F.date_format(c, "yyyy-MM-dd")
    ends = gaps.agg(F.min("day").alias("a"), F.max("day").alias("z"), F.count(F.lit(1)).alias("n")).where("n > 0")
    span = F.when(F.col("n") > 1, F.concat_ws(" ~ ", d("a"), d("z"))).otherwise(d("a"))
    return ends.select(F.format_string(ABSENT_HEAD + ABSENT_LINE, F.lit(feed), d(today), F.col("n").cast("string"), span).alias("message"))
