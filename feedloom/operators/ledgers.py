"""Ledgers of runs, tokens and alerts: the last entry of a step wins, a partial run is merged into its day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.articles import pick

# Statuses of steps that did nothing, sums of a usage row.
IDLE = ["skipped", "loaded"]
SUMS = ["calls", "prompt_tokens", "completion_tokens", "total_tokens"]
# Words of the table (%s: days, average; step, calls, tokens).
TABLE_HEAD, TABLE_COLUMNS, TABLE_MEAN, TABLE_STEP = "📊 Token 用量（近 %s 天）", "日期              呼叫          輸入          輸出          合計", "平均/天：%s tokens", "  %s%s 次  %s tokens"


def run_ledger(entries: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """(keys..., step, status, duration_seconds): the last entry of each step, durations rounded to three digits."""
    last = pick(entries.select(*keys, "step", "status", "duration_seconds", order.alias("_o")), [*keys, "step"], F.col("_o"), last=True)
    return last.select(*keys, "step", "status", F.bround("duration_seconds", 3).alias("duration_seconds"))


def _sides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by keys (null equals null): keys, and the other columns as structs _a and _b."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.struct(*rest).alias("_a"))
    b = new.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*rest).alias("_b"))
    both = a.join(b, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys], "full")
    return both.select(*[F.when(F.col("_b").isNull(), F.col(f"_a_{k}")).otherwise(F.col(f"_b_{k}")).alias(k) for k in keys], "_a", "_b")


def merged_runs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Steps (keys..., step, status, ...) of a day's stored run and of a partial one: a fresh step replaces the stored one,
    unless it did nothing and one is stored. Days with one run only keep it."""
    rest = [c for c in old.columns if c not in (*keys, "step")]
    both = _sides(old, new, [*keys, "step"])
    stay = F.col("_b").isNull() | (F.col("_a").isNotNull() & F.coalesce(F.col("_b.status").isin(IDLE), F.lit(False)))
    return both.select(*keys, "step", F.when(stay, F.col("_a")).otherwise(F.col("_b")).alias("_x")).select(*keys, "step", *[F.col(f"_x.{c}").alias(c) for c in rest])


def merged_usage_steps(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sums (keys..., step, SUMS) of a day's stored usage and of a partial run: a step run again replaces its sums."""
    both = _sides(old.select(*keys, "step", *SUMS), new.select(*keys, "step", *SUMS), [*keys, "step"])
    return both.select(*keys, "step", F.coalesce("_b", "_a").alias("_x")).select(*keys, "step", *[F.col(f"_x.{c}").alias(c) for c in SUMS])


def usage_totals(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., SUMS): totals computed anew from the merged steps."""
    return steps.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])


def merged_usage_models(old: DataFrame, new: DataFrame, old_steps: DataFrame, new_steps: DataFrame, keys: list[str]) -> DataFrame:
    """Sums (keys..., model, SUMS): the whole of the partial run's models is added on days on which it brought a step that
    was not stored; on other days the stored ones stay. Days without a stored run take the fresh ones."""
    on = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    brought = new_steps.join(old_steps, on(new_steps, old_steps, [*keys, "step"]), "left_anti").select(*keys).distinct()
    added = new.select(*keys, "model", *SUMS).join(brought, on(new, brought, keys), "left_semi")
    return old.select(*keys, "model", *SUMS).unionByName(added).groupBy(*keys, "model").agg(*[F.sum(c).alias(c) for c in SUMS])


def summed_buckets(days: DataFrame, buckets: str) -> DataFrame:
    """days with the sums of the buckets of a JSON object, column by column: members that are no objects are skipped, and
    missing, null and empty numbers count 0. What is no object has sums of 0."""
    v = F.try_parse_json(buckets)
    members = F.map_values(F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")), F.create_map().cast("map<string,variant>")))
    objects = F.filter(members, lambda b: F.schema_of_variant(b).startswith("OBJECT"))
    one = lambda c: F.aggregate(objects, F.lit(0).cast("long"), lambda s, b: s + F.coalesce(F.try_variant_get(b, f"$.{c}", "long"), F.lit(0).cast("long")))
    return days.withColumns({c: one(c) for c in SUMS})


def persisted_runs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored steps after a day's run: merged into what is stored where any of its steps was loaded, in its place else; days
    without a new run stay."""
    partial = builds_on_prior(new, keys)
    flagged = lambda df: _on(df, partial, keys)
    a, b = flagged(old), flagged(new)
    untouched, merged = a.where("partial is null").drop("partial"), merged_runs(a.where("partial").drop("partial"), b.where("partial").drop("partial"), keys)
    return untouched.select(*old.columns).unionByName(merged.select(*old.columns)).unionByName(b.where("not partial").select(*old.columns))


def _on(df: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    named = flags.select(*[F.col(k).alias(f"_f_{k}") for k in keys], "partial")
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys], "left").drop(*[f"_f_{k}" for k in keys])


def builds_on_prior(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., partial): whether any step of a run was loaded, so that the run is merged rather than stored whole."""
    return steps.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("status") == "loaded"), F.lit(False)).alias("partial"))


def alerts_recorded(alerts: DataFrame, failures: DataFrame, keys: list[str], forced: bool = False) -> DataFrame:
    """Alerts (keys..., step, error) with new failures, cut at 300 characters: a step already alerted that day keeps its
    alert unless forced. One failure per step."""
    new = failures.select(*keys, "step", F.substring("error", 1, 300).alias("error"))
    at = [*keys, "step"]
    if forced:
        return alerts.join(new, at, "left_anti").select(*at, "error").unionByName(new)
    return alerts.select(*at, "error").unionByName(new.join(alerts, at, "left_anti"))


def alerts_cleared(alerts: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Alerts without those of steps that were mended."""
    return alerts.join(done.select(*keys, "step"), [*keys, "step"], "left_anti")


def append_usage(events: DataFrame, path: str) -> None:
    """Add a run's calls to the ledger table: one row per call, none of zero usage, blank steps are 'other'. Accumulators are
    no ledger, since tasks that run again would count twice; readers drop repeated event_ids."""
    from feedloom.operators.health import usage_events

    usage_events(events).write.mode("append").partitionBy("run_date").parquet(path)


def usage_table(days: DataFrame, steps: DataFrame, last: int = 7) -> DataFrame:
    """(pos, line): the last days' sums, their average per day, and the latest day's steps by tokens, as lines of text.

    Sums come as (run_date, SUMS), one row per day, and (step, calls, total_tokens); only the last days are brought together.
    """
    text = lambda c: F.format_number(F.coalesce(c, F.lit(0)), 0)
    recent = days.orderBy(F.desc("run_date")).limit(last)
    n, total = F.count(F.lit(1)), F.sum("total_tokens")
    row = F.concat(F.rpad("run_date", 12, " "), F.lpad(F.col("calls").cast("string"), 6, " "), *[F.lpad(text(c), 12, " ") for c in map(F.col, SUMS[1:])])
    place = F.row_number().over(Window.orderBy("run_date"))
    body = recent.select((place + 2).alias("pos"), row.alias("line"))
    head = recent.agg(n.alias("n"), total.alias("t")).where("n > 0").select(F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.format_string(TABLE_HEAD, F.col("n").cast("string")).alias("line")), F.struct(F.lit(1).alias("pos"), F.lit("").alias("line")),
        F.struct(F.lit(2).alias("pos"), F.lit(TABLE_COLUMNS).alias("line")),
        F.struct(F.lit(1000).alias("pos"), F.format_string(TABLE_MEAN, text(F.floor(F.col("t") / F.col("n")))).alias("line")))).alias("x")).select("x.*")
    order = F.row_number().over(Window.orderBy(F.desc("total_tokens"), "step"))
    foot = steps.select((order + 1000).alias("pos"), F.format_string(TABLE_STEP, F.rpad("step", 12, " "), F.lpad(F.col("calls").cast("string"), 4, " "), F.lpad(text(F.col("total_tokens")), 12, " ")).alias("line"))
    return head.unionByName(body).unionByName(foot)
