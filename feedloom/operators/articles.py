"""Articles: cleaning, flattening, first- and last-wins, balanced picks, search, and the duplicate ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scalars as S


def clean(articles: DataFrame, popularity: list[Column], least: str = "**", order: Column | None = None) -> DataFrame:
    """Rows of at least a grade, with rank and the first popularity number that isn't 0 or null, in order of rank,
    popularity and arrival (unknown thresholds count as '**')."""
    rank = S.interest_rank(F.col("interest"))
    rows = articles.withColumns({"rank": rank, "popularity": F.coalesce(*[S.truthy(p, "int") for p in popularity], F.lit(0)).cast("long")})
    return rows.where(F.col("rank") >= S.threshold_rank(least)).orderBy(F.desc("rank"), F.desc("popularity"), order if order is not None else F.col("article_id"))


def pick(df: DataFrame, keys: list[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by order. Partial aggregation before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    pack = F.struct(*rest)
    best = (F.max_by if last else F.min_by)(pack, order)
    return df.groupBy(*keys).agg(best.alias("_p")).select(*keys, *[F.col(f"_p.`{c}`").alias(c) for c in rest])


def enumerated(df: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, first_order, number): distinct keys numbered from 0 by their first appearance.

    Numbers come from a distributed rank, not from one task that holds all keys.
    """
    from feedloom.operators.ranking import running

    firsts = df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(order).alias("first_order")).withColumn("_all", F.lit(1))
    return running(firsts, ["_all"], [F.col("first_order")], rank="_number").select(key, "first_order", (F.col("_number") - 1).alias("number"))


def round_robin(df: DataFrame, group: str, order: Column, n: int) -> DataFrame:
    """The first n rows taking one of each group in turn; groups in order of their first row. Only n rows of a group rank."""
    firsts = df.groupBy(group).agg(F.min(order).alias("_g"))
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("turn") <= n)
    return ranked.join(firsts, group).orderBy("turn", "_g").limit(n).drop("_g")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, salt: int = 16) -> DataFrame:
    """The first k rows of each group: first within salted parts of a group, then among their winners."""
    parts = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    near = parts.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("place") <= k)
    return near.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k).drop("_salt")


def keyword_search(df: DataFrame, fields: list[str], query: str) -> DataFrame:
    """Rows whose fields hold every word of the query in lower case; a blank query finds nothing."""
    words = query.lower().split()
    if not words:
        return df.limit(0)
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    for w in words:
        df = df.where(F.contains(hay, F.lit(w)))
    return df


def seen_before(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Anti-join on a key: rows whose non-empty key isn't in old."""
    return new.join(old.select(key).where(F.col(key) != "").distinct(), key, "left_anti")


def ledger(articles: DataFrame, key: str = "url", order: str = "article_id", day: str = "run_date", days: int = 7) -> DataFrame:
    """Decision per article with an address: kept, or url_seen with the date of what it repeats: the day itself for a later
    row of one day, else the day on which the address was last kept, if within the `days` before.

    Only kept rows are history, so an address comes through again once its last kept day is out of the window. That chain is
    a fold over the distinct days of one address, which are as many as the calendar has, not as there are rows.
    """
    rows = articles.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_d", S.strict_date(F.col(day))).where(F.col("_d").isNotNull())
    per_day = rows.groupBy(key, "_d").agg(F.min(order).alias("_first"))
    seen = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<struct<_d:date,_kept:date>>").alias("out"))

    def step(state: Column, d: Column) -> Column:
        repeats = state["last"].isNotNull() & (F.datediff(d, state["last"]) <= days)
        return F.struct(F.when(repeats, state["last"]).otherwise(d).alias("last"), F.concat(state["out"], F.array(F.struct(d.alias("_d"), F.when(repeats, state["last"]).alias("_kept")))).alias("out"))

    chain = per_day.groupBy(key).agg(F.array_sort(F.collect_list("_d")).alias("_ds")).select(key, F.explode(F.aggregate("_ds", seen, step)["out"]).alias("_o"))
    before = per_day.join(chain.select(key, F.col("_o._d").alias("_d"), F.col("_o._kept").alias("_prev")), [key, "_d"])
    joined = rows.join(before, [key, "_d"])
    repeat = F.col(order) != F.col("_first")
    date = F.when(repeat, F.col("_d")).otherwise(F.col("_prev"))
    return joined.select(order, key, day, F.when(date.isNotNull(), "url_seen").otherwise("kept").alias("decision"), date.alias("original_date"))


def in_window(history: DataFrame, today: Column, days: int = 7, day: str = "day") -> DataFrame:
    """History of the days before today, today left out: [today - days, today)."""
    return history.where((F.col(day) >= F.date_sub(today, days)) & (F.col(day) < today))


def decided(new: DataFrame, history: DataFrame, today: Column, days: int = 7, least: float = 0.8, key: str = "url", order: str = "ord", vector: str = "embedding") -> DataFrame:
    """(order, key, decision, original_date) of one day's rows with an address, against the kept rows (key, day, vector) of
    the window before today.

    In order: url_seen, today, for a later row of the same address; url_seen with the date of the address in the window;
    semantic_dup with the date of the most similar row of the window, if at least so similar; else kept. Rows of the day are
    never compared with each other by vector, and a row without a vector is kept.
    """
    from feedloom.operators.vectors import nearest

    rows = new.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1)
    near = in_window(history, today, days)
    dates = near.groupBy(key).agg(F.max("day").alias("_seen"))
    known = rows.join(dates, key, "left")
    asked = known.where("_first and _seen is null").select(F.col(order).alias("vec_id"), F.col(vector).alias("embedding"))
    stored = near.select(F.monotonically_increasing_id().alias("_n"), "day", F.col(vector).alias("embedding"))
    # Row numbers of the two sides must not meet: a query leaves out the row of its own number.
    found = nearest(asked, stored.select((-F.col("_n") - 1).alias("vec_id"), "embedding", "day"), 1, carry="day").select(F.col("query").alias(order), "similarity", F.col("carried").alias("_day"))
    out = known.join(found, order, "left")
    like = F.coalesce(F.col("similarity") >= least, F.lit(False))
    decision = F.when(~F.col("_first") | F.col("_seen").isNotNull(), "url_seen").when(like, "semantic_dup").otherwise("kept")
    return out.select(order, key, decision.alias("decision"), F.when(~F.col("_first"), today).otherwise(F.coalesce("_seen", F.when(like, F.col("_day")))).alias("original_date"))


def remembered(history: DataFrame, new: DataFrame, decisions: DataFrame, today: Column, key: str = "url", order: str = "ord", vector: str = "embedding") -> DataFrame:
    """History (key, day, vector) after a day: kept rows are put in or stamped anew with today; what was filtered is not."""
    kept = new.join(decisions.where("decision = 'kept'").select(order), order, "left_semi").select(key, today.alias("day"), F.col(vector).alias(vector))
    return history.join(kept.select(key), key, "left_anti").select(key, "day", vector).unionByName(kept)


def counters(decisions: DataFrame) -> DataFrame:
    c = F.col("decision")
    return decisions.groupBy("run_date").agg(F.count(F.lit(1)).alias("total"), F.count_if(c == "kept").alias("kept"), F.count_if(c == "url_seen").alias("filtered_url"), F.count_if(c == "semantic_dup").alias("filtered_semantic"))


def replayed(articles: DataFrame, kept: DataFrame, key: str = "url", order: str = "article_id", by: list[str] = ()) -> DataFrame:
    """A day's articles filtered again by the stored list of kept addresses, of each the first row: what the day itself gave."""
    return pick(articles.where(F.coalesce(F.col(key), F.lit("")) != "").join(kept.select(*by, key).distinct(), [*by, key], "left_semi"), [*by, key], F.col(order))
