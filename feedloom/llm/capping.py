"""Capping the records of dominant contributors (problem 5)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.ranking import Down, running
from feedloom.runtime import cut


def contributor(column: Column) -> Column:
    """One spelling per contributor: blanks around and letter case don't matter; null and blank are the contributor ''."""
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def host(url: Column) -> Column:
    """The host of an address without user, port, 'www.' and letter case; '' where there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(found, r"^www\.|\.$", "")


def share_limit(counts: DataFrame, share: float) -> int:
    """The largest count c with c <= share * sum(min(n_i, c)): water-filling over the sorted contributor counts.

    counts: one row per contributor with column n. Between two neighbouring counts the sum is linear in c, so the level is
    solved in the last span in which it still fits. Only the distinct counts are sorted: at most sqrt(2 * rows) of them.
    0 if no count fits (share below one over the number of contributors); the largest count if nobody exceeds the share.
    """
    if share >= 1:
        return int(counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0])
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = steps.select(
        "n", F.sum(F.col("n") * F.col("k")).over(upto).alias("below"), (F.sum("k").over(everyone.partitionBy()) - F.sum("k").over(upto)).alias("above"),
        (F.sum("k").over(everyone.partitionBy())).alias("m"), F.min("n").over(everyone.partitionBy()).alias("least"))
    fits = levels.where(F.col("n") <= F.lit(share) * (F.col("below") + F.col("above") * F.col("n")) + 1e-9)
    top = fits.agg(F.max_by(F.struct("n", "below", "above"), "n").alias("t"), F.max("n").alias("n")).first()
    if top.t is None:
        first = levels.agg(F.min_by(F.struct("m", "least"), "n").alias("t")).first()
        return 0 if first.t is None or share * first.t.m < 1 - 1e-12 else int(first.t.least)
    room = 1 - share * top.t.above
    if top.t.above == 0 or room <= 0:
        return int(top.t.n)
    return int(math.floor(share * top.t.below / room + 1e-9))


def capped(df: DataFrame, who: Column, key: str, score: Column | None, max_count: int | None = None, max_share: float | None = None) -> DataFrame:
    """The rows kept, with `contributor` and `place` (1 is the best of its contributor).

    A contributor keeps at most max_count rows, and at most max_share of all rows kept. Best score first, nulls last, ties
    by key ascending; repeated rows count each. Contributors within the limit keep all rows and are not ranked: their place
    is null. Only rows of the contributors above it are sorted, spread over many tasks however large one is.
    """
    rows = df.withColumns({"contributor": who, "_score": score if score is not None else F.lit(None).cast("double")})
    counts = cut(rows.groupBy("contributor").agg(F.count(F.lit(1)).alias("n")))
    limits = [x for x in (max_count, share_limit(counts, max_share) if max_share is not None else None) if x is not None]
    if not limits:
        return rows.withColumn("place", F.lit(None).cast("long")).drop("_score")
    above = counts.where(F.col("n") > min(limits)).select("contributor")
    whole = rows.join(above, "contributor", "left_anti").withColumn("place", F.lit(None).cast("long"))
    ranked = running(rows.join(above, "contributor", "left_semi"), ["contributor"], [Down(F.col("_score")), F.col(key)], rank="place")
    kept = ranked.where(F.col("place") <= min(limits)).withColumn("place", F.col("place").cast("long"))
    return whole.unionByName(kept.select(*whole.columns)).drop("_score")
