"""Connected components by alternating stars, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.runtime import Workspace


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour of every node, partially aggregated before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node in edges (a, b): label is the least node of its component.

    Runs until a round changes nothing; RuntimeError if that takes more than most_rounds, never a part of the result.

    Each round links every node's larger neighbours, then its smaller ones, to the least node around it; rounds grow with
    the logarithm of the component's size. A hub is a key with many rows on one side of a join and one on the other, which
    adaptive execution splits. Null ends and self-edges are left out.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "components")
    now = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "round-0")
    mark = None
    for i in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = work.write(small, f"round-{i}")
        if i > 1:
            work.remove(f"round-{i - 1}")
        sign = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if sign == mark:
            break
        mark = sign
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
