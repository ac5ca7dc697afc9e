"""Ranks and running sums within groups of any size, without one task holding a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.runtime import cut


def running(df: DataFrame, keys: list[str], order: list[Column], weight: Column | None = None, rank: str = "_rank", total: str = "_before") -> DataFrame:
    """Add the 1-based rank in (keys, order) and the sum of weight over the rows before.

    The rows are range-partitioned by keys and order, so a group that holds a third of all rows is spread over many
    tasks; each task numbers its own pieces, and the pieces' sizes (at most partitions x groups in them) give the offsets.
    The ranged rows are written first: range bounds are sampled anew whenever a plan runs again.
    """
    names = [f"_o{i}" for i in range(len(order))]
    wide = df.withColumns({n: c for n, c in zip(names, [_plain(c) for c in order])}).withColumn("_w", F.coalesce(weight, F.lit(0)) if weight is not None else F.lit(1))
    sort = [*[F.col(k).asc_nulls_first() for k in keys], *[_direction(c, n) for c, n in zip(order, names)]]
    ranged = cut(wide.repartitionByRange(*sort).withColumn("_piece", F.spark_partition_id()))
    here = Window.partitionBy(*keys, "_piece").orderBy(*sort[len(keys):])
    pieces = ranged.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_piece") == F.col("_p")]
    numbered = ranged.withColumn("_r", F.row_number().over(here)).withColumn("_b", F.coalesce(F.sum("_w").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = numbered.join(offsets, on, "left")
    return joined.withColumns({rank: F.col("_r") + F.col("_n0"), total: F.col("_b") + F.col("_s0")}).drop(
        *names, "_w", "_piece", "_p", "_r", "_b", "_n0", "_s0", *[f"_k{i}" for i in range(len(keys))])


class Down:
    """Marks an ordering expression as descending, nulls last."""

    def __init__(self, column: Column):
        self.column = column


def _plain(c) -> Column:
    return c.column if isinstance(c, Down) else c


def _direction(c, name: str) -> Column:
    return F.col(name).desc_nulls_last() if isinstance(c, Down) else F.col(name).asc_nulls_last()
