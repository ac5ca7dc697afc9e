"""Totals over trailing periods from segment trees per entity and time shard (problem 6).

Days are cut into shards of SHARD days. Each entity has one small tree per shard in which it has an outcome: leaf i holds
the successes and failures of day i, each inner node the sums of its two children. The total of any period is read from
O(log SHARD) nodes of at most two neighbouring trees; a late correction changes one leaf and its ancestors only.
Trees are stored as rows, so they can be written, merged by key range and corrected without the raw history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.runtime import cut

#: Days per shard; a power of two, and at least the longest period, so that a period touches two shards at most.
SHARD = 64
_LONGS = T.ArrayType(T.LongType())


def calendar_day(text: Column) -> Column:
    """The date of a text that is exactly YYYY-MM-DD and a day of the calendar; else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


def daily_results(history: DataFrame) -> DataFrame:
    """(edition, subject, day, outcome): one row per outcome that counts.

    Of several records of one edition and day only the one recorded last counts, even if its results are null or empty;
    among records of the same time the one with more results, then the larger text of them (identical records are one).
    Records whose date isn't a calendar day in the form YYYY-MM-DD don't count; nor do null or empty outcomes and null or
    empty subjects. A null edition is an entity of its own.
    """
    rows = history.select("edition", calendar_day(F.col("run_date")).alias("day"), "recorded_at", "results").where(F.col("day").isNotNull())
    entries = F.array_sort(F.coalesce(F.transform(F.map_entries("results"), lambda e: F.struct(e["key"].alias("subject"), e["value"].alias("outcome"))), F.array()))
    last = rows.withColumn("_e", entries).groupBy("edition", "day").agg(F.max(F.struct(F.col("recorded_at"), F.size("_e").alias("n"), F.col("_e"))).alias("_l"))
    return last.select("edition", "day", F.explode("_l._e").alias("_x")).select(
        "edition", F.col("_x.subject").alias("subject"), "day", F.col("_x.outcome").alias("outcome")).where("outcome <> '' and subject <> ''")


def daily_outcomes(history: DataFrame) -> DataFrame:
    """(edition, subject, day, ok) of daily_results."""
    return daily_results(history).select("edition", "subject", "day", (F.col("outcome") == "ok").alias("ok"))


def _sums(leaves: np.ndarray) -> np.ndarray:
    """Trees of many rows at once: column 1 is the root, node k has the children 2k and 2k + 1, leaves come last."""
    rows = leaves.shape[0]
    tree = np.zeros((rows, 2 * SHARD), np.int64)
    tree[:, SHARD:] = leaves
    width = SHARD
    while width > 1:
        half = width // 2
        tree[:, half:width] = tree[:, width:2 * width:2] + tree[:, width + 1:2 * width:2]
        width = half
    return tree


def _shard_of(day: str) -> Column:
    return F.floor(F.unix_date(day) / SHARD).cast("int")


def _matrix(column: pa.Array) -> np.ndarray:
    """Trees of a column of lists, a row each; null is a tree of noughts."""
    out = np.zeros((len(column), 2 * SHARD), np.int64)
    there = ~np.asarray(column.is_null())
    out[there] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * SHARD)
    return out


def _lists(trees: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(trees) + 1, dtype=np.int32) * 2 * SHARD), pa.array(trees.ravel()))


def trees(outcomes: DataFrame, keys: list[str] = ("edition", "subject")) -> DataFrame:
    """(keys..., shard, ok, bad): one tree per entity and shard with an outcome. Repeated days add up."""
    day = F.unix_date("day")
    coded = outcomes.select(*keys, _shard_of("day").alias("shard"), (F.pmod(day, F.lit(SHARD)) * 2 + F.col("ok").cast("int")).cast("int").alias("_c"))
    held = coded.groupBy(*keys, "shard").agg(F.collect_list("_c").alias("_d"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days = batch.column(batch.num_columns - 1)
            rows, codes = len(days), days.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.repeat(np.arange(rows), np.asarray(days.value_lengths())) * SHARD + (codes >> 1)
            good = codes & 1 == 1
            both = [_lists(_sums(np.bincount(place[which], minlength=rows * SHARD).reshape(rows, SHARD))) for which in (good, ~good)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *both], names=schema.names)

    schema = T.StructType([*held.select(*keys, "shard").schema.fields, T.StructField("ok", _LONGS), T.StructField("bad", _LONGS)])
    return held.mapInArrow(grow, schema)


def changes(before: DataFrame, after: DataFrame, keys: list[str] = ("edition", "subject")) -> DataFrame:
    """(keys..., day, ok_change, bad_change): what turns the outcomes before into those after (both keys..., day, ok), as late
    records do; days on which nothing changes are left out."""
    one = lambda df, sign: df.select(*keys, "day", (F.col("ok").cast("long") * sign).alias("o"), ((~F.col("ok")).cast("long") * sign).alias("b"))
    both = one(before, -1).unionByName(one(after, 1)).groupBy(*keys, "day").agg(F.sum("o").alias("ok_change"), F.sum("b").alias("bad_change"))
    return both.where("ok_change <> 0 or bad_change <> 0")


def correct_trees(stored: DataFrame, corrections: DataFrame, keys: list[str] = ("edition", "subject")) -> DataFrame:
    """The trees that corrections (keys..., day, ok_change, bad_change) change, and only those, in their new form.

    A correction is expanded to its leaf and ancestors, log2(SHARD) + 1 nodes, summed per node, and added. Entities or shards
    seen for the first time get a tree. The shuffle is as large as the corrections and the trees they meet.
    """
    leaf = F.pmod(F.unix_date("day"), F.lit(SHARD)) + SHARD
    path = corrections.select(*keys, _shard_of("day").alias("shard"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(SHARD.bit_length() - 1)), lambda h: F.floor(leaf / F.pow(F.lit(2), h)).cast("int"))).alias("_k"), "ok_change", "bad_change")
    nodes = path.groupBy(*keys, "shard", "_k").agg(F.sum("ok_change").alias("o"), F.sum("bad_change").alias("b"))
    deltas = nodes.groupBy(*keys, "shard").agg(F.map_from_entries(F.collect_list(F.struct("_k", "o"))).alias("_o"), F.map_from_entries(F.collect_list(F.struct("_k", "b"))).alias("_b"))
    empty = F.array_repeat(F.lit(0).cast("long"), 2 * SHARD)

    def plus(column: str, change: str) -> Column:
        return F.transform(F.coalesce(F.col(column), empty), lambda v, i: v + F.coalesce(F.try_element_at(F.col(change), i), F.lit(0)))

    a, b = deltas.alias("a"), stored.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "shard"]]
    return a.join(b, same, "left").select(*[F.col(f"a.{k}").alias(k) for k in [*keys, "shard"]], plus("b.ok", "_o").alias("ok"), plus("b.bad", "_b").alias("bad"))


def corrected(stored: DataFrame, corrections: DataFrame, keys: list[str] = ("edition", "subject")) -> DataFrame:
    """All trees after late corrections: the changed ones anew, the others as they are."""
    changed = cut(correct_trees(stored, corrections, keys))
    a, b = stored.alias("a"), changed.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "shard"]]
    return a.join(b.select(*keys, "shard"), same, "left_anti").unionByName(changed.select(*stored.columns))


def write_trees(built: DataFrame, path: str) -> None:
    """Trees as a table in a folder, a part per time shard."""
    built.write.mode("overwrite").partitionBy("shard").parquet(path)


def apply_corrections(spark: SparkSession, path: str, corrections: DataFrame, keys: list[str] = ("edition", "subject")) -> None:
    """Correct stored trees: only the parts of time shards with a correction are read and written anew."""
    touched = [r[0] for r in corrections.select(_shard_of("day").alias("shard")).distinct().collect()]  # shards of time
    stored = spark.read.parquet(path).where(F.col("shard").isin(touched))
    after = cut(corrected(stored, corrections, keys))
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def _range_sum(tree: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums over leaves first..last (inclusive, per row and query) by climbing from both ends; empty where first > last."""
    rows = np.arange(tree.shape[0])[:, None]
    left, right = first + SHARD, last + SHARD + 1
    total = np.zeros(left.shape, np.int64)
    while True:
        live = left < right
        if not live.any():
            return total
        take = live & (left & 1 == 1)
        total += np.where(take, tree[rows, np.where(take, left, 0)], 0)
        left = left + take
        live = left < right
        take = live & (right & 1 == 1)
        right = right - take
        total += np.where(take, tree[rows, np.where(take, right, 0)], 0)
        left, right = np.where(left < right, left >> 1, left), np.where(left < right, right >> 1, left)


def _answers(keys: list[str], periods: tuple[int, ...]):
    """A map from (keys..., shard, ok, bad, _ok0, _bad0, _begin, _end), trees with those of the shard before, to a row per day."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            now, before = (_matrix(column["ok"]), _matrix(column["bad"])), (_matrix(column["_ok0"]), _matrix(column["_bad0"]))
            day = np.broadcast_to(np.arange(SHARD), (batch.num_rows, SHARD))
            begin, end = (np.asarray(column[c].fill_null(v)) for c, v in (("_begin", SHARD), ("_end", -1)))
            row, at = np.nonzero((day >= begin[:, None]) & (day <= end[:, None]))

            def over(which: int, days: int) -> np.ndarray:
                here = _range_sum(now[which], np.maximum(day - days + 1, 0), day)
                return here + _range_sum(before[which], np.where(day - days + 1 < 0, day - days + 1 + SHARD, SHARD), np.full(day.shape, SHARD - 1))

            found = [over(0, 1) + over(1, 1), *[over(which, p) for p in periods for which in (0, 1)]]
            on = (np.asarray(column["shard"])[row].astype(np.int32) * SHARD + at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[column[k].take(pa.array(row)) for k in keys], pa.array(on).cast(pa.date32()), *[pa.array(f[row, at]) for f in found]],
                                             names=[*keys, "day", "day_count", *[f"{x}_{p}" for p in periods for x in ("ok", "bad")]])

    return ask


def _every_shard(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The trees with those of shards without any outcome (null) between two with outcomes, and the days of each shard from
    the entity's first to its last outcome (_begin, _end). Trees that corrections left without outcomes don't count."""
    of = Window.partitionBy(*keys).orderBy("shard")
    known = stored.where(F.get("ok", F.lit(1)) + F.get("bad", F.lit(1)) > 0).withColumns({"_next": F.lead("shard").over(of), "_last_shard": F.lag("shard").over(of)})
    full = known.withColumn("_s", F.explode(F.sequence("shard", F.coalesce(F.col("_next") - 1, F.col("shard")))))
    real = F.col("_s") == F.col("shard")
    spread = full.select(*keys, F.col("_s").alias("shard"), F.when(real, F.col("ok")).alias("ok"), F.when(real, F.col("bad")).alias("bad"),
                         (real & F.col("_last_shard").isNull()).alias("_first"), (real & F.col("_next").isNull()).alias("_final"))
    filled = lambda pick: pick(F.filter(F.sequence(F.lit(0), F.lit(SHARD - 1)), lambda i: F.get("ok", i + SHARD) + F.get("bad", i + SHARD) > 0))
    return spread.withColumns({"_begin": F.when(F.col("_first"), filled(F.array_min)).otherwise(0), "_end": F.when(F.col("_final"), filled(F.array_max)).otherwise(SHARD - 1)})


def trailing(stored: DataFrame, keys: list[str] = ("edition", "subject"), periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """(keys..., day, day_count, ok_P, bad_P for each period P): every day from an entity's first to its last outcome.

    day_count is the number of outcomes on the day itself, 0 on days without one. Shards without any outcome between two
    with outcomes are filled in, so silent months have their days too. Shuffles trees, not days, once.
    """
    if max(periods) > SHARD:
        raise ValueError(f"a period is longer than a shard of {SHARD} days")
    of = Window.partitionBy(*keys).orderBy("shard")
    spread = _every_shard(stored, keys)
    ranged = spread.withColumns({
        "_ok0": F.when(F.lag("shard").over(of) == F.col("shard") - 1, F.lag("ok").over(of)), "_bad0": F.when(F.lag("shard").over(of) == F.col("shard") - 1, F.lag("bad").over(of))})
    names = ["day_count", *[f"{x}_{p}" for p in periods for x in ("ok", "bad")]]
    schema = T.StructType([*ranged.select(*keys).schema.fields, T.StructField("day", T.DateType()), *[T.StructField(n, T.LongType()) for n in names]])
    return ranged.select(*keys, "shard", "ok", "bad", "_ok0", "_bad0", "_begin", "_end").mapInArrow(_answers(list(keys), tuple(periods)), schema)


def with_averages(rows: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Add ok_avg_P and bad_avg_P: totals divided by the P days of the period, days without a record included."""
    return rows.withColumns({f"{x}_avg_{p}": F.round(F.col(f"{x}_{p}") / p, 6) for p in periods for x in ("ok", "bad")})


def silent_days(stored: DataFrame, keys: list[str] = ("edition", "subject")) -> DataFrame:
    """(keys..., on_day): days without an outcome between an entity's first and last one, as YYYY-MM-DD: the empty leaves of
    its trees, and all days of shards between without a tree."""
    empty = F.filter(F.sequence("_begin", "_end"), lambda i: F.coalesce(F.get("ok", i + SHARD) + F.get("bad", i + SHARD), F.lit(0)) == 0)
    rows = _every_shard(stored, keys).where("_begin <= _end").select(*keys, "shard", F.explode(empty).alias("_i"))
    return rows.select(*keys, F.date_format(F.date_from_unix_date((F.col("shard") * SHARD + F.col("_i")).cast("int")), "yyyy-MM-dd").alias("on_day"))
