"""Keyed tables on plain files: idempotent upserts, partition overwrite, retention, insert-if-absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from feedloom.operators.articles import pick


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Old rows whose key isn't in new, and the new rows (the last by order per key)."""
    fresh = pick(new, keys, order, last=True) if order is not None else new.dropDuplicates(keys)
    return old.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.select(*old.columns))


def replace_days(df: DataFrame, path: str, day: str = "run_date") -> None:
    """Write only the days in df, whole; other days stay. A rerun of a day gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, first: str, last: str, schema: str, day: str = "run_date") -> DataFrame:
    """Rows of a range of days, by partition pruning; an absent table is an empty one with the schema."""
    try:
        return spark.read.parquet(path).where(F.col(day).between(first, last))
    except AnalysisException:
        return spark.createDataFrame([], schema)


def retained(df: DataFrame, day: str, today: Column, days: int) -> DataFrame:
    return df.where(F.col(day) >= F.date_sub(today, days))


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON list file; elements that aren't objects are skipped; a missing, corrupt or non-list file has none."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    items = text.select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    rows = items.where(F.trim("item").startswith("{")).select(F.from_json("item", schema).alias("r"))
    return rows.where("r is not null").select("r.*")
