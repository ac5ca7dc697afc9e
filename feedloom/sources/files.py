"""Raw feed files as a data source of Spark, and as binary files."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from feedloom.functions.scalars import strict_date


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, body) of raw feed files under a path: the file's name without its ending, and its text, whose broken
    characters are replaced."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("body"))


def day_reports(spark: SparkSession, root: str, name: str = "report.md") -> DataFrame:
    """(run_date, text) of the reports in folders named by a day, newest first; other folders, and days without a report,
    are left out."""
    found = spark.read.text(f"{root}/*/{name}", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run_date"), F.col("value").alias("text"))
    return found.where(strict_date(F.col("run_date")).isNotNull()).orderBy(F.desc("run_date"))


class Fetched(InputPartition):
    def __init__(self, name: str, at: str):
        self.name, self.at = name, at


class FeedReader(DataSourceReader):
    """Reads each source by itself, so sources run side by side and one that fails is a row with its error."""

    def __init__(self, options: dict):
        self.pattern = options.get("path", "")

    def partitions(self) -> list[Fetched]:
        return [Fetched(os.path.splitext(os.path.basename(p))[0], p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition: Fetched) -> Iterator[tuple]:
        if partition is None:  # no file matches
            return
        try:
            with open(partition.at, encoding="utf-8") as f:
                yield partition.name, f.read(), None
        except (OSError, UnicodeDecodeError) as problem:
            yield partition.name, None, str(problem)[:300]


class FeedSource(DataSource):
    """spark.read.format("feeds").option("path", "/folder/*.xml"): what a fetcher gives, as rows."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "source string, body string, error string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
