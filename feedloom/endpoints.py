"""The two questions that are asked of recent days, as functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import scalars as S
from feedloom.operators.articles import keyword_search, top_per_group


def _recent(digests: DataFrame, today: Column, days: int) -> DataFrame:
    """Rows of the days from today - days on; days + 1 of them, as both ends count."""
    return digests.withColumn("_d", S.strict_date(F.col("run_date"))).where(F.col("_d") >= F.date_sub(today, days))


def recent_briefs(digests: DataFrame, today: Column, days: int = 7, themes: int = 10) -> DataFrame:
    """(run_date, digest_count, themes), newest first: the first titles of each day, of which no more are ever collected."""
    rows = _recent(digests, today, days)
    counts = rows.groupBy("run_date").agg(F.count(F.lit(1)).alias("digest_count"))
    few = top_per_group(rows.where("title is not null").select("run_date", "ord", "digest_id", "title"), ["run_date"], [F.col("ord"), F.col("digest_id")], themes)
    listed = few.groupBy("run_date").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]).alias("themes"))
    return counts.join(listed, "run_date", "left").select("run_date", "digest_count", F.coalesce("themes", F.array().cast("array<string>")).alias("themes")).orderBy(F.desc("run_date"))


def search(digests: DataFrame, query: str, today: Column, days: int = 7) -> DataFrame:
    """(run_date, ord, digest_id, title, url) of recent digests that hold every word of the query, newest day first, then in
    the order of the day."""
    found = keyword_search(_recent(digests, today, days), ["title", "summary", "source_label"], query)
    return found.select("run_date", "ord", "digest_id", "title", "url").orderBy(F.desc("run_date"), "ord", "digest_id")
