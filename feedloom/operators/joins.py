"""Keyed joins whose build side is made unique first, so rows never multiply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.texts import title_key_of
from feedloom.operators.articles import pick
from feedloom.runtime import cut


def last_wins(probe: DataFrame, build: DataFrame, key: str, order: Column, columns: list[str], how: str = "left") -> DataFrame:
    """Join columns of the build row that comes last for each key."""
    return probe.join(pick(build.select(key, *columns, order.alias("_ord")).where(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), [key], F.col("_ord"), last=True).drop("_ord"), key, how)


def with_originals(scored: DataFrame, raw: DataFrame) -> DataFrame:
    """Scored rows with the original title and description (200 characters) of the raw row of either address, last one wins."""
    keyed = raw.select(F.explode(F.array("url", "alt_url")).alias("url"), "ord", F.struct("title", "description").alias("_raw")).where("url <> ''")
    best = keyed.groupBy("url").agg(F.max_by("_raw", "ord").alias("_raw"))
    return scored.join(best, "url", "left").withColumns({
        "original_title": F.nullif(F.col("_raw.title"), F.lit("")), "original_description": F.nullif(F.substring("_raw.description", 1, 200), F.lit(""))}).drop("_raw")


def matched_titles(lines: DataFrame, index: DataFrame, least: int = 8) -> DataFrame:
    """(line_id, url): the one address whose title equals the line's title in matching form; failing any equal title, the one
    address whose title holds it or is held by it, both of `least` characters or more; null where several addresses match.

    Containment candidates meet on fragments of `least` characters of the title form: all those of the longer text, and of the
    shorter one that which is rarest on the other side, so that a beginning that many titles share is no hot key. A title one of
    whose fragments is nowhere on the other side is held by none. Titles are compared once however many lines and addresses
    have them, and by number, so that the text isn't repeated for every fragment. No side of a join is broadcast: fragments are
    many times the rows that Spark takes them for.
    """
    sorted_ = lambda side: side.hint("merge")
    keyed = lines.select("line_id", title_key_of("title").alias("t"))
    known = index.where("url <> ''").select(title_key_of("title").alias("t"), "url")
    every = keyed.select("t", F.lit(None).cast("string").alias("url")).unionByName(known).where("t <> ''")
    # Titles without an address are those of lines that equal no title; their numbers are negative.
    told = every.groupBy("t").agg(F.min("url").alias("low"), F.max("url").alias("high")).withColumn("_id", F.monotonically_increasing_id())
    titles = cut(told.select(F.when(F.col("low").isNotNull(), F.col("_id")).otherwise(-1 - F.col("_id")).alias("id"), "t", "low", "high"))
    fragments = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - least + 1), lambda i: F.hash(F.substring(t, i, least))))
    # One shuffle, of two columns, which the counts and both joins read; Spark adds the test for null to the joins only.
    parts = titles.where((F.length("t") >= least) & F.col("id").isNotNull()).select("id", F.explode(fragments("t")).alias("g")).repartition("g")
    often = parts.groupBy("g").agg(F.count_if(F.col("id") >= 0).alias("_known"), F.count_if(F.col("id") < 0).alias("_asked")).where("_known > 0 and _asked > 0")
    others = F.when(F.col("id") >= 0, F.col("_asked")).otherwise(F.col("_known"))
    # A title whose fragments are all on the other side: as many matches as its size takes off.
    matches = parts.join(sorted_(often), "g").select("id", "g", others.alias("n"), F.lit(1).alias("c"))
    sizes = titles.where(F.length("t") >= least).select("id", F.lit(None).cast("int").alias("g"), F.lit(None).cast("long").alias("n"), (-F.size(fragments("t"))).alias("c"))
    rarest = matches.unionByName(sizes).groupBy(F.col("id").alias("short")).agg(F.sum("c").alias("_c"), F.min_by("g", "n").alias("g")).where("_c = 0").select("short", "g")
    meet = rarest.join(sorted_(parts.select(F.col("id").alias("long"), "g")), "g").where("(short < 0) <> (long < 0)").select("short", "long")
    end = lambda name: sorted_(titles.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("t", "low", "high"))))
    held = meet.join(end("short"), "short").join(end("long"), "long").where(F.contains("long_t", "short_t"))
    asked, known_ = (lambda c, n=n: F.when(F.col("short") < 0, F.col(f"{n[0]}_{c}")).otherwise(F.col(f"{n[1]}_{c}")) for n in (("short", "long"), ("long", "short")))
    near = held.select(asked("t").alias("t"), known_("low").alias("low"), known_("high").alias("high")).groupBy("t").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = titles.where("id >= 0").select("t", "low", "high", F.lit(True).alias("equal")).unionByName(near.withColumn("equal", F.lit(False)))
    some = lambda equal: (F.when(F.col("equal") == equal, F.col(c)) for c in ("low", "high"))
    one = lambda low, high: F.when(F.min(low) == F.max(high), F.min(low))
    return keyed.join(sorted_(found), "t", "left").groupBy("line_id").agg(F.when(F.max("equal"), one(*some(True))).otherwise(one(*some(False))).alias("url"))
