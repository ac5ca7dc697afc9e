"""What surrounds a model call: the rows sent, the reply's rows taken by number, and everything else from trusted input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scalars as S

# Forms that replies must have (no other members).
COMPRESS_FORM, DIGEST_FORM = "themes array<string>, articles array<struct<id:bigint,one_liner:string>>", "digests array<struct<id:bigint,summary:string>>"


def sent(articles: DataFrame, group: list[str], order: Column, leave_out: tuple[str, ...] = ("comment_summary",)) -> DataFrame:
    """Articles as a model gets them: numbered from 0 in each group, without what it must not see."""
    number = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    return articles.withColumn("id", number).drop(*leave_out)


def told(replies: DataFrame, group: list[str], reply: str, items: str, field: str) -> DataFrame:
    """(group..., id, text): what replies say of each number: whole numbers only (true counts as 1), the first of each that
    isn't blank. Elements that are no objects, and replies that are no JSON objects with such a list, give nothing."""
    v = F.try_parse_json(reply)
    part = F.try_variant_get(v, f"$.{items}", "variant")
    listed = F.when(F.schema_of_variant(part).startswith("ARRAY"), F.try_variant_get(v, f"$.{items}", "array<variant>"))
    rows = replies.select(*group, F.posexplode(listed).alias("_at", "_e")).where(F.schema_of_variant("_e").startswith("OBJECT"))
    kind = F.schema_of_variant(F.try_variant_get("_e", "$.id", "variant"))
    number = F.when(kind == "BOOLEAN", F.try_variant_get("_e", "$.id", "boolean").cast("int").cast("long")).when(kind == "BIGINT", F.try_variant_get("_e", "$.id", "long"))
    words = F.when(F.schema_of_variant(F.try_variant_get("_e", f"$.{field}", "variant")) == "STRING", S.strip(F.try_variant_get("_e", f"$.{field}", "string")))
    good = rows.select(*group, "_at", number.alias("id"), words.alias("text")).where("id >= 0 and text <> ''")
    return good.groupBy(*group, "id").agg(F.min_by("text", "_at").alias("text"))


def rebuilt(numbered: DataFrame, replies: DataFrame, group: list[str], field: str, fallback: list[Column]) -> DataFrame:
    """Every row that was sent, with the reply's text for its number, else the first fallback that isn't empty, else ''.

    Numbers that were not sent are ignored, so no row is lost and none is made up.
    """
    return numbered.join(replies.withColumnRenamed("text", "_text"), [*group, "id"], "left").withColumn(field, S.first_truthy(F.col("_text"), *fallback, default="")).drop("_text")


def completed(digests: DataFrame, quality: DataFrame, again: Callable[[DataFrame], DataFrame], group: list[str], forced: bool = False) -> DataFrame:
    """Digests after at most one new try: groups whose completeness is below 3 are asked once more with the addresses they
    missed (again gets group and missed_urls); the others stay. A run asked for by hand is left alone."""
    if forced:
        return digests
    weak = quality.where("completeness < 3").select(*group, "missed_urls").join(digests.select(*group).distinct(), group, "left_semi")
    return digests.join(weak, group, "left_anti").unionByName(again(weak).select(*digests.columns))
