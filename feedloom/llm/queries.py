"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, capping, history, languages, mixing, quantiles, textform, truncation

SHARES = [0.001, 0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
CURVE = [0.001, *[k / 100 for k in range(1, 100)], 0.999]
GROUP = ["step", "model"]


def _table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def p1_found(spark, at):
    labels = [r[0] for r in _table(spark, at, "sources").select("source").where("source is not null").distinct().collect()]
    return history.repeats(_table(spark, at, "articles"), labels)


def p2_found(spark, at):
    return textform.look_alikes(_table(spark, at, "articles"))


def p2_forms(spark, at):
    return textform.forms(_table(spark, at, "articles"))


def p3_month_percentiles(spark, at):
    """Every percentile and the outermost thousandths per month, step and model."""
    calls = quantiles.usage_calls(_table(spark, at, "usage_events").withColumn("month", F.substring("run_date", 1, 7)), "month")
    by = ["month", *GROUP]
    return quantiles.percentiles(quantiles.sketches(calls, by, "total_tokens"), by, CURVE)


def p3_month_rank_check(spark, at):
    calls = quantiles.usage_calls(_table(spark, at, "usage_events").withColumn("month", F.substring("run_date", 1, 7)), "month")
    by = ["month", *GROUP]
    return quantiles.rank_check(calls, quantiles.percentiles(quantiles.sketches(calls, by, "total_tokens"), by, SHARES), by, "total_tokens")


def p3_day_percentiles(spark, at):
    """Per day, step and model, from the day's own sketches."""
    calls = quantiles.usage_calls(_table(spark, at, "usage_events"), "run_date")
    by = ["run_date", *GROUP]
    return quantiles.percentiles(quantiles.sketches(calls, by, "total_tokens"), by, SHARES)


def p3_percentiles(spark, at):
    calls = quantiles.usage_calls(_table(spark, at, "usage_events"))
    return quantiles.percentiles(quantiles.sketches(calls, GROUP, "total_tokens"), GROUP, SHARES)


def p3_from_days(spark, at):
    """Sketches of days, kept as they would be stored, merged to one per step and model."""
    calls = quantiles.usage_calls(_table(spark, at, "usage_events"), "run_date")
    days = quantiles.sketches(calls, ["run_date", *GROUP], "total_tokens")
    return quantiles.percentiles(quantiles.merged(days, GROUP), GROUP, SHARES)


def p3_rank_check(spark, at):
    calls = quantiles.usage_calls(_table(spark, at, "usage_events"))
    estimates = quantiles.percentiles(quantiles.sketches(calls, GROUP, "total_tokens"), GROUP, SHARES)
    return quantiles.rank_check(calls, estimates, GROUP, "total_tokens")


def p4_found(spark, at):
    return truncation.found(truncation.judge(_table(spark, at, "articles")))


def p4_rates(spark, at):
    return truncation.rates(truncation.judge(_table(spark, at, "articles")))


def p5_source_share(spark, at):
    rows = _table(spark, at, "articles").select("article_id", "source", "score")
    return capping.capped(rows, capping.contributor(F.col("source")), "article_id", F.col("score"), max_share=0.1).select("contributor", "article_id", "score", "place")


def p5_host_share(spark, at):
    rows = _table(spark, at, "articles").select("article_id", "url", "score")
    return capping.capped(rows, capping.host(F.col("url")), "article_id", F.col("score"), max_share=0.1).select("contributor", "article_id", "score", "place")


def p5_source_count(spark, at):
    rows = _table(spark, at, "articles").select("article_id", "source", "score")
    return capping.capped(rows, capping.contributor(F.col("source")), "article_id", F.col("score"), max_count=100).select("contributor", "article_id", "score", "place")


def p5_digest_share(spark, at):
    """Digests by source key, the best by the score of the article at their address."""
    best = _table(spark, at, "articles").where("url <> ''").groupBy("url").agg(F.max("score").alias("score"))
    rows = _table(spark, at, "digests").select("digest_id", "source_key", "url").join(best, "url", "left")
    return capping.capped(rows, capping.contributor(F.col("source_key")), "digest_id", F.col("score"), max_share=0.25).select("contributor", "digest_id", "score", "place")


def p7_ids(spark, at):
    return bpe.encode(_table(spark, at, "documents"))


def _mix(spark, at):
    return mixing.select(_table(spark, at, "documents"), _table(spark, at, "mix_targets"))


def p8_selection(spark, at):
    return _mix(spark, at)[0]


def p8_shares(spark, at):
    return _mix(spark, at)[1]


def p8_bounds(spark, at):
    return mixing.within_bounds(_table(spark, at, "documents"), _table(spark, at, "mix_targets"))


def _languages(spark, at):
    return languages.detect(_table(spark, at, "documents"), _table(spark, at, "lang_samples"))


def p9_found(spark, at):
    return languages.wrong_or_missing(_languages(spark, at))


def p9_documents(spark, at):
    return languages.document_languages(_languages(spark, at))


def p9_segments(spark, at):
    return _languages(spark, at).select("doc_id", F.posexplode("found").alias("segment", "s")).select("doc_id", "segment", "s.lang", "s.confidence", "s.sentences", "s.words")


QUERIES = {f.__name__: f for f in (
    p1_found, p2_found, p2_forms, p3_month_percentiles, p3_month_rank_check, p3_day_percentiles, p3_percentiles, p3_from_days, p3_rank_check, p4_found, p4_rates, p5_source_share, p5_host_share, p5_source_count,
    p5_digest_share, p7_ids, p8_selection, p8_shares, p8_bounds, p9_found, p9_documents, p9_segments)}

_CALLS = """select distinct event_id, case when trim(coalesce(step, '')) = '' then 'other' else lower(trim(step)) end as step,
  split_part(lower(trim(coalesce(model, ''))), '@', 1) as model, total_tokens from usage_events"""


def _capped(rows: str, key: str, share: float | None = None, count: int | None = None) -> str:
    limit = f"select {count} as c" if count else f"""select coalesce(max(c), 0) as c from (
      select r.c, sum(least(n, r.c)) as t from counts, (select unnest(range(1, (select max(n) from counts) + 1)) as c) r group by r.c) where c <= {share} * t + 1e-9"""
    return f"""with rows as ({rows}), counts as (select contributor, count(*) as n from rows group by 1), cap as ({limit}),
    placed as (select *, row_number() over (partition by contributor order by score desc nulls last, {key}) as place from rows)
    select contributor, {key}, score, case when n > c then place end as place from placed join counts using (contributor), cap where place <= c"""


_SOURCE = "select lower(trim(coalesce(source, ''))) as contributor, article_id, score from articles"
_MONTHLY = _CALLS.replace("select distinct event_id,", "select distinct event_id, left(run_date, 7) as month,")
SQL = {
    "p8_bounds": """select mix_name, source, target_share, source in (select source from documents where text <> '' and source is not null) as has_documents, true as size_ok, true as repeats_ok from mix_targets""",
    "p3_month_rank_check": f"""with calls as ({_MONTHLY}) select month, step, model, share, count(*) as n, true as within
      from calls, (select unnest({SHARES})::double as share) where total_tokens is not null group by all""",
    "p3_rank_check": f"""with calls as ({_CALLS}) select step, model, share, count(*) as n, true as within
      from calls, (select unnest({SHARES})::double as share) where total_tokens is not null group by all""",
    "p5_source_share": _capped(_SOURCE, "article_id", share=0.1),
    "p5_source_count": _capped(_SOURCE, "article_id", count=100),
    "p5_host_share": _capped("""select regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.|\\.$', '') as contributor,
      article_id, score from articles""", "article_id", share=0.1),
    "p5_digest_share": _capped("""select lower(trim(coalesce(source_key, ''))) as contributor, digest_id, s.score from digests d
      left join (select url, max(score) as score from articles where url <> '' group by url) s on d.url = s.url""", "digest_id", share=0.25),
}
