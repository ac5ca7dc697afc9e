"""Registry of the engine's own queries over the driver's tables, each with the SQL it must equal.

Names of the feed's operators begin with r_ and their number in the survey; p6_ are the trailing totals.
Queries without SQL use text transforms that SQL can't express; tests hold those against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.functions import scalars as S
from feedloom.operators import articles as A
from feedloom.operators import health as H
from feedloom.operators import joins as J
from feedloom.operators import judging as G
from feedloom.operators import reports as R
from feedloom.operators import rolling
from feedloom.operators import tables as K
from feedloom.operators import vectors as V
from feedloom.plans import stages
from feedloom.runtime import Workspace, cut
from feedloom.sources import feeds
from feedloom.streaming import daily

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


STEPS = "'hatena', 'hn', 'reddit', 'security_blogs', 'rss'"
SUBJECTS = ["hatena", "hn", "reddit", "security_blogs", "rss", "telegram", "vault", "deploy"]
RESULTS = """with valid as (select edition, try_cast(run_date as date) as d, results, recorded_at from health_history
    where regexp_full_match(run_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(run_date as date) is not null),
  latest as (select *, row_number() over (partition by edition, d order by recorded_at desc, cardinality(results) desc nulls last) as k from valid),
  pairs as (select edition, d, unnest(map_entries(results)) as e from latest where k = 1),
  outcomes as (select edition, e.key as subject, d as day, e.value as outcome, e.value = 'ok' as ok from pairs where e.value <> '' and e.key <> '')"""
DAYS = RESULTS + """, spans as (select edition, subject, min(day) as a, max(day) as z from outcomes group by 1, 2),
  days as (select edition, subject, unnest(generate_series(a::timestamp, z::timestamp, interval 1 day))::date as d from spans),
  filled as (select days.*, o.ok from days left join outcomes o on days.edition is not distinct from o.edition and days.subject = o.subject and days.d = o.day)"""
DATE = "case when regexp_full_match(run_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_cast(run_date as date) end"


def outcomes(spark, at):
    return rolling.daily_results(table(spark, at, "health_history")).withColumn("ok", F.col("outcome") == "ok")


# --- problem 6 ---------------------------------------------------------------------------------------------------

def _trailing(spark, at):
    return rolling.trailing(rolling.trees(rolling.daily_outcomes(table(spark, at, "health_history"))))


@query(DAYS + " select edition, subject, strftime(d, '%Y-%m-%d') as on_day from filled where ok is null")
def p6_found(spark, at):
    return rolling.silent_days(rolling.trees(rolling.daily_outcomes(table(spark, at, "health_history"))))


_TOTALS = DAYS + """ select *, round(ok_7 / 7, 6) as ok_avg_7, round(bad_7 / 7, 6) as bad_avg_7, round(ok_30 / 30, 6) as ok_avg_30, round(bad_30 / 30, 6) as bad_avg_30 from (
  select edition, subject, d as day, (ok is not null)::bigint as day_count,
    coalesce(sum(ok::int) over w7, 0)::bigint as ok_7, coalesce(sum((not ok)::int) over w7, 0)::bigint as bad_7,
    coalesce(sum(ok::int) over w30, 0)::bigint as ok_30, coalesce(sum((not ok)::int) over w30, 0)::bigint as bad_30 from filled
  window w7 as (partition by edition, subject order by d range between interval 6 day preceding and current row),
    w30 as (partition by edition, subject order by d range between interval 29 day preceding and current row))"""


@query(_TOTALS)
def p6_trailing(spark, at):
    return rolling.with_averages(_trailing(spark, at))


@query(_TOTALS)
def p6_corrected(spark, at):
    """Trees of the records written in time, corrected by those that came more than a day late; the totals are those of all."""
    history = table(spark, at, "health_history")
    late = F.coalesce(F.datediff("recorded_at", rolling.calendar_day(F.col("run_date"))) > 1, F.lit(False))
    before = rolling.daily_outcomes(history.where(~late))
    stored = cut(rolling.trees(before))
    return rolling.with_averages(rolling.trailing(rolling.corrected(stored, rolling.changes(before, rolling.daily_outcomes(history)))))


# --- scans and sinks ---------------------------------------------------------------------------------------------

@query("""select article_id, array_to_string(list_transform(list_filter(list_slice(string_split(comment_summary, '. '), 1, 10), lambda x: trim(x) <> '' and x not in ('[deleted]', '[removed]')),
  lambda x: left(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), 300)), '|') as comments from articles where comment_summary is not null""")
def r_s9_comments(spark, at):
    rows = table(spark, at, "articles").where("comment_summary is not null").select(F.col("article_id").alias("item_id"), F.split("comment_summary", r"\. ").alias("children"))
    return feeds.top_comments(rows).select(F.col("item_id").alias("article_id"), F.array_join("comments", "|").alias("comments"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events where json_extract_string(props, '$.k') is not null")
def r_s13_json_artifact(spark, at):
    v = F.try_parse_json("props")
    return table(spark, at, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k")).where("k is not null")


@query(f"select run_date, count(*) as n from health_history where {DATE} is not null group by 1")
def r_s16_day_folders(spark, at):
    return table(spark, at, "health_history").where(S.strict_date(F.col("run_date")).isNotNull()).groupBy("run_date").agg(F.count(F.lit(1)).alias("n"))


@query(f"select digest_id, run_date from (select *, {DATE} as d from digests) where d > (select max({DATE}) - 30 from digests)")
def r_s17_trailing_window(spark, at):
    rows = table(spark, at, "digests").withColumn("d", S.strict_date(F.col("run_date")))
    return H.recent(rows, [], "d", 30).select("digest_id", "run_date")


@query("select run_date, digest_id, title from digests where run_date = (select max(run_date) from digests)")
def r_s18_latest_day(spark, at):
    rows = table(spark, at, "digests")
    return rows.join(F.broadcast(rows.agg(F.max("run_date").alias("run_date"))), "run_date", "left_semi").select("run_date", "digest_id", "title")  # one row


@query("""with r as (select *, row_number() over (partition by url order by article_id desc) as k from articles where url <> '')
  select url, article_id, batch_no from r where k = 1""")
def r_k2_keyed_upsert(spark, at):
    """The archive, then the later batches, keyed by address: the last row of an address stays."""
    rows = table(spark, at, "articles").where("url <> ''").select("url", "article_id", "batch_no")
    old = A.pick(rows.where("batch_no = 0"), ["url"], F.col("article_id"), last=True)
    newer = K.upserted(old, rows.where("batch_no > 0"), ["url"], F.col("article_id"))
    return A.pick(newer.unionByName(old), ["url"], F.col("article_id"), last=True)


@query("select run_date, string_agg('- ' || coalesce(title, '') || ' ' || coalesce(url, ''), chr(10) order by ord, digest_id) as note from digests group by 1")
def r_k8_notes(spark, at):
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("url", F.lit(""))).alias("line")
    return R.joined(table(spark, at, "digests").select("run_date", "ord", "digest_id", line), "run_date", ["ord", "digest_id"]).select("run_date", F.col("text").alias("note"))


@query("""select url, 'ledger' as origin from (select distinct url from dedup_items where url <> '')
  union all select url, 'digest' from (select distinct url from digests where url <> '' and url not in (select url from dedup_items where url is not null))""")
def r_k12_insert_absent(spark, at):
    old = table(spark, at, "dedup_items").where("url <> ''").select("url").distinct().withColumn("origin", F.lit("ledger"))
    return K.inserted(old, table(spark, at, "digests").where("url <> ''").select("url").distinct().withColumn("origin", F.lit("digest")), ["url"])


@query("""with p as (select url, title, 1 as prio, digest_id as id from digests where url <> '' union all select url, title, 2, article_id from articles where url <> ''),
  r as (select *, row_number() over (partition by url order by prio, id) as k from p) select url, title, prio from r where k = 1""")
def r_k13_assembly(spark, at):
    """Digests over articles on the same address."""
    a = table(spark, at, "digests").where("url <> ''").select("url", "title", F.lit(1).alias("prio"), F.col("digest_id").alias("id"))
    b = table(spark, at, "articles").where("url <> ''").select("url", "title", F.lit(2).alias("prio"), F.col("article_id").alias("id"))
    return A.pick(a.unionByName(b), ["url"], F.struct("prio", "id")).select("url", "title", "prio")


# --- projections and filters --------------------------------------------------------------------------------------

@query("""select article_id, case interest when '***' then 3 else 2 end as rank, coalesce(nullif(score, 0), length(nullif(one_liner, '')), 0)::bigint as popularity
  from articles where interest in ('***', '**')""")
def r_p1_clean(spark, at):
    rows = table(spark, at, "articles")
    return A.clean(rows, [F.col("score"), F.length("one_liner").cast("long")]).select("article_id", "rank", "popularity")


@query("select run_date, source_key, count(*) as n from articles where interest = '***' group by 1, 2")
def r_p4_top_interest(spark, at):
    return table(spark, at, "articles").where("interest = '***'").groupBy("run_date", "source_key").agg(F.count(F.lit(1)).alias("n"))


@query("select run_date, count(*) as total, count(*) filter (coalesce(url, '') <> '') as with_url from articles group by 1")
def r_p6_empty_urls(spark, at):
    return table(spark, at, "articles").groupBy("run_date").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("url", F.lit("")) != "").alias("with_url"))


@query("select article_id, coalesce(title, '') as title, coalesce(url, '') as url, coalesce(one_liner, '') as one_liner, coalesce(original_title, '') as original_title from articles")
def r_p7_typed_view(spark, at):
    return table(spark, at, "articles").select("article_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "url", "one_liner", "original_title")])


@query("select digest_id, coalesce(nullif(source_key, ''), nullif(source_label, ''), '?') as source_key, coalesce(nullif(source_label, ''), nullif(source_key, ''), '?') as source_label from digests")
def r_p8_source_fallback(spark, at):
    k, v = F.col("source_key"), F.col("source_label")
    return table(spark, at, "digests").select("digest_id", S.first_truthy(k, v, default="?").alias("source_key"), S.first_truthy(v, k, default="?").alias("source_label"))


@query(f"select url, one_liner from articles where url <> '' and source_key in ({STEPS})")
def r_p10_slim(spark, at):
    return table(spark, at, "articles").where((F.col("url") != "") & F.col("source_key").isin(S.FETCH_STEPS)).select("url", "one_liner")


@query("select event_id, try_cast(json_extract(props, '$.k') as double) as k from events")
def r_p12_number_or_null(spark, at):
    return table(spark, at, "events").select("event_id", S.number_or_null(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")).alias("k"))


@query("select article_id, coalesce(starts_with(url, 'http://') or starts_with(url, 'https://'), false) as valid from articles")
def r_p16_valid_url(spark, at):
    return table(spark, at, "articles").select("article_id", S.is_valid_url(F.col("url")).alias("valid"))


@query(RESULTS + " select edition, subject, day, outcome from outcomes")
def r_p19_outcomes(spark, at):
    return rolling.daily_results(table(spark, at, "health_history"))




@query("""select i % 2 = 1 as a, i // 2 % 2 = 1 as b, i // 4 % 2 = 1 as c, i // 8 = 1 as d, case when not (i % 2 = 1) then case when i // 2 % 2 = 1 then 'LOAD' else 'SKIP' end
  when i // 4 % 2 = 1 or i // 8 = 1 or i // 2 % 2 = 0 then 'RUN' else 'LOAD' end as verdict from range(16) t(i)""")
def r_p28_verdict(spark, at):
    bits = spark.range(16).select(*[(F.shiftright("id", k) % 2 == 1).alias(n) for k, n in enumerate("abcd")])
    return bits.withColumn("verdict", S.run_verdict(*[F.col(n) for n in "abcd"]))


@query(f"""with d as (select run_date, unnest([{STEPS}]) as source_key from (select distinct run_date from articles))
  select d.run_date, d.source_key from d anti join articles a on d.run_date = a.run_date and d.source_key = a.source_key""")
def r_p32_empty_sources(spark, at):
    rows = table(spark, at, "articles").select("run_date", "source_key").distinct()
    wanted = rows.select("run_date").distinct().withColumn("source_key", F.explode(F.array(*map(F.lit, S.FETCH_STEPS))))
    return wanted.join(rows, ["run_date", "source_key"], "left_anti")


@query("""with n as (select run_date, count(*) as n from digests group by 1), v as (select d.*, row_number() over (partition by d.run_date, ord order by digest_id) as k from digests d join n using (run_date)
  where ord >= 0 and ord < n and trim(coalesce(summary, '')) <> '') select run_date, ord, digest_id from v where k = 1""")
def r_p33_valid_ids(spark, at):
    rows = table(spark, at, "digests")
    n = rows.groupBy("run_date").agg(F.count(F.lit(1)).alias("n"))
    good = rows.join(n, "run_date").where("ord >= 0 and ord < n and trim(coalesce(summary, '')) <> ''")
    return A.pick(good.select("run_date", "ord", "digest_id"), ["run_date", "ord"], F.col("digest_id"))


# --- joins --------------------------------------------------------------------------------------------------------

@query("select d.digest_id, coalesce(s.score, 0) as score from digests d left join (select url, max(score) as score from articles where url <> '' group by 1) s on d.url = s.url")
def r_j1_scores(spark, at):
    best = table(spark, at, "articles").where("url <> ''").groupBy("url").agg(F.max("score").alias("score"))
    return table(spark, at, "digests").select("digest_id", "url").join(best, "url", "left").select("digest_id", F.coalesce("score", F.lit(0)).alias("score"))


@query("""with k as (select unnest([url, replace(url, 'http://', 'https://')]) as u, article_id, title, original_description from articles), r as (select *, row_number() over (partition by u order by article_id desc) as n from k where u <> '')
  select d.digest_id, nullif(r.title, '') as original_title, nullif(left(r.original_description, 200), '') as original_description from digests d left join r on d.url = r.u and n = 1""")
def r_j2_originals(spark, at):
    raw = table(spark, at, "articles").select("url", F.replace("url", F.lit("http://"), F.lit("https://")).alias("alt_url"), F.col("article_id").alias("ord"), "title", F.col("original_description").alias("description"))
    return J.with_originals(table(spark, at, "digests").select("digest_id", "url"), raw).select("digest_id", "original_title", "original_description")


@query("""with r as (select *, row_number() over (partition by url order by article_id desc) as n from articles where url <> '')
  select d.digest_id, coalesce(nullif(r.original_title, ''), nullif(d.title, ''), '') as original, coalesce(r.comment_summary, '') as comment from digests d left join r on d.url = r.url and n = 1""")
def r_j3_pairs(spark, at):
    got = J.last_wins(table(spark, at, "digests").select("digest_id", "url", "title"), table(spark, at, "articles"), "url", F.col("article_id"), ["original_title", "comment_summary"])
    return got.select("digest_id", S.first_truthy(F.col("original_title"), F.col("title"), default="").alias("original"), F.coalesce("comment_summary", F.lit("")).alias("comment"))


@query("with r as (select *, row_number() over (partition by url order by article_id desc) as n from articles where url <> '' and comment_summary <> '') select url, comment_summary from r where n = 1")
def r_j4_comment_map(spark, at):
    rows = table(spark, at, "articles").where("url <> '' and comment_summary <> ''").select("url", "comment_summary", "article_id")
    return A.pick(rows, ["url"], F.col("article_id"), last=True).select("url", "comment_summary")


@query("select url, min(article_id) as article_id from articles where url <> '' and url in (select url from digests) group by 1")
def r_j6_kept_first(spark, at):
    rows = table(spark, at, "articles").where("url <> ''").join(table(spark, at, "digests").select("url").distinct(), "url", "left_semi")
    return A.pick(rows.select("url", "article_id"), ["url"], F.col("article_id"))


_VECTORS = "with v as (select vec_id::bigint as vec_id, embedding::double[] as e from embeddings), q as (select * from v where vec_id % 50 = 0)"


def _asked(spark, at):
    v = table(spark, at, "embeddings")
    return v.where("vec_id % 50 = 0"), v


@query(_VECTORS + """, s as (select q.vec_id as query, v.vec_id as neighbour, list_dot_product(q.e, v.e) as s from q, v where q.vec_id <> v.vec_id),
  r as (select *, row_number() over (partition by query order by round(s, 10) desc, neighbour) as place from s) select query, place::int as place, neighbour, round(s, 6) as similarity from r where place <= 3""")
def r_t4_nearest(spark, at):
    return V.nearest(*_asked(spark, at), 3)


@query("select count(*) filter (url not in (select url from articles where url is not null)) as missing, count(*) as n from (select distinct url from digests where url <> '')")
def r_j15_containment(spark, at):
    d = table(spark, at, "digests").where("url <> ''").select("url").distinct()
    a = table(spark, at, "articles").where("url <> ''").select("url").distinct().withColumn("_in", F.lit(True))
    return d.join(a, "url", "left").agg(F.count_if(F.col("_in").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))


_ONCE = "(select * from (select *, row_number() over (partition by event_id order by recorded_at) as k from usage_events) where k = 1)"

# --- aggregates ---------------------------------------------------------------------------------------------------

_USAGE = f"""with o as (select event_id, edition, run_date, coalesce(nullif(step, ''), 'other') as step, coalesce(model, '') as model, coalesce(prompt_tokens, 0) as prompt_tokens, coalesce(completion_tokens, 0) as completion_tokens,
  case when coalesce(total_tokens, 0) <> 0 then total_tokens else coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) end as total_tokens from {_ONCE}), l as (select * from o where total_tokens > 0)"""
_SUM = "count(*) as calls, coalesce(sum(prompt_tokens), 0)::bigint as prompt_tokens, coalesce(sum(completion_tokens), 0)::bigint as completion_tokens, coalesce(sum(total_tokens), 0)::bigint as total_tokens"


def _ledger(spark, at):
    return H.usage_events(table(spark, at, "usage_events"))


@query(_USAGE + f" select {_SUM} from l")
def r_a1_usage_totals(spark, at):
    return _ledger(spark, at).agg(*H.usage_sums())


@query(_USAGE + f" select step, {_SUM} from l group by 1")
def r_a2_usage_by_step(spark, at):
    return _ledger(spark, at).groupBy("step").agg(*H.usage_sums())


@query(_USAGE + f" select model, {_SUM} from l group by 1")
def r_a2_usage_by_model(spark, at):
    return _ledger(spark, at).groupBy("model").agg(*H.usage_sums())


@query(_USAGE + f" select step, model, {_SUM}, grouping(step, model)::bigint as level from l group by grouping sets ((), (step), (model))")
def r_a3_usage_levels(spark, at):
    return H.usage_levels(_ledger(spark, at))


@query(_USAGE + " select edition, run_date, total_tokens from (select edition, run_date, sum(total_tokens)::bigint as total_tokens from l group by 1, 2)")
def r_a4_usage_by_day(spark, at):
    return _ledger(spark, at).groupBy("edition", "run_date").agg(F.sum("total_tokens").alias("total_tokens"))


@query("select source_key, n, round(n / sum(n) over (), 6) as share from (select source_key, count(*) as n from digests where coalesce(source_key, '') <> '' group by 1)")
def r_a5_source_share(spark, at):
    return H.share_of_total(table(spark, at, "digests"), "source_key")


_RECENT = RESULTS + ", m as (select edition, max(day) as z from outcomes group by 1), near as (select o.* from outcomes o join m on o.edition is not distinct from m.edition where m.z - o.day < 7)"


@query(RESULTS + """, c as (select edition, outcome, count(*) as n, min(day) as f from outcomes where not ok group by 1, 2), b as (select *, row_number() over (partition by edition order by n desc, f, outcome) as k from c)
  select edition, outcome, n from b where k = 1""")
def r_a7_common_failure(spark, at):
    return H.most_common(outcomes(spark, at).where("not ok"), ["edition"], "outcome", "day")


@query(RESULTS + " select subject, count(*) filter (ok) as ok, count(*) as total, round(count(*) filter (ok) / count(*), 4) as rate from outcomes where subject <> 'deploy' or day >= date '2026-03-01' group by 1")
def r_a9_tracked_rates(spark, at):
    """All history; one subject only counts from the day its tracking began."""
    return H.success_rates(outcomes(spark, at).where("subject <> 'deploy' or day >= date '2026-03-01'"), ["subject"])


_OVERALL = RESULTS + ", s as (select edition, day, case when bool_and(ok) then 5.0 when count(*) filter (ok) * 2 >= count(*) then 4.0 else 2.0 end::double as overall from outcomes group by 1, 2)"


def _overall(spark, at):
    ok, n = F.count_if("ok"), F.count(F.lit(1))
    return outcomes(spark, at).groupBy("edition", "day").agg(F.when(F.bool_and("ok"), 5.0).when(ok * 2 >= n, 4.0).otherwise(2.0).alias("overall"))


@query("""select run_date, array_to_string(list_slice(list(category order by article_id), 1, 10), '|') as themes from (select *, row_number() over (partition by run_date order by article_id) as k from articles where category <> '') where k <= 10 group by 1""")
def r_a13_themes(spark, at):
    top = A.top_per_group(table(spark, at, "articles").where("category <> ''").select("run_date", "article_id", "category"), ["run_date"], [F.col("article_id")], 10)
    return top.groupBy("run_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_id", "category"))), lambda x: x["category"]), "|").alias("themes"))


@query(_USAGE + ", d as (select run_date, sum(total_tokens)::bigint as t from l group by 1 order by 1 desc limit 7) select (sum(t) // count(*))::bigint as per_day, count(*) as days from d")
def r_a14_tokens_per_day(spark, at):
    days = _ledger(spark, at).groupBy("run_date").agg(F.sum("total_tokens").alias("t")).orderBy(F.desc("run_date")).limit(7)
    return days.agg(F.floor(F.sum("t") / F.count(F.lit(1))).alias("per_day"), F.count(F.lit(1)).alias("days"))


@query("select count(distinct run_date) as days, count(distinct url) as urls, count(distinct source) as sources from articles")
def r_a15_distinct(spark, at):
    return table(spark, at, "articles").agg(F.count_distinct("run_date").alias("days"), F.count_distinct("url").alias("urls"), F.count_distinct("source").alias("sources"))


@query("select run_date, bool_or(coalesce(source_key, '?') = '?') as any_unknown from digests group by 1")
def r_a16_any(spark, at):
    return table(spark, at, "digests").groupBy("run_date").agg(F.bool_or(F.coalesce("source_key", F.lit("?")) == "?").alias("any_unknown"))


@query("select run_date, count(distinct source_key) as sources, count(distinct source_key) >= 2 as quorum from articles where source_key <> '' group by 1")
def r_a18_quorum(spark, at):
    n = F.count_distinct("source_key")
    return table(spark, at, "articles").where("source_key <> ''").groupBy("run_date").agg(n.alias("sources"), (n >= 2).alias("quorum"))


@query(RESULTS + ", f as (select distinct edition, subject || ': ' || outcome as m from outcomes where not ok) select edition, left(string_agg(m, '; ' order by m), 400) as message from f group by 1")
def r_a19_messages(spark, at):
    f = outcomes(spark, at).where("not ok").select("edition", F.concat("subject", F.lit(": "), "outcome").alias("m")).distinct()
    return f.groupBy("edition").agg(F.substring(F.array_join(F.array_sort(F.collect_list("m")), "; "), 1, 400).alias("message"))


# --- windows, sorts, sets -----------------------------------------------------------------------------------------

@query("select url, min(article_id) as first_order, row_number() over (order by min(article_id)) - 1 as number from articles where url <> '' group by 1")
def r_w3_enumerated(spark, at):
    return A.enumerated(table(spark, at, "articles"), "url", F.col("article_id"))


@query("select url, min(article_id) as article_id from articles where url <> '' group by 1")
def r_w4_first_wins(spark, at):
    return A.pick(table(spark, at, "articles").where("url <> ''").select("url", "article_id"), ["url"], F.col("article_id"))


@query(RESULTS + """, d as (select distinct edition, day from outcomes), i as (select edition, day, day - row_number() over (partition by edition order by day)::int as g from d),
  n as (select edition, g, count(*) as c, max(day) as z from i group by 1, 2) select edition, arg_max(c, z) as streak_days from n group by 1""")
def r_w5_streak(spark, at):
    return H.streak(outcomes(spark, at), ["edition"])


@query(RESULTS + """, d as (select distinct edition, day from outcomes), b as (select edition, min(day) as a, max(day) as z from d group by 1), s as (select edition, unnest(generate_series(a::timestamp, z::timestamp, interval 1 day))::date as day from b)
  select s.edition, s.day from s anti join d on s.edition is not distinct from d.edition and s.day = d.day""")
def r_w6_missing_days(spark, at):
    return H.missing_days(outcomes(spark, at), ["edition"])


@query("""with r as (select *, row_number() over (partition by source_key order by digest_id) as turn, min(digest_id) over (partition by source_key) as g from digests)
  select digest_id, turn from r order by turn, g limit 24""")
def r_w7_round_robin(spark, at):
    rows = table(spark, at, "digests").withColumn("_k", F.coalesce("source_key", F.lit("\0")))
    return A.round_robin(rows, "_k", F.col("digest_id"), 24).select("digest_id", "turn")


@query(_OVERALL + " select edition, array_to_string(list(strftime(day, '%Y-%m-%d') || '=' || overall::int order by day), ',') as series from s group by 1")
def r_w8_series(spark, at):
    s = _overall(spark, at).select("edition", F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("="), F.col("overall").cast("int").cast("string")).alias("v"))
    return s.groupBy("edition").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("series"))


@query("select run_date, b, count(*) as n from (select run_date, ((row_number() over (partition by run_date order by article_id) - 1) // 25)::bigint as b from articles where source_key = 'reddit') group by 1, 2")
def r_w9_batches(spark, at):
    w = Window.partitionBy("run_date").orderBy("article_id")
    return table(spark, at, "articles").where("source_key = 'reddit'").select("run_date", F.floor((F.row_number().over(w) - 1) / 25).alias("b")).groupBy("run_date", "b").agg(F.count(F.lit(1)).alias("n"))


@query("with r as (select *, row_number() over (partition by url order by article_id desc) as k from articles where url <> '') select url, article_id, run_date from r where k = 1")
def r_w13_last_wins(spark, at):
    return A.pick(table(spark, at, "articles").where("url <> ''").select("url", "article_id", "run_date"), ["url"], F.col("article_id"), last=True)


@query("with r as (select source_key, article_id, score, row_number() over (partition by source_key order by score desc nulls last, article_id) as place from articles) select source_key, article_id, score, place from r where place <= 10")
def r_t5_top_per_source(spark, at):
    rows = table(spark, at, "articles").select("source_key", "article_id", "score")
    return A.top_per_group(rows, ["source_key"], [F.col("score").desc_nulls_last(), F.col("article_id")], 10)


@query("select article_id, fetched_at from articles order by fetched_at desc, article_id limit 30")
def r_t6_newest(spark, at):
    return table(spark, at, "articles").select("article_id", "fetched_at").orderBy(F.desc("fetched_at"), "article_id").limit(30)


@query("""with a as (select source, article_id, coalesce(score, 0) as s from articles where source <> ''), m as (select source, max(s) as top from a group by 1),
  r as (select a.*, top, row_number() over (partition by a.source order by s desc, article_id) as place from a join m using (source)) select source, article_id, s from r where s >= 300 or (top < 300 and place <= 3)""")
def r_t8_threshold_or_top(spark, at):
    """Articles above the popularity threshold; the first three of sources that have none."""
    a = table(spark, at, "articles").where("source <> ''").select("source", "article_id", F.coalesce("score", F.lit(0)).alias("s"))
    low = a.groupBy("source").agg(F.max("s").alias("top")).where("top < 300")
    few = A.top_per_group(a.join(low.select("source"), "source", "left_semi"), ["source"], [F.desc("s"), F.col("article_id")], 3).drop("place")
    return a.where("s >= 300").unionByName(few)


@query("select url, 'digest' as origin from digests union all select url, 'ledger' from dedup_items")
def r_u1_union_all(spark, at):
    return table(spark, at, "digests").select("url", F.lit("digest").alias("origin")).unionByName(table(spark, at, "dedup_items").select("url", F.lit("ledger").alias("origin")))


@query("select run_date from digests union select run_date from dedup_items union select run_date from usage_events")
def r_u2_union_days(spark, at):
    d = lambda n: table(spark, at, n).select("run_date").distinct()
    return d("digests").union(d("dedup_items")).union(d("usage_events")).distinct()


@query("select run_date from usage_events except select run_date from digests")
def r_u3_except(spark, at):
    return table(spark, at, "usage_events").select("run_date").distinct().subtract(table(spark, at, "digests").select("run_date"))


@query("select run_date from usage_events intersect select run_date from digests")
def r_u4_intersect(spark, at):
    return table(spark, at, "usage_events").select("run_date").distinct().intersect(table(spark, at, "digests").select("run_date"))


# --- scalars and texts --------------------------------------------------------------------------------------------

@query(f"select edition, recorded_at, {DATE} as strict, case when regexp_full_match(run_date, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then try_cast(run_date as date) end as loose from health_history")
def r_x22_dates(spark, at):
    return table(spark, at, "health_history").select("edition", "recorded_at", S.strict_date(F.col("run_date")).alias("strict"), S.loose_date(F.col("run_date")).alias("loose"))


@query("select distinct o_orderdate::date as day, (o_orderdate::date - date '0001-01-01')::bigint + 1 as ordinal from orders")
def r_x24_ordinals(spark, at):
    return table(spark, at, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", S.day_number(F.col("day")).cast("long").alias("ordinal"))


@query("""select event_id, case when value <= 0 then '—' when floor(value * 60 / 60) < 60 then floor(value * 60 / 60)::bigint || 'm' else (floor(value * 60 / 60)::bigint // 60) || ':' || lpad((floor(value * 60 / 60)::bigint % 60)::varchar, 2, '0') end as lasted from events""")
def r_x25_durations(spark, at):
    return table(spark, at, "events").select("event_id", S.duration_text(F.col("value") * 60).alias("lasted"))


@query(f"""select event_id, case when coalesce(total_tokens, 0) <> 0 then total_tokens else coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) end as total from {_ONCE}""")
def r_x27_usage_total(spark, at):
    rows = table(spark, at, "usage_events").dropDuplicates(["event_id"])
    return rows.select("event_id", S.usage_total(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens")).alias("total"))


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) as length from embeddings")
def r_x29_unit_vectors(spark, at):
    u = V.unit(F.transform("embedding", lambda x: x * 3))
    return table(spark, at, "embeddings").select("vec_id", F.round(F.sqrt(V.dot(u, u)), 4).alias("length"))


@query("""select source_key as source, count(*) as n from articles where source_key is not null group by 1""")
def r_p5_flatten(spark, at):
    """Articles packed as one JSON list per day and source, and flattened again."""
    rows = table(spark, at, "articles").where("source_key is not null")
    packed = rows.groupBy(F.col("source_key").alias("source"), "run_date", F.pmod("article_id", F.lit(64)).alias("_part")).agg(F.to_json(F.collect_list(F.struct("article_id"))).alias("articles"))
    return G.flattened(packed).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id, case when event_type = 'error' then null else value end as relevance, case when event_type = 'click' then 1 else 0 end as missed, case when event_type = 'view' then 4.5 else 0 end::double as overall from events""")
def r_p13_quality_view(spark, at):
    kind, value = F.col("event_type"), F.col("value")
    reply = F.concat(
        F.lit('{"relevance": {"score": '), F.when(kind == "error", "true").otherwise(value.cast("string")), F.lit('}, "completeness": {"missed_urls": ['), F.when(kind == "click", '"u"').otherwise(""), F.lit("]}"),
        F.when(kind == "view", ', "overall": 4.5').otherwise(""), F.lit("}"))
    return G.quality_view(table(spark, at, "events").select("event_id", reply.alias("reply"))).select("event_id", "relevance", F.size("missed_urls").alias("missed"), "overall")


@query("""with d as (select run_date, (count(*) % 5)::double as a, case when count(*) % 3 = 0 then null else (count(*) % 4)::double end as b, null::double as c from digests group by 1)
  select run_date, round(list_avg(list_filter([a, b, c], lambda x: x is not null)), 1) as overall from d""")
def r_a11_overall(spark, at):
    n = F.count(F.lit(1))
    d = table(spark, at, "digests").groupBy("run_date").agg((n % 5).cast("double").alias("relevance"), F.when(n % 3 != 0, (n % 4).cast("double")).alias("completeness"), F.lit(None).cast("double").alias("faithfulness"))
    return d.select("run_date", G.overall_mean().alias("overall"))


@query("select run_date, digest_id from digests d where not exists (select 1 from dedup_items i where i.run_date = d.run_date and i.url = d.url)")
def r_k10_undelivered(spark, at):
    messages = table(spark, at, "digests").select("run_date", F.col("url").alias("message_id"), "digest_id")
    done = table(spark, at, "dedup_items").select("run_date", F.col("url").alias("message_id"))
    return G.undelivered(messages, done).select("run_date", "digest_id")


# --- composites, seams and streams --------------------------------------------------------------------------------

@query("select doc_id, left(split_part(text, '.', 1), 200) as value from documents where text is not null")
def r_d1_model_seam(spark, at):
    """The model seam with its deterministic stand-in."""
    rows = stages.complete(table(spark, at, "documents").where("text is not null").select("doc_id", "text"), "text", "r")
    return rows.select("doc_id", F.col("r.value").alias("value"))


def _closed_windows(spark, at, **windows):
    work = Workspace(spark, "stream")
    schema = table(spark, at, "events").schema
    folder = f"{work.path}/in"
    table(spark, at, "events").repartition(4).write.parquet(folder)
    counts = daily.daily_counts(daily.stream(spark, folder, schema), ["event_type"], late="1 day", **windows)
    counts.writeStream.format("parquet").option("path", f"{work.path}/out").option("checkpointLocation", f"{work.path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{work.path}/out").select(F.date_format("start", "yyyy-MM-dd").alias("first_day"), "event_type", "n")


@query("select strftime(d, '%Y-%m-%d') as first_day, event_type, count(*) as n from (select date_trunc('day', ts) as d, event_type from events) where d + interval 1 day <= (select max(ts) - interval 1 day from events) group by 1, 2")
def r_r3_daily_stream(spark, at):
    """Closed daily windows of the events stream, one pass over what is there."""
    return _closed_windows(spark, at)


@query("""select strftime(w, '%Y-%m-%d') as first_day, event_type, count(*) as n from (select date_trunc('day', ts) - to_days(k::int) as w, event_type from events, range(7) t(k)) where w + interval 7 day <= (select max(ts) - interval 1 day from events) group by 1, 2""")
def r_r3_sliding_stream(spark, at):
    """Closed windows of seven days, one beginning every day."""
    return _closed_windows(spark, at, days="7 days", slide="1 day")


from feedloom import queries_feeds, queries_reports, queries_state  # noqa: E402, F401  (they register themselves here)
