"""Queries of feeds, pages, endpoints and deliveries, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import endpoints
from feedloom.functions import scalars as S
from feedloom.operators import articles as A
from feedloom.operators import health as H
from feedloom.operators import judging as G
from feedloom.operators import reports as R
from feedloom.queries import DATE, query, table
from feedloom.queries_reports import lines_sql
from feedloom.sources import feeds

_PLAIN = "trim(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9 ]', '', 'g'))"


def _plain(spark, at):
    return table(spark, at, "articles").select("article_id", "source_key", F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z0-9 ]", "")).alias("t"), F.col("article_id").cast("string").alias("i"))


@query(f"""select article_id, case when article_id % 5 = 4 then '' else trim(t || ' & more') end as title, case when article_id % 5 = 4 then '' else 'https://h.test/?a=' || article_id || '&b=1' end as url,
  case when article_id % 5 = 4 then '' else trim(left(t || ' end', 200)) end as description, case when article_id % 5 = 2 and article_id % 3 > 0 then article_id % 50 else 0 end as bookmarks, case when article_id % 5 = 4 then 'no items' end as error from (select article_id, {_PLAIN} as t from articles)""")
def r_s1_rss_items(spark, at):
    """A document per article: RSS with CDATA and with entities, RDF with bookmarks (some no number), Atom, and broken ones."""
    k, i, t = F.col("article_id") % 5, F.col("i"), F.col("t")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    link = c("https://h.test/?a=", i, "&amp;b=1")
    rss = lambda text: c('<rss version="2.0"><channel><item><title>', t, " &amp; more</title><link> ", link, " </link><description>", text, "</description></item></channel></rss>")
    body = F.when(k == 0, rss(c("<![CDATA[<p>", t, " <b>end</b></p>]]>"))).when(k == 1, rss(c("&lt;i&gt;", t, "&lt;/i&gt; end"))).when(k == 2, c(
        '<rdf:RDF xmlns:rdf="r" xmlns:hatena="h"><item><title>', t, " &amp; more</title><link>", link, "</link><description>", t, " end</description><hatena:bookmarkcount>", F.when(F.col("article_id") % 3 > 0, (F.col("article_id") % 50).cast("string")).otherwise("many"), "</hatena:bookmarkcount></item></rdf:RDF>")).when(k == 3, c(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>', t, ' &amp; more</title><link href="', link, '"/><summary>', t, " end</summary></entry></feed>")).otherwise("<rss><channel><item><ti")
    items = feeds.rss_items(_plain(spark, at).select(i.alias("source"), body.alias("body")))
    return items.select(F.col("source").cast("long").alias("article_id"), F.trim("title").alias("title"), "url", F.trim("description").alias("description"), "bookmarks", "error")


@query(f"""with r as (select source_key, article_id, {_PLAIN} as t, row_number() over (partition by source_key order by article_id) as n from articles where source_key is not null)
  select source_key as source, (n - 1)::int as ord, trim('x' || t) as title from r where n <= 10""")
def r_s7_first_ten(spark, at):
    """A feed of fifteen items per fetch step, of which ten are taken."""
    few = A.top_per_group(_plain(spark, at).where("source_key is not null"), ["source_key"], [F.col("article_id")], 15)
    docs = few.groupBy(F.col("source_key").alias("source")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: F.concat(F.lit("<item><title>x"), x["t"], F.lit("</title></item>"))), ""), F.lit("</channel></rss>")).alias("body"))
    return feeds.rss_items(docs, per_feed=10).select("source", "ord", F.trim("title").alias("title"))


@query(f"""with r as (select source_key, article_id, {_PLAIN} as t, row_number() over (partition by source_key order by article_id) as n from articles where source_key is not null)
  select source_key as source, article_id::varchar as item, (n - 1)::int as ord, trim('x' || t) as title, case when article_id % 3 = 0 then 'https://news.ycombinator.com/item?id=' || article_id else 'https://h.test/' || article_id end as url,
    case when article_id % 4 = 0 then 0 else article_id % 100 + 2 end as score, case when article_id % 5 = 0 then 0 else article_id % 30 end as comments from r where n <= 30""")
def r_s2_front_page(spark, at):
    """A front page of thirty items per fetch step; some link to themselves, some have no points or no comments yet."""
    a, i = F.col("article_id"), F.col("i")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    row = c('<tr class="athing submission" id="', i, '"><td><span class="titleline"><a href="', F.when(a % 3 == 0, c("item?id=", i)).otherwise(c("https://h.test/", i)), '"> x', F.col("t"), "</a></span></td></tr><tr><td>",
            F.when(a % 4 != 0, c('<span class="score" id="score_', i, '">', (a % 100 + 2).cast("string"), " points</span>")).otherwise(""), F.when(a % 5 != 0, c('<a href="item?id=', i, '">', (a % 30).cast("string"), "&nbsp;comments</a>")).otherwise('<a href="item">discuss</a>'), "</td></tr>")
    few = A.top_per_group(_plain(spark, at).where("source_key is not null"), ["source_key"], [F.col("article_id")], 30).withColumn("r", row)
    pages = few.groupBy(F.col("source_key").alias("source")).agg(c("<table>", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "r"))), lambda x: x["r"]), "\n"), "</table>").alias("html"))
    return feeds.front_page(pages).select("source", "item", "ord", "title", "url", "score", "comments")


def _render(url: str) -> tuple[str, str]:
    """Stands in for a browser."""
    if "/0" in url:
        raise TimeoutError("no answer")
    return f"<p>{url}</p>" * 200, url[-3:]


@query("select url, case when contains(url, '/0') then null else left(repeat('<p>' || url || '</p>', 200), 8000) end as html, case when contains(url, '/0') then null else right(url, 3) end as title, case when contains(url, '/0') then 'no answer' end as error from (select distinct url from digests where url <> '')")
def r_s4_pages(spark, at):
    return feeds.rendered(table(spark, at, "digests").where("url <> ''").select("url").distinct(), _render)


@query("""select article_id, case when article_id % 4 = 0 then 'hn' when article_id % 4 = 1 then 'reddit' when article_id % 4 = 2 then 'twitter' else 'general' end as kind, case when article_id % 4 = 0 then 'T' || article_id when article_id % 4 = 1 then 'https://www.reddit.com/r/a/comments/' || article_id when article_id % 4 = 2 then '[Twitter/X]' else 'https://h.test/' || article_id end as title,
  case when article_id % 4 = 0 then '' when article_id % 4 = 1 then 'own' when article_id % 4 = 2 then '' else left(coalesce(original_description, ''), 4000) end as content, case when article_id % 4 = 0 then 'one' || chr(10) || 'five' when article_id % 4 = 1 then repeat('b', 500) || chr(10) || 'two' else '' end as comments from articles""")
def r_s11_link_contents(spark, at):
    url = F.expr("case article_id % 4 when 0 then 'https://news.ycombinator.com/item?id=' || article_id when 1 then 'https://www.reddit.com/r/a/comments/' || article_id when 2 then 'https://x.com/' || article_id else 'https://h.test/' || article_id end")
    body = F.expr("""case article_id % 4 when 0 then '{"title": "T' || article_id || '", "text": null, "children": [{"text": "one"}, {"text": ""}, {"text": null}, {}, {"text": "five"}, {"text": "six"}]}'
      when 1 then '[{"data": {"children": [{"data": {"selftext": "own"}}]}}, {"data": {"children": [{"data": {"body": "' || repeat('b', 600) || '"}}, {"data": {}}, {"data": {"body": "two"}}, {}, {}, {}, {}, {}, {"data": {"body": "nine"}}]}}]' else original_description end""")
    got = feeds.link_contents(table(spark, at, "articles").select(url.alias("url"), body.alias("body")))
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("article_id"), "kind", "title", "content", "comments")


@query("""select article_id, array_to_string(list_transform(list_filter(list_slice(string_split(comment_summary, '. '), 1, 10), lambda x: trim(x) <> '' and x not in ('[deleted]', '[removed]')), lambda x: left(x, 300)), '|') as comments from articles where comment_summary is not null""")
def r_s10_comments_with_tags(spark, at):
    rows = table(spark, at, "articles").where("comment_summary is not null").select(F.col("article_id").alias("item_id"), F.split("comment_summary", r"\. ").alias("children"))
    return feeds.top_comments(rows, tags=False).select(F.col("item_id").alias("article_id"), F.array_join("comments", "|").alias("comments"))


@query(f"""with d as (select *, {DATE} as d from digests), r as (select * from d where d >= (select max(d) - 7 from d)), t as (select *, row_number() over (partition by run_date order by ord, digest_id) as k from r where title is not null)
  select c.run_date, digest_count, coalesce(themes, '') as themes from (select run_date, count(*) as digest_count from r group by 1) c left join (select run_date, string_agg(title, '|' order by k) as themes from t where k <= 10 group by 1) t using (run_date)""")
def r_s21_recent_briefs(spark, at):
    digests = table(spark, at, "digests")
    today = digests.agg(F.max(S.strict_date(F.col("run_date"))).alias("d")).first().d  # one date
    return endpoints.recent_briefs(digests, F.lit(today)).select("run_date", "digest_count", F.array_join("themes", "|").alias("themes"))


@query(f"""select digest_id, run_date, ord from digests where {DATE} >= (select max({DATE}) from digests) - 60 and contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(source_label, ''))), 'the')
  and contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(source_label, ''))), 'e')""")
def r_p15_search(spark, at):
    digests = table(spark, at, "digests")
    today = digests.agg(F.max(S.strict_date(F.col("run_date"))).alias("d")).first().d  # one date
    return endpoints.search(digests, " The  E ", F.lit(today), 60).select("digest_id", "run_date", "ord")


@query(f"""with u as (select {DATE} as day, count(*) as n from usage_events group by 1), g as (select {DATE} as day, count(*) as n from digests group by 1), e as (select {DATE} as day, count(*) as n from dedup_items group by 1), h as (select {DATE} as day, count(*) as n from health_history group by 1),
  s as (select day from u union select day from g union select day from e union select day from h), c as (select unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from s)
  select c.day, c.day not in (select day from s where day is not null) as absent, u.n as calls, g.n as digests, e.n as filtered, h.n as records from c left join u on c.day = u.day left join g on c.day = g.day left join e on c.day = e.day left join h on c.day = h.day""")
def r_j9_runs(spark, at):
    """Four histories on their days, with the days that none has."""
    def per_day(name: str):
        return table(spark, at, name).groupBy(S.strict_date(F.col("run_date")).cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("n")).withColumn("_ord", F.lit(0))

    out = H.runs({"u": per_day("usage_events"), "g": per_day("digests"), "e": per_day("dedup_items"), "h": per_day("health_history")})
    return out.select("day", "absent", F.col("u.n").alias("calls"), F.col("g.n").alias("digests"), F.col("e.n").alias("filtered"), F.col("h.n").alias("records"))


_SENT = "select run_date, digest_id::varchar as message_id, coalesce(title, '') as text from digests where run_date is not null"


@query(f"select run_date, message_id, not contains(text, 'a') and not contains(text, 'ee') as ok, case when contains(text, 'a') then 'refused' end as error from ({_SENT})")
def r_k9_delivered(spark, at):
    """Messages of digests; the stand-in refuses some with an exception and others with a no."""
    def send(text: str) -> bool:
        if "a" in text:
            raise ValueError("refused")
        return "ee" not in text

    return G.delivered(table(spark, at, "digests").where("run_date is not null").selectExpr("run_date", "cast(digest_id as string) as message_id", "coalesce(title, '') as text"), send)


@query()
def r_k9_messages(spark, at):
    return table(spark, at, "documents").where("text is not null").select("doc_id", G.message(F.col("text")).alias("text"))


_DAY_LINES = lines_sql("summary", "(select run_date, replace(summary, ' ', ' @@1@@ ') as summary from digests where ord = 0 and run_date is not null and digest_id in (select min(digest_id) from digests where ord = 0 group by run_date))", "run_date")


@query(f"""with runs as (select distinct run_date, step from usage_events where step in ('compress', 'digest', 'judge')), u as (select run_date, sum(case when event_id % 997 = 0 then total_tokens else 0 end) as t from usage_events group by 1),
  z as (select run_date, 'zero_tokens' as code, 1::bigint as count, string_agg(step, ', ' order by step) as sample from runs where run_date not in (select run_date from u where t > 0 and run_date is not null) group by 1),
  h as (select run_date, pos, left(regexp_replace(line, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), 60) as line from {_DAY_LINES} where regexp_matches(line, '@@[0-9]+@@')), r as (select *, row_number() over (partition by run_date order by pos) as n from h)
  select * from z union all select run_date, 'leftover_token', count(*), string_agg(line, '；' order by pos) filter (n <= 3) from r group by 1""")
def r_c6_day_checks(spark, at):
    """Thinned ledgers of days, and the first summary of a day as its report, with place holders put in."""
    u = table(spark, at, "usage_events")
    usage = u.groupBy("run_date").agg(F.sum(F.expr("case when event_id % 997 = 0 then total_tokens else 0 end")).alias("total_tokens"))
    first = A.pick(table(spark, at, "digests").where("ord = 0 and run_date is not null").select("run_date", "digest_id", "summary"), ["run_date"], F.col("digest_id"))
    lines = R.lines_of(first.select("run_date", F.replace("summary", F.lit(" "), F.lit(" @@1@@ ")).alias("text")), "run_date", "text")
    return G.day_violations(u.select("run_date", "step", F.lit("ran").alias("status")), usage, lines, ["compress", "digest", "judge"])
