"""Queries of texts, reports, feeds and model replies, each with the SQL it must equal.

Inputs that the driver's tables don't hold (error messages, replies, mail dates) are made from their rows by expressions
that both sides read alike, one form per branch of the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import scalars as S
from feedloom.functions import texts as X
from feedloom.operators import articles as A
from feedloom.operators import joins as J
from feedloom.operators import judging as G
from feedloom.operators import reports as R
from feedloom.plans import models
from feedloom.queries import query, table
from feedloom.sources import feeds

_SPACE = "[\\s\\p{Z}]"
_STRIP = f"'^{_SPACE}+|{_SPACE}+$', '', 'g'"
_ENDS = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"


def lines_sql(text: str, table_: str = "documents", key: str = "doc_id") -> str:
    return f"""(select {key}, unnest(string_split_regex({text}, {_ENDS})) as line, generate_subscripts(string_split_regex({text}, {_ENDS}), 1) - 1 as pos from {table_} where {text} is not null)"""


# --- classes ------------------------------------------------------------------------------------------------------

_URL = """case article_id % 12 when 0 then 'https://x.com/a/' || article_id when 1 then 'https://twitter.com/b' when 2 then 'https://netflix.com/c' when 3 then 'https://news.ycombinator.com/'
  when 4 then 'https://news.ycombinator.com/item?id=' || article_id when 5 then 'https://www.reddit.com/r/z/' when 6 then 'https://www.reddit.com/r/z/comments/' || article_id when 7 then 'https://X.com/d'
  when 8 then 'https://old.reddit.com/user/a/comments/b' when 9 then null when 10 then 'https://h.test/?u=twitter.com/e' else url end"""


@query(f"""select article_id, case when contains(u, 'x.com/') or contains(u, 'twitter.com/') then 'twitter' when contains(u, 'news.ycombinator.com/item?id=') then 'hn'
  when contains(u, 'reddit.com/r/') and contains(u, '/comments/') then 'reddit' else 'general' end as kind from (select article_id, coalesce({_URL}, '') as u from articles)""")
def r_p17_url_class(spark, at):
    return table(spark, at, "articles").select("article_id", S.classify_url(F.expr(_URL)).alias("kind"))


_ERROR = """case event_id % 16 when 0 then 'Connection refused by host' when 1 then '[Errno 61] no route' when 2 then 'errno 111' when 3 then 'HTTP Error 503: busy' when 4 then '<urlopen error timed out>'
  when 5 then 'parse_llm_json: cannot read ''''' when 6 then 'parse_llm_json: cannot read {' when 7 then 'JSONDecodeError: ""' when 8 then '無法解析' when 9 then '無法解析：空' when 10 then 'context length 404 tokens'
  when 11 then 'Telegram status False' when 12 then 'model reply timeout' when 13 then null when 14 then 'HTTP error after Connection Refused' else props end"""


@query(f"""select event_id, case when contains(l, 'connection refused') or contains(l, 'errno 61') or contains(l, 'errno 111') then 'network' when contains(l, 'http error') then 'upstream_http'
  when contains(l, 'urlopen error') then 'network' when contains(l, 'parse_llm_json') or contains(t, '無法解析') or contains(l, 'json') then
    case when contains(t, '''''') or contains(t, '""') or contains(t, '空') then 'empty_llm' else 'parse' end else 'other' end as kind
  from (select event_id, coalesce({_ERROR}, '') as t, lower(coalesce({_ERROR}, '')) as l from events)""")
def r_p18_error_class(spark, at):
    return table(spark, at, "events").select("event_id", S.classify_error(F.expr(_ERROR)).alias("kind"))


_LABEL = "select article_id, case when article_id % 3 = 0 then 'r/' || category else '' end as subreddit, case when article_id % 2 = 0 then source end as own, case when article_id % 5 = 0 then 'other' else source_key end as key from articles"


@query(f"""select article_id, coalesce(nullif(subreddit, ''), nullif(own, ''), case key when 'hatena' then 'Hatena' when 'hn' then 'HN' when 'reddit' then 'Reddit' when 'security' then 'Security' when 'rss' then 'RSS' end, key) as label from ({_LABEL})""")
def r_p9_source_label(spark, at):
    rows = table(spark, at, "articles").selectExpr("article_id", "case when article_id % 3 = 0 then 'r/' || category else '' end as subreddit", "case when article_id % 2 = 0 then source end as own", "case when article_id % 5 = 0 then 'other' else source_key end as key")
    return rows.select("article_id", S.source_label(F.col("subreddit"), F.col("own"), F.col("key")).alias("label"))


_ARGS = "case event_id % 5 when 0 then '' when 1 then '--force hn' when 2 then 'today --only rss' when 3 then 'day-of-week' else '  -x' end"


@query(f"select event_id, case when event_id % 5 in (1, 2, 4) then 'manual' else 'scheduled' end as trigger from events")
def r_p30_trigger(spark, at):
    return table(spark, at, "events").select("event_id", S.trigger(F.expr(_ARGS)).alias("trigger"))


@query("select event_id, case event_id % 6 when 0 then 'a/b.html' when 1 then 'b.html' when 4 then 'a' end as path from events")
def r_k7_safe_path(spark, at):
    made = F.expr("case event_id % 6 when 0 then './a//b.html' when 1 then 'a/../b.html' when 2 then '../b' when 3 then '/etc/x' when 4 then 'a/' else 'a/../../b' end")
    return table(spark, at, "events").select("event_id", S.safe_path(made).alias("path"))


# --- judging ------------------------------------------------------------------------------------------------------

_REPLY = """case event_id % 8 when 7 then 'no json' else '{"scores": {"relevance": {"score": ' || case event_id % 5 when 0 then '2' when 1 then '2.5' when 2 then 'true' when 3 then 'null' else '4' end || ', "reasoning": "r", "overall": 1}, "completeness": '
  || case event_id % 3 when 0 then '{"score": 1.5}' when 1 then '"none"' else '{"score": 5}' end || ', "own": {"score": 1}}, "quality_alert": true, "missed_urls": ' || case event_id % 4 when 0 then '["u1", 5, "u2"]' when 1 then '"u"' else '[]' end || '}' end"""
_JUDGED = """select *, case when bad then null else case event_id % 5 when 0 then '2' when 1 then '2.5' when 2 then 'true' when 3 then 'null' else '4' end end as r, case when bad then null when event_id % 3 = 0 then '1.5' when event_id % 3 = 2 then '5' end as c,
  case when not bad and event_id % 4 = 0 then ['u1', 'u2'] else [] end as m, case event_id % 7 when 0 then 0.0 when 1 then 3.4 when 2 then 3.5 else 2.0 end::double as overall from (select event_id, event_id % 8 = 7 as bad from events)"""


@query(f"select event_id, r as relevance, c as completeness, array_to_string(m, ',') as missed from ({_JUDGED})")
def r_p14_judge_whitelist(spark, at):
    return G.judged(table(spark, at, "events").select("event_id", F.expr(_REPLY).alias("reply"))).select(
        "event_id", F.col("relevance.score").alias("relevance"), F.col("completeness.score").alias("completeness"), F.array_join("missed_urls", ",").alias("missed"))


@query(f"""select event_id, array_to_string(list_filter([case when r in ('2', '2.5') then 'relevance=' || r end, case when c = '1.5' then 'completeness=1.5，遺漏：[' || array_to_string(list_transform(m, lambda u: '''' || u || ''''), ', ') || ']' end,
  case when overall > 0 and overall < 3.5 then 'overall=' || overall end], lambda x: x is not null), '；') as reasons from ({_JUDGED})""")
def r_p22_alert_reasons(spark, at):
    rows = G.judged(table(spark, at, "events").select("event_id", F.expr(_REPLY).alias("reply"), F.expr("cast(case event_id % 7 when 0 then 0.0 when 1 then 3.4 when 2 then 3.5 else 2.0 end as double)").alias("overall")))
    return rows.select("event_id", G.alert_reasons(F.col("overall")).alias("reasons"))


# --- reports ------------------------------------------------------------------------------------------------------

_REPORT = """case doc_id % 5 when 0 then text when 1 then replace(replace(text, ' pt)', ' users )'), '(', '( ') when 2 then replace(replace(text, '- ', '• '), '](https', '](@@' || doc_id || '@@ https') when 3 then replace(replace(text, ' pt)', 'pt)'), '](http', '](ftp')
  else replace(text, '](https', '](@@3@@) x](https') end"""
_ROW_SQL = f"(regexp_matches(line, '^{_SPACE}*(?:\\p{{Nd}}+\\.|[-*•]){_SPACE}|^{_SPACE}*\\|') and regexp_matches(line, '\\({_SPACE}*\\p{{Nd}}[\\p{{Nd}},]*{_SPACE}*(?:users|pt|ups){_SPACE}*\\)'))"
_UNLINKED = f"({_ROW_SQL} and not regexp_matches(line, '\\]\\(https?://'))"


def _report_lines(spark, at):
    return R.lines_of(table(spark, at, "documents").select("doc_id", F.expr(_REPORT).alias("text")), "doc_id", "text")


@query(f"select doc_id, count(*) filter ({_ROW_SQL}) as rows_found, count(*) filter ({_UNLINKED}) as unlinked from {lines_sql('text', f'(select doc_id, {_REPORT} as text from documents)')} group by 1")
def r_p24_unlinked_rows(spark, at):
    line = F.col("line")
    return _report_lines(spark, at).groupBy("doc_id").agg(F.count_if(line.rlike(R.ROW) & line.rlike(R.POPULAR)).alias("rows_found"), F.count_if(R.is_unlinked_row(line)).alias("unlinked"))


_VIOLATIONS = f"""with l as (select * from {lines_sql('text', f'(select doc_id, {_REPORT} as text from documents)')}),
  h as (select doc_id, pos, left(regexp_replace(line, {_STRIP}), 60) as line, 'leftover_token' as code from l where regexp_matches(line, '@@[0-9]+@@')
    union all select doc_id, pos, left(regexp_replace(line, {_STRIP}), 60), 'unlinked_articles' from l where {_UNLINKED}),
  r as (select *, row_number() over (partition by doc_id, code order by pos) as n from h),
  v as (select doc_id, code, count(*) as count, string_agg(line, '；' order by pos) filter (n <= 3) as sample from r group by 1, 2)"""


@query(_VIOLATIONS + " select * from v")
def r_p25_check_report(spark, at):
    return R.check_report(_report_lines(spark, at), "doc_id")


@query(_VIOLATIONS + """ select doc_id, 'deploy 已擋下：' || string_agg('[' || code || '] ' || case code when 'leftover_token' then 'report.md 殘留 ' || count || ' 行 @@id@@ token：' || sample else 'report.md 有 ' || count || ' 篇文章列沒有 http(s) 連結：' || sample end, ' | ' order by code) as message from v group by 1""")
def r_a19_violation_lines(spark, at):
    return R.violations_line(R.check_report(_report_lines(spark, at), "doc_id"), "doc_id")


@query(_VIOLATIONS + " select doc_id, case when bool_or(code in ('leftover_token', 'unlinked_articles')) then 'block' else 'ledger_only' end as decision from v group by 1")
def r_p27_gate_codes(spark, at):
    return G.gate(R.check_report(_report_lines(spark, at), "doc_id"))


@query(f"""with runs as (select run_date, step from usage_events where step in ('compress', 'digest', 'judge') group by 1, 2), u as (select run_date, sum(case when edition is null then 0 when event_id % 997 = 0 then total_tokens else 0 end) as t from usage_events group by 1)
  select distinct runs.run_date from runs left join u using (run_date) where coalesce(t, 0) <= 0""")
def r_p26_ledger_check(spark, at):
    """Days on which a step that calls a model ran, but whose (thinned) ledger holds no tokens."""
    u = table(spark, at, "usage_events")
    runs = u.select("run_date", "step", F.lit("ran").alias("status"))
    return R.ledger_check(runs, u.groupBy("run_date").agg(F.sum(F.expr("case when edition is null then 0 when event_id % 997 = 0 then total_tokens else 0 end")).alias("total_tokens")), ["compress", "digest", "judge"])


_BROKEN = "replace(case doc_id % 3 when 0 then replace(text, '\n- ', '\n  - ') when 1 then replace(text, '\n- ', '\n1. ') else text end, '## ', '')"


@query(f"""select doc_id, count(*) filter (regexp_matches(line, '^(\\d+\\.|[-*+])\\s') and not regexp_matches(prev, '^(\\d+\\.|[-*+])\\s') and regexp_matches(prev, '^\\S')) as breaks
  from (select *, lag(line) over (partition by doc_id order by pos) as prev from {lines_sql('text', f'(select doc_id, {_BROKEN} as text from documents)')}) group by 1""")
def r_x20_list_breaks(spark, at):
    lines = R.list_breaks(R.lines_of(table(spark, at, "documents").select("doc_id", F.expr(_BROKEN).alias("text")), "doc_id", "text"), "doc_id")
    return lines.groupBy("doc_id").agg(F.count_if("break_before").alias("breaks"))


def _gated(spark, at):
    """A report of two lines per article, of five kinds, and the index of titles."""
    a = table(spark, at, "articles").select("article_id", F.md5(F.col("article_id").cast("string")).alias("m"))
    text = F.expr("""case article_id % 5 when 0 then '• ' || upper(m) || ' title (1,234pt) and more' when 1 then '| ' || m || ' title (5 users) | x |' when 2 then '3. [' || m || ' title](https://h.test/0) ( 7 ups )'
      when 3 then '- unknown ' || article_id || ' story (5 pt)' else m || ' title @@4@@ (5 pt)' end""")
    docs = a.select(F.col("article_id").alias("doc_id"), F.concat(text, F.lit("\nprose (9 pt)")).alias("text"))
    enriched = a.select(F.concat("m", F.lit(" title")).alias("title"), F.lit(None).cast("string").alias("original_title"), F.concat(F.lit("https://h.test/"), F.col("article_id").cast("string")).alias("url"))
    return R.lines_of(docs, "doc_id", "text"), G.title_index(enriched, table(spark, at, "digests"))


@query("select article_id as doc_id, case when article_id % 5 in (3, 4) then 'block' else 'allow' end as decision from articles")
def r_c4_gate(spark, at):
    """Rows of lists and tables whose title is known are mended; unknown ones and place holders block."""
    return G.checked(*_gated(spark, at))


@query("""select article_id as doc_id, 0 as pos, case article_id % 5 when 0 then '• [' || upper(md5(article_id::varchar)) || ' title](https://h.test/' || article_id || ') (1,234pt) and more' when 1 then '| [' || md5(article_id::varchar) || ' title](https://h.test/' || article_id || ') (5 users) | x |'
  when 2 then '3. [' || md5(article_id::varchar) || ' title](https://h.test/0) ( 7 ups )' when 3 then '- unknown ' || article_id || ' story (5 pt)' else md5(article_id::varchar) || ' title @@4@@ (5 pt)' end as line from articles union all select article_id, 1, 'prose (9 pt)' from articles""")
def r_c5_relinked(spark, at):
    return G.relinked(*_gated(spark, at))


_VIEWED = "replace(text, ' pt)', ' pt) 社群觀點：x')"
_VIEW_SQL = "[ \\t]*(?:[-*•][ \\t]+)?\\**(?:💬[ \\t]*)?\\**社群觀點\\**[ \\t]*[：:].*$"


@query(f"""select doc_id, count(*) as lines, sum(length(line))::bigint as size from (select doc_id, case when regexp_matches(line, '^\\s*\\|') or not regexp_matches(line, '{_VIEW_SQL}') then line
    else nullif(regexp_replace(regexp_replace(line, '{_VIEW_SQL}', ''), '{_SPACE}+$', ''), '') end as line from {lines_sql('text', f'(select doc_id, {_VIEWED} as text from documents)')}) where line is not null group by 1""")
def r_x7_without_views(spark, at):
    lines = R.without_views(R.lines_of(table(spark, at, "documents").select("doc_id", F.expr(_VIEWED).alias("text")), "doc_id", "text"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("size"))


@query(f"""with l as (select * from {lines_sql('text')}), u as (select doc_id, pos, regexp_extract(line, '^\\s*(?:\\d+\\.|[-*•])\\s+.*?\\]\\((https?://[^)\\s]+)\\)', 1) as url from l)
  select doc_id, min(pos)::int as pos, url, 'views of ' || url as comment from u where url <> '' group by doc_id, url""")
def r_j5_views(spark, at):
    """Every address has a comment; where it is put."""
    lines = R.lines_of(table(spark, at, "documents"), "doc_id", "text")
    urls = lines.select(F.regexp_extract("line", R.LISTED_LINK, 1).alias("url")).where("url <> ''").distinct().withColumn("comment", F.concat(F.lit("views of "), F.col("url")))
    put = R.with_views(lines, urls, "doc_id").where("part = 1")
    text = F.regexp_replace("line", "^ *" + R.VIEW_HEAD, "")
    return put.select("doc_id", "pos", F.regexp_replace(text, "^views of ", "").alias("url"), text.alias("comment"))


# --- scalars and texts --------------------------------------------------------------------------------------------

@query(f"""select article_id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(left(c, 60), '<[^>]+>', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://\\S+', '', 'g'), '```', ''), {_STRIP}) as text
  from (select article_id, case article_id % 3 when 0 then '`code` ```x``` ' || comment_summary when 1 then '[a](b) <i>' || comment_summary else comment_summary end as c from articles) where c is not null""")
def r_x2_clean_comment(spark, at):
    made = F.expr("case article_id % 3 when 0 then '`code` ```x``` ' || comment_summary when 1 then '[a](b) <i>' || comment_summary else comment_summary end")
    return table(spark, at, "articles").select("article_id", made.alias("c")).where("c is not null").select("article_id", S.clean_comment(F.col("c")).alias("text"))


@query("""select article_id, replace(replace(replace(replace(replace(original_description, '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;', '"'), '&amp;', '&') as text from articles""")
def r_x19_unescaped(spark, at):
    return table(spark, at, "articles").select("article_id", X.unescaped("original_description").alias("text"))


@query("""select article_id, replace(replace(regexp_replace(regexp_replace(original_description, '(?i)<(/?(?:b|i|u|s|a|code|pre)(?:\\s[^>]*)?)>', chr(1) || '\\1' || chr(2), 'g'), '<(/?)(\\w[\\w-]*)(\\s[^>]*)?>', '', 'g'), chr(1), '<'), chr(2), '>') as text from articles where original_description is not null""")
def r_x10_allowed_tags(spark, at):
    return table(spark, at, "articles").where("original_description is not null").select("article_id", G.allowed_tags(F.col("original_description")).alias("text"))


_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
_ZONES = "case article_id % 8 when 0 then '+0900' when 1 then 'GMT' when 2 then '-0330' when 3 then 'EST' when 4 then '-0000' when 5 then 'XYZ' when 6 then '+0000' else '' end"
_OFFSETS = "case article_id % 8 when 0 then '+09:00' when 1 then '+00:00' when 2 then '-03:30' when 3 then '-05:00' when 6 then '+00:00' else '' end"


@query(f"select article_id, case when article_id % 11 = 5 then 'some day' else strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || {_OFFSETS} end as iso from articles where fetched_at is not null")
def r_x23_mail_date(spark, at):
    """Dates of eight zones, and text that is none."""
    mail = F.when(F.col("article_id") % 11 == 5, "some day").otherwise(F.rtrim(F.concat(F.date_format("fetched_at", "E, dd MMM yyyy HH:mm:ss"), F.lit(" "), F.expr(_ZONES))))
    return table(spark, at, "articles").where("fetched_at is not null").select("article_id", S.mail_date(mail).alias("iso"))


@query("""select event_id, case when total_tokens is null then '—' when total_tokens >= 1000000 then printf('%.2fM', total_tokens / 1000000.0::double) when total_tokens >= 1000 then printf('%.0fK', total_tokens / 1000.0::double) else total_tokens::varchar end as tokens,
  case when total_tokens is null then '—' else printf('%.1f', (total_tokens % 50) / 10.0::double) end as score, format('{:,}', coalesce(total_tokens, 0)) as number from (select distinct event_id, total_tokens from usage_events)""")
def r_x25_formats(spark, at):
    rows = table(spark, at, "usage_events").select("event_id", "total_tokens").distinct()
    t = F.col("total_tokens")
    return rows.select("event_id", S.token_text(t).alias("tokens"), S.score_text(F.try_mod(t, F.lit(50)) / 10).alias("score"), S.thousands(F.coalesce(t, F.lit(0))).alias("number"))


@query("select event_id, case when event_id % 4 = 0 then '{}' when event_id % 4 = 1 then null else json_extract_string(props, '$.k') end as k from events")
def r_x14_simple_reply(spark, at):
    """A reply that can't be read counts as an empty object."""
    v = F.coalesce(F.try_parse_json(F.expr("case event_id % 4 when 0 then 'not json' when 1 then '[1]' else props end")), F.parse_json(F.lit("{}")))
    return table(spark, at, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.to_json(v)).otherwise(F.try_variant_get(v, "$.k", "string")).alias("k"))


@query("select event_id, coalesce(map_extract(b, 'x')[1], map_extract(a, 'x')[1]) as x, coalesce(map_extract(b, 'y')[1], map_extract(a, 'y')[1]) as y from (select event_id, map {'x': event_type, 'y': 'old'} as a, case when event_id % 3 = 0 then map {'y': 'new'} else map {} end as b from events)")
def r_u5_map_merge(spark, at):
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    merged = S.merged_map(F.create_map(F.lit("x"), F.col("event_type"), F.lit("y"), F.lit("old")), F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("y"), F.lit("new"))).otherwise(empty))
    return table(spark, at, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["x"].alias("x"), F.col("m")["y"].alias("y"))


# --- feeds --------------------------------------------------------------------------------------------------------

_SAFE = "regexp_replace(coalesce(title, ''), '[^A-Za-z0-9 ]', '', 'g')"


def _safe(spark, at):
    return table(spark, at, "articles").select("article_id", "source_key", "url", F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z0-9 ]", "").alias("t"))


@query(f"""select article_id, trim(t) as title, case when article_id % 3 = 0 then 'https://h.test/' || article_id else 'https://r.test/r/' || article_id end as orig_url, 0 as score from (select article_id, {_SAFE} as t from articles)""")
def r_s5_linked_entries(spark, at):
    """Entries of an Atom feed; every third links elsewhere, the others are discussions."""
    content = F.when(F.col("article_id") % 3 == 0, F.concat(F.lit("&amp;lt;a href=\"https://h.test/"), F.col("article_id").cast("string"), F.lit("\"&amp;gt;[link]&amp;lt;/a&amp;gt;"))).otherwise("talk")
    body = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), F.col("t"), F.lit('</title><link href="https://r.test/r/'), F.col("article_id").cast("string"), F.lit('"/><content>'), content, F.lit("</content></entry></feed>"))
    items = feeds.rss_items(_safe(spark, at).select(F.col("article_id").cast("string").alias("source"), body.alias("body")), cap=100_000, tags=False)
    got = feeds.linked_entries(items.withColumnRenamed("description", "content"))
    return got.select(F.col("source").cast("long").alias("article_id"), F.trim("title").alias("title"), "orig_url", "score")


@query("""with r as (select event_id, event_id // 3 as ord, event_id % 3 as attempt, event_type, case event_id % 5 when 0 then 429 when 1 then 503 when 2 then 200 when 3 then null else 200 end as status, case when event_id % 5 = 3 then null when event_id % 2 = 0 then event_id % 100 end::double as reset from events),
  a as (select *, min(case when status is null or status = 200 then attempt end) over (partition by ord) as f from r), k as (select * from a where attempt < 2 and (f is null or attempt <= f))
  select ord, attempt, least(coalesce(lag(coalesce(reset + 2, 0)) over (order by ord, attempt), 0), 70)::double as waited, status, (status is null or status = 200) as used from k""")
def r_s6_paced(spark, at):
    raw = F.expr("""case event_id % 5 when 0 then 'HTTP/2 429 \r\n' when 1 then 'HTTP/1.1 503 X\r\n' when 3 then '<feed/>' else 'HTTP/1.1 200 OK\r\n' end
      || case when event_id % 5 = 3 then '' when event_id % 2 = 0 then 'X-RateLimit-Reset: ' || event_id % 100 || '\r\n\r\nbody' else '\r\nbody' end""")
    rows = table(spark, at, "events").select(F.lit("all").alias("g"), F.floor(F.col("event_id") / 3).alias("ord"), (F.col("event_id") % 3).alias("attempt"), raw.alias("raw"))
    return feeds.paced(rows, "g").select("ord", "attempt", "waited", "status", "used")


@query(f"""with c as (select source, row_number() over (order by source) as k from sources where source is not null), a as (select lower(trim(coalesce(x.source, ''))) as s, article_id, {_SAFE} as t, row_number() over (partition by lower(trim(coalesce(x.source, ''))) order by article_id) - 1 as ord from articles x)
  select c.source, case when k % 4 = 0 then 'Tech' else 'C' || k % 4 end as category, a.ord::int as ord, trim(a.t) as title, trim(left('d' || a.t, 500)) as description from c join a on lower(c.source) = a.s where k % 7 <> 0 and a.ord < case when k % 5 = 0 then 20 else k % 5 end""")
def r_s8_configured(spark, at):
    """One feed per contributor; some have no limit, some no category, some can't be read."""
    from pyspark.sql import Window

    c = table(spark, at, "sources").where("source is not null").select("source", F.row_number().over(Window.orderBy("source")).alias("k"))
    config = c.select(F.concat(F.lit("https://f.test/"), F.lower("source")).alias("url"), F.col("source").alias("name"), F.when(F.col("k") % 4 != 0, F.concat(F.lit("C"), (F.col("k") % 4).cast("string"))).alias("category"), F.when(F.col("k") % 5 != 0, F.col("k") % 5).alias("max_items"), "k")
    own = F.lower(F.trim(F.coalesce("source", F.lit(""))))
    rows = table(spark, at, "articles").select(own.alias("s"), "article_id", F.regexp_replace(F.coalesce("title", F.lit("")), "[^A-Za-z0-9 ]", "").alias("t"))
    # Only what a feed may give is put into its document.
    few = A.top_per_group(rows, ["s"], [F.col("article_id")], 20).drop("place")
    item = F.concat(F.lit("<item><title>"), F.col("t"), F.lit("</title><description>d"), F.col("t"), F.lit("</description></item>"))
    bodies = few.groupBy("s").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_id", item.alias("i")))), lambda x: x["i"]), ""), F.lit("</channel></rss>")).alias("b"))
    docs = bodies.join(config, F.concat(F.lit("https://f.test/"), F.col("s")) == F.col("url")).select("url", F.when(F.col("k") % 7 == 0, "<rss><cha").otherwise(F.col("b")).alias("body"))
    return feeds.configured_items(docs, config.drop("k")).select("source", "category", "ord", F.trim("title").alias("title"), F.trim("description").alias("description"))


_BILINGUAL = "'head ' || coalesce(title, '') || chr(10) || '<!-- lang:zh -->' || chr(10) || coalesce(one_liner, '') || chr(10) || case when article_id % 3 = 0 then '' else '<!--  LANG:EN -->' || chr(10) || article_id || chr(10) end"
_BILINGUAL_SPARK = _BILINGUAL.replace("chr(10)", "'\n'")


@query(f"""select article_id, 'zh' as lang, regexp_replace(regexp_replace(coalesce(one_liner, ''), {_ENDS}, chr(10), 'g'), {_STRIP}) as body from articles union all select article_id, 'en', article_id::varchar from articles where article_id % 3 <> 0""")
def r_s19_languages(spark, at):
    rows = table(spark, at, "articles").select("article_id", F.expr(_BILINGUAL_SPARK).alias("text"))
    return feeds.language_sections(rows, "article_id")


@query("select case event_id % 2 when 0 then 'health-history.json' else 'run-history.json' end as name, count(*) as n from events where event_id % 6 in (0, 1, 2) group by 1")
def r_s20_histories(spark, at):
    body = F.expr("case event_id % 6 when 0 then '[]' when 1 then '[{\"date\": \"x\"}]' when 2 then '[1, 2]' when 3 then '{}' when 4 then 'broken [' else null end")
    rows = table(spark, at, "events").select(F.expr("case event_id % 2 when 0 then '_health-history.json' else '_run-history.json' end").alias("name"), body.alias("body"))
    return feeds.published_histories(rows, {"_health-history.json": "health-history.json", "_run-history.json": "run-history.json"}).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# --- model calls --------------------------------------------------------------------------------------------------

_NUMBERED = "(select *, row_number() over (partition by run_date, source_key order by article_id) - 1 as id from articles where interest = '***' and source_key is not null)"


@query(f"select article_id, id::int as id, url from {_NUMBERED}")
def r_p11_sent(spark, at):
    """Starred articles as the model gets them; what people said of them stays out."""
    rows = models.sent(table(spark, at, "articles").where("interest = '***' and source_key is not null"), ["run_date", "source_key"], F.col("article_id"))
    assert "comment_summary" not in rows.columns
    return rows.select("article_id", "id", "url")


@query(f"""with n as (select *, count(*) over (partition by run_date, source_key) as size from {_NUMBERED})
  select article_id, case when id = 1 and size > 1 then 'true one' when id % 4 = 0 then 'about ' || id when coalesce(title, '') <> '' then title else '' end as one_liner from n""")
def r_j10_rebuilt(spark, at):
    """The reply names every fourth article, twice (the first counts), leaves some blank, has numbers nobody sent, text
    numbers, and true for 1."""
    numbered = models.sent(table(spark, at, "articles").where("interest = '***' and source_key is not null"), ["run_date", "source_key"], F.col("article_id"))
    say = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("id") % 4 == 0, F.col("id")))), lambda i: F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "one_liner": " about '), i.cast("string"), F.lit(' "}, {"id": '), i.cast("string"), F.lit(', "one_liner": "again"}, '))), "")
    reply = F.concat(F.lit('{"articles": ['), say, F.lit('{"id": true, "one_liner": "true one"}, {"id": 2, "one_liner": " "}, {"id": "3", "one_liner": "text"}, {"id": 100000, "one_liner": "none"}, {"id": -1, "one_liner": "none"}, 7]}'))
    replies = numbered.groupBy("run_date", "source_key").agg(reply.alias("reply"))
    by = ["run_date", "source_key"]
    out = models.rebuilt(numbered.drop("one_liner"), models.told(replies, by, "reply", "articles", "one_liner"), by, "one_liner", [F.col("title")])
    return out.select("article_id", "one_liner")


@query(f"""with d as (select run_date, count(*) as n, min(digest_id) as first from digests where run_date is not null group by 1) select digest_id, case when n % 3 = 0 then 'again ' || (n % 2) else coalesce(summary, '') end as summary from digests join d using (run_date)""")
def r_c7_completed(spark, at):
    """Days with a low completeness are asked once more, with what they missed."""
    digests = table(spark, at, "digests").where("run_date is not null").select("run_date", "digest_id", F.coalesce("summary", F.lit("")).alias("summary"))
    n = F.count(F.lit(1))
    quality = digests.groupBy("run_date").agg(F.when(n % 3 == 0, 2.0).when(n % 3 == 1, 3.0).cast("double").alias("completeness"), F.array_repeat(F.lit("u"), (n % 2).cast("int")).alias("missed_urls"))
    again = lambda weak: digests.join(weak, "run_date").select("run_date", "digest_id", F.concat(F.lit("again "), F.size("missed_urls").cast("string")).alias("summary"))
    return models.completed(digests, quality, again, ["run_date"]).select("digest_id", "summary")


# --- small forms --------------------------------------------------------------------------------------------------

@query("select event_id, coalesce(case event_id % 4 when 0 then null when 1 then 2.9 when 2 then 3.0 else 1 end < 3, false) and event_id % 5 <> 0 and event_id % 3 > 0 as again from events")
def r_p23_needs_reconcile(spark, at):
    e = table(spark, at, "events")
    return e.select("event_id", G.needs_reconcile(F.expr("cast(case event_id % 4 when 0 then null when 1 then 2.9 when 2 then 3.0 else 1 end as double)"), F.col("event_id") % 3, F.col("event_id") % 5 == 0).alias("again"))


@query("select event_id, case when event_id % 3 = 0 then '<b>' || event_type || '</b>' else '<b><a href=\"https://h/' || event_id || '\">' || event_type || '</a></b>' end as text, case when event_id % 3 = 0 then 1 else 0 end as removed from events")
def r_x5_live_anchors(spark, at):
    text = F.expr("'<b><a href=\"' || case when event_id % 3 = 0 then '@@' || event_id || '@@' else 'https://h/' || event_id end || '\">' || event_type || '</a></b>'")
    return table(spark, at, "events").select("event_id", X.live_anchors(text).alias("r")).select("event_id", "r.text", "r.removed")


@query("select digest_id, '@@' || digest_id || '@@' as token, 'archive/' || left(run_date, 7) || '/' || run_date || '.html' as path from digests")
def r_x6_x30_tokens_and_paths(spark, at):
    return table(spark, at, "digests").select("digest_id", S.link_token(F.col("digest_id")).alias("token"), G.archive_path(F.col("run_date")).alias("path"))


@query("select digest_id, '1. [' || source_key || '](' || case when digest_id % 2 = 0 then url else '@@' || digest_id || '@@' end || ') (5 pt)' as text from digests where source_key not in ('', '?') and url <> ''")
def r_j11_filled_links(spark, at):
    """Rows whose link lost its bracket; even ids have an address."""
    d = table(spark, at, "digests").where("source_key not in ('', '?') and url <> ''")
    text = F.expr("'1. ' || source_key || '](@@' || digest_id || '@@) (5 pt)'")
    ids = F.when(F.col("digest_id") % 2 == 0, F.array(F.col("digest_id").cast("int"))).otherwise(F.array().cast("array<int>"))
    return d.select("digest_id", X.filled(text, ids, F.when(F.col("digest_id") % 2 == 0, F.array("url")).otherwise(F.array().cast("array<string>"))).alias("text"))


@query("select event_id, case event_id % 4 when 0 then event_type when 1 then '{\"n\": 1}' when 2 then event_type else '[1]' end as text from events")
def r_x15_unwrapped(spark, at):
    made = F.expr("""case event_id % 4 when 0 then '{"n": 1, "z": "' || event_type || '", "a": "no"}' when 1 then '{"n": 1}' when 2 then event_type else '[1]' end""")
    return table(spark, at, "events").select("event_id", X.first_text_of(made).alias("text"))


@query("select event_id, event_type || '`x' as text from events")
def r_x16_unfenced(spark, at):
    made = F.expr("case event_id % 3 when 0 then '```markdown\n' || event_type || '`x\n```' when 1 then event_type || '`x' else '```\n' || event_type || '`x ``' end")
    return table(spark, at, "events").select("event_id", G.unfenced(made).alias("text"))


@query("select event_id, case event_id % 3 when 0 then 429 when 1 then 200 end as status, case when event_id % 3 = 0 then (event_id % 70)::double end as reset_seconds, case event_id % 3 when 2 then event_type || chr(10) || chr(10) || 'x' else event_type end as body from events")
def r_x18_response_parts(spark, at):
    raw = F.expr("case event_id % 3 when 0 then 'HTTP/2 429 \r\nX-Ratelimit-RESET: ' || event_id % 70 || '\r\n\r\n' || event_type when 1 then 'HTTP/1.1 200 OK\n\n' || event_type else event_type || '\n\nx' end")
    return feeds.response_parts(table(spark, at, "events").select("event_id", raw.alias("raw"))).select("event_id", "status", "reset_seconds", "body")


@query("select event_id, case when event_id % 3 = 0 then 'why' else '' end as reason, case when event_id % 4 = 0 and event_id % 5 = 0 then 'thought' when event_id % 4 = 0 then case when event_id % 2 = 0 then ' ' else '' end when event_id % 4 = 1 then '' else event_type end as text from events")
def r_c12_c17_read_back(spark, at):
    """The reason of an alert, and the text of a response whose content may be blank or missing."""
    e = table(spark, at, "events")
    content = F.expr("case event_id % 4 when 0 then ' ' when 1 then null else event_type end")
    return e.select("event_id", G.quality_reason(F.expr("case event_id % 3 when 0 then true when 1 then false end"), F.lit("why")).alias("reason"), S.response_text(content, F.when(F.col("event_id") % 4 == 0, "thought"), F.col("event_id") % 5 == 0).alias("text"))


@query("""select title, url from articles where (starts_with(url, 'http://') or starts_with(url, 'https://')) and title <> '' union all select original_title, url from articles where (starts_with(url, 'http://') or starts_with(url, 'https://')) and original_title <> ''
  union all select title, url from digests where (starts_with(url, 'http://') or starts_with(url, 'https://')) and title <> ''""")
def r_j13_title_index(spark, at):
    return G.title_index(table(spark, at, "articles"), table(spark, at, "digests"))


@query("""select event_id, case event_id % 4 when 0 then event_type || ' [a](https://h/1) b c' when 1 then 'x' when 2 then '[keep](http://h) t [v]' else event_type end as text, case event_id % 4 when 0 then 3 when 1 then 1 when 2 then 2 else 0 end as removed from events""")
def r_x4_dead_links(spark, at):
    """Targets with blanks, place holders with and without their link, a title with brackets of its own, and links that live."""
    made = F.expr("case event_id % 4 when 0 then event_type || ' [a](https://h/1) [b](two words) [c](@@' || event_id || '@@)@@7@@' when 1 then 'x](@@2@@)' when 2 then '[keep](http://h) [t [v]](#)@@3@@' else event_type end")
    return table(spark, at, "events").select("event_id", X.live_links(made).alias("g")).select("event_id", "g.text", "g.removed")


@query("select event_id, 'a' || replace(event_type, '_', '') || 'bé' as form from events")
def r_x8_title_key(spark, at):
    """Full-width and composed letters, blanks of other scripts, and markdown signs."""
    made = F.concat(F.lit("Ａ　*"), F.upper("event_type"), F.lit("*\t[Ｂ]`_e\u0301"))
    return table(spark, at, "events").select("event_id", X.title_key_of(made).alias("form"))


@query("""select event_id, case event_id % 6 when 0 then '<b>' || event_type || '<i>x</i></b>' when 1 then '<p>' || event_type || '<b>y</b>' when 2 then '<b><i>x</b></i></b>' when 3 then '<b>xxxxxx</b>...' when 4 then 'xxxxxxx...' else event_type end as text from events""")
def r_x11_x12_closed(spark, at):
    """Tags left open, tags that don't count, closers that don't match; texts cut in the open and inside a tag."""
    text = F.expr("case event_id % 6 when 0 then '<b>' || event_type || '<i>x' when 1 then '<p>' || event_type || '<b>y</b>' when 2 then '<b><i>x</b>' when 3 then '<b>' || repeat('x', 20) when 4 then 'xxxxxxx<b>yyyyyyy' else event_type end")
    e = table(spark, at, "events")
    return e.select("event_id", F.when(F.col("event_id") % 6 < 3, X.closed_tags(text)).otherwise(X.truncated_to(12)(text)).alias("text"))


@query("""select event_id, case event_id % 7 when 0 then '{"k": ' || event_id || '}' when 1 then '{"k": "' || event_type || '"}' when 4 then '{"k": 1}' when 5 then '{"a": [1, 2], "b": null}' end as value, case when event_id % 7 in (2, 3, 6) then 'no JSON object' end as error from events""")
def r_x13_json_reply(spark, at):
    """Fenced and bare objects, a comma too many, full-width colons, lists, prose, and nothing."""
    reply = F.expr("""case event_id % 7 when 0 then 'Here:\n```json\n{"k": ' || event_id || '}\n```\n```\n{"k": 0}\n```' when 1 then 'Sure. {"k": "' || event_type || '",} Done.' when 2 then '[1, 2]' when 3 then 'nothing of the kind' when 4 then '{"k"：1}' when 5 then '{"a":[1,2],"b":null}' else '' end""")
    return table(spark, at, "events").select("event_id", X.parsed_reply(reply).alias("r")).select("event_id", F.col("r.value").alias("value"), F.col("r.error").alias("error"))


@query("select article_id as line_id, case when article_id % 5 = 0 or article_id % 4 = 3 then null else 'https://h.test/' || article_id end as url from articles")
def r_j12_titles(spark, at):
    """Equal, contained, containing and too short titles; every fifth stands for two addresses."""
    a = table(spark, at, "articles").select("article_id", F.md5(F.col("article_id").cast("string")).alias("m"))
    lines = a.select(F.col("article_id").alias("line_id"), F.expr("case article_id % 4 when 0 then upper(m) || ' *of the day*' when 1 then substring(m, 3) || ' of the' when 2 then 'x ' || m || ' of the day y' else substring(m, 1, 7) end").alias("title"))
    url = F.concat(F.lit("https://h.test/"), F.col("article_id").cast("string"))
    urls = F.when(F.col("article_id") % 5 == 0, F.array(url, F.concat(url, F.lit("/2")))).otherwise(F.array(url))
    return J.matched_titles(lines, a.select(F.concat("m", F.lit(" of the day")).alias("title"), F.explode(urls).alias("url")))


@query("select event_id, case event_id % 9 when 0 then 12 when 1 then -7 when 2 then 3 when 3 then -3 when 7 then event_id when 8 then 1000 else 0 end::bigint as k from events")
def r_p3_coerce_int(spark, at):
    """Numbers, digits in text with blanks around, fractions, booleans, two signs, words, nulls, exponents."""
    made = F.expr("""case event_id % 9 when 0 then '" 12 "' when 1 then '"-7"' when 2 then '3.9' when 3 then '-3.9' when 4 then 'true' when 5 then '"--5"' when 6 then '"abc"' when 7 then cast(event_id as string) else '1e3' end""")
    return table(spark, at, "events").select("event_id", S.coerce_int(made).alias("k"))


_TAGGED = "case article_id % 3 when 0 then '<p> ' || original_description || ' </p>' when 1 then original_description || repeat(' <b>x</b>', 200) else original_description end"


@query(f"""select article_id, regexp_replace(left(regexp_replace(t, '<[^>]+>', '', 'g'), 500), {_STRIP}) as summary, left(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), {_STRIP}), 300) as comment, regexp_replace(left(t, 60), '<[^>]+>', '', 'g') as short
  from (select article_id, {_TAGGED} as t from articles) where t is not null""")
def r_x1_strip_tags(spark, at):
    """Tags off, cut, stripped; tags off, stripped, cut; cut first."""
    t = F.col("t")
    rows = table(spark, at, "articles").select("article_id", F.expr(_TAGGED).alias("t")).where("t is not null")
    return rows.select("article_id", S.strip(F.substring(S.strip_tags(t), 1, 500)).alias("summary"), F.substring(S.strip(S.strip_tags(t)), 1, 300).alias("comment"), S.strip_tags(F.substring(t, 1, 60)).alias("short"))


@query("""select doc_id, len(regexp_extract_all(text, 'https?://[^\\s)]+')) as links, nullif(regexp_extract('https://news.ycombinator.com/item?id=' || doc_id || '&p=2', 'item\\?id=(\\d+)', 1), '') as item from documents where text is not null""")
def r_x17_links(spark, at):
    item = F.regexp_extract(F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("doc_id").cast("string"), F.lit("&p=2")), r"item\?id=(\d+)", 1)
    return table(spark, at, "documents").where("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"https?://[^\s)]+"), F.lit(0))).cast("long").alias("links"), F.nullif(item, F.lit("")).alias("item"))
