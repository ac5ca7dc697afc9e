import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedloom.functions import scalars as S
from feedloom.functions import texts as X
from feedloom.operators import articles as A
from feedloom.operators import graph, ranking
from feedloom.operators import health as H
from feedloom.operators import joins as J
from feedloom.operators import reports as R
from feedloom.operators import tables as K
from feedloom.operators import vectors as V
from feedloom.plans import stages
from feedloom.sources import feeds


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("12", 12), ('" -7 "', -7), ("3.9", 3), ("-3.9", -3), ("true", 0), ('"--5"', 0), ('"abc"', 0), (None, 0), ("1e3", 1000), ('"2.5"', 0)])
def test_coerce_int(spark, text, want):
    assert one(spark, S.coerce_int(F.col("t").cast("string")), t=text) == want


@pytest.mark.parametrize("bits", range(16))
def test_verdict_truth_table(spark, bits):
    args = [bool(bits >> k & 1) for k in range(4)]
    assert one(spark, S.run_verdict(*[F.lit(a) for a in args]), z=1) == stages.verdict(*args)


@pytest.mark.parametrize("text,want", [("Connection refused", "network"), ("Errno 111", "network"), ("HTTP Error 503", "upstream_http"), ("urlopen error", "network"), ("parse_llm_json failed on ''", "empty_llm"), ("parse_llm_json failed on x", "parse"), ("bad JSON", "parse"), ("無法解析：空", "empty_llm"),
    ("Connection timed out", "other"), ("context length 404 tokens", "other"), ("Telegram status False", "other"), ("empty reply", "other"), ("boom", "other"), (None, "other")])
def test_error_class(spark, text, want):
    assert one(spark, S.classify_error(F.col("t").cast("string")), t=text) == want


def test_dates_and_formats(spark):
    assert one(spark, S.loose_date(F.lit("2026-1-5")), z=1) == dt.date(2026, 1, 5)
    assert one(spark, S.strict_date(F.lit("2026-1-5")), z=1) is None
    dates = {"Tue, 03 Feb 2026 10:00:00 +0900": "2026-02-03T10:00:00+09:00", "3 feb 2026 9:05 GMT": "2026-02-03T09:05:00+00:00", "Tue, 03 Feb 2026 10:00:00 -0000": "2026-02-03T10:00:00", "Tue, 03 Feb 2026 10:00:00 PDT": "2026-02-03T10:00:00-07:00", "soon": "soon", "31 Feb 2026 10:00 GMT": "31 Feb 2026 10:00 GMT"}
    assert {d: one(spark, S.mail_date(F.lit(d)), z=1) for d in dates} == dates
    assert one(spark, S.day_number(F.lit("2026-10-17").cast("date")), z=1) == 739906
    assert [one(spark, S.duration_text(F.lit(float(s))), z=1) for s in (0, 59, 3660)] == ["—", "0m", "1:01"]
    assert [one(spark, S.token_text(F.lit(n)), z=1) for n in (12, 1500, 2_000_000)] == ["12", "2K", "2.00M"] and one(spark, S.token_text(F.lit(None).cast("long")), z=1) == "—" and one(spark, S.token_text(F.lit(2500)), z=1) == "2K"
    assert [one(spark, S.fixed_text(F.lit(x)), z=1) for x in (5.45, 5.25, -0.1, 0.05, 4.0)] == [f"{x:.1f}" for x in (5.45, 5.25, -0.1, 0.05, 4.0)]
    assert [one(spark, S.safe_path(F.lit(x)), z=1) for x in ("a/./b", "a/../b", "../b", "/b", "a/../../b")] == ["a/b", "b", None, None, None]
    assert one(spark, S.classify_url(F.lit("https://netflix.com/a")), z=1) == "twitter"
    assert one(spark, S.classify_url(F.lit("https://netflix.com/a"), exact_host=True), z=1) == "general"
    urls = {"https://news.ycombinator.com/": "general", "https://news.ycombinator.com/item?id=3": "hn", "https://www.reddit.com/r/a/": "general", "https://www.reddit.com/r/a/comments/b": "reddit", "https://X.com/a": "general", "https://twitter.com/a": "twitter"}
    for exact in (False, True):
        assert {u: one(spark, S.classify_url(F.lit(u), exact), z=1) for u in urls} == urls


def test_number_or_null(spark):
    got = spark.createDataFrame([('{"a": 1}',), ('{"a": true}',), ('{"a": "1"}',), ('{}',), ("nope",)], "j string").select(S.number_or_null(F.try_variant_get(F.try_parse_json("j"), "$.a", "variant")).alias("x")).collect()
    assert [r.x for r in got] == [1.0, None, None, None, None]


def test_texts():
    assert X.filled_links("- [a](@@1@@) [b](@@9@@)\n- c](@@2@@)", {1: "u", 2: "v"}) == "- [a](u) [b](@@9@@)\n- [c](v)"
    assert X.filled_links("2. t](@@1@@) (5 pt)\n• t](@@1@@)\n| x | t](@@2@@) |\nprose](@@1@@)", {1: "u", 2: "v"}) == "2. [t](u) (5 pt)\n• [t](u)\n| x | [t](v) |\nprose](@@1@@)"
    assert X.filled_links("[t [new]]( @@1@@ )", {1: "u"}) == "[t [new]](u)"
    assert X.filled_anchors('<a href="@@1@@">x</a> <a href="@@2@@">', {1: "u"}) == '<a href="u">x</a> <a href="@@2@@">'
    assert X.without_dead_links("[a [x]](no) [b](https://h) @@3@@") == ("a [x] [b](https://h) ", 2)
    assert X.without_dead_links("[a](two words) t](@@3@@) [c](#)") == ("a t c", 3)
    assert X.without_dead_anchors('<a href="x">t</a> <a href="https://h">k</a>') == ('t <a href="https://h">k</a>', 1)
    assert X.closed("<b>x<i>y") == "<b>x<i>y</i></b>" and X.closed("a<br/>") == "a<br/>"
    assert X.closed("<b><i>x</b>") == "<b><i>x</b></i></b>" and X.closed("<p>x <B>y") == "<p>x <B>y</b>"
    assert X.truncated("<b>" + "x" * 20, 10) == "<b>xxxx</b>..."
    assert X.repaired_json('```json\n{"a": 1,}\n```')[0] == '{"a": 1}' and X.repaired_json("no")[1]
    assert X.first_text('{"n": 1, "b": "t", "a": "u"}') == "t" and X.first_text("plain") == "plain"
    assert X.title_key("Ａ *b* [c]") == "abc"


def test_clean_orders_and_falls_back(spark):
    df = spark.createDataFrame([(1, "*", 5, 0), (2, "***", 0, 7), (3, "**", 9, 1), (4, None, 1, 1), (5, "?", 9, 9), (6, "**", 9, 0)], "article_id int, interest string, a int, b int")
    got = A.clean(df, [F.col("a"), F.col("b")]).collect()
    assert [(r.article_id, r.popularity) for r in got] == [(2, 7), (3, 9), (6, 9)]
    assert [r.article_id for r in A.clean(df, [F.col("a")], least="*").collect()] == [2, 3, 6, 1, 4]


def test_pick_and_enumerate_do_not_depend_on_partitions(spark):
    rows = [(i, f"u{i % 3}" if i % 7 else None) for i in range(30)]
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "ord int, url string").repartition(parts)
        assert sorted((r.url, r.ord) for r in A.pick(df.where("url is not null"), ["url"], F.col("ord")).collect()) == [("u0", 3), ("u1", 1), ("u2", 2)]
        assert sorted((r.number, r.url) for r in A.enumerated(df, "url", F.col("ord")).collect()) == [(0, "u1"), (1, "u2"), (2, "u0")]


def test_round_robin_skips_exhausted(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate("aabac")], "ord int, s string")
    assert [r.ord for r in A.round_robin(df, "s", F.col("ord"), 4).orderBy("turn", "ord").collect()] == [0, 2, 4, 1]


def test_search(spark):
    df = spark.createDataFrame([("The Model", None), ("model", "x")], "title string, s string")
    assert A.keyword_search(df, ["title", "s"], "model THE").count() == 1
    assert A.keyword_search(df, ["title"], "  ").count() == 0


def test_ledger(spark):
    df = spark.createDataFrame([(1, "u", "2026-01-01"), (2, "u", "2026-01-01"), (3, "u", "2026-01-08"), (4, "u", "2026-01-16"), (5, "", "2026-01-01"), (6, None, "2026-01-01"), (7, "u", "bad")], "article_id int, url string, run_date string")
    got = {r.article_id: (r.decision, str(r.original_date)) for r in A.ledger(df).collect()}
    assert got == {1: ("kept", "None"), 2: ("url_seen", "2026-01-01"), 3: ("url_seen", "2026-01-01"), 4: ("kept", "None")}
    chain = spark.createDataFrame([(1, "u", "2026-01-01"), (2, "u", "2026-01-07"), (3, "u", "2026-01-11")], "article_id int, url string, run_date string")
    assert [r.decision for r in A.ledger(chain).orderBy("article_id").collect()] == ["kept", "url_seen", "kept"]


def test_decided_day(spark):
    today = F.lit("2026-01-08").cast("date")
    d = lambda n: dt.date(2026, 1, n)
    new = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "b", [0.0, 1.0]), (4, "c", [0.6, 0.8]), (5, "d", [0.0, -1.0]), (6, "e", None), (7, "", [1.0, 0.0])], "ord int, url string, embedding array<double>")
    history = spark.createDataFrame([("a", d(1), [1.0, 0.0]), ("b", d(8), [0.0, 1.0]), ("x", d(3), [0.0, 1.0]), ("y", dt.date(2025, 12, 31), [0.0, -1.0])], "url string, day date, embedding array<double>")
    out = A.decided(new, history, today)
    got = {r.ord: (r.decision, r.original_date) for r in out.collect()}
    assert got == {1: ("url_seen", d(1)), 2: ("url_seen", d(8)), 3: ("semantic_dup", d(3)), 4: ("semantic_dup", d(3)), 5: ("kept", None), 6: ("kept", None)}
    after = {r.url: r.day for r in A.remembered(history, new, out, today).collect()}
    assert after == {"a": d(1), "b": d(8), "x": d(3), "y": dt.date(2025, 12, 31), "d": d(8), "e": d(8)}
    assert {r.decision for r in A.decided(new, history.limit(0), today).collect()} == {"kept", "url_seen"}
    assert A.decided(new.limit(0), history, today).count() == 0


def test_observe_and_escalate(spark):
    d = lambda n: dt.date(2026, 1, n)
    history = spark.createDataFrame([(d(n), "hn", "network") for n in (1, 2, 5)] + [(d(6), "rss", "ok")], "day date, subject string, outcome string")
    results = spark.createDataFrame([("hn", "parse"), ("rss", "ok")], "subject string, outcome string")
    none = spark.createDataFrame([], "subject string, last date")
    after, new, gaps, state = H.escalated(history, results, none, F.lit(d(7)))
    assert after.count() == 6 and [(r.subject, r.failures, r.dominant) for r in new.collect()] == [("hn", 4, "network")]
    assert sorted(r.day.day for r in gaps.collect()) == [3, 4] and {r.subject for r in state.collect()} == {"hn", "absent:2026-01-04"}
    again = H.escalated(after, results, state, F.lit(d(7)))
    assert again[0].count() == 6 and again[1].count() == again[2].count() == 0 and again[3].count() == 2
    empty = H.escalated(history, results.limit(0), none, F.lit(d(7)))
    assert empty[0].count() == 4 and empty[1].count() == empty[2].count() == empty[3].count() == 0


def test_nameless_entities_stay(spark):
    df = spark.createDataFrame([(None, "s", dt.date(2026, 1, n), "b") for n in (1, 2, 3)], "edition string, subject string, day date, outcome string").withColumn("ok", F.lit(False))
    assert [(r.edition, r.failures, r.window_days) for r in H.chronic(df).collect()] == [(None, 3, 3)]


def test_ledgers(spark):
    from feedloom.operators import ledgers as L

    e = spark.createDataFrame([("d", "a", "ran", 1.23456, 1), ("d", "a", "failed", 2.0, 2), ("d", "b", "ran", 1.0, 3)], "run_date string, step string, status string, duration_seconds double, at int")
    assert sorted((r.step, r.status, r.duration_seconds) for r in L.run_ledger(e, ["run_date"], F.col("at")).collect()) == [("a", "failed", 2.0), ("b", "ran", 1.0)]
    old = spark.createDataFrame([("d", "a", "ran"), ("d", "b", "ran")], "run_date string, step string, status string")
    new = spark.createDataFrame([("d", "a", "skipped"), ("d", "b", "failed"), ("d", "c", "skipped")], "run_date string, step string, status string")
    assert sorted((r.step, r.status) for r in L.merged_runs(old, new, ["run_date"]).collect()) == [("a", "ran"), ("b", "failed"), ("c", "skipped")]
    sums = "calls long, prompt_tokens long, completion_tokens long, total_tokens long"
    a = spark.createDataFrame([("d", "a", 1, 1, 1, 2)], f"run_date string, step string, {sums}")
    b = spark.createDataFrame([("d", "a", 5, 5, 5, 10), ("d", "n", 1, 1, 1, 2)], f"run_date string, step string, {sums}")
    steps = L.merged_usage_steps(a, b, ["run_date"])
    assert L.usage_totals(steps, ["run_date"]).first().total_tokens == 12
    ma, mb = a.withColumnRenamed("step", "model"), b.withColumnRenamed("step", "model")
    assert {r.model: r.total_tokens for r in L.merged_usage_models(ma, mb, a, b, ["run_date"]).collect()} == {"a": 12, "n": 2}
    assert {r.model: r.total_tokens for r in L.merged_usage_models(ma, mb, a, b.where("step = 'a'"), ["run_date"]).collect()} == {"a": 2}
    al = spark.createDataFrame([("d", "x", "old")], "run_date string, step string, error string")
    f = spark.createDataFrame([("d", "x", "new"), ("d", "y", "e" * 500)], "run_date string, step string, error string")
    assert {r.step: len(r.error) for r in L.alerts_recorded(al, f, ["run_date"]).collect()} == {"x": 3, "y": 300}
    assert {r.step: r.error[:3] for r in L.alerts_recorded(al, f, ["run_date"], forced=True).collect()} == {"x": "new", "y": "eee"}
    assert L.alerts_cleared(al, f, ["run_date"]).count() == 0


def test_model_replies(spark):
    from feedloom.plans import models as M

    rows = M.sent(spark.createDataFrame([("s", i, f"t{i}", "c") for i in range(4)], "g string, ord int, title string, comment_summary string"), ["g"], F.col("ord"))
    reply = '{"articles": [{"id": 0, "x": " one "}, {"id": 0, "x": "two"}, {"id": 9, "x": "no"}, {"id": "2", "x": "no"}, {"id": true, "x": "yes"}, {"id": 2, "x": " "}, 5]}'
    said = M.told(spark.createDataFrame([("s", reply), ("q", "broken"), ("r", None)], "g string, reply string"), ["g"], "reply", "articles", "x")
    assert [r.x for r in M.rebuilt(rows, said, ["g"], "x", [F.col("title")]).orderBy("id").collect()] == ["one", "yes", "t2", "t3"] and "comment_summary" not in rows.columns


def test_running_equals_window(spark):
    df = spark.createDataFrame([(i, ("a", "b", None)[i % 3], (i * 7) % 5) for i in range(200)], "id int, g string, w int")
    got = {r.id: (r._rank, r._before) for r in ranking.running(df.repartition(7), ["g"], [ranking.Down(F.col("w")), F.col("id")], weight=F.col("w")).collect()}
    for g in ("a", "b", None):
        before = 0
        own = sorted([(-((i * 7) % 5), i) for i in range(200) if ("a", "b", None)[i % 3] == g])
        for place, (w, i) in enumerate(own, 1):
            assert got[i] == (place, before)
            before -= w


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 102), (7, 7), (200, 40)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).distinct().collect())
    assert {k for k, v in got.items() if v == 1} == {*range(1, 41), 200} and got[101] == got[102] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame(edges, "a long, b long"), most_rounds=1)


def test_histories(spark):
    d = lambda n: dt.date(2026, 1, n)
    df = spark.createDataFrame([("e", "s", d(n), o) for n, o in ((1, "ok"), (5, "b"), (6, "a"), (7, "b"), (8, "a"), (10, "ok"))], "edition string, subject string, day date, outcome string").withColumn("ok", F.col("outcome") == "ok")
    r = H.chronic(df).first()
    assert (r.failures, r.dominant, r.window_days) == (4, "b", 5)
    assert H.streak(df, ["edition"]).first().streak_days == 1
    assert sorted(x.day.day for x in H.missing_days(df, ["edition"]).collect()) == [2, 3, 4, 9]
    assert [x.day.day for x in H.missing_days(df, ["edition"], until=F.lit("2026-01-13").cast("date")).orderBy("day").collect()] == [2, 3, 4, 9, 11, 12]
    rate = H.success_rates(H.recent(df, ["edition"], "day", 7), ["subject"]).first()
    assert (rate.ok, rate.total) == (1, 5)
    for f in (lambda x: H.chronic(x), lambda x: H.streak(x, ["edition"]), lambda x: H.missing_days(x, ["edition"])):
        assert f(df.limit(0)).count() == 0


def test_saturation(spark):
    df = spark.createDataFrame([("e", dt.date(2026, 1, 1) + dt.timedelta(i), 4.5 if i else 2.0) for i in range(30)], "edition string, day date, overall double")
    r = H.saturation(df, "edition").first()
    assert (r.n, r.low, r.top, r.histogram["4.5"]) == (30, 2.0, 4.5, 29)
    assert H.saturation(df.where("day > date '2026-01-01'"), "edition").count() == 0


def test_status(spark):
    res = spark.createDataFrame([(1, "hn", True), (1, "rss", True), (2, "hn", True), (2, "rss", False), (3, "hn", True), (3, "rss", True), (3, "vault", False), (4, None, None)], "d int, subject string, ok boolean")
    assert {r.d: r.status for r in H.run_status(res, ["d"], ["hn", "rss"]).collect()} == {1: "success", 2: "failed", 3: "partial", 4: "unknown"}


def test_title_match(spark):
    lines = spark.createDataFrame([(1, "Big News"), (2, "a long enough title here"), (3, "twice told"), (4, "short")], "line_id int, title string")
    index = spark.createDataFrame([("big  news", "u1"), ("A long enough title", "u2"), ("twice told", "u3"), ("twice told", "u4"), ("shorter", "u5"), ("x", "")], "title string, url string")
    assert dict(map(tuple, J.matched_titles(lines, index).collect())) == {1: "u1", 2: "u2", 3: None, 4: None}


def test_title_match_broadcasts_no_fragments(spark):
    """A small file of titles has many times its rows in fragments, which the driver must not hold."""
    rows = spark.range(300).select("id", F.md5(F.col("id").cast("string")).alias("m"))
    lines = rows.select(F.col("id").alias("line_id"), F.expr("case id % 3 when 0 then m when 1 then substring(m, 5, 20) else 'held ' || m || ' by' end").alias("title"))
    got = J.matched_titles(lines, rows.select(F.col("m").alias("title"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url")))
    assert {r.line_id: r.url for r in got.collect()} == {i: f"u{i}" for i in range(300)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_title_match_over_several_titles_and_sides(spark):
    """A line's titles count together, equal before held; blanks, repeated letters, missing titles and addresses."""
    lines = spark.createDataFrame([(1, "same title"), (1, "other long title here"), (2, "first title"), (2, "second title"), (3, "aaaaaaaaaaaa"), (4, None), (5, " *_"), (6, "no such title"), (7, "holds a known tale and more"), (8, "known tale of old")], "line_id int, title string")
    index = spark.createDataFrame([("Same title", "u1"), ("long title here", "u2"), ("first title", "u3"), ("second title", "u4"), ("aaaaaaaaaaaaaaaa", "u5"), ("no such title", None), ("a known tale", "u6"), ("a known tale", "u6"), ("", "u7"), (None, "u8")], "title string, url string")
    assert dict(map(tuple, J.matched_titles(lines, index).collect())) == {1: "u1", 2: None, 3: "u5", 4: None, 5: None, 6: None, 7: "u6", 8: None}


def test_originals_last_wins(spark):
    scored = spark.createDataFrame([("u",), ("v",)], "url string")
    raw = spark.createDataFrame([("u", "", 1, "t1", "d"), ("x", "u", 2, "t2", ""), ("", None, 3, "t3", "")], "url string, alt_url string, ord int, title string, description string")
    got = {r.url: (r.original_title, r.original_description) for r in J.with_originals(scored, raw).collect()}
    assert got == {"u": ("t2", None), "v": (None, None)}


def test_reports(spark):
    text = "# T\n- [a](https://h/1) (5 pt)\n- b (7 users)\n| c | (1,200 ups) |\nprose (3 pt)\n@@4@@ left\nsee (https://h/1)\n• d (1234pt)\n 2. e ( 88 users )"
    lines = R.lines_of(spark.createDataFrame([(1, text), (2, None)], "k int, text string"), "k", "text")
    got = {r.code: (r["count"], r.sample) for r in R.check_report(lines, "k").collect()}
    assert got["leftover_token"][0] == 1 and got["unlinked_articles"] == (4, "- b (7 users)；| c | (1,200 ups) |；• d (1234pt)")
    comments = spark.createDataFrame([("https://h/1", "nice")], "url string, comment string")
    own = R.lines_of(spark.createDataFrame([(1, text + "\n  - **社群觀點**：made up\nkept 💬 社群觀點: gone\n| 社群觀點：stays |")], "k int, text string"), "k", "text")
    out = R.joined(R.with_views(own, comments, "k"), "k", ["pos", "part"]).first().text
    assert out.count("nice") == 1 and out.split("\n")[2] == "   💬 社群觀點：nice" and out.endswith("\nkept\n| 社群觀點：stays |") and "made up" not in out
    again = R.with_views(R.lines_of(spark.createDataFrame([(1, out)], "k int, text string"), "k", "text"), comments, "k")
    assert R.joined(again, "k", ["pos", "part"]).first().text == out
    assert [r.section for r in R.sections(lines, "k").orderBy("pos").collect()][0] == "T"
    breaks = R.list_breaks(R.lines_of(spark.createDataFrame([(1, "p\n1. a\n2. b\n   note\n- c\n\n- d\nq\n  - e\n**b** x\n* f")], "k int, text string"), "k", "text"), "k")
    assert [r.pos for r in breaks.where("break_before").orderBy("pos").collect()] == [1, 10]


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    K.replace_days(spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "run_date string, n int"), path)
    for _ in range(2):
        K.replace_days(spark.createDataFrame([("2026-01-02", 9)], "run_date string, n int"), path)
    assert sorted(r.n for r in K.read_days(spark, path, "2026-01-01", "2026-01-31", "run_date string, n int").collect()) == [1, 9]
    assert K.read_days(spark, path + "-none", "a", "b", "run_date string, n int").count() == 0
    (tmp_path / "h.json").write_text('[{"date": "d1", "n": 1}, 5, "x", {"date": "d2"}]')
    (tmp_path / "bad.json").write_text('{"date": 1')
    assert [tuple(r) for r in K.history(spark, str(tmp_path / "h.json"), "date string, n int").collect()] == [("d1", 1), ("d2", None)]
    assert K.history(spark, str(tmp_path / "bad.json"), "date string").count() == K.history(spark, str(tmp_path / "no.json"), "date string").count() == 0
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, K.upserted(old, new, ["k"], F.col("v")).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_feeds(spark):
    rss = '<rss version="2.0"><channel><item><title>A &amp; B</title><link> https://h/1 </link><description><![CDATA[<p>x</p>]]></description><pubDate>Tue, 03 Feb 2026 10:00:00 +0000</pubDate></item><item><title>C</title><link>https://h/2</link></item></channel></rss>'
    rdf = '<rdf:RDF xmlns:rdf="r" xmlns:hatena="h"><item><title>R</title><link>https://h/3</link><hatena:bookmarkcount>12</hatena:bookmarkcount></item></rdf:RDF>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="https://h/4"/><content>c</content></entry></feed>'
    df = spark.createDataFrame([("rss", rss), ("rdf", rdf), ("atom", atom), ("bad", "<rss><cha")], "source string, body string")
    got = {(r.source, r.ord): r for r in feeds.rss_items(df).collect()}
    assert got["rss", 0].title == "A & B" and got["rss", 0].url == "https://h/1" and got["rss", 0].description == "x" and got["rss", 0].published == "2026-02-03T10:00:00+00:00"
    assert got["rdf", 0].bookmarks == 12 and got["atom", 0].url == "https://h/4" and got["bad", 0].error
    assert feeds.rss_items(df, per_feed=1).where("source = 'rss'").count() == 1
    entries = spark.createDataFrame([("https://r/1", '&lt;a href="https://h/9"&gt;[link]&lt;/a&gt;'), ("https://r/2", "talk"), ("https://r/3", None)], "url string, content string")
    assert [r.orig_url for r in feeds.linked_entries(entries).orderBy("url").collect()] == ["https://h/9", "https://r/2", "https://r/3"]
    two = spark.createDataFrame([("u", rss), ("v", "<rss><cha")], "url string, body string")
    config = spark.createDataFrame([("u", "N", None, 1), ("v", "M", "C", None), ("", "E", "C", 3), ("w", None, None, None)], "url string, name string, category string, max_items int")
    assert [(r.source, r.category, r.title) for r in feeds.configured_items(two, config).collect()] == [("N", "Tech", "A & B")]
    both = spark.createDataFrame([(1, "pre\n<!-- lang:zh -->\n z \n<!-- LANG:en -->\ne\nf\n"), (2, "none"), (3, None)], "k int, text string")
    assert sorted((r.k, r.lang, r.body) for r in feeds.language_sections(both, "k").collect()) == [(1, "en", "e\nf"), (1, "zh", "z")]


def test_comments_pages_and_responses(spark):
    trees = spark.createDataFrame([(1, ["<p>a</p>", "[deleted]", "", None, "b"]), (2, None)], "item_id int, children array<string>")
    assert [r.comments for r in feeds.top_comments(trees).orderBy("item_id").collect()] == [["a", "b"], []]
    row = lambda i, to, name, more="": f'<tr class="athing submission" id="{i}"><td><span class="titleline"><a href="{to}">{name}</a></span></td></tr>{more}'
    page = "<b>top</b>" + row(7, "item?id=7", " T ", '<span id="score_7">12 points</span><a href="item?id=7">3&nbsp;comments</a>') + row(8, "https://h", "V", '<span id="score_9">5 points</span>') + row(9, "", "none")
    rows = feeds.front_page(spark.createDataFrame([("hn", page), ("empty", ""), ("null", None)], "source string, html string")).orderBy("ord").collect()
    assert [(r.item, r.title, r.score, r.comments) for r in rows] == [("7", "T", 12, 3), ("8", "V", 0, 0)] and [r.url for r in rows] == ["https://news.ycombinator.com/item?id=7", "https://h"]
    raw = spark.createDataFrame([("HTTP/1.1 429 Too Many\r\nX-RateLimit-Reset: 17.5\r\n\r\nbody\n\nmore",), ("<feed/>\n\nx",)], "raw string")
    assert {(r.status, r.reset_seconds, r.body) for r in feeds.response_parts(raw).collect()} == {(429, 17.5, "body\n\nmore"), (None, None, "<feed/>\n\nx")}
    asked = spark.createDataFrame([("g", 0, 0, "HTTP/1.1 429 X\r\nx-ratelimit-reset: 90\r\n\r\n"), ("g", 0, 1, "HTTP/1.1 200 OK\r\nx-ratelimit-reset: 3\r\n\r\nb"), ("g", 0, 2, "b"), ("g", 1, 0, "b")], "g string, ord int, attempt int, raw string")
    assert [(r.ord, r.attempt, r.waited, r.used) for r in feeds.paced(asked, "g").orderBy("ord", "attempt").collect()] == [(0, 0, 0.0, False), (0, 1, 70.0, True), (1, 0, 5.0, True)]


def test_nearest_is_exact(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id int, embedding array<double>")
    got = V.nearest(df.where("vec_id < 10"), df, 3, block=4, rows=16).collect()
    sims = v @ v.T
    np.fill_diagonal(sims, -2)
    for r in got:
        assert r.neighbour == np.argsort(-sims[r.query])[r.place - 1]


def test_pipeline(spark, tmp_path):
    calls = []

    def make(name, fail=0):
        def build(done):
            calls.append(name)
            if calls.count(name) <= fail:
                raise ValueError("timeout")
            return spark.createDataFrame([(name,)], "v string")
        return build

    waits = []
    p = stages.Pipeline(spark, f"file://{tmp_path}", [stages.Stage("a", 1, make("a")), stages.Stage("b", 2, make("b", fail=1), tries=3)], sleep=waits.append)
    assert set(p.run("2026-01-01")) == {"a", "b"} and waits == [1.0]
    p.log.clear()
    p.run("2026-01-01")
    assert [x["status"] for x in p.log] == ["loaded", "loaded"]
    p.log.clear()
    p.run("2026-01-01", forced={"a"})
    assert [x["status"] for x in p.log] == ["ran", "ran"]


def test_derived_tables_are_built_once_per_files(spark, tmp_path):
    from feedloom.runtime import Workspace, derived, signature

    built = []
    spark.range(5).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    make = lambda: (built.append(1), t.select((F.col("id") * 2).alias("x")))[1]
    assert sorted(r.x for r in derived("twice", make, t, a=1).collect()) == sorted(r.x for r in derived("twice", make, t, a=1).collect()) == [0, 2, 4, 6, 8]
    assert len(built) == 1 and derived("twice", make, t, a=2).count() == 5 and len(built) == 2
    assert signature(spark.createDataFrame([(1,)], "a int")) is None
    w = Workspace(spark)
    assert w.get("a.json") is None
    w.put("a.json", "x")
    w.put("a.json", "ä")
    assert w.get("a.json") == "ä"


def test_feed_files_and_source(spark, tmp_path):
    from feedloom.sources import files

    (tmp_path / "a.xml").write_text("<rss><channel><item><title>A</title></item></channel></rss>")
    (tmp_path / "b.xml").write_bytes(b"<rss>\xff")
    assert {r.source: r.body[:5] for r in files.feed_files(spark, f"{tmp_path}/*.xml").collect()} == {"a": "<rss>", "b": "<rss>"}
    files.register(spark)
    rows = {r.source: r for r in spark.read.format("feeds").option("path", f"{tmp_path}/*.xml").load().collect()}
    assert rows["a"].error is None and rows["b"].body is None and rows["b"].error
    assert spark.read.format("feeds").option("path", f"{tmp_path}/none/*").load().count() == 0


def test_endpoints(spark):
    from feedloom import endpoints

    rows = [("2026-01-08", 1, 1, "The Model", "s", None, "u"), ("2026-01-08", 0, 2, None, "model the", "x", "u"), ("2026-01-01", 0, 3, "old the model", None, None, "u"), ("2025-12-31", 0, 4, "older the model", None, None, "u"), ("bad", 0, 5, "the model", None, None, "u")]
    d = spark.createDataFrame(rows, "run_date string, ord int, digest_id int, title string, summary string, source_label string, url string")
    today = F.lit("2026-01-08").cast("date")
    assert [(r.run_date, r.digest_count, r.themes) for r in endpoints.recent_briefs(d, today).collect()] == [("2026-01-08", 2, ["The Model"]), ("2026-01-01", 1, ["old the model"])]
    assert [r.digest_id for r in endpoints.search(d, "the MODEL", today).collect()] == [2, 1, 3] and endpoints.search(d, " ", today).count() == 0


def test_usage_table_grows_by_calls(spark, tmp_path):
    from feedloom.operators import ledgers as L

    e = spark.createDataFrame([(1, "e", "d1", "", "m", 1, 1, 0), (2, "e", "d1", "s", "m", None, None, None), (1, "e", "d1", "", "m", 1, 1, 0)], "event_id int, edition string, run_date string, step string, model string, prompt_tokens long, completion_tokens long, total_tokens long")
    L.append_usage(e, f"{tmp_path}/u")
    assert [(r.step, r.total_tokens) for r in spark.read.parquet(f"{tmp_path}/u").collect()] == [("other", 2)]


def test_a_retry_gets_a_hint(spark, tmp_path):
    hints = []

    def build(done, hint):
        hints.append(hint)
        if not hint:
            raise ValueError("bad form")
        return spark.createDataFrame([(hint,)], "v string")

    p = stages.Pipeline(spark, f"file://{tmp_path}", [stages.Stage("a", 1, build, tries=2, reflect=lambda error: f"mind: {error}")], sleep=lambda s: None)
    assert p.run("2026-01-01")["a"].first().v == "mind: bad form" and hints == ["", "mind: bad form"] and p.log[0]["status"] == "ran"


def test_clear_removes_cut_tables(spark):
    import os

    from feedloom.runtime import clear, cut

    at = cut(spark.range(3)).inputFiles()[0].removeprefix("file://")
    assert os.path.exists(at)
    clear(spark)
    assert not os.path.exists(at) and cut(spark.range(3)).count() == 3


def test_arguments_and_command_line(capsys):
    from feedloom.__main__ import run

    assert stages.parsed_arguments("--force hn, nope --only rss judge x", {"hn", "rss", "judge"}) == ({"hn"}, {"rss", "judge"})
    assert stages.parsed_arguments("hn", {"hn"}) == (set(), set())
    assert run(["list"]) == 0 and "p6_found" in capsys.readouterr().out and run(["run"]) == 2


def test_day_reports(spark, tmp_path):
    from feedloom.sources import files

    for day in ("2026-01-02", "2026-01-10", "_state", "2026-1-3"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "report.md").write_text(f"# {day}\nx")
    (tmp_path / "2026-01-04").mkdir()
    assert [(r.run_date, r.text) for r in files.day_reports(spark, str(tmp_path)).collect()] == [("2026-01-10", "# 2026-01-10\nx"), ("2026-01-02", "# 2026-01-02\nx")]
