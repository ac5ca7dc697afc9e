import datetime as dt

from pyspark.sql import functions as F

from feedloom.operators import judging as G
from feedloom.operators import reports as R


def test_flattened(spark):
    rows = [("a", '[{"t": 1}, {"t": 2}, 5]'), ("b", '{"x": [{"t": 3}], "y": [{"t": 4}]}'), ("c", '"text"'), ("d", None), ("e", "{bad")]
    got = sorted((r.source, r.category, r.ord, r.article) for r in G.flattened(spark.createDataFrame(rows, "source string, articles string")).collect())
    assert got == [("a", "", 0, '{"t":1}'), ("a", "", 1, '{"t":2}'), ("b", "x", 0, '{"t":3}'), ("b", "y", 0, '{"t":4}')]


def test_quality_view_and_mean(spark):
    rows = [
        (1, '{"relevance": {"score": 4, "reasoning": "x"}, "completeness": {"score": 3.5, "missed_urls": ["u", null]}, "faithfulness": {"score": true}, "overall": 3.7}'),
        (2, '{"relevance": 2, "missed_urls": ["v"], "completeness": {"missed_urls": ["u"]}}'), (3, "{}"), (4, None), (5, "nope")]
    got = {r.k: r for r in G.quality_view(spark.createDataFrame(rows, "k int, reply string")).withColumn("mean", G.overall_mean()).collect()}
    assert (got[1].relevance, got[1].completeness, got[1].faithfulness, got[1].overall, got[1].missed_urls) == (4.0, 3.5, None, 3.7, ["u"]) and got[1].mean == 3.8
    assert (got[2].relevance, got[2].missed_urls, got[2].overall) == (2.0, ["v"], 0.0)
    assert all(got[k].missed_urls == [] and got[k].mean == 0.0 for k in (3, 4, 5))


def test_predicates_and_texts(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    assert one(G.needs_reconcile(F.lit(2.0), F.lit(3), F.lit(False))) and not one(G.needs_reconcile(F.lit(None).cast("double"), F.lit(3), F.lit(False)))
    assert one(G.quality_reason(F.lit(None).cast("boolean"), F.lit("r"))) == "" and one(G.quality_reason(F.lit(True), F.lit("r"))) == "r"
    assert one(G.allowed_tags(F.lit("<b>x</b><br/><p class='a'>y</p><bold>"), strict=True)) == "<b>x</b>y"
    assert one(G.allowed_tags(F.lit("a<br/>b<br>"))) == "a<br/>b"
    assert one(G.unfenced(F.lit("```json\n{}\n```"))) == "{}" and one(G.archive_path(F.lit("2026-01-05"))) == "archive/2026-01/2026-01-05.html"


def test_gate_relinks_and_blocks(spark):
    docs = spark.createDataFrame([(1, "- A long title here (5 pt)\n- [ok](https://h/2) (1 pt)"), (2, "- unknown words (7 users)"), (3, "prose"), (4, "- Twice told tale (3 pt)")], "doc_id int, text string")
    index = spark.createDataFrame([("a long title here", "https://h/1"), ("twice told tale", "https://h/3"), ("twice told tale", "https://h/4")], "title string, url string")
    lines = R.lines_of(docs, "doc_id", "text")
    assert {r.doc_id: r.decision for r in G.checked(lines, index).collect()} == {1: "allow", 2: "block", 3: "allow", 4: "block"}
    first = G.relinked(lines, index).where("doc_id = 1 and pos = 0").first().line
    assert first == "- [A long title here](https://h/1) (5 pt)"
    again = G.relinked(G.relinked(lines, index), index)
    assert again.where("doc_id = 1 and pos = 0").first().line == first


def test_state(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    files = spark.createDataFrame([("a", t(1)), ("b", t(3)), ("c", t(2))], "step string, mtime timestamp")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, step string")
    assert [r.step for r in G.stale(files, edges).collect()] == ["c"]
    gaps = spark.createDataFrame([("e", dt.date(2026, 1, 2)), ("e", dt.date(2026, 1, 5)), ("f", dt.date(2026, 1, 1))], "edition string, day date")
    told = spark.createDataFrame([("e", dt.date(2026, 1, 5))], "edition string, day date")
    assert [r.edition for r in G.new_absences(gaps, told).collect()] == ["f"]
    m = spark.createDataFrame([("d", "1", "x"), ("d", "2", "y")], "run_date string, message_id string, text string")
    assert [r.message_id for r in G.undelivered(m, m.where("message_id = '1'")).collect()] == ["2"]
    series = spark.createDataFrame([("e", dt.date(2026, 1, d), float(v)) for d, v in ((1, 5), (2, 9), (3, -1))], "edition string, day date, overall double")
    assert G.sparkline(series, "edition").first().points == "4.0,4.0 120.0,4.0 236.0,36.0"
    assert G.sparkline(series.where("overall = 5"), "edition").first().points == "120.0,4.0"


def test_judge_whitelist_and_reasons(spark):
    rows = [
        (1, '{"scores": {"relevance": {"score": 2, "reasoning": "r", "x": 1}, "completeness": {"score": 2.5}, "faithfulness": {"score": true}}, "missed_urls": ["u", 3, "v"], "quality_alert": false}', 2.2),
        (2, '{"scores": {"relevance": "no", "faithfulness": {"score": 5}}, "missed_urls": "u"}', 5.0), (3, "[]", 0.0), (4, None, 0.0)]
    got = {r.k: r for r in G.judged(spark.createDataFrame(rows, "k int, reply string, overall double")).withColumn("why", G.alert_reasons(F.col("overall"))).collect()}
    assert got[1].relevance.score == "2" and got[1].missed_urls == ["u", "v"] and got[1].why == "relevance=2；completeness=2.5，遺漏：['u', 'v']；overall=2.2"
    assert got[2].relevance is None and got[2].faithfulness.score == "5" and got[2].missed_urls == [] and got[2].why == ""
    assert got[3].why == got[4].why == "" and got[4].missed_urls == []


def test_table_rows_are_relinked(spark):
    docs = spark.createDataFrame([(1, "| A long title here (5 pt) | x |\n• A long title here (1,200pt) more\n| other | (3 pt) |")], "doc_id int, text string")
    index = spark.createDataFrame([("a long title here", "https://h/1")], "title string, url string")
    got = [r.line for r in G.relinked(R.lines_of(docs, "doc_id", "text"), index).orderBy("pos").collect()]
    assert got == ["| [A long title here](https://h/1) (5 pt) | x |", "• [A long title here](https://h/1) (1,200pt) more", "| other | (3 pt) |"]


def test_relinking_broadcasts_no_lines(spark):
    """Lines of a small file may be large, and as many as their titles; addresses go back to their place, also a null one."""
    docs = spark.range(60).select(F.when(F.col("id") < 59, F.col("id")).alias("doc_id"), F.concat(F.lit("- story number "), F.col("id"), F.lit(" today (5 pt) story number\nprose (9 pt)")).alias("text"))
    index = spark.range(58).select(F.concat(F.lit("Story number "), F.col("id"), F.lit(" today")).alias("title"), F.concat(F.lit("https://h/"), F.col("id")).alias("url"))
    lines = R.lines_of(docs, "doc_id", "text")
    out = G.relinked(lines, index)
    got = {(r.doc_id, r.pos): r.line for r in out.collect()}
    assert len(got) == 120 and got[7, 0] == "- [story number 7 today](https://h/7) (5 pt) story number" and got[7, 1] == "prose (9 pt)"
    assert got[58, 0] == "- story number 58 today (5 pt) story number" and got[None, 0].startswith("- story number 59")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_messages_and_delivery(spark):
    long = "<p>" + "x" * 5000
    assert spark.range(1).select(G.message(F.lit("<b>a<p>b</p>")).alias("m")).first().m == "<b>ab"
    assert len(spark.range(1).select(G.message(F.lit(long)).alias("m")).first().m) == 4096
    m = spark.createDataFrame([("d", "1", "x"), ("d", "2", None)], "run_date string, message_id string, text string")
    got = {r.message_id: (r.ok, bool(r.error)) for r in G.delivered(m, lambda t: len(t) > 0).collect()}
    assert got == {"1": (True, False), "2": (False, True)}


def test_day_violations(spark):
    runs = spark.createDataFrame([("d1", "judge", "ran"), ("d1", "digest", "ran"), ("d2", "judge", "loaded")], "run_date string, step string, status string")
    usage = spark.createDataFrame([("d1", 0)], "run_date string, total_tokens long")
    lines = R.lines_of(spark.createDataFrame([("d2", "a @@1@@")], "run_date string, text string"), "run_date", "text")
    assert sorted((r.run_date, r.code, r.sample) for r in G.day_violations(runs, usage, lines, ["judge", "digest"]).collect()) == [("d1", "zero_tokens", "digest, judge"), ("d2", "leftover_token", "a @@1@@")]
