import datetime as dt

from pyspark.sql import functions as F

from feedloom.streaming import daily


def test_closed_windows_equal_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2026, 1, 1 + i // 4, i % 24), "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, k string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    out = daily.daily_counts(daily.stream(spark, str(tmp_path / "in"), df.schema), ["k"], late="1 day")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.start, r.k): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.d, r.k): r.n for r in df.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 4


def test_day_upsert_keeps_days_that_come_in_parts(spark, tmp_path):
    schema = "run_date string, k int, n int"
    for i, rows in enumerate(([("2026-01-01", 1, 1), ("2026-01-02", 1, 2)], [("2026-01-01", 2, 3), ("2026-01-02", 1, 9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        daily.upsert_days(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "st"), ["k"]).awaitTermination()
    want = [("2026-01-01", 1, 1), ("2026-01-01", 2, 3), ("2026-01-02", 1, 9)]
    read = lambda: sorted((str(r.run_date), r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert read() == want
    daily.upsert_days(spark.readStream.schema(schema).option("latestFirst", "false").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "again"), ["k"]).awaitTermination()
    assert [r[:2] for r in read()] == [r[:2] for r in want]


def test_first_seen(spark, tmp_path):
    spark.createDataFrame([("u", dt.datetime(2026, 1, 1)), ("u", dt.datetime(2026, 1, 2)), ("v", dt.datetime(2026, 1, 2))], "url string, ts timestamp").write.parquet(str(tmp_path / "in"))
    out = daily.first_seen(spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in")), ["url"])
    out.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.url for r in spark.table("firsts").collect()) == ["u", "v"]


def test_cool_down(spark, tmp_path):
    df = spark.createDataFrame([("s", dt.date(2026, 1, d)) for d in (1, 3, 8, 9, 20)], "subject string, day date")
    df.write.parquet(str(tmp_path / "in"))
    out = daily.cool_down(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("cooled").option("checkpointLocation", str(tmp_path / "st")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.day.day for r in spark.table("cooled").collect()) == [1, 8, 20]


def test_chronic_episodes(spark, tmp_path):
    days = [(1, False), (2, True), (3, False), (4, False), (5, False), (6, False), (11, False), (12, False), (30, False)]
    spark.createDataFrame([("s", dt.date(2026, 1, d), ok) for d, ok in days] + [("t", dt.date(2026, 1, 1), False)], "subject string, day date, ok boolean").write.parquet(str(tmp_path / "in"))
    out = daily.chronic_episodes(spark.readStream.schema("subject string, day date, ok boolean").parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "st")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.subject, r.day.day, r.failures) for r in spark.table("episodes").collect()) == [("s", 4, 3), ("s", 11, 3)]
