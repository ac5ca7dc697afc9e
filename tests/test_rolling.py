import datetime as dt


from feedloom.operators import rolling as R

SCHEMA = "edition string, run_date string, results map<string,string>, recorded_at timestamp, subject string"


def at(hour):
    return dt.datetime(2026, 1, 1, hour)


def history(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(outcomes, periods=(7, 30)):
    """Totals by counting, for [(subject, day, ok)] of one edition."""
    out = {}
    for s in {o[0] for o in outcomes}:
        own = [(d, ok) for x, d, ok in outcomes if x == s]
        day, last = min(d for d, _ in own), max(d for d, _ in own)
        while day <= last:
            for p in periods:
                near = [ok for d, ok in own if 0 <= (day - d).days < p]
                out[s, day, p] = (sum(near), len(near) - sum(near))
            day += dt.timedelta(1)
    return out


def test_latest_record_counts_and_dirty_dates_do_not(spark):
    h = history(spark, [
        ("e", "2026-01-01", {"hn": "ok"}, at(1)), ("e", "2026-01-01", {"hn": "parse"}, at(2)), ("e", "2026-01-01", {"hn": "parse"}, at(2)),
        ("e", "2026-01-02", {"hn": "ok"}, at(1)), ("e", "2026-01-02", None, at(2)), ("e", "2026-02-30", {"hn": "ok"}, at(1)), ("e", "2026/01/05", {"hn": "ok"}, at(1)),
        ("e", None, {"hn": "ok"}, at(1)), ("e", "2026-01-04", {"hn": "", "rss": None, "vault": "ok"}, at(1)), ("e", "2026-01-06\n", {"hn": "ok"}, at(1)), ("e", "2026-01-07", {"hn": "ok"}, at(1)), (None, "2026-01-07", {"hn": "ok"}, None)])
    got = {(r.edition, r.subject, str(r.day), r.outcome) for r in R.daily_results(h).collect()}
    assert got == {("e", "hn", "2026-01-01", "parse"), ("e", "vault", "2026-01-04", "ok"), ("e", "hn", "2026-01-07", "ok"), (None, "hn", "2026-01-07", "ok")}


def test_trailing_equals_brute_force_over_shards(spark):
    import random

    rng = random.Random(5)
    start = dt.date(2025, 12, 20)
    outcomes = [(s, start + dt.timedelta(d), rng.random() < 0.7) for s in ("a", "b") for d in range(300) if rng.random() < 0.4 and not 60 < d < 210]
    rows = spark.createDataFrame([("e", s, d, ok) for s, d, ok in outcomes], "edition string, subject string, day date, ok boolean")
    got = R.trailing(R.trees(rows.repartition(5))).collect()
    want = brute(outcomes)
    assert len(got) * 2 == len(want)
    for r in got:
        assert (r.ok_7, r.bad_7) == want[r.subject, r.day, 7] and (r.ok_30, r.bad_30) == want[r.subject, r.day, 30]


def test_correction_equals_rebuild(spark):
    base = [("e", "a", dt.date(2026, 1, d), True) for d in (1, 5, 9)]
    schema = "edition string, subject string, day date, ok boolean"
    fix = spark.createDataFrame([("e", "a", dt.date(2026, 1, 5), -1, 1), ("e", "a", dt.date(2026, 5, 1), 1, 0), ("e", "new", dt.date(2026, 1, 2), 0, 1)], "edition string, subject string, day date, ok_change int, bad_change int")
    after = [("e", "a", dt.date(2026, 1, 1), True), ("e", "a", dt.date(2026, 1, 5), False), ("e", "a", dt.date(2026, 1, 9), True), ("e", "a", dt.date(2026, 5, 1), True), ("e", "new", dt.date(2026, 1, 2), False)]
    got = R.corrected(R.trees(spark.createDataFrame(base, schema)), fix)
    want = R.trees(spark.createDataFrame(after, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_silent_days_and_averages(spark):
    rows = spark.createDataFrame([("e", "a", dt.date(2026, 1, 1), True), ("e", "a", dt.date(2026, 1, 4), False)], "edition string, subject string, day date, ok boolean")
    t = R.trailing(R.trees(rows))
    assert sorted(r.on_day for r in R.silent_days(R.trees(rows)).collect()) == ["2026-01-02", "2026-01-03"]
    far = rows.unionByName(spark.createDataFrame([("e", "a", dt.date(2026, 9, 1), True)], rows.schema))
    assert R.silent_days(R.trees(far)).count() == (dt.date(2026, 9, 1) - dt.date(2026, 1, 1)).days + 1 - 3
    last = R.with_averages(t).where("day = date '2026-01-04'").first()
    assert (last.ok_avg_7, last.bad_avg_30) == (round(1 / 7, 6), round(1 / 30, 6))


def test_empty(spark):
    assert R.trailing(R.trees(R.daily_outcomes(history(spark, [])))).count() == 0


def test_stored_trees_are_corrected_where_they_change(spark, tmp_path):
    import os

    path = f"{tmp_path}/trees"
    schema = "edition string, subject string, day date, ok boolean"
    before = spark.createDataFrame([("e", "a", dt.date(2026, 1, 1), True), ("e", "a", dt.date(2026, 6, 1), True), (None, "b", dt.date(2026, 6, 2), True)], schema)
    after = spark.createDataFrame([("e", "a", dt.date(2026, 1, 1), True), ("e", "a", dt.date(2026, 6, 1), False), ("e", "a", dt.date(2026, 6, 3), True)], schema)
    R.write_trees(R.trees(before), path)
    names = {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("shard=")}
    R.apply_corrections(spark, path, R.changes(before, after))
    now = {d: set(os.listdir(f"{path}/{d}")) for d in names}
    assert sum(names[d] == now[d] for d in names) == 1 and len(names) == 2
    kept = R.trailing(spark.read.parquet(path).select("edition", "subject", "shard", "ok", "bad"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, R.trailing(R.trees(after)).collect()))
    assert R.changes(before, before).count() == 0
