import numpy as np
import pytest

pytest.importorskip("feedloom.llm")
from feedloom.llm import quantiles as Q  # noqa: E402


@pytest.mark.parametrize("values", [np.arange(200_000), np.repeat([1, 5, 9], 50_000), (np.random.default_rng(1).pareto(1.1, 150_000) * 1000).astype(np.int64), np.array([7]), np.array([-5, 0, 1 << 40])])
def test_error_bound_after_any_merge(values):
    rng = np.random.default_rng(2)
    values = rng.permutation(values)
    whole = Q.Sketch()
    for part in np.array_split(values, 17):
        s = Q.Sketch().add(part)
        if s.n:
            whole.merge(*s.row())
    whole.settle()
    for ladder in (whole.upper, whole.lower or whole.upper):
        assert whole.n == len(values) == sum(len(v) << h for h, v in enumerate(ladder.levels))
    ordered = np.sort(values)
    for q in (0.0001, 0.001, 0.01, 0.1, 0.4, 0.5, 0.9, 0.99, 0.999, 1):
        got = whole.quantiles([q])[0]
        low, high = np.searchsorted(ordered, got, "left"), np.searchsorted(ordered, got, "right")
        slack = Q.error_bound() * (q if q < 0.5 else 1 - q) * len(values) + 1
        assert low - slack <= q * len(values) <= high + slack
    assert sum(map(len, whole.upper.levels)) < 8000


def test_small_groups_are_exact():
    s = Q.Sketch().add(np.arange(1, 101))
    assert s.quantiles([0.5, 0.9, 1.0]) == [50, 90, 100] and Q.Sketch().quantiles([0.5]) == [None]


def test_mirror_comes_with_the_first_compaction():
    s = Q.Sketch().add(np.arange(300))
    assert s.row()[5:] == ([], []) and len(s.row()[4][0]) == 300
    t = Q.Sketch().merge(*s.row()).merge(*Q.Sketch().add(np.arange(300, 900)).row())
    assert t.row()[5] and t.n == 900 and t.quantiles([0.001])[0] == 0


def test_errors_are_those_of_a_fair_coin():
    """Over many shuffled halves the mean error of a rank is near nought and its spread within the bound's quarter."""
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        values = rng.permutation(20_000)
        s = Q.Sketch()
        for part in np.array_split(values, 40):
            s.add(part)
        errors.append((s.quantiles([0.5])[0] + 1 - 10_000) / 10_000)
    assert abs(np.mean(errors)) < 4 * np.std(errors) / len(errors) ** 0.5 + 1e-4 and np.std(errors) < Q.error_bound() / 4 * 1.5


def test_frames(spark):
    rows = [(i, f"2026-01-0{1 + i % 3}", " Enrich" if i % 2 else None, "M@main" if i % 5 else "", i if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows + rows[:50], "event_id long, run_date string, step string, model string, total_tokens long").repartition(5)
    calls = Q.usage_calls(df)
    assert calls.count() == 500 and {r.step for r in calls.collect()} == {"enrich", "other"} and {r.model for r in calls.collect()} == {"m", ""}
    by = ["step", "model"]
    p = Q.percentiles(Q.sketches(calls, by, "total_tokens"), by, [0.5, 0.99])
    assert Q.rank_check(calls, p, by, "total_tokens").where("not within").count() == 0 and p.count() == 8
    days = Q.sketches(Q.usage_calls(df, "run_date"), ["run_date", *by], "total_tokens")
    joined = Q.percentiles(Q.merged(days, by), by, [0.5, 0.99])
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, p.collect()))
    assert Q.sketches(calls.limit(0), by, "total_tokens").count() == 0
    assert Q.sketches(calls, [], "total_tokens").first().n == calls.where("total_tokens is not null").count()
