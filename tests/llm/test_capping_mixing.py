import os
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("feedloom.llm")
from feedloom.llm import bpe, capping, mixing  # noqa: E402


def brute_limit(counts, share):
    return max((c for c in range(0, max(counts, default=0) + 1) if c <= share * sum(min(n, c) for n in counts) + 1e-9), default=0)


@pytest.mark.parametrize("seed", range(8))
def test_share_limit(spark, seed):
    rng = random.Random(seed)
    counts = [rng.choice([1, 2, 5, 40, 300]) for _ in range(rng.randint(1, 30))]
    share = rng.choice([0.05, 0.1, 0.3, 0.5, 1.0])
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "contributor string, n long")
    assert capping.share_limit(df, share) == brute_limit(counts, share)


def test_capped(spark):
    rows = [(i, "Big" if i % 3 else (" big " if i % 2 else None), i % 4 if i % 7 else None, "c") for i in range(300)] + [(1000 + i, f"s{i}", 1, "c") for i in range(40)]
    df = spark.createDataFrame(rows, "article_id long, source string, score long, place string").drop("place")
    got = capping.capped(df, capping.contributor(F.col("source")), "article_id", F.col("score"), max_share=0.3).collect()
    n = {}
    for r in got:
        n[r.contributor] = n.get(r.contributor, 0) + 1
    assert max(n.values()) <= 0.3 * len(got) and all(n[f"s{i}"] == 1 for i in range(40))
    best = sorted((r for r in rows[:300] if r[1] and r[1].strip().lower() == "big"), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert {r.article_id for r in got if r.contributor == "big"} == {r[0] for r in best[:n["big"]]}
    assert capping.capped(df, capping.contributor(F.col("source")), "article_id", F.col("score"), max_count=2).groupBy("contributor").count().agg(F.max("count")).first()[0] == 2
    assert capping.capped(df.limit(0), capping.contributor(F.col("source")), "article_id", F.col("score"), max_share=0.3).count() == 0


def test_host(spark):
    df = spark.createDataFrame([("https://www.A.test:443/x",), ("http://u@a.test",), ("nope",), (None,)], "u string")
    assert [r.h for r in df.select(capping.host(F.col("u")).alias("h")).collect()] == ["a.test", "a.test", "", ""]


@pytest.mark.skipif(not os.path.exists(bpe.BYTE_BPE_50K), reason="no vocabulary file")
def test_mixing(spark):
    rng = random.Random(1)
    docs = [(i, " word" * rng.randint(1, 60), "abc"[i % 3] if i % 10 else "tiny", "x") for i in range(400)] + [(900, None, "a", "x"), (901, "", "a", "x"), (902, "w", None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rest string")
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "tiny", 0.4, 3), ("m", "none", 0.1, 1), ("n", "b", None, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mixing.select(df, targets)
    got = {r.source: r for r in report.where("mix_name = 'm'").collect()}
    assert abs(got["a"].actual_share - 0.5 / 0.9) < 0.02 and abs(got["tiny"].actual_share - 0.4 / 0.9) < 0.02 and got["none"].actual_share == 0
    assert got["tiny"].most_copies == 3 and got["a"].most_copies <= 2
    again = mixing.select(df.repartition(3), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))
    chosen, report = mixing.select(df, targets, total=100)
    assert abs(sum(r.tokens for r in report.collect()) - 100) < 10
    assert mixing.select(df.limit(0), targets)[0].count() == 0 and mixing.select(df, targets.limit(0))[0].count() == 0


def brute_inclusion(sizes, rest):
    """Certain documents one at a time, the largest first, while the largest's probability would reach one."""
    left, open_ = rest, sorted((s for s in sizes if s <= rest), reverse=True)
    certain = []
    while open_ and left > 0 and left * open_[0] >= sum(s * s for s in open_):
        certain.append(open_[0])
        left -= open_.pop(0)
    return certain, max(left, 0) / sum(s * s for s in open_) if open_ else 0.0


@pytest.mark.parametrize("seed", range(6))
def test_inclusion_probabilities(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 7, 40, 41, 300]) for _ in range(rng.randint(1, 40))]
    rest = rng.choice([2.5, 30.0, 0.5 * sum(sizes), float(sum(sizes))])
    docs = spark.createDataFrame([("s", n) for n in sizes], "source string, n_tokens long")
    used = spark.createDataFrame([("m", "s", rest)], "mix_name string, source string, rest double")
    got = mixing.inclusion(docs, used).first()
    certain, factor = brute_inclusion(sizes, rest)
    framed = [n for n in sizes if n <= rest]
    inside = [n for n in framed if n >= got.certain_from] if framed else []
    open_ = [n for n in framed if n < got.certain_from]
    assert sum(inside) + sum(got.factor * n * n for n in open_) == pytest.approx(min(rest, sum(framed)) if sum(certain) <= rest else sum(inside), rel=1e-6)
    assert all(got.factor * n < 1 + 1e-9 for n in open_) and sum(inside) <= rest + max(framed, default=0)


def test_sampling_follows_sizes(spark):
    """Over many seeds a document twice as long is taken twice as often, and every sample has the size asked for."""
    sizes = [10] * 60 + [20] * 60
    docs = spark.createDataFrame([(i, "s", n) for i, n in enumerate(sizes)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(f"m{k}", "s", 1.0, 1) for k in range(120)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mixing.select(None, targets, total=300, counts=docs)
    assert all(abs(r.tokens - 300) <= 10 for r in report.collect())
    n = {r.n_tokens: r["count"] for r in chosen.groupBy("n_tokens").count().collect()}
    assert 1.7 < n[20] / n[10] < 2.3
