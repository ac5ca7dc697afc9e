import numpy as np
import pytest

pytest.importorskip("feedloom.llm")
from feedloom.llm import truncation as T  # noqa: E402


@pytest.mark.parametrize("text,verdict", [
    ("All is well.", "whole"), ("「よし。」", "whole"), ("It ends &am", "cut"), ("It ends <a hre", "cut"), ("It ends &lt;cod", "cut"), ("half �", "cut"), ("Tom & Jerry", "open"), ("R&D", "open"), ("<p>Fine.</p>", "whole"), ("<p>Fine.", "whole"),
    ("Tags: a, b, c", "list"), ("#one #two", "list"), ("see https://h.test/x", "link"), ("It begins (Quo", "cut"), ("done (Quovik 2.1)", "whole"), ("rocket 🚀", "whole"), ("and so on …", "marked"), ("First. Then[…]", "marked"), ("a, b,", "broken"), ("It was the", "open"), ("。", "whole")])
def test_verdicts(text, verdict):
    assert T.look(text)[0] == verdict


def test_censored_fit_finds_the_limit_and_the_distribution():
    rng = np.random.default_rng(3)
    drawn = np.exp(rng.normal(5.0, 0.5, 20_000)).astype(int).clip(5)
    kept = np.minimum(drawn, 200)
    sizes, counts = np.unique(kept, return_counts=True)
    f = T.censoring(sizes, counts)
    mu, sigma, post = f.mu, f.sigma, f.posterior
    assert list(post) == [200] and post[200] > 0.95 and abs(mu - 5.0) < 0.05 and abs(sigma - 0.5) < 0.05
    sizes, counts = np.unique(drawn[drawn < 400], return_counts=True)
    assert not any(p > 0.5 for p in T.censoring(sizes, counts).posterior.values())
    assert T.censoring(np.array([7]), np.array([3])).posterior == {}


def test_found(spark):
    import random

    rng = random.Random(2)
    nouns, verbs = ["router", "parser", "login form", "test machine", "retry loop"], ["fixes", "slows", "rewrites", "hides"]
    sentence = lambda: f"The new {rng.choice(nouns)} {rng.choice(verbs)} the old {rng.choice(nouns)} during the summer."
    rows, cut = [], set()
    for i in range(600):
        text = " ".join(sentence() for _ in range(rng.randint(1, 6)))
        if len(text) > 200:
            text = text[:200]
            if not text.endswith("."):
                cut.add(i)
        rows.append((i, "S ", "rss", text, None, "t", "x"))
    rows += [(1000, "s", "rss", None, "", None, "x"), (1001, None, None, "Fine.", "Fine.", None, "x"), (1002, "s", "rss", "x" * 50_000 + ".", None, None, "x")]
    df = spark.createDataFrame(rows, "article_id long, source string, source_key string, original_description string, comment_summary string, title string, verdict string")
    judged = T.judge(df)
    got = {r.article_id for r in T.found(judged).collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.03 * len(cut)
    rate = {(r.source, r.field_name): (r.n, r.n_cut) for r in T.rates(judged).collect()}
    assert rate["s", "original_description"] == (601, len(got)) and rate["", "comment_summary"] == (1, 0)
    assert T.found(T.judge(df.limit(0))).count() == 0


def test_fragments_that_return_are_no_trailing_phrases(spark):
    """'The new' with a mark at two lengths is a cut, since it mostly stands inside sentences; a phrase never seen there isn't."""
    body = "The new router fixes the old parser."
    rows = [(i, "s", "rss", " ".join([body] * (1 + i % 7)), None) for i in range(70)]
    rows += [(100 + i, "s", "rss", " ".join([body] * (1 + i)) + " The new…", None) for i in range(3)]
    rows += [(200 + i, "s", "rss", " ".join([body] * (1 + i)) + " Wait and see…", None) for i in range(3)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "article_id long, source string, source_key string, original_description string, comment_summary string, title string")
    got = {r.article_id for r in T.found(T.judge(df)).collect()}
    assert {100, 101, 102} <= got and not got & {200, 201, 202}


def test_small_sources_have_their_own_limits_and_else_those_of_their_step():
    rng = np.random.default_rng(4)
    drawn = np.exp(rng.normal(5.0, 0.5, 20_000)).astype(int).clip(5)
    step = T.censoring(*np.unique(np.minimum(drawn, 300), return_counts=True))
    own = np.minimum(np.exp(rng.normal(5.0, 0.5, 40)).astype(int), 160)
    f = T.censoring(*np.unique(own, return_counts=True), step)
    assert f.posterior[160] > 0.5 and abs(f.mu - 5.0) < 0.2
    few = T.censoring(np.array([90, 300]), np.array([1, 1]), step)
    assert list(few.posterior) == [300] and few.posterior[300] > 0.9
    copies = T.censoring(np.array([90, 141]), np.array([1, 1]), step)
    assert copies.posterior.get(141, 0.0) == 0.0


def test_last_words_of_any_length():
    word = "x" * 700
    assert T.ending_key(f"The old {word}") == (f"bold {word}", f"w{word}")
    assert T.ending_key(f"The old {word} {word}")[0] == f"b{word} {word}"
