import pytest

pytest.importorskip("feedloom.llm")
from feedloom.llm import textform as X  # noqa: E402


@pytest.mark.parametrize("a,b,same", [
    ("ＡＢＣ １２", "ABC 12", True), ("café", "café", True), ("a​b", "ab", True), ("a b", "a b", True), ("pаypal", "paypal", True),
    ("co‑op", "co-op", True), ("ﾌﾟﾛ", "プロ", True), ("ⅰⅼ", "il", True), ("⼤きい", "大きい", True), ("a­b", "ab", True), ("ﬁn", "fin", True),
    ("cafe", "café", False), ("ABC", "abc", False), ("x1", "x2", False), ("x²", "x2", False), ("①", "1", False), ("ab", "ab!", False), ("タ", "チ", False)])
def test_what_a_reader_sees(a, b, same):
    assert (X.seen_form(a) == X.seen_form(b)) is same


def test_form_folds_and_is_stable():
    for t in ("Straße", "ΑΒΓ", "İstanbul", "ﬁＮ", "Ⅳ", "é‍", "  x　y ", "", "K"):
        once = X.one_form(t)
        assert X.one_form(once) == once
    assert X.one_form("STRASSE") == X.one_form("straße")


def test_columns(spark):
    rows = [(1, "ＡＢ", "AB", "t"), (2, "AB", "AB", "t"), (3, None, "AB", "t"), (4, "", "", "t"), (5, "ab", "AB", "t"), (6, "​", "‌", "t"), (1, "ＡＢ", "AB", "t")]
    df = spark.createDataFrame(rows, "article_id long, title string, original_title string, title_form string")
    assert [r.article_id for r in X.look_alikes(df).collect()] == [1, 1]
    got = {r.article_id: (r.title_form, r.original_title_form) for r in X.forms(df).collect()}
    assert got[1] == ("ab", "ab") and got[3] == (None, "ab") and got[4] == ("", "") and got[6] == ("", "")
    for r in X.forms(df).collect():
        pass
    assert X.look_alikes(df.limit(0)).count() == 0


def test_column_equals_function(spark):
    texts = ["Ａ b", "x  y\t", "É", "", "ÅÅ", "plain Text\u001f", "ロ口"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(X.consistent_form(df.t).alias("f")).collect()] == [X.one_form(t) for t in texts]
