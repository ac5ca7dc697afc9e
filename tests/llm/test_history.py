import pytest

pytest.importorskip("feedloom.llm")
from feedloom.llm import history as H  # noqa: E402

NONE = H.Lexicon({})
WORDS = H.Lexicon({w: 0.01 for w in "announces replaces modular exporters routers remote desktops weekly releases users means people shared calendars notes".split()} | {"the": 0.3, "of": 0.3, "from": 0.2})


@pytest.mark.parametrize("a,b,same", [
    ("https://www.h.test/a/?utm_source=x&id=1#top", "http://H.TEST:80/a?id=1", True), ("https://h.test/caf%C3%A9", "https://h.test/café/", True), ("https://h.test/?b=1&a=2", "https://h.test/index.php?a=2&b=1&fbclid=z", True),
    ("https://h.test/a?id=1", "https://h.test/a?id=2", False), ("https://h.test/a", "https://g.test/a", False), ("https://h.test/a?lang=en", "https://h.test/a", False), ("https://h.test/A", "https://h.test/a", False)])
def test_addresses(a, b, same):
    assert (H.url_key(a) == H.url_key(b)) is same


def test_no_addresses():
    assert H.url_key(None) is H.url_key(" ") is H.url_key("nope") is H.url_key("http://[bad") is None


def same(a, b, labels=H.label_forms(["Lumo Weekly"])):
    return H.same_headline(H.Headline(a, WORDS, labels).pack(), H.Headline(b, WORDS, labels).pack())


BASE = "Quovik 2.5 replaces modular exporters from Tandor ahead of weekly releases"


@pytest.mark.parametrize("other,want", [
    ("Quovik 2.5 repalces modular exporters from Tandor ahead of weekly releases", True), ("Ahead of weekly releases, Quovik 2.5 replaces modular exporters with Tandor", True),
    (BASE + " | Lumo Weekly", True), (BASE + " / LumoWeekly - Lumo Weelky", True), (BASE + " :: Lumo...", True), ("［話題］" + BASE, True), ("Ahead Of Weekly Releases, Quovik 2.5 Introduces Modular Exporters Aimed At Tandor", True), ("[Update] " + BASE + "!", True), ("Quovik 2.5 Replaces Modular Exporters From Tandor…", True), ("Quоvik ２.５ replaces modular exporters from Tandor ahead weekly releases", True),
    ("Quovik 2.6 replaces modular exporters from Tandor ahead of weekly releases", False), ("Quovak 2.5 replaces modular exporters from Tandor ahead of weekly releases", False),
    ("Quovik 2.5 replaces modular exporters from Gildor ahead of weekly releases", False), ("What Quovik 2.5 means for people on Tandor", False), ("Notes on Quovik 2.5 by a Tandor user", False)])
def test_headlines(other, want):
    assert same(BASE, other) is want and same(other, BASE) is want


def test_repeats(spark):
    schema = "article_id long, batch_no int, url string, title string, source string, text string"
    rows = [
        (1, 0, "https://h.test/1", BASE, "s", "x"), (2, 0, "https://h.test/2", "Zanvor 1.0 means people on remote desktops", "s", "x"), (3, 1, "http://www.h.test/1?utm_medium=a", "Another Gildor story", "s", "x"),
        (4, 1, None, BASE.upper(), "s", "x"), (5, 2, "https://h.test/5", "Another Gildor story", "s", "x"), (6, 2, "", "", "s", "x"), (7, 2, None, None, None, "x"), (8, 2, "https://h.test/8", "Quovik 2.6" + BASE[10:], "s", "x"),
        (9, 3, "https://h.test/8/", None, "s", "x"), (9, 3, "https://h.test/8/", None, "s", "x"), (None, 3, "https://h.test/8/", None, "s", "x"), (10, 0, "https://h.test/2", None, "s", "x")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, H.repeats(df, ["Lumo Weekly"]).collect()))
    assert got == [(1, 3), (1, 4), (1, 5), (8, 9)]
    assert sorted(map(tuple, H.repeats(df.repartition(6), ["Lumo Weekly"]).collect())) == got
    assert H.repeats(df.limit(0), []).count() == 0


def test_story_of_many_wordings_and_copies(spark):
    words = "modular exporters routers desktops weekly releases shared calendars".split()
    rows = [(0, 0, None, "Quovik and Tandor: " + " ".join(words), "s")]
    for i in range(1, 200):
        extra = [w for j, w in enumerate(words) if (i >> j) & 1 == 0 or j < 5]
        rows.append((i, 1 + i % 3, None, "Quovik and Tandor: " + " ".join(extra[i % 3:] + extra[:i % 3]) + ("!" if i % 2 else ""), "s"))
    df = spark.createDataFrame(rows, "article_id long, batch_no int, url string, title string, source string")
    got = H.repeats(df, []).collect()
    assert {r.kept_id for r in got} == {0} and len(got) == 199


def test_hot_name_loses_no_link(spark):
    """A block of far more stories than any window: the variant adds a name, so only the first name's block is left in common."""
    stories = [f"Quovik {'abcdefghij'[i % 10]}word{i}x fixes {'klmnopqrst'[i // 10 % 10]}part{i}y beside zone{i}q" for i in range(400)]
    rows = [(i, 0, None, t.replace("fixes", f"{i + 1000} fixes"), "s") for i, t in enumerate(stories)]
    rows += [(1000 + i, 1, None, f"{t.replace('fixes', f'{i + 1000} fixes')}".replace("Quovik", "Quovik with Tandor"), "s") for i, t in enumerate(stories)]
    df = spark.createDataFrame(rows, "article_id long, batch_no int, url string, title string, source string")
    assert sorted(map(tuple, H.repeats(df, []).collect())) == [(i, 1000 + i) for i in range(400)]


def test_nameless_headlines_meet_by_their_rarest_words(spark):
    """The extremes of the sorted words differ: a word added in front, another one behind."""
    base = "the modular exporters hide broken certificates during remote upgrades"
    rows = [(1, 0, None, base, "s"), (2, 1, None, "again " + base + " yesterday", "s"), (3, 1, None, "weekly releases of shared calendars", "s"),
            (4, 0, None, "新版索引移除舊快取設定功能說明", "s"), (5, 1, None, "一新版索引移除舊快取設定功能說明龠", "s")]
    df = spark.createDataFrame(rows, "article_id long, batch_no int, url string, title string, source string")
    assert sorted(map(tuple, H.repeats(df, []).collect())) == [(1, 2), (4, 5)]


def test_every_label_and_long_words_are_kept(spark):
    word = "verylongcommonword" * 3
    rows = [(i, 0, None, f"{word} {a}", "s") for i, a in enumerate("alpha beta gamma delta omega sigma kappa theta zeta".split())]
    df = spark.createDataFrame(rows, "article_id long, batch_no int, url string, title string, source string")
    assert word in H.lexicon_of(df, frozenset()).words


def test_labels_have_no_bound(tmp_path, spark):
    from feedloom.llm import queries as Q

    spark.range(10_050).selectExpr("concat('Label ', id) as source").write.parquet(str(tmp_path / "sources.parquet"))
    told = []
    old, H.repeats = H.repeats, lambda rows, labels: told.append(len(labels))
    try:
        spark.createDataFrame([], "article_id long").write.parquet(str(tmp_path / "articles.parquet"))
        Q.p1_found(spark, str(tmp_path))
    finally:
        H.repeats = old
    assert told == [10_050]


def _table(spark, rows):
    return spark.createDataFrame(rows, "article_id long, batch_no int, url string, title string, source string")


def _titles(n, first=0):
    return [(first + i, None, None, f"Quovik {i % 9} hides modular exporters number{i}x from part{i % 13}y", "s") for i in range(n)]


def test_history_is_kept_and_opened_again(spark, tmp_path):
    work = H.Workspace(spark, at=f"file://{tmp_path}/kept")
    rows = _titles(40)
    one = H.History(work, frozenset())
    one.ingest(_table(spark, rows))
    words = dict(one.lexicon.words)
    again = H.History(work, frozenset())
    assert again.lexicon.words == words and again.state == one.state
    links = again.ingest(_table(spark, [(100, None, None, rows[7][3] + "!", "s"), (101, None, None, "Nothing like Tandor before", "s")]))
    assert [tuple(r) for r in links.distinct().collect()] == [(100, 7)]
    assert dict(map(tuple, again.stories().collect())) == {100: 7, 7: 7}
    later = H.History(work, frozenset())
    later.ingest(_table(spark, [(102, None, None, rows[7][3], "s")]))
    assert dict(map(tuple, later.stories().collect())) == {100: 7, 7: 7, 102: 7}


def test_only_files_with_blocks_of_the_batch_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "RUN_ROWS", 10)
    h = H.History(H.Workspace(spark, at=f"file://{tmp_path}/kept"), frozenset())
    h.ingest(_table(spark, [(i, None, f"https://h.test/{i}", None, "s") for i in range(200)]))
    files = h.state["runs"][0]["files"]
    assert len(files) >= 20
    batch = h._keyed(_table(spark, [(900, None, "https://h.test/5", None, "s")]))
    touched = h._touched(batch.select("block"))
    assert len(touched) == 1
    assert [tuple(r) for r in h.ingest(_table(spark, [(900, None, "https://h.test/5", None, "s")])).collect()] == [(900, 5)]


def test_lexicon_is_that_of_accepted_titles_and_grows_with_them(spark, tmp_path):
    h = H.History(H.Workspace(spark, at=f"file://{tmp_path}/kept"), frozenset())
    h.ingest(_table(spark, _titles(30)))
    before = dict(h.lexicon.words)
    batch = [(500 + i, None, None, f"again thing{chr(97 + i) * 3} calls alpha{chr(97 + i % 12) * 2}", "s") for i in range(20)]
    h.ingest(_table(spark, batch))
    assert h.lexicon.words == before and h.state["version"] == 1
    h.ingest(_table(spark, [(600 + i, *r[1:3], r[3] + chr(97 + i), "s") for i, r in enumerate(batch)]))
    assert h.state["version"] == 2 and len(h.state["runs"]) == 1 and "again" in h.lexicon.words


def test_split_blocks_lose_no_link(spark, monkeypatch):
    rows = [(i, 0, None, f"Quovik {i % 7} hides number{i}x from part{i % 13}y with shared{i % 5}z calendars", "s") for i in range(300)]
    rows += [(1000 + i, 1 + i % 2, None, f"Quovik {i % 7} hides number{i}x from part{i % 13}y with shared{i % 5}z calendars {'again' if i % 3 else ''}", "s") for i in range(300)]
    whole = sorted(map(tuple, H.repeats(_table(spark, rows), []).collect()))
    monkeypatch.setattr(H, "SPLIT", 40)
    assert sorted(map(tuple, H.repeats(_table(spark, rows), []).collect())) == whole and len(whole) >= 300


def test_blocks_against_brute_force(spark):
    """All pairs of the small table's headlines; the blocks must find at least 0.9 of the pairs that are the same."""
    import glob

    at = "/root/testdata/sf0.001/articles.parquet"
    if not glob.glob(at):
        pytest.skip("no test data")
    rows = spark.read.parquet(at).where("title <> ''").select("article_id", "title", "source").collect()
    table = spark.read.parquet(at)
    lexicon = H.lexicon_of(table.where("batch_no = 0"), frozenset())
    lines = [(r.article_id, H.Headline(r.title, lexicon, frozenset(), H.label(r.source))) for r in rows]
    packed = [(i, h.pack(), {b for _, b, _ in h.keys(lexicon)}) for i, h in lines]
    same = [(bool(x[2] & y[2])) for k, x in enumerate(packed) for y in packed[:k] if H.same_headline(x[1], y[1])]
    assert len(same) >= 10 and sum(same) >= 0.9 * len(same)
