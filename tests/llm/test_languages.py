import numpy as np
import pytest

pytest.importorskip("feedloom.llm")
from feedloom.llm import languages as L  # noqa: E402

SAMPLES = {
    "en": ["The engineer removes a broken certificate without telling the users.", "This version no longer supports most of the old queries.", "We explain the open tickets about the slow start."],
    "de": ["Die Entwicklerin ersetzt den alten Zwischenspeicher ohne Warnung.", "Das Team beschreibt eine fehlerhafte Kette auf älteren Rechnern.", "Wir erklären die offenen Fragen nicht mehr."],
    "ja": ["開発チームは利用者に知らせることなく索引を置き換えた。", "新しい版は古いキャッシュを遅くしてしまう。"], "zh": ["開發團隊沒有事先通知使用者就移除了舊的快取。", "維護者在比較舊的筆電上取代了索引建置。"]}


@pytest.fixture(scope="module")
def field():
    return L.fit([(k, t) for k, v in SAMPLES.items() for t in v for _ in range(4)])


def test_forward_backward_equals_enumeration():
    import itertools

    f = L.Field(["a", "b", "c"])
    rng = np.random.default_rng(1)
    emit, f.t = rng.normal(size=(1, 4, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    a, b, e, step = f._forward_backward(emit, np.ones((1, 4), bool))
    m, pairs = f._marginals(a, b), f._pairs(a, b, e, step, np.ones((1, 4), bool))
    weight = {y: np.exp(sum(emit[0, i, y[i]] for i in range(4)) + sum(f.t[y[i], y[i + 1]] for i in range(3))) for y in itertools.product(range(3), repeat=4)}
    total = sum(weight.values())
    for i in range(4):
        for k in range(3):
            assert abs(m[0, i, k] - sum(w for y, w in weight.items() if y[i] == k) / total) < 1e-4
    want = np.zeros((3, 3))
    for y, w in weight.items():
        for i in range(3):
            want[y[i], y[i + 1]] += w / total
    assert np.abs(pairs - want).max() < 1e-3


def test_lines_leave_out_what_is_no_language():
    text = "# Heading here now\n```\ncode here\n```\n> WARN 10:00 A.b() -> x=1\n- Name: “ein Stück davon”\nfn a(x: u8) -> u8 { x }\nA real sentence stands here.\n"
    assert list(L.lines_of(text)) == ["Name:", "A real sentence stands here."]
    assert L.segments(L.Field(["en"]), [text])[0][0][2] == 5


def test_detect(spark, field):
    en, de, ja, zh = (v[0] for v in SAMPLES.values())
    rows = [(1, en, "en", 0), (2, de, "en", 0), (3, en + " " + de, "en", 0), (4, ja, None, 0), (5, zh, "zh-TW", 0), (6, None, None, 0), (7, "", "xx", 0), (8, "$ tool --x=1 | tee log", "de", 0), (9, de, " deu ", 0), (10, (en + " ") * 2000, "EN", 0), (11, zh + "\n" + ja, "ja", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int")
    found = L.detect(df, None, field)
    got = sorted((r.doc_id, r.lang) for r in L.wrong_or_missing(found).collect())
    assert got == [(2, "de"), (3, "de"), (3, "en"), (4, "ja"), (11, "ja"), (11, "zh")]
    assert found.count() == 11 and {r.doc_id: len(r.found) for r in found.collect()}[3] == 2
    assert all(0 <= r.confidence <= 1 for r in L.document_languages(found).collect())
    assert L.detect(df.limit(0), None, field).count() == 0


def test_held_out_accuracy(spark, field):
    held = [("en", "The team explains the old certificate without the users."), ("de", "Die offenen Rechner sind nicht mehr ohne Warnung."), ("ja", "古い版は利用者を遅くしてしまう。"), ("zh", "使用者沒有事先移除舊的索引。")]
    assert [s[0][0] for s in L.segments(field, [t for _, t in held])] == [k for k, _ in held]


@pytest.mark.parametrize("line,count", [
    ("- Neue Version behebt Fehler beim Start", 1), ("- 메모리 누수를 수정했습니다", 1), ("네트워크를 재시작했습니다.", 1), ("Neue Version behebt Fehler", 0), ("- Quovik Gateway", 0), ("- データベース", 0), ("- 索引を更新した", 1)])
def test_lines_of_lists_and_short_sentences(line, count):
    assert len(L.segments(L.Field(["de"]), [line])[0]) == count


def test_semicolons_and_calls_in_prose():
    prose = ["- correction d'une fuite de memoire dans le serveur ;", "新しい関数connect(host)は、接続を閉じる前に再試行する。"]
    assert len(list(L.lines_of("\n".join(prose)))) == 2
    assert list(L.lines_of("let x = 1;\nint count;\nfoo(bar);\nuse std::io;\nreturn x;")) == []


def test_every_feature_of_a_long_word_counts_and_long_words_stay():
    f = L.Field(["de", "en"], {"de": {"entwicklerinnen"}})
    ids, edged = f.features("Entwicklerinnen"), "<entwicklerinnen>"
    assert len(ids) == 1 + 3 + 4 + len({edged[i:i + n] for n in (2, 3) for i in range(len(edged) - n + 1)}) + 1
    compound = "Rindfleischetikettierungsüberwachungsaufgabenübertragungsgesetz"
    assert compound in list(L.lines_of(f"Das {compound} gilt nicht mehr."))[0]
    assert "a1" not in " ".join(L.lines_of("Der Wert ist " + "a1" * 30 + " heute."))


def test_saved_field_labels_alike(spark, field, tmp_path):
    path = f"file://{tmp_path}/field"
    assert L.load(spark, path) is None
    L.save(field, spark, path)
    back = L.load(spark, path)
    texts = [t for v in SAMPLES.values() for t in v]
    assert back.langs == field.langs and back.lists == field.lists
    assert [[x[0] for x in s] for s in L.segments(back, texts)] == [[x[0] for x in s] for s in L.segments(field, texts)]


def test_field_is_fitted_once_per_files(spark, tmp_path, monkeypatch):
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, v in SAMPLES.items() for t in v)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    first = L.field_for(docs, docs)
    monkeypatch.setattr(L, "fit", lambda *a: 1 / 0)
    assert L.field_for(docs, docs).langs == first.langs
