import base64
import os

import pytest

pytest.importorskip("feedloom.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from feedloom.llm import bpe  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.BYTE_BPE_50K), reason="no vocabulary file")
TEXTS = ["", "a" * 3000, " " * 200 + "x", "\r\n\t  a  b\n\n", "<|endoftext|>", "it's we'll 'S", "日本語のテキスト、中文", "🚀🚀 ​", "  ", "été 1234567", "x\u0000y", "﻿"]


def brute(text, ranks, find):
    out = []
    for w in find(text):
        seq = [bytes([b]) for b in w.encode()]
        while len(seq) > 1:
            r, k = min((ranks.get(seq[k] + seq[k + 1], 1 << 60), k) for k in range(len(seq) - 1))
            if r == 1 << 60:
                break
            seq[k:k + 2] = [seq[k] + seq[k + 1]]
        out += [ranks[s] for s in seq]
    return out


@pytest.fixture(scope="module")
def parts():
    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.BYTE_BPE_50K, "rb"))}
    return ranks, regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall


def test_equals_merging(parts):
    got = list(bpe.trie(bpe.BYTE_BPE_50K).encode_texts(TEXTS))
    assert got == [brute(t, *parts) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_equals_merging_on_any_text(parts, text):
    text = text.encode("utf-8", "ignore").decode()
    assert next(iter(bpe.trie(bpe.BYTE_BPE_50K).encode_texts([text]))) == brute(text, *parts)


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (1, "a b", 9), (4, "x" * 100_000, 9)], "doc_id long, text string, ids int")
    rows = bpe.encode(df).collect()
    got = {r.doc_id: r.ids for r in rows}
    assert len(rows) == 5 and got[2] == got[3] == [] and len(got[1]) == 2 and bpe.encode(df.limit(0)).count() == 0
    token = {i: t for t, i in bpe.trie(bpe.BYTE_BPE_50K).rank.items()}
    assert b"".join(token[i] for i in got[4]).decode() == "x" * 100_000
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df, ["doc_id"]).collect()} == {k: len(v) for k, v in got.items()}
