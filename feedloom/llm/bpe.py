"""Corpus encoding with a public byte-level BPE vocabulary (problem 7).

Distinct words go into a trie; a depth-first walk carries the state of every prefix, its last token. For a prefix p there
is exactly one token t that ends p such that the encoding of p is that of p without t, followed by t: the one that stands
next to the last token of the shorter prefix. An automaton names the tokens that end at a byte, so a few lookups per byte
give every prefix's last token, shared prefixes are computed once, and a word's ids are read off backwards. The work is
linear in the bytes of the trie, also for very long words.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default place of the vocabulary on the driver; pass another path as a parameter.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to the vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Bytes of words kept in a Python worker between batches, and bytes of text handled at once.
KEEP_BYTES, CHUNK_BYTES = 48 << 20, 8 << 20
_NEVER = 1 << 60
_SENT: set[tuple[str, str]] = set()


class Trie:
    """Last-token states of word prefixes, for one vocabulary file (base64 token, rank per line)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(SPLIT).findall
        self.size = {i: len(t) for t, i in self.rank.items()}
        parts = {i: p for t, i in self.rank.items() if len(t) > 1 and (p := self._last_merge(t, i))}
        self.pair = {p: i for i, p in parts.items()}
        self.whole = {t: i for t, i in self.rank.items() if len(t) == 1 or i in parts}
        # Tokens that end at a place, the longest first; bytes are the characters of the same number.
        self.endings = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.endings.add_word(t.decode("latin-1"), i)
        self.endings.make_automaton()
        self.longest = max(map(len, self.whole))
        # Border tokens of a token at each time of its making, with the merge that ends each: right side and left side.
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for i in self.whole.values():
            self.right[i], self.left[i] = self._border(parts, i, 1), self._border(parts, i, 0)
        self.known: dict[tuple[int, int], bool] = {}
        self.kept: dict[bytes, tuple[int, ...]] = {}
        self.kept_bytes = 0

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the vocabulary merges last into this one; None if merging never makes it."""
        seq = [token[k:k + 1] for k in range(len(token))]
        while len(seq) > 2:
            best = min(((r, k) for k in range(len(seq) - 1) if (r := self.rank.get(seq[k] + seq[k + 1], rank)) < rank), default=None)
            if best is None:
                return None
            k = best[1]
            seq[k:k + 2] = [seq[k] + seq[k + 1]]
        return self.rank[seq[0]], self.rank[seq[1]]

    @staticmethod
    def _border(parts: dict, token: int, side: int) -> list[tuple[int, int]]:
        out, ends = [(token, _NEVER)], token
        while token in parts:
            token = parts[token][side]
            out.append((token, ends))
            ends = token
        return out

    def stands(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border between a and b: merges run by rank, the leftmost first on ties."""
        known = self.known.get((a, b))
        if known is None:
            pair = self.pair
            known = not any((r := pair.get((x, y))) is not None and r < x_ends and r <= y_ends for x, x_ends in self.right[a] for y, y_ends in self.left[b])
            if len(self.known) < 2_000_000:
                self.known[a, b] = known
        return known

    def encode_words(self, words: set[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of each word: the sorted words are the trie in depth-first order, states is the path to the current node."""
        size, known, stands, endings = self.size, self.known, self.stands, self.endings.iter
        out: dict[bytes, tuple[int, ...]] = {}
        states: list[int] = [-1]
        before = b""
        for word in sorted(words):
            direct = self.rank.get(word)
            if direct is not None:
                out[word] = (direct,)
                continue
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del states[shared + 1:]
            # Tokens that end behind the shared prefix may begin inside it.
            first, done = max(0, shared - self.longest + 1), shared
            for last, t in endings(word[first:].decode("latin-1")):
                end = first + last + 1
                if end > done:
                    begin = states[end - size[t]]
                    if begin < 0 or (known[begin, t] if (begin, t) in known else stands(begin, t)):
                        states.append(t)
                        done = end
            before = word
            ids, end = [], len(word)
            while end:
                ids.append(states[end])
                end -= size[states[end]]
            out[word] = tuple(reversed(ids))
        return out

    def encode_texts(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text; null and the empty text have none. Distinct words are encoded once per worker as far as they fit."""
        split = [self.words(t) if t else [] for t in texts]
        distinct = {w for words in split for w in words}
        new = {b: w for w in distinct if w not in self.kept for b in (w.encode("utf-8", "replace"),)}
        fresh = {new[b]: ids for b, ids in self.encode_words(set(new)).items()}
        known = {w: fresh[w] if w in fresh else self.kept[w] for w in distinct}
        if self.kept_bytes > KEEP_BYTES:
            self.kept.clear()
            self.kept_bytes = 0
        for w, ids in fresh.items():
            if len(w) <= 64:
                self.kept[w] = ids
                self.kept_bytes += 150 + 3 * len(w) + 32 * len(ids)
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            yield ids


@functools.lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    """The trie of a vocabulary file; on workers that don't have the path, of the copy that came with the job."""
    return Trie(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def _sent(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file of the driver to the workers, once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SENT and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _SENT.add(key)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHUNK_BYTES // 4:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts) or not texts:
        yield start, len(texts)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): the token ids of every text, in order, without special tokens.

    Markers of tokenizers inside a text are ordinary text. A null or an empty text gives an empty list. One row per input
    row, repeated rows included. A narrow map without a shuffle: each worker encodes the distinct words it meets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                ids = pa.array(list(t.encode_texts(texts[a:b])), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=[key, "ids"])

    _sent(documents.sparkSession, vocabulary)
    schema = T.StructType([documents.select(key).schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """The columns of keep and n_tokens of each text; null and empty texts count 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _chunks(texts):
                n = pa.array([len(ids) for ids in t.encode_texts(texts[a:b])], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], n], names=[*keep, "n_tokens"])

    _sent(documents.sparkSession, vocabulary)
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType())])
    return documents.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
