"""Languages of documents and of the segments in them, by a linear-chain conditional random field (problem 9).

The field labels the words of a line. A word's features are the word itself, its affixes, character n-grams and the
languages in whose word lists it stands; transitions between languages are learned. Forward-backward gives each word's
marginals, whose mean over a sentence is its language and confidence. It is fitted on the clean samples, then twice more
with a bounded sample of documents whose label the fit before confirms, so that the corpus's own wording is known. A fitted
field is a small table in the shared folder, which later queries over the same files read instead of fitting anew.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from feedloom.runtime import shared_root, signature

#: Bounds of what the classifier is fitted on (every document is labelled whatever they are): labelled documents, their
#: characters at most, sentences of one language among them, and clean samples.
MOST_DOCUMENTS, MOST_CHARACTERS, MOST_SENTENCES, MOST_SAMPLES = 6000, 4000, 800, 20_000
#: Hashed features, and words of a line handled as one chain (longer lines are several).
SPACE, CHAIN = 1 << 17, 120
#: Words a sentence needs besides names, and the mean marginal it needs to count.
LEAST_WORDS, LEAST_CONFIDENCE = 3, 0.5
#: The same for lines that no sentence sign ends: shorter ones are headings, names and the like.
LEAST_OPEN = 5
# Three-letter codes of the languages at hand.
CODES = {"eng": "en", "jpn": "ja", "zho": "zh", "chi": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "nld": "nl", "dut": "nl", "kor": "ko", "rus": "ru"}

_WORD = re.compile(r"[^\W\d_]+(?:['’·-][^\W\d_]+)*")
_CJK = re.compile(r"[ぁ-ゟ]{1,3}|[ァ-ヿｦ-ﾟ]{1,4}|[㐀-鿿豈-﫿々]{1,2}")
_IS_CJK = re.compile(r"[ぁ-ヿ㐀-鿿豈-﫿々ｦ-ﾟ]")
_END = re.compile(r"(?<=[.!?…])[\"')\]”»]*\s+|(?<=[。！？])")
_CLOSED = re.compile(r"[.!?…。！？；;:：][\W_]*$")
_LINK = re.compile(r"\[([^\]]*)\]\([^)\s]*\)")
_ADDRESS = re.compile(r"(?i)\(?(?:https?://|www\.)\S+\)?|\S+@\S+\.\w+")
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|‹[^›]*›|\"[^\"]*\"|「[^」]*」|『[^』]*』|`[^`]*`")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,40}>|<\|[^|<>]*\|>|\[/?[A-Z]{2,6}\]|&#?\w{1,8};")
_CODE = re.compile(r"[{}=]\s*$|^\s*(?:\$|fn |def |class |import |return\b|SELECT |GROUP BY|for \w+ in |if \w+\.|#include|var |let |const |\{|\}|//|/\*)|\w\(.*\)|->|::|\w\[\d|[<>|&]{2}|errno|0x[0-9a-f]+|--\w+=")
_SIGNS = re.compile(r"[={}\[\]<>|$]|\w\(|\+\+|--")
_INNER = re.compile(r"[a-z][A-Z]|^[A-Z]{2,}$")
_HANGUL = re.compile("[가-힣]")
# Long strings with digits or signs that words don't have: hashes, tokens, paths. A long word is a word.
_STRING = re.compile(r"\S*[\d_=%\\<>{}|$#@~^]\S*")


def label_of(lang: Column) -> Column:
    """The two-letter code a label names, by case, region, three letters or blanks around it; null if it names none."""
    base = F.lower(F.regexp_extract(F.trim(F.regexp_replace(F.coalesce(lang, F.lit("")), r"\s+", " ")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    known = F.create_map(*[F.lit(x) for pair in {**CODES, **{v: v for v in CODES.values()}}.items() for x in pair])
    return F.try_element_at(known, base)


def is_code(line: str) -> bool:
    """Lines with signs of code that aren't prose which mentions them. A closing semicolon alone ends items of lists, too."""
    closed, signs = line.rstrip().endswith(";"), _CODE.search(line)
    if not closed and not signs:
        return False
    words, cjk = len(_WORD.findall(line)), len(_IS_CJK.findall(line))
    if closed and (_SIGNS.search(line) or words < 4 and cjk < 8):
        return True
    prose = re.search(r"[.!?。！？][\W_]*$", line) and (words >= 6 or cjk >= 12 and 2 * cjk > len(re.findall(r"\w", line)))
    return bool(signs) and not prose


def lines_of(text: str) -> Iterator[str]:
    """The lines that can be language: without code, logs, headings, addresses, markup and quoted fragments."""
    return (line for line, _ in items_of(text))


def items_of(text: str) -> Iterator[tuple[str, bool]]:
    """lines_of with whether each is a line of a list."""
    fenced = False
    for line in re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", text):
        if line.lstrip(" >").startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced:
            continue
        bare = re.sub(r"^(?:\s{0,3}>)+\s?", "", line)
        if not bare.strip() or re.match(r"\s{0,3}#{1,6}\s", bare):
            continue
        if "<" in bare or "[" in bare or "&" in bare:
            bare = _LINK.sub(r"\1", _MARKUP.sub(" ", bare))
        if "://" in bare or "@" in bare or "www." in bare.lower():
            bare = _ADDRESS.sub(" ", bare)
        bare = _QUOTED.sub(" ", bare)
        if is_code(bare):
            continue
        bare, listed = re.subn(r"^\s*(?:[-*+•]|\d+[.)])\s+", "", bare)
        bare = re.sub(r"^[\w.-]{3,40}:\s+", "", bare) if re.match(r"^[a-z][\w.-]{2,39}:\s", bare) else bare
        bare = re.sub(r"\S{41,}", lambda m: " " if _STRING.fullmatch(m[0]) and not _IS_CJK.search(m[0]) else m[0], bare)
        if bare.strip():
            yield bare.strip(), listed > 0


def words_of(sentence: str) -> list[str]:
    """Words; scripts without blanks are cut into pieces, marked by whether the sentence holds any kana."""
    out, mark = [], "\x01" if re.search("[ぁ-ヺ]", sentence) else "\x02"
    for m in _WORD.finditer(sentence):
        w = m[0]
        out += [p for p in re.findall(r"[ぁ-ヿ㐀-鿿豈-﫿々ｦ-ﾟ]+|[^ぁ-ヿ㐀-鿿豈-﫿々ｦ-ﾟ]+", w) for p in ([c + mark for c in _CJK.findall(p)] if _IS_CJK.match(p) else [p])] if _IS_CJK.search(w) else [w]
    return out


def calm(sentence: str) -> str:
    """A sentence in capitals throughout, in small letters."""
    return sentence.lower() if sentence.isupper() and len(sentence) > 20 else sentence


def is_name(word: str, first: bool) -> bool:
    """Words in capitals or with a capital inside a sentence say little about its language (nouns of German apart)."""
    if word.islower():
        return False
    return (not first and word[0].isupper() and word.isascii()) or bool(_INNER.search(word))


def counts(sentence: str, words: list[str], listed: bool) -> tuple[bool, bool]:
    """Whether a sentence holds enough words besides names, and whether it does if it is German, whose nouns have capitals.

    Lines of lists need no sign at their end. Korean is counted in syllables there, since a word of it is a phrase.
    """
    whole = listed or bool(_CLOSED.search(sentence))
    need = LEAST_WORDS if whole else LEAST_OPEN
    cjk = sum(len(w) - 1 for w in words if _IS_CJK.match(w))
    if cjk >= 4:
        terms = whole and not _CLOSED.search(sentence) and all(re.match("[ァ-ヿｦ-ﾟ]", w) for w in words if _IS_CJK.match(w))
        return cjk >= 2 * need and not terms, False
    told = sum(not is_name(w, i == 0) for i, w in enumerate(words))
    korean = whole and len(words) > 1 and len(_HANGUL.findall(sentence)) >= 2 * need
    german = whole and told > 0 and sum(not _INNER.search(w) for w in words) >= need
    return told >= need or korean, german


def _hash(text: str) -> int:
    return 1 + zlib.crc32(text.encode("utf-8", "replace")) % (SPACE - 1)


class Field:
    """The conditional random field: weights of hashed features per language, and transitions.

    A word's score is the sum over all its features, however many it has; it is computed once per distinct word.
    """

    def __init__(self, langs: list[str], lists: dict[str, set[str]] | None = None):
        self.langs, self.lists = langs, lists or {}
        self.w = np.zeros((SPACE, len(langs)), np.float32)
        self.t = np.zeros((len(langs), len(langs)), np.float32)
        self.known: dict[str, np.ndarray] = {}

    def features(self, word: str) -> list[int]:
        """Hashed features: the word, its affixes, the languages whose lists hold it, and all its two- and three-letter
        pieces; of scripts without blanks the piece, its characters and the sentence's mark."""
        if _IS_CJK.match(word):
            parts = [f"m{word[-1]}", f"c{word[:-1]}", *[f"c{c}" for c in word[:-1]]]
            low = word.lower()
        else:
            low = word.lower()
            edged = f"<{low}>"
            parts = [f"w{low}", *[f"p{low[:k]}" for k in (1, 2, 3)], *[f"s{low[-k:]}" for k in (1, 2, 3, 4)]]
            parts += dict.fromkeys(f"g{edged[i:i + n]}" for n in (3, 2) for i in range(len(edged) - n + 1))
        parts += [f"l{lang}" for lang, words in self.lists.items() if low in words]
        return [_hash(p) for p in parts]

    def scores(self, word: str) -> np.ndarray:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = self.w[self.features(word)].sum(0)
        return found

    def _forward_backward(self, emit: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward messages of padded chains, with the scaled emissions and transitions."""
        most = emit.shape[1]
        e = np.exp(emit - emit.max(2, keepdims=True))
        step = np.exp(self.t - self.t.max())
        a, b = np.zeros_like(e), np.ones_like(e)
        a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for i in range(1, most):
            x = (a[:, i - 1] @ step) * e[:, i]
            x /= x.sum(1, keepdims=True)
            a[:, i] = np.where(mask[:, i, None], x, a[:, i - 1])
        for i in range(most - 2, -1, -1):
            y = (b[:, i + 1] * e[:, i + 1]) @ step.T
            y /= y.sum(1, keepdims=True)
            b[:, i] = np.where(mask[:, i + 1, None], y, b[:, i])
        return a, b, e, step

    @staticmethod
    def _marginals(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = a * b
        m /= m.sum(2, keepdims=True)
        return m

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, e: np.ndarray, step: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The sum of the marginals of neighbouring words, over all places at once."""
        left, right = a[:, :-1], b[:, 1:] * e[:, 1:]
        scale = np.einsum("nij,jk,nik->ni", left, step, right, optimize=True)
        weight = np.where(mask[:, 1:], 1 / np.maximum(scale, 1e-30), 0)
        return step * np.einsum("nij,nik->jk", left * weight[:, :, None], right, optimize=True)

    def fit(self, chains: list[tuple[list[str], list[int]]], epochs: int = 4, rate: float = 0.25, seed: int = 3) -> "Field":
        """Adagrad on the conditional likelihood; the same input gives the same weights."""
        rng = np.random.default_rng(seed)
        g2, t2 = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-3)
        k = len(self.langs)
        number: dict[str, int] = {}
        coded = [np.array([number.setdefault(w, len(number)) for w in c], np.int64) for c, _ in chains]
        per_word = [np.array(self.features(w), np.int64) for w in number]
        size = np.array([len(f) for f in per_word], np.int64)
        begin, flat = np.concatenate([[0], np.cumsum(size)]), np.concatenate(per_word)
        for _ in range(epochs):
            order = rng.permutation(len(chains))
            for start in range(0, len(order), 64):
                part = order[start:start + 64]
                most = max(len(coded[i]) for i in part)
                ids, mask = np.zeros((len(part), most), np.int64), np.zeros((len(part), most), bool)
                gold, seen = np.zeros((len(part), most, k), np.float32), np.zeros((k, k))
                for row, i in enumerate(part):
                    y, n = chains[i][1], len(coded[i])
                    ids[row, :n], mask[row, :n] = coded[i], True
                    gold[row, np.arange(n), y] = 1
                    np.add.at(seen, (y[:-1], y[1:]), 1)
                words, where = np.unique(ids[mask], return_inverse=True)
                lengths = size[words]
                ends = np.cumsum(lengths)
                places = np.arange(ends[-1]) + np.repeat(begin[words] - (ends - lengths), lengths)
                feats = flat[places]
                by_word = np.add.reduceat(self.w[feats], ends - lengths, axis=0)
                emit = np.zeros((len(part), most, k), np.float32)
                emit[mask] = by_word[where]
                a, b, e, step = self._forward_backward(emit, mask)
                d = (gold - self._marginals(a, b))[mask]
                pull = np.stack([np.bincount(where, d[:, j], len(words)) for j in range(k)], 1)
                used, at = np.unique(feats, return_inverse=True)
                spread = np.repeat(pull, lengths, axis=0)
                grad = np.stack([np.bincount(at, spread[:, j], len(used)) for j in range(k)], 1).astype(np.float32)
                g2[used] += grad ** 2
                self.w[used] += rate * grad / np.sqrt(g2[used]) - 1e-5 * self.w[used]
                dt = ((seen - self._pairs(a, b, e, step, mask)) / len(part)).astype(np.float32)
                t2 += dt ** 2
                self.t += 0.1 * dt / np.sqrt(t2)
        self.known.clear()
        return self

    def label(self, chains: list[list[str]]) -> list[np.ndarray]:
        """Marginals of every word, per chain."""
        out: list[np.ndarray] = [np.empty(0)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        start = 0
        while start < len(order):
            size = max(1, min(512, 20_000 // max(1, len(chains[order[start]]))))
            part = order[start:start + size]
            lengths = np.array([len(chains[i]) for i in part])
            mask = np.arange(lengths.max()) < lengths[:, None]
            emit = np.zeros((*mask.shape, len(self.langs)), np.float32)
            emit[mask] = [self.scores(w) for i in part for w in chains[i]]
            a, b, _, _ = self._forward_backward(emit, mask)
            m = self._marginals(a, b)
            for row, i in enumerate(part):
                out[i] = m[row, :len(chains[i])]
            start += size
        return out


def sentences_of(line: str) -> list[str]:
    return [s for s in (x.strip() for x in _END.split(line)) if s]


def segments(field: Field, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
    """Per text its sentences in order as (language, confidence, words); only whole sentences and lines that count."""
    chains, spans, owners, german = [], [], [], set()
    for doc, text in enumerate(texts):
        for line, listed in items_of(text) if text else ():
            chain, marks = [], []
            for s in sentences_of(line):
                words = words_of(calm(s))
                enough, if_german = counts(s, words, listed)
                if not enough and not if_german:
                    continue
                # What counts only in German is labelled by itself.
                if chain and (not enough or len(chain) + len(words) > CHAIN):
                    chains.append(chain), spans.append(marks), owners.append(doc)
                    chain, marks = [], []
                for at in range(0, len(words), CHAIN):  # one endless sentence is several chains
                    part = words[at:at + CHAIN]
                    if len(chain) + len(part) > CHAIN:
                        chains.append(chain), spans.append(marks), owners.append(doc)
                        chain, marks = [], []
                    marks.append((len(chain), len(chain) + len(part)))
                    chain = chain + part
                if not enough:
                    german.add(len(chains))
                    chains.append(chain), spans.append(marks), owners.append(doc)
                    chain, marks = [], []
            if chain:
                chains.append(chain), spans.append(marks), owners.append(doc)
    found: list[list[tuple[str, float, int]]] = [[] for _ in texts]
    for at, (doc, marks, chain, m) in enumerate(zip(owners, spans, chains, field.label(chains))):
        for a, b in marks:
            weigh = np.array([0.15 if is_name(w, a + i == a) else 1.0 for i, w in enumerate(chain[a:b])])
            mean = (m[a:b] * weigh[:, None]).sum(0) / weigh.sum()
            best = int(mean.argmax())
            if at not in german or field.langs[best] == "de":
                found[doc].append((field.langs[best], float(mean[best]), b - a))
    return found


def _chains(sentences: list[tuple[str, list[str]]], langs: list[str], seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Training chains of one to three sentences, a third of them of mixed languages."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[list[str]]] = {}
    for lang, words in sentences:
        by.setdefault(lang, []).append(words)
    out, have = [], sorted(by)
    for lang in have:
        for words in by[lang]:
            chain, y = list(words), [langs.index(lang)] * len(words)
            for _ in range(int(rng.integers(0, 3))):
                other = lang if rng.random() < 0.6 else have[int(rng.integers(len(have)))]
                more = by[other][int(rng.integers(len(by[other])))]
                if len(chain) + len(more) <= CHAIN:
                    chain, y = chain + list(more), y + [langs.index(other)] * len(more)
            out.append((chain[:CHAIN], y[:CHAIN]))
    return out


def _lists(sentences: list[tuple[str, list[str]]]) -> dict[str, set[str]]:
    """Word lists: words of a language seen in at least two sentences of it and in few others."""
    seen: dict[str, dict[str, int]] = {}
    for lang, words in sentences:
        for w in {w.lower() for i, w in enumerate(words) if not is_name(w, i == 0)}:
            seen.setdefault(w, {}).setdefault(lang, 0)
            seen[w][lang] += 1
    out: dict[str, set[str]] = {}
    for w, by in seen.items():
        for lang, n in by.items():
            if n >= 2 and n >= 0.2 * sum(by.values()):
                out.setdefault(lang, set()).add(w)
    return out


def fit(samples: list[tuple[str, str]], labelled: list[tuple[str, str]] = ()) -> Field:
    """Fit on clean (lang, text) samples, then twice more with the labelled texts that the fit before confirms."""
    def split(pairs) -> list[tuple[str, list[str]]]:
        return [(lang, words) for lang, text in pairs for line in lines_of(text) for s in sentences_of(line) if len(words := words_of(s)) >= LEAST_WORDS]

    langs = sorted({lang for lang, _ in samples})
    clean = split(samples)
    model = Field(langs, _lists(clean)).fit(_chains(clean, langs))
    texts = [labelled[i] for i in np.random.default_rng(9).permutation(len(labelled)) if labelled[i][0] in langs]
    for _ in range(2 if texts else 0):  # the second time the labels are confirmed by a fit that knows the corpus
        every = clean + _confirmed(model, texts, split)
        model = Field(langs, _lists(every)).fit(_chains(every, langs), epochs=3)
    return model


def _confirmed(model: Field, texts: list[tuple[str, str]], split) -> list[tuple[str, list[str]]]:
    """Sentences of texts in one language: most words agree with the label, and no sentence is surely in another.

    Doubtful sentences of such a text are its language's too; else what the samples don't know would never be learned.
    """
    more: dict[str, list[list[str]]] = {}
    for at in range(0, len(texts), 500):
        owned = [(doc, words[:CHAIN]) for doc, pair in enumerate(texts[at:at + 500]) for _, words in split([pair])]
        told: dict[int, list[tuple[list[str], np.ndarray]]] = {}
        for (doc, words), m in zip(owned, model.label([w for _, w in owned])):
            told.setdefault(doc, []).append((words, m.mean(0)))
        for doc, rows in told.items():
            k = model.langs.index(texts[at + doc][0])
            agreed = sum(len(w) for w, m in rows if m.argmax() == k)
            if agreed >= 0.7 * sum(len(w) for w, _ in rows) and all(m.argmax() == k or m.max() < 0.7 for _, m in rows):
                kept = more.setdefault(model.langs[k], [])
                kept += [w for w, _ in rows][:MOST_SENTENCES - len(kept)]
    return [(lang, w) for lang, rows in sorted(more.items()) for w in rows]


def training(documents: DataFrame, samples: DataFrame) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(clean samples, labelled documents) that a field is fitted on, within the bounds above: of each the rows with the
    least hash."""
    label = label_of(F.col("lang"))
    clean = samples.where("lang is not null and text <> ''").orderBy(F.xxhash64("lang", "text")).limit(MOST_SAMPLES).select("lang", "text")
    some = documents.where(label.isNotNull() & (F.length("text") < MOST_CHARACTERS) & (F.col("text") != "")).orderBy(
        F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(MOST_DOCUMENTS).select(label.alias("lang"), "text")
    return sorted((r.lang, r.text) for r in clean.collect()), [(r.lang, r.text) for r in some.collect()]


def save(field: Field, spark: SparkSession, path: str) -> None:
    """Write a field as a table: a row per used feature with its weights, per listed word, and one with the transitions."""
    used = np.flatnonzero(np.abs(field.w).sum(1))
    rows = [(int(i), None, None, [float(x) for x in field.w[i]]) for i in used]
    rows += [(None, lang, w, None) for lang, words in sorted(field.lists.items()) for w in sorted(words)]
    rows += [(-1 - i, lang, None, [float(x) for x in field.t[i]]) for i, lang in enumerate(field.langs)]
    spark.createDataFrame(rows, "feature long, lang string, word string, weights array<float>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Field | None:
    """The field written at path, if one is there whole. At most SPACE rows of weights and the listed words reach the driver."""
    try:
        rows = spark.read.parquet(path).toPandas()
    except AnalysisException:
        return None
    states = rows[rows["feature"] < 0].sort_values("feature", ascending=False)
    if states.empty:
        return None
    lists = {lang: set(part["word"]) for lang, part in rows[rows["word"].notna()].groupby("lang")}
    field = Field(list(states["lang"]), lists)
    field.t = np.array(states["weights"].tolist(), np.float32)
    weights = rows[rows["feature"] >= 0]
    field.w[weights["feature"].to_numpy(np.int64)] = np.array(weights["weights"].tolist(), np.float32)
    return field


def field_for(documents: DataFrame, samples: DataFrame) -> Field:
    """The field for these tables: read from the shared folder if one was fitted on the same files with the same bounds,
    else fitted and kept there. Tables that are no files are fitted on each time."""
    spark = documents.sparkSession

    sign = signature(documents, samples, bounds=(MOST_DOCUMENTS, MOST_CHARACTERS, MOST_SENTENCES, MOST_SAMPLES, SPACE, CHAIN))
    if sign is None:
        return fit(*training(documents, samples))
    path = f"{shared_root(spark)}/feedloom/derived/field-{sign}"
    field = load(spark, path)
    if field is None:
        field = fit(*training(documents, samples))
        save(field, spark, path)
    return field


def detect(documents: DataFrame, samples: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, label, found): the named label and the text's segments [(lang, confidence, sentences, words)] in order.

    Neighbouring sentences of one language are one segment. Texts that are null, empty, or hold only code, logs, names,
    headings and quoted fragments have no segments. One row per input row; no shuffle. The field is that of field_for(),
    unless one is given.
    """
    spark = documents.sparkSession
    field = field or field_for(documents, samples)
    used = np.flatnonzero(np.abs(field.w).sum(1))
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, field.langs, field.lists, used, field.w[used].astype(np.float16), field.t))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _received(sent)
        for f in frames:
            texts = [t if isinstance(t, str) else None for t in f["text"]]
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t) if t else 0
                if size > 2_000_000 or i == len(texts) - 1:
                    part = f.iloc[start:i + 1]
                    rows = []
                    for doc, label, found in zip(part["doc_id"], part["label"], segments(model, texts[start:i + 1])):
                        merged: list[list] = []
                        for lang, sure, n in found:
                            if merged and merged[-1][0] == lang:
                                m = merged[-1]
                                m[1], m[2], m[3] = (m[1] * m[3] + sure * n) / (m[3] + n), m[2] + 1, m[3] + n
                            else:
                                merged.append([lang, sure, 1, n])
                        rows.append((doc, label, [{"lang": a, "confidence": round(b, 4), "sentences": c, "words": d} for a, b, c, d in merged]))
                    yield pd.DataFrame(rows, columns=["doc_id", "label", "found"])
                    start, size = i + 1, 0

    schema = "doc_id long, label string, found array<struct<lang string, confidence double, sentences int, words int>>"
    return documents.select(F.col("doc_id").cast("long"), label_of(F.col("lang")).alias("label"), F.col("text").cast("string")).mapInPandas(run, schema)


_MODEL: list = []


def _received(sent) -> Field:
    key, langs, lists, used, w, t = sent.value
    if not _MODEL or _MODEL[0] != key:
        model = Field(langs, lists)
        model.w[used] = w.astype(np.float32)
        model.t = t
        _MODEL[:] = [key, model]
    return _MODEL[1]


def document_languages(found: DataFrame) -> DataFrame:
    """(doc_id, label, lang, confidence, words): a row per language a document holds a sure segment of."""
    one = found.select("doc_id", "label", F.explode("found").alias("s")).where(F.col("s.confidence") >= LEAST_CONFIDENCE)
    return one.groupBy("doc_id", "label", "s.lang").agg(F.round(F.sum(F.col("s.confidence") * F.col("s.words")) / F.sum("s.words"), 4).alias("confidence"), F.sum("s.words").alias("words"))


def wrong_or_missing(found: DataFrame) -> DataFrame:
    """(doc_id, lang): languages of documents without a label, with another label than their language, or with several."""
    langs = F.array_distinct(F.transform(F.filter("found", lambda s: s["confidence"] >= LEAST_CONFIDENCE), lambda s: s["lang"]))
    rows = found.select("doc_id", "label", langs.alias("langs"))
    case = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return rows.where(case).select("doc_id", F.explode("langs").alias("lang"))
