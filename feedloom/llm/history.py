"""Checking new batches for repeats against everything accepted so far (problem 1).

Sorted runs of blocked keys. Every article gives a few rows: its address in one spelling, and its headline in a block per
name, or without names in a block per rare word. A batch's distinct keys form a run, kept as files sorted by block. A new
batch opens the files whose range holds a block of its own, and is merged with those blocks; within them an index of words
and numbers, instead of a window of fixed width, gives each new key all headlines of its block that can be the same. Runs
are compacted into one every few batches. What is found are links between articles; their components are the stories.
"""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from urllib.parse import parse_qsl, unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from feedloom.llm.textform import IGNORABLE, LOOKALIKE
from feedloom.operators.graph import components
from feedloom.runtime import Workspace

#: Shares of words that headlines with a common name, and those without names, have in common at least.
NAMED_SHARE, NAMELESS_SHARE = 0.45, 0.8
#: Runs merged into one once there are so many.
COMPACT = 5
#: A word is common if it stands with so many different other words: a share of the titles, and at least so many.
COMMON_SHARE, COMMON_LEAST = 3e-4, 8
#: The same for words that are mostly written in lower case, which names aren't.
LOWER_SHARE, LOWER_LEAST = 1e-4, 3
#: Blocks of a batch that may be broadcast (8 bytes each); beyond, the runs are joined by a shuffle.
MOST_BROADCAST = 1_000_000
# Query parameters that only say where a click came from, and marks that editors put around headlines.
CLICK = re.compile(r"^(?:utm_.*|[a-z]*clid|mc_[ce]id|_hs.*|ref|ref_src|ref_url|referrer|igshid|mkt_tok|spm|cmpid|ocid|_ga|_gl|s_cid)$")
MARKS = frozenset("re fw fwd psa show ask tell breaking update updated pr ad sponsored video longread repost pdf new live exclusive audio podcast thread opinion analysis 更新 追記 追記あり 動画 速報 続報 影片 轉貼 快訊 独自 獨家".split())

_DROP = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]+")
_LETTERS = {ord(c): row[0] for row in LOOKALIKE.strip().split("\n") if row[0] < "\x7f" for c in row.split(" ")[1:] if c}
# Ideographs that stand for the katakana they look like between katakana.
_KANA = dict(zip("口力夕二卜八工一才千三", "ロカタニトハエーオチミ"))
_KANA_SLIP = re.compile("(?<=[ァ-ヶー])[口力夕二卜八工一才千三](?=[ァ-ヶー])|(?<=[ァ-ヶー])[口夕卜一](?![一-龥])|(?<![一-龥])[口夕卜](?=[ァ-ヶー])")
_SEPARATED = re.compile(r"^(.*\S)\s*(?:\||｜|::|—|–|-|/)\s*([^|｜—–]{1,40}?)\s*$", re.S)
_TAIL_MARK = re.compile(r"\s*[\[(（【［]([^\])）】］]{1,10})[\])）】］]\s*[.!?！？。…]*\s*$")
_SHORT_MARK = re.compile(r"[A-Za-zÀ-ɏ]{2,10}|[ぁ-ヿ㐀-鿿]{1,4}")
_HEAD_MARK = re.compile(r"^\s*(?:[\[(（【［]([^\])）】］]{1,10})[\])）】］]|([^\W\d_]{1,10}):)\s*")
_CUT = re.compile(r"\s*(?:…+|\.{3,}|\[…\]|\[\.\.\.\])[!?.]*\s*$")
_TOKEN = re.compile(r"(\d+(?:[.,]\d+)*)|([A-Za-zÀ-ɏЀ-ӿ가-힣]+(?:['’][A-Za-zÀ-ɏ]+)*(?:-\d+)?)|([ァ-ヶー]+)|([ぁ-ゟ㐀-鿿々]+)")


def url_key(url: str | None) -> str | None:
    """One spelling per page: scheme, user, default port, 'www.', letter case of the host, dot segments, percent signs,
    closing slashes, index files, fragments, order of parameters and click parameters don't matter. None for null, blank
    and what is no address."""
    if not url or not url.strip():
        return None
    text = "".join(url.split())
    try:
        parts = urlsplit(text if "://" in text[:16] else "http://" + text.lstrip("/"))
        name = (parts.hostname or "").rstrip(".")
        port = parts.port
    except ValueError:
        return None
    if "." not in name:
        return None
    try:
        name = name.encode("idna").decode() if not name.isascii() else name
    except UnicodeError:
        pass
    name = re.sub(r"^www\d?\.", "", name)
    segments: list[str] = []
    for piece in unicodedata.normalize("NFC", unquote(parts.path)).split("/"):
        if piece == "..":
            segments = segments[:-1]
        elif piece not in ("", "."):
            segments.append(piece)
    if segments and re.fullmatch(r"(?:index|default)\.(?:html?|php|aspx?|jsp)", segments[-1].lower()):
        segments.pop()
    asked = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not CLICK.match(k.lower()))
    at = "" if port in (None, 80, 443) else f":{port}"
    bang = parts.fragment if parts.fragment.startswith("!") else ""
    return f"{name}{at}/{'/'.join(segments)}?{'&'.join(f'{k}={v}' for k, v in asked)}#{bang}"


def plain(title: str) -> str:
    """The title with look-alike letters, blanks and ignorable characters in one form; letter case and kana are kept."""
    if not title.isascii():
        title = _DROP.sub("", unicodedata.normalize("NFKC", _DROP.sub("", title))).translate(_LETTERS)
        title = _KANA_SLIP.sub(lambda m: _KANA[m[0]], title)
    return " ".join(title.split())


def label_forms(labels) -> frozenset[str]:
    """What a label may look like at the end of a headline: without blanks and signs, and its first word."""
    whole = {re.sub(r"[\W_]+", "", x.casefold()) for x in labels if x}
    return frozenset(whole | {re.split(r"[\W_]+", x.casefold().strip())[0] for x in labels if x and len(x) > 5} - {""})


@functools.lru_cache(maxsize=20_000)
def _is_label(segment: str, forms: frozenset[str]) -> bool:
    """A label, also cut off or with one letter or swap wrong."""
    form = re.sub(r"[\W_]+", "", segment.casefold())
    if form in forms:
        return True
    if len(form) < 4:
        return False
    return any(f.startswith(form) or abs(len(f) - len(form)) <= 1 and _nearly(f, form) for f in forms)


def _nearly(a: str, b: str) -> bool:
    """Whether two words differ by one letter left out, added, changed or swapped with the next."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return len(b) - len(a) == 1 and a[i:] == b[i + 1:]
    return a[i + 1:] == b[i + 1:] or a[i:i + 2] == b[i:i + 2][::-1] and a[i + 2:] == b[i + 2:]


def bare(title: str, labels: frozenset[str], own: str = "") -> tuple[str, bool]:
    """The headline without labels of contributors and marks around it, and whether its end is cut off.

    labels are label_forms; own is the label of the article's contributor.
    """
    text, cut = title, False
    mine = label_forms([own]) if own else frozenset()
    while True:
        before = text
        if m := _CUT.search(text):
            text, cut = text[:m.start()], True
        if (m := _TAIL_MARK.search(text)) and m.start() > 0 and (m[1].casefold() in MARKS or _SHORT_MARK.fullmatch(m[1])):
            text = text[:m.start()]
        if (m := _HEAD_MARK.match(text)) and m.end() < len(text) and ((m[1] or m[2]).casefold() in MARKS or m[1] and _SHORT_MARK.fullmatch(m[1])):
            text = text[m.end():]
        if (m := _SEPARATED.match(text)) and (_is_label(m[2], labels) or mine and _is_label(m[2], mine)):
            text = m[1]
        if text == before:
            return text, cut


def _unaccented(word: str) -> str:
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)) if word[0] < "ʰ" else word


def pieces(text: str) -> list[tuple[str, str, bool]]:
    """(kind, folded token, whether it begins with a capital): kinds are number, word, kana and run (of ideographs)."""
    out = []
    for m in _TOKEN.finditer(text):
        if m[1]:
            out.append(("number", m[1], False))
        elif m[2]:
            out.append(("word", _unaccented(m[2].casefold()), m[2][0] != m[2][0].lower()))
        elif m[3]:
            out.append(("kana" if len(m[3]) > 1 else "run", m[3], False))
        else:
            out.append(("run", m[4], False))
    return out


def _pairs(run: str) -> list[str]:
    return [run[i:i + 2] for i in range(max(1, len(run) - 1))]


def _dropped(word: str) -> set[str]:
    return {word[:i] + word[i + 1:] for i in range(len(word))}


class Lexicon:
    """Common words with their frequency, and the common word next to a misspelling (one letter or one swap away); runs
    are the common pairs of ideographs with theirs."""

    def __init__(self, words: dict[str, float], runs: dict[str, float] | None = None):
        self.words, self.runs = words, runs or {}
        self.near: dict[str, str] = {}
        for w in sorted(words, key=lambda w: words[w]):
            if len(w) >= 4:
                for d in _dropped(w):
                    self.near[d] = w
        self.small = {w for w, f in words.items() if f >= 0.015 and len(w) <= 5} | {w for w in words if len(w) <= 2}

    def fix(self, word: str) -> str:
        if word in self.words or len(word) < 4:
            return word
        if word in self.near:  # a letter is missing
            return self.near[word]
        for d in _dropped(word):
            if d in self.words and len(d) >= 3 or d in self.near and len(d) >= 4:  # one too many; a wrong one or a swap
                return d if d in self.words else self.near[d]
        return word


class Headline:
    """What two headlines are compared by."""

    __slots__ = ("names", "numbers", "words", "cut", "order", "last")

    def __init__(self, title: str | None, lexicon: Lexicon, labels: frozenset[str], own: str = ""):
        text, self.cut = bare(plain(title or ""), labels, own)
        found = pieces(text)
        self.numbers, self.names, self.words = [], [], []
        self.order: list[str] = []
        for kind, token, capital in found:
            if kind == "number":
                self.numbers.append(token)
                self.order.append(token)
                continue
            if kind == "run":
                self.words += _pairs(token)
                continue
            fixed = lexicon.fix(token)
            if fixed in lexicon.words:
                if fixed not in lexicon.small:
                    self.words.append(fixed)
            elif capital or kind == "kana" or token[-1:].isdigit():
                self.names.append(token)
                self.order.append(token)
            else:
                self.words.append(token)
        self.last = found[-1][1] if found else ""

    def keys(self, lexicon: Lexicon) -> list[tuple[str, str, str]]:
        """(pass, block, key); none for a headline without letters or digits. The key is the same in all blocks; pass a is
        the first of them.

        Headlines with names are the same only if they share one, so each name is a block. Those without share
        NAMELESS_SHARE of the longer one's words; in one order of all words, the rarest first, two such headlines share one
        of their first words, beyond which fewer than that share are left.
        """
        key = " ".join(sorted(set(self.names)) + sorted(self.numbers)) + " | " + " ".join(sorted(set(self.words)))
        if self.names:
            blocks = sorted(set(self.names))
        else:
            often = lambda w: lexicon.words.get(w) or lexicon.runs.get(w, 0.0)
            words = sorted(self.words, key=lambda w: (often(w), w))
            blocks = list(dict.fromkeys(words[:len(words) - math.ceil(NAMELESS_SHARE * len(words) - 1e-9) + 1]))
        if not blocks and self.numbers:
            blocks = [" ".join(sorted(self.numbers))]
        return [("b" if i else "a", b, key) for i, b in enumerate(blocks)]

    def pack(self) -> str:
        return "\x1f".join(["\x1e".join(self.names), "\x1e".join(self.numbers), "\x1e".join(self.words), "1" if self.cut else "", self.last])


@functools.lru_cache(maxsize=4096)
def _unpack(text: str) -> tuple[Counter, Counter, Counter, bool, str]:
    names, numbers, words, cut, last = text.split("\x1f")
    return Counter(filter(None, names.split("\x1e"))), Counter(filter(None, numbers.split("\x1e"))), Counter(filter(None, words.split("\x1e"))), bool(cut), last


def same_headline(one: str, other: str) -> bool:
    """Whether two packed headlines are the same: equal names and numbers as far as neither is cut, and most words shared."""
    return _same(_unpack(one), _unpack(other))


def _same(one: tuple, other: tuple) -> bool:
    (n1, d1, w1, c1, l1), (n2, d2, w2, c2, l2) = one, other
    size1, size2 = sum(n1.values()) + sum(w1.values()), sum(n2.values()) + sum(w2.values())
    # In capitals throughout, a word may be taken for a name; where the other headline has it as a word, it is one.
    taken = {x for x in n1 if x in w2} | {x for x in n2 if x in w1}
    if taken:
        w1, w2 = w1 + Counter({x: n1[x] for x in taken if x in n1}), w2 + Counter({x: n2[x] for x in taken if x in n2})
        n1, n2 = Counter({x: c for x, c in n1.items() if x not in taken}), Counter({x: c for x, c in n2.items() if x not in taken})
    first, second = set(n1) - set(n2), set(n2) - set(n1)
    if first and second and (len(first) == 1 or len(second) == 1):  # a name broken off at the end of the shorter one
        if size1 <= size2 and l1 in first and any(x.startswith(l1) for x in second):
            second = {x for x in second if not x.startswith(l1)}
            first = first - {l1}
        elif size2 <= size1 and l2 in second and any(x.startswith(l2) for x in first):
            first = {x for x in first if not x.startswith(l2)}
            second = second - {l2}
    if first and second:  # one letter wrong in a long word; short ones and those with a number are other names
        for x in sorted(first):
            y = next((y for y in sorted(second) if len(x) >= 8 and len(y) >= 8 and _nearly(x, y) and x.isalpha() and y.isalpha()), None)
            if y and set(n1) & set(n2):
                first, second = first - {x}, second - {y}
    if first and second:
        return False
    if d1 != d2 and not ((c1 or size1 < size2) and not d1 - d2 and not first or (c2 or size2 < size1) and not d2 - d1 and not second):
        return False
    if d1 != d2 and abs(sum(d1.values()) - sum(d2.values())) and not (c1 or c2) and not (first or second):
        return False
    shared, least, most = sum((w1 & w2).values()), min(sum(w1.values()), sum(w2.values())), max(sum(w1.values()), sum(w2.values()))
    if not least:
        return not most and n1 == n2 and d1 == d2 and bool(n1)
    if not (set(n1) & set(n2)):
        return not n1 and not n2 and shared >= NAMELESS_SHARE * most or (c1 or c2) and shared >= 0.9 * least and least >= 4
    if first or second:
        extra = len(first) + len(second)
        return least >= 3 and (shared >= 0.7 * least and extra <= 2 or shared >= 0.85 * least and extra <= 6)
    return shared >= (NAMED_SHARE if len(n1) > 1 else 0.55) * least and (shared >= 0.35 * most or c1 or c2)


# --- tables -----------------------------------------------------------------------------------------------------

#: Rows of one file of a run, and rows of a block that one task compares; larger blocks are cut into pieces.
RUN_ROWS, SPLIT = 100_000, 50_000
RUN = "pass string, block long, key string, id long, text string, n long"


def label(source: str | None) -> str:
    return (source or "").casefold().strip()


def lexicon_of(articles: DataFrame, labels: frozenset[str]) -> Lexicon:
    """Common words of all titles: words that stand with many different other words, so that a story told a million
    times makes no common word of its names. At most (words of a title) / LOWER_SHARE entries, whatever the corpus."""
    @F.pandas_udf("array<struct<w:string,c:string,l:boolean,r:boolean>>")
    def split(titles: pd.Series) -> pd.Series:
        out = []
        for t in titles:
            every = pieces(bare(plain(t), labels)[0])
            found = {p[1]: p[0] == "word" and not p[2] for p in every if p[0] in ("word", "kana")}
            runs = {w for p in every if p[0] == "run" for w in _pairs(p[1])}
            far = sorted(found, key=lambda w: (-len(w), w))[:2]
            out.append([{"w": w, "c": next((x for x in far if x != w), ""), "l": low, "r": False} for w, low in found.items()] + [{"w": w, "c": "", "l": False, "r": True} for w in sorted(runs)])
        return pd.Series(out)

    titles = articles.where("title <> ''").select("title")
    total = titles.count()
    words = titles.select(F.explode(split("title")).alias("x")).groupBy("x.w").agg(F.approx_count_distinct("x.c", 0.05).alias("n"), F.count(F.lit(1)).alias("f"), F.count_if("x.l").alias("low"), F.bool_or("x.r").alias("run"))
    common = F.col("n") >= max(COMMON_LEAST, COMMON_SHARE * total)
    lower = (F.col("n") >= max(LOWER_LEAST, LOWER_SHARE * total)) & (F.col("low") >= 0.5 * F.col("f"))
    paired = F.col("run") & (F.col("f") >= max(LOWER_LEAST, LOWER_SHARE * total))
    rows = words.where(~F.col("run") & (common | lower) | paired).collect()
    return Lexicon({r.w: r.f / total for r in rows if not r.run}, {r.w: r.f / total for r in rows if r.run})


class History:
    """Everything accepted so far, kept in one folder; ingest() takes a batch at a time, and the folder can be opened again.

    The folder holds the runs (files sorted by block, with the range of blocks of each file in the state), the links, the
    accepted titles, and the lexicon that all keys in the runs were made with. That lexicon is fitted on accepted titles
    only: on the first batch, and anew, with all keys, when the titles have doubled since. Nothing of a batch to come is known.
    """

    def __init__(self, work: Workspace, labels: frozenset[str]):
        self.work, self.spark, self.labels = work, work.spark, labels
        self.state = json.loads(work.get("state.json") or "null") or {"batches": 0, "version": 0, "titles": 0, "fitted": 0, "accepted": [], "runs": [], "links": [], "stories": None}
        self.lexicon = None
        if self.state["version"]:
            words = json.loads(work.get(f"lexicon-{self.state['version']}.json"))
            self.lexicon = Lexicon(words["words"], words["runs"])

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.work.path}/{name}")

    def _fit(self, titles: DataFrame) -> None:
        self.lexicon = lexicon_of(titles, self.labels)
        self.state["version"] += 1
        self.work.put(f"lexicon-{self.state['version']}.json", json.dumps({"words": self.lexicon.words, "runs": self.lexicon.runs}, ensure_ascii=False, sort_keys=True))

    def _keyed(self, batch: DataFrame) -> DataFrame:
        labels, words = self.labels, self.spark.sparkContext.broadcast((f"{self.work.path} {self.state['version']}", self.lexicon.words, self.lexicon.runs))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lexicon = _shared_lexicon(words)
            for f in frames:
                rows = []
                for article, url, title, source in f.itertuples(index=False):
                    u = url_key(url)
                    if u:
                        rows.append(("u", u, u, article, None))
                    if title and title.strip():
                        h = Headline(title, lexicon, labels, label(source))
                        packed = h.pack()
                        rows += [(p, b, k, article, packed) for p, b, k in h.keys(lexicon)]
                yield pd.DataFrame(rows, columns=["pass", "block", "key", "id", "text"])

        return batch.select(F.col("article_id").cast("long").alias("id"), "url", "title", "source").mapInPandas(run, "pass string, block string, key string, id long, text string").withColumn("block", F.xxhash64(F.col("pass") == "u", "block"))

    def _write_run(self, rows: DataFrame, name: str, most: int) -> DataFrame:
        """Write a run as files of RUN_ROWS rows at most, sorted by block and key, and note each file's range of blocks. most is
        a bound of its rows: what fits into one file is sorted as one, without sampling ranges or asking files for theirs."""
        alone = most <= RUN_ROWS
        seen = Observation()
        placed = (rows.repartition(1) if alone else rows.repartitionByRange("block", "key")).sortWithinPartitions("block", "key")
        told = [F.min("block").alias("first"), F.max("block").alias("last"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("pass") == "a", F.col("n"))).alias("titles")]
        placed.observe(seen, *told).write.mode("overwrite").option("maxRecordsPerFile", RUN_ROWS).parquet(f"{self.work.path}/{name}")
        written, whole = self._table(name, RUN), seen.get
        if alone:
            files = [[whole["first"], whole["last"], at] for at in written.inputFiles()] if whole["rows"] else []
        else:
            files = sorted([f.first, f.last, f.file] for f in written.groupBy(F.col("_metadata.file_path").alias("file")).agg(*told[:2]).collect())
        self.state["runs"].append({"name": name, "rows": whole["rows"], "files": files})
        self.state["titles"] += whole["titles"] or 0
        return written

    def _touched(self, blocks: DataFrame) -> list[str]:
        """Files of all runs whose range holds a block of the batch. The ranges are one row per RUN_ROWS rows of history."""
        runs = [run["files"] for run in self.state["runs"] if run["files"]]
        sides = [(np.array([f[0] for f in files], np.int64), np.sort(np.array([f[1] for f in files], np.int64))) for files in runs]

        @F.pandas_udf("array<struct<r:int,f:int>>")
        def held(values: pd.Series) -> pd.Series:
            # Files of a run are in order, so those that hold a block are a stretch; all blocks of a batch at once.
            found, blocks = [], values.to_numpy(np.int64)
            for r, (first, last) in enumerate(sides):
                begin, end = np.searchsorted(last, blocks, "left"), np.searchsorted(first, blocks, "right")
                edges = np.bincount(begin[begin < end], minlength=len(first) + 1) - np.bincount(end[begin < end], minlength=len(first) + 1)
                found += [{"r": r, "f": int(f)} for f in np.flatnonzero(np.cumsum(edges)[:-1])]
            return pd.Series([found] + [[]] * (len(values) - 1)) if len(values) else pd.Series([], dtype="object")

        hit = blocks.select(F.explode(held("block")).alias("x")).select("x.r", "x.f").distinct().collect() if runs else []
        return sorted(runs[h.r][h.f][2] for h in hit)

    def ingest(self, batch: DataFrame, kept_at: str | None = None) -> DataFrame:
        """Compare a batch (article_id, url, title, source) with all runs and with itself, keep its run, and return its links
        (a, b: equal stories). Only files of runs that hold a block of the batch are opened. kept_at names a folder in which the
        batch already lies, so that its titles need not be kept once more."""
        state = self.state
        number = state["batches"] = state["batches"] + 1
        if self.lexicon is None:
            self._fit(batch)
            state["fitted"] = -1  # until the first run is counted
        accepted = batch.select("article_id", "url", "title", "source")
        if kept_at is None:
            self.work.write(accepted, f"accepted-{number}")
        state["accepted"].append(kept_at or f"accepted-{number}")
        counted = Observation()
        keyed = self.work.write(self._keyed(batch).observe(counted, F.count(F.lit(1)).alias("rows")), f"keyed-{number}")
        older = [f for run in state["runs"] for f in run["files"]]
        run = self._write_run(keyed.groupBy("pass", "block", "key").agg(F.min(F.struct("id", "text")).alias("m"), F.count(F.lit(1)).alias("n")).select("pass", "block", "key", "m.id", "m.text", "n"), f"run-{number}", counted.get["rows"])
        mine = state["runs"].pop()
        if state["fitted"] < 0:
            state["fitted"] = state["titles"]
        # Exact copies inside the batch: to the first row of the key. Only keys that repeat are joined.
        firsts = run.where("n > 1 and pass in ('u', 'a')").select("pass", "key", F.col("id").alias("first"))
        copies = keyed.where("pass in ('u', 'a')").select("pass", "key", "id").join(firsts, ["pass", "key"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
        rows = run.drop("n").withColumn("new", F.lit(True))
        if older:
            blocks = run.select("block").distinct()
            touched = self._touched(blocks)
            if touched:
                old = self.spark.read.schema(RUN).parquet(*touched).drop("n")
                old = old.join(F.broadcast(blocks) if mine["rows"] <= MOST_BROADCAST else blocks, "block", "left_semi")
                rows = rows.unionByName(old.withColumn("new", F.lit(False)))
        found = _placed(rows, mine["rows"] + sum(r["rows"] for r in state["runs"])).mapInPandas(_compare, "a long, b long")
        links = self.work.write(found.unionByName(copies), f"links-{number}")
        state["links"].append(f"links-{number}")
        state["runs"].append(mine)
        self.work.remove(f"keyed-{number}")
        if state["titles"] >= 2 * max(1, state["fitted"]):
            self.refit()
        elif len(state["runs"]) > COMPACT:
            self.compact()
        self._keep()
        return links

    def _keep(self) -> None:
        self.work.put("state.json", json.dumps(self.state))

    def _replace(self, rows: DataFrame, name: str) -> None:
        """One run in place of all. The old ones are removed once the state no longer names them."""
        before, titles = self.state["runs"], self.state["titles"]
        self.state["runs"] = []
        self._write_run(rows, name, sum(run["rows"] for run in before))
        self.state["titles"] = titles
        self._keep()
        for run in before:
            self.work.remove(run["name"])

    def compact(self) -> None:
        """Merge all runs into one with each key's first article."""
        whole = functools.reduce(DataFrame.unionByName, [self._table(run["name"], RUN) for run in self.state["runs"]])
        merged = whole.groupBy("pass", "block", "key").agg(F.min(F.struct("id", "text")).alias("m"), F.sum("n").alias("n")).select("pass", "block", "key", "m.id", "m.text", "n")
        self._replace(merged, f"compact-{self.state['batches']}")

    def refit(self) -> None:
        """A new version of the lexicon from all accepted titles, and one run of keys made with it. Done when the titles have
        doubled, so a title is keyed a few times in its life at most."""
        parts = [self._table(name, "article_id long, url string, title string, source string") for name in self.state["accepted"]]
        accepted = functools.reduce(DataFrame.unionByName, parts)
        self._fit(accepted)
        keyed = self._keyed(accepted)
        self.state["fitted"] = self.state["titles"]
        self._replace(keyed.groupBy("pass", "block", "key").agg(F.min(F.struct("id", "text")).alias("m"), F.count(F.lit(1)).alias("n")).select("pass", "block", "key", "m.id", "m.text", "n"), f"refit-{self.state['batches']}")

    def stories(self) -> DataFrame:
        """(node, label): every linked article with the first article of its story.

        The stories found last time are stars, so only the links since then take several rounds.
        """
        links = [self._table(name, "a long, b long") for name in self.state["links"]]
        if self.state["stories"]:
            links.append(self._table(self.state["stories"], "node long, label long").select(F.col("node").alias("a"), F.col("label").alias("b")))
        name, before = f"stories-{self.state['batches']}", [*self.state["links"], self.state["stories"]]
        if not links:
            return self.spark.createDataFrame([], "node long, label long")
        if self.state["links"]:
            self.work.write(components(functools.reduce(DataFrame.unionByName, links)), name)
            self.state.update(stories=name, links=[])
            self._keep()
            for old in before:
                if old and old != name:
                    self.work.remove(old)
        return self._table(self.state["stories"], "node long, label long")


def _placed(rows: DataFrame, most: int) -> DataFrame:
    """Rows of a comparison (most at most) by block, older ones first. A block of more than SPLIT rows is cut into pieces by key: a piece
    indexes its own part of the block, and every new row of the block is looked up in all pieces, so no pair is lost."""
    large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SPLIT)
    columns = ["block", "pass", "key", "id", "text", "new"]
    if most <= SPLIT or large.isEmpty():
        placed = rows.select(*columns, F.lit(0).alias("piece"), F.lit(True).alias("own"))
    else:
        pieces = F.ceil(F.coalesce("_n", F.lit(1)) / SPLIT).cast("int")
        counted = rows.join(large, "block", "left").withColumns({"_p": pieces, "_own": F.pmod(F.xxhash64("key"), pieces).cast("int")})
        spread = F.when(F.col("new"), F.sequence(F.lit(0), F.col("_p") - 1)).otherwise(F.array("_own"))
        placed = counted.withColumn("piece", F.explode(spread)).select(*columns, "piece", (F.col("piece") == F.col("_own")).alias("own"))
    return placed.repartition("block", "piece").sortWithinPartitions("block", "piece", "new", "id", "key")


_LEXICON: dict[str, Lexicon] = {}


def _shared_lexicon(words) -> Lexicon:
    key, *parts = words.value
    if key not in _LEXICON:
        _LEXICON.clear()
        _LEXICON[key] = Lexicon(*parts)
    return _LEXICON[key]


class Block:
    """Headlines of one block, by the words and numbers that a headline that is the same must share with them."""

    def __init__(self):
        self.ids: list[int] = []
        self.texts: list[tuple] = []
        self.sizes: list[int] = []
        self.parent: list[int] = []
        self.keys: dict[str, int] = {}
        # Postings of words and of names: over all headlines, and per list of numbers.
        self.every: tuple[dict, dict] = defaultdict(list), defaultdict(list)
        self.some: dict[tuple, tuple[dict, dict]] = {}
        self.holding: dict[str, set[tuple]] = defaultdict(set)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, article: int, key: str, text: tuple | None) -> int:
        i = self.keys[key] = len(self.ids)
        self.ids.append(article)
        if text is None:
            return i
        self.texts.append(text)
        self.parent.append(i)
        names, numbers, words = text[:3]
        # Words twice in a headline count more than once, so the words shared say nothing yet.
        self.sizes.append(0 if sum(words.values()) > len(words) else len(words))
        sign = tuple(sorted(numbers.elements()))
        if sign not in self.some:
            self.some[sign] = defaultdict(list), defaultdict(list)
            for d in numbers:
                self.holding[d].add(sign)
        for kept in (self.every, self.some[sign]):
            for w in words:
                kept[0][w].append(i)
            for w in names:
                kept[1][w].append(i)
        return i

    def candidates(self, text: tuple) -> list[int]:
        """Headlines with numbers among this one's or the other way round, and NAMED_SHARE of the fewer words, most shared
        first. A name of one may be a word of the other."""
        names, numbers, words = text[:3]
        if numbers:
            signs = {s for d in numbers for s in self.holding.get(d, ())} | {()}
            found = [self.some[s] for s in signs if s in self.some and ((c := Counter(s)) <= numbers or numbers <= c)]
        else:
            found = [self.every]
        shared: Counter = Counter()
        for in_words, in_names in found:
            for w in words:
                if w in in_words:
                    shared.update(in_words[w])
                if w in in_names:
                    shared.update(in_names[w])
            for w in names:
                if w in in_words and w not in words:
                    shared.update(in_words[w])
        size = 0 if sum(words.values()) > len(words) else len(words)
        return [i for i, n in sorted(shared.items(), key=lambda x: (-x[1], x[0])) if n >= NAMED_SHARE * min(size, self.sizes[i])]


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of the new keys of each piece of a block, whose older keys come first: to equal keys and to headlines that are
    the same.

    Each new headline is compared with every one of its piece that can be the same, until it has met the story of that one.
    New rows whose own piece is another one are only looked up.
    """
    block, have = None, Block()
    for f in frames:
        out = []
        for b, piece, p, key, article, text, new, own in f[["block", "piece", "pass", "key", "id", "text", "new", "own"]].itertuples(index=False):
            if (b, piece) != block:
                block, have = (b, piece), Block()
            at = have.keys.get(key)
            if at is not None:
                if article != have.ids[at]:
                    out.append((article, have.ids[at]))
                if p == "u" or not new or _unpack(text) == have.texts[at]:
                    continue
            mine = None if p == "u" else _unpack(text)
            met = {have.root(at)} if at is not None else set()
            if new and mine:
                for i in have.candidates(mine):
                    if have.root(i) in met or i == at:
                        continue
                    if _same(mine, have.texts[i]):
                        if article != have.ids[i]:
                            out.append((article, have.ids[i]))
                        met.add(have.root(i))
            if at is None and own:
                at = have.add(article, key, mine)
            if at is not None:
                for r in met:
                    have.parent[r] = have.root(at)
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def repeats(articles: DataFrame, labels: list[str], at: str | None = None) -> DataFrame:
    """(kept_id, dup_id): articles of batch 1 and later that repeat a story which an article with a smaller id brought.

    The archive (batch 0) makes the first run; then batch by batch is compared with the runs before it. With `at`, the history
    is kept in that folder. Null or empty addresses and titles match nothing; rows repeated with one id are one article; null
    ids and batches take no part. An empty table gives no rows.
    """
    spark = articles.sparkSession
    work = Workspace(spark, "history", at)
    rows = articles.where("article_id is not null and batch_no is not null").select(F.col("article_id").cast("long").alias("article_id"), "batch_no", "url", "title", "source")
    # One folder per batch, as they would arrive, so that no batch is read for another one.
    arrived = work.write(rows, "arrived", partition_by=["batch_no"])
    numbers = sorted(r[0] for r in arrived.select("batch_no").distinct().collect())
    history = History(work, label_forms(labels))
    for n in numbers:
        history.ingest(arrived.where(F.col("batch_no") == n), f"arrived/batch_no={n}")
    late = arrived.where("batch_no >= 1").select(F.col("article_id").alias("node")).distinct()
    return history.stories().join(late, "node").where("label < node").select(F.col("label").alias("kept_id"), F.col("node").alias("dup_id"))
