"""Texts cut off by field limits or in transfer (problem 4).

Two kinds of evidence are combined. Lengths: per source and field a log-normal length distribution, right-censored at
candidate limits, is fitted by maximum likelihood (EM); it gives each length's posterior probability of being censored
there. Sources are shrunk to their fetch step, so a source with few values has limits of its own as far as its values say
so, and its step's limits otherwise. Endings: how often the last words, or the last characters of scripts without blanks, end a sentence in the whole
corpus, against how often they stand inside one.
"""

from __future__ import annotations

import functools
import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.capping import contributor
from feedloom.runtime import cut

FIELDS = ("original_description", "comment_summary")
#: Weight of the fetch step's distribution and limits in a contributor's own fit, in values.
STEP_WEIGHT = 50.0
#: Log-likelihood ratio by which a length must be more frequent than expected to be a candidate limit; a candidate is
#: searched among all lengths, so the ratio is well above the logarithm of their number.
SURPRISE = 12.0
#: Share of a phrase with a mark among all places of its last words, from which it trails off on purpose.
TRAILING_RATE = 0.2
#: Entries counted in a Python worker before they are handed on.
HELD = 300_000

_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")
_HALF_TAG = re.compile(r"(?:<|&lt;)/?(?:[A-Za-z][^<>&]*)?$")
_HALF_ENTITY = re.compile(r"&(?:#\d{0,6}|#[xX][0-9a-fA-F]{0,5}|[A-Za-z]{0,7})$")
# Names of character entities that feeds use.
ENTITIES = "amp lt gt quot apos nbsp hellip mdash ndash lsquo rsquo ldquo rdquo laquo raquo copy reg trade euro middot bull times deg eacute egrave agrave uuml ouml auml szlig ccedil ntilde".split()
_MARK = re.compile(r"\s*(?:\[(?:…|\.{3})\]|\((?:…|\.{3})\)|…+|\.{3,}|⋯+)\s*$")
_CLOSER = "\"'”’»›」』）)】］]〉》*_"
_STOP = re.compile(r"[.!?。！？।؟][\"'”’»›」』）)】］\]*_]*$")
_LINK_END = re.compile(r"(?:https?://|www\.)\S+$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+|(?<=[。！？])[」』）]*\s*|[\r\n]+")
_WORDISH = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_CJK = re.compile(r"[ぁ-ヿ㐀-鿿々]")
_CJK_RUN = re.compile(r"[ぁ-ヿ㐀-鿿々]+")
_LIST_HEAD = re.compile(r"^\s*(?:\[[^\]]{1,15}\]|[^\W\d_][\w ]{1,20}\s*[:：–-])\s+")


@functools.lru_cache(maxsize=100_000)
def _kind(word: str) -> str:
    """Words by themselves; names and numbers as a class, since single ones are too rare to count."""
    if any(c.isdigit() for c in word):
        return "#"
    if word[0].isupper():
        return "^"
    return word


def ending_key(text: str) -> tuple[str, str]:
    """(key, rarer key) of the end of a text: the last three characters of a script without blanks, else the last word
    with the one before; names count as one word."""
    if _CJK.search(text[-1:]):
        run = _CJK_RUN.search(text[-12:][::-1])[0][::-1]
        return f"c{run[-3:]}", f"c{run[-2:]}"
    reach, words = 120, []
    while len(words := _WORDISH.findall(text[-reach:])) < 3 and reach < len(text):  # the first may be cut by the reach
        reach *= 4
    if not words:
        return "", ""
    last = words[-1]
    before = _kind(words[-2]) if len(words) > 1 else "|"
    return f"b{before} {_kind(last)}", f"w{_kind(last)}"


def _counted(text: str) -> tuple[list[str], list[str]]:
    """(keys of every place, keys of the places that end a sentence) in the complete sentences of a text: those with a stop."""
    inside: list[str] = []
    ends: list[str] = []
    for sentence in _SENTENCE.split(html.unescape(_TAGS.sub(" ", text))):
        sentence = sentence.strip()
        ended = bool(_STOP.search(sentence)) and not _MARK.search(sentence)
        words = _WORDISH.findall(sentence.rstrip(" .!?。！？" + _CLOSER) if ended else sentence)
        if not words:
            continue
        last = words[-1]
        before = "|"
        for w in words[:-1]:
            kind = _kind(w)
            if w.isascii() or not _CJK.search(w):
                inside += (f"b{before} {kind}", f"w{kind}")
            else:
                for run in _CJK_RUN.findall(w):
                    inside += [f"c{run[max(0, j - 3):j]}" for j in range(1, len(run) + 1)]
                    inside += [f"c{run[j - 2:j]}" for j in range(2, len(run) + 1)]
            before = kind
        if not ended:
            continue
        if last.isascii() or not _CJK.search(last):
            final = [f"b{before} {_kind(last)}", f"w{_kind(last)}"]
        else:
            final = []
            for m in _CJK_RUN.finditer(last):
                run = m[0]
                inside += [f"c{run[max(0, j - 3):j]}" for j in range(1, len(run))]
                inside += [f"c{run[j - 2:j]}" for j in range(2, len(run))]
                if m.end() == len(last):
                    final = [f"c{run[-3:]}", *([f"c{run[-2:]}"] if len(run) > 1 else [])]
        inside += final
        ends += final
    return inside, ends


def _is_list(sentence: str, alone: bool) -> bool:
    """A list of tags or links: two or more short items with one separator."""
    body = _LIST_HEAD.sub("", sentence)
    if re.fullmatch(r"(?:#[\w-]+\s*)+", body):
        return True
    for mark in (" | ", "; ", " / ", ", ", "、", " · "):
        items = body.split(mark)
        if len(items) >= 2 and all(0 < len(i.split()) <= 2 and len(i) <= 30 for i in items) and (len(items) >= 3 or body != sentence or mark != ", " and alone or alone and not any(" " in i for i in items)):
            return True
    return False


def look(text: str) -> tuple[str, str, str, str, bool]:
    """(verdict, key, rarer key, phrase, prose) of the end of a text.

    Verdicts: cut (inside a character, an entity, a tag, or a bracket), whole (a stop, a sign, a list), link, marked (with a
    mark of omission), open. phrase is the last sentence of a marked text; prose says that earlier sentences have stops.
    """
    trimmed = text.rstrip()
    if trimmed.endswith("�"):
        return "cut", "", "", "", True
    m = _HALF_ENTITY.search(trimmed)
    if m and any(e.startswith(m[0][1:]) for e in ENTITIES) or m and m[0].startswith("&#"):
        return "cut", "", "", "", True
    m = _HALF_TAG.search(trimmed)
    if m and trimmed[m.start():].count(" ") < 4 and (m[0][1:2].isalpha() or m[0] in ("<", "&lt;", "</", "&lt;/") or m[0].startswith(("&lt;", "</"))):
        return "cut", "", "", "", True
    clean = html.unescape(_TAGS.sub("", trimmed)).rstrip()
    mark = _MARK.search(clean)
    body = clean[:mark.start()].rstrip() if mark else clean
    if not body:
        return "whole", "", "", "", False
    parts = [p for p in _SENTENCE.split(body) if p.strip()]
    last = parts[-1].strip() if parts else body
    prose = len(parts) > 1
    if mark:
        key, rarer = ending_key(body) if body[-1].isalnum() else ("", "")
        return ("marked" if not _STOP.search(body) else "markedstop"), key, rarer, last, prose
    if _STOP.search(body):
        return "whole", "", "", "", prose
    if _LINK_END.search(body):
        return "link", "", "", "", prose
    opened = max(last.rfind("("), last.rfind("（"))
    if opened >= 0 and not re.search(r"[)）]", last[opened:]) and len(last) - opened < 60:
        return "cut", "", "", "", prose
    if prose and body[-1] in "%$€£¥°#@" or body[-1] in ",;:，、；：([（「『“„—–/&+=" or body[-1] in "-" and len(body) > 1 and body[-2].isalnum():
        return "broken", "", "", "", prose
    if not body[-1].isalnum() and not _CJK.search(body[-1]):
        return "whole", "", "", "", prose  # a closing bracket, an emoji, another sign
    key, rarer = ending_key(body)
    return ("list" if _is_list(last, not prose) else "open"), key, rarer, "", prose


def values(articles: DataFrame) -> DataFrame:
    """(article_id, field_name, source, step, text) of every non-empty value; null and blank values are no values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in FIELDS])
    return articles.select("article_id", contributor(F.col("source")).alias("source"), F.coalesce("source_key", F.lit("")).alias("step"), F.explode(pairs).alias("v")).select(
        "article_id", "v.field_name", "source", "step", F.col("v.text").alias("text")).where(F.trim("text") != "")


def endings(texts: DataFrame) -> DataFrame:
    """(key, inside, ends): how often each ending stands anywhere and how often it ends a sentence, over all texts."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inside, ends = Counter(), Counter()
        for f in frames:
            for t, title in zip(f["text"], f["title"]):
                every, final = _counted(t + "." if title and not _STOP.search(t.rstrip()) and not _MARK.search(t) else t)
                inside.update(every)
                ends.update(final)
            if len(inside) > HELD:
                yield pd.DataFrame({"key": list(inside), "inside": list(inside.values()), "ends": [ends[k] for k in inside]})
                inside, ends = Counter(), Counter()
        yield pd.DataFrame({"key": list(inside), "inside": list(inside.values()), "ends": [ends[k] for k in inside]}).astype({"key": "object"})

    return texts.select("text", "title").mapInPandas(count, "key string, inside long, ends long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("ends").alias("ends"))


def _normal_tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


class Lengths:
    """A log-normal length distribution, right-censored at candidate limits: mu, sigma, each limit's weight (the share of
    longer values that are cut there) and the posterior that a value of the limit's length was cut."""

    def __init__(self, mu: float, sigma: float, weight: dict[int, float], posterior: dict[int, float]):
        self.mu, self.sigma, self.weight, self.posterior = mu, sigma, weight, posterior

    def at(self, size: float) -> tuple[float, float, float, float]:
        """(z, density, tail, mean logarithm of the longer ones) at a length."""
        z = (math.log(size) - self.mu) / self.sigma
        tail = max(_normal_tail(z), 1e-9)
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
        return z, math.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * self.sigma * size), tail, hazard


def _surprise(n: float, expected: float) -> float:
    return n * math.log(n / expected) - n + expected if n > expected else 0.0


def censoring(lengths: np.ndarray, counts: np.ndarray, step: Lengths | None = None, rounds: int = 40) -> Lengths:
    """The censored log-normal of a length histogram, shrunk to that of the fetch step, if given, with STEP_WEIGHT values.

    Candidates are lengths far more frequent than their neighbourhood and the distribution say, and the step's limits. EM: a
    value at a candidate is censored there with the posterior of its limit's weight and the tail beyond against the density
    at it; censored values count with their expected logarithm and its square.
    """
    total = counts.sum()
    by = dict(zip(lengths.tolist(), counts.tolist()))
    logs = np.log(lengths)
    prior = STEP_WEIGHT if step else 0.0
    mu0, var0 = (step.mu, step.sigma ** 2) if step else (0.0, 0.0)
    mu = float(((logs * counts).sum() + prior * mu0) / (total + prior))
    spread = ((logs - mu) ** 2 * counts).sum() + prior * (var0 + (mu0 - mu) ** 2)
    fitted = Lengths(mu, max(0.1, math.sqrt(spread / (total + prior))), {}, {})
    usual = step or fitted
    for c, n in by.items():
        around = [by.get(c + d, 0) for d in range(-12, 13) if d and not by.get(c + d, 0) > 3 * max(1, n)]
        near = (sum(sorted(around)[:-2]) if len(around) > 2 else 0) / max(1, len(around) - 2)
        if c >= 20 and n > 1 and n > 5 * near and _surprise(n, max(near, total * usual.at(c)[1], 1e-3)) > SURPRISE:
            fitted.weight[c] = n / total
    for c, w in step.weight.items() if step else ():
        fitted.weight.setdefault(c, w)
    fitted.posterior = dict.fromkeys(fitted.weight, 0.9)
    for _ in range(rounds if fitted.weight else 0):
        first = second = mass = 0.0
        kept = counts.astype(float).copy()
        for c, w in list(fitted.weight.items()):
            z, density, tail, hazard = fitted.at(c)
            fitted.posterior[c] = w * tail / (w * tail + density)
            hit = by.get(c, 0) * fitted.posterior[c]
            known = prior * step.weight.get(c, 0.0) if step else 0.0
            fitted.weight[c] = max(1e-6, min(1.0, (hit / tail + known) / (total + prior)))
            if hit:
                kept[lengths == c] -= hit
                mean = fitted.mu + fitted.sigma * hazard
                first += hit * mean
                second += hit * (fitted.sigma ** 2 * (1 + z * hazard - hazard ** 2) + mean ** 2)
                mass += hit
        all_mass = kept.sum() + mass + prior
        fitted.mu = float(((logs * kept).sum() + first + prior * mu0) / all_mass)
        fitted.sigma = max(0.1, math.sqrt(max(1e-4, ((logs ** 2 * kept).sum() + second + prior * (var0 + mu0 ** 2)) / all_mass - fitted.mu ** 2)))
    return fitted


def limits(measured: DataFrame) -> DataFrame:
    """(field_name, step, source, chars, bytes): each contributor's limits, as maps from length to posterior.

    Fitted on histograms of distinct texts: copies of one text say nothing about a limit. First per fetch step, then per
    contributor of a step, shrunk to it. A group is a histogram, so its size is the number of different lengths.
    """
    sizes = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size"))))
    texts = measured.groupBy("field_name", "step", "source", "mark", "chars", "bytes").agg(F.lit(1).alias("_1"))
    hist = cut(texts.select("field_name", "step", "source", sizes.alias("s")).groupBy("field_name", "s.unit", "step", "source", "s.size").agg(F.count(F.lit(1)).alias("n")))
    whole = hist.groupBy("field_name", "unit", "step", "size").agg(F.sum("n").alias("n"))

    def of_step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = censoring(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
        return pd.DataFrame([(*key, f.mu, f.sigma, list(f.weight), list(f.weight.values()))], columns=["field_name", "unit", "step", "mu", "sigma", "at", "weight"])

    steps = cut(whole.groupBy("field_name", "unit", "step").applyInPandas(of_step, "field_name string, unit string, step string, mu double, sigma double, at array<long>, weight array<double>"))

    def of_source(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        step = Lengths(r["mu"], r["sigma"], dict(zip(map(int, r["at"]), map(float, r["weight"]))), {})
        f = censoring(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), step)
        return pd.DataFrame([(*key, c, p) for c, p in f.posterior.items()], columns=["field_name", "unit", "step", "source", "size", "censored"])

    found = hist.join(steps, ["field_name", "unit", "step"]).groupBy("field_name", "unit", "step", "source").applyInPandas(
        of_source, "field_name string, unit string, step string, source string, size long, censored double")
    entries = lambda unit: F.map_from_entries(F.collect_list(F.when(F.col("unit") == unit, F.struct("size", "censored")))).alias(f"_{unit}")
    return found.groupBy("field_name", "step", "source").agg(entries("chars"), entries("bytes"))


def judge(articles: DataFrame) -> DataFrame:
    """(article_id, field_name, source, verdict, censored, p_cut) of every value; see found() for the rule.

    Every value is judged, once per row of the input. Counts and fits run over all values.
    """
    every = values(articles)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen = [look(t) for t in f["text"]]
            out = f[["article_id", "field_name", "source", "step"]].copy()
            for i, name in enumerate(("verdict", "key", "rarer", "phrase", "prose")):
                out[name] = [s[i] or None if name in ("key", "rarer", "phrase") else s[i] for s in seen]
            out["chars"] = [len(t) for t in f["text"]]
            raw = [t.encode("utf-8", "replace") for t in f["text"]]
            out["bytes"] = [len(r) for r in raw]
            out["mark"] = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "big", signed=True) for r in raw]
            yield out

    measured = cut(every.mapInPandas(measure, "article_id long, field_name string, source string, step string, verdict string, key string, rarer string, phrase string, prose boolean, chars long, bytes long, mark long"))
    caps = cut(limits(measured))
    titles = articles.where("title <> ''").select(F.col("title").alias("text"), F.lit(True).alias("title"))
    counted = cut(endings(every.select("text", F.lit(False).alias("title")).unionByName(titles)))
    posterior = lambda unit: F.coalesce(F.try_element_at(F.col(f"_{unit}"), F.col(unit)), F.lit(0.0))
    # A mark of omission may take a few characters of a limit.
    below = lambda unit: F.exists(F.map_entries(f"_{unit}"), lambda e: (e["value"] > 0.5) & F.col(unit).between(e["key"] - 4, e["key"]))
    at = measured.drop("mark").join(caps, ["field_name", "step", "source"], "left").withColumns({
        "censored": F.greatest(posterior("chars"), posterior("bytes")), "under": F.coalesce(below("chars") | below("bytes"), F.lit(False))}).drop("_chars", "_bytes")
    at = cut(at)
    # Phrases that trail off on purpose come back at several lengths that lie under no limit.
    said = at.where("verdict = 'marked' and not under and phrase is not null").groupBy("phrase").agg(F.count_distinct("chars").alias("_lengths"), F.count(F.lit(1)).alias("_said"))
    totals = counted.where("key like 'w%' or key like 'c__'").agg(F.sum("inside").alias("i"), F.sum("ends").alias("e")).first()
    base = math.log(max(1, totals.e or 1) / max(2, totals.i or 2))
    # Most values end in a sign that decides and have no key to look up: they take no part in the joins.
    open_ended = at.where("key is not null or phrase is not null")
    for name in ("key", "rarer"):
        open_ended = open_ended.join(counted.select(F.col("key").alias(name), F.col("inside").alias(f"_{name}_in"), F.col("ends").alias(f"_{name}_ends")), name, "left")
    open_ended = open_ended.join(said, "phrase", "left")
    at = open_ended.unionByName(at.where("key is null and phrase is null"), allowMissingColumns=True)
    known = lambda n: F.coalesce(F.col(n), F.lit(0))
    pair = (F.col("_key_in") >= 8) & ~F.col("key").endswith("^") | F.col("key").endswith("^") & (F.col("_key_in") >= 3)
    inside = F.when(pair, known("_key_in")).otherwise(known("_rarer_in"))
    ends = F.when(pair, known("_key_ends")).otherwise(known("_rarer_ends"))
    unseen = known("_rarer_in") < 2
    ending = F.when(F.col("key").isNull(), F.lit(0.0)).when(unseen & F.col("key").startswith("b"), F.lit(3.0)).when(unseen, F.lit(1.0)).otherwise(
        F.log((inside + 0.5) / (ends + F.lit(0.15))) + F.lit(base))
    length = F.log((F.col("censored") + 0.02) / (1 - F.col("censored") + 0.02))
    prior = F.when(F.col("prose"), F.lit(2.5)).otherwise(F.lit(-0.5))
    # Against how often the words at its end stand inside sentences: a fragment is said there far more often than with a mark.
    trailing = (F.col("_lengths") >= 2) & (F.col("_said") >= TRAILING_RATE * (F.col("_said") + known("_key_in")))
    odds = (
        F.when(F.col("verdict") == "cut", F.lit(6.0)).when(F.col("verdict") == "whole", F.lit(-6.0)).when(F.col("verdict") == "broken", F.lit(2.5) + length * 0.5 + 1.9)
        .when(F.col("verdict") == "link", length).when(F.col("verdict") == "list", F.when(unseen & F.col("key").startswith("b"), F.lit(2.0)).otherwise(F.lit(-2.5)))
        .when(F.col("verdict") == "markedstop", length)
        .when(F.col("verdict") == "marked", F.when((F.col("censored") > 0.5) | F.col("under"), F.lit(4.0)).when(F.coalesce(trailing, F.lit(False)), F.lit(-4.0)).otherwise(F.lit(0.5) + ending))
        .otherwise(prior + ending + F.greatest(length, F.lit(-1.5)) + F.lit(1.0)))
    return at.select("article_id", "field_name", "source", "step", "verdict", "chars", "censored", F.round(1 / (1 + F.exp(-odds)), 4).alias("p_cut"), "key", F.col("_key_in"), F.col("_key_ends"), "_rarer_in", "_rarer_ends")


def found(judged: DataFrame) -> DataFrame:
    """(article_id, field_name) of values that were cut off: posterior above one half."""
    return judged.where("p_cut > 0.5").select("article_id", "field_name")


def rates(judged: DataFrame) -> DataFrame:
    """(source, field_name, n, n_cut, share_cut): how often each source's values are cut off."""
    return judged.groupBy("source", "field_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_cut") > 0.5).alias("n_cut")).withColumn("share_cut", F.round(F.col("n_cut") / F.col("n"), 6))
