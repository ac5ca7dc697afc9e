"""Percentiles of very large numeric columns from mergeable sketches (problem 3).

A sketch is a ladder of relative-rank compactors. Level h holds values that stand for 2**h values each. A full level
keeps its largest values untouched, sorts the rest and hands every second value to the next level, so the error of a
rank is a fraction of the number of values above it: tight at the upper percentiles. A second, mirrored ladder over the
negated values does the same for the lower ones; it comes into being with the first compaction, since before that the
values themselves are there. Sketches of days, partitions or groups are merged level by level, in any order, within the
same bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values in a section; rank errors stay under error_bound(SECTION) of the values beyond, in nearly all cases.
SECTION = 64
_SECTIONS = 3
_LADDERS = T.ArrayType(T.ArrayType(T.LongType()))
SKETCH_FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()),
    T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("levels", _LADDERS), T.StructField("low_runs", T.ArrayType(T.LongType())), T.StructField("low_levels", _LADDERS),
]
_PARTS = [f.name for f in SKETCH_FIELDS]


def error_bound(section: int = SECTION) -> float:
    """Four standard deviations of the rank error, as a share of the values beyond the rank (above it for shares of one half
    and more, below it for smaller ones). A compaction is off by one weight or not at all, with equal odds by a coin that a
    cryptographic hash draws, so errors of different compactions add like independent ones."""
    return 4 * math.sqrt(0.0512 / _SECTIONS) / section


class Ladder:
    """One ladder of compactors over 64-bit integers, protecting the largest."""

    def __init__(self, section: int = SECTION, runs=None, levels=None):
        self.section = section
        self.levels = [np.asarray(v, np.int64) for v in levels] if levels is not None and len(levels) else [np.empty(0, np.int64)]
        self.runs = [int(r) for r in runs] if runs is not None and len(runs) else [0]

    def _shape(self, level: int) -> tuple[int, float]:
        """Sections and their size at a level: every doubling of its runs halves the error added by a section."""
        sections, size = _SECTIONS, float(self.section)
        while self.runs[level] >= 1 << (sections - 1) and size / math.sqrt(2) >= 4:
            sections, size = sections * 2, size / math.sqrt(2)
        return sections, size

    def room(self, level: int = 0) -> int:
        sections, size = self._shape(level)
        return 2 * sections * round(size)

    def add(self, values: np.ndarray) -> None:
        self.levels[0] = np.concatenate([self.levels[0], values])
        self.compress()

    def merge(self, other: "Ladder") -> None:
        for h, values in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.empty(0, np.int64))
                self.runs.append(0)
            self.levels[h] = np.concatenate([self.levels[h], values])
            self.runs[h] |= other.runs[h]
        self.compress()

    def compress(self) -> None:
        h = 0
        while h < len(self.levels):
            sections, size = self._shape(h)
            if len(self.levels[h]) > self.room(h):
                values = np.sort(self.levels[h])
                trailing = (~self.runs[h] & (self.runs[h] + 1)).bit_length() - 1
                keep = self.room(h) // 2 + (sections - min(trailing + 1, sections)) * round(size)
                cut = (len(values) - keep) & ~1
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0, np.int64))
                    self.runs.append(0)
                # A coin that depends on nothing but what is compacted, so a task that runs again gives the same sketch.
                coin = hashlib.blake2b(values[:cut].tobytes(), digest_size=1, key=f"{h} {self.runs[h]}".encode()).digest()[0] & 1
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[:cut][coin::2]])
                self.levels[h] = values[cut:]
                self.runs[h] += 1
            h += 1

    def compacted(self) -> bool:
        return len(self.levels) > 1

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """(values in order, how many values each reaches up to)."""
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])


class Sketch:
    """Ladders for both tails, the number of values and their extremes. Values wait in a list until a level can be filled."""

    def __init__(self, section: int = SECTION):
        self.section, self.n = section, 0
        self.low, self.high = None, None
        self.upper = Ladder(section)
        self.lower: Ladder | None = None
        self.waiting: list[np.ndarray] = []
        self.count = 0

    def _seen(self, n: int, low: int, high: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)
        self.high = high if self.high is None else max(self.high, high)

    def add(self, values: np.ndarray) -> "Sketch":
        if len(values):
            self._seen(len(values), int(values.min()), int(values.max()))
            self.waiting.append(values)
            self.count += len(values)
            if self.count > 2 * self.upper.room():
                self.settle()
        return self

    def settle(self) -> "Sketch":
        """Put waiting values into the ladders."""
        if self.waiting:
            values = np.concatenate(self.waiting).astype(np.int64)
            self.waiting, self.count = [], 0
            if self.lower is not None:
                self.lower.add(-values)
            elif len(self.upper.levels[0]) + len(values) > self.upper.room():
                self.lower = Ladder(self.section)
                self.lower.add(-np.concatenate([self.upper.levels[0], values]))
            self.upper.add(values)
        return self

    def merge(self, n: int, low, high, runs, levels, low_runs, low_levels) -> "Sketch":
        if n:
            other = Ladder(self.section, runs, levels)
            if not other.compacted():
                return self.add(other.levels[0])
            self.settle()
            self._seen(int(n), int(low), int(high))
            if self.lower is None:
                self.lower = Ladder(self.section)
                self.lower.add(-self.upper.levels[0])
            self.upper.merge(other)
            self.lower.merge(Ladder(self.section, low_runs, low_levels))
        return self

    def row(self) -> tuple:
        self.settle()
        mirrored = ([], []) if self.lower is None else (self.lower.runs, [v.tolist() for v in self.lower.levels])
        return self.n, self.low, self.high, self.upper.runs, [v.tolist() for v in self.upper.levels], *mirrored

    def quantiles(self, shares: list[float]) -> list[int | None]:
        """For each share q the smallest kept value whose estimated rank reaches q * n; null of no values."""
        self.settle()
        if not self.n:
            return [None] * len(shares)
        values, reached = self.upper.ranked()
        mirrored = self.lower.ranked() if self.lower is not None else None
        out = []
        for q in shares:
            rank = max(1, math.ceil(q * self.n))
            if q >= 1 or rank >= self.n:
                out.append(int(self.high))
            elif mirrored is not None and q < 0.5:
                # The value of this rank from below is that of rank n - rank + 1 from above among the negated ones.
                below, upto = mirrored
                out.append(int(-below[min(int(np.searchsorted(upto, self.n - rank + 1)), len(below) - 1)]))
            else:
                out.append(int(values[min(int(np.searchsorted(reached, rank)), len(values) - 1)]))
        return out


def _schema(df: DataFrame, by: list[str], extra: list[T.StructField]) -> T.StructType:
    return T.StructType([*df.select(*by).schema.fields, *extra])


def sketches(df: DataFrame, by: list[str], value: str, section: int = SECTION, spread: int = 16) -> DataFrame:
    """One mergeable sketch per group: (by..., n, low, high, runs, levels).

    Each partition sketches its rows per group first, so only sketches are shuffled and a group that holds most rows is no
    hot spot; the partitions' sketches are merged in two steps, `spread` ways and then at once. Null values are left out;
    groups of nulls only, and empty tables, give no row. Null is a group of its own.
    """
    schema = _schema(df, by, [T.StructField("_part", T.IntegerType()), *SKETCH_FIELDS])
    width = len(by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % spread
        held: dict[tuple, Sketch] = {}
        for batch in batches:
            for group, values in batch.groupby([batch.columns[i] for i in range(width)], dropna=False, sort=False)[batch.columns[width]] if width else [((), batch.iloc[:, 0])]:
                key = tuple(None if pd.isna(k) else k for k in group)
                held.setdefault(key, Sketch(section)).add(values.to_numpy(np.int64))
        rows = [(*key, part, *s.row()) for key, s in held.items()]
        for i in range(0, len(rows), 1000):
            yield pd.DataFrame(rows[i:i + 1000], columns=schema.names)

    first = df.select(*by, F.col(value).cast("long").alias("_value")).where(F.col("_value").isNotNull()).mapInPandas(partial, schema)
    return merged(merged(first, [*by, "_part"], section), by, section)


def merged(parts: DataFrame, by: list[str], section: int = SECTION) -> DataFrame:
    """Merge sketches (of days, partitions, finer groups) to one per group of `by`. Other columns are dropped.

    Sketches arrive sorted by group and are merged one by one, so a task holds one sketch at a time.
    """
    schema = _schema(parts, by, SKETCH_FIELDS)
    width = len(by)

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for f in frames:
            rows = []
            for r in f.itertuples(index=False, name=None):
                k = tuple(None if pd.isna(x) else x for x in r[:width])
                if held is None or k != key:
                    if held is not None:
                        rows.append((*key, *held.row()))
                    key, held = k, Sketch(section)
                held.merge(*r[width:])
            yield pd.DataFrame(rows, columns=schema.names)
        if held is not None:
            yield pd.DataFrame([(*key, *held.row())], columns=schema.names)

    rows = parts.select(*by, *_PARTS)
    placed = rows.repartition(*by).sortWithinPartitions(*by) if by else rows.coalesce(1)
    return placed.mapInPandas(join, schema)


def percentiles(found: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by..., n, share, estimate): one row per sketch and share."""
    wanted = [float(s) for s in shares]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def read(n: pd.Series, high: pd.Series, levels: pd.Series, low_levels: pd.Series) -> pd.Series:
        out = []
        for count, top, ladder, mirrored in zip(n, high, levels, low_levels):
            s = Sketch()
            s.n, s.high, s.upper = int(count), top, Ladder(levels=ladder)
            s.lower = Ladder(levels=mirrored) if mirrored is not None and len(mirrored) else None
            out.append(s.quantiles(wanted))
        return pd.Series(out)

    pairs = F.arrays_zip(F.array(*[F.lit(s) for s in wanted]).alias("share"), read("n", "high", "levels", "low_levels").alias("estimate"))
    return found.select(*by, "n", F.explode(pairs).alias("_p")).select(*by, "n", F.col("_p.share").alias("share"), F.col("_p.estimate").alias("estimate"))


def usage_calls(events: DataFrame, *extra: str) -> DataFrame:
    """One row per call with step and model in one spelling.

    Calls delivered twice are identical rows, so a distinct over the used columns drops the repeats with partial aggregation.
    Blank or null steps are 'other'; blank or null models are ''; a '@branch' after a model is dropped. total_tokens stays
    as it is: zeros, negative and absurd values are values, nulls are left to the sketch, which leaves them out.
    """
    step = F.lower(F.trim(F.coalesce("step", F.lit(""))))
    model = F.split_part(F.lower(F.trim(F.coalesce("model", F.lit("")))), F.lit("@"), F.lit(1))
    return events.select(
        "event_id", *extra, F.when(step == "", "other").otherwise(step).alias("step"), model.alias("model"), "total_tokens"
    ).distinct()


def rank_check(calls: DataFrame, estimates: DataFrame, by: list[str], value: str, section: int = SECTION) -> DataFrame:
    """Whether each estimate's true rank interval meets the bound, a share of the values beyond it: (by..., share, n, within)."""
    wide = estimates.groupBy(*by).agg(F.collect_list(F.struct("share", "estimate")).alias("_e"))
    hit = calls.where(F.col(value).isNotNull()).join(wide, by).select(*by, value, F.explode("_e").alias("_x"))
    counts = hit.groupBy(*by, F.col("_x.share").alias("share")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < F.col("_x.estimate")).alias("_below"), F.count_if(F.col(value) <= F.col("_x.estimate")).alias("_upto"))
    target = F.col("share") * F.col("n")
    slack = F.lit(error_bound(section)) * F.when(F.col("share") < 0.5, target).otherwise(F.col("n") - target) + 1
    return counts.select(*by, "share", "n", ((F.col("_below") - slack <= target) & (F.col("_upto") + slack >= target)).alias("within"))
