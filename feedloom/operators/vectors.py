"""Vectors: unit length, cosine, nearest neighbours, and the similarity anti-join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v / (length + 1e-8)."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + F.lit(1e-8)
    return F.transform(v, lambda x: x.cast("double") / size)


def nearest(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 512, rows: int = 2048, carry: str | None = None) -> DataFrame:
    """(query, neighbour, similarity): the k most similar rows of base of every query, itself left out, ties by key.

    Exact, in blocks: both sides are packed into matrices of bounded size, every pair of blocks is one multiplication
    that keeps k rows per query, and the blocks' winners are merged. Queries are a stated set (a batch, a sample of ids); base
    is read whole. With `carry`, that date column of base comes out as `carried`.
    """
    def pack(df: DataFrame, size: int, name: str) -> DataFrame:
        n = max(1, df.count() // size)
        return df.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(n)).alias(f"{name}_block"), F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), (F.col(carry) if carry and name == "b" else F.lit(None)).cast("date").alias("c")).groupBy(f"{name}_block").agg(
            F.collect_list("i").alias(f"{name}_i"), F.collect_list(F.coalesce(F.unix_date("c"), F.lit(0))).alias(f"{name}_c"), F.flatten(F.collect_list("v")).alias(f"{name}_v"))

    left, right = pack(queries, block, "q"), pack(base, rows, "b")
    n = max(1, queries.count() // block)
    pairs = right.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("q_block", F.col("q_block").cast("long")).join(left, "q_block")

    def best(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                q, b = np.asarray(r.q_i), np.asarray(r.b_i)
                sims = np.asarray(r.q_v).reshape(len(q), -1) @ np.asarray(r.b_v).reshape(len(b), -1).T
                sims[q[:, None] == b[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(b, sims.shape), -np.round(sims, 12)), axis=1)[:, :k]
                keep = np.take_along_axis(sims, order, 1)
                out = pd.DataFrame({"query": np.repeat(q, order.shape[1]), "neighbour": b[order].ravel(), "similarity": keep.ravel(), "c": np.asarray(r.b_c)[order].ravel()})
                yield out[np.isfinite(out.similarity)]

    found = pairs.select("q_i", "q_v", "b_i", "b_v", "b_c").mapInPandas(best, "query long, neighbour long, similarity double, c int")
    ranked = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("similarity", 10)).alias("d"), F.col("neighbour"), F.col("similarity"), F.col("c")))), 1, k).alias("n"))
    extra = [F.date_from_unix_date("x.c").alias("carried")] if carry else []
    return ranked.select("query", F.posexplode("n").alias("place", "x")).select("query", (F.col("place") + 1).alias("place"), "x.neighbour", F.round("x.similarity", 6).alias("similarity"), *extra)


def unlike(new: DataFrame, history: DataFrame, least: float, key: str = "vec_id") -> DataFrame:
    """(query, dropped, neighbour, similarity): whether a new row's nearest row of history is at least so similar."""
    top = nearest(new, history, 1, key)
    rows = new.select(F.col(key).cast("long").alias("query")).join(top, "query", "left")
    return rows.select("query", F.coalesce(F.col("similarity") >= least, F.lit(False)).alias("dropped"), "neighbour", "similarity")


def embedded(df: DataFrame, text: str, size: int = 64, model=None) -> DataFrame:
    """df with `embedding`: unit vectors of a text, batch by batch; model(texts) gives a row of numbers per text.

    The stand-in counts hashed three-letter pieces of the lower-case text. Null texts have no vector.
    """
    from pyspark.sql import types as T

    def counted(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), size))
        for row, t in enumerate(texts):
            edged = f" {t.lower()} "
            for i in range(len(edged) - 2):
                out[row, zlib.crc32(edged[i:i + 3].encode("utf-8", "replace")) % size] += 1
        return out

    ask = model or counted

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        given = texts.notna()
        found = np.asarray(ask(list(texts[given]))) if given.any() else np.zeros((0, size))
        rows = iter(found / (np.linalg.norm(found, axis=1, keepdims=True) + 1e-8))
        return pd.Series([next(rows) if g else None for g in given], dtype="object")

    return df.withColumn("embedding", run(F.col(text)))
