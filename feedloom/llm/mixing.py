"""Mixing sources to target weights (problem 8).

Sizes are tokens of a public tokenizer. Each source gets whole copies of all its documents as far as its part of the
total allows, and the rest by Pareto order sampling: documents have inclusion probabilities in proportion to their size,
those that would exceed one are taken for certain and the others' probabilities solved anew; the others are ranked by
their random odds u / (1 - u) divided by the odds of their inclusion, and the sample is the first of that order whose
size is the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.bpe import BYTE_BPE_50K, token_counts
from feedloom.operators.ranking import running
from feedloom.runtime import cut, derived

BY = ["mix_name", "source"]


def sizes(documents: DataFrame, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, source, n_tokens), counted once per files and kept; documents without tokens or source take no part in any mix."""
    rows = documents.where(F.col("source").isNotNull() & (F.col("text") != ""))
    return derived("sizes", lambda: token_counts(rows, ["doc_id", "source"], vocabulary=vocabulary).where("n_tokens > 0"), documents, vocabulary=vocabulary)


def plan(targets: DataFrame, available: DataFrame, total: int | None = None) -> DataFrame:
    """Per mix and source: how many tokens to take, as whole copies of everything and as a sampled rest.

    Without `total`, a mix is as large as it can be with every source that has documents at its share exactly:
    the least of max_repeats * size / share. With `total`, a source gives what it may, at most max_repeats times its size.
    Shares of sources without documents are spread over the others in proportion, since nothing can reach them.
    """
    has = targets.join(available, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    live = has.where("available > 0 and target_share > 0 and max_repeats > 0").groupBy("mix_name").agg(
        F.sum("target_share").alias("_live"), F.min(F.col("max_repeats") * F.col("available") / F.col("target_share")).alias("_most"))
    sized = has.join(live, "mix_name", "left").withColumn(
        "mix_tokens", F.lit(total).cast("double") if total is not None else F.col("_most") * F.col("_live"))
    want = F.least(F.col("target_share") / F.col("_live") * F.col("mix_tokens"), F.col("max_repeats") * F.col("available"))
    out = sized.withColumn("wanted", F.when((F.col("available") > 0) & F.col("_live").isNotNull(), want).otherwise(0.0))
    whole = F.when(F.col("available") > 0, F.floor(F.col("wanted") / F.greatest(F.col("available"), F.lit(1)) + 1e-9)).otherwise(0).cast("int")
    return out.withColumn("whole_copies", whole).withColumn("rest", F.greatest(F.col("wanted") - F.col("whole_copies") * F.col("available"), F.lit(0.0))).drop("_live", "_most")


def inclusion(docs: DataFrame, used: DataFrame) -> DataFrame:
    """(mix_name, source, certain_from, factor): documents of a size from certain_from on are in the sample for certain, the
    others with probability factor * size, so that the expected size of the sample is the rest.

    Documents larger than the rest can't be part of it and are out of the frame. With the k largest documents certain, the
    others' factor is the rest left over, divided by the sum of their squared sizes; k is the least for which no probability
    reaches one. All k are tried at once along the sorted distinct sizes of a source, which are as many as sizes differ.
    """
    by_size = docs.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("_c")).join(used.where("rest > 0"), "source").where("n_tokens <= rest")
    down = Window.partitionBy(*BY).orderBy(F.desc("n_tokens"))
    larger = down.rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("_c") * F.col("n_tokens").cast("double") * F.col("n_tokens")
    tried = by_size.withColumns({
        "_left": F.col("rest") - F.coalesce(F.sum(F.col("_c") * F.col("n_tokens")).over(larger), F.lit(0)), "_squares": F.sum(square).over(Window.partitionBy(*BY)) - F.coalesce(F.sum(square).over(larger), F.lit(0.0))})
    good = tried.where("_left <= 0 or _left * n_tokens < _squares")
    first = good.groupBy(*BY).agg(F.max_by(F.struct("n_tokens", "_left", "_squares"), "n_tokens").alias("_g"))
    return used.where("rest > 0").select(*BY).join(first, BY, "left").select(
        *BY, F.coalesce(F.col("_g.n_tokens") + 1, F.lit(0)).alias("certain_from"), F.coalesce(F.greatest(F.col("_g._left"), F.lit(0.0)) / F.col("_g._squares"), F.lit(0.0)).alias("factor"))


def pareto_order(size: Column, certain_from: Column, factor: Column, draw: Column) -> Column:
    """The rank's key: below 0 for certain documents, else the odds of the draw divided by the odds of inclusion."""
    p = F.least(factor * size, F.lit(1 - 1e-12))
    return F.when(size >= certain_from, F.lit(-1.0)).otherwise(draw / (1 - draw) / F.greatest(p / (1 - p), F.lit(1e-300)))


def select(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, vocabulary: str = BYTE_BPE_50K, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (mix_name, doc_id, source, n_tokens, copies) and the report of shares.

    Draws are a hash of document, mix and seed, so a rerun selects the same. The sample of a source is the part of its order
    whose size comes nearest to the rest, so no source is further off than half a document. counts (doc_id, source, n_tokens)
    may be given where they are known. Duplicate doc_ids are separate documents; null texts and sources take no part; null
    shares and repeats count as 0; an empty table of documents or targets gives an empty selection.
    """
    docs = counts if counts is not None else sizes(documents, vocabulary)
    available = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    clean = targets.select("mix_name", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    budget = cut(plan(clean, available, total))
    used = budget.where("wanted > 0").select(*BY, "max_repeats", "whole_copies", "rest")
    frame = used.join(inclusion(docs, used), BY, "left")
    rows = docs.join(frame, "source")
    u = (F.pmod(F.xxhash64("doc_id", "mix_name", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    open_to = (F.col("n_tokens") <= F.col("rest")) & (F.col("whole_copies") < F.col("max_repeats"))
    ranked = running(rows.where(open_to), BY, [pareto_order(F.col("n_tokens"), F.col("certain_from"), F.col("factor"), u), F.col("doc_id")], weight=F.col("n_tokens"))
    sampled = F.when(F.col("_before") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    pick = lambda part, copies: part.select("mix_name", "doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")
    chosen = cut(pick(rows.where(~open_to), F.col("whole_copies")).unionByName(pick(ranked, F.col("whole_copies") + sampled)))
    taken = chosen.groupBy(*BY).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    sums = taken.groupBy("mix_name").agg(F.sum("tokens").alias("_all"))
    report = budget.select(*BY, "target_share", "max_repeats", "available", "wanted").join(taken, BY, "left").join(sums, "mix_name", "left").select(
        *BY, "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.round("wanted", 1).alias("wanted_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"))
    return chosen, report


def within_bounds(documents: DataFrame, targets: DataFrame, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(mix_name, source, target_share, has_documents, size_ok, repeats_ok): whether each source gives what it should to within
    half of its largest document, and no document is used too often."""
    docs = sizes(documents, vocabulary)
    _, report = select(documents, targets, vocabulary=vocabulary, counts=docs)
    largest = docs.groupBy("source").agg(F.max("n_tokens").alias("_l"))
    return report.join(largest, "source", "left").select(
        *BY, "target_share", (F.col("available_tokens") > 0).alias("has_documents"), (F.abs(F.col("tokens") - F.col("wanted_tokens")) <= F.coalesce(F.col("_l"), F.lit(0)) / 2 + 0.1).alias("size_ok"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_ok"))
