"""Replies of the judging model as typed rows, report gates, and what follows from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scalars as S
from feedloom.operators import reports as R
from feedloom.operators.joins import matched_titles

# Dimensions of quality, and violation codes that concern the content.
DIMENSIONS = ["relevance", "completeness", "faithfulness"]
CONTENT_CODES = ["leftover_token", "unlinked_articles"]


def flattened(nested: DataFrame, column: str = "articles") -> DataFrame:
    """(source, category, ord, article): VARIANT articles that are a list, or a map of lists; other shapes give no row."""
    v = F.try_parse_json(column)
    kind = F.schema_of_variant(v)
    listed = nested.withColumn("_v", v).where(kind.startswith("ARRAY")).select("source", F.lit("").alias("category"), F.from_json(column, "array<string>").alias("_a"))
    mapped = nested.withColumn("_v", v).where(kind.startswith("OBJECT")).select("source", F.explode(F.from_json(column, "map<string,string>")).alias("category", "_t")).select(
        "source", "category", F.from_json("_t", "array<string>").alias("_a"))
    return listed.unionByName(mapped).select("source", "category", F.posexplode("_a").alias("ord", "article")).where(F.trim("article").startswith("{"))


def quality_view(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Score per dimension (null unless a number), missed_urls at the top or nested, overall 0.0 where absent (true counts 1)."""
    v = F.try_parse_json(reply)
    dims = {d: S.number_or_null(F.coalesce(F.try_variant_get(v, f"$.{d}.score", "variant"), F.try_variant_get(v, f"$.{d}", "variant"))) for d in DIMENSIONS}
    urls = lambda path: F.filter(F.try_variant_get(v, path, "array<string>"), lambda u: u.isNotNull())
    full = lambda c: F.when(F.size(c) > 0, c)
    return replies.withColumns({
        **dims, "missed_urls": F.coalesce(full(urls("$.missed_urls")), full(urls("$.completeness.missed_urls")), F.array().cast("array<string>")),
        "overall": F.coalesce(F.try_variant_get(v, "$.overall", "double"), F.lit(0.0))})


def overall_mean() -> Column:
    """Mean of the dimensions that have a score, one digit; 0.0 of none."""
    kept = F.array_compact(F.array(*DIMENSIONS))
    return F.when(F.size(kept) > 0, F.bround(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept), 1)).otherwise(0.0)


def needs_reconcile(completeness: Column, digests: Column, forced: Column) -> Column:
    return F.coalesce(completeness < 3, F.lit(False)) & ~forced & (digests > 0)


def quality_reason(alert: Column, reason: Column) -> Column:
    return F.when(F.coalesce(alert, F.lit(False)), F.coalesce(reason, F.lit(""))).otherwise("")


def allowed_tags(text: Column, strict: bool = False) -> Column:
    """Tags other than b, i, u, s, a, code and pre are taken out; `<br/>` only with strict."""
    tail = r"(?:\s[^>]*|/)?>" if strict else r"(?:\s[^>]*)?>"
    return F.regexp_replace(text, r"(?i)</?(?!(?:b|i|u|s|a|code|pre)(?![\w-]))\w[\w-]*" + tail, "")


def unfenced(text: Column) -> Column:
    """A leading code fence with its language and trailing backticks off."""
    return S.strip(F.regexp_replace(F.regexp_replace(text, r"^\s*```\w*\s*\n?", ""), r"\s*`+\s*$", ""))


def archive_path(day: Column) -> Column:
    return F.concat(F.lit("archive/"), F.substring(day, 1, 7), F.lit("/"), day, F.lit(".html"))


def title_index(enriched: DataFrame, digests: DataFrame) -> DataFrame:
    """(title, url) of enriched titles, their originals, and digests, with valid addresses."""
    a = enriched.select("title", "url").unionByName(enriched.select(F.col("original_title").alias("title"), "url")).unionByName(digests.select("title", "url"))
    return a.where(S.is_valid_url(F.col("url")) & (F.coalesce("title", F.lit("")) != ""))


def relinked(lines: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, line): unlinked rows of lists, and of tables by their first cell, get the one address their title matches;
    ambiguous and other rows stay."""
    listed, cell = rf"(?U)^(\s*(?:\d+\.|[-*•])\s+)(.+?)(\s*{R.POPULAR.removeprefix('(?U)')})", r"^(\s*\|\s*)([^|]+?)(\s*\|)"
    line = F.col("line")
    is_list = line.rlike(listed)
    lead = F.when(is_list, F.regexp_extract("line", listed, 1)).otherwise(F.regexp_extract("line", cell, 1))
    title = F.when(is_list, S.strip(F.regexp_extract("line", listed, 2))).otherwise(S.strip(F.regexp_replace(F.regexp_extract("line", cell, 2), R.POPULAR, "")))
    # An address comes back with the place of its line: lead and title are read from the line again, not joined.
    rows = lines.where(R.is_unlinked_row(line) & (is_list | line.rlike(cell))).select(F.struct(F.col(key), F.col("pos")).alias("line_id"), title.alias("title")).where("title <> ''")
    fixes = matched_titles(rows, index).where("url is not null").select(f"line_id.{key}", "line_id.pos", "url")
    found = lines.join(fixes.hint("merge"), [key, "pos"], "left").withColumns({"_title": F.when(F.col("url").isNotNull(), title), "_lead": F.when(F.col("url").isNotNull(), F.length(lead))})
    at = F.expr("locate(_title, line, _lead + 1)")
    linked = F.concat(F.expr("substring(line, 1, locate(_title, line, _lead + 1) - 1)"), F.lit("["), F.col("_title"), F.lit("]("), F.col("url"), F.lit(")"), F.expr("substring(line, locate(_title, line, _lead + 1) + length(_title))"))
    return found.select(key, "pos", F.when(at > 0, linked).otherwise(line).alias("line"))


def gate(violations: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, decision): block for any violation of content, ledger_only for others."""
    return violations.groupBy(key).agg(F.when(F.bool_or(F.col("code").isin(CONTENT_CODES)), "block").otherwise("ledger_only").alias("decision"))


def checked(lines: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, decision) of every report after relinking: allow, ledger_only or block."""
    decided = gate(R.check_report(relinked(lines, index, key), key), key)
    return lines.select(key).distinct().join(decided, key, "left").select(key, F.coalesce("decision", F.lit("allow")).alias("decision"))


def stale(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(step): steps whose file is older than the newest of the files they are made from; files (step, mtime), edges (source, step)."""
    newest = edges.join(files.select(F.col("step").alias("source"), F.col("mtime").alias("_m")), "source").groupBy("step").agg(F.max("_m").alias("_m"))
    return files.join(newest, "step").where(F.col("mtime") < F.col("_m")).select("step")


def day_violations(runs: DataFrame, usage: DataFrame, lines: DataFrame, steps: list[str], day: str = "run_date") -> DataFrame:
    """(day, code, count, sample) of all checks of a day: steps that called a model without a token counted, and the report's
    own. lines has the day, pos and line of each report."""
    empty = R.ledger_check(runs, usage, steps).select(F.col("run_date").alias(day), F.lit("zero_tokens").alias("code"))
    ran = runs.where(F.col("step").isin(steps) & (F.col("status") == "ran")).groupBy(F.col("run_date").alias(day)).agg(F.array_sort(F.collect_set("step")).alias("_s"))
    ledger = empty.join(ran, day).select(day, "code", F.lit(1).cast("long").alias("count"), F.array_join("_s", ", ").alias("sample"))
    return ledger.unionByName(R.check_report(lines, day))


def message(text: Column, most: int = 4096) -> Column:
    """A text as it may be sent: only tags the messenger knows, and no longer than it takes."""
    from feedloom.functions.texts import truncated_to

    return truncated_to(most)(allowed_tags(text))


def delivered(messages: DataFrame, send) -> DataFrame:
    """(run_date, message_id, ok, error) of messages sent by send(text) -> bool; an exception is an error, not the end of the
    others. Write the result: what is in it with ok is left out next time by undelivered()."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for day, name, text in f.itertuples(index=False):
                try:
                    rows.append((day, name, bool(send(text)), None))
                except Exception as problem:
                    rows.append((day, name, False, str(problem)[:300]))
            yield pd.DataFrame(rows, columns=["run_date", "message_id", "ok", "error"])

    return messages.select("run_date", "message_id", "text").mapInPandas(run, "run_date string, message_id string, ok boolean, error string")


def undelivered(messages: DataFrame, delivered: DataFrame) -> DataFrame:
    """Messages (run_date, message_id, text) not yet recorded as delivered, so a rerun sends the rest only."""
    return messages.join(delivered.select("run_date", "message_id").distinct(), ["run_date", "message_id"], "left_anti")


def new_absences(gaps: DataFrame, notified: DataFrame) -> DataFrame:
    """The last missing day per entity, unless it was notified before."""
    last = gaps.groupBy("edition").agg(F.max("day").alias("day"))
    return last.join(notified.select("edition", "day").distinct(), ["edition", "day"], "left_anti")


def sparkline(series: DataFrame, key: str, width: float = 240.0, height: float = 40.0, pad: float = 4.0, top: float = 5.0) -> DataFrame:
    """(key, points): 'x,y' per value in order inside a padded box: x evenly spaced, a single value in the middle; y of a
    value clamped to 0..top, high values above."""
    w = Window.partitionBy(key).orderBy("day")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    x = F.when(n > 1, (F.row_number().over(w) - 1) / (n - 1) * (width - 2 * pad)).otherwise((width - 2 * pad) / 2)
    y = (height - 2 * pad) * (1 - F.greatest(F.lit(0.0), F.least(F.lit(top), F.col("overall"))) / top)
    points = series.select(key, "day", F.concat(S.fixed_text(x + pad), F.lit(","), S.fixed_text(y + pad)).alias("p"))
    return points.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "p"))), lambda s: s["p"]), " ").alias("points"))


def judged(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The judge's reply rebuilt from what is allowed: per dimension of `scores` its score and reasoning (raw JSON; null
    where the dimension is no object), missed_urls of strings only; whatever else the model says of itself is dropped."""
    v = F.try_parse_json(reply)
    part = lambda path, kind: F.try_variant_get(v, path, kind)
    out = {}
    for d in DIMENSIONS:
        one = part(f"$.scores.{d}", "variant")
        is_object = F.schema_of_variant(one).startswith("OBJECT")
        out[d] = F.when(is_object, F.struct(F.to_json(part(f"$.scores.{d}.score", "variant")).alias("score"), F.to_json(part(f"$.scores.{d}.reasoning", "variant")).alias("reasoning")))
    listed = F.coalesce(F.when(F.schema_of_variant(part("$.missed_urls", "variant")).startswith("ARRAY"), part("$.missed_urls", "array<variant>")), F.array().cast("array<variant>"))
    texts = F.transform(F.filter(listed, lambda u: F.schema_of_variant(u) == "STRING"), lambda u: u.cast("string"))
    return replies.withColumns({**out, "missed_urls": texts})


def alert_reasons(overall: Column, missed: str = "missed_urls") -> Column:
    """Reasons of a quality alert over columns of judged(): each dimension whose score is a number below 3, completeness with
    the addresses it missed, and an overall score above 0 and below 3.5; joined, '' if there is none."""
    urls = F.concat(F.lit("["), F.array_join(F.transform(missed, lambda u: F.concat(F.lit("'"), u, F.lit("'"))), ", "), F.lit("]"))
    parts = []
    for d in DIMENSIONS:
        text = F.col(f"{d}.score")
        number = F.when(text.rlike(r"^-?[0-9]"), text.try_cast("double"))
        tail = F.concat(F.lit("，遺漏："), urls) if d == "completeness" else F.lit("")
        parts.append(F.when(number < 3.0, F.concat(F.lit(f"{d}="), text, tail)))
    parts.append(F.when((overall > 0) & (overall < 3.5), F.concat(F.lit("overall="), overall.cast("string"))))
    return F.array_join(F.array_compact(F.array(*parts)), "；")
