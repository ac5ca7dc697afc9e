"""Reports in markdown as rows of lines: checks, community views, relinking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import scalars as S

# What a row of a list or table with popularity looks like, and a link in it; line ends of any script.
ROW, POPULAR, LINKED = r"(?U)^\s*(?:\d+\.|[-*•])\s|^\s*\|", r"(?U)\(\s*\d[\d,]*\s*(?:users|pt|ups)\s*\)", r"\]\(https?://"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# What models write for a view of a community, to the end of the line; how a true one begins; the first link
# of a list row.
VIEW = r"[ \t]*(?:[-*•][ \t]+)?\**(?:💬[ \t]*)?\**社群觀點\**[ \t]*[：:].*$"
VIEW_HEAD, VIEW_INDENT = "💬 社群觀點：", "   "
# What violations say, by their code (%s: count, sample), and what a line of them begins with.
VIOLATION = {"leftover_token": "report.md 殘留 %s 行 @@id@@ token：%s", "unlinked_articles": "report.md 有 %s 篇文章列沒有 http(s) 連結：%s"}
BLOCKED, NOT_BLOCKED = "deploy 已擋下：", "（未擋 deploy）"
LISTED_LINK = r"^\s*(?:\d+\.|[-*•])\s+.*?\]\((https?://[^)\s]+)\)"


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): lines at any line end; nothing of a null text."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), LINE_END)).alias("pos", "line"))


def is_unlinked_row(line: Column) -> Column:
    return line.rlike(ROW) & line.rlike(POPULAR) & ~line.rlike(LINKED)


def check_report(lines: DataFrame, key: str) -> DataFrame:
    """(key, code, count, sample): left-over place holders and unlinked rows, with the first three lines, stripped and cut
    at 60 characters. Only three lines of a report are collected, however many there are."""
    kinds = F.array_compact(F.array(F.when(F.col("line").rlike("@@[0-9]+@@"), F.lit("leftover_token")), F.when(is_unlinked_row(F.col("line")), F.lit("unlinked_articles"))))
    hit = lines.select(key, "pos", F.substring(S.strip(F.col("line")), 1, 60).alias("line"), F.explode(kinds).alias("code"))
    first = hit.withColumn("_n", F.row_number().over(Window.partitionBy(key, "code").orderBy("pos")))
    return first.groupBy(key, "code").agg(F.count(F.lit(1)).alias("count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.struct("pos", "line")))), lambda x: x["line"]), "；").alias("sample"))


def violation_text(code: Column, count: Column, sample: Column) -> Column:
    """What a violation says to a reader."""
    return F.coalesce(*[F.when(code == name, F.format_string(says, count.cast("string"), sample)) for name, says in VIOLATION.items()], sample)


def violations_line(violations: DataFrame, key: str, blocked: bool = True) -> DataFrame:
    """(key, message): all violations of a report in one line, place holders before rows."""
    prefix = BLOCKED if blocked else NOT_BLOCKED
    part = F.concat(F.lit("["), F.col("code"), F.lit("] "), violation_text(F.col("code"), F.col("count"), F.col("sample")))
    return violations.groupBy(key).agg(F.concat(F.lit(prefix), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", part.alias("t")))), lambda x: x["t"]), " | ")).alias("message"))


def without_views(lines: DataFrame) -> DataFrame:
    """Lines without views that a model wrote, also behind other text; a line that was nothing else goes. Table rows stay."""
    cut = F.when(F.col("line").rlike(r"^\s*\|") | ~F.col("line").rlike(VIEW), F.col("line")).otherwise(F.nullif(F.regexp_replace(F.regexp_replace("line", VIEW, ""), r"(?U)\s+$", ""), F.lit("")))
    return lines.withColumn("line", cut).where("line is not null")


def with_views(lines: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """(key, pos, part, line): instead of what a model wrote, each address's comment after the first list row with it. Twice is
    as once. comments has (url, comment), an address once."""
    base = without_views(lines)
    urls = base.withColumn("url", F.regexp_extract("line", LISTED_LINK, 1))
    firsts = urls.where("url <> ''").groupBy(key, "url").agg(F.min("pos").alias("pos"))
    added = firsts.join(comments.where(F.coalesce("comment", F.lit("")) != ""), "url").select(key, "pos", F.lit(1).alias("part"), F.concat(F.lit(VIEW_INDENT + VIEW_HEAD), F.col("comment")).alias("line"))
    return base.select(key, "pos", F.lit(0).alias("part"), "line").unionByName(added)


def sections(lines: DataFrame, key: str, pattern: str = r"^#{1,6}\s+(.*)$") -> DataFrame:
    """(key, pos, line, section): the last heading at or before each line; null before the first."""
    heading = F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, 1))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def list_breaks(lines: DataFrame, key: str) -> DataFrame:
    """(key, pos, line, break_before): list rows without indent that need an empty line before them: after a line that is
    neither blank nor indented nor such a row itself."""
    item = r"^(?:\d+\.|[-*+])\s"
    before = F.lag("line").over(Window.partitionBy(key).orderBy("pos"))
    return lines.withColumn("break_before", F.coalesce(F.col("line").rlike(item) & ~before.rlike(item) & before.rlike(r"^\S"), F.lit(False)))


def joined(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, text): the lines put together in order; a document's lines are one row's text, as they were before."""
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("text"))


def ledger_check(runs: DataFrame, usage: DataFrame, steps: list[str]) -> DataFrame:
    """Days on which a step that calls a model ran but no tokens were counted: (run_date)."""
    ran = runs.where(F.col("step").isin(steps) & (F.col("status") == "ran")).select("run_date").distinct()
    return ran.join(usage.select("run_date", "total_tokens"), "run_date", "left").where(F.coalesce("total_tokens", F.lit(0)) <= 0).select("run_date")
