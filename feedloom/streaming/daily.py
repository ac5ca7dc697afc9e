"""Structured Streaming forms of the daily, stateful behaviour. Event times are timestamps in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from feedloom.operators.tables import replace_days, upserted
from feedloom.runtime import cut


def stream(spark: SparkSession, path: str, schema, event_time: str = "ts") -> DataFrame:
    """A file stream whose zone-less event time is read as UTC."""
    return spark.readStream.schema(schema).parquet(path).withColumn(event_time, F.col(event_time).cast("timestamp"))


def daily_counts(events: DataFrame, keys: list[str], event_time: str = "ts", late: str = "7 days", days: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped, and only closed windows leave in append mode."""
    window = F.window(event_time, days, slide) if slide else F.window(event_time, days)
    return events.withWatermark(event_time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(events: DataFrame, keys: list[str], event_time: str = "ts", within: str = "7 days") -> DataFrame:
    """The first row of each key within the trailing window of the watermark; later ones are repeats."""
    return events.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def upsert_days(events: DataFrame, path: str, checkpoint: str, keys: list[str], day: str = "run_date") -> StreamingQuery:
    """Every micro-batch puts its rows (the last of a key by order of arrival doesn't matter: keys are unique in a batch, else
    one is kept) in place of stored rows of the same day and keys. Other rows of a day stay, so a day may come in parts, and a
    batch or a day that is run again leaves the same table. Only the days of the batch are read and written."""
    def merge(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = cut(df.dropDuplicates([day, *keys]))
        touched = [r[0] for r in new.select(day).distinct().collect()]  # days of one batch
        try:
            old = spark.read.parquet(path).where(F.col(day).isin(touched))
        except AnalysisException:
            old = new.limit(0)
        replace_days(cut(upserted(old.select(*new.columns), new, [day, *keys])), path, day)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def chronic_episodes(outcomes: DataFrame, window: int = 7, threshold: int = 3) -> DataFrame:
    """(subject, day, failures) of outcomes (subject, day, ok): a subject failing on threshold days of the last `window`, unless
    that was reported within the last `window` days. State per subject: its failing days in the window and the last report.

    Days of one subject that arrive out of order within a batch are put in order; a day already passed is counted with its window.
    """
    def emit(key, frames, state):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("day")
        failing, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        out = []
        for day, ok in zip(rows["day"], rows["ok"]):
            number = day.toordinal()
            if not ok and number not in failing:
                failing.append(number)
            failing = [n for n in failing if number - n < window]
            count = sum(n <= number for n in failing)
            if not ok and count >= threshold and (last is None or number - last >= window):
                out.append((key[0], day, count))
                last = number
        state.update((failing, last))
        yield pd.DataFrame(out, columns=["subject", "day", "failures"])

    return outcomes.groupBy("subject").applyInPandasWithState(emit, "subject string, day date, failures int", "failing array<int>, last int", "append", "NoTimeout")


def cool_down(findings: DataFrame, days: int = 7) -> DataFrame:
    """Findings (subject, day) not reported within `days` of the last report, with state per subject."""
    def emit(key, frames, state):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("day")
        last = state.get[0] if state.exists else None
        out = []
        for day in rows["day"]:
            number = day.toordinal()
            if last is None or number - last >= days:
                out.append((key[0], day))
                last = number
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["subject", "day"])

    return findings.groupBy("subject").applyInPandasWithState(emit, "subject string, day date", "last long", "append", "NoTimeout")
