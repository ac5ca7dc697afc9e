"""The stage scheduler: verdicts, invalidation, retries, and injected effects."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def verdict(in_steps: bool, exists: bool, forced: bool, upstream_ran: bool) -> str:
    """RUN, LOAD or SKIP; the column form is functions.scalars.run_verdict."""
    if not in_steps:
        return "LOAD" if exists else "SKIP"
    return "RUN" if forced or upstream_ran or not exists else "LOAD"


@dataclass
class Stage:
    """A named DataFrame -> DataFrame step in a tier; retries wait longer each time.

    With reflect, a try after a failure gets reflect(error) as a hint: build(done, hint) then takes two arguments.
    """

    name: str
    tier: int
    build: Callable[[dict[str, DataFrame]], DataFrame]
    tries: int = 1
    wait: float = 1.0
    reflect: Callable[[str], str] | None = None


@dataclass
class Pipeline:
    """Runs stages in tier order into tables at root/name/run_date=...; LOAD reads them back instead of recomputing."""

    spark: SparkSession
    root: str
    stages: list[Stage]
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    log: list[dict] = field(default_factory=list)

    def path(self, stage: str, day: str) -> str:
        return f"{self.root}/{stage}/run_date={day}"

    def stored(self, stage: str, day: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(stage, day))
        except AnalysisException:
            return None

    def run(self, day: str, wanted: set[str] | None = None, forced: set[str] = frozenset()) -> dict[str, DataFrame]:
        """Tables of all stages that ran or could be loaded; a failed stage counts as skipped and is logged."""
        out: dict[str, DataFrame] = {}
        ran: list[int] = []
        for stage in sorted(self.stages, key=lambda s: s.tier):
            old = self.stored(stage.name, day)
            what = verdict(wanted is None or stage.name in wanted, old is not None, stage.name in forced, any(t < stage.tier for t in ran))
            began, status, error = self.clock(), {"RUN": "ran", "LOAD": "loaded", "SKIP": "skipped"}[what], None
            if what == "LOAD":
                out[stage.name] = old
            elif what == "RUN":
                for attempt in range(stage.tries):
                    try:
                        built = stage.build(out, stage.reflect(error) if error else "") if stage.reflect else stage.build(out)
                        built.write.mode("overwrite").parquet(self.path(stage.name, day))
                        out[stage.name] = self.spark.read.parquet(self.path(stage.name, day))
                        ran.append(stage.tier)
                        error = None  # an earlier try's
                        break
                    except Exception as problem:  # a stage's failure is data for the health history
                        error = str(problem)[:300]
                        if attempt + 1 < stage.tries:
                            self.sleep(self.wait_of(stage, attempt))
                status = "failed" if error else "ran"
            self.log.append({"step": stage.name, "status": status, "duration_seconds": round(self.clock() - began, 3), "error": error})
        return out

    @staticmethod
    def wait_of(stage: Stage, attempt: int) -> float:
        return stage.wait * 3 ** attempt


def parsed_arguments(text: str, known: set[str]) -> tuple[set[str], set[str]]:
    """(forced, only) steps of arguments like '--force hn digest --only rss': names up to the next flag; unknown ones are
    left out."""
    found: dict[str, set[str]] = {"--force": set(), "--only": set()}
    flag = None
    for word in text.replace(",", " ").split():
        if word.startswith("--"):
            flag = word
        elif flag in found and word in known:
            found[flag].add(word)
    return found["--force"], found["--only"]


def stub_model(prompt: str) -> str:
    """A deterministic stand-in for a model: the first sentence of the prompt."""
    return prompt.split(".")[0][:200]


def complete(df: DataFrame, prompt: str, reply: str, model: Callable[[str], str] = stub_model) -> DataFrame:
    """Replies of a model per row, batched; an error is a column, not an exception. Write the result before using it twice."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(kind)
    def ask(prompts):
        import pandas as pd

        out = []
        for p in prompts:
            try:
                out.append((None if p is None else model(p), None))
            except Exception as problem:
                out.append((None, str(problem)[:300]))
        return pd.DataFrame(out, columns=["value", "error"])

    return df.withColumn(reply, ask.asNondeterministic()(F.col(prompt)))
