"""Session set-up, the shared work folder, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_FOLDERS: dict[str, "Workspace"] = {}
_SHIPPED: set[str] = set()


def session(app: str = "feedloom", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, adaptive execution) and this package on every executor."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers find it wherever they run. The archive
    lies in the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here, packed = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for base, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    with open(full, "rb") as f:
                        z.writestr(zipfile.ZipInfo(os.path.join("feedloom", os.path.relpath(full, here))), f.read())
    at = f"package-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}/feedloom.zip"
    work = Workspace(spark, at=f"{shared_root(spark)}/feedloom")
    work.put(at, packed.getvalue())
    context.addPyFile(f"{work.path}/{at}")


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a local one, which only a local master may use."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='feedloom-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """Tables and small texts of one run in the shared folder; close() removes them, at the latest when the driver ends.

    With `at`, a folder of that name is used and stays.
    """

    def __init__(self, spark: SparkSession, name: str = "work", at: str | None = None):
        self.spark = spark
        self.path = at.rstrip("/") if at else f"{shared_root(spark)}/feedloom/{name}-{uuid.uuid4().hex}"
        if not at:
            atexit.register(self.close)

    def write(self, df: DataFrame, name: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> DataFrame:
        """Write df as a table and read it back with the schema known, so the result has no lineage."""
        at = f"{self.path}/{name}"
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def cut(self, df: DataFrame) -> DataFrame:
        return self.write(df, f"cut-{uuid.uuid4().hex}")

    def put(self, name: str, text: str | bytes) -> None:
        """Write a small text, whole or not at all: under another name first, then renamed."""
        fs, at = self._file(name)
        draft = at.suffix(f".{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(text.encode("utf-8") if isinstance(text, str) else text))
        finally:
            out.close()
        fs.delete(at, False)
        if not fs.rename(draft, at):
            raise OSError(f"cannot write {name}")

    def get(self, name: str) -> str | None:
        """The text put under a name; None if there is none."""
        fs, at = self._file(name)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _file(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def remove(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def _delete(self, at: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(at)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended already
            pass

    def close(self) -> None:
        self._delete(self.path)


def signature(*tables: DataFrame, **settings) -> str | None:
    """A name for what can be derived from these tables with these settings: a hash over their files' paths, sizes and times of
    change; None where a table doesn't come straight from files, so that nothing derived from it can be found again."""
    found = []
    for t in tables:
        try:
            files = t.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("at")).distinct()
            mark = F.xxhash64("file_path", "file_size", "at").cast("decimal(38,0)")
            found.append(tuple(map(str, files.agg(F.count(F.lit(1)), F.sum(mark), F.max("at")).first())))
        except AnalysisException:
            return None
    return hashlib.sha256(repr((found, sorted(settings.items()))).encode()).hexdigest()[:32]


def derived(name: str, build, *tables: DataFrame, **settings) -> DataFrame:
    """build() as a table in the shared folder, read again by whoever derives the same from the same files."""
    sign = signature(*tables, **settings)
    if sign is None:
        return cut(build())
    spark = tables[0].sparkSession
    at = f"{shared_root(spark)}/feedloom/derived/{name}-{sign}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a written table in the shared folder."""
    spark = df.sparkSession
    key = spark.sparkContext.applicationId
    if key not in _FOLDERS:
        _FOLDERS[key] = Workspace(spark, "cuts")
    return _FOLDERS[key].cut(df)


def clear(spark: SparkSession) -> None:
    """Remove the tables that cut() wrote so far, once the results made from them are stored."""
    work = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if work is not None:
        work.close()
