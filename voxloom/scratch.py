"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: With this setting Spark deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables that were begun inside of ``deleted_after``, innermost first.
_begun: ContextVar[list[Scratch] | None] = ContextVar("begun", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset a temporary one is made, but only for a local master: elsewhere executors
    wouldn't see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="voxloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/voxloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. Results that were returned lazily read them, so call it when these are written."""
    _delete(spark, _own_dir(spark))


@contextmanager
def _shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def deleted_after() -> Iterator[None]:
    """Scratch tables that operators begin inside are deleted at the end, those of no one else. Results that read them have to be written by then."""
    own: list[Scratch] = []
    token = _begun.set(own)
    try:
        yield
    finally:
        _begun.reset(token)
        for scratch in own:
            _delete(scratch.spark, scratch.path)


class Scratch:
    """Parquet tables of one operator call. Writing one cuts lineage: later stages reread files instead of recomputing."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if (begun := _begun.get()) is not None:
            begun.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and reread. The shuffle files of the write go with it: nothing reads them again."""
        with _shuffles_end_with_query(self.spark):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later result reads."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")

    def keep_only(self, *names: str) -> None:
        """Delete all tables but these."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = top.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        self.drop(*[n for n in (s.getPath().getName() for s in store.listStatus(top)) if n not in names])


def is_small(df: DataFrame, rows: int) -> bool:
    """True if df has at most that many rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def plan_bytes(df: DataFrame) -> int | None:
    """What the optimizer takes df to hold, from the sizes of its files; None where it doesn't know. Rows aren't read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 52 else None
