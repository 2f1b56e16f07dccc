"""The folder that all executors see, and tables that are written to it to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting (4.1) by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where a session on one machine names none (tests), a temporary one is set for it; elsewhere that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: The scope that is open, of each thread by itself.
_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under the scope that is open."""
    return f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes at its end what operators wrote inside it; write or collect their results before.

    Without a scope the written tables stay, since results read them, until whoever owns the folder clears it.
    """
    path = scratch(spark, "scope")
    before = _scope.set(path)
    try:
        yield path
    finally:
        _scope.reset(before)
        remove(spark, path)


_lock, _writers, _was = Lock(), Counter(), {}


@contextmanager
def _shuffles_go(spark: SparkSession):
    """Queries that begin inside leave no shuffle files; the session's own setting is back when its last writer, of any thread, ends."""
    key = id(spark)
    with _lock:
        if not _writers[key]:
            _was[key] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _writers[key] += 1
    try:
        yield
    finally:
        with _lock:
            _writers[key] -= 1
            if not _writers[key]:
                del _writers[key]
                spark.conf.set(CLEANUP, _was.pop(key))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: this cuts lineage, and lost executors lose nothing.

    What reads the table needs the shuffle files of its writing no more, so they go at once and not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with _shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Deletes a path, or what a materialized DataFrame reads, from the shared folder."""
    path = df_or_path if isinstance(df_or_path, str) else df_or_path.scratch_path
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
