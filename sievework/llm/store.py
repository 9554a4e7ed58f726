"""Where operators cut lineage, and sizes they need before they choose a number of partitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor sees.

    Only a local master may go without the setting (tests do); it then gets a folder of its own.
    """
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        known = sc._jsc.sc().getCheckpointDir()
        there = known.get() if known.isDefined() else None
    if not there:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="sievework-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(there)
    return there


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint: for results of a shuffle, whose last stage is cheap to run twice.

    How the rows are dealt out stays known, so that later grouping by the same key needs no shuffle;
    an adaptive plan would hide it, so the plan of the checkpoint alone isn't adaptive.
    """
    spark = df.sparkSession
    shared_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


#: Tables written inside the scopes that are open, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at its end; what is read after that must have been written outside of it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, path: str | None = None, free_shuffles: bool = False) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: for results of costly Python stages.

    A table with a path of the caller's own is left to the caller, also inside a scope.  ``free_shuffles``: nothing
    else reads the shuffles of this plan, which are large.
    """
    spark = df.sparkSession
    if path is None:
        path = new_path(spark, name)
        if _scopes:
            _scopes[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    if free_shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if free_shuffles:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
