"""Event streams: exactly-once effect by keys, tumbling and session windows, and upserts of each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_events(spark, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """A watermark on a time that may lack a zone, which is then the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def once_each(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """STR-02: rows read again within the watermark are dropped by their keys; state older than it goes."""
    return timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, by: list[str], width: str = "5 minutes", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """STR-16: rows of each key and window."""
    return timed(stream, time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(*by, F.col("window.start").alias("slot"), "n")


def sessions(stream: DataFrame, by: list[str], gap: str = "180 seconds", time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """STR-04 and STR-28: sessions by time gap alone."""
    return timed(stream, time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("raw_count")).select(*by, F.col("session_window.start").alias("first_seen"), "raw_count")


def append_batches(target: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that is run again overwrites its own folder, so no row is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write
