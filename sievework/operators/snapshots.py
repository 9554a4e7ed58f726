"""Snapshots of tables and whether a restored one is the same: digests of multisets of rows, by partition.

A row's hash covers its columns by name, nulls apart from empty strings; a partition's digest is the number of its rows and
sums of two parts of their hashes, so it doesn't depend on order or files, repeats count, and partial sums do most of the
work before a shuffle of one row a partition and task.  Two tables differ exactly where digests do, by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITIONS = 64


def row_hash(columns: list[str]) -> Column:
    """MD5 of a row's columns in order of their names, each as its length and text, null as such."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("null")) for c in sorted(columns)]
    return F.md5(F.concat_ws("|", *parts))


def digests(table: DataFrame, by: Column | None = None, partitions: int = PARTITIONS) -> DataFrame:
    """part, n_rows, low and high of each partition: of ``by``, or of the rows' own hashes."""
    columns = table.columns
    rows = table.select(row_hash(columns).alias("_hash"), *([by.cast("string").alias("part")] if by is not None else []))
    number = lambda at: F.conv(F.substring("_hash", at, 15), 16, 10).cast("decimal(38,0)")
    if by is None:
        rows = rows.withColumn("part", F.format_string("%04d", F.pmod(F.conv(F.substring("_hash", 1, 15), 16, 10).cast("long"), F.lit(partitions))))
    return rows.groupBy("part").agg(F.count("*").alias("n_rows"), F.sum(number(1)).cast("string").alias("low"), F.sum(number(16)).cast("string").alias("high"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Partitions of two digests that differ, with both numbers of rows; a partition that one lacks has none there."""
    rows = a.alias("a").join(b.alias("b"), F.col("a.part").eqNullSafe(F.col("b.part")), "full_outer")
    same = F.col("a.n_rows").eqNullSafe(F.col("b.n_rows")) & F.col("a.low").eqNullSafe(F.col("b.low")) & F.col("a.high").eqNullSafe(F.col("b.high"))
    none = F.lit(0).cast("long")
    return rows.where(~same).select(F.coalesce("a.part", "b.part").alias("part"), F.coalesce("a.n_rows", none).alias("rows_before"), F.coalesce("b.n_rows", none).alias("rows_after"))


def back_up(tables: dict[str, DataFrame], path: str, partitions: int = PARTITIONS) -> None:
    """SNK-06: tables as Parquet with their digests beside them; digests are of what was written."""
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        df.write.parquet(target)
        digests(df.sparkSession.read.parquet(target), partitions=partitions).coalesce(1).write.parquet(f"{target}-digests")


def check(tables: dict[str, DataFrame], path: str, least: dict[str, int] | None = None, partitions: int = PARTITIONS) -> DataFrame:
    """SNK-06: table_name, n_rows, differing (partitions) and ok of restored tables against a backup.

    A table is ok if no partition differs and it has the rows it must have at least.
    """
    out = None
    for name, df in tables.items():
        spark = df.sparkSession
        now = digests(df, partitions=partitions)
        differ = differences(spark.read.parquet(f"{path.rstrip('/')}/{name}-digests"), now).agg(F.count("*").alias("differing"))
        n = now.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        row = n.crossJoin(differ)  # one row each
        row = row.select(F.lit(name).alias("table_name"), "n_rows", "differing", ((F.col("differing") == 0) & (F.col("n_rows") >= (least or {}).get(name, 0))).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out
