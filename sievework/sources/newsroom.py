"""The star schema seen as a newsroom's tables, so that its operators can be run on it.

Suppliers are sources, customers events, orders claims of events (an urgent one is of high risk) and stories,
line items evidence of claims (returned ones contradict, accepted ones are context) and publications of stories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey")
    return s.select(
        F.col("s_suppkey").alias("source_id"),
        F.col("s_name").alias("name"),
        F.when(nation % 3 == 0, F.concat(F.lit("Nation "), nation)).otherwise("").alias("identity"),
        F.when(nation < 5, "OFFICIAL_PRIMARY").when(nation < 12, "PERSON_STATEMENT").otherwise("AGENCY").alias("source_role"),
        (F.col("s_acctbal") > 0).alias("enabled"),
        F.when(nation % 2 == 0, "OWNER_ENABLED").otherwise("OWNER_DISABLED").alias("control_state"),
        F.when(nation % 5 == 0, "REVIEW").otherwise("AUTO").alias("publication_policy"),
        (nation % 7 == 0).alias("breaking"),
        F.round(F.col("s_acctbal")).cast("int").alias("balance"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    return items.select(
        F.col("l_orderkey").alias("claim_id"),
        F.col("l_linenumber").alias("raw_item_id"),
        F.col("l_suppkey").alias("source_id"),
        F.when(part % 4 == 0, F.concat(F.lit("dom:p"), part % 7)).otherwise("").alias("lineage_key"),
        F.when(F.col("l_returnflag") == "R", "CONTRADICTS").when(F.col("l_returnflag") == "A", "CONTEXT").otherwise("SUPPORTS").alias("relation"),
        F.col("l_shipdate").alias("observed_at"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("event_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("normal").alias("risk"), F.col("o_totalprice").alias("weight"), F.col("o_orderdate").alias("created_at"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("story_id"), F.col("o_custkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").when(F.col("o_orderstatus") == "P", "HELD").otherwise("DRAFT").alias("status"), F.col("o_orderdate").alias("created_at"))


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem")
    return items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pub_id"),
        F.col("l_orderkey").alias("story_id"),
        F.when(F.col("l_linestatus") == "O", "telegram").otherwise("site").alias("platform"),
        F.when(F.col("l_returnflag") == "N", "SENT").when(F.col("l_returnflag") == "R", "FAILED").otherwise("PENDING").alias("status"),
        F.col("l_partkey").cast("string").alias("remote_id"),
        F.col("l_shipdate").alias("created_at"),
    )
