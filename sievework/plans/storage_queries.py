"""Commits of several tables at once, and digests of snapshots, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import items, snapshots
from sievework.sources.shared import shared_folder


def _inserted(spark, sf_dir):
    """Documents as items, in two commits that overlap; then an edit of every fifth, and of every tenth once more."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = d.select((F.col("doc_id") % 7).alias("source_id"), F.col("doc_id").cast("string").alias("external_key"), F.concat(F.lit("https://news.example/"), "doc_id").alias("url"), F.substring_index(text, "\n", 1).alias("title"), text.alias("text"), F.lit(None).cast("timestamp").alias("published_at"), "doc_id")
    b = items.bundle(spark, shared_folder(spark, "items"))
    items.insert_items(b, rows.where("doc_id % 3 <> 0").drop("doc_id"))
    items.insert_items(b, rows.where("doc_id % 2 = 0 OR doc_id % 3 = 0").drop("doc_id"))
    edits = rows.where("doc_id % 5 = 0").withColumn("nth", F.lit(1)).withColumn("text", F.when(F.col("doc_id") % 15 == 0, F.col("text")).otherwise(F.lit("edited")))
    again = rows.where("doc_id % 10 = 0").withColumn("nth", F.lit(2)).withColumn("text", F.lit("edited again"))
    items.add_revisions(b, edits.unionByName(again).select("source_id", "external_key", "title", "text", "nth"))
    keys = b.read("raw_items").select("item_key", F.col("external_key").cast("long").alias("doc_id"))
    prints = b.read("item_fingerprints").select("item_key", "content_hash")
    revisions = b.read("item_revisions").select("item_key", "rev_no", F.col("content_hash").alias("revision_hash"))
    return keys.join(prints, "item_key").join(revisions, "item_key").select("doc_id", "content_hash", "rev_no", "revision_hash")


def _digest(spark, sf_dir):
    return snapshots.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _differences(spark, sf_dir):
    """Documents by source against the same without every 301st and with another language for every 401st."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = d.where("doc_id % 301 <> 0").withColumn("lang", F.when(F.col("doc_id") % 401 == 0, "xx").otherwise(F.col("lang")))
    by = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id") % 40)
    return snapshots.differences(snapshots.digests(d, by), snapshots.digests(other, by))


QUERIES = {"SNK07_insert_items": _inserted, "SNK06_digests": _digest, "SNK06_differences": _differences}


def oracles(norm: str) -> dict[str, str]:
    """norm: SQL of TXT-02 over ``text``."""
    hashed = f"sha256({norm})"
    fields = ["doc_id", "lang", "n_chars", "source", "text"]
    row = " || '|' || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, 'null')" for c in fields)
    return {
        "SNK07_insert_items": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS (SELECT doc_id, {hashed} AS content_hash FROM d),
a AS (SELECT doc_id, content_hash, 1 AS rev_no, content_hash AS revision_hash FROM h),
e AS (SELECT doc_id, content_hash, 1 AS nth, CASE WHEN doc_id % 15 = 0 THEN content_hash ELSE sha256('edited') END AS r FROM h WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, content_hash, 2, sha256('edited again') FROM h WHERE doc_id % 10 = 0),
c AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY doc_id ORDER BY nth), content_hash) AS before FROM e)
SELECT * FROM a UNION ALL SELECT doc_id, content_hash, (1 + row_number() OVER (PARTITION BY doc_id ORDER BY nth))::INTEGER, r FROM c WHERE r <> before""",
        "SNK06_digests": f"""
WITH h AS (SELECT md5({row}) AS h FROM documents)
SELECT lpad((('0x' || h[1:15])::BIGINT % 64)::VARCHAR, 4, '0') AS part, count(*) AS n_rows, sum(('0x' || h[1:15])::BIGINT)::VARCHAR AS low, sum(('0x' || h[16:30])::BIGINT)::VARCHAR AS high FROM h GROUP BY ALL""",
        "SNK06_differences": """
WITH b AS (SELECT coalesce(source, 'none') || '/' || (doc_id % 40) AS part, count(*) AS rows_before, count(*) FILTER (doc_id % 301 <> 0) AS rows_after, count(*) FILTER (doc_id % 401 = 0 AND doc_id % 301 <> 0) AS changed FROM documents GROUP BY 1)
SELECT part, rows_before, rows_after FROM b WHERE rows_before <> rows_after OR changed > 0""",
    }
