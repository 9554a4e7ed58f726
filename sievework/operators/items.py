"""Raw items with their fingerprints and first revisions, inserted at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import rules as R
from sievework.functions import text as T
from sievework.sources.bundle import Bundle

KEYS = ["source_id", "external_key"]
ITEM = "item_key string, source_id long, external_key string, url string, title string, text string, published_at timestamp"
SCHEMAS = {
    "raw_items": ITEM,
    "item_fingerprints": "item_key string, canonical_url_hash string, content_hash string, title_norm_hash string",
    "item_revisions": "item_key string, rev_no int, title string, text string, content_hash string",
}


def bundle(spark: SparkSession, path: str) -> Bundle:
    return Bundle(spark, path, SCHEMAS)


def _with_prints(items: DataFrame) -> DataFrame:
    url = R.canonical_url(F.col("url"))
    return items.withColumns({"canonical_url_hash": F.sha2(url, 256), "content_hash": T.content_hash(F.col("text")), "title_norm_hash": F.sha2(T.normalized_title(F.col("title")), 256)})


def insert_items(to: Bundle, items: DataFrame) -> int:
    """SNK-07: items (KEYS, url, title, text, published_at) that the tables don't have, with fingerprint and revision 1.

    An item is known by its source and external key; of equal ones the first by url, title and text is taken.  Readers see an item
    in all three tables or in none.  The number of the commit.
    """

    def make(version: int) -> dict:
        nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy("url", "title", "text"))
        key = F.sha2(F.concat_ws("\x1f", F.col("source_id").cast("string"), "external_key"), 256)
        known = to.read("raw_items", version).select("item_key").distinct()
        new = items.withColumn("_nth", nth).where("_nth = 1").drop("_nth").withColumn("item_key", key).join(known, "item_key", "left_anti")
        once = to.staged(_with_prints(new))
        return {"appended": {"raw_items": once, "item_fingerprints": once, "item_revisions": once.withColumn("rev_no", F.lit(1))}}

    return to.transact(make)


def add_revisions(to: Bundle, edits: DataFrame) -> int:
    """WIN-02, STR-12: edits (KEYS, title, text, nth) of known items whose content isn't that of the item's newest revision.

    Edits of one item go in order of ``nth``; one that repeats the content before it is no revision.  Numbers go on from the highest.
    """

    def make(version: int) -> dict:
        key = F.sha2(F.concat_ws("\x1f", F.col("source_id").cast("string"), "external_key"), 256)
        old = to.read("item_revisions", version)
        last = old.groupBy("item_key").agg(F.max(F.struct("rev_no", "content_hash")).alias("last"))
        rows = edits.withColumn("item_key", key).withColumn("content_hash", T.content_hash(F.col("text"))).join(last, "item_key")
        order = Window.partitionBy("item_key").orderBy("nth")
        rows = rows.withColumn("_before", F.coalesce(F.lag("content_hash").over(order), F.col("last.content_hash"))).where("content_hash <> _before")
        rows = rows.withColumn("rev_no", F.col("last.rev_no") + F.row_number().over(order))
        return {"appended": {"item_revisions": rows}}

    return to.transact(make)
