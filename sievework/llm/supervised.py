"""Labelled rows for classifiers: which are held out, and a bounded sample of the others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the crc32 of an id's text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """doc_id, text and y of ``most`` labelled rows at most of each class that aren't held out.

    Rows are chosen by a hash of the id.  Ids with labels of both classes are left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("l"))
    known = known.groupBy("_id").agg(F.min("l").alias("y"), F.max("l").alias("z")).where("y = z")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id", "y")
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most twice ``most`` rows: bounded, whatever the table's size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "inner").select("doc_id", "text", "y").toPandas()
    return out.drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True)


def as_buffer(texts: list[str]):
    """UTF-8 bytes of texts in a row, and where each starts (and the last ends)."""
    import numpy as np

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), starts
