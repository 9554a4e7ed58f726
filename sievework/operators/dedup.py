"""Near duplicates by SimHash, joined on blocks of bits instead of all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a small table has fewer files than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_simhash(docs: DataFrame) -> DataFrame:
    return T.with_simhash64(spread(docs.select("doc_id", "text")).select("doc_id", T.normalized_for_hash(F.col("text")).alias("norm")), T.shingles(F.col("norm"))).drop("norm")


def block_count(nodes: int, most: int = 6, bucket: int = 256) -> int:
    """Blocks of a hash, of which all but ``most`` agree in any near pair: so many that a bucket holds ``bucket`` nodes, about.

    Keys a node: 28 up to 16 million nodes, 84 up to 500 million, 210 up to eight thousand million, and no more beyond.
    """
    blocks = most + 2
    while blocks < most + 4 and (1 << (64 * (blocks - most) // blocks)) * bucket < nodes:
        blocks += 1
    return blocks


def near_pairs(hashed: DataFrame, most: int = 6, bucket: int = 256) -> DataFrame:
    """Pairs of different hashes within the distance, each with its smallest ids; equal hashes are one node.

    Hashes that differ in ``most`` bits agree in all but ``most`` of some blocks, so nodes meet on each choice of
    the others.  Rows are dealt out and sorted by choice and key once; neighbours of one key are compared where they lie,
    in Arrow batches, and a pair counts under the first choice in which it agrees, so there is no second copy to join, and
    nothing to make distinct.
    """
    nodes = hashed.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"))
    blocks = block_count(nodes.count(), most, bucket)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - most)]
    signed = [m - ((m >> 63) << 64) for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("simhash").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
    schema = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("distance", pa.int32())])

    def pairs_of(choice: np.ndarray, key: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        run = np.cumsum(np.concatenate([[0], (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]))
        out, apart = [], 1
        at = np.arange(len(run))
        while True:
            at = at[at < len(run) - apart]
            at = at[run[at] == run[at + apart]]
            if not len(at):
                break
            x = bits[at] ^ bits[at + apart]
            distance = np.bitwise_count(x)
            close = np.flatnonzero(distance <= most)
            x = x[close]
            first = np.full(len(close), -1)
            for k, m in enumerate(masks):
                first[(first < 0) & (x & np.uint64(m) == 0)] = k
            close = close[first == choice[at[close]]]
            out.append((ids[at[close]], ids[at[close] + apart], distance[close].astype(np.int32)))
            apart += 1
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(p) for p in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last key may go on in the next batch
            if cut:
                yield pairs_of(rows[0][:cut], rows[1][:cut], rows[2][:cut], rows[3][:cut].view(np.uint64))
            held = [c[cut:] for c in rows]
        if held is not None and len(held[0]):
            yield pairs_of(held[0], held[1], held[2], held[3].view(np.uint64))

    met = nodes.select("doc_id", "simhash", F.explode(keys).alias("k")).select("k.choice", "k.key", F.col("doc_id").cast("long").alias("doc_id"), "simhash")
    return met.repartition("choice", "key").sortWithinPartitions("choice", "key", "doc_id").mapInArrow(compare, "doc_a long, doc_b long, distance int")


def near_documents(hashed: DataFrame, most: int = 6) -> DataFrame:
    """near_pairs, and each document of an equal hash with the smallest id of its class, at distance 0.

    All pairs of documents within the distance follow from these rows: any two of one class, and any
    member of one class with any of another that a pair links.
    """
    hashed = hashed.persist()  # two integers a row, used by each step
    least = hashed.groupBy("simhash").agg(F.min("doc_id").alias("doc_a"))
    members = hashed.join(least, "simhash").where("doc_id > doc_a").select("doc_a", F.col("doc_id").alias("doc_b"), F.lit(0).alias("distance")).distinct()
    return near_pairs(hashed, most).unionByName(members)


def fingerprints(items: DataFrame, item_id: str, url: str, title: str, text: str) -> DataFrame:
    """The four keys of an item: of its address, its text, its title, and its SimHash; an empty key is null."""
    from sievework.functions.rules import canonical_url

    canonical, name = canonical_url(F.col(url)), T.normalized_title(F.col(title))
    forms = spread(items.select(item_id, url, title, text)).select(F.col(item_id).alias("item_id"), canonical.alias("url"), name.alias("name"), T.normalized_for_hash(F.col(text)).alias("norm"))
    keyed = forms.select("item_id", F.when(F.col("url") != "", F.sha2("url", 256)).alias("url_key"), F.sha2("norm", 256).alias("content_key"), F.when(F.col("name") != "", F.sha2("name", 256)).alias("title_key"), "norm")
    return T.with_simhash64(keyed, T.shingles(F.col("norm"))).drop("norm")


def staged_duplicates(prints: DataFrame, most: int = 6) -> DataFrame:
    """STR-07: item_id, matched_id and stage: an item's first earlier item (by id) by address, text, title or SimHash.

    The first stage that finds one decides.  Each exact stage takes the least id of a key, by a sum before its
    shuffle; near hashes come from ``near_pairs``.
    """
    out = prints.select("item_id", "url_key", "content_key", "title_key", "simhash").persist()  # keys alone, used by each stage
    found = []
    for place, (stage, key) in enumerate((("url", "url_key"), ("content_hash", "content_key"), ("title", "title_key"))):
        least = out.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("item_id").alias("matched_id"))
        hits = out.join(least, key).where("matched_id < item_id")
        found.append(hits.select("item_id", F.struct(F.lit(place).alias("place"), F.lit(stage).alias("stage"), "matched_id").alias("hit")))
    hashed = out.select(F.col("item_id").alias("doc_id"), "simhash")
    least = hashed.groupBy("simhash").agg(F.min("doc_id").alias("first"))
    pairs = near_pairs(hashed, most)
    linked = pairs.select(F.col("doc_b").alias("first"), F.col("doc_a").alias("other")).unionByName(pairs.select(F.col("doc_a").alias("first"), F.col("doc_b").alias("other")))
    near = linked.unionByName(least.select("first", F.col("first").alias("other"))).groupBy("first").agg(F.min("other").alias("matched_id"))
    hits = hashed.join(least, "simhash").join(near, "first").where("matched_id < doc_id")
    found.append(hits.select(F.col("doc_id").alias("item_id"), F.struct(F.lit(3).alias("place"), F.lit("simhash").alias("stage"), "matched_id").alias("hit")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    first = every.groupBy("item_id").agg(F.min("hit").alias("hit"))
    return out.select("item_id").join(first, "item_id", "left").select("item_id", "hit.matched_id", F.coalesce("hit.stage", F.lit("new")).alias("stage"))
