"""Mixing sources to target weights.

Method.  Targets come from weights, with a limit of ``most`` times a source's own size, the excess
shared again by weight among sources under theirs: all sources under their limits have ``level * weight``,
and each round sums what the limited ones hold and raises the level until no more are over.  A document's
place in its source's permutation is a seeded hash of its id; documents of one place follow each other by a
hash of where they are read.  A source is taken ``target // size`` times whole and for the rest up to the
place where its documents reach the target: sums over the next eight bits of the place find the stretch in
which that falls, until few documents are left to be ordered, so no task orders a whole source.

A block is a stretch of a stratum's places.  A source with a thousandth of all words or more is a stratum of
its own; the others share a fixed number of strata by hash.  The blocks of each stratum, each with its exact
quota, are split among the output shards by a tree: at each node a multivariate hypergeometric draw decides
how many blocks of each stratum go left, from a generator seeded by the node, so all shards are drawn
without replacement and any can be redrawn alone.  Shards draw disjoint stretches of each stratum's
permuted blocks and are shuffled locally, by a hash.

Bound: sources stay a table, of any length; the driver holds the strata (``OWN + SHARED`` at most) and their
blocks (``2 ** MOST_BLOCK_BITS`` and one a stratum, times ``most``), and these are what is broadcast, with the table of
sources where it has ``BROADCAST_SOURCES`` rows at most.

Defined results: a null or empty text has size 0 and is taken 0 words (its copies count as any row's in
the mix); null is a source of its own; rows of repeated or null ids share a place and are taken one by one.
Other columns are kept in ``mixed``, ignored in ``taken``.  An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

WEIGHTS = (5.0, 2.0, 1.0)
PLACE_BITS = 62
#: Documents of a source that are ordered one by one at the end of the search for a place.
FEW = 50_000
#: A source with this part of all words is a stratum of its own; strata that the others share.
OWN, SHARED = 1000, 64
#: Words of a block and of an output shard at least; at most so many blocks and shards, as powers of two.
BLOCK_WORDS, SHARD_WORDS = 50_000, 1_000_000
MOST_BLOCK_BITS, MOST_SHARD_BITS = 18, 16
BROADCAST_SOURCES = 100_000
#: Sources ordered in one task, about; copies of a source's row that a join without broadcast deals out.
RANKED, SALTS = 100_000, 32


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: a tree of multivariate hypergeometric draws over the shards."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have
        node(lo, mid, left)
        node(mid, hi, have - left)

    if len(quotas):
        node(0, shards, quotas.astype(np.int64))
    return out


def _size(text_col: str):
    words = F.expr(f"cast(size(filter(split(`{text_col}`, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')) as long)")
    return F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(words)


def _hash(*of) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 64 - PLACE_BITS)


def _placed(docs: DataFrame, seed: int, id_col: str) -> list[Column]:
    """A row's place, and its order among rows of the same place."""
    return [_hash(F.lit(seed), F.col(id_col)).alias("place"), _hash(F.lit(seed), F.monotonically_increasing_id()).alias("tie")]


def _ranked(sources: DataFrame) -> DataFrame:
    """source, size and rank by code point from 0, null last; ranges of sources are ordered apart."""
    parts = max(1, sources.count() // RANKED)
    order = [F.col("source").isNull(), F.col("source")]  # strings go by their UTF-8 bytes, as code points do
    ranged = written(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # one row for RANKED sources
    before = np.cumsum([0] + [n for _, n in counts])
    offset = F.element_at(F.create_map(*[F.lit(int(v)) for (part, _), n in zip(counts, before, strict=False) for v in (part, n)]), F.col("part")) if counts else F.lit(0)
    return ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + offset).drop("part")


def _targets(ranked: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """source, size, weight and target of each source."""
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    weighted = written(weighted.drop("rank"), "weighted")
    full = F.col("size") > 0
    total, share = weighted.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double"), F.sum(F.when(full, F.col("weight")))).first()
    level, held = total / share if share else 0.0, -1
    while True:
        over = full & (level * F.col("weight") > most * F.col("size"))
        now, fixed, free = weighted.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("size") * float(most))), F.sum(F.when(full & ~over, F.col("weight")))).first()
        if now == held or not now or not free:
            break
        level, held = (total - fixed) / free, now
    target = F.when(full, F.least(F.col("weight") * level, F.col("size") * float(most))).otherwise(F.lit(0.0))
    return weighted.withColumn("target", target)


def _joined(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with what is known of their source (``of``); a source with very many rows goes to many tasks."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if few:
        return rows.join(F.broadcast(sources), same, "inner")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("place", "tie"), F.lit(SALTS)).cast("int"))
    each = sources.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, same & (F.col("salt") == F.col("salt_of")), "inner").drop("salt", "salt_of")


def _cuts(sized: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """For each source of ``wanted`` (of, want) the place and tie up to which its sizes come nearest to want.

    Each round sums the parts of the one stretch where a source's cut lies, of a 256th of its places each.
    """
    digits = [F.expr(f"cast(shiftrightunsigned({c}, {max(0, PLACE_BITS - 8 * (k + 1))}) & {255 if PLACE_BITS >= 8 * (k + 1) else (1 << PLACE_BITS - 8 * k) - 1}L as int)") for c in ("place", "tie") for k in range(-(-PLACE_BITS // 8))]
    rows = _joined(sized, wanted, few).select("source", "place", "tie", "size", "want")
    for digit in digits:
        sums = rows.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("part"), F.count("*").alias("rows"), F.first("want").alias("want"))
        upto = F.sum("part").over(Window.partitionBy("source").orderBy("digit"))
        cross = sums.withColumn("upto", upto).where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("part") <= F.col("want")))
        cross = written(cross.select(F.col("source").alias("of"), F.col("digit").alias("at"), (F.col("want") - (F.col("upto") - F.col("part"))).alias("left"), "rows"), "stretches")
        inside = _joined(rows, cross, few).where(digit == F.col("at"))
        rows = written(inside.select("source", "place", "tie", "size", F.col("left").alias("want")), "inside")
        most = cross.agg(F.max("rows")).first()[0]
        if most is None or most <= FEW:
            break
    order = Window.partitionBy("source").orderBy("place", "tie")
    last = rows.withColumn("upto", F.sum("size").over(order)).where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("size") <= F.col("want")))
    taken = F.col("upto") - F.col("want") <= F.col("want") - (F.col("upto") - F.col("size"))
    return last.groupBy(F.col("source").alias("of")).agg(F.min(F.struct("place", (F.col("tie") + taken.cast("long")).alias("tie"))).alias("cut"))


class Plan(NamedTuple):
    """sized: doc_id, source, size, place and tie of each document; sources: of, source_size, target, the times
    it is taken whole, the place and tie below which once more, its stratum and the bits of its blocks;
    places: the shard of each stratum's block and copy; few: whether sources may be broadcast."""

    sized: DataFrame
    sources: DataFrame
    places: DataFrame
    shards: int
    few: bool


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, shards: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Plan:
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _size(text_col).alias("size"), *_placed(docs, seed, id_col))
    sized = written(sized, "sized")
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("size")), "totals")
    known = written(_targets(_ranked(totals), weights, most), "targets")
    n, words, mix_words = known.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    few = n <= BROADCAST_SOURCES
    known = known.withColumn("whole", F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(most))).otherwise(F.lit(0)).cast("int"))
    rest = F.col("target") - F.col("whole") * F.col("size")
    wanted = known.where((F.col("size") > 0) & (F.col("whole") < most) & (rest > 0)).select(F.col("source").alias("of"), rest.alias("want"))
    cuts = _cuts(sized, wanted, few)
    known = known.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    none = F.lit(0).cast("long")
    known = known.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "whole", F.coalesce("cut.place", none).alias("cut"), F.coalesce("cut.tie", none).alias("cut_tie"))
    # strata: a source's own where it has a thousandth of all words, so their number is bounded
    known = written(known.withColumn("own", F.col("source_size") * OWN >= F.lit(max(1, words))), "sources")
    own = [r["of"] for r in known.where("own").select("of").collect()]
    own.sort(key=lambda v: (v is None, v or ""))
    strata = spark.createDataFrame([(v, k) for k, v in enumerate(own)], "name string, number int")
    known = known.join(F.broadcast(strata), F.col("own") & F.col("of").eqNullSafe(F.col("name")), "left")
    known = known.withColumn("stratum", F.coalesce("number", (F.pmod(F.xxhash64(F.lit(seed), "of"), F.lit(SHARED)) + len(own)).cast("int"))).drop("name", "number", "own")
    copies = F.col("whole") + ((F.col("cut") > 0) | (F.col("cut_tie") > 0)).cast("int")
    found = known.groupBy("stratum").agg(F.sum("source_size").alias("words"), F.max("whole").alias("whole"), F.max(copies).alias("copies"), F.max("cut").alias("cut")).orderBy("stratum").collect()  # one row a stratum
    block_words = max(BLOCK_WORDS, words >> MOST_BLOCK_BITS)
    bits = {r["stratum"]: max(0, int(r["words"] // block_words).bit_length()) for r in found}
    shards = shards or max(1, min(int(mix_words) // SHARD_WORDS, 1 << MOST_SHARD_BITS))
    quotas = []
    for r in found:
        blocks, partial = 1 << bits[r["stratum"]], 0
        if r["copies"] > r["whole"]:  # of a stratum with one source, only the blocks up to its cut are taken once more
            partial = min(blocks, (r["cut"] >> (PLACE_BITS - bits[r["stratum"]])) + 1) if r["stratum"] < len(own) else blocks
        quotas.append(r["whole"] * blocks + partial)
    given = split_quotas(np.array(quotas, np.int64), shards, seed)
    places = []
    for k, r in enumerate(found):
        blocks = 1 << bits[r["stratum"]]
        order = np.random.default_rng([seed, r["stratum"]]).permutation(quotas[k])
        places.append(pd.DataFrame({"of_stratum": np.full(quotas[k], r["stratum"], np.int32), "block": (order % blocks).astype(np.int32), "copy": (order // blocks).astype(np.int32), "shard": np.repeat(np.arange(shards, dtype=np.int32), given[:, k])}))
    schema = "of_stratum int, block int, copy int, shard int"
    dealt = spark.createDataFrame(pd.concat(places), schema) if places else spark.createDataFrame([], schema)
    sizes = spark.createDataFrame([(k, v) for k, v in bits.items()], "one_stratum int, bits int")
    known = known.join(F.broadcast(sizes), F.col("stratum") == F.col("one_stratum")).drop("one_stratum")
    return Plan(sized, written(known, "plan"), dealt, shards, few)


def _copies() -> Column:
    once_more = (F.col("place") < F.col("cut")) | ((F.col("place") == F.col("cut")) & (F.col("tie") < F.col("cut_tie")))
    return F.col("whole") + once_more.cast("int")


def _block() -> Column:
    return F.expr(f"cast(shiftrightunsigned(place, {PLACE_BITS} - bits) as int)")


def taken(docs: DataFrame, **how) -> DataFrame:
    """Each document's doc_id, size, source_size, target, taken (words, repeats counted) and copies.

    Copies are those that the draw deals to a shard, counted without moving texts.
    """
    plan = mix_plan(docs, **how)
    rows = _joined(plan.sized, plan.sources, plan.few).withColumn("at", _block()).withColumn("wanted", _copies())
    drawn = plan.places.groupBy("of_stratum", "block").agg(F.collect_list("copy").alias("drawn"))
    rows = rows.join(F.broadcast(drawn), (F.col("stratum") == F.col("of_stratum")) & (F.col("at") == F.col("block")), "left")
    rows = rows.withColumn("copies", F.when(F.col("drawn").isNull(), 0).otherwise(F.size(F.filter("drawn", lambda c: c < F.col("wanted")))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the documents' columns, a row for each copy taken, dealt to the output shards and
    shuffled within each by a hash.  Copies and shards follow from small tables; texts move once."""
    plan = mix_plan(docs, seed=seed, id_col=id_col, source_col=source_col, **how)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), *_placed(docs, seed, id_col))
    rows = _joined(rows, plan.sources, plan.few)
    rows = rows.withColumn("copies", _copies()).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
    rows = rows.withColumn("at", _block()).join(F.broadcast(plan.places.withColumnRenamed("copy", "nth")), (F.col("stratum") == F.col("of_stratum")) & (F.col("at") == F.col("block")) & (F.col("copy") == F.col("nth")), "inner")
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed + 1), "place", "tie", "copy"))
    return rows.repartitionById(plan.shards, F.col("shard")).sortWithinPartitions("shard", "order").select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
