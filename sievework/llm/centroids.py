"""Centroid clustering of whole-number vectors: Lloyd's rounds, screened by block norms.

Method.  Vectors become whole numbers and are stored once, in blocks, each beside its compressed form: the
norms of a few segments of its components.  By Cauchy-Schwarz no two vectors are nearer than their segment
norms, ``|x - c|^2 >= sum over segments of (|x_s| - |c_s|)^2``, so a round bounds all distances from the
compressed vectors and centroids, takes the exact distance to the centroid with the least bound, and gives
only centroids whose bound isn't above it an exact distance too.  Bounds are lowered by more than doubles can
round, so no centroid that is nearest or as near is pruned; what decides is whole-number arithmetic.

A task sums its vectors by centroid, so a round moves ``k * (components + 1)`` numbers a task, whatever the
sizes of clusters, and the driver holds the centroids alone.  A lost executor's tasks read the blocks again.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part,
nor do those with a component of ``LIMIT`` units or more in size, whose squared distances a long can't hold.
A null id takes part, but starts no centroid while others are left; equal ids start centroids in order of their
components.  Fewer vectors than ``k`` make fewer centroids.  Sums that a long can't hold are null.  Other
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Whole components stay below this in size, so that 64 squared differences fit in a long.
LIMIT = 1 << 27
SEGMENTS = 8
#: Doubles of segment norms and their sums are right to a far smaller part than this.
SLACK = 2.0**-40
#: Numbers in the table of bounds that a slice of a block makes.
SLICE = 1 << 21
BLOCKS = "ids array<bigint>, comps binary, norms binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def segment_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Norms of stretches of components, as even as they can be."""
    cuts = np.arange(min(segments, x.shape[1])) * x.shape[1] // min(segments, x.shape[1])
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, cuts, axis=1))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (of equals the first), its squared distance, and how many exact distances that took."""
    compressed = segment_norms(centroids, segments)
    cluster, distance, exact = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), len(x)
    step = max(1, SLICE // compressed.size)
    for lo in range(0, len(x), step):
        rows, own = x[lo : lo + step], norms[lo : lo + step, None, :]
        gap = np.abs(own - compressed) - SLACK * (own + compressed)
        bound = (np.maximum(gap, 0) ** 2).sum(2) * (1 - SLACK)
        first = bound.argmin(1)
        best, at = squared(rows, centroids[first]), first.astype(np.int32)
        for j in range(len(centroids)):
            open_ = np.flatnonzero((bound[:, j] <= best) & (first != j))
            exact += len(open_)
            d = squared(rows[open_], centroids[j])
            won = (d < best[open_]) | ((d == best[open_]) & (j < at[open_]))
            best[open_[won]], at[open_[won]] = d[won], j
        cluster[lo : lo + step], distance[lo : lo + step] = at, best
    return cluster, distance, exact


def whole_vectors(vectors: DataFrame, scale: int = 1024, dim: int = 64, segments: int = SEGMENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Blocks of kept vectors: ids, components ``floor(scale * x)`` as 32-bit integers, and segment norms."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("comps", pa.binary()), ("norms", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pc.equal(pc.list_value_length(batch.column(1)), dim).fill_null(False)
            kept = pa.Table.from_batches([batch]).filter(right).combine_chunks()
            if not kept.num_rows:
                continue
            values = pc.list_flatten(kept.column(1)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(invalid="ignore", over="ignore"):
                values = np.floor(values * scale)  # a null component is NaN here
                good = np.flatnonzero((np.abs(values) < LIMIT).all(1))
            if len(good):
                x = values[good].astype("<i4")
                ids = kept.column(0).cast(pa.int64()).take(pa.array(good)).to_pylist()
                yield pa.RecordBatch.from_pylist([{"ids": ids, "comps": x.tobytes(), "norms": segment_norms(x, segments).astype("<f8").tobytes()}], schema)

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInArrow(make, BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            x = np.frombuffer(batch.column(1)[k].as_buffer(), "<i4").reshape(-1, dim)
            yield batch.column(0)[k].values, x, np.frombuffer(batch.column(2)[k].as_buffer(), "<f8").reshape(len(x), -1)


def first_centroids(blocks: DataFrame, k: int, seed: str, dim: int = 64) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; each task sends k at most."""
    schema = pa.schema([("hash", pa.string()), ("x", pa.list_(pa.int64()))])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for ids, x, _ in _blocks(batches, dim):
            hashes = [(i is None, hashlib.sha256(f"{seed}{i}".encode()).hexdigest()) for i in ids.to_pylist()]
            order = sorted(range(len(hashes)), key=hashes.__getitem__)
            cut = hashes[order[min(k, len(order)) - 1]]  # all that are as small, as components part equal ids
            best = sorted(best + [(*hashes[i], x[i].tolist()) for i in order if hashes[i] <= cut])[:k]
        yield pa.RecordBatch.from_pylist([{"hash": None if none else h, "x": x} for none, h, x in best], schema)

    rows = blocks.mapInArrow(least, "hash string, x array<bigint>").orderBy(F.col("hash").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, dim)


def next_centroids(blocks: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Floors of the means of the vectors nearest to each; a centroid without vectors stays."""
    k, dim = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for _, x, norms in _blocks(batches, dim):
            cluster = nearest(x, norms, centroids, segments)[0]
            for j in np.unique(cluster):
                own = x[cluster == j]
                total[j, :dim] += own.sum(0, dtype=np.int64)
                total[j, dim] += len(own)
        at = np.flatnonzero(np.repeat(total[:, dim] > 0, dim + 1))
        yield pa.RecordBatch.from_arrays([pa.array((at // (dim + 1)).astype(np.int32)), pa.array((at % (dim + 1)).astype(np.int32)), pa.array(total.ravel()[at])], schema=schema)

    found = blocks.mapInArrow(sums, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums_of = {(r["cluster"], r["place"]): int(r["total"]) for r in found.collect()}  # k * (dim + 1) numbers at most
    out = centroids.copy()
    for j in range(k):
        if n := sums_of.get((j, dim), 0):
            out[j] = [sums_of[j, i] // n for i in range(dim)]
    return out


def _long(n: int | None) -> int | None:
    return n if n is not None and n < 1 << 63 else None


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3:", segments: int = SEGMENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each kept vector's cluster and squared distance, with its cluster's and all distances summed and the hash of
    its centroid's components (see RESULT)."""
    spark = vectors.sparkSession
    blocks = written(whole_vectors(vectors, scale, dim, segments, id_col, vector_col), "whole")
    centroids = first_centroids(blocks, k, seed, dim)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        after = next_centroids(blocks, centroids, segments)
        if (after == centroids).all():  # later rounds change nothing
            break
        centroids = after
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, norms in _blocks(batches, dim):
            cluster, distance, _ = nearest(x, norms, centroids, segments)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(cluster), pa.array(distance)], schema=schema)

    assigned = written(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    each = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(total).collect()}  # k rows at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(j, _long(n), _long(sum(each.values())), digest[j]) for j, n in sorted(each.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(rounds: int = 10, k: int = 8, dim: int = 64) -> str:
    """SQL for the query: every distance of every round."""
    apart = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v) AS s WHERE c < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM (SELECT v.r, c.c, {apart} AS d, row_number() OVER (PARTITION BY v.r ORDER BY {apart}, c.c) AS place FROM v, c{n} AS c) AS s WHERE place = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT a.c, i, sum(v.x[i])::BIGINT AS s, count(*) AS n FROM a{n} AS a JOIN v ON v.r = a.r, range(1, {dim + 1}) AS t(i) GROUP BY a.c, i) AS s GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN m{n} AS m ON m.c = c.c)")
    last = f"SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN v ON v.r = a.r JOIN c{rounds} AS c ON c.c = a.c"
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLE = oracle()
