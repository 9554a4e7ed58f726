"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Method.  Vectors are dealt by a hash over shards.  A shard draws each vector's level, and each layer
links vectors of that level or higher: they are inserted in batches, what a search of the graph so far
finds and the batch itself are candidates, a heuristic keeps candidates nearer to the
new vector than to any kept one, links are made both ways, and lists that overflow keep the nearest.  The
graph is stored as flat arrays of neighbours.  A search goes greedily down the layers, then keeps a beam
on the lowest; queries advance together, so a step is a few numpy calls.  Results of shards are merged
by the exact product in double precision.

Inner products are made distances by one more component, ``sqrt(M^2 - |v|^2)`` with M the shard's largest
norm.  A shard holds norms of one range, a factor of 16, so that no vector's size swamps the others' in
single precision; its vectors are divided by M, and queries by their own norm, which leaves ranks as they are.
Equal vectors are indexed once, with their smallest ids, as many as a result can need.

Size: queries are a fixed share of the rows and each goes to every shard, as the contract of a search
against all rows asks; both sides come in blocks, so memory stays bounded.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do those of another length than the longest common one (the most frequent; of equals the longest).
Rows with a null id take no part.  A query's own id is no candidate.  Other columns are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SHARD_ROWS = 8192
QUERY_GROUP = 1 << 15
LINKS = 16
BUILD = 64
BEAM = 128


def _nearest(x: np.ndarray, norms: np.ndarray, lo: int, hi: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows lo to hi the nearest of the rows before each, with squared distances, nearest first."""
    d = norms[lo:hi, None] + norms[None, :hi] - 2 * (x[lo:hi] @ x[:hi].T)
    later = np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]
    d[later] = np.inf
    count = min(count, hi)
    near = np.argpartition(d, count - 1, axis=1)[:, :count]
    dist = np.take_along_axis(d, near, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
    return np.where(np.isfinite(dist), near, -1), dist


def _diverse(x: np.ndarray, norms: np.ndarray, near: np.ndarray, dist: np.ndarray, links: int) -> np.ndarray:
    """Which candidates each row links to: those nearer to it than to any linked before, then the nearest others."""
    rows, count = near.shape
    v = x[near]
    between = norms[near][:, :, None] + norms[near][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((rows, count), bool)
    least = np.full((rows, count), np.inf, np.float32)
    many = np.zeros(rows, np.int64)
    for k in range(count):
        ok = (near[:, k] >= 0) & (dist[:, k] < least[:, k]) & (many < links)
        kept[ok, k] = True
        many += ok
        least[ok] = np.minimum(least[ok], between[ok, k])
    spare = (near >= 0) & ~kept
    room = (links - many)[:, None]
    return kept | (spare & (np.cumsum(spare, axis=1) <= room))


def build_layer(x: np.ndarray, links: int, most: int) -> np.ndarray:
    """Neighbours of each row, -1 where a list has room; rows are inserted in order, some at a time.

    Candidates of a row are what a search of the graph so far finds, and rows inserted with it.
    """
    n = len(x)
    norms = np.einsum("ij,ij->i", x, x)
    out = np.full((n, most), -1, np.int32)
    far = np.full((n, most), np.inf, np.float32)
    size = np.zeros(n, np.int64)
    lo = 1
    while lo < n:
        hi = min(n, lo + min(max(lo, 1), 256))
        own, d = _nearest(x[lo:hi], norms[lo:hi], 0, hi - lo, min(BUILD, hi - lo))
        near = np.where(own >= 0, own + lo, -1)
        found, f = search_layer(x[:lo], out[:lo], x[lo:hi], np.zeros(hi - lo, np.int64), BUILD, 6)
        near, dist = np.concatenate([found, near], axis=1), np.concatenate([f, d], axis=1)
        order = np.argsort(np.where(near >= 0, dist, np.inf), axis=1, kind="stable")[:, :BUILD]
        near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
        keep = _diverse(x, norms, near, dist, links)
        r, c = np.nonzero(keep)
        a, b, d = r + lo, near[r, c], dist[r, c]
        for u, v, w in zip(np.concatenate([a, b]).tolist(), np.concatenate([b, a]).tolist(), np.concatenate([d, d]).tolist(), strict=True):
            k = size[u]
            if k < most:
                out[u, k], far[u, k] = v, w
                size[u] = k + 1
            else:
                k = int(far[u].argmax())
                if w < far[u, k]:
                    out[u, k], far[u, k] = v, w
        lo = hi
    return out


def build(x: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest: rows in them, and neighbours as places among these rows."""
    levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / np.log(LINKS)).astype(int)
    layers = []
    for level in range(levels.max() + 1 if len(x) else 0):
        rows = np.flatnonzero(levels >= level).astype(np.int32)
        layers.append((rows, build_layer(x[rows], LINKS, LINKS * 2)))
    return layers


def search_layer(x: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The beam nearest rows that a search from each query's entry finds, nearest first, -1 for none."""
    q, n = len(queries), len(x)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    every = np.arange(q)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = ((x[entry] - queries) ** 2).sum(1)
    seen[every, entry] = True
    width = min(width, beam)
    live = every
    while len(live):
        order = np.argsort(np.where(done[live], np.inf, dist[live]), axis=1)[:, :width]
        chosen = np.where(np.take_along_axis(done[live], order, axis=1), -1, np.take_along_axis(ids[live], order, axis=1))
        done[live[:, None], order] = True
        new = np.where(chosen[:, :, None] >= 0, neighbours[chosen], -1).reshape(len(live), -1).astype(np.int64)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[live[:, None], np.maximum(new, 0)]] = -1
        r, c = np.nonzero(new >= 0)
        seen[live[r], new[r, c]] = True
        d = np.full(new.shape, np.inf, np.float32)
        d[r, c] = ((x[new[r, c]] - queries[live[r]]) ** 2).sum(1)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_i = np.concatenate([ids[live], new], axis=1)
        all_e = np.concatenate([done[live], new < 0], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live], ids[live], done[live] = (np.take_along_axis(v, order, axis=1) for v in (all_d, all_i, all_e))
        live = live[~done[live].all(axis=1)]
    return ids, dist


def search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int) -> np.ndarray:
    """Rows found for each query, nearest first, -1 for none."""
    entry = np.zeros(len(queries), np.int64)
    for level in range(len(layers) - 1, 0, -1):
        rows, neighbours = layers[level]
        best = search_layer(x[rows], neighbours, queries, entry, 1, 1)[0][:, 0]
        entry = np.searchsorted(layers[level - 1][0], rows[best])
    return search_layer(x[layers[0][0]], layers[0][1], queries, entry, beam)[0]


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their norms, and the norms; squares neither overflow nor vanish."""
    peak = np.abs(x).max(axis=1, keepdims=True)
    unit = x / peak
    norm = np.sqrt((unit**2).sum(axis=1, keepdims=True))
    return unit / norm, (peak * norm)[:, 0]


def _widened(x: np.ndarray) -> np.ndarray:
    """A shard's vectors divided by the largest norm, with the component that gives all the same length."""
    unit, norm = _scaled(x)
    share = (norm / norm.max())[:, None]
    return np.concatenate([unit * share, np.sqrt(np.maximum(1 - share**2, 0))], axis=1).astype(np.float32)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("v") == (sizes["n"] if sizes else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query.

    Queries are the rows whose id is divisible by ``every``.  Ties go to the smaller id.
    """
    beam = max(beam, k + 1)
    v = _usable(vectors, id_col, vector_col)
    # equal vectors once, with the ids that come first; the limit of the window holds before its shuffle too
    first = v.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    distinct = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # log of the norm by the largest component, as squares could overflow; ranges of a factor of 16, with 1 inside one
    peak = F.array_max(F.transform("v", F.abs))
    log = F.log2("peak") + F.log2(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / F.col("peak")) * (c / F.col("peak")))) / 2
    distinct = written(distinct.withColumn("peak", peak).withColumn("range", F.round(log / 4).cast("int")).drop("peak"), "vectors")
    sizes = {r["range"]: r["count"] for r in distinct.groupBy("range").count().collect()}
    count, shards, dealt = sum(sizes.values()), 0, F.lit(0)
    for span in sorted(sizes):
        many = -(-sizes[span] // shard_rows)
        dealt = F.when(F.col("range") == span, F.pmod(F.xxhash64("v"), F.lit(many)).cast("int") + shards).otherwise(dealt)
        shards += many
    shards = max(1, shards)
    schema = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("v", pa.binary()), ("layers", pa.list_(pa.binary()))])

    def index(t: pa.Table) -> pa.Table:
        x = np.array(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1)
        x = x[order := np.random.default_rng(1).permutation(len(x))]
        ids = [i for k, i in enumerate(t["ids"].to_pylist())]
        ids = [ids[k] for k in order.tolist()]
        own = _widened(x)
        layers = [part.astype("<i4").tobytes() for layer in build(own, 1) for part in layer]
        flat = np.array([i for s in ids for i in s], "<i8")
        return pa.Table.from_pylist([{"shard": t["shard"][0].as_py(), "n": len(x), "ids": flat.tobytes(), "counts": np.array([len(s) for s in ids], "<i4").tobytes(), "v": x.astype("<f8").tobytes(), "layers": layers}], schema)

    graphs = written(distinct.withColumn("shard", dealt).select("shard", "v", "ids").groupBy("shard").applyInArrow(index, "shard int, n int, ids binary, counts binary, v binary, layers array<binary>"), "graphs")
    queries = v.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-count * 2 // (every * QUERY_GROUP)))
    queries = queries.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = graphs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found.empty_table()
        g = left.to_pylist()[0]
        x = np.frombuffer(g["v"], np.float64).reshape(g["n"], -1)
        counts = np.frombuffer(g["counts"], np.int32).astype(np.int64)
        ids = np.frombuffer(g["ids"], np.int64)
        at = np.cumsum(counts) - counts
        own = _widened(x)
        flat = [np.frombuffer(p, np.int32) for p in g["layers"]]
        layers = [(rows, links.reshape(len(rows), -1)) for rows, links in zip(flat[::2], flat[1::2], strict=True)]
        qid = right["vec_id"].to_numpy()
        q = np.array(right["v"].combine_chunks().flatten()).reshape(len(qid), -1)
        out = []
        for lo in range(0, len(q), 256):
            part, names = q[lo : lo + 256], qid[lo : lo + 256]
            got = search(own, layers, np.concatenate([_scaled(part)[0], np.zeros((len(part), 1))], axis=1).astype(np.float32), beam)
            r, c = np.nonzero(got >= 0)
            row = got[r, c]
            score = np.einsum("ij,ij->i", x[row], part[r])
            each = counts[row]
            pick = np.repeat(at[row] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            r, score, cand = np.repeat(r, each), np.repeat(score, each), ids[pick]
            ok = cand != names[r]
            r, score, cand = r[ok], score[ok], cand[ok]
            order = np.lexsort((cand, -score, r))
            r, score, cand = r[order], score[order], cand[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            ok = place < k
            out.append(pa.table([names[r[ok]], cand[ok], score[ok]], schema=found))
        return pa.concat_tables(out)

    by = ["shard", "group"]
    hits = graphs.groupBy(*by).cogroup(queries.select("shard", "group", "vec_id", "v").groupBy(*by)).applyInArrow(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    # repeated rows of one query id find the same, and count once
    return hits.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
