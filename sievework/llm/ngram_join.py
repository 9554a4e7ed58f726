"""N-gram Jaccard join: components of texts whose sets of word n-grams are alike.

Method.  A text's set is its distinct word n-grams, as 64-bit hashes.  Equal sets are one node.  Sets are
ordered rare first, by counts of hashes in a sketch of fixed size, then by hash: any one order for all
sets keeps prefix filtering exact.  Two sets that reach the threshold share an n-gram of their prefixes,
so nodes meet where a prefix n-gram is shared (length filter: sizes close enough; positional filter:
enough left behind the shared n-gram), and a pair is verified once, on whole sets, after a suffix filter
that bounds the overlap by counts in ranges of the hash.

A group of nodes that share an n-gram is not expanded into all pairs.  Ordered by size, nodes are paired
with those a few places off first; verified links join components, and only pairs of different
components go on to wider distances, until every group is one component or all its distances are done.
So no link between components is lost, whatever a group's size, and links inside one are not needed.

Defined results: a null, empty or wordless text has an empty set and is its own component.  Repeated ids
share a component.  Rows with a null id take no part.  Other columns are ignored.  An empty table gives
an empty result.  Node and n-gram identity rests on 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .bytehash import U, mix, stretch_hashes, word_hashes, word_spans
from .components import components
from .store import written
from .toxicity import LOWER

SKETCH_BITS, SLICE_BITS = 18, 14
#: Prefix n-grams of a shard, about; pairs of a bundle; nodes up to which a table of them is broadcast.
SHARD_GRAMS = 1 << 20
BUNDLE_PAIRS = 2000
BROADCAST_NODES = 2_000_000
#: Distances in a group, ordered by size, at which each round pairs its nodes; the last has no end.
ROUNDS = (1, 3, 24, 512, 1 << 62)


def sets_of(buf: np.ndarray, starts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words has one for all of them."""
    buf = LOWER[buf]
    first, last, text = word_spans(buf, starts)
    words = word_hashes(buf, first, last)
    counts = np.bincount(text, minlength=len(starts) - 1)
    at = np.cumsum(counts) - counts
    every = np.arange(max(0, len(words) - n + 1))
    grams = stretch_hashes(words, every, every + n, 0)
    for k, (i, c) in enumerate(zip(at.tolist(), counts.tolist(), strict=True)):
        if c >= n:
            own = np.sort(grams[i : i + c - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif c:
            yield stretch_hashes(words[i : i + c], np.array([0]), np.array([c]), 0)
        else:
            yield np.zeros(0, np.uint64)


def node_of(own: np.ndarray) -> int:
    return int(mix(mix(own + U(77)).sum(keepdims=True) + U(len(own)))[0].astype(np.int64))


def linked_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links, its own included).

    Two texts link when 100 * intersection >= percent * union of their sets.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    spark = docs.sparkSession
    cells = 1 << SKETCH_BITS
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(cells, np.int64)
        for keys, buf, starts in B.text_chunks(batches):
            sizes, nodes, grams = [], [], []
            for own in sets_of(buf, starts, n):
                sizes.append(len(own))
                nodes.append(node_of(own) if len(own) else None)
                grams.append(own)
            sketch += np.bincount((np.concatenate(grams) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())], schema=fields)
        if sketch.any():
            yield pa.RecordBatch.from_pylist([{"slice": k, "counts": B.small_ints(part)} for k, part in enumerate(sketch.reshape(-1, 1 << SLICE_BITS))], fields)

    described = written(docs.mapInArrow(describe, "doc_id long, n long, node long, slice int, counts binary"), "sets")
    sets = described.where("doc_id IS NOT NULL").select("doc_id", "n", "node")
    summed = described.where("slice IS NOT NULL").groupBy("slice").applyInArrow(lambda t: pa.table({"slice": t["slice"][:1], "counts": [sum(B.from_small_ints(c) for c in t["counts"].to_pylist()).astype("<i8").tobytes()]}), "slice int, counts binary").collect()
    often = np.zeros(cells, np.int64)  # the sketch: 2**SKETCH_BITS numbers, whatever the input
    for r in summed:
        often[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(r["counts"], np.int64)
    sketch = spark.sparkContext.broadcast(often)
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, total * (100 - percent) // 100 // SHARD_GRAMS)
    message = pa.schema([("shard", pa.int32()), ("grams", pa.binary()), ("of", pa.binary()), ("place", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value

        def sent(seen: dict[int, int], sizes: list, grams: list, of: list, place: list) -> pa.RecordBatch:
            g, o, at = np.concatenate(grams), np.concatenate(of), np.concatenate(place)
            shard = ((g >> U(20)) % U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            nodes, sizes_ = np.array(list(seen), np.int64), np.array(sizes, np.int32)
            rows = []
            for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if j > i:
                    k = order[i:j]
                    mine, local = np.unique(o[k], return_inverse=True)
                    rows.append({"shard": s, "grams": g[k].tobytes(), "of": local.astype("<i4").tobytes(), "place": at[k].tobytes(), "nodes": nodes[mine].tobytes(), "sizes": sizes_[mine].tobytes()})
            return pa.RecordBatch.from_pylist(rows, message)

        # several chunks go in one message, so that copies among them are sent once
        held: tuple = ({}, [], [], [], [])
        size = 0
        for _, buf, starts in B.text_chunks(batches):
            seen, sizes, grams, of, place = held
            for own in sets_of(buf, starts, n):
                node = node_of(own) if len(own) else None
                if node is None or node in seen:
                    continue
                seen[node] = len(seen)
                sizes.append(len(own))
                p = len(own) - -(-percent * len(own) // 100) + 1
                top = own[np.lexsort((own, often[(own >> U(64 - SKETCH_BITS)).astype(np.int64)]))[:p]]
                grams.append(top)
                of.append(np.full(len(top), seen[node], np.int32))
                place.append(np.arange(len(top), dtype=np.int32))
            size += len(buf)
            if size >= B.BLOCK_BYTES and seen:
                yield sent(*held)
                held, size = ({}, [], [], [], []), 0
        if held[0]:
            yield sent(*held)

    posting = pa.schema([("shard", pa.int32()), ("gram", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])

    def shared(t: pa.Table) -> pa.Table:
        """The n-grams of a shard that two nodes have."""
        g, node, size, place = [], [], [], []
        for m in t.to_pylist():
            of = np.frombuffer(m["of"], np.int32)
            g.append(np.frombuffer(m["grams"], np.int64))
            place.append(np.frombuffer(m["place"], np.int32))
            node.append(np.frombuffer(m["nodes"], np.int64)[of])
            size.append(np.frombuffer(m["sizes"], np.int32)[of])
        g, node, size, place = map(np.concatenate, (g, node, size, place))
        order = np.argsort(g, kind="stable")
        g, node, size, place = g[order], node[order], size[order], place[order]
        many = np.zeros(len(g), bool)
        many[1:] = g[1:] == g[:-1]
        many[:-1] |= many[1:]
        g, node, size, place = g[many], node[many], size[many], place[many]
        order = np.lexsort((node, g))
        g, node, size, place = g[order], node[order], size[order], place[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1])
        g, node, size, place = g[new], node[new], size[new], place[new]
        return pa.table([pa.array(np.full(len(g), t["shard"][0].as_py(), np.int32)), g, node, size, place], schema=posting)

    postings = written(docs.mapInArrow(prefixes, "shard int, grams binary, of binary, place binary, nodes binary, sizes binary").groupBy("shard").applyInArrow(shared, "shard int, gram long, node long, size int, place int"), "postings")
    pair = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("first", pa.int64())])
    reps = written(sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")

    def pairs_at(lo: int, hi: int):
        def pairs(t: pa.Table) -> pa.Table:
            g, node, size, place, comp = (t[k].to_numpy() for k in ("gram", "node", "size", "place", "component"))
            order = np.lexsort((node, size, g))
            g, node, size, place, comp = (x[order].astype(np.int64) for x in (g, node, size, place, comp))
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            heads = np.flatnonzero(new)
            count = np.diff(np.append(heads, len(g)))
            within = np.arange(len(g)) - np.repeat(heads, count)
            head = np.repeat(heads, count)
            # a group of one component, or with all its distances done, has nothing left
            least, most = np.minimum.reduceat(comp, heads), np.maximum.reduceat(comp, heads)
            live = np.flatnonzero(np.repeat((least != most) & (count > lo), count))
            out = []
            lag = lo
            while len(live) and lag < hi:
                live = live[within[live] >= lag]
                a, b = live - lag, live
                need = -(-percent * (size[a] + size[b]) // (100 + percent))
                ok = (comp[a] != comp[b]) & (100 * size[a] >= percent * size[b]) & (np.minimum(size[a] - place[a], size[b] - place[b]) >= need)
                out.append(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), node[head[a]]], axis=1)[ok])
                lag += 1
            if not out:
                return pair.empty_table()
            found = np.concatenate(out)
            order = np.lexsort(found.T[::-1])
            found = found[order]
            keep = np.ones(len(found), bool)
            keep[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
            return pa.table(list(found[keep].T), schema=pair)

        return pairs

    edge = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of a bundle's pairs those that link, as edges to the least node they connect."""
        if not left.num_rows or not right.num_rows:
            return edge.empty_table()
        buf, starts = B.text_buffer(left["text"])
        own = dict(zip(left["node"].to_pylist(), sets_of(buf, starts, n), strict=True))
        ranges = {k: np.bincount((v >> U(58)).astype(np.int64), minlength=64) for k, v in own.items()}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for u, v in zip(right["u"].to_pylist(), right["v"].to_pylist(), strict=True):
            a, b = own[u], own[v]
            need = -(-percent * (len(a) + len(b)) // (100 + percent))
            if np.minimum(ranges[u], ranges[v]).sum() < need:
                continue
            both = np.concatenate([a, b])
            both.sort()
            if int((both[1:] == both[:-1]).sum()) >= need:
                x, y = find(u), find(v)
                root[max(x, y)] = min(x, y)
        found = [(k, find(k)) for k in list(root) if find(k) != k]
        return pa.Table.from_pylist([{"u": u, "v": v} for u, v in found], edge)

    links = None
    known = None
    tried = None
    for lo, hi in zip(ROUNDS[:-1], ROUNDS[1:], strict=True):
        left = postings
        if known is not None:
            left = left.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
            # groups with more members than the distances done, and of more than one component
            open_ = left.groupBy("shard", "gram").agg(F.count("*").alias("many"), F.min("component").alias("a"), F.max("component").alias("b")).where((F.col("many") > lo) & (F.col("a") != F.col("b"))).select("shard", "gram")
            left = written(left.join(open_, ["shard", "gram"], "left_semi"), "open")
            if left.isEmpty():
                break
        else:
            left = left.withColumn("component", F.col("node"))
        pairs = left.groupBy("shard").applyInArrow(pairs_at(lo, hi), "u long, v long, first long").groupBy("u", "v").agg(F.min("first").alias("first"))
        if tried is not None:
            pairs = pairs.join(tried.select("u", "v"), ["u", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if pairs.isEmpty():
            continue
        parts = pairs.groupBy("first").agg(F.ceil(F.count("*") / BUNDLE_PAIRS).alias("parts"))
        bundled = pairs.join(parts, "first").select("u", "v", F.xxhash64("first", F.pmod(F.xxhash64("u"), "parts")).alias("bundle"))
        bundled = written(bundled, "bundled")
        need = bundled.select("bundle", F.explode(F.array("u", "v")).alias("node")).distinct()
        wanted = need.select("node").distinct().join(reps, "node")
        wanted = written(wanted, "wanted")
        small = wanted.count() <= BROADCAST_NODES
        texts = docs.join(F.broadcast(wanted) if small else wanted, "doc_id")
        texts = texts.join(need, "node").select("bundle", "node", "text")
        edges = texts.groupBy("bundle").cogroup(bundled.select("u", "v", F.expr("bundle + 0L").alias("bundle")).groupBy("bundle")).applyInArrow(verify, "u long, v long")
        links = written(edges if links is None else links.unionByName(edges), "links")
        known = written(components(links), "components")
    nodes = reps.withColumnRenamed("doc_id", "least")
    if known is not None:
        nodes = nodes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
        nodes = nodes.join(heads, "component").select("node", "component_id")
    else:
        nodes = nodes.select("node", F.col("least").alias("component_id"))
    out = sets.join(nodes, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of its component; rows with a null id stay.

    Of several rows with that id the one with the smallest hash of its text stays.
    """
    found = written(linked_components(docs, id_col=id_col, text_col=text_col, **how), "found")
    own = F.col(id_col).cast("long")

    def ids(rows: DataFrame, name: str) -> DataFrame:
        rows = written(rows.select(F.col("doc_id").alias("_id_of_" + name)), name)
        return F.broadcast(rows) if rows.count() <= BROADCAST_NODES else rows

    gone = ids(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    left = docs.join(gone, own == F.col("_id_of_gone"), "left_anti")
    again = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return left
    again = ids(again, "again")
    # the window's limit holds before its shuffle too, so an id with very many rows sends one from each task
    first = F.row_number().over(Window.partitionBy(own).orderBy(F.xxhash64(text_col)))
    nth = "_".join(["nth", *docs.columns])
    one = left.join(again, own == F.col("_id_of_again"), "left_semi").withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    return left.join(again, own == F.col("_id_of_again"), "left_anti").unionByName(one)


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Sets as lists, each pair that shares a shingle of both prefixes counted in full, components by a recursive walk.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: md5(array_to_string(w[i:i + 3], ' ')))) END AS s FROM d),
classes AS MATERIALIZED (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM g WHERE len(s) > 0 GROUP BY list_sort(s)),
u AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
f AS (SELECT x, count(*) AS many FROM u GROUP BY x),
r AS (SELECT u.rep, u.n, u.x, row_number() OVER (PARTITION BY u.rep ORDER BY f.many, u.x) AS k FROM u JOIN f ON f.x = u.x),
q AS (SELECT rep, n, x FROM r WHERE k <= n - ceil(0.85 * n)::BIGINT + 1),
c AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM q a JOIN q b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
l AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN classes x ON x.rep = c.a JOIN classes y ON y.rep = c.b
      WHERE 185 * len(list_intersect(x.s, y.s)) >= 85 * (len(x.s) + len(y.s))),
both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk AS (SELECT rep AS v, rep AS z FROM classes UNION SELECT both_.b, walk.z FROM walk JOIN both_ ON both_.a = walk.v),
m AS (SELECT v, min(z) AS component FROM walk GROUP BY v)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, coalesce(m.component, g.doc_id) AS component_id
FROM g LEFT JOIN classes k ON k.s = list_sort(g.s) LEFT JOIN m ON m.v = k.rep
"""
