r"""Target-distribution importance resampling with a dictionary of distinct features.

Method.  Features are all runs of one to three words.  Blocks of texts count their distinct features and send each
to the shard of the dictionary that its words hash to; a shard merges the strings of all blocks, counts them on both
sides (documents and target), hashes each distinct string once, and adds the counts up by bucket.  The sums of all
shards give each bucket's gain.  A block gets its features' buckets back, in the order in which it sent them, joins the gains
to them, and adds them up by document.  Weights plus Gumbel noise from a hash of the id draw without replacement.

How much moves.  A block sends a feature once, however often it has it, and a run of three words as its last word under the
pair before it.  All runs after a pair go to the pair's shard; where a pair has over a ``SPREAD``-th of a block's runs, that
block deals them over all shards (each then counts its own part, and sums by bucket stay exact).  Answers are two bytes
a feature.  Shards grow in number with the text; the driver holds one number a bucket.  Ranks are counted within ranges
of scores and shifted by the ranges' sizes, so no task orders all documents.

Blocks are made twice and have to come out alike, so the input must be read in the same order each time, as a table is; a
checksum tells if not.  A text over ``BLOCK_BYTES`` is cut between words, each piece with the next two words for its runs.

Defined results: a null or empty text, or one without words, has no features and weight 0.  Rows with a null id have no score
and aren't drawn, nor do they count among the documents drawn from, but their features count.  Repeated rows each get a
row and a rank.  Other columns are ignored.  An empty table gives an empty result; an empty target has no counts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import from_small_ints, give_back, small_ints, text_chunks
from .bytehash import U, mix, word_hashes
from .store import written

BUCKETS = 10_000
BLOCK_BYTES = 6 << 20
#: Text of a shard of the dictionary, about.
SHARD_BYTES = 6 << 20
SPREAD = 64
#: Rows ordered in one task, about.
RANKED = 1_000_000
#: Bytes that part words: all below 0x80 but digits and small letters.
PARTING = np.ones(256, bool)
PARTING[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
RESULT = "doc_id long, n_features long, weight long, score long, rank long"
_BLOCK = "block long, check long, ids array<bigint>, rows binary, own binary, lens binary, data binary"
_MESSAGE = "block long, check long, shard long, target boolean, data binary"
_ANSWER = "block long, check long, shard long, data binary, sums binary"
_WEIGHT = "row long, doc_id long, n_words long, n_features long, weight long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.strip().split(" ") for c in ddl.split(","))])


def _listed(strings: pa.LargeBinaryArray) -> list[bytes]:
    """The strings, none of which holds a line feed."""
    if not len(strings):
        return []
    ended = pc.binary_join_element_wise(strings, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    return ended.buffers()[2].to_pybytes().split(b"\n")[: len(strings)]


def _squeezed(*parts: bytes) -> bytes:
    head = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.ZstdCompressor(3).compress(head + b"".join(parts))


def _opened(raw: bytes, n: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    cuts = 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(data[: 4 * n], "<u4"), dtype=np.int64)])
    return [data[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


# Blocks


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int | None, bytes, int]]:
    """Row number, id, lower-case text and words of its own (-1: all) of each text, or of each piece of a long one."""
    row = TaskContext.get().partitionId() << 33
    for ids, buf, starts in text_chunks(batches):
        buf = LOWER[buf]
        for k, i in enumerate(ids.to_pylist()):
            text = buf[starts[k] : starts[k + 1]]
            if len(text) <= size:
                yield row, i, text.tobytes(), -1
            else:
                first, last, _ = _spans(text, np.array([0, len(text)]))
                at = 0
                while at < len(first) or at == 0:
                    to = min(len(first), max(at + 1, int(np.searchsorted(last, first[at] + size, side="right")))) if len(first) else 0
                    yield row, i, text[first[at] : last[min(to + 2, len(first)) - 1]].tobytes() if to else b"", to - at
                    at = to or 1
            row += 1


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict]:
    number, held, held_size = TaskContext.get().partitionId() << 32, [], 0

    def out() -> dict:
        rows, ids, texts, own = zip(*held, strict=True)
        lens = np.array([len(t) for t in texts], "<i8")
        own = np.array(own, "<i8")
        check = zlib.crc32(lens.tobytes(), zlib.crc32(str(ids).encode()))
        return {"block": number, "check": check, "ids": list(ids), "rows": np.array(rows, "<i8"), "own": own, "lens": lens, "data": b"".join(texts)}

    for piece in _pieces(batches, size):
        held.append(piece)
        held_size += len(piece[2]) + 64
        if held_size >= size:
            yield out()
            number, held, held_size = number + 1, [], 0
    if held:
        yield out()


def _spans(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer of texts, and the text of each."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = ~PARTING[buf]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    heads = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(buf))]  # a word ends where the next text starts
    begins[heads] |= inside[heads + 1]
    ends[heads - 1] |= inside[heads]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(np.searchsorted(first, starts)))


class _Features:
    """The distinct features of a block in order, and the ways between them, places in the text, and shards."""

    def __init__(self, block: dict, shards: int, places: bool = True):
        buf = np.frombuffer(block["data"], np.uint8)
        first, last, text = _spans(buf, np.concatenate([[0], np.cumsum(block["lens"])]))
        sizes = np.bincount(text, minlength=len(block["lens"]))
        own = np.where(block["own"] < 0, sizes, np.minimum(block["own"], sizes))
        self.n_words = own
        mine = np.ones(len(text), bool)
        if (own < sizes).any():
            mine = np.arange(len(first)) - (np.cumsum(sizes) - sizes)[text] < own[text]
        offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(buf[~PARTING[buf]])]).dictionary_encode()
        order = pc.sort_indices(words.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        known = words.dictionary.take(order)
        self.words = np.array([*_listed(known), None], object)[:-1]
        word = rank[words.indices.to_numpy()]
        bits = len(known).bit_length()
        below = (1 << bits) - 1
        edges = np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1] if len(known) else np.zeros(1, np.int64)
        h = word_hashes(np.frombuffer(known.buffers()[2] or b"", np.uint8), edges[:-1], edges[1:])
        at1 = np.flatnonzero(mine)
        at2 = np.flatnonzero(mine[:-1] & (text[1:] == text[:-1]))
        at3 = np.flatnonzero(mine[:-2] & (text[2:] == text[:-2]))
        counts = np.bincount(word[at1], minlength=len(known))
        one = np.flatnonzero(counts)
        number = np.cumsum(counts > 0) - 1
        two, inv2, cnt2 = np.unique(word[at2] << bits | word[at2 + 1], return_inverse=True, return_counts=True)
        inv2 = inv2.astype(np.int32)
        pair_at = np.zeros(len(word), np.int32)
        pair_at[at2] = inv2
        key3 = pair_at[at3].astype(np.int64) << bits | word[at3 + 2]
        if places:
            self.at = [text[at1], text[at2], text[at3]]
            three, inv3, cnt3 = np.unique(key3, return_inverse=True, return_counts=True)
            self.inverse = [number[word[at1]].astype(np.int32), inv2, inv3.astype(np.int32)]
        else:
            three, cnt3 = np.unique(key3, return_counts=True)
        self.counts = [counts[one], cnt2.astype(np.int32), cnt3.astype(np.int32)]
        del key3, pair_at, word, text, mine, at1, at2, at3, first, last, buf
        self.one, self.first, self.second = one, (two >> bits).astype(np.int32), (two & below).astype(np.int32)
        self.pair, self.third = (three >> bits).astype(np.int32), (three & below).astype(np.int32)
        del three
        n = len(two)
        hp = mix(h[self.first] * U(3) + h[self.second])
        home1, home2 = ((x % U(shards)).astype(np.int64) for x in (mix(h[one]), hp))
        home3 = home2[self.pair]
        hot = np.bincount(self.pair, minlength=n) > max(SPREAD, len(self.pair) // SPREAD)
        guests = np.zeros(0, np.int64)
        if shards > 1 and hot.any():
            spread = np.flatnonzero(hot[self.pair])
            home3[spread] = ((hp[self.pair[spread]] + mix(h[self.third[spread]])) % U(shards)).astype(np.int64)
            # pairs whose runs are dealt to a shard where they aren't at home: they count 0 there
            guests = np.unique((home3[spread] * n + self.pair[spread])[home3[spread] != home2[self.pair[spread]]])
        self.home2, self.pair_keys = home2, np.sort(np.concatenate([home2 * n + np.arange(n), guests]))
        small = np.uint16 if shards <= 1 << 16 else np.int64  # short numbers are sorted by radix
        self.order1, self.order3 = (np.argsort(x.astype(small), kind="stable") for x in (home1, home3))
        self.shard1, self.shard3 = home1[self.order1], home3[self.order3]
        self.shards = np.unique(np.concatenate([np.unique(self.shard1), np.unique(self.pair_keys // max(1, n)), np.unique(self.shard3)]))

    def of(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A shard's words, pairs and runs (as numbers of distinct ones), and which of the pairs are at home there."""
        i, j = np.searchsorted(self.shard1, [shard, shard + 1])
        n = len(self.home2)
        k, m = np.searchsorted(self.pair_keys, [shard * n, (shard + 1) * n])
        a, b = np.searchsorted(self.shard3, [shard, shard + 1])
        pairs = self.pair_keys[k:m] - shard * n
        return self.order1[i:j], pairs, self.order3[a:b], self.home2[pairs] == shard

    def message(self, shard: int) -> bytes:
        ones, pairs, runs, home = self.of(shard)
        say = lambda w: b"\n".join(self.words[w].tolist())
        lead = self.first[pairs]
        new = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])) if len(lead) else np.zeros(0, np.int64)
        thirds = np.bincount(np.searchsorted(pairs, self.pair[runs]), minlength=len(pairs))
        counts = [self.counts[0][ones], np.diff(np.append(new, len(lead))), np.where(home, self.counts[1][pairs], 0), thirds, self.counts[2][runs]]
        return _squeezed(say(self.one[ones]), say(lead[new]), say(self.second[pairs]), say(self.third[runs]), *map(small_ints, counts))


def _words(raw: bytes) -> pa.LargeBinaryArray:
    buf = np.frombuffer(raw, np.uint8)
    cut = np.concatenate([[-1], np.flatnonzero(buf == 10), [len(buf)]]) if len(buf) else np.zeros(1, np.int64)
    lens = np.diff(cut) - 1
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)), pa.py_buffer(buf[buf != 10])])


def _dictionary(rows: list[dict], buckets: int) -> list[dict]:
    """A shard: all blocks' strings merged and counted, each distinct one hashed once; sums by bucket and answers.

    Strings are equal if their words are, one by one; the CRC of a longer one goes on from that of the one before.
    """
    parts = [_opened(m["data"], 9) for m in rows]
    texts = [[_words(p[k]) for p in parts] for k in range(4)]
    c1, repeat, c2, after, c3 = ([from_small_ints(p[k]) for p in parts] for k in range(4, 9))
    words = pa.concat_arrays([w for t in texts for w in t]).dictionary_encode()
    number, sizes = words.indices.to_numpy().astype(np.int64), [sum(map(len, t)) for t in texts]
    one, lead, second, third = np.split(number, np.cumsum(sizes)[:-1])
    bits = len(words.dictionary).bit_length()
    below = (1 << bits) - 1
    del number, texts, parts
    lead = np.repeat(lead, np.concatenate(repeat))
    two, pair = np.unique(lead << bits | second, return_inverse=True)
    three, run = np.unique(np.repeat(pair, np.concatenate(after)) << bits | third, return_inverse=True)
    del lead, second, third
    text = _listed(words.dictionary)
    spaced = np.array([*(b" " + w for w in text), None], object)
    crc1 = np.fromiter(map(zlib.crc32, text), np.int64, len(text))
    crc2 = np.fromiter(map(zlib.crc32, spaced[two & below].tolist(), crc1[two >> bits].tolist()), np.int64, len(two))
    crc3 = np.fromiter(map(zlib.crc32, spaced[three & below].tolist(), crc2[three >> bits].tolist()), np.int64, len(three))
    hashed = [crc % buckets for crc in (crc1, crc2, crc3)]
    numbers, times = (one, pair, run), (c1, c2, c3)
    sums = np.zeros((2, buckets), np.int64)
    for mine, t, h in zip(numbers, times, hashed, strict=True):
        target = np.repeat([m["target"] for m in rows], list(map(len, t)))
        t = np.concatenate(t)
        for side in (0, 1):  # of each distinct string, among documents and in the target
            counts = np.bincount(mine[target == side], t[target == side], minlength=len(h)).astype(np.int64)
            np.add.at(sums[side], h, counts)
    cuts = [np.cumsum([0, *map(len, t)]) for t in times]
    out = []
    for i, m in enumerate(rows):
        if not m["target"]:
            mine = [h[x[c[i] : c[i + 1]][t[i] > 0]] for x, c, t, h in zip(numbers, cuts, times, hashed, strict=True)]
            data = np.concatenate(mine).astype("<u4" if buckets > 1 << 16 else "<u2")
            out.append({"block": m["block"], "check": m["check"], "shard": m["shard"], "data": _squeezed(data.tobytes()), "sums": None})
    return [*out, {"block": None, "check": None, "shard": rows[0]["shard"], "data": None, "sums": _squeezed(sums.tobytes())}]


def gains(sums: np.ndarray) -> np.ndarray:
    """Each bucket's gain from its counts among documents (row 0) and in the target (row 1)."""
    buckets = sums.shape[1]
    s_all, t_all = (float(x + buckets) for x in map(int, sums.sum(1)))
    return np.array([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in sums.T.tolist()], np.int64)


def _texts(df: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return df.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def weighted(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Each row's number, doc_id, words, features and weight: the sum of its features' gains (see _WEIGHT)."""
    docs, target = _texts(docs, id_col, text_col), _texts(target, None, target_text)
    size = sum(d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] for d in (docs, target))
    n = max(1, -(-size // shard_bytes))
    messages_schema, answers_schema, blocks_schema, weights_schema = map(_schema, (_MESSAGE, _ANSWER, _BLOCK, _WEIGHT))

    def sender(is_target: bool):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches, block_bytes):
                f = _Features(block, n, places=False)
                for s in f.shards.tolist():
                    yield pa.RecordBatch.from_pylist([{"block": block["block"], "check": block["check"], "shard": s, "target": is_target, "data": f.message(s)}], messages_schema)
            give_back()

        return send

    def dictionary(table: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist(_dictionary(table.to_pylist(), buckets), answers_schema)
        give_back()
        return out

    sent = docs.mapInArrow(sender(False), _MESSAGE).unionByName(target.mapInArrow(sender(True), _MESSAGE))
    answers = written(sent.groupBy("shard").applyInArrow(dictionary, _ANSWER), "buckets", free_shuffles=True)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(_opened(raw, 1)[0], np.int64).reshape(2, -1)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "s", "t"])

    parts = answers.where("sums IS NOT NULL").select("sums").mapInArrow(add, "bucket long, s long, t long")
    sums = np.zeros((2, buckets), np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # a row a bucket
        sums[:, r["bucket"]] = r["s"], r["t"]
    gain = gains(sums)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, block_bytes):
            yield pa.RecordBatch.from_pylist([b | {k: b[k].tobytes() for k in ("rows", "own", "lens")} | {"data": zstandard.ZstdCompressor(3).compress(b["data"])}], blocks_schema)
        give_back()

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1 or any(c != left.column("check")[0].as_py() for c in right.column("check").to_pylist()):
            raise ValueError("the input was not read in the same order twice; write it to a table first")
        b = left.to_pylist()[0]
        rows, own, lens = (np.frombuffer(b[k], "<i8") for k in ("rows", "own", "lens"))
        f = _Features({"own": own, "lens": lens, "data": zstandard.ZstdDecompressor().decompress(b["data"])}, n)
        if sorted(right.column("shard").to_pylist()) != f.shards.tolist():
            raise ValueError("the input was not read in the same order twice; write it to a table first")
        got = [np.zeros(len(c), np.int64) for c in f.counts]
        for m in right.select(["shard", "data"]).to_pylist():
            ones, pairs, runs, home = f.of(m["shard"])
            mine = gain[np.frombuffer(_opened(m["data"], 1)[0], "<u4" if buckets > 1 << 16 else "<u2")]
            pairs = pairs[home]
            got[0][ones], got[1][pairs], got[2][runs] = np.split(mine, [len(ones), len(ones) + len(pairs)])
        weight, count = np.zeros(len(lens)), np.zeros(len(lens), np.int64)
        for text, inverse, g in zip(f.at, f.inverse, got, strict=True):
            weight += np.bincount(text, g[inverse], minlength=len(lens))  # whole numbers below 2 ** 53
            count += np.bincount(text, minlength=len(lens))
        out = pa.table([pa.array(rows), pa.array(b["ids"], pa.int64()), pa.array(f.n_words), pa.array(count), pa.array(weight.astype(np.int64))], schema=weights_schema)
        give_back()
        return out

    replies = answers.where("data IS NOT NULL").select("block", "check", "shard", "data")
    pieces = docs.mapInArrow(pack, _BLOCK).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(weigh, _WEIGHT)
    sums_of = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    return pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums_of)  # a long text's pieces


def gumbel(seed: int, key: Column) -> Column:
    """Noise of an id: a Gumbel draw, in thousandths, from the first 32 bits of its hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, **how) -> DataFrame:
    """Each document's features, weight, score and rank among the drawn ones (see RESULT)."""
    rows = weighted(docs, target, **how)
    rows = written(rows.withColumn("score", (F.col("weight") + gumbel(seed, F.col("doc_id"))).cast("long")), "weights")
    fit = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    n = rows.where(fit).count()
    order = [F.col("score").desc(), F.col("doc_id")]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // RANKED)
    ranged = written(rows.where(fit).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = dict(sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect()))  # a row for RANKED documents
    before = np.cumsum([0, *sizes.values()]).tolist()
    shift = rows.sparkSession.createDataFrame(list(zip(sizes, before, strict=False)), "part int, before long")
    ranged = ranged.join(F.broadcast(shift), "part").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before"))
    ranked = ranged.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = rows.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (SELECT list(list_reduce(list_concat([i], range(0, 8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY i) AS crcs FROM range(0, 256) AS r(i)),
x AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, false AS target FROM documents),
d AS MATERIALIZED (SELECT r, doc_id, target, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
 FROM (SELECT * FROM x UNION ALL SELECT -1, NULL, text, true FROM benchmark) AS u),
f AS MATERIALIZED (SELECT r, target, array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT r, target, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k) AS s),
g AS (SELECT f, hex(encode(f)) AS h, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f GROUP BY f),
b AS MATERIALIZED (SELECT f, s, t, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, c: xor(crcs[((xor(a, c)) & 255) + 1], a >> 8))) % 10000 AS bucket FROM g, t),
c AS (SELECT bucket, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM b GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
w AS (SELECT f.r, sum(gain)::BIGINT AS weight, count(*) AS n FROM f JOIN b ON b.f = f.f JOIN gain ON gain.bucket = b.bucket WHERE NOT target GROUP BY f.r),
o AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, len(d.w) >= 20 AND d.doc_id IS NOT NULL AS fit,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w ON w.r = d.r WHERE NOT target),
p AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (fit) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM p
"""
