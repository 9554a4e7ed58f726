"""Suffix-array dedup: bytes of strings of a given length that start more than once are removed.

Method.  Every window of ``size`` bytes has an anchor, its gram with the least hash; windows in a row
with one anchor form a run, and the bytes they cover are its context.  Equal windows have equal anchors,
so only runs with an anchor in common can share windows.  Blocks of documents send shards the anchors
and contexts they hold, distinct in the block.  A context met twice is repeated as a whole.  Contexts
whose anchor has others too, as at the edges of a shared passage, are sent as text, once each, and the
shard builds their suffix array: Larsson-Sadakane refinement in numpy (ranks by the first bytes, then
doubling, with a sort of groups still tied only), Kasai's common prefixes (in lanes of consecutive
places), and a window is repeated where the common prefix with a neighbour reaches ``size``.  An anchor
with very many contexts is split over several shards; these send the sorted hashes of their windows by
ranges, and a window met in two of the lists, found by binary search of one list in the other, is
repeated.  The prefilter by anchors loses nothing; it keeps the suffix arrays to text that may repeat.

Defined results: a null or empty text has no bytes, and the hash of none; a text under ``size`` bytes
stays whole.  Rows with a null id take no part.  Repeated ids and rows are separate documents.  Removal
may cut a character; as text, what is left of one is dropped.  Other columns are ignored.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks as B
from .bytehash import U, _table, byte_grams, stretch_hashes
from .store import written

GRAM = 64
#: Contexts of one anchor that go to one suffix array; more are split.
SPLIT = 20_000
#: Text of a block; a task holds some forty arrays of eight bytes for each of its bytes, at times.
BLOCK_BYTES = 1 << 20
#: Runs a shard holds, about.
SHARD_RUNS = 1 << 16
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
_MESSAGE = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_MESSAGES = "block long, shard long, part long, a binary, b binary, c binary, d binary"


def suffix_array(buf: np.ndarray, ends: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of each text in order of their first ``limit`` bytes at least (None: of all), and their ranks.

    ends: for each place where its text ends; a suffix stops there.  Larsson-Sadakane: a rank is the
    place of a group's first suffix; groups of one are settled and no longer sorted.  Equal suffixes are
    in order of their places.
    """
    n = len(buf)
    if limit is None:
        limit = int((ends - np.arange(n)).max(initial=0))
    place = np.arange(n)
    wide = np.zeros(n + 8, np.int64)
    wide[:n] = buf.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | np.where(place + k < ends, wide[k : k + n], 0)
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0))
    h = 7
    while h < limit:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)  # slots of the order in groups of two or more
        if not len(at):
            break
        who = order[at]
        then = np.minimum(who + h, n - 1)
        key = (rank[who] << 32) | np.where(who + h < ends[who], rank[then] + 1, 0)
        sub = np.argsort(key, kind="stable")
        order[at] = who[sub]
        key = key[sub]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head[at] = new
        rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
        h *= 2
    rank[order] = place
    return order, rank


def common_prefixes(buf: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray, limit: int, lane: int = 256) -> np.ndarray:
    """Kasai: for each slot of the order the length it shares with the slot before, ``limit`` at most.

    From one place of the text to the next the length falls by one at most, which holds for a full order
    only.  Lanes of consecutive places advance together; in a lane each place starts from the length of
    the one before.
    """
    n = len(buf)
    out = np.zeros(n, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = buf
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view("<u8").ravel()
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    for step in range(lane):
        live = starts + step < n
        starts, h = starts[live], h[live]
        i = starts + step
        slot = rank[i]
        j = order[np.maximum(slot - 1, 0)]
        most = np.minimum(np.minimum(ends[i] - i, ends[j] - j), limit)
        most[slot == 0] = 0
        h = np.minimum(np.maximum(h - 1, 0), most)
        go = np.flatnonzero(h < most)
        while len(go):
            x = eight[i[go] + h[go]] ^ eight[j[go] + h[go]]
            low = x & (~x + U(1))
            same = np.where(x == 0, 8, (np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64)) >> 3)
            h[go] = np.minimum(h[go] + same, most[go])
            go = go[(same == 8) & (h[go] < most[go])]
        out[slot] = h
    return out


def repeated_windows(buf: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of some texts, and for each slot whether it shares ``size`` bytes with the slot before."""
    order, rank = suffix_array(buf, ends)
    return order, common_prefixes(buf, ends, order, rank, size) >= size


def _runs(buf: np.ndarray, starts: np.ndarray, size: int):
    """Runs of a block: their first and last window, anchor hash and context hash."""
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    w = size - GRAM + 1
    if len(buf) < size:
        return none
    grams = byte_grams(buf, GRAM)
    n = len(grams)
    bits = max(1, int(n - 1).bit_length())
    key = (grams >> U(bits) << U(bits)) | np.arange(n, dtype=np.uint64)
    # the least of each w keys in a row, by running minima from both ends of stretches of w
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(buf) - size + 1
    anchor = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & U((1 << bits) - 1)).astype(np.int64)
    lens = np.diff(starts)
    whole = np.zeros(m + 1, np.int32)  # windows that lie in one text
    long = np.flatnonzero(lens >= size)
    whole[starts[long]] += 1
    np.subtract.at(whole, starts[long + 1] - size + 1, 1)
    at = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(at):
        return none
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at][1:] != anchor[at][:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    first, last = at[heads], at[np.append(heads[1:], len(at)) - 1]
    context = stretch_hashes(_table(1)[buf], first, last + size, 1)
    return first, last, grams[anchor[first]], context


def _by_shard(keys: np.ndarray, n: int):
    shard = (keys % U(n)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1))


def _joined(messages: list[dict], field: str, kind) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(m[field], kind) for m in messages]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _pairs(a: np.ndarray, b: np.ndarray):
    """Order by (a, b), and where a new a and a new pair begin in it."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new_a, new = np.ones(len(a), bool), np.ones(len(a), bool)
    new_a[1:] = x[1:] != x[:-1]
    new[1:] = new_a[1:] | (y[1:] != y[:-1])
    return order, new_a, new


def without_repeats(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", split: int = SPLIT) -> DataFrame:
    """The documents with all their columns, their texts cut to what is kept.

    The column named ``length_col``, if there is one, gets the new texts' lengths; rows with a null id stay
    as they are.
    """
    kept = B.free_name("_kept", docs.columns)
    whole = repeated_byte_strings(docs, size, id_col, text_col, split=split, carry=docs.columns).where(F.col(kept).isNotNull())
    new = {text_col: F.when(F.col(text_col).isNotNull(), F.col(kept))}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col(text_col).isNotNull(), F.length(kept)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)
    return whole.withColumns(new).select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def repeated_byte_strings(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, split: int = SPLIT, carry: list[str] | None = None) -> DataFrame:
    """Each document with its bytes, removed bytes and maximal removed runs, and what is kept (see RESULT).

    With ``carry``, its columns instead, and ``_kept`` (longer if a column has that name) for what is kept of the text.
    """
    if size < GRAM:
        raise ValueError(f"size must be {GRAM} at least")
    packed, _, total = B.pack_blocks(docs, id_col, text_col, BLOCK_BYTES, carry)
    n = max(1, total // (26 * SHARD_RUNS))

    def distinct(row: dict):
        ids, starts, buf = B.unpack(row)
        first, last, anchor, context = _runs(buf, starts, size)
        order, _, new = _pairs(anchor, context)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        one = order[heads]
        times = np.diff(np.append(heads, len(order)))
        by, cuts = _by_shard(anchor[one], n)
        return ids, starts, buf, first, last, number, one[by], times[by], by, cuts, anchor, context

    def census(row: dict) -> list[dict]:
        *_, one, times, _, cuts, anchor, context = distinct(row)
        return [{"block": row["block"], "shard": s, "a": anchor[one[i:j]].tobytes(), "b": context[one[i:j]].tobytes(), "c": np.packbits(times[i:j] > 1).tobytes()} for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]

    def judge(messages: list[dict]) -> list[dict]:
        a, of = _joined(messages, "a", np.uint64)
        b, _ = _joined(messages, "b", np.uint64)
        twice = np.concatenate([np.unpackbits(np.frombuffer(m["c"], np.uint8), count=len(m["a"]) // 8) for m in messages])
        order, new_a, new = _pairs(a, b)
        pair, group = np.cumsum(new) - 1, np.cumsum(new_a) - 1
        times = np.bincount(pair, 1 + twice[order])
        contexts = np.bincount(group[new])
        full, others = times[pair] > 1, contexts[group] > 1
        parts = -(-contexts[group] // split)
        status = np.zeros(len(a), np.int64)
        # 1: repeated as a whole; 2: send its text, one block does; from 4: the part it goes to, and how many
        within = pair - pair[np.flatnonzero(new_a)[group]]
        status[order] = full + 2 * (others & new) + 4 * (within % parts) + (parts << 32)
        return [{"block": m["block"], "shard": m["shard"], "a": B.small_ints(status[of == k])} for k, m in enumerate(messages)]

    def read(row: dict, answers: list[dict]):
        got = distinct(row)
        status = np.zeros(len(got[6]), np.int64)
        cuts = got[9]
        for m in answers:
            if m["part"] is None:
                status[cuts[m["shard"]] : cuts[m["shard"] + 1]] = B.from_small_ints(m["a"])
        return got, status

    def texts(row: dict, answers: list[dict]) -> list[dict]:
        (_, _, buf, first, last, _, one, _, _, cuts, anchor, context), status = read(row, answers)
        out = []
        for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            send = np.flatnonzero(status[i:j] & 2) + i
            part = (status[send] >> 2) & ((1 << 30) - 1)
            for p in np.unique(part):
                k = one[mine := send[part == p]]
                out.append({"block": row["block"], "shard": s, "part": int(p), "a": anchor[k].tobytes(), "b": context[k].tobytes(), "c": ((last[k] + size - first[k]) << 2 | (status[mine] & 1) | 2 * (status[mine] >> 32 > 1)).astype("<i4").tobytes(), "d": b"".join(buf[x:y].tobytes() for x, y in zip(first[k], last[k] + size, strict=True))})
        return out

    def search(messages: list[dict]) -> list[dict]:
        """The suffix array of a shard's contexts; answers, and lists of windows of split anchors."""
        a, of = _joined(messages, "a", np.uint64)
        b, _ = _joined(messages, "b", np.uint64)
        c, _ = _joined(messages, "c", np.int32)
        lens, known, parted = (c >> 2).astype(np.int64), c & 1 > 0, c & 2 > 0
        buf = np.frombuffer(b"".join(m["d"] for m in messages), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lens)])
        text = np.repeat(np.arange(len(lens)), lens)
        ends = starts[1:][text]
        order, same = repeated_windows(buf, ends, size)
        same = np.append(same, False)
        twice = np.zeros(len(buf), bool)
        twice[order[same[:-1] | same[1:]]] = True
        place = np.arange(len(buf))
        out = []
        hits = np.flatnonzero(twice & ~known[text])
        blocks = np.array([m["block"] for m in messages])[of]
        for block in np.unique(blocks[text[hits]]):
            at = hits[blocks[text[hits]] == block]
            out.append({"block": int(block), "shard": messages[0]["shard"], "part": -1, "a": a[text[at]].tobytes(), "b": b[text[at]].tobytes(), "c": (at - starts[text[at]]).astype("<i4").tobytes()})
        wanted = np.flatnonzero(parted[text] & (place + size <= ends) & ~twice)
        wanted = np.concatenate([wanted, order[np.flatnonzero(same[1:] & ~same[:-1])]]) if parted.any() else wanted
        wanted = wanted[parted[text[wanted]]]
        if len(wanted):  # each window of this part once, to be sought in the others' lists
            h = byte_grams(buf, size, 0)[wanted]
            g = byte_grams(buf, size, 1)[wanted]
            by, cuts = _by_shard(h, n)
            for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if j > i:
                    k = by[i:j][np.lexsort((g[by[i:j]], h[by[i:j]]))]
                    ref = np.stack([blocks[text[wanted[k]]].astype(np.uint64), a[text[wanted[k]]], b[text[wanted[k]]], (wanted[k] - starts[text[wanted[k]]]).astype(np.uint64)])
                    out.append({"block": None, "shard": s, "part": messages[0]["part"] << 32 | messages[0]["shard"], "a": h[k].tobytes(), "b": g[k].tobytes(), "c": ref.tobytes(), "d": twice[wanted[k]].tobytes()})
        return out

    def merge(messages: list[dict]) -> list[dict]:
        """Windows that two lists hold, by binary search of each in the others, joined and sorted."""
        a, of = _joined(messages, "a", np.uint64)
        b, _ = _joined(messages, "b", np.uint64)
        order, _, new = _pairs(a, b)
        heads = np.flatnonzero(new)
        several = np.diff(np.append(heads, len(a))) > 1
        table, tail = a[order][heads][several], b[order][heads][several]
        out: dict[int, list] = {}
        for m in messages:
            mine, more = np.frombuffer(m["a"], np.uint64), np.frombuffer(m["b"], np.uint64)
            lo, hi = np.searchsorted(table, mine), np.searchsorted(table, mine, side="right")
            hit = (hi > lo) & (tail[np.minimum(lo, len(tail) - 1)] == more) if len(table) else np.zeros(len(mine), bool)
            for k in np.flatnonzero((hi - lo) > 1):
                hit[k] = (tail[lo[k] : hi[k]] == more[k]).any()
            ref = np.frombuffer(m["c"], np.uint64).reshape(4, -1)[:, hit]
            for block in np.unique(ref[0]):
                out.setdefault(int(block), []).append(ref[1:, ref[0] == block])
        return [{"block": k, "shard": messages[0]["shard"], "part": -1, "a": r[0].tobytes(), "b": r[1].tobytes(), "c": r[2].astype("<i4").tobytes()} for k, v in out.items() for r in [np.concatenate(v, axis=1)]]

    def result(row: dict, answers: list[dict]) -> list[dict] | pa.Table:
        (ids, starts, buf, first, last, number, one, _, by, _, anchor, context), status = read(row, answers)
        full = np.zeros(len(by), bool)
        full[by] = status & 1 > 0
        edge = np.zeros(len(buf) + 1, np.int32)
        runs = np.flatnonzero(full[number]) if len(number) else np.zeros(0, np.int64)
        np.add.at(edge, first[runs], 1)
        np.subtract.at(edge, last[runs] + size, 1)
        found = [m for m in answers if m["part"] is not None]
        if found:
            keys = np.stack([np.concatenate([np.frombuffer(m[k], np.uint64) for m in found]) for k in "ab"])
            off = np.concatenate([np.frombuffer(m["c"], np.int32) for m in found])
            sort = np.lexsort((context[one], anchor[one]))
            both = np.rec.fromarrays([anchor[one][sort], context[one][sort]])
            lo = np.searchsorted(both, np.rec.fromarrays([keys[0], keys[1]], dtype=both.dtype))
            at = first[one[sort[lo]]] + off
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + size, 1)
        gone = np.cumsum(edge[:-1]) > 0
        raw, out = buf, []
        for k in range(len(ids)):
            i, j = starts[k], starts[k + 1]
            cut = gone[i:j]
            kept = raw[i:j][~cut].tobytes()
            spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
            out.append({"doc_id": int(ids[k]), "n_bytes": int(j - i), "n_removed": int(cut.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode("utf-8", "ignore") if with_text else None})
        if carry:
            table = B.from_stream(row["carried"]).append_column("_kept", pa.array([o["kept_text"] for o in out], pa.string()))
            return table.rename_columns([*carry, B.free_name("_kept", carry)])
        return out

    judged = written(B.shards(B.send(packed, census, _MESSAGES, _MESSAGE), judge, _MESSAGES, _MESSAGE), "judged")
    sent = B.answered(packed, judged, texts, _MESSAGES, _MESSAGE)
    searched = sent.groupBy("shard", "part").applyInArrow(lambda t: B.table(search(t.to_pylist()), _MESSAGE), _MESSAGES)
    searched = written(searched, "searched")
    merged = B.shards(searched.where("block IS NULL"), merge, _MESSAGES, _MESSAGE)
    answers = judged.unionByName(searched.where(F.col("block").isNotNull())).unionByName(merged)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    if carry:
        both = docs.select(carry).withColumn(B.free_name("_kept", carry), F.lit(None).cast("string")).schema
        return B.answered(packed, answers, result, both, to_arrow_schema(both))
    out = B.answered(packed, answers, result, RESULT, schema)
    return out if with_text else out.drop("kept_text")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_byte_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"), 200, with_text=False)


#: Texts as hexadecimal digits, two for each byte, so that every window is a string of digits.
ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400),
h AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS k FROM s),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS last FROM p GROUP BY doc_id),
e AS (SELECT p.doc_id, string_agg(substr(d.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.x ELSE e.kept || substr(d.x, 2 * k.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id
"""
