"""Substring dedup: words of long passages that an earlier document has too are removed.

Method.  A window is ``size`` consecutive words of one document.  First each block of documents counts
its distinct windows in a count-min sketch, sent as sorted cell numbers; the sketches of all blocks are
merged shard by shard of the key space, and each block learns which of its windows have an estimated
count of two or more.  An estimate is never too low, so no repeated window is lost.  A second pass
exactly groups those windows only, by two independent 64-bit hashes, and finds the smallest document in
which each starts.  A window is sent once per block however many of its documents hold it, so neither
pass gathers a hot passage in one task.

Defined results: a null or empty text has no words, loses none and keeps the hash of the empty text; so
does a text of fewer than ``size`` words, but with its words.  Rows whose id is null take no part.
Repeated ids count as one document for "a smaller doc_id" (equal ids never remove each other), each row
gets a result.  Other columns of the input are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from .bytehash import U, covered, mix, windows, word_hashes, word_spans

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
_MESSAGE = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_MESSAGES = "block long, shard long, a binary, b binary, c binary"
#: Windows a shard holds, about, and cells of a sketch row for each.
SHARD_WINDOWS = 1 << 21
CELLS_EACH = 4


def _read(row: dict, size: int):
    ids, starts, buf = B.unpack(row)
    first, last, text = word_spans(buf, starts)
    hashes = word_hashes(buf, first, last)
    at, h = windows(hashes, text, size)
    return ids, starts, buf, first, last, text, at, h


def _distinct(ids, text, at, h):
    """Distinct windows of a block: hashes, the smallest id of each, and for each place its window's number."""
    keys, number = np.unique(h, return_inverse=True)
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids[text[at]])
    return keys, least, number


def _sketch(keys: np.ndarray, n: int, width: int):
    """By shard: the keys' places in its list for each row of the sketch, and their cells, sorted."""
    shard = (keys % U(n)).astype(np.int64)
    rows = [(mix(keys + U(k + 1)) % U(width)).astype(np.int64) for k in range(2)]
    order = [np.lexsort((r, shard)) for r in rows]
    cuts = np.searchsorted(shard[order[0]], np.arange(n + 1))
    return shard, rows, order, cuts


def repeated_word_windows(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Each document with its numbers of words and of removed words, and what is kept (see RESULT).

    Remove each word covered by a window whose word sequence also starts in a document with a smaller
    id.  Kept words are joined by one space; ``kept_text`` is left out unless ``with_text``.
    """
    packed, _, total = B.pack_blocks(docs, id_col, text_col)
    n = max(1, -(-total // (2 * SHARD_WINDOWS)))  # a word takes about two packed bytes
    width = SHARD_WINDOWS * CELLS_EACH

    def sketch(row: dict) -> list[dict]:
        ids, _, _, _, _, text, at, h = _read(row, size)
        keys = np.unique(h)
        _, rows, order, cuts = _sketch(keys, n, width)
        return [{"block": row["block"], "shard": s, "a": B.cells_of(rows[0][order[0][i:j]]), "b": B.cells_of(rows[1][order[1][i:j]])} for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]

    def merge(messages: list[dict]) -> list[dict]:
        out = [{"block": m["block"], "shard": m["shard"]} for m in messages]
        for part in "ab":
            merged = np.zeros(width, np.uint8)
            for m in messages:  # a count stops at two, as it need be no higher
                cells, times = np.unique(B.cells_from(m[part]), return_counts=True)
                merged[cells] = np.minimum(merged[cells] + np.minimum(times, 2), 2)
            for m, o in zip(messages, out, strict=True):
                o[part] = np.packbits(merged[B.cells_from(m[part])] > 1).tobytes()
        return out

    def estimated(row: dict, answers: list[dict]):
        """What _read gives, the distinct windows, and which of them are estimated repeated."""
        read = _read(row, size)
        ids, text, at, h = read[0], read[5], read[6], read[7]
        keys, least, number = _distinct(ids, text, at, h)
        often = np.ones(len(keys), bool)
        _, _, order, cuts = _sketch(keys, n, width)
        for part, o in zip("ab", order, strict=True):
            seen = np.zeros(len(keys), bool)
            for m in answers:
                i, j = cuts[m["shard"]], cuts[m["shard"] + 1]
                seen[o[i:j]] = np.unpackbits(np.frombuffer(m[part], np.uint8), count=j - i) > 0
            often &= seen
        return read, keys, least, number, often

    def second_hash(read) -> np.ndarray:
        _, _, buf, first, last, text, _, _ = read
        return windows(word_hashes(buf, first, last, 1), text, size, 1)[1]

    def exact(row: dict, answers: list[dict]) -> list[dict]:
        read, keys, least, number, often = estimated(row, answers)
        if not often.any():
            return []
        other = np.zeros(len(keys), np.uint64)
        other[number] = second_hash(read)
        at = np.flatnonzero(often)
        shard = (keys[at] % U(n)).astype(np.int64)
        at = at[np.argsort(shard, kind="stable")]
        cuts = np.searchsorted(np.sort(shard), np.arange(n + 1))
        return [{"block": row["block"], "shard": s, "a": keys[at[i:j]].tobytes(), "b": other[at[i:j]].tobytes(), "c": B.small_ints(least[at[i:j]])} for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]

    def smallest(messages: list[dict]) -> list[dict]:
        sizes = [len(m["a"]) // 8 for m in messages]
        a, b = (np.frombuffer(b"".join(m[k] for m in messages), np.uint64) for k in "ab")
        least = np.concatenate([B.from_small_ints(m["c"]) for m in messages])
        order = np.lexsort((least, b, a))
        head = np.ones(len(a), bool)
        head[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        best = np.empty_like(least)
        best[order] = least[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        out, k = [], 0
        for m, size_ in zip(messages, sizes, strict=True):
            mine, global_ = least[k : k + size_], best[k : k + size_]
            lower = np.flatnonzero(global_ < mine)
            k += size_
            if len(lower):
                keys = np.frombuffer(m["a"], np.uint64)[lower]
                out.append({"block": m["block"], "shard": m["shard"], "a": keys.tobytes(), "b": None, "c": B.small_ints(global_[lower])})
        return out

    def result(row: dict, answers: list[dict]) -> list[dict]:
        ids, starts, buf, first, last, text, at, h = _read(row, size)
        keys, least, number = _distinct(ids, text, at, h)
        for m in answers:
            place = np.searchsorted(keys, np.frombuffer(m["a"], np.uint64))
            least[place] = np.minimum(least[place], B.from_small_ints(m["c"]))
        gone = covered(at[least[number] < ids[text[at]]], size, len(first))
        n_words = np.bincount(text, minlength=len(ids))
        n_gone = np.bincount(text[gone], minlength=len(ids))
        cuts = np.concatenate([[0], np.cumsum(n_words)])
        raw, out = buf.tobytes(), []
        for k in range(len(ids)):
            i, j = cuts[k], cuts[k + 1]
            keep = np.flatnonzero(~gone[i:j]) + i
            kept = b" ".join([raw[x:y] for x, y in zip(first[keep].tolist(), last[keep].tolist(), strict=True)])
            out.append({"doc_id": int(ids[k]), "n_words": int(n_words[k]), "n_removed": int(n_gone[k]), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode("utf-8", "replace") if with_text else None})
        return out

    sketches = B.send(packed, sketch, _MESSAGES, _MESSAGE)
    merged = B.shards(sketches, merge, _MESSAGES, _MESSAGE)
    candidates = B.answered(packed, merged, exact, _MESSAGES, _MESSAGE)
    lower = B.shards(candidates, smallest, _MESSAGES, _MESSAGE)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    out = B.answered(packed, lower, result, RESULT, schema)
    return out if with_text else out.drop("kept_text")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_word_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50, with_text=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM h) WHERE least < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM gone),
c AS (SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, coalesce(len(c.ps), 0) AS n, coalesce(c.ps, []) AS ps FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
e AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) a WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.doc_id = a.doc_id AND v.p = a.p) GROUP BY doc_id)
SELECT k.doc_id, len(k.w)::BIGINT AS n_words, k.n::BIGINT AS n_removed, sha256(coalesce(e.kept, '')) AS kept_sha256 FROM k LEFT JOIN e ON e.doc_id = k.doc_id
"""
