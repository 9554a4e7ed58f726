"""Best-fit packing of token sequences.

Method.  Texts are encoded and cut into pieces of at most ``length`` ids.  Pieces are dealt at random
over partitions and packed by bounded-space online best fit: a fixed number of bins is open, an integer
used as a bitset has a bit for each free space that an open bin has, the lowest bit at or above a
piece's length names the best bin, and when a new bin would exceed the number the fullest closes first.
Each piece is placed as it comes and stays there.  A partition sends its pieces to the packer long ones
first, since few sequences are wanted and short ones then fill what long ones left: in the order of
arrival the same packer needs 0.8 to 1 % more sequences.  A partition gets so many pieces that its last
bins are a small share.

Encoding.  The vocabulary drops white space and joins nothing across it, so a text's ids are those of
its words (parted by the six ASCII white-space characters) in a row.  Each worker encodes a word once
while its table of words has room, and looks it up by a 64-bit hash afterwards.

Defined results: a null or empty text is the end id alone.  Rows with a null id are packed too, with a
null id.  Repeated rows are packed as often as they occur.  Other columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_chunks
from .bytehash import word_hashes, word_spans
from .store import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words a worker keeps the ids of; pieces a partition packs, about.
KEEP_WORDS = 1 << 20
PARTITION_PIECES = 1 << 17

_tables: dict[str, "WordTable"] = {}


class WordTable:
    """Ids of words by hash: sorted hashes, with where each word's ids lie in one array."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.counts, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words that aren't there; hashes are distinct and sorted."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int32, len(found))
        at = (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.uint32, int(counts.sum()))])
        slot = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.counts = (np.insert(old, slot, new) for old, new in ((self.hashes, hashes), (self.at, at), (self.counts, counts)))

    def encode(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text."""
        first, last, text = word_spans(buf, starts)
        hashes, one, number = np.unique(word_hashes(buf, first, last), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > KEEP_WORDS:
            self.clear()
        slot = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = slot < len(self.hashes)
        new[inside] = self.hashes[slot[inside]] != hashes[inside]
        if new.any():
            raw = buf.tobytes()
            self.learn(hashes[new], [raw[i:j].decode() for i, j in zip(first[one[new]].tolist(), last[one[new]].tolist(), strict=True)])
            slot = np.searchsorted(self.hashes, hashes)
        slot = slot[number]
        counts, at = self.counts[slot].astype(np.int64), self.at[slot]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(at - (ends - counts), counts) + np.arange(total)]
        return ids, np.bincount(text, counts, minlength=len(starts) - 1).astype(np.int64)


def word_table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, length: int = 2048, end_id: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of each text's ids with the end id after them (see PIECES; ``ids`` too if ``with_ids``)."""
    path = vocabulary or default_vocabulary()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(path)
        for keys, buf, starts in text_chunks(batches):
            ids, counts = words.encode(buf, starts)
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            each = -(-counts // length)
            text = np.repeat(np.arange(len(counts)), each)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * length
            size = np.minimum(counts[text] - start, length)
            at = np.cumsum(size) - size  # pieces lie in a row, as the texts do
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * i : 4 * (i + n)]) for i, n in zip(at.tolist(), size.tolist(), strict=True)]
            columns = [keys.take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def best_fit(lengths: list[int], size: int, open_bins: int) -> tuple[list[int], list[int]]:
    """The bin of each piece, by bounded-space best fit in the given order, and its offset there."""
    by_free: list[list[int]] = [[] for _ in range(size)]
    bits = opened = made = 0
    bins, offsets = [], []
    for need in lengths:
        fitting = bits >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            bin_ = by_free[free].pop()
            if not by_free[free]:
                bits &= ~(1 << free)
            opened -= 1
        else:
            if opened == open_bins:  # the fullest closes
                low = (bits & -bits).bit_length() - 1
                by_free[low].pop()
                if not by_free[low]:
                    bits &= ~(1 << low)
                opened -= 1
            bin_, free = made, size
            made += 1
        bins.append(bin_)
        offsets.append(size - free)
        left = free - need
        if left:
            by_free[left].append(bin_)
            bits |= 1 << left
            opened += 1
    return bins, offsets


def packed(pieces: DataFrame, length: int = 2048, open_bins: int = 1 << 16, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Pieces with the sequence each goes to and its offset there; all columns of the pieces stay."""
    n = pieces.count()
    # dealt by place too, so that repeated rows go to all partitions
    dealt = pieces.repartition(max(1, -(-n // partition_pieces)), F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()))
    dealt = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    names = pieces.columns

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        whole = pa.Table.from_batches(got)
        bins, offsets = best_fit(whole["length"].to_pylist(), length, open_bins)
        ids = np.array(bins, np.int64) + (TaskContext.get().partitionId() << 32)
        whole = whole.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))
        yield from whole.to_batches(max_chunksize=1 << 16)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.select(names).mapInArrow(fit, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, length: int = 2048, open_bins: int = 1 << 16, **how) -> DataFrame:
    """All texts packed into as few sequences of at most ``length`` ids as best fit finds."""
    return packed(written(token_pieces(docs, length, **how), "pieces"), length, open_bins)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
