"""Texts packed into blocks, and rounds of packed messages between blocks and shards of a key space.

A block holds some megabytes of whole texts.  In a round every block sends each shard what it has of
the shard's keys, distinct within the block, and the shard answers each block.  So a key sends one
entry per block however many rows hold it, no task gathers a hot key's rows, and Spark moves a few
packed rows where it would else move one row for each key.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .store import kept

BLOCK_BYTES = 4 << 20
#: Text that is hashed at a time; a task holds some twenty arrays of eight bytes for each of its bytes.
CHUNK_BYTES = 1 << 20
BLOCK = "block long, n long, ids binary, lens binary, data binary, carried binary"


def free_name(name: str, columns: list[str]) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column of texts, null as empty, and where each text starts (and the last ends)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys (the first column), bytes and starts of about so many bytes of texts (the second) at a time."""
    for batch in batches:
        buf, starts = text_buffer(batch.column(1))
        k = 0
        while k < batch.num_rows:
            to = max(k + 1, int(np.searchsorted(starts, starts[k] + size, side="right")) - 1)
            yield batch.column(0).slice(k, to - k), buf[starts[k] : starts[to]], starts[k : to + 1] - starts[k]
            k = to
    give_back()


def give_back(forget: bool = True) -> None:
    """Return memory that the allocators of a reused worker keep from a task (or a group) that is done."""
    if forget:
        bytehash.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pack(block: int, ids: np.ndarray, starts: np.ndarray, buf: np.ndarray) -> dict:
    return {"block": block, "n": len(ids), "ids": ids.astype("<i8").tobytes(), "lens": np.diff(starts).astype("<i8").tobytes(), "data": zstandard.ZstdCompressor(3).compress(buf.tobytes())}


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts (one more than texts) and bytes of a block's texts."""
    lens = np.frombuffer(row["lens"], np.int64)
    starts = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=starts[1:])
    raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(starts[-1])))
    return np.frombuffer(row["ids"], np.int64), starts, np.frombuffer(raw, np.uint8)


def as_stream(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(t)
    return sink.getvalue().to_pybytes()


def from_stream(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def pack_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> tuple[DataFrame, int, int]:
    """The texts in blocks, dealt out by block and checkpointed; with the number of blocks and packed bytes.

    ``carried`` holds the columns named in ``carry``, as an Arrow stream.

    A block is numbered by the partition it was made in and its place there, which a rerun of the task
    repeats as long as the input is read in the same order (a table is).
    """
    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("data", pa.binary()), ("carried", pa.binary())])
    carry = carry or []

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, lens, parts, others, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
            row = pack(number, np.concatenate(ids), starts, np.concatenate(parts))
            return pa.RecordBatch.from_pylist([row | {"carried": as_stream(pa.Table.from_batches(others)) if carry else None}], schema)

        for batch in batches:
            keys = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            buf, starts = text_buffer(batch.column(1))
            k = 0
            while k < len(keys):
                to = max(k + 1, int(np.searchsorted(starts, starts[k] + block_bytes - size, side="right")) - 1)
                ids.append(keys[k:to])
                lens.append(np.diff(starts[k : to + 1]))
                parts.append(buf[starts[k] : starts[to]])
                others.append(batch.slice(k, to - k).select(range(2, batch.num_columns)))
                size += int(starts[to] - starts[k])
                k = to
                if size >= block_bytes // 2 and (k < len(keys) or size >= block_bytes):
                    yield out()
                    number += 1
                    ids, lens, parts, others, size = [], [], [], [], 0
        if ids:
            yield out()
        give_back()

    # rows without an id go before columns are put side by side: a carried one may have any name
    rows = docs.where(F.col(id_col).cast("long").isNotNull())
    packed = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_carried_{k}") for k, c in enumerate(carry)]).mapInArrow(make, BLOCK)
    n = max(8, docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    packed = kept(packed.repartition(n, "block"))
    blocks, size = packed.agg(F.count("*"), F.coalesce(F.sum(F.expr("aggregate(array(length(data)), 0L, (a, x) -> a + x)")), F.lit(0))).first()
    return packed, blocks, size


def send(blocks: DataFrame, f: Callable[[dict], list[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """What each block sends: f(block) lists the rows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = f(batch.slice(k, 1).to_pylist()[0])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
        give_back()

    return blocks.mapInArrow(go, schema)


def shards(messages: DataFrame, f: Callable[[list[dict]], list[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """What each shard answers: f(the messages it got)."""

    def go(t: pa.Table) -> pa.Table:
        out = table(f(t.to_pylist()), arrow)
        give_back(forget=False)
        return out

    return messages.groupBy("shard").applyInArrow(go, schema)


def answered(blocks: DataFrame, answers: DataFrame, f: Callable[[dict, list[dict]], list[dict] | pa.Table], schema, arrow: pa.Schema) -> DataFrame:
    """What each block makes of its answers: f(block, answers); blocks are dealt out by block already."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        got = f(rows[0], right.to_pylist()) if rows else []
        out = got if isinstance(got, pa.Table) else table(got, arrow)
        give_back()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(go, schema)


def cells_of(sorted_cells: np.ndarray) -> bytes:
    """Sorted integers as gaps, of two bytes each where all fit, with larger ones split by full steps."""
    gaps = np.diff(sorted_cells.astype(np.int64), prepend=0)
    kind = "<u1" if len(gaps) and gaps.max() < 1 << 8 else "<u2" if not len(gaps) or gaps.max() < 1 << 16 else "<u4" if gaps.max() < 1 << 32 else "<u8"
    return kind[-1].encode() + gaps.astype(kind).tobytes()


def cells_from(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw[1:], f"<u{raw[:1].decode()}").astype(np.int64))


def small_ints(x: np.ndarray) -> bytes:
    """Integers as distances from the least, in as few bytes each as the largest needs."""
    low = int(x.min()) if len(x) else 0
    span = int(x.max()) - low if len(x) else 0
    kind = next(k for k in ("1", "2", "4", "8") if span < 1 << (8 * int(k) - (k == "8")))
    return kind.encode() + low.to_bytes(8, "little", signed=True) + (x - low).astype(f"<u{kind}").tobytes()


def from_small_ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[9:], f"<u{raw[:1].decode()}").astype(np.int64) + int.from_bytes(raw[1:9], "little", signed=True)
