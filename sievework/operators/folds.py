"""Folds in time: what each row of a key gives depends on all rows before it, by a small state.

Rows are cut into ranges of key and order that are folded at once, each from an empty state.  A range that begins within a
key is folded again from the state its predecessor ended with, until no state changes.  Where a state forgets where it
came from (a quiet stretch, a full window) few ranges are folded more than twice, however many rows a key has; after k rounds
the first k ranges are right in any case.  The driver holds a state a range.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.shared import shared_folder

#: Rows of a range, about.
RANGE_ROWS = 500_000


class Fold(Protocol):
    """The state of one key."""

    def step(self, row: dict) -> tuple:
        """What a row gives; changes the state."""

    def state(self) -> Any:
        """What later rows can depend on, as JSON has it."""


def folded(rows: DataFrame, key: str, order: list[str], make: Callable[[Any], Fold], result: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each row's result (``result``: its columns as DDL) by a fold of its key's rows in an order without ties.

    ``make`` gives a key's fold from a state, null for an empty one.  Rows without a key or an order take no part: leave them out.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // range_rows))
    path = shared_folder(spark, "fold")
    rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    table = spark.read.parquet(path)
    schema = spark.createDataFrame([], result).schema
    arrow = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[f.dataType.simpleString()]) for f in schema.fields])

    def run(known: dict[int, Any], ends: bool) -> Callable[[pa.Table], pa.Table]:
        def fold(t: pa.Table) -> pa.Table:
            t = t.sort_by([(c, "ascending") for c in (key, *order)])
            part, now, state, out = t.column("_part")[0].as_py(), None, None, []
            for batch in t.to_batches(max_chunksize=10_000):
                for row in batch.to_pylist():
                    if state is None or row[key] != now:
                        state = make(known.get(part) if state is None else None)
                        now = row[key]
                    given = state.step(row)
                    if not ends:
                        out.append(given)
            if ends:
                return pa.table({"part": pa.array([part], pa.int32()), "first": [t.column(key)[0].as_py()], "last": [now], "state": [json.dumps(state.state())]})
            return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        return fold

    known: dict[int, Any] = {}
    empty = make(None).state()
    if parts > 1:
        found, todo = {}, None
        while todo is None or todo:
            some = table if todo is None else table.where(F.col("_part").isin(sorted(todo)))
            kind = rows.schema[key].dataType.simpleString()
            for r in some.groupBy("_part").applyInArrow(run(known, True), f"part int, first {kind}, last {kind}, state string").collect():  # a row a range
                found[r["part"]] = r
            todo, ranges = set(), sorted(found)
            for before, p in zip(ranges, ranges[1:], strict=False):
                state = json.loads(found[before]["state"]) if found[p]["first"] == found[before]["last"] else empty
                if state != known.get(p, empty):
                    known[p] = state
                    todo.add(p)
    return table.groupBy("_part").applyInArrow(run(known, False), result)
