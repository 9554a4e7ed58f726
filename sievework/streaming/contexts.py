"""Live contexts: each source's state, kept by key in a stream, with timers that end it.

What an item says (label, speaker, kind, topic words, marks of a second occurrence) is found by column expressions; the
keyed state is one context a source: whom a colon label named, of what kind and about what, until when.  The decisions are
those of ``stories.contexts``, so a stream fed in any cut of batches gives the rows of that query, as long as batches keep
the order of a source's items.  A context whose time is over is no longer inherited, and an event-time timer removes its
state.  State is in RocksDB and checkpointed with the offsets, so a restart goes on where the last whole batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sievework.functions import claims as C
from sievework.functions import rules as R
from sievework.functions.lexicon import PERSIAN, Lexicon
from sievework.operators.stories import HARD_TYPES, colon_label, explicit_speaker, prefix_item

TTL = 1800
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = StructType([StructField("speaker", StringType()), StructField("plain", StringType()), StructField("kind", StringType()), StructField("tokens", ArrayType(StringType())), StructField("until", LongType())])
RESULT = "source string, item_id long, decision string, reason string, inherited_speaker string"


def said(items: DataFrame, item_id: str, source: str, time: str, text: str, lex: Lexicon = PERSIAN) -> DataFrame:
    """What decides about each item, one row an item; the time keeps its name ``at``, for the watermark."""
    label, kind = colon_label(F.col(text)), R.event_type(F.col(text), lex)
    return items.select(
        F.col(source).cast("string").alias("source"), F.col(item_id).cast("long").alias("item_id"), F.col(time).cast("timestamp").alias("at"),
        prefix_item(F.col(text)).alias("prefix"), label.alias("label"), C.normalized(label).alias("label_plain"), R.event_type(label, lex).alias("label_kind"), R.event_tokens(label, lex).alias("label_tokens"),
        C.normalized(explicit_speaker(F.col(text))).alias("speaker"), kind.alias("kind"), R.event_tokens(F.col(text), lex).alias("tokens"), R.second_occurrence(F.col(text), lex).alias("second"),
        (C.claim_class(C.normalized(F.col(text)), lex.classes) == "QUOTE").alias("quote"), (F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("empty"),
    )


def decide(item: Any, context: tuple | None, ttl: int) -> tuple[str, str | None, str | None, tuple | None]:
    """Decision, reason, inherited speaker and the context after an item; a context is (speaker, plain speaker, kind, tokens, until)."""
    at = item.at_us
    if item.prefix and item.label is not None:
        return "PREFIX_STORED", None, None, (item.label, item.label_plain or "", item.label_kind, list(item.label_tokens), at + ttl * 1_000_000)
    if item.prefix:
        return "CONNECTIVE_FRAGMENT", None, None, context
    if item.empty or context is None or at >= context[4]:
        return "NO_CONTEXT", None, None, context
    speaker, plain, kind, tokens, _ = context
    named = item.speaker if isinstance(item.speaker, str) and item.speaker else None
    apart = not set(item.tokens) & set(tokens) and item.kind != kind
    if named and speaker and not (plain and (named in plain or plain in named)):
        reason = "EXPLICIT_NEW_SPEAKER"
    elif item.second:
        reason = "EVENT_BOUNDARY_MARKER"
    elif item.kind in HARD_TYPES and item.kind != kind:
        reason = "HARD_CATEGORY_SWITCH"
    elif apart and not (named is None and (item.quote or kind == "INTERVIEW")):
        reason = "CLEAR_TOPIC_CHANGE"
    else:
        return "INHERIT", None, speaker, context
    return "RESET", reason, None, None


class ContextState(StatefulProcessor):
    """One context a source; a timer at its end clears it."""

    def __init__(self, ttl: int = TTL) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.context = handle.getValueState("context", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        items = pd.concat(list(rows)).sort_values(["at_us", "item_id"])
        before = self.context.get() if self.context.exists() else None
        context, out = before, []
        for item in items.itertuples():
            item = item._replace(label=item.label if isinstance(item.label, str) else None)
            decision, reason, speaker, context = decide(item, context, self.ttl)
            out.append((key[0], item.item_id, decision, reason, speaker))
        if context is None:
            self.context.clear()
        elif context != before:
            self.context.update(context)
            self.handle.registerTimer(context[4] // 1000)
        yield pd.DataFrame(out, columns=["source", "item_id", "decision", "reason", "inherited_speaker"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.context.exists() and self.context.get()[4] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():  # not a newer label's
            self.context.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_contexts(stream: DataFrame, item_id: str, source: str, time: str, text: str, lex: Lexicon = PERSIAN, ttl: int = TTL, late: str = "1 day") -> DataFrame:
    """STR-05, SRC-07: source, item_id, decision, reason and inherited speaker of each item of a stream, as it comes.

    Items of a batch go in order of time and id.  Those later than the watermark (``late`` behind the newest) are dropped, as their
    state is gone; those without a source or time have no context and need none of this.
    """
    rows = said(stream, item_id, source, time, text, lex).where("source IS NOT NULL AND at IS NOT NULL").withColumn("at_us", F.unix_micros("at"))
    return rows.withWatermark("at", late).groupBy("source").transformWithStateInPandas(ContextState(ttl), RESULT, "append", "eventTime")


def run_to_end(rows: DataFrame, target: str, checkpoint: str) -> None:
    """All that a stream has by now, into a table with a folder a batch; a batch that runs again overwrites its own."""
    spark: SparkSession = rows.sparkSession
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)
