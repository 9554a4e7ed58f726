"""Claims of rows, and each against the one before it in its event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.operators.dedup import spread


def with_claims(df: DataFrame, text: str, actor: Column | None = None, location: Column | None = None, lex=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return spread(df).withColumn("claim", C.claim(F.col(text), none if actor is None else actor, none if location is None else location, lex))


def against_previous(df: DataFrame, event: str, order: str) -> DataFrame:
    """decision and conflicts of each row's claim against the previous one of its event; the first is a new claim."""
    before = F.lag("claim").over(Window.partitionBy(event).orderBy(order))
    found = df.withColumn("_before", before).withColumn("_found", F.when(F.col("_before").isNotNull(), C.compare(F.col("claim"), F.col("_before"))))
    return found.select(*df.columns, F.coalesce("_found.decision", F.lit("NEW_CLAIM")).alias("decision"), F.coalesce("_found.conflicts", F.array().cast("array<string>")).alias("conflicts"))
