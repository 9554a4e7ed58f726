"""Evidence of claims: origins, relations, states; events over their claims; sources behind both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.rules import collapsed_origin

RELATIONS = ("SUPPORTS", "CONTRADICTS", "CONTEXT")


def origins(links: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG-10, JOIN-06: claim_id and the number of distinct origins among its supporting links."""
    named = links.where(F.col("relation") == "SUPPORTS").join(sources.select("source_id", "name", "identity"), "source_id")
    origin = collapsed_origin(F.col("identity"), F.col("lineage_key"), F.col("name"), F.col("source_id"))
    return named.groupBy("claim_id").agg(F.count_distinct(origin).alias("origins"))


def relation_counts(links: DataFrame) -> DataFrame:
    """AGG-11: links of each claim by relation, with zeros."""
    return links.groupBy("claim_id").agg(*[F.count(F.when(F.col("relation") == r, 1)).alias(r.lower()) for r in RELATIONS])


def claim_state(contradicted: Column, origins_: Column, risk: Column) -> Column:
    """OPS-01."""
    return F.when(contradicted, "CONFLICTING").when(origins_ >= 2, "CORROBORATED").when(risk == "high", "SINGLE_SOURCE").otherwise("UNVERIFIED")


def verified(claims: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """OPS-07: the claims with origins, whether contradicted, and state; a claim without links has no origin."""
    counts = relation_counts(links).select("claim_id", (F.col("contradicts") > 0).alias("contradicted"))
    rows = claims.join(origins(links, sources), "claim_id", "left").join(counts, "claim_id", "left")
    rows = rows.withColumns({"origins": F.coalesce("origins", F.lit(0)).cast("int"), "contradicted": F.coalesce("contradicted", F.lit(False))})
    return rows.withColumn("state", claim_state(F.col("contradicted"), F.col("origins"), F.col("risk")))


def publishable(states: DataFrame) -> DataFrame:
    """FLT-17: event_id, and why its claims forbid automatic publication (OK if they don't)."""
    high = (F.col("risk") == "high") & (F.col("state") == "SINGLE_SOURCE")
    reason = F.when(F.bool_or(F.col("state") == "CONFLICTING"), "CONFLICTING_CLAIMS").when(F.bool_or(high), "HIGH_RISK_SINGLE_SOURCE").otherwise("OK")
    return states.groupBy("event_id").agg(reason.alias("reason"))


def event_support(states: DataFrame) -> DataFrame:
    """AGG-24: each event's highest number of origins and how many claims are contradicted."""
    return states.groupBy("event_id").agg(F.max("origins").alias("most_origins"), F.count(F.when(F.col("contradicted"), 1)).alias("contradictions"))


def lifecycle(states: DataFrame) -> DataFrame:
    """OPS-13: CONFIRMED with a corroborated claim and no conflict, CONFLICTING with one, else PROVISIONAL."""
    conflict, sure = F.bool_or(F.col("state") == "CONFLICTING"), F.bool_or(F.col("state") == "CORROBORATED")
    return states.groupBy("event_id").agg(F.when(sure & ~conflict, "CONFIRMED").when(conflict, "CONFLICTING").otherwise("PROVISIONAL").alias("lifecycle"))


def main_claim(states: DataFrame) -> DataFrame:
    """OPS-12: the first corroborated claim of an event, else its first."""
    sure = F.min(F.when(F.col("state") == "CORROBORATED", F.col("claim_id")))
    return states.groupBy("event_id").agg(F.coalesce(sure, F.min("claim_id")).alias("main"))


def next_check(states: DataFrame) -> DataFrame:
    """OPS-05: the trigger of a claim's next check and its key; corroborated claims need none."""
    trigger = F.when(F.col("state") == "CONFLICTING", "contra").when(F.col("state").isin("UNVERIFIED", "SINGLE_SOURCE"), "ev")
    return states.where(trigger.isNotNull()).select("claim_id", "event_id", trigger.alias("trigger"), F.concat_ws(":", trigger, F.col("event_id"), F.col("claim_id")).alias("dedupe_key"))


def official(links: DataFrame, sources: DataFrame) -> DataFrame:
    """JOIN-07: claims with a link from an official source or a person's own statement."""
    known = sources.where(F.col("source_role").isin("OFFICIAL_PRIMARY", "PERSON_STATEMENT")).select("source_id")
    return links.join(known, "source_id", "left_semi").select("claim_id").distinct()


def lineages(links: DataFrame) -> DataFrame:
    """JOIN-08: distinct lineages of each claim, the source where there is none."""
    key = F.when(F.col("lineage_key") != "", F.col("lineage_key")).otherwise(F.concat(F.lit("src:"), F.col("source_id")))
    return links.groupBy("claim_id").agg(F.count_distinct(key).alias("lineages"))


def event_sources(claims: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Each event with the sources behind its claims."""
    return claims.select("claim_id", "event_id").join(links.select("claim_id", "source_id"), "claim_id").select("event_id", "source_id").distinct().join(sources, "source_id")


def identities(found: DataFrame) -> DataFrame:
    """JOIN-09: distinct identities of an event's sources, the name where there is none."""
    key = F.when(F.col("identity") != "", F.col("identity")).otherwise(F.col("name"))
    return found.groupBy("event_id").agg(F.count_distinct(key).alias("identities"))


def first_names(found: DataFrame, many: int = 3) -> DataFrame:
    """JOIN-11: an event's first names in order."""
    return found.groupBy("event_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, many), "|").alias("names"))


def policy(found: DataFrame) -> DataFrame:
    """JOIN-10, JOIN-12, FLT-15: how many breaking sources an event has, and whether one may publish by itself."""
    free = F.col("enabled") & (F.col("control_state") == "OWNER_ENABLED") & (F.col("publication_policy") == "AUTO")
    return found.groupBy("event_id").agg(F.count(F.when(F.col("breaking"), 1)).alias("breaking"), F.bool_or(free).alias("allowed"))
