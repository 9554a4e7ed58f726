"""Tables that are changed by keys, queues and their states, and decisions on publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DML-01: the table and the first new row of each key that it doesn't have."""
    return table.unionByName(_one_each(rows, keys, order).join(table.select(keys).distinct(), keys, "left_anti"))


def insert_or_replace(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DML-03: the last new row of each key takes the old one's place."""
    new = _one_each(rows, keys, order)
    return table.join(new.select(keys), keys, "left_anti").select(table.columns).unionByName(new.select(table.columns))


def add_counts(table: DataFrame, rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """DML-02: counts of new rows are added to those of the same keys."""
    return table.select(*keys, count).unionByName(rows.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def update_if_unchanged(table: DataFrame, changes: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """DML-06: a change (key, seen version, new value) is made where the version is still the one seen, and raises it."""
    new = changes.select(F.col(key).alias("_key"), F.col(version).alias("_seen"), F.col(value).alias("_new"))
    rows = table.join(new, (F.col(key) == F.col("_key")) & (F.col(version) == F.col("_seen")), "left")
    hit = F.col("_key").isNotNull()
    return rows.withColumns({value: F.when(hit, F.col("_new")).otherwise(F.col(value)), version: F.col(version) + hit.cast("int")}).select(table.columns)


def unexpired(table: DataFrame, until: str, as_of: Column) -> DataFrame:
    """DML-07: rows whose time isn't over; those without one stay."""
    return table.where(F.col(until).isNull() | (F.col(until) > as_of))


def evict(table: DataFrame, key: str, size: str, most: int, ranges: int = 64) -> DataFrame:
    """SRT-11: the oldest rows (least keys) beyond a total size; sums go by ranges of the key, so no task sorts all.

    Keys are distinct.
    """
    rows = table.select(key, size)
    bounds = rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    rows = rows.withColumn("_part", part)
    sums = {r["_part"]: r["s"] for r in rows.groupBy("_part").agg(F.sum(size).alias("s")).collect()}  # one row a range
    above, total = {}, 0
    for k in sorted(sums, reverse=True):
        above[k] = total
        total += sums[k]
    offset = F.element_at(F.create_map(*[F.lit(v) for pair in above.items() for v in pair]), F.col("_part")) if above else F.lit(0)
    upto = F.sum(size).over(Window.partitionBy("_part").orderBy(F.desc(key))) + offset
    return rows.withColumn("_upto", upto).where(F.col("_upto") > most).select(key)


def first_sent(publications: DataFrame) -> DataFrame:
    """JOIN-19, WIN-04: the first SENT publication of each story."""
    return publications.where(F.col("status") == "SENT").groupBy("story_id").agg(F.min(F.struct("pub_id", "platform", "created_at")).alias("p")).select("story_id", "p.*")


def last_sent(publications: DataFrame) -> DataFrame:
    """JOIN-28: the last SENT publication of each story."""
    return publications.where(F.col("status") == "SENT").groupBy("story_id").agg(F.max("pub_id").alias("pub_id"))


def resent(publications: DataFrame) -> DataFrame:
    """JOIN-23: publications of a story on a platform that has another remote id there."""
    many = publications.groupBy("story_id", "platform").agg(F.count_distinct("remote_id").alias("n")).where("n > 1")
    return publications.join(many, ["story_id", "platform"], "left_semi").select("pub_id")


def checkpoints(old: DataFrame, persisted: DataFrame) -> DataFrame:
    """STR-01: source_id and the highest id persisted; it never falls."""
    both = old.select("source_id", "checkpoint").unionByName(persisted.select("source_id", F.col("item_id").alias("checkpoint")))
    return both.groupBy("source_id").agg(F.max("checkpoint").alias("checkpoint"))


def admitted(items: DataFrame, published: str, activated: str) -> DataFrame:
    """STR-11, FLT-12: items with mode LIVE, or STORE_ONLY where they're older than their source's activation."""
    ok = F.col(activated).isNull() | F.coalesce(F.col(published) >= F.col(activated), F.lit(False))
    return items.withColumn("mode", F.when(ok, "LIVE").otherwise("STORE_ONLY"))


def stale(events: DataFrame, as_of: Column, minutes: int = 180) -> DataFrame:
    """FLT-14: confirmed events not seen for so long."""
    return events.where((F.col("lifecycle") == "CONFIRMED") & (F.col("last_seen") < as_of - F.expr(f"INTERVAL {minutes} MINUTES")))


def shares(sent: DataFrame, by: str) -> DataFrame:
    """AGG-12: how many first posts each identity has, and its share, by a sum over the few groups."""
    groups = sent.groupBy(by).agg(F.count("*").alias("n"))
    return groups.crossJoin(F.broadcast(groups.agg(F.sum("n").alias("total")))).select(by, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def diversity(share: Column, sample: Column, alternatives: Column, breaking: Column, soft: float = 0.25, hard: float = 0.45, least: int = 4) -> Column:
    """STR-21: DEFER where a source's share is over the soft limit and others wait, or over the hard one."""
    over = (share > hard) | ((share > soft) & alternatives)
    return F.when(breaking | (sample < least), "PASS").when(over, "DEFER").otherwise("PASS")


def publication_decision(held: Column, sent: Column, changed: Column, deferred: Column, waited_minutes: Column, cap: int = 20) -> Column:
    """STR-23, STR-24: HOLD, EDIT or NOOP of what is sent, DEFER up to a cap, else SEND."""
    return F.when(held, "HOLD").when(sent & changed, "EDIT").when(sent, "NOOP").when(deferred & (waited_minutes < cap), "DEFER").otherwise("SEND")


def deadline_action(status: Column, age_minutes: Column, limit: int = 60) -> Column:
    """STR-17: past the deadline what is sent gets a caution, what never was is archived."""
    return F.when(age_minutes < limit, "WAIT").when(status == "SENT", "CAUTION_EDIT").otherwise("ARCHIVE")


def rejection(error: Column) -> Column:
    """OPS-25."""
    return F.when(F.startswith(F.coalesce(error, F.lit("")), F.lit("BLOCKED_")), "SKIPPED").otherwise("FAILED")


def send_priority(correction: Column, tier: Column) -> Column:
    """SRT-03: 100 for corrections and 60 for others, and 10, 6, 3 or 0 by tier."""
    return F.when(correction, 100).otherwise(60) + F.when(tier == "P0", 10).when(tier == "P1", 6).when(tier == "P2", 3).otherwise(0)


def numeric_order(ids: Column) -> Column:
    """SRT-10: text ids by their number; those that are none come first."""
    return F.coalesce(ids.try_cast("bigint"), F.lit(0))
