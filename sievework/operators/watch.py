"""What editors and watchdogs count: first posts, triggers of a crisis, health of what is public, and the media a story shows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CRISIS_NAMES, CRISIS_LEAST, CRISIS_MINUTES, CRISIS_EVENTS = ["ایران", "تهران", "Iran"], 90, 30, 2
MEDIA_RANK = {"ORIGINAL_MEDIA": 0, "SOURCE_REFERENCE": 1}


def new_posts(publications: DataFrame, since: Column) -> DataFrame:
    """AGG-15: platform and how many stories' first SENT publication (least pub_id) was created since then; later sends, and edits of
    the first, add none."""
    first = publications.where(F.col("status") == "SENT").groupBy("story_id").agg(F.min(F.struct("pub_id", "platform", "created_at")).alias("p"))
    return first.where(F.col("p.created_at") >= since).groupBy(F.col("p.platform").alias("platform")).agg(F.count("*").alias("posts"))


def crisis_triggers(stories: DataFrame, events: DataFrame, as_of: Column, names: list[str] = CRISIS_NAMES, least: int = CRISIS_LEAST, minutes: int = CRISIS_MINUTES) -> DataFrame:
    """AGG-27: triggers (distinct events of importance or velocity with a story of the window that names home) and whether they make a crisis."""
    named = reduce(or_, [F.contains(F.coalesce("headline", F.lit("")), F.lit(n)) for n in names])
    fresh = stories.where((F.col("created_at") >= as_of - F.expr(f"INTERVAL {minutes} MINUTES")) & named).select("event_id").distinct()
    hit = events.where((F.col("importance") >= least) | (F.col("velocity") >= least)).join(fresh, "event_id", "left_semi")
    return hit.agg(F.count_distinct("event_id").alias("triggers")).select("triggers", (F.col("triggers") >= CRISIS_EVENTS).alias("crisis"))


def health(stories: DataFrame, base_url: str) -> DataFrame:
    """AGG-26: check, n and ok of the public stories (slug, lead, status, lifecycle): one pass, one row a check."""
    public = F.col("status").isin("PUBLISHED", "CORRECTED")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    counts = stories.agg(F.count_if(public).alias("a"), F.count_if(empty("slug")).alias("b"), F.count_if(empty("lead")).alias("c"), F.count_if((F.col("lifecycle") == "PROVISIONAL") & (F.col("status") == "PUBLISHED")).alias("d"))
    rows = [("published stories", F.col("a"), F.col("a") > 0), ("public base url", F.lit(int(bool(base_url))).cast("long"), F.lit(bool(base_url))), ("stories missing slug", F.col("b"), F.col("b") == 0), ("stories missing lead", F.col("c"), F.col("c") == 0), ("provisional live", F.col("d"), F.lit(True))]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), v.alias("n"), ok.alias("ok")) for n, v, ok in rows])))


def picked_media(assets: DataFrame) -> DataFrame:
    """SRT-08: each story's asset (asset_id, story_id, status, file_id, url, kind) to show: original before referenced, with a file id
    before without, videos last, the newest; those of another status, or with neither file id nor address, aren't shown."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p in MEDIA_RANK.items() for x in p]), F.col("status"))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = assets.where(rank.isNotNull() & (has("file_id") | has("url")))
    key = F.struct((-rank).alias("rank"), has("file_id").alias("held"), (F.coalesce("kind", F.lit("")) != "video").alias("photo"), F.col("asset_id"))
    return rows.groupBy("story_id").agg(F.max(key).alias("m")).select("story_id", "m.asset_id")
