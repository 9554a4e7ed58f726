"""Admission of posts under rolling caps, the publication ledger, and the decision of a publish job.

Only posts that were admitted count against a cap, so whether a request goes out depends on all before it: a fold in
time (``folds``) whose state is the times of the last day's posts and what was sent of stories that still get requests.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.folds import RANGE_ROWS, folded

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Posts an hour of provisional and of other stories, posts an hour and a day at most, seconds to a retry.
PROVISIONAL_HOUR, CONFIRMED_HOUR, MOST_HOUR, MOST_DAY = 6, 12, 12, 120
RETRY, RETRY_LEAST, RETRY_MOST = 300, 60, 3600

class Caps:
    """Rolling caps of one key: who is admitted, and what is remembered of it."""

    def __init__(self, provisional: int, confirmed: int, most_hour: int, most_day: int, state: list | None = None) -> None:
        self.hour = {True: min(provisional, most_hour), False: min(confirmed, most_hour)}
        self.day = most_day
        times, sent = state or ([], {})
        self.times, self.sent = deque(times), {s: set(p) for s, p in sent.items()}

    def state(self) -> list:
        """What a later request can depend on: times of the last day's posts, and payloads sent of stories that get more requests."""
        return [list(self.times), {s: sorted(p) for s, p in sorted(self.sent.items())}]

    def step(self, row: dict) -> tuple[int, str, int | None]:
        return row["number"], *self.decide(row["at"], row["story"], row["payload"], row["provisional"], row["more"])

    def decide(self, at: int, story: str, payload: str, provisional: bool, more: bool) -> tuple[str, int | None]:
        """SEND, EDIT or NOOP of a story sent before, or THROTTLED with the seconds to wait; more: whether the story has later requests."""
        while self.times and self.times[0] < at - DAY:
            self.times.popleft()
        known = self.sent.get(story)
        if known is not None:
            action, wait = ("NOOP" if payload in known else "EDIT"), None
        elif len(self.times) >= self.day:
            return "THROTTLED", RETRY_MOST
        elif sum(t >= at - HOUR for t in self.times) >= self.hour[provisional]:
            return "THROTTLED", int(max(RETRY_LEAST, min(RETRY_MOST, (at - self.times[0]) // 1_000_000))) if self.times else RETRY
        else:
            action, wait = "SEND", None
            self.times.append(at)
        if more:
            self.sent.setdefault(story, set()).add(payload)
        else:
            self.sent.pop(story, None)
        return action, wait


def admitted_posts(requests: DataFrame, key: str, order: str, at: str, story: str, payload: str, provisional: str, per_hour: tuple[int, int] = (PROVISIONAL_HOUR, CONFIRMED_HOUR), most_hour: int = MOST_HOUR, most_day: int = MOST_DAY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """STR-19: order, action and retry_s of each request: SEND, THROTTLED, or EDIT and NOOP of a story that went out before.

    Requests of a key go in order of time and ``order``, a number that no two share.  A post counts an hour and a day after
    its time, both ends included.  Requests without a key or time are INVALID.  A throttled request isn't asked again by itself.
    """
    rows = requests.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp_ltz")).alias("at"), F.col(order).cast("long").alias("number"), F.coalesce(F.col(story).cast("string"), F.lit("")).alias("story"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"), F.coalesce(F.col(provisional), F.lit(False)).alias("provisional"))
    timed = rows.where("key IS NOT NULL AND at IS NOT NULL")
    timed = timed.withColumn("more", F.lead("number").over(Window.partitionBy("key", "story").orderBy("at", "number")).isNotNull())
    make = lambda state: Caps(*per_hour, most_hour, most_day, state)
    done = folded(timed, "key", ["at", "number"], make, "number long, action string, retry_s long", range_rows)
    rest = rows.where("key IS NULL OR at IS NULL").select("number", F.lit("INVALID").alias("action"), F.lit(None).cast("long").alias("retry_s"))
    return done.unionByName(rest).withColumnRenamed("number", order)


def marked(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """OPS-22: the ledger after marks (story_id, platform, payload_hash, status, remote_id, error, at, nth), in order of ``nth``.

    A payload that the ledger lacks gets a row.  Each mark is an attempt; a remote id stays when a later mark has none; status,
    error and time are the last mark's, and an error that the last mark doesn't name is gone.
    """
    keys = ["story_id", "platform", "payload_hash"]
    last = F.max(F.struct("nth", "status", "error", "at")).alias("last")
    remote = F.max(F.when(F.col("remote_id").isNotNull(), F.struct("nth", "remote_id")))["remote_id"].alias("new_remote")
    new = marks.groupBy(*keys).agg(F.count("*").alias("marks"), last, remote, F.min("at").alias("first_at"))
    old = ledger.select(*keys, F.col("status").alias("old_status"), "attempt", F.col("remote_id").alias("old_remote"), F.col("error").alias("old_error"), "created_at", "updated_at")
    rows = old.join(new, keys, "full_outer")
    hit = F.col("marks").isNotNull()
    return rows.select(
        *keys, F.coalesce("last.status", "old_status").alias("status"), (F.coalesce("attempt", F.lit(0)) + F.coalesce("marks", F.lit(0))).cast("long").alias("attempt"), F.coalesce("new_remote", "old_remote").alias("remote_id"),
        F.when(hit, F.col("last.error")).otherwise(F.col("old_error")).alias("error"), F.coalesce("created_at", "first_at").alias("created_at"), F.coalesce("last.at", "updated_at").alias("updated_at"),
    )


def already_sent(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """OPS-22: requests whose payload of a story and platform is in the ledger as SENT."""
    return requests.join(ledger.where("status = 'SENT'").select("story_id", "platform", "payload_hash").distinct(), ["story_id", "platform", "payload_hash"], "left_semi")


def held_back(paused: Column, allowed: Column, lifecycle: Column, age_minutes: Column, most_age: int = 180) -> Column:
    """OPS-24: why a publish job stops before caps are asked, in this order; null if it doesn't."""
    stale = (F.coalesce(lifecycle, F.lit("CONFIRMED")) == "CONFIRMED") & (age_minutes > most_age)
    return F.when(paused, "PAUSED").when(~allowed, "CANCELLED_SOURCE_DISABLED").when(stale, "STALE_SUPERSEDED")


def publish_actions(requests: DataFrame, reason: Column, **columns) -> DataFrame:
    """OPS-24: each request's action: what holds it back, else what the caps say; what is held back isn't counted."""
    order = columns["order"]
    rows = requests.withColumn("_reason", reason)
    open_ = admitted_posts(rows.where("_reason IS NULL"), **columns)
    return open_.unionByName(rows.where("_reason IS NOT NULL").select(F.col(order).cast("long").alias(order), F.col("_reason").alias("action"), F.lit(None).cast("long").alias("retry_s")))
