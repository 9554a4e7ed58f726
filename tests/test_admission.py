"""Rolling caps against a plain loop, whatever the ranges; ledger and publish decisions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievework.operators import admission

START = datetime(2024, 1, 1)


def plain(rows, per_hour, most_hour, most_day):
    """(number, action, wait) of (number, key, at, story, payload, provisional), each channel in order of time."""
    out, posts, sent = [], {}, {}
    for number, key, at, story, payload, provisional in sorted(rows, key=lambda r: (r[1] or "", r[2] or START, r[0])):
        if key is None or at is None:
            out.append((number, "INVALID", None))
            continue
        day = [t for t in posts.setdefault(key, []) if t >= at - timedelta(days=1)]
        hour = [t for t in day if t >= at - timedelta(hours=1)]
        known = sent.setdefault((key, story), set())
        if known:
            out.append((number, "NOOP" if payload in known else "EDIT", None))
            known.add(payload)
        elif len(day) >= most_day:
            out.append((number, "THROTTLED", 3600))
        elif len(hour) >= min(per_hour[0 if provisional else 1], most_hour):
            out.append((number, "THROTTLED", int(max(60, min(3600, (at - day[0]).total_seconds() // 1))) if day else 300))
        else:
            out.append((number, "SEND", None))
            posts[key].append(at)
            known.add(payload)
    return sorted(out)


def requests(seed):
    rng = random.Random(seed)
    rows, at = [], START
    for n in range(900):  # bursts, quiet stretches, follow-ups of stories and rows of one time
        at += timedelta(seconds=rng.choice([0, 5, 40, 300, 900, 900, 9000 if n % 50 == 0 else 60, 200_000 if n % 300 == 0 else 60]))
        rows.append((n, rng.choice(["a", "a", "a", "b"]), at, str(rng.randint(n // 4, n // 3 + 3)), rng.choice("xyz"), rng.random() < 0.4))
    return rows + [(1000, None, START, "s", "x", False), (1001, "a", None, "s", "x", False), (1002, "c", START, None, None, None)]


@pytest.mark.parametrize("ranges", [10_000, 120, 17])
def test_caps_equal_a_plain_loop(spark, ranges):
    for seed, caps in ((1, ((2, 4), 4, 12)), (2, ((6, 12), 12, 120))):
        rows = requests(seed)
        df = spark.createDataFrame(rows, "number long, channel string, moment timestamp, story string, hash string, early boolean")
        got = admission.admitted_posts(df, "channel", "number", "moment", "story", "hash", "early", caps[0], caps[1], caps[2], range_rows=ranges).collect()
        want = plain(rows, *caps)
        assert sorted(map(tuple, got)) == want
        assert {a for _, a, _ in want} == {"SEND", "EDIT", "NOOP", "THROTTLED", "INVALID"}


def test_edits_take_no_room(spark):
    """Fifty updates of one story within the hour leave room for another story's post; an hour later it has aged out."""
    rows = [(0, "a", START, "one", "v0", False), *[(k, "a", START + timedelta(minutes=50, seconds=k), "one", f"v{k}", False) for k in range(1, 51)]]
    rows += [(60, "a", START + timedelta(minutes=55), "two", "w", False), (61, "a", START + timedelta(minutes=58), "three", "w", False), (62, "a", START + timedelta(minutes=61), "four", "w", False), (63, "a", START + timedelta(minutes=60), "five", "w", False)]
    df = spark.createDataFrame(rows, "number long, channel string, moment timestamp, story string, hash string, early boolean")
    got = {r.number: (r.action, r.retry_s) for r in admission.admitted_posts(df, "channel", "number", "moment", "story", "hash", "early", (1, 2), 2, 10).collect()}
    assert got[0][0] == "SEND" and all(got[k][0] == "EDIT" for k in range(1, 51))
    assert got[60][0] == "SEND" and got[61] == ("THROTTLED", 3480) and got[63] == ("THROTTLED", 3600) and got[62][0] == "SEND"
    assert admission.admitted_posts(df.where("false"), "channel", "number", "moment", "story", "hash", "early").count() == 0


def test_ledger(spark):
    old = spark.createDataFrame([(1, "t", "h", "FAILED", 2, "r1", "late", "d0", "d1"), (2, "t", "h", "SENT", 1, "r2", None, "d0", "d1")], "story_id int, platform string, payload_hash string, status string, attempt int, remote_id string, error string, created_at string, updated_at string")
    marks = spark.createDataFrame([(1, "t", "h", "FAILED", None, "again", "d2", 1), (1, "t", "h", "SENT", None, None, "d3", 2), (3, "t", "h", "PENDING", None, None, "d2", 3), (3, "t", "g", "SENT", "r9", None, "d4", 4)], "story_id int, platform string, payload_hash string, status string, remote_id string, error string, at string, nth int")
    got = sorted(map(tuple, admission.marked(old, marks).collect()))
    assert got == [(1, "t", "h", "SENT", 4, "r1", None, "d0", "d3"), (2, "t", "h", "SENT", 1, "r2", None, "d0", "d1"), (3, "t", "g", "SENT", 1, "r9", None, "d4", "d4"), (3, "t", "h", "PENDING", 1, None, None, "d2", "d2")]
    asked = spark.createDataFrame([(2, "t", "h"), (2, "t", "other"), (1, "t", "h")], "story_id int, platform string, payload_hash string")
    assert [tuple(r) for r in admission.already_sent(asked, old).collect()] == [(2, "t", "h")]


def test_what_holds_a_publish_job_back(spark):
    rows = [(True, False, "CONFIRMED", 500.0, "PAUSED"), (False, False, "CONFIRMED", 500.0, "CANCELLED_SOURCE_DISABLED"), (False, True, "CONFIRMED", 181.0, "STALE_SUPERSEDED"), (False, True, None, 181.0, "STALE_SUPERSEDED"), (False, True, "CONFIRMED", 180.0, None), (False, True, "PROVISIONAL", 500.0, None), (False, True, "CONFIRMED", None, None)]
    df = spark.createDataFrame(rows, "paused boolean, allowed boolean, lifecycle string, age double, want string")
    got = df.select("want", admission.held_back(*map(F.col, ("paused", "allowed", "lifecycle", "age"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
