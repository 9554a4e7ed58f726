"""First posts, crisis triggers, health and media on small cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sievework.operators import watch

NOW = datetime(2024, 5, 1, 12)


def test_edits_are_no_new_posts(spark):
    ago = lambda **k: NOW - timedelta(**k)
    rows = [(1, 1, "t", "SENT", ago(hours=10)), *[(k, 1, "t", "SENT", ago(minutes=5)) for k in range(2, 52)], (60, 2, "t", "SENT", ago(minutes=5)), (61, 3, "t", "FAILED", ago(minutes=5)), (62, 4, "s", "SENT", ago(hours=30))]
    df = spark.createDataFrame(rows, "pub_id int, story_id int, platform string, status string, created_at timestamp")
    since = lambda h: {r.platform: r.posts for r in watch.new_posts(df, F.lit(NOW - timedelta(hours=h))).collect()}
    assert since(1) == {"t": 1} and since(24) == {"t": 2} and since(48) == {"t": 2, "s": 1}


def test_a_crisis_takes_two_events(spark):
    stories = spark.createDataFrame([(1, "حمله به تهران", NOW), (1, "تهران دوباره", NOW), (2, "Iran talks", NOW - timedelta(minutes=29)), (3, "ایران", NOW - timedelta(minutes=31)), (4, "elsewhere", NOW), (5, None, NOW), (6, "ایران", NOW)], "event_id int, headline string, created_at timestamp")
    events = spark.createDataFrame([(1, 95, 0), (2, 0, 90), (3, 99, 99), (4, 99, 99), (5, 99, 99), (6, 89, 89)], "event_id int, importance int, velocity int")
    assert tuple(watch.crisis_triggers(stories, events, F.lit(NOW)).first()) == (2, True)
    assert tuple(watch.crisis_triggers(stories, events.where("event_id <> 2"), F.lit(NOW)).first()) == (1, False)
    assert tuple(watch.crisis_triggers(stories.where("false"), events, F.lit(NOW)).first()) == (0, False)


def test_health(spark):
    df = spark.createDataFrame([("PUBLISHED", "PROVISIONAL", "s", "l"), ("DRAFT", "CONFIRMED", "", None), ("CORRECTED", "CONFIRMED", None, "l")], "status string, lifecycle string, slug string, lead string")
    got = {r.check: (r.n, r.ok) for r in watch.health(df, "").collect()}
    assert got == {"published stories": (2, True), "public base url": (0, False), "stories missing slug": (2, False), "stories missing lead": (1, False), "provisional live": (1, True)}


def test_media(spark):
    rows = [(1, 1, "SOURCE_REFERENCE", "f", "u", "photo"), (2, 1, "ORIGINAL_MEDIA", "", "u", "video"), (3, 2, "ORIGINAL_MEDIA", None, "u", "photo"), (4, 2, "ORIGINAL_MEDIA", "f", "", "video"), (5, 3, "SOURCE_REFERENCE", "", "u", "video"), (6, 3, "SOURCE_REFERENCE", "", "u", "photo"), (7, 3, "SOURCE_REFERENCE", "", "u", "photo"), (8, 4, "BRANDED_FALLBACK", "f", "u", "photo"), (9, 5, "ORIGINAL_MEDIA", "", None, "photo"), (10, 6, "ORIGINAL_MEDIA", "f", "", None)]
    df = spark.createDataFrame(rows, "asset_id int, story_id int, status string, file_id string, url string, kind string")
    assert sorted(map(tuple, watch.picked_media(df).collect())) == [(1, 2), (2, 4), (3, 7), (6, 10)]
