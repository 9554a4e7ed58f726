"""What registries say, endpoints in one form, and keys of page views, on single cases."""

from pyspark.sql import functions as F

from sievework.operators import registry as R


def test_speed_and_trust(spark):
    speeds = {"": ("MID", 300), "Real-time": ("FAST", 120), "1–2 min": ("FAST", 120), "5 min": ("MID", 240), "5–15 min": ("SLOW", 600), "event-driven": ("EVENT", 1800), "30 min": ("SLOW", 900), "quick": ("MID", 240), None: ("MID", 300)}
    got = spark.createDataFrame([(t,) for t in speeds], "t string").select("t", R.speed(F.col("t")).alias("s")).collect()
    assert {r.t: (r.s.tier, r.s.seconds) for r in got} == speeds
    cases = [("Official", "No", "x", "OFFICIAL_PRIMARY", False, False), ("", "", "Government body", "OFFICIAL_PRIMARY", False, False), ("direct person", "Yes", "", "PERSON_STATEMENT", False, False), ("OSINT", "Yes", "", "OSINT_DATA", False, True), ("OSINT", "No", "", "OSINT_DATA", False, False), ("analysis", "Yes", "", "ANALYSIS", False, False), ("news", "No, same desk", "", "INDEPENDENT_NEWSROOM", False, False), ("news", "No", "", "INDEPENDENT_NEWSROOM", True, True), (None, None, None, "INDEPENDENT_NEWSROOM", True, True)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "n int, u string, i string, k string, role string, va boolean, ci boolean")
    for r in df.select("*", R.trust(F.col("u"), F.col("i"), F.col("k")).alias("t")).collect():
        assert (r.t.role, r.t.verification_allowed, r.t.can_increase) == (r.role, r.va, r.ci), r


def test_endpoints(spark):
    cases = {
        "@channel_1": ("telegram", "channel_1", "https://t.me/s/channel_1"), "https://t.me/s/chan4/": ("telegram", "chan4", "https://t.me/s/chan4"), "t.me/@chan4": ("telegram", "chan4", "https://t.me/s/chan4"), "@abc": None, "": None, None: None, "ftp://e.example/x": None, "just words": None,
        "https://e.example/feed": ("rss", "e.example", "https://e.example/feed"), "http://e.example:81/a.XML?x=1": ("rss", "e.example:81", "http://e.example:81/a.XML?x=1"), "https://e.example/page": ("website", "e.example", "https://e.example/page"), "http://localhost/x": None, "http://10.1.2.3/x": None, "http://172.20.0.1/": None, "http://172.40.0.1/": ("website", "172.40.0.1", "http://172.40.0.1/"), "http://[::1]/": None, "file:///etc/passwd": None,
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", R.endpoint(F.col("t")).alias("e")).collect()
    assert {r.t: tuple(r.e) if r.e else None for r in got} == cases
    handles = {"https://t.me/s/abc_1": "abc_1", "https://t.me/joinchat": "", "https://t.me/c/12345": "", "https://x.example": "", None: ""}
    got = spark.createDataFrame([(t,) for t in handles], "t string").select("t", R.channel_handle(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == handles


def test_an_import_again_changes_nothing(spark):
    schema = "entity string, name string, platform string, url string, language string, kind string, trust_use string, independent string, speed string, focus string"
    rows = spark.createDataFrame([("A ", "", "Telegram", "https://t.me/s/aaaa", "Persian", "", "news", "Yes", "2 min", "war"), ("A", "Second", "web", "https://a.example", None, "", "Official", "", "", None), ("", "x", "web", "https://b.example", "", "", "", "", "", ""), ("B", "b", "web", "", "", "", "", "", "", "")], schema)
    new = R.endpoint_rows(rows).withColumn("nth", F.monotonically_increasing_id())
    empty = new.where("false").drop("nth")
    one = R.imported(empty, new, "nth")
    two = R.imported(one, new, "nth")
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.select(one.columns).collect()), key=str) and one.count() == 2
    changed = R.imported(one, R.endpoint_rows(rows.withColumn("speed", F.lit("daily")).withColumn("name", F.lit("other"))).withColumn("nth", F.lit(0)), "nth").collect()
    assert {(r["name"], r.polling_seconds, r.speed_tier) for r in changed} == {("A", 1800, "EVENT"), ("Second", 1800, "EVENT")}


def test_view_keys(spark):
    cases = [("/", "", None, ("home", "-", "-|-|-")), (None, None, "s", ("home", "-", "s|-|-")), ("/story/a-slug/x", "https://ref.example/a/b", "", ("story:a-slug", "ref.example", "-|-|-")), ("/feed.xml", "app", None, ("rss", "app", "-|-|-")), ("/abc/def", "", None, ("page:abc", "-", "-|-|-")), ("//x", "", None, ("page:other", "-", "-|-|-"))]
    df = spark.createDataFrame([(k, p, r, s) for k, (p, r, s, _) in enumerate(cases)], "k int, p string, r string, s string")
    none = F.lit(None).cast("string")
    got = {r.k: tuple(r.v) for r in df.select("k", R.view_keys(F.col("p"), F.col("r"), F.col("s"), none, none).alias("v")).collect()}
    assert got == {k: c[3] for k, c in enumerate(cases)}
