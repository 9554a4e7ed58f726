"""Claims, streams and sources on small cases."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.sources import feeds
from sievework.streaming import events as S

A = "ارتش به پایگاه هوایی شهر تبریز حمله کرد"
CASES = [
    (A, "x", A, "x", "SAME_CLAIM", []),
    ("رئیس جمهور فردا سفر خود به عراق را آغاز می کند", "x", "رئیس جمهور فردا سفر خود به عراق آغاز می کند", "x", "SAME_CLAIM", []),
    (A, "x", A, "y", "POTENTIAL_CONTRADICTION", ["ACTOR_DIFFERS"]),
    ("دولت قیمت بنزین امسال افزایش خواهد داد", None, "دولت قیمت بنزین امسال افزایش نخواهد داد", None, "POTENTIAL_CONTRADICTION", ["NEGATION_DIFFERS"]),
    ("۱۰ کشته در تهران", None, "12 کشته در تهران", None, "POTENTIAL_CONTRADICTION", ["NUMBERS_DIFFER"]),
    ("باران در شیراز", None, "ممکن است باران در شیراز", None, "POTENTIAL_CONTRADICTION", ["CERTAINTY_DIFFERS"]),
    ("one two three", None, "four five six", None, "NEW_CLAIM", []),
    ("", None, None, None, "SAME_CLAIM", []),
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_compare(spark, case):
    a, x, b, y, decision, conflicts = case
    df = spark.createDataFrame([(a, x, b, y)], "a string, x string, b string, y string")
    none = F.lit(None).cast("string")
    df = df.select(C.claim(F.col("a"), F.col("x"), none).alias("a"), C.claim(F.col("b"), F.col("y"), none).alias("b"))
    got = df.select(C.compare(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert (got["decision"], got["conflicts"]) == (decision, conflicts)


def test_stream_drops_rows_read_again(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    stream = S.once_each(S.read_events(spark, str(tmp_path / "in"), schema), ["event_id"], late="1000 days")
    q = stream.writeStream.foreachBatch(S.append_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in events.collect())


def test_feed_registry_and_table(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>http://a/1</link><description>D</description><pubDate>Sat, 03 Oct 2026 10:00:00 +0000</pubDate></item><item><title>U</title><link>http://a/2</link><guid>g</guid><pubDate>never</pubDate></item></channel></rss>")
    got = {r["external_key"]: str(r["published_at"]) for r in feeds.read_feed(spark, str(tmp_path / "f.xml")).withColumn("published_at", F.col("published_at").cast("string")).collect()}
    assert got == {"http://a/1": "2026-10-03 10:00:00", "g": "None"}
    (tmp_path / "r.csv").write_text("name,platform,url,language,role,notes\nA,rss,http://a,fa,x,\nA,rss,http://a,fa,x,\n,rss,http://b,fa,x,\n")
    rows = feeds.read_registry(spark, str(tmp_path / "r.csv"))
    assert rows.count() == 1
    feeds.write_table(rows, str(tmp_path / "t"), ["platform"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
