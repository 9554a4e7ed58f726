"""Tables that change together, and digests of snapshots."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievework.operators import items, snapshots
from sievework.sources.bundle import Bundle, Conflict

SCHEMA = "source_id long, external_key string, url string, title string, text string, published_at timestamp"
AT = datetime(2024, 1, 1)


def some(spark, keys, text="text of {}"):
    return spark.createDataFrame([(1, k, f"https://e.example/{k}?utm_source=x", f"Title {k}", text.format(k), AT) for k in keys], SCHEMA)


def seen(b, version=None):
    return {n: sorted(r.item_key for r in b.read(n, version).collect()) for n in items.SCHEMAS}


def failing(column):
    def f(t):
        if t.endswith("bad"):
            raise RuntimeError("the task is lost")
        return t

    return F.udf(f, "string")(column)


def test_all_three_tables_or_none(spark, tmp_path, monkeypatch):
    b = items.bundle(spark, str(tmp_path / "b"))
    assert b.version() == 0 and seen(b) == {n: [] for n in items.SCHEMAS}
    items.insert_items(b, some(spark, ["a", "b", "a"]))
    before = seen(b)
    assert all(len(v) == 2 for v in before.values()) and len({str(v) for v in before.values()}) == 1
    with pytest.raises(Exception):  # noqa: B017  a task that fails for good
        items.insert_items(b, some(spark, ["c", "bad"]).withColumn("text", failing("external_key")))
    assert seen(b) == before and b.version() == 1
    for step in ("raw_items", "item_fingerprints", "item_revisions", "publish"):  # the driver goes after any phase

        def crash(*a, step=step, **k):
            raise KeyboardInterrupt(step)

        with monkeypatch.context() as m:
            if step == "publish":
                m.setattr(Bundle, "_publish", crash)
            else:
                schemas = dict(items.SCHEMAS)
                m.setattr(b, "schemas", {k: v for k, v in schemas.items() if k != step})
            with pytest.raises((KeyboardInterrupt, KeyError)):
                items.insert_items(b, some(spark, ["d"]))
        assert seen(b) == before and b.version() == 1
    items.insert_items(b, some(spark, ["b", "d"], "another {}"))
    after = seen(b)
    assert all(len(v) == 3 for v in after.values()) and seen(b, 1) == before
    texts = {r.external_key: r.text for r in b.read("raw_items").collect()}
    assert texts == {"a": "text of a", "b": "text of b", "d": "another d"}  # what is known is ignored
    assert {r.content_hash for r in b.read("item_fingerprints").collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in texts.values()}
    assert b.vacuum(keep=1) > 0 and seen(b) == after


def test_a_writer_that_lost_the_race_begins_again(spark, tmp_path):
    one, two = (items.bundle(spark, str(tmp_path / "b")) for _ in range(2))
    base = one.version()
    items.insert_items(two, some(spark, ["x"]))
    with pytest.raises(Conflict):
        one.commit(appended={"raw_items": some(spark, ["x"]).withColumn("item_key", F.lit("k"))}, base=base)
    assert len(one.read("raw_items").collect()) == 1
    real, raced = one.commit, []

    def late(**how):
        if not raced:
            raced.append(items.insert_items(two, some(spark, ["y"])))
        return real(**how)

    one.commit = late
    items.insert_items(one, some(spark, ["y", "z"]))
    assert sorted(r.external_key for r in one.read("raw_items").collect()) == ["x", "y", "z"] and one.version() == 3


def test_rows_of_a_commit_are_made_once(spark, tmp_path):
    """each of the three tables made its rows, and two of them the texts' hashes, anew."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(key):
        made.add(1)
        return f"text of {key}"

    b = items.bundle(spark, str(tmp_path / "b"))
    items.insert_items(b, some(spark, ["a", "b", "c"]).withColumn("text", text("external_key")))
    assert made.value == 3 and all(b.read(t).count() == 3 for t in items.SCHEMAS)
    assert not [p.name for p in (tmp_path / "b" / "_staged").iterdir() if p.name.startswith("rows-")]


def test_revisions_count_changes_only(spark, tmp_path):
    b = items.bundle(spark, str(tmp_path / "b"))
    items.insert_items(b, some(spark, ["a", "b"]))
    edits = spark.createDataFrame([(1, "a", "t", "text of a", 1), (1, "a", "t", "new", 2), (1, "a", "t", "NEW", 3), (1, "a", "t", "text of a", 4), (1, "nobody", "t", "x", 1)], "source_id long, external_key string, title string, text string, nth int")
    items.add_revisions(b, edits)
    items.add_revisions(b, edits.where("nth = 4"))
    got = sorted((r.rev_no, r.text) for r in b.read("item_revisions").collect())
    assert got == [(1, "text of a"), (1, "text of b"), (2, "new"), (3, "text of a")]


def test_digests(spark, tmp_path):
    rows = [(k, f"t{k % 7}", None if k % 5 else "") for k in range(200)] + [(3, "t3", None)] * 2
    df = spark.createDataFrame(rows, "k long, t string, u string")
    digest = lambda d: sorted(map(tuple, snapshots.digests(d, partitions=8).collect()))
    want = digest(df)
    assert want == digest(df.repartition(5).select("u", "k", "t").orderBy(F.desc("k"))) and sum(r[1] for r in want) == 202
    for changed in (df.where("k <> 9"), df.union(df.where("k = 3").limit(1)), df.withColumn("t", F.when(F.col("k") == 9, "x").otherwise(F.col("t"))), df.withColumn("u", F.when(F.col("k") == 10, F.lit(None)).otherwise(F.col("u")))):
        assert 1 <= snapshots.differences(snapshots.digests(df, partitions=8), snapshots.digests(changed, partitions=8)).count() <= 2
    by = snapshots.differences(snapshots.digests(df, F.col("t")), snapshots.digests(df.where("k <> 9"), F.col("t"))).collect()
    assert [tuple(r) for r in by] == [("t2", 29, 28)]
    snapshots.back_up({"a": df, "b": df.where("false")}, str(tmp_path / "backup"))
    restored = {"a": spark.read.parquet(str(tmp_path / "backup/a")), "b": df.where("false")}
    assert sorted(map(tuple, snapshots.check(restored, str(tmp_path / "backup"), {"b": 1}).collect())) == [("a", 202, 0, True), ("b", 0, 0, False)]
    restored["a"] = restored["a"].where("k <> 9")
    assert snapshots.check(restored, str(tmp_path / "backup")).where("NOT ok").first()["differing"] == 1
