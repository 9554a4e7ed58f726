"""Live state and incremental sources: any cut of batches, restarts, and a crash between write and commit."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievework.operators import stories
from sievework.sources.channels import ChannelPreviews, messages_of, pending
from sievework.streaming import contexts

START = datetime(2024, 5, 1)
PREFIX, QUOTE = "ترامپ به مجله تایم:", "«این جنگ به زودی پایان می‌یابد و ما به توافق می‌رسیم»"
CASES = [
    ("a", 0, PREFIX, "PREFIX_STORED"), ("b", 2, QUOTE, "NO_CONTEXT"), ("a", 5, QUOTE, "INHERIT"), ("a", 10, "ترامپ گفت مذاکرات جدی است و ادامه دارد", "INHERIT"), ("a", 12, "در همین حال", "CONNECTIVE_FRAGMENT"),
    ("a", 15, "", "CONNECTIVE_FRAGMENT"), ("a", 1200, QUOTE, "INHERIT"), ("a", 1801, QUOTE, "NO_CONTEXT"), ("c", 30, PREFIX, "PREFIX_STORED"), ("c", 60, "نتانیاهو گفت جنگ تا نابودی حماس ادامه دارد", "RESET"), ("c", 70, QUOTE, "NO_CONTEXT"),
    ("d", 30, PREFIX, "PREFIX_STORED"), ("d", 40, "نتانیاهو:", "PREFIX_STORED"), ("d", 50, "حمله دوم به پایگاه در عراق رخ داد و تلفات داشت", "RESET"), ("e", 1, PREFIX, "PREFIX_STORED"), ("e", 16, "حمله موشکی به پایگاه آمریکایی در عراق رخ داد", "RESET"), ("e", 20, QUOTE, "NO_CONTEXT"),
]


def items(spark):
    rows = [(k, s, START + timedelta(seconds=t), text) for k, (s, t, text, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "item_id long, source string, at timestamp, text string")


def test_contexts_of_the_batch_query(spark):
    got = {r.item_id: r.decision for r in stories.contexts(items(spark), "source", ["at", "item_id"], "at", "text").collect()}
    assert got == {k: c[3] for k, c in enumerate(CASES)}


@pytest.mark.parametrize("cuts", [[17], [3, 5, 6, 11, 17], list(range(1, 18))])
def test_a_stream_in_any_cut_of_batches_gives_the_batch_query(spark, tmp_path, cuts):
    df = items(spark)
    want = sorted(tuple(r) for r in stories.contexts(df, "source", ["at", "item_id"], "at", "text").select("source", "item_id", "decision", "reason", "inherited_speaker").collect())
    folder, at = tmp_path / "in", 0
    for k, cut in enumerate(cuts):
        df.where(F.col("item_id").between(at, cut - 1)).coalesce(1).write.mode("append").parquet(str(folder))
        at = cut
        if k % 8 == 0 or cut == 17:  # a restart from the checkpoint each time
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
            contexts.run_to_end(contexts.live_contexts(stream, "item_id", "source", "at", "text"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).select("source", "item_id", "decision", "reason", "inherited_speaker")
    assert sorted(map(tuple, got.collect())) == want


def test_state_goes_when_its_time_is_over(spark, tmp_path):
    df = items(spark).where("item_id = 0")
    late = spark.createDataFrame([(90, "z", START + timedelta(days=3), "x"), (91, "z", START + timedelta(days=3, seconds=9), "x")], df.schema)
    folder = str(tmp_path / "in")
    spark.conf.set(*contexts.ROCKSDB)
    try:
        for part in (df, late.where("item_id = 90"), late.where("item_id = 91")):
            part.coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(df.schema).parquet(folder)
            contexts.run_to_end(contexts.live_contexts(stream, "item_id", "source", "at", "text", late="1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
        left = spark.read.format("statestore").option("stateVarName", "context").load(str(tmp_path / "state"))
        assert left.count() == 0
    finally:
        spark.conf.unset(contexts.ROCKSDB[0])


def block(channel, n):
    return f'<div class="tgme_widget_message js" data-post="{channel}/{n}"><div class="tgme_widget_message_text x">message {n}<br/>more &amp; more</div><time datetime="2024-05-01T00:{n % 60:02d}:00+00:00"></time></div>'


def preview(channel, before):
    """For tests: a channel of the messages 100 to 124 (more once a file says so), twenty a page."""
    flag = Path("/tmp") / "sievework-test-more"
    newest = 124 if channel == "burst" else 105
    newest += int(flag.read_text()) if flag.exists() and channel == "burst" else 0
    shown = [n for n in range(100, newest + 1) if before is None or n < before][-20:]
    return "".join(block(channel, n) for n in shown) or None


def test_pages_are_read_back_to_the_checkpoint():
    assert [m[1] for m in pending(preview, "burst", 0)] == list(range(100, 125))
    assert [m[1] for m in pending(preview, "burst", 119)] == [120, 121, 122, 123, 124]
    key, number, text, at = messages_of(preview("burst", None) * 2 + '<div data-post="burst/x">no text</div>')[0]
    assert (key, number, text) == ("burst/105", 105, "message 105\nmore & more") and at.minute == 45


class Crash(Exception):
    pass


def test_no_message_is_lost_or_doubled_by_a_burst_or_a_crash(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", f"{Path(__file__).parent}:{Path(__file__).parent.parent}")
    spark.dataSource.register(ChannelPreviews)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(crash):
        stream = spark.readStream.format("channel_previews").option("channels", "burst, @calm").option("fetch", "tests.test_live:preview").load()
        seen = []

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            seen.append(number)
            if crash and len(seen) == crash:
                raise Crash  # written, but never marked done

        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception):  # noqa: B017  whatever the crash is wrapped in
        run(1)
    run(0)
    got = [(r.channel, r.number) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted([("burst", n) for n in range(100, 125)] + [("calm", n) for n in range(100, 106)])
    first = [r.number for r in spark.read.parquet(f"{out}/batch=0").where("channel = 'burst'").collect()]
    assert sorted(first) == list(range(100, 120))  # twenty a pass, the oldest first
    run(0)
    assert spark.read.parquet(out).count() == 31
    one = spark.read.format("channel_previews").option("channels", "burst").option("start", '{"burst": 118}').option("fetch", "tests.test_live:preview").load()
    assert [r.number for r in one.orderBy("number").collect()] == [119, 120, 121, 122, 123, 124]
