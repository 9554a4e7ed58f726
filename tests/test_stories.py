"""Rules, contexts, bursts, claims and event matching on small cases, and against plain versions."""

import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.functions import rules as R
from sievework.functions import text as T
from sievework.functions.lexicon import EUROPEAN as LEX
from sievework.operators import ledger, stories
from sievework.plans import story_queries
from sievework.sources import feeds

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2026, 10, 3, 10)


def one(spark, make, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return row.select(make(*[F.col(f"c{k}") for k in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("HTTPS://News.Example:443/a/?utm_source=x&b=2&a=1#frag", "https://news.example/a?a=1&b=2"),
        ("http://n.example:8080/x y/é?q=%20z&fbclid=1", "http://n.example:8080/x%20y/%C3%A9?q= z"),
        ("http://n.example", "http://n.example/"),
        ("  no host ", "no host"),
        (None, ""),
        ("https://u@n.example/a*b~c//?k", "https://n.example/a%2Ab~c?k="),
    ],
)
def test_canonical_url(spark, given, want):
    assert one(spark, R.canonical_url, given) == want


def test_normal_forms(spark):
    assert one(spark, lambda t: T.content_hash(t), "تركیه … داد!") == one(spark, lambda t: T.content_hash(t), "ترکیه … داد!")
    assert one(spark, lambda t: T.normalized_title(t), "«a» - b… (c)") == "a b c"
    assert one(spark, T.normalized_for_hash, None) == "" and one(spark, T.nfkc, "ﬁ ①") == "fi 1"
    assert one(spark, R.press_numbers, "۱۲٬۵۰۰ and 7, 12,500") == ["12500", "7"]


@pytest.mark.parametrize("given, want", [("وزیر گفت که این کشور را در جنگ است", "fa"), ("قال الرئيس إن هذا في اليوم", "ar"), ("Россия", "ru"), ("plain words", "en"), ("12 !", "und"), (None, "und")])
def test_language(spark, given, want):
    assert one(spark, R.detected_language, given) == want


def test_gates_and_topics(spark):
    assert one(spark, lambda t: R.topic(t)["topic"], "قیمت دلار و فوتبال") == "CURRENCY"
    assert one(spark, lambda t: R.topic(t)["topic"], "football only") == "SPORT" and one(spark, lambda t: R.tier(R.topic(t)["weight"]), "oil prices") == "P1"
    assert one(spark, R.promotional, "در سایت ثبت نام کنید", "کازینو و جوایز") is True and one(spark, R.promotional, "خبر کازینو", "") is False
    assert one(spark, R.low_value, "گربه عجیب", "") is True and one(spark, R.low_value, "گربه در جنگ", "") is False
    assert [one(spark, R.materiality_floor, t, "") for t in ("ایران", "قطر", "x")] == [25, 45, 65]
    assert one(spark, lambda t: R.split_speaker(t)["speaker"], "Trump:\nsaid it") == "Trump"


def test_contexts_equal_a_state_machine(spark):
    turns = story_queries._turns(spark, SF)
    rows = turns.select("*", stories.prefix_item(F.col("text")).alias("prefix"), stories.colon_label(F.col("text")).alias("label"), stories.explicit_speaker(F.col("text")).alias("speaker"), R.event_type(F.col("text"), LEX).alias("kind"), R.event_tokens(F.col("text"), LEX).alias("tokens"), R.second_occurrence(F.col("text"), LEX).alias("second"), (C.claim_class(C.normalized(F.col("text")), LEX.classes) == "QUOTE").alias("quote")).collect()
    held, want = {}, {}
    for r in sorted(rows, key=lambda r: (r.channel, r["at"], r.conv_id, r.turn)):
        c, decision, speaker = held.get(r.channel), None, None
        if r.prefix:
            decision = "PREFIX_STORED" if r.label is not None else "CONNECTIVE_FRAGMENT"
            if r.label is not None:
                held[r.channel] = r
        elif not (r.text or "").strip() or c is None or (r["at"] - c["at"]).total_seconds() >= 1800:
            decision = "NO_CONTEXT"
        else:
            kind = one_kind(spark, c.label)
            apart = not set(r.tokens) & set(one_tokens(spark, c.label)) and r.kind != kind
            other = r.speaker and c.label and r.speaker not in c.label and c.label not in r.speaker
            hard = r.kind in stories.HARD_TYPES and r.kind != kind
            if other or r.second or hard or (apart and not (r.speaker is None and (r.quote or kind == "INTERVIEW"))):
                decision = "RESET"
                del held[r.channel]
            else:
                decision, speaker = "INHERIT", c.label
        want[r.conv_id, r.turn] = (decision, speaker)
    got = {(r.conv_id, r.turn): (r.decision, r.inherited_speaker) for r in story_queries.QUERIES["STR05_contexts"](spark, SF).collect()}
    assert got == want and {d for d, _ in want.values()} >= {"PREFIX_STORED", "NO_CONTEXT", "RESET"}


_kinds: dict = {}


def one_kind(spark, label):
    if label not in _kinds:
        _kinds[label] = (one(spark, lambda t: R.event_type(t, LEX), label), one(spark, lambda t: R.event_tokens(t, LEX), label))
    return _kinds[label][0]


def one_tokens(spark, label):
    one_kind(spark, label)
    return _kinds[label][1]


def items(spark, rows):
    return spark.createDataFrame([(k, s, t, T0 + datetime.timedelta(seconds=at) if at is not None else None) for k, (s, t, at) in enumerate(rows)], "id long, source long, text string, at timestamp")


def test_bursts(spark):
    rows = [(1, "مصاحبه ترامپ با مجله", 0), (1, "مصاحبه ترامپ ادامه", 30), (1, "مصاحبه درباره جنگ", 60), (2, "انفجار در تهران", 0), (2, "قیمت دلار بالا رفت", 20), (2, "قطعی اینترنت", 40), (3, "same words here", 0), (3, "same words here", 600), (4, "x y", None), (5, "same words here", 10)]
    got = {r.item_id: r.burst_id for r in stories.bursts(items(spark, rows), "id", "source", "at", "text").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}


def match(spark, new, old, minutes):
    df = spark.createDataFrame([(1, 10, 0, new, old, T0, T0 - datetime.timedelta(minutes=minutes))], "item_id long, event_id long, place int, n string, o string, x timestamp, y timestamp")
    none = F.lit(None).cast("string")
    pairs = df.withColumns({"a": stories.event_print(F.col("n"), none, F.col("x")), "b": stories.event_print(F.col("o"), none, F.col("y"))})
    return stories.matched_events(pairs).first()


def test_event_matching(spark):
    assert match(spark, "انفجار شدید در تهران", "انفجار در تهران شنیده شد", 20).decision == "ATTACH_EXISTING"
    r = match(spark, "حمله موشکی به شیراز", "حمله موشکی به تهران", 5)
    assert (r.decision, r.reason) == ("CREATE_NEW", "ALL_CANDIDATES_CONFLICT")
    assert match(spark, "مصاحبه وزیر", "وزیر اعلام کرد", 5).decision == "CREATE_NEW"
    assert match(spark, "انفجار در تهران", "انفجار در تهران", 200).decision == "CREATE_NEW"


def test_documents_meet_the_three_before_them_in_one_move(spark):
    """prints were made for both sides of a join, and one side's came three times."""
    df = story_queries.QUERIES["STR10_event_matches"](spark, SF)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_materiality(spark):
    def why(text, priors, kind="GENERAL", certainty="ASSERTED"):
        df = spark.createDataFrame([(text, kind, certainty, None, [(p, None) for p in priors])], "t string, k string, c string, l string, p array<struct<text:string,location:string>>")
        return df.select(stories.materiality(F.col("t"), F.col("k"), F.col("c"), F.col("l"), F.col("p")).alias("r")).first()["r"]

    assert why("هر چه", []) == ["FIRST_CLAIM"]
    assert why("25 کشته", ["10 کشته"], "CASUALTY") == ["NEW_NUMBERS"] and why("25 درصد", ["10"], "INTERNET") == []
    assert why("ارتش گفت", ["ارتش گفت"], certainty="ATTRIBUTED") == ["OFFICIAL_CONFIRMATION"]
    assert "STATUS_TRANSITION" in why("آتش‌بس برقرار شد", ["x"]) and "CORRECTION" in why("خبر تصحیح شد", ["x"])


def test_claims_against_earlier_ones(spark):
    got = {(r.conv_id, r.turn): (r.decision, r.met) for r in story_queries.QUERIES["JOIN30_claims_of_event"](spark, SF).collect()}
    from sievework.operators import claims

    turns = claims.with_claims(spark.read.parquet(f"{SF}/conversations.parquet"), "text", lex=LEX).select("conv_id", "turn", "claim")
    a, b = turns.alias("a"), turns.alias("b")
    at = lambda s: F.col(f"{s}.conv_id") * 100 + F.col(f"{s}.turn")
    pairs = a.join(b, (F.col("a.conv_id") % 20 == F.col("b.conv_id") % 20) & (at("b") < at("a"))).select("a.conv_id", "a.turn", at("b").alias("at"), C.compare(F.col("a.claim"), F.col("b.claim"))["decision"].alias("d"), (F.col("b.conv_id") % 20).alias("e")).collect()
    earlier = {}
    for r in pairs:
        earlier.setdefault((r.conv_id, r.turn), []).append((r["at"], r.d))
    for k, v in got.items():
        found = sorted(earlier.get(k, []))[:50]
        same, against = ([x for x in found if x[1] == d] for d in ("SAME_CLAIM", "POTENTIAL_CONTRADICTION"))
        first = (same or against or [(None, "NEW_CLAIM")])[0]
        assert v == (first[1], first[0])


def test_claims_of_one_event_are_dealt_out(spark):
    """F8: a task an event before, however many claims it had."""
    from sievework.operators import claims

    rows = [(1, k, f"minister number {k % 7} said nothing of the agreement") for k in range(60)]
    df = claims.with_claims(spark.createDataFrame(rows, "event long, at long, text string"), "text")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        got = stories.against_existing(df, "event", "at", 5, part_rows=10).select("at", "decision", "met", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.task for r in got}) > 1
    assert sorted((r["at"], r.decision, r.met) for r in got) == sorted(map(tuple, stories.against_existing(df, "event", "at", 5).select("at", "decision", "met").collect())) and len(got) == 60


def test_material_claims_meet_without_their_texts(spark):
    """every claim carried its event's texts, and each reason made their normal forms anew."""
    plan = story_queries.QUERIES["OPS02_materiality"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "text" not in plan[: plan.index("Aggregate")]


def test_channels_and_checkpoints(spark, tmp_path):
    html = "".join(f'<div class="m" data-post="ch/{k}"><div class="message_text x">no {k}<br>line</div><time datetime="2026-10-03T10:00:00+00:00"></time></div>' for k in range(100, 125))
    blocks = feeds.message_blocks(spark.createDataFrame([("p", html)], "page string, html string"))
    assert blocks.count() == 25 and blocks.first().text == "no 100\nline"
    seen, at = [], 0
    for _ in range(3):
        new = sorted(r.number for r in feeds.after_checkpoint(blocks, F.lit(at)).collect())
        seen += new
        at = max([at, *new])
    assert seen == list(range(100, 125)) and at == 124
    rows = spark.createDataFrame([("a & b", "s-1", "2026")], "h string, s string, p string")
    rows = rows.select(feeds.rss_item("http://x/", F.col("s"), F.col("h"), F.col("h"), F.col("p")).alias("item"), F.col("p").alias("published"))
    feeds.write_channel(rows, f"{tmp_path}/rss", "T", "http://x")
    assert "<title>a &amp; b</title><link>http://x/story/s-1</link>" in spark.read.text(f"{tmp_path}/rss").first()[0]
    feeds.append_metrics(rows, f"{tmp_path}/m")
    feeds.append_metrics(rows, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 2


def test_eviction_of_one_range_and_of_none(spark):
    df = spark.range(100).select("id", F.lit(10).alias("size"))
    assert sorted(r.id for r in ledger.evict(df, "id", "size", 300).collect()) == list(range(70))
    assert ledger.evict(df.where("false"), "id", "size", 300).count() == 0


def test_a_burst_keeps_its_words_as_a_set():
    """a long burst's words were sorted and copied for each of its items."""
    import time

    fold, began = stories.Bursts(180, 5), time.process_time()
    for k in range(1500):
        fold.step({"item_id": k, "at": k, "kind": "GENERAL_NEWS", "ref": "", "speaker": "", "second": False, "tokens": [f"w{k * 40 + j}" for j in range(40)]})
    again = stories.Bursts(180, 5, fold.state())
    assert isinstance(again.groups[0]["tokens"], set) and len(again.groups[0]["tokens"]) == 60_000 and again.state() == fold.state()
    assert time.process_time() - began < 10 and stories.BURST_ROWS <= 20_000


def test_bursts_of_a_source_that_never_falls_quiet(spark):
    import random
    from datetime import datetime, timedelta

    rng, at, rows = random.Random(3), datetime(2024, 1, 1), []
    texts = ["حمله موشکی به بغداد", "دلار در بازار تهران", "مصاحبه با وزیر", "حمله دوم به پایگاه", "قطعی اینترنت در شیراز", "خبر تازه از شهر", "ترامپ: صلح نزدیک است و ادامه دارد"]
    for k in range(400):
        at += timedelta(seconds=rng.choice([0, 5, 20, 60, 100, 170]))
        rows.append((k, rng.choice("aab"), at if k % 50 else None, rng.choice(texts) + rng.choice(["", " امروز", " نفت", " سازمان"])))
    df = spark.createDataFrame(rows, "id long, source string, at timestamp, text string")
    whole = sorted(map(tuple, stories.bursts(df, "id", "source", "at", "text").collect()))
    assert len({b for _, b in whole}) > 20 and len(whole) == 400
    for ranges in (90, 13):
        assert sorted(map(tuple, stories.bursts(df, "id", "source", "at", "text", range_rows=ranges).collect())) == whole
