"""Publishing: caps, ledger and decisions on events seen as publish requests, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import admission, watch
from sievework.sources import newsroom

#: Caps of the queries: an hour of provisional and of other stories, an hour and a day in all.
CAPS = {"per_hour": (1, 3), "most_hour": 2, "most_day": 30}


def _requests(spark, sf_dir):
    """Events as requests to publish: eight channels, neighbouring events of a channel tell one story."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (F.col("user_id") % 8).alias("channel"), "ts", (F.col("event_id") / 9).cast("long").alias("story"), "event_type", (F.col("value") > 30).alias("provisional"), "user_id", "value")


_COLUMNS = {"key": "channel", "order": "event_id", "at": "ts", "story": "story", "payload": "event_type", "provisional": "provisional"}


def _caps(spark, sf_dir):
    return admission.admitted_posts(_requests(spark, sf_dir), **_COLUMNS, **CAPS)


def _decisions(spark, sf_dir):
    s = newsroom.sources(spark, sf_dir).select(F.col("source_id").alias("user_id"), (F.col("enabled") & (F.col("control_state") == "OWNER_ENABLED") & (F.col("publication_policy") == "AUTO")).alias("allowed"))
    rows = _requests(spark, sf_dir).join(s, "user_id", "left")
    lifecycle = F.when(F.col("provisional"), "PROVISIONAL").otherwise("CONFIRMED")
    reason = admission.held_back(F.col("channel") == 5, F.coalesce("allowed", F.lit(True)), lifecycle, F.col("value") * 10)
    return admission.publish_actions(rows, reason, **_COLUMNS, **CAPS)


def _ledger(spark, sf_dir):
    """Publications of stories as marks of two payloads, upon a ledger of the first payload of every third story."""
    p = newsroom.publications(spark, sf_dir)
    payload = (F.col("pub_id") % 2).cast("string")
    error = F.when(F.col("status") == "FAILED", F.concat(F.lit("e"), F.col("pub_id") % 10))
    marks = p.select("story_id", "platform", payload.alias("payload_hash"), "status", F.when(F.col("status") == "SENT", F.col("remote_id")).alias("remote_id"), error.alias("error"), F.col("created_at").alias("at"), F.col("pub_id").alias("nth"))
    old = p.where("story_id % 3 = 0").select("story_id", "platform", F.lit("0").alias("payload_hash")).distinct()
    zero = F.to_date(F.lit("1990-01-01"))
    old = old.select("*", F.lit("PENDING").alias("status"), F.lit(1).alias("attempt"), F.lit("r0").alias("remote_id"), F.lit("old").alias("error"), zero.alias("created_at"), zero.alias("updated_at"))
    return admission.marked(old, marks)


def _stories(spark, sf_dir):
    """Documents as stories of the events they come in tens, with their first line as a headline and the second as a lead."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    k = F.col("doc_id")
    return d.select(F.expr("doc_id DIV 10").alias("event_id"), F.get(lines, 0).alias("headline"), T.slug(F.get(lines, 0)).alias("slug"), F.coalesce(F.get(lines, 1), F.lit("")).alias("lead"), F.when(k % 3 == 0, "PUBLISHED").when(k % 3 == 1, "CORRECTED").otherwise("DRAFT").alias("status"), F.when(k % 4 == 0, "PROVISIONAL").otherwise("CONFIRMED").alias("lifecycle"), F.timestamp_seconds(k * 20 + 1_700_000_000).alias("created_at"))


def _crisis(spark, sf_dir):
    s = _stories(spark, sf_dir)
    e = s.select("event_id").distinct().select("event_id", (F.col("event_id") * 7 % 101).alias("importance"), (F.col("event_id") * 13 % 97).alias("velocity"))
    return watch.crisis_triggers(s, e, F.timestamp_seconds(F.lit(1_700_000_000 + 4000)), ["that", "que", "der"], minutes=60)


def _media(spark, sf_dir):
    """Line items as media of their orders."""
    k = F.col("l_partkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 1_000_000 + F.col("l_suppkey") * 10_000 + k).alias("asset_id"), F.col("l_orderkey").alias("story_id"), F.when(F.col("l_returnflag") == "R", "ORIGINAL_MEDIA").when(F.col("l_returnflag") == "A", "SOURCE_REFERENCE").otherwise("BRANDED_FALLBACK").alias("status"), F.when(k % 3 == 0, F.concat(F.lit("f"), k)).alias("file_id"), F.when(k % 4 != 1, F.concat(F.lit("https://m.example/"), k)).otherwise("").alias("url"), F.when(k % 2 == 0, "photo").otherwise("video").alias("kind"))
    return watch.picked_media(rows)


QUERIES = {
    "AGG15_new_posts": lambda spark, sf: watch.new_posts(newsroom.publications(spark, sf), F.lit("1998-01-01").cast("timestamp")),
    "AGG26_health": lambda spark, sf: watch.health(_stories(spark, sf), "https://news.example"),
    "AGG27_crisis_triggers": _crisis,
    "SRT08_picked_media": _media,
    "STR19_rate_caps": _caps, "OPS24_publish_decisions": _decisions, "OPS22_ledger": _ledger}


def _walk(rows: str) -> str:
    """A recursive walk over each channel's requests: times of posts, and what was sent, are carried in lists."""
    prov, conf = min(CAPS["per_hour"][0], CAPS["most_hour"]), min(CAPS["per_hour"][1], CAPS["most_hour"])
    step = f"""CASE WHEN list_contains(sent, r.story::VARCHAR) THEN CASE WHEN list_contains(sent, r.story || '/' || r.event_type) THEN 'NOOP' ELSE 'EDIT' END
  WHEN len(live) >= {CAPS['most_day']} THEN 'DAY' WHEN len(list_filter(live, lambda t: t >= r.us - 3600000000)) >= CASE WHEN r.provisional THEN {prov} ELSE {conf} END THEN 'HOUR' ELSE 'SEND' END"""
    return f"""
q AS ({rows}), r AS MATERIALIZED (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) AS n FROM q),
w(channel, n, event_id, us, action, live, sent) AS (
 SELECT DISTINCT channel, 0::BIGINT, NULL::BIGINT, 0::BIGINT, ''::VARCHAR, []::BIGINT[], []::VARCHAR[] FROM r
 UNION ALL SELECT channel, n, event_id, us, action, CASE WHEN action = 'SEND' THEN list_append(live, us) ELSE live END,
  CASE WHEN action IN ('SEND', 'EDIT') THEN list_concat(list_filter(sent, lambda s: split_part(s, '/', 1)::BIGINT >= story - 1), [story::VARCHAR, story || '/' || event_type]) ELSE sent END
 FROM (SELECT r.channel, r.n, r.event_id, r.us, r.story, r.event_type, live, sent, {step} AS action
  FROM (SELECT channel, n, sent, live AS live0 FROM w) AS p JOIN r ON r.channel = p.channel AND r.n = p.n + 1, LATERAL (SELECT list_filter(live0, lambda t: t >= r.us - 86400000000) AS live) AS l) AS s)"""


_ROWS = "SELECT event_id, user_id % 8 AS channel, ts, event_id // 9 AS story, event_type, value > 30 AS provisional FROM events"
_ANSWER = "SELECT event_id, CASE WHEN action IN ('DAY', 'HOUR') THEN 'THROTTLED' ELSE action END AS action, CASE WHEN action = 'DAY' THEN 3600 WHEN action = 'HOUR' THEN greatest(60, least(3600, (us - live[1]) // 1000000)) END::BIGINT AS retry_s FROM w WHERE n > 0"
_REASON = "CASE WHEN user_id % 8 = 5 THEN 'PAUSED' WHEN NOT coalesce(allowed, true) THEN 'CANCELLED_SOURCE_DISABLED' WHEN NOT value > 30 AND value * 10 > 180 THEN 'STALE_SUPERSEDED' END"
_JOINED = f"SELECT e.*, {_REASON} AS reason FROM events e LEFT JOIN (SELECT s_suppkey, s_acctbal > 0 AND s_nationkey % 2 = 0 AND s_nationkey % 5 <> 0 AS allowed FROM supplier) s ON s.s_suppkey = e.user_id"
ORACLES = {
    "STR19_rate_caps": f"WITH RECURSIVE {_walk(_ROWS)} {_ANSWER}",
    "OPS24_publish_decisions": f"WITH RECURSIVE j AS MATERIALIZED ({_JOINED}), {_walk(_ROWS.replace('FROM events', 'FROM j WHERE reason IS NULL'))} {_ANSWER} UNION ALL SELECT event_id, reason, NULL FROM j WHERE reason IS NOT NULL",
    "OPS22_ledger": """
WITH p AS (SELECT l_orderkey AS story_id, CASE WHEN l_linestatus = 'O' THEN 'telegram' ELSE 'site' END AS platform, l_orderkey * 10 + l_linenumber AS nth, CASE l_returnflag WHEN 'N' THEN 'SENT' WHEN 'R' THEN 'FAILED' ELSE 'PENDING' END AS status, l_partkey::VARCHAR AS remote_id, l_shipdate AS us FROM lineitem),
m AS (SELECT story_id, platform, (nth % 2)::VARCHAR AS payload_hash, nth, status, us, CASE WHEN status = 'SENT' THEN remote_id END AS remote_id, CASE WHEN status = 'FAILED' THEN 'e' || (nth % 10) END AS error FROM p),
o AS (SELECT DISTINCT story_id, platform, '0' AS payload_hash FROM p WHERE story_id % 3 = 0),
n AS (SELECT story_id, platform, payload_hash, count(*) AS marks, min(us) AS first_at, max({'nth': nth, 'status': status, 'error': coalesce(error, ''), 'us': us}) AS l, max({'nth': nth, 'r': remote_id}) FILTER (remote_id IS NOT NULL) AS x FROM m GROUP BY ALL)
SELECT coalesce(o.story_id, n.story_id) AS story_id, coalesce(o.platform, n.platform) AS platform, coalesce(o.payload_hash, n.payload_hash) AS payload_hash, coalesce(l.status, 'PENDING') AS status, (CASE WHEN o.story_id IS NULL THEN 0 ELSE 1 END + coalesce(marks, 0))::BIGINT AS attempt,
 coalesce(x.r, CASE WHEN o.story_id IS NOT NULL THEN 'r0' END) AS remote_id, CASE WHEN n.story_id IS NULL THEN 'old' ELSE nullif(l.error, '') END AS error, CASE WHEN o.story_id IS NOT NULL THEN DATE '1990-01-01' ELSE first_at END AS created_at, coalesce(l.us, DATE '1990-01-01') AS updated_at
FROM o FULL JOIN n ON n.story_id = o.story_id AND n.platform = o.platform AND n.payload_hash = o.payload_hash""",
    "AGG15_new_posts": """
WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS pub_id, l_orderkey AS story_id, CASE WHEN l_linestatus = 'O' THEN 'telegram' ELSE 'site' END AS platform, l_shipdate AS d FROM lineitem WHERE l_returnflag = 'N'),
f AS (SELECT story_id, min({'i': pub_id, 'p': platform, 'd': d}) AS x FROM p GROUP BY story_id) SELECT x.p AS platform, count(*) AS posts FROM f WHERE x.d >= DATE '1998-01-01' GROUP BY 1""",
    "AGG26_health": r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
SELECT 'published stories' AS check, count(*) AS n, count(*) > 0 AS ok FROM s WHERE doc_id % 3 < 2 UNION ALL SELECT 'public base url', 1, true UNION ALL SELECT 'stories missing slug', 0, true
UNION ALL SELECT 'stories missing lead', count(*), count(*) = 0 FROM s WHERE coalesce(l[2], '') = '' UNION ALL SELECT 'provisional live', count(*), true FROM s WHERE doc_id % 12 = 0""",
    "AGG27_crisis_triggers": """
WITH e AS (SELECT DISTINCT doc_id // 10 AS e FROM documents WHERE doc_id * 20 >= 400 AND (contains(string_split(coalesce(text, ''), chr(10))[1], 'that') OR contains(string_split(coalesce(text, ''), chr(10))[1], 'que') OR contains(string_split(coalesce(text, ''), chr(10))[1], 'der')) AND (doc_id // 10 * 7 % 101 >= 90 OR doc_id // 10 * 13 % 97 >= 90))
SELECT count(*) AS triggers, count(*) >= 2 AS crisis FROM e""",
    "SRT08_picked_media": """
WITH m AS (SELECT l_orderkey AS story_id, l_orderkey * 1000000 + l_suppkey * 10000 + l_partkey AS asset_id, l_returnflag = 'R' AS original, l_partkey % 3 = 0 AS held, l_partkey % 2 = 0 AS photo FROM lineitem WHERE l_returnflag IN ('R', 'A') AND (l_partkey % 3 = 0 OR l_partkey % 4 <> 1))
SELECT story_id, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY original DESC, held DESC, photo DESC, asset_id DESC) AS k FROM m) AS r WHERE k = 1""",
}
