"""Queries of what editors and watchdogs ask, on the newsroom's tables, with SQL over the tables these are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import rules as R
from sievework.functions import text as T
from sievework.functions.lexicon import EUROPEAN as LEX
from sievework.operators import board as B
from sievework.operators import dedup
from sievework.operators import evidence as E
from sievework.plans import text_queries as Q
from sievework.plans.newsroom_queries import _LIFE, _PUB, _STATES, _states
from sievework.sources import newsroom as N


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _keyed(spark, sf):
    d = _docs(spark, sf)
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return dedup.spread(d).select(F.col("doc_id").alias("item_id"), F.concat_ws("/", "source", "n_chars").alias("url_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_key"), F.nullif(T.normalized_title(first), F.lit("")).alias("title_key"))


def _assigned(spark, sf):
    matched = B.candidates(_keyed(spark, sf), ["url_key", "content_key", "title_key"])
    at = F.timestamp_seconds(F.col("item_id") * 1800 + 1_700_000_000)
    return B.assigned(_keyed(spark, sf).select("item_id", at.alias("at")).join(matched, "item_id", "left"))


def _headlines(spark, sf):
    d = _docs(spark, sf)
    first = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    words = F.array_distinct(F.regexp_extract_all(first, F.lit("[a-z]{3,}"), F.lit(0)))
    rows = d.select(F.col("doc_id").alias("story_id"), F.floor(F.col("doc_id") / 2).alias("event_id"), words.alias("words"), F.coalesce("lang", F.lit("")).alias("identity"))
    return B.repeated_headlines(rows.where("story_id % 2 = 0"), rows.where("story_id % 2 = 1"))


def _words(spark, sf):
    d = _docs(spark, sf).select((F.col("doc_id") % 40).alias("event_id"), F.col("doc_id").alias("claim_id"), R.event_tokens(F.col("text"), LEX).alias("tokens"))
    return B.word_union(d, "event_id", "tokens", 5).select("event_id", F.size("words").alias("n_words"))


def _calls(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("event_type").alias("provider"), "ts")
    return B.over_budget(e, "ts", 1, 4).select("event_id", "last_minute", "last_hour")


def _media(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("item"), F.array(F.concat(F.lit("m"), F.col("o_orderkey") % 3), F.concat(F.lit("n"), F.col("o_orderkey") % 2), F.lit("z")).alias("refs"))
    return B.first_media(o, "event_id", "item", "refs")


def _drafts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = B.with_media(e.select("event_id", "props"), "props", F.concat(F.lit("m"), F.col("event_id") % 3))
    return rows.select("event_id", F.get_json_object("props", "$.media").alias("media"), F.get_json_object("props", "$.k").alias("k"))


def _queue(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("job_id"), F.concat_ws(":", "event_type", F.col("user_id") % 30).alias("dedupe_key"))
    return B.enqueue(e.where("job_id < 40"), e.where("job_id >= 40"))


def _stalled(spark, sf):
    """Users as platforms and their events as posts, as of the newest; who is idle for four hours has stalled."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    posts = e.select(F.col("user_id").cast("string").alias("platform"), F.lit("SENT").alias("status"), F.col("ts").alias("created_at"))
    return B.stalled(posts, F.lit(now), 240)


QUERIES = {
    "JOIN02_any_key": lambda spark, sf: B.candidates(_keyed(spark, sf), ["url_key", "content_key", "title_key"]),
    "JOIN03_recent_candidates": lambda spark, sf: B.recent(N.publications(spark, sf).where("status = 'SENT'"), "platform", [F.desc("created_at"), F.desc("pub_id"), F.desc("remote_id")], 300).select("platform", "place", "pub_id"),
    "JOIN17_repeated_headlines": _headlines,
    "STR08_event_assignment": _assigned,
    "AGG18_coverage": lambda spark, sf: B.coverage(N.sources(spark, sf), N.evidence(spark, sf)),
    "AGG23_event_words": _words,
    "AGG25_over_budget": _calls,
    "SRT06_headline_pick": lambda spark, sf: B.headline_pick(_states(spark, sf)),
    "SRT07_details_pick": lambda spark, sf: B.details_pick(_states(spark, sf)),
    "SRT05_recent_list": lambda spark, sf: N.stories(spark, sf).orderBy(F.desc("created_at"), F.desc("story_id")).limit(25).select("story_id"),
    "SRT09_oldest_first": lambda spark, sf: N.stories(spark, sf).where("status = 'DRAFT'").orderBy("created_at", "story_id").limit(100).select("story_id"),
    "OPS14_new_versions": lambda spark, sf: B.new_version(N.stories(spark, sf), E.lifecycle(_states(spark, sf))),
    "OPS26_distribution_plan": lambda spark, sf: B.plan(E.lifecycle(_states(spark, sf)), ["telegram"]),
    "OPS06_check_attempts": lambda spark, sf: B.attempts(N.evidence(spark, sf)),
    "OPS21_enqueued": _queue,
    "OPS27_first_media": _media,
    "DML09_json_set": _drafts,
    "STR22_capacity": lambda spark, sf: N.claims(spark, sf).select("claim_id", B.capacity((F.col("event_id") % 20) / 20.0, F.col("claim_id") % 2 == 0, F.col("claim_id") % 100).alias("action")),
    "STR25_stalled": _stalled,
    "STR27_requeued": lambda spark, sf: B.requeued(N.publications(spark, sf).select("pub_id", F.when(F.col("status") == "PENDING", "RUNNING").otherwise(F.col("status")).alias("status"))),
}

_TITLE = r"trim(regexp_replace(regexp_replace(" + Q._HASHED.replace("X", Q._FIRST) + r", '[«»\"''()\[\]{}.،؛:!؟?…-]', ' ', 'g'), '\s+', ' ', 'g'))"
_MATCHED = f"""k AS (SELECT doc_id, concat_ws('/', source, n_chars) AS u, {Q._T} AS c, nullif({_TITLE}, '') AS t FROM documents),
w AS (SELECT doc_id, least(min(doc_id) OVER (PARTITION BY u), min(doc_id) OVER (PARTITION BY c), CASE WHEN t IS NOT NULL THEN min(doc_id) OVER (PARTITION BY t) END) AS least_id FROM k)"""

ORACLES = {
    "JOIN02_any_key": f"WITH {_MATCHED} SELECT doc_id AS item_id, least_id AS matched_id FROM w WHERE least_id < doc_id",
    "STR08_event_assignment": f"""WITH RECURSIVE {_MATCHED},
p AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id - least_id <= 96 THEN least_id ELSE doc_id END AS up FROM w),
r AS (SELECT doc_id, up FROM p UNION SELECT r.doc_id, p.up FROM r JOIN p ON p.doc_id = r.up WHERE p.up <> r.up)
SELECT doc_id AS item_id, min(up) AS event_id FROM r GROUP BY doc_id""",
    "JOIN03_recent_candidates": f"SELECT platform, place::INT AS place, pub_id FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY created_at DESC, pub_id DESC, remote_id DESC) AS place FROM {_PUB} WHERE status = 'SENT') WHERE place <= 300",
    "JOIN17_repeated_headlines": f"""WITH w AS (SELECT doc_id, doc_id // 2 AS e, coalesce(lang, '') AS l, list_distinct(regexp_extract_all(lower({Q._FIRST}), '[a-z]{{3,}}')) AS w FROM documents)
SELECT a.doc_id AS story_id, min(b.doc_id) AS sent_id FROM w a JOIN w b ON a.l = b.l AND a.e <> b.e AND a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 AND len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.55 GROUP BY a.doc_id""",
    "AGG18_coverage": "SELECT CASE WHEN s_nationkey % 3 = 0 THEN 'Nation ' || s_nationkey ELSE s_name END AS who, count(*) AS endpoints, count(*) FILTER (s_acctbal > 0) AS active, sum((SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey))::BIGINT AS items FROM supplier GROUP BY 1",
    "AGG23_event_words": f"""WITH t AS (SELECT doc_id, doc_id % 40 AS event_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS k, {Q._WORDS} AS w FROM documents)
SELECT event_id, count(DISTINCT x)::INT AS n_words FROM (SELECT event_id, unnest(w) AS x FROM t WHERE k <= 5) WHERE length(x) > 1 AND NOT list_contains({Q._list(LEX.event_stop)}, x) GROUP BY event_id""",
    "AGG25_over_budget": "SELECT * FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS last_minute, count(*) OVER (PARTITION BY event_type ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS last_hour FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events)) WHERE last_minute > 1 OR last_hour > 4",
    "SRT06_headline_pick": _STATES + "SELECT event_id, claim_id FROM st JOIN orders ON o_orderkey = claim_id QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY CASE state WHEN 'CORROBORATED' THEN 0 WHEN 'UNVERIFIED' THEN 1 WHEN 'SINGLE_SOURCE' THEN 2 ELSE 3 END, o_totalprice DESC, claim_id) = 1",
    "SRT07_details_pick": _STATES + "SELECT event_id, place::INT AS place, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY state <> 'CORROBORATED', claim_id DESC) AS place FROM st) WHERE place <= 3",
    "SRT05_recent_list": "SELECT o_orderkey AS story_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25",
    "SRT09_oldest_first": "SELECT o_orderkey AS story_id FROM orders WHERE o_orderstatus NOT IN ('F', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 100",
    "OPS14_new_versions": _STATES + f"SELECT o_orderkey AS story_id, new AS status, 1 + (new <> old)::INT AS version FROM (SELECT o_orderkey, CASE lifecycle WHEN 'CONFIRMED' THEN 'PUBLISHED' WHEN 'CONFLICTING' THEN 'HELD' ELSE 'DRAFT' END AS new, CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'P' THEN 'HELD' ELSE 'DRAFT' END AS old FROM orders JOIN ({_LIFE}) l ON l.event_id = o_custkey)",
    "OPS26_distribution_plan": _STATES + f"SELECT event_id, CASE lifecycle WHEN 'CONFLICTING' THEN '' ELSE 'site' END AS platforms FROM ({_LIFE})",
    "OPS06_check_attempts": "SELECT l_orderkey AS claim_id, count(*) AS attempts, max(l_shipdate) AS last_run FROM lineitem GROUP BY l_orderkey",
    "OPS21_enqueued": "SELECT event_type || ':' || (user_id % 30) AS dedupe_key, min(event_id) AS job_id FROM events WHERE event_id >= 40 GROUP BY 1 HAVING dedupe_key NOT IN (SELECT event_type || ':' || (user_id % 30) FROM events WHERE event_id < 40)",
    "OPS27_first_media": "WITH f AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5) SELECT o_custkey AS event_id, 'm' || (o_orderkey % 3) AS ref FROM f UNION SELECT o_custkey, 'n' || (o_orderkey % 2) FROM f",
    "DML09_json_set": "SELECT event_id, 'm' || (event_id % 3) AS media, json_extract_string(props, '$.k') AS k FROM events",
    "STR22_capacity": "SELECT o_orderkey AS claim_id, CASE WHEN o_custkey % 20 < 18 AND o_orderkey % 2 = 0 AND o_orderkey % 100 < 75 THEN 'DEFER' ELSE 'PASS' END AS action FROM orders",
    "STR25_stalled": "WITH t AS (SELECT max(floor(epoch(ts))) AS now FROM events), l AS (SELECT user_id::VARCHAR AS platform, max(floor(epoch(ts))) AS last FROM events GROUP BY 1) SELECT platform, floor((now - last) / 60)::BIGINT AS idle_minutes, floor((now - last) / 60) > 240 AS stalled FROM l, t",
    "STR27_requeued": f"SELECT pub_id, status FROM {_PUB}",
}
