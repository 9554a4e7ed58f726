"""Queries of the evidence and ledger operators on the newsroom's tables, with SQL over the tables these are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import evidence as E
from sievework.operators import ledger as L
from sievework.sources import newsroom as N


def _states(spark, sf):
    return E.verified(N.claims(spark, sf), N.evidence(spark, sf), N.sources(spark, sf))


def _behind(spark, sf):
    return E.event_sources(N.claims(spark, sf), N.evidence(spark, sf), N.sources(spark, sf))


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def _split(spark, sf):
    """Events as a table that has some rows, and new rows of which it has some."""
    e = _events(spark, sf).select("event_id", "user_id", "event_type", "value")
    return e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0").withColumn("value", F.lit(-1.0))


def _merged(how):
    def run(spark, sf):
        table, rows = _split(spark, sf)
        return how(table, rows, ["event_id"], [F.desc("value")])

    return run


def _replaced_by_pair(spark, sf):
    table, rows = _split(spark, sf)
    first = table.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.max("value").alias("value"))
    return L.insert_or_replace(first, rows.where("event_id % 5 = 0"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


def _counted(spark, sf):
    day = _events(spark, sf).select(F.to_date("ts").alias("day"), "event_type", F.lit(1).cast("long").alias("views"), "event_id")
    old = day.where("event_id % 3 <> 0").groupBy("day", "event_type").agg(F.sum("views").alias("views"))
    return L.add_counts(old, day.where("event_id % 3 = 0"), ["day", "event_type"], "views")


def _locked(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("version"), F.col("o_orderstatus").alias("status"))
    changes = o.where("id % 2 = 0").select("id", F.lit(1).cast("long").alias("version"), F.lit("X").alias("status"))
    return L.update_if_unchanged(o, changes, "id", "version", "status")


def _expired(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("until"))
    return L.unexpired(o, "until", F.lit("1997-01-01").cast("timestamp")).select("o_orderkey")


def _checkpoints(spark, sf):
    e = _events(spark, sf)
    old = e.groupBy((F.col("user_id") % 50).alias("source_id")).agg(F.min("event_id").alias("checkpoint"))
    return L.checkpoints(old, e.where("event_type <> 'error'").select((F.col("user_id") % 60).alias("source_id"), F.col("event_id").alias("item_id")))


def _admitted(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    starts = o.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("activated"))
    rows = o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("published")).join(starts, "o_custkey")
    return L.admitted(rows, "published", "activated").select("o_orderkey", "mode")


def _decisions(spark, sf):
    p = N.publications(spark, sf)
    sent = p.groupBy("story_id").agg(F.bool_or(F.col("status") == "SENT").alias("sent"), F.count("*").alias("sample"))
    s = N.stories(spark, sf).join(sent, "story_id", "left").withColumns({"sent": F.coalesce("sent", F.lit(False)), "sample": F.coalesce("sample", F.lit(0))})
    share, waited = (F.col("event_id") % 10) / 10.0, F.col("story_id") % 40
    deferred = L.diversity(share, F.col("sample"), F.col("story_id") % 3 == 0, F.col("event_id") % 13 == 0) == "DEFER"
    return s.select("story_id", L.publication_decision(F.col("status") == "HELD", F.col("sent") & (F.col("story_id") % 2 == 0), F.col("status") == "PUBLISHED", deferred, waited).alias("decision"))


def _deadlines(spark, sf):
    p = N.publications(spark, sf)
    return p.select("pub_id", L.deadline_action(F.col("status"), F.col("pub_id") % 120).alias("action"))


def _priorities(spark, sf):
    p = N.publications(spark, sf)
    tier = F.concat(F.lit("P"), (F.col("story_id") % 4).cast("string"))
    return p.where(F.col("status") == "PENDING").select("pub_id", L.send_priority(F.col("pub_id") % 5 == 0, tier).alias("priority"))


def _numeric(spark, sf):
    p = N.publications(spark, sf).select("pub_id", F.when(F.col("pub_id") % 9 == 0, "x").otherwise(F.col("remote_id")).alias("remote_id"))
    return p.orderBy(L.numeric_order(F.col("remote_id")).desc(), "pub_id").limit(30)


def _stale(spark, sf):
    seen = N.claims(spark, sf).groupBy("event_id").agg(F.max("created_at").alias("last_seen"))
    rows = E.lifecycle(_states(spark, sf)).join(seen, "event_id")
    return L.stale(rows, F.lit("1998-06-01").cast("timestamp")).select("event_id")


QUERIES = {
    "AGG10_independent_origins": lambda spark, sf: E.origins(N.evidence(spark, sf), N.sources(spark, sf)),
    "AGG11_relation_counts": lambda spark, sf: E.relation_counts(N.evidence(spark, sf)),
    "AGG24_event_support": lambda spark, sf: E.event_support(_states(spark, sf)),
    "OPS01_claim_state_by_origins": lambda spark, sf: _states(spark, sf).select("claim_id", "state"),
    "OPS05_next_check": lambda spark, sf: E.next_check(_states(spark, sf)).select("claim_id", "trigger", "dedupe_key"),
    "OPS07_verified_claims": lambda spark, sf: _states(spark, sf).select("claim_id", "risk", "origins", "contradicted", "state"),
    "OPS12_main_claim_of_event": lambda spark, sf: E.main_claim(_states(spark, sf)),
    "OPS13_event_lifecycle": lambda spark, sf: E.lifecycle(_states(spark, sf)),
    "FLT14_stale_events": _stale,
    "FLT17_publishable_events": lambda spark, sf: E.publishable(_states(spark, sf)),
    "JOIN07_official_claims": lambda spark, sf: E.official(N.evidence(spark, sf), N.sources(spark, sf)),
    "JOIN08_lineages": lambda spark, sf: E.lineages(N.evidence(spark, sf)),
    "JOIN09_event_identities": lambda spark, sf: E.identities(_behind(spark, sf)),
    "JOIN11_first_names": lambda spark, sf: E.first_names(_behind(spark, sf)),
    "JOIN12_event_policy": lambda spark, sf: E.policy(_behind(spark, sf)),
    "JOIN19_first_sent": lambda spark, sf: L.first_sent(N.publications(spark, sf)),
    "JOIN23_resent": lambda spark, sf: L.resent(N.publications(spark, sf)),
    "JOIN28_last_sent": lambda spark, sf: L.last_sent(N.publications(spark, sf)),
    "DML01_insert_or_ignore": _merged(L.insert_or_ignore),
    "DML02_counter_upsert": _counted,
    "DML03_insert_or_replace": _merged(L.insert_or_replace),
    "DML04_latest_wins": _replaced_by_pair,
    "DML06_optimistic_update": _locked,
    "DML07_unexpired": _expired,
    "SRT03_send_priority": _priorities,
    "SRT10_numeric_ids": _numeric,
    "SRT11_eviction": lambda spark, sf: L.evict(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "n_chars", 1_000_000),
    "AGG12_first_post_shares": lambda spark, sf: L.shares(L.first_sent(N.publications(spark, sf)), "platform"),
    "STR01_checkpoints": _checkpoints,
    "STR11_admitted": _admitted,
    "STR17_deadlines": _deadlines,
    "STR24_publication_decision": _decisions,
    "OPS25_rejections": lambda spark, sf: N.publications(spark, sf).where("status = 'FAILED'").select("pub_id", L.rejection(F.when(F.col("pub_id") % 3 == 0, "BLOCKED_COPY").when(F.col("pub_id") % 3 == 1, "timeout")).alias("status")),
}

_ORIGIN = r"CASE WHEN s_nationkey % 3 = 0 THEN 'i:nation ' || s_nationkey WHEN l_partkey % 4 = 0 THEN 'l:p' || (l_partkey % 7) ELSE 'i:' || trim(regexp_replace(lower(s_name), '[^\p{L}\p{N}]+', ' ', 'g')) END"
_STATES = f"""
WITH n AS (SELECT l_orderkey AS k, count(DISTINCT CASE WHEN l_returnflag NOT IN ('R', 'A') THEN {_ORIGIN} END) AS origins, bool_or(l_returnflag = 'R') AS against FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey),
v AS (SELECT o_orderkey AS claim_id, o_custkey AS event_id, o_orderdate, o_orderpriority = '1-URGENT' AS high, coalesce(origins, 0) AS origins, coalesce(against, false) AS against FROM orders LEFT JOIN n ON n.k = o_orderkey),
st AS (SELECT *, CASE WHEN against THEN 'CONFLICTING' WHEN origins >= 2 THEN 'CORROBORATED' WHEN high THEN 'SINGLE_SOURCE' ELSE 'UNVERIFIED' END AS state FROM v) """
_LIFE = "SELECT event_id, max(o_orderdate) AS seen, CASE WHEN sum((state = 'CONFLICTING')::INT) > 0 THEN 'CONFLICTING' WHEN sum((state = 'CORROBORATED')::INT) > 0 THEN 'CONFIRMED' ELSE 'PROVISIONAL' END AS lifecycle FROM st GROUP BY event_id"
_BEHIND = "(SELECT DISTINCT o_custkey AS event_id, s.* FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier s ON s_suppkey = l_suppkey)"
_PUB = "(SELECT l_orderkey * 10 + l_linenumber AS pub_id, l_orderkey AS story_id, CASE l_linestatus WHEN 'O' THEN 'telegram' ELSE 'site' END AS platform, CASE l_returnflag WHEN 'N' THEN 'SENT' WHEN 'R' THEN 'FAILED' ELSE 'PENDING' END AS status, l_partkey::VARCHAR AS remote_id, l_shipdate AS created_at FROM lineitem)"

ORACLES = {
    "AGG10_independent_origins": f"SELECT l_orderkey AS claim_id, count(DISTINCT {_ORIGIN}) AS origins FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag NOT IN ('R', 'A') GROUP BY l_orderkey",
    "AGG11_relation_counts": "SELECT l_orderkey AS claim_id, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS supports, count(*) FILTER (l_returnflag = 'R') AS contradicts, count(*) FILTER (l_returnflag = 'A') AS context FROM lineitem GROUP BY l_orderkey",
    "AGG24_event_support": _STATES + "SELECT event_id, max(origins)::INT AS most_origins, count(*) FILTER (against) AS contradictions FROM st GROUP BY event_id",
    "OPS01_claim_state_by_origins": _STATES + "SELECT claim_id, state FROM st",
    "OPS05_next_check": _STATES + "SELECT claim_id, t AS trigger, t || ':' || event_id || ':' || claim_id AS dedupe_key FROM (SELECT *, CASE state WHEN 'CONFLICTING' THEN 'contra' ELSE 'ev' END AS t FROM st WHERE state <> 'CORROBORATED')",
    "OPS07_verified_claims": _STATES + "SELECT claim_id, CASE WHEN high THEN 'high' ELSE 'normal' END AS risk, origins::INT AS origins, against AS contradicted, state FROM st",
    "OPS12_main_claim_of_event": _STATES + "SELECT event_id, arg_min(claim_id, CASE WHEN state = 'CORROBORATED' THEN 0 ELSE 1 END * 1000000000000 + claim_id) AS main FROM st GROUP BY event_id",
    "OPS13_event_lifecycle": _STATES + f"SELECT event_id, lifecycle FROM ({_LIFE})",
    "FLT14_stale_events": _STATES + f"SELECT event_id FROM ({_LIFE}) WHERE lifecycle = 'CONFIRMED' AND seen < TIMESTAMP '1998-05-31 21:00:00'",
    "FLT17_publishable_events": _STATES + "SELECT event_id, CASE max(CASE WHEN state = 'CONFLICTING' THEN 2 WHEN state = 'SINGLE_SOURCE' AND high THEN 1 ELSE 0 END) WHEN 2 THEN 'CONFLICTING_CLAIMS' WHEN 1 THEN 'HIGH_RISK_SINGLE_SOURCE' ELSE 'OK' END AS reason FROM st GROUP BY event_id",
    "JOIN07_official_claims": "SELECT DISTINCT l_orderkey AS claim_id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)",
    "JOIN08_lineages": "SELECT l_orderkey AS claim_id, count(DISTINCT CASE WHEN l_partkey % 4 = 0 THEN 'p' || (l_partkey % 7) ELSE 's' || l_suppkey END) AS lineages FROM lineitem GROUP BY l_orderkey",
    "JOIN09_event_identities": f"SELECT event_id, count(DISTINCT CASE WHEN s_nationkey % 3 = 0 THEN 'n' || s_nationkey ELSE s_name END) AS identities FROM {_BEHIND} GROUP BY event_id",
    "JOIN11_first_names": f"SELECT event_id, array_to_string(list_sort(list(DISTINCT s_name))[1:3], '|') AS names FROM {_BEHIND} GROUP BY event_id",
    "JOIN12_event_policy": f"SELECT event_id, count(*) FILTER (s_nationkey % 7 = 0) AS breaking, bool_or(s_acctbal > 0 AND s_nationkey % 2 = 0 AND s_nationkey % 5 <> 0) AS allowed FROM {_BEHIND} GROUP BY event_id",
    "JOIN19_first_sent": f"SELECT story_id, pub_id, platform, created_at FROM {_PUB} p WHERE status = 'SENT' QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY pub_id, platform, created_at) = 1",
    "JOIN23_resent": f"SELECT pub_id FROM {_PUB} p WHERE EXISTS (SELECT 1 FROM {_PUB} q WHERE q.story_id = p.story_id AND q.platform = p.platform AND q.remote_id <> p.remote_id)",
    "JOIN28_last_sent": f"SELECT story_id, max(pub_id) AS pub_id FROM {_PUB} WHERE status = 'SENT' GROUP BY story_id",
    "DML01_insert_or_ignore": "SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 <> 0 THEN value ELSE -1.0 END AS value FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0",
    "DML02_counter_upsert": "SELECT ts::DATE AS day, event_type, count(*) AS views FROM events GROUP BY ALL",
    "DML03_insert_or_replace": "SELECT event_id, user_id, event_type, CASE WHEN event_id % 2 <> 0 THEN value ELSE -1.0 END AS value FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0",
    "DML04_latest_wins": """WITH a AS (SELECT user_id, event_type, min(event_id) AS event_id, max(value) AS value FROM events WHERE event_id % 3 <> 0 GROUP BY ALL),
b AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_id % 10 = 0 GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.event_id, a.event_id) AS event_id, CASE WHEN b.event_id IS NULL THEN a.value ELSE -1.0 END AS value FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""",
    "DML06_optimistic_update": "SELECT o_orderkey AS id, o_custkey % 3 + CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 = 1 THEN 1 ELSE 0 END AS version, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 = 1 THEN 'X' ELSE o_orderstatus END AS status FROM orders",
    "DML07_unexpired": "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR o_orderdate > TIMESTAMP '1997-01-01 00:00:00'",
    "SRT03_send_priority": f"SELECT pub_id, (CASE WHEN pub_id % 5 = 0 THEN 100 ELSE 60 END + [10, 6, 3, 0][story_id % 4 + 1])::INT AS priority FROM {_PUB} WHERE status = 'PENDING'",
    "SRT10_numeric_ids": f"SELECT pub_id, r AS remote_id FROM (SELECT pub_id, CASE WHEN pub_id % 9 = 0 THEN 'x' ELSE remote_id END AS r FROM {_PUB}) ORDER BY coalesce(try_cast(r AS BIGINT), 0) DESC, pub_id LIMIT 30",
    "SRT11_eviction": "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id DESC) AS upto FROM documents) WHERE upto > 1000000",
    "AGG12_first_post_shares": f"WITH f AS (SELECT platform FROM {_PUB} WHERE status = 'SENT' QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY pub_id, platform) = 1) SELECT platform, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM f), 6) AS share FROM f GROUP BY platform",
    "STR01_checkpoints": "SELECT source_id, max(c) AS checkpoint FROM (SELECT user_id % 50 AS source_id, min(event_id) AS c FROM events GROUP BY 1 UNION ALL SELECT user_id % 60, event_id FROM events WHERE event_type <> 'error') GROUP BY source_id",
    "STR11_admitted": "WITH a AS (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F') AS t FROM orders GROUP BY o_custkey) SELECT o_orderkey, CASE WHEN t IS NULL OR (o_orderkey % 11 <> 0 AND o_orderdate >= t) THEN 'LIVE' ELSE 'STORE_ONLY' END AS mode FROM orders JOIN a USING (o_custkey)",
    "STR17_deadlines": f"SELECT pub_id, CASE WHEN pub_id % 120 < 60 THEN 'WAIT' WHEN status = 'SENT' THEN 'CAUTION_EDIT' ELSE 'ARCHIVE' END AS action FROM {_PUB}",
    "STR24_publication_decision": f"""WITH p AS (SELECT story_id, bool_or(status = 'SENT') AS sent, count(*) AS n FROM {_PUB} GROUP BY story_id),
s AS (SELECT o_orderkey AS k, o_custkey AS e, o_orderstatus AS st, coalesce(sent, false) AND o_orderkey % 2 = 0 AS sent, coalesce(n, 0) AS n FROM orders LEFT JOIN p ON p.story_id = o_orderkey)
SELECT k AS story_id, CASE WHEN st = 'P' THEN 'HOLD' WHEN sent AND st = 'F' THEN 'EDIT' WHEN sent THEN 'NOOP' WHEN e % 13 <> 0 AND n >= 4 AND (e % 10 >= 5 OR (e % 10 >= 3 AND k % 3 = 0)) AND k % 40 < 20 THEN 'DEFER' ELSE 'SEND' END AS decision FROM s""",
    "OPS25_rejections": f"SELECT pub_id, CASE WHEN pub_id % 3 = 0 THEN 'SKIPPED' ELSE 'FAILED' END AS status FROM {_PUB} WHERE status = 'FAILED'",
}
