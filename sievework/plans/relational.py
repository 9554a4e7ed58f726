"""Relational queries over the operational tables, by operator, as SQL that Catalyst plans.

Each is written once; names say which operator it shows: joins (inner, left, semi, anti, as-of, band),
aggregates, windows, top-k, sets, upserts, sessions and decision chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL: dict[str, str] = {
    "AGG01_totals": "SELECT count(*) AS items, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS high FROM events",
    "AGG02_group_one_key": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "AGG03_group_two_keys": "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "AGG04_count_distinct": "SELECT lang, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
    "AGG05_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "AGG06_conditional_max": "SELECT user_id, max(CASE WHEN event_type = 'click' THEN event_id END) AS last_click, max(CASE WHEN event_type <> 'click' THEN event_id END) AS last_other FROM events GROUP BY user_id",
    "AGG07_daily_top": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS views FROM events GROUP BY CAST(ts AS DATE), event_type ORDER BY views DESC, day, event_type LIMIT 15",
    "AGG08_extremes": "SELECT min(ts) AS first_ts, max(ts) AS last_ts, max(event_id) + 1 AS next_id FROM events",
    "AGG09_event_recompute": "SELECT user_id, count(*) AS report_count, count(DISTINCT CASE WHEN value > 10 THEN event_type END) AS independent_count, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id",
    "AGG11_pivot_counts": "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS supports, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS contradicts, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS context FROM orders GROUP BY o_custkey",
    "AGG12_identity_shares": "WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT event_type, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM f WHERE k = 1 GROUP BY event_type",
    "AGG13_diversity_top": "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5",
    "AGG14_share": "SELECT round(CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS share FROM documents",
    "AGG16_modal": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), r AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c WHERE lang <> 'und') SELECT source, lang FROM r WHERE k = 1",
    "AGG19_zero_activity": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey HAVING count(o.o_orderkey) = 0",
    "AGG20_funnel": "WITH a AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey), b AS (SELECT c.c_nationkey, count(*) AS orders_n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey), s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) SELECT n.n_name, coalesce(a.customers, 0) AS customers, coalesce(b.orders_n, 0) AS orders_n, coalesce(s.suppliers, 0) AS suppliers FROM nation n LEFT JOIN a ON a.c_nationkey = n.n_nationkey LEFT JOIN b ON b.c_nationkey = n.n_nationkey LEFT JOIN s ON s.s_nationkey = n.n_nationkey",
    "AGG21_multi_window": "WITH t AS (SELECT max(ts) AS as_of FROM events) SELECT sum(CASE WHEN ts >= as_of - INTERVAL 30 MINUTE THEN 1 ELSE 0 END) AS m30, sum(CASE WHEN ts >= as_of - INTERVAL 1 HOUR THEN 1 ELSE 0 END) AS h1, sum(CASE WHEN ts >= as_of - INTERVAL 3 HOUR THEN 1 ELSE 0 END) AS h3, sum(CASE WHEN ts >= as_of - INTERVAL 6 HOUR THEN 1 ELSE 0 END) AS h6 FROM events CROSS JOIN t",
    "AGG22_any_all": "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_partial, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY o_custkey",
    "JOIN01_inner": "SELECT o.o_orderkey, l.l_linenumber, l.l_partkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'P'",
    "JOIN05_latest_of_match": "SELECT c.c_custkey, max_by(o.o_orderkey, o.o_orderkey) AS event FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    "JOIN06_independent_origins": "SELECT l.l_orderkey, count(DISTINCT coalesce(nullif(s.s_name, ''), CAST(s.s_suppkey AS VARCHAR(32)))) AS origins FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY l.l_orderkey",
    "JOIN13_six_way": "SELECT r.r_name, count(DISTINCT o.o_orderkey) AS orders_n, count(DISTINCT s.s_suppkey) AS suppliers FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY r.r_name",
    "JOIN14_left_chain": "SELECT c.c_custkey, n.n_name, r.r_name, o.o_orderkey FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'",
    "JOIN16_left_or_distinct": "SELECT DISTINCT o.o_orderkey, o.o_orderdate FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'P' OR l.l_returnflag = 'R' ORDER BY o.o_orderdate, o.o_orderkey LIMIT 40",
    "JOIN18_recent_semi": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1997-01-01 00:00:00')",
    "JOIN19_first_only": "WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, event_id, ts FROM r WHERE k = 1",
    "JOIN20_anti": "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "JOIN22_anti_labels": "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "JOIN26_scalar_subquery": "SELECT n.n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n",
    "JOIN28_latest_per_key": "SELECT user_id, max_by(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events GROUP BY user_id",
    "JOIN29_band": "WITH k AS (SELECT e.event_id, f.event_id AS near_id, row_number() OVER (PARTITION BY e.event_id ORDER BY f.event_id DESC) AS r FROM events e JOIN events f ON f.user_id = e.user_id AND f.ts < e.ts AND f.ts >= e.ts - INTERVAL 240 MINUTE) SELECT event_id, near_id FROM k WHERE r <= 20",
    "JOIN27_as_of": "WITH m AS (SELECT event_id, user_id, ts, max(CASE WHEN event_type = 'click' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) SELECT event_id, CASE WHEN seen >= ts - INTERVAL 1800 SECOND THEN seen END AS live_context FROM m",
    "JOIN36_ranked_cte": "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) SELECT c.c_name, r.o_orderkey FROM customer c JOIN r ON r.o_custkey = c.c_custkey AND r.k = 1",
    "JOIN37_join_grouped": "SELECT n.n_name, count(*) AS n FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY n.n_name",
    "WIN01_latest_row": "WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) SELECT event_id, user_id, event_type FROM r WHERE k = 1",
    "WIN02_revision_number": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev_no FROM events",
    "WIN06_rolling_hour": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events",
    "WIN07_recent_candidates": "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT o_custkey, o_orderkey, k FROM r WHERE k <= 5",
    "SRT01_multi_key": "WITH t AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100) SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM t",
    "SRT02_priority_queue": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 5",
    "SRT04_top_k": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 15",
    "SET03_distinct": "SELECT DISTINCT lang, source FROM documents",
    "DML10_check_violations": "SELECT sum(CASE WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN 1 ELSE 0 END) AS bad_status, count(*) - count(DISTINCT o_orderkey) AS duplicate_keys FROM orders",
    "STR04_session_gap": "WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 180 SECOND THEN 0 ELSE 1 END AS starts FROM events), s AS (SELECT user_id, event_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM g) SELECT user_id, burst, count(*) AS raw_count, min(ts) AS first_seen, max(ts) AS last_seen FROM s GROUP BY user_id, burst",
    "STR12_change_detection": "WITH c AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id FROM c WHERE before IS NULL OR before <> event_type",
    "STR13_sla_state": "WITH t AS (SELECT max(ts) AS as_of FROM events), u AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id) SELECT user_id, CASE WHEN seen >= as_of - INTERVAL 1 HOUR THEN 'HEALTHY' WHEN seen >= as_of - INTERVAL 24 HOUR THEN 'DEGRADED' ELSE 'STALE' END AS state FROM u CROSS JOIN t",
    "STR14_health_score": "WITH c AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok, coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS oks, coalesce(sum(CASE WHEN event_type <> 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fails FROM events) SELECT user_id, round(power(0.8e0, sum(ok)) * power(0.9e0, sum(1 - ok)) * 0.5e0 + sum(ok * 0.2e0 * power(0.8e0, oks) * power(0.9e0, fails)), 6) AS health FROM c GROUP BY user_id",
    "STR15_crisis_mode": "WITH t AS (SELECT event_id, user_id, ts, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS triggers FROM events), m AS (SELECT event_id, ts, max(CASE WHEN triggers >= 2 THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marked FROM t) SELECT event_id, coalesce(marked >= ts - INTERVAL 60 MINUTE, false) AS crisis FROM m",
    "STR16_reverify_slots": "SELECT DISTINCT user_id, date_trunc('hour', ts) AS hour, CAST(floor(minute(ts) / 5) AS INT) AS slot FROM events",
    "STR18_debounced_edit": "WITH n AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) SELECT user_id, event_id, ts + INTERVAL 120 SECOND AS run_after FROM n WHERE after IS NULL OR after > ts + INTERVAL 120 SECOND",
    "STR20_backoff": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 5 THEN 'FAILED' ELSE 'RETRY' END AS status, CAST(30 * power(2, l_linenumber - 1) AS BIGINT) AS job_wait, CAST(least(300 * power(2, l_linenumber), 3600) AS BIGINT) AS translation_wait FROM lineitem",
    "STR26_heartbeat": "WITH t AS (SELECT max(ts) AS as_of FROM events), u AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id) SELECT user_id FROM u CROSS JOIN t WHERE seen < as_of - INTERVAL 900 SECOND",
    "OPS18_field_changes": "WITH b AS (SELECT event_id, event_type, value, lag(event_type) OVER w AS old_type, lag(value) OVER w AS old_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, 'event_type' AS field FROM b WHERE event_type IS DISTINCT FROM old_type UNION ALL SELECT event_id, 'value' AS field FROM b WHERE value IS DISTINCT FROM old_value",
    "FLT13_due_sources": "WITH t AS (SELECT max(ts) AS as_of FROM events), u AS (SELECT user_id, max(ts) AS fetched FROM events WHERE event_type <> 'error' GROUP BY user_id) SELECT c.c_custkey FROM customer c CROSS JOIN t LEFT JOIN u ON u.user_id = c.c_custkey WHERE u.fetched IS NULL OR u.fetched <= t.as_of - INTERVAL 300 SECOND",
}


def query(name: str):
    """The query of a name: views of the tables it reads, then its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in SQL[name]:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(SQL[name])

    run.__name__ = name
    return run


QUERIES = {name: query(name) for name in SQL}
ORACLES = dict(SQL)
