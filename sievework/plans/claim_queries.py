"""Claims against claims, evidence groups and origins, with SQL that compares every pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.functions.lexicon import EUROPEAN as LEX
from sievework.operators import claims, origins, recent
from sievework.sources import newsroom


def _turns(spark, sf):
    """Turns of conversations as claims of the conversation, the second one a repeat of the first turn three conversations before, with three words more."""
    t = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    first = t.where("turn = 0").select((F.col("conv_id") + 3).alias("conv_id"), F.col("text").alias("before"))
    rows = t.join(first, "conv_id", "left").withColumn("text", F.when(F.col("turn") == 1, F.concat(F.coalesce("before", F.lit("")), F.lit(" and so on"))).otherwise(F.col("text")))
    return claims.with_claims(rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("claim_id"), F.col("conv_id").alias("event_id"), "text"), "text", lex=LEX)


def _joined(spark, sf):
    return recent.joined_events(_turns(spark, sf), "claim_id", "event_id")


def _across(spark, sf):
    d = _turns(spark, sf).select("claim_id", "event_id", "claim")
    kind = F.when(F.col("event_id") % 3 == 0, "INTERVIEW").when(F.col("event_id") % 3 == 1, "MILITARY_STRIKE").otherwise("GENERAL_NEWS")
    e = d.select("event_id").distinct().select("event_id", kind.alias("kind"), F.timestamp_seconds(F.col("event_id") * 1200 + 1_700_000_000).alias("last_seen"))
    return recent.same_across_events(d, e)


def _items(spark, sf):
    """Twenty documents in a row are an event's items; every third source is trusted."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.floor(F.col("doc_id") / 20).cast("long").alias("event"), F.col("doc_id").alias("item_id"), F.coalesce("source", F.lit("")).alias("title"), "text", F.concat(F.lit("dom:"), F.col("doc_id") % 4).alias("lineage"), (F.col("doc_id") % 3 == 0).alias("trusted"))


def _words(t):
    return F.array_distinct(F.filter(F.split(t, r"[\s\x0b\x1c-\x1f]+"), lambda w: w != ""))


def _sentences(spark, sf):
    """The sentences of every item as claims of its event."""
    rows = _items(spark, sf).select("event", "item_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.!?]")).alias("nth", "sentence"))
    return rows.select("event", (F.col("item_id") * 100_000 + F.col("nth")).alias("claim_id"), _words(F.col("sentence")).alias("words"))


def _best(spark, sf):
    g = recent.evidence_groups(_items(spark, sf))
    return recent.best_groups(_sentences(spark, sf), g.select("event", "place", _words(F.col("line")).alias("words")))


def _sources(spark, sf):
    s = newsroom.sources(spark, sf)
    k = F.col("source_id")
    stable = F.when(k % 4 == 0, F.concat(F.lit("-100"), k + 1000)).when(k % 4 == 2, (k + 1000).cast("string"))
    return s.select("source_id", "identity", "name", F.concat(F.lit("https://T.example/s/"), F.substring(F.sha2(k.cast("string"), 256), 1, 3)).alias("url"), F.when(F.col("balance") < 0, origins.LIMITED).otherwise("APPROVED").alias("status"), stable.alias("stable_id"), F.when(k % 3 == 0, F.concat(F.lit("h"), k)).alias("handle"))


def _forwarded(spark, sf):
    """Events as forwarded messages: usernames and titles that are identities, parts of names or addresses, or nobody's."""
    e, n = F.col("event_id"), F.col("user_id")
    user = F.when(e % 5 == 0, F.concat(F.lit("@Nation "), n % 25)).when(e % 5 == 1, F.concat(F.lit("supplier#00000"), n % 100)).when(e % 5 == 2, F.concat(F.lit("@"), F.substring(F.sha2((n % 40).cast("string"), 256), 1, 3)))
    title = F.when(e % 3 == 0, F.concat(F.lit("#"), F.lpad((n % 90).cast("string"), 9, "0"))).when(e % 3 == 1, F.substring(n.cast("string"), 1, 2))
    return spark.read.parquet(f"{sf}/events.parquet").select(e.alias("message_id"), user.alias("username"), title.alias("title"))


def _peers(spark, sf):
    e, n = F.col("event_id"), F.col("user_id") + 1000
    peer = F.when(e % 5 == 0, F.concat(F.lit("-100"), n)).when(e % 5 == 1, n.cast("string")).when(e % 5 == 2, F.concat(F.lit("-"), n)).when(e % 5 == 3, F.concat(F.lit("@h"), n - 1000)).when(e % 10 == 4, F.concat(F.lit("h"), n - 1000))
    return spark.read.parquet(f"{sf}/events.parquet").select(e.alias("message_id"), peer.alias("peer_id"))


QUERIES = {
    "JOIN31_recent_claims": _joined,
    "JOIN32_same_across_events": _across,
    "AGG17_evidence_groups": lambda spark, sf: recent.evidence_groups(_items(spark, sf)).select("event", "key", "n_items", "independent", "place"),
    "JOIN34_best_overlap": _best,
    "OPS20_forward_origins": lambda spark, sf: origins.mapped_origins(_forwarded(spark, sf), _sources(spark, sf)),
    "OPS19_peers": lambda spark, sf: origins.resolved_peers(_peers(spark, sf), _sources(spark, sf)),
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w.replace(C.ZWNJ, ' ').strip())})" for w in words) + ")"


def _normal(t: str) -> str:
    return f"trim(regexp_replace(translate(coalesce({t}, ''), '{C.DIGITS[0] + C.ZWNJ}يك', '{C.DIGITS[1]} یک'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def claim_sql(rows: str, text: str = "text") -> str:
    """The rows with what a claim without actor and place is compared by."""
    kind = "CASE " + " ".join(f"WHEN {_any('n', k)} THEN '{c}'" for c, k in LEX.classes.items()) + " ELSE 'GENERAL' END"
    return f"""(SELECT *, substring(sha256(concat_ws('|', '', head, '', '', array_to_string(qty, ','), CASE WHEN neg THEN 'NEG' ELSE 'POS' END, kind)), 1, 16) AS print, list_filter(toks, lambda w: NOT list_contains({C.LIGHT_WORDS!r}, w)) AS heavy FROM (
 SELECT *, {_any('n', LEX.negation)} AS neg, {kind} AS kind, CASE WHEN {_any('n', LEX.reported)} THEN 'REPORTED' WHEN {_any('n', LEX.attributed)} THEN 'ATTRIBUTED' ELSE 'ASSERTED' END AS cert, list_sort(list_distinct(regexp_extract_all(n, '[0-9]+(?:[.,][0-9]+)*'))) AS qty, list_distinct(list_filter(string_split(lower(n), ' '), lambda w: length(w) > 1)) AS toks
 FROM (SELECT *, {_normal(text)} AS n, {_normal(f'substring({text}, 1, 80)')} AS head FROM {rows}) AS r0) AS r1)"""


_SHARED, _HEAVY = "len(list_intersect(a.toks, b.toks))", "len(list_intersect(a.heavy, b.heavy))"
_UNION = f"(len(a.toks) + len(b.toks) - {_SHARED})"
_J = f"(CASE WHEN {_UNION} = 0 THEN 0.0 ELSE {_SHARED}::DOUBLE / {_UNION} END)"
_CONTAINED = f"(CASE WHEN least(len(a.toks), len(b.toks)) = 0 THEN 0.0 ELSE {_SHARED}::DOUBLE / least(len(a.toks), len(b.toks)) END)"
_ALIKE = f"({_J} >= 0.55 OR {_CONTAINED} >= 0.8 OR ({_HEAVY} >= greatest(3.0, 0.25 * greatest(least(len(a.heavy), len(b.heavy)), 1)) AND {_J} >= 0.30))"
_CONFLICT = f"((a.neg <> b.neg AND {_HEAVY} >= 4) OR (len(a.qty) > 0 AND len(b.qty) > 0 AND NOT list_has_any(a.qty, b.qty)) OR (a.cert <> b.cert AND (a.cert = 'REPORTED' OR b.cert = 'REPORTED')))"
#: STR-09 of claims without actor and place.
DECISION = f"CASE WHEN a.print = b.print THEN 'SAME_CLAIM' WHEN {_CONFLICT} THEN 'POTENTIAL_CONTRADICTION' WHEN {_ALIKE} AND a.cert = b.cert THEN 'SAME_CLAIM' WHEN {_J} >= 0.40 THEN 'AMBIGUOUS_CLAIM' ELSE 'NEW_CLAIM' END"
_HJ = f"(CASE WHEN len(a.heavy) + len(b.heavy) - {_HEAVY} = 0 THEN 0.0 ELSE {_HEAVY}::DOUBLE / (len(a.heavy) + len(b.heavy) - {_HEAVY}) END)"
_VIA = f"CASE d WHEN 'SAME_CLAIM' THEN 'SAME_CLAIM' WHEN 'POTENTIAL_CONTRADICTION' THEN CASE WHEN {_J} >= 0.40 AND {_HEAVY} >= 3 THEN 'CONTRADICTION' END WHEN 'AMBIGUOUS_CLAIM' THEN CASE WHEN {_HJ} >= 0.6 THEN 'AMBIGUOUS' END END"
_TURNS = "(SELECT a.conv_id * 100 + a.turn AS claim_id, a.conv_id AS event_id, CASE WHEN a.turn = 1 THEN coalesce(b.text, '') || ' and so on' ELSE coalesce(a.text, '') END AS text FROM conversations a LEFT JOIN conversations b ON b.turn = 0 AND b.conv_id + 3 = a.conv_id)"
_ITEMS = "(SELECT doc_id // 20 AS event, doc_id AS item_id, coalesce(source, '') || chr(10) || coalesce(text, '') AS t, 'dom:' || (doc_id % 4) AS lineage, doc_id % 3 = 0 AS trusted FROM documents)"
_GROUPS = f"""
l AS (SELECT event, item_id, lineage, trusted, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: regexp_replace(s, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda s: length(s) > 25 AND length(s) < 300)[1:5] AS ls FROM {_ITEMS}),
x AS (SELECT event, item_id, lineage, trusted, unnest(ls) AS line, generate_subscripts(ls, 1) AS nth FROM l),
g AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY item_id, nth) AS place FROM (SELECT event, sha256(line)[1:16] AS key, min(line) AS line, count(*) AS n_items, count(DISTINCT CASE WHEN trusted THEN lineage END) AS independent, min({{'i': item_id, 'n': nth}}) AS f, min(item_id) AS item_id, min({{'i': item_id, 'n': nth}}).n AS nth FROM x GROUP BY 1, 2) AS y)"""
_SOURCES = """(SELECT s_suppkey AS source_id, CASE WHEN s_nationkey % 3 = 0 THEN 'Nation ' || s_nationkey ELSE '' END AS identity, s_name AS name, 'https://T.example/s/' || sha256(s_suppkey::VARCHAR)[1:3] AS url, round(s_acctbal)::INT < 0 AS limited,
 CASE s_suppkey % 4 WHEN 0 THEN '-100' || (s_suppkey + 1000) WHEN 2 THEN (s_suppkey + 1000)::VARCHAR END AS stable_id, CASE WHEN s_suppkey % 3 = 0 THEN 'h' || s_suppkey END AS handle FROM supplier)"""
ORACLES = {
    "JOIN31_recent_claims": f"""
WITH c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY claim_id) AS place FROM {claim_sql(_TURNS)}),
e AS (SELECT claim_id, lag(event_id) OVER (PARTITION BY print ORDER BY place) AS exact FROM c),
p AS (SELECT a.claim_id, b.place, b.event_id, {_VIA.replace('CASE d', f'CASE {DECISION}')} AS via FROM c a JOIN c b ON b.place < a.place AND b.place >= a.place - 40 WHERE len(a.heavy) > 0),
n AS (SELECT claim_id, max({{'p': place, 'e': event_id, 'v': via}}) AS near FROM p WHERE via IS NOT NULL GROUP BY claim_id)
SELECT e.claim_id, coalesce(exact, near.e) AS joined_event, CASE WHEN exact IS NOT NULL THEN 'FINGERPRINT' ELSE near.v END AS via FROM e LEFT JOIN n ON n.claim_id = e.claim_id""",
    "JOIN32_same_across_events": f"""
WITH c AS MATERIALIZED (SELECT *, event_id * 1200 AS us, CASE event_id % 3 WHEN 0 THEN 240 WHEN 1 THEN 45 ELSE 90 END * 60 AS w, row_number() OVER (PARTITION BY event_id ORDER BY claim_id) AS nth FROM {claim_sql(_TURNS)})
SELECT a.event_id AS event_a, b.event_id AS event_b, a.claim_id AS claim_a, b.claim_id AS claim_b FROM c a JOIN c b ON a.event_id < b.event_id AND abs(a.us - b.us) <= a.w WHERE a.nth <= 3 AND b.nth <= 3 AND {DECISION} = 'SAME_CLAIM'""",
    "AGG17_evidence_groups": f"WITH {_GROUPS} SELECT event, key, n_items, independent, place::INT AS place FROM g",
    "JOIN34_best_overlap": f"""
WITH {_GROUPS}, s AS (SELECT event, item_id, unnest(z) AS s, generate_subscripts(z, 1) - 1 AS k FROM (SELECT doc_id // 20 AS event, doc_id AS item_id, regexp_split_to_array(coalesce(text, ''), '[.!?]') AS z FROM documents)),
c AS (SELECT event, item_id * 100000 + k AS claim_id, list_distinct(list_filter(regexp_split_to_array(s, '[\\s\\x0b\\x1c-\\x1f]+'), lambda w: w <> '')) AS mine FROM s),
h AS (SELECT event, place, list_distinct(list_filter(regexp_split_to_array(line, '[\\s\\x0b\\x1c-\\x1f]+'), lambda w: w <> '')) AS theirs FROM g),
p AS (SELECT c.claim_id, h.place, len(list_intersect(mine, theirs)) AS overlap FROM c JOIN h ON h.event = c.event)
SELECT claim_id, place::INT AS place, overlap::INT AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY overlap DESC, place) AS k FROM p WHERE overlap > 0) AS r WHERE k = 1""",
    "OPS20_forward_origins": f"""
WITH s AS (SELECT * FROM {_SOURCES} WHERE NOT limited), m AS (SELECT event_id AS message_id, ltrim(coalesce(CASE event_id % 5 WHEN 0 THEN '@Nation ' || (user_id % 25) WHEN 1 THEN 'supplier#00000' || (user_id % 100) WHEN 2 THEN '@' || sha256((user_id % 40)::VARCHAR)[1:3] END, ''), '@') AS u,
 coalesce(CASE event_id % 3 WHEN 0 THEN '#' || lpad((user_id % 90)::VARCHAR, 9, '0') WHEN 1 THEN user_id::VARCHAR[1:2] END, '') AS t FROM events),
p AS (SELECT DISTINCT unnest([u, t]) AS p FROM m), f AS (SELECT p, min({{'b': identity = '', 'i': source_id}}).i AS id FROM p JOIN s ON identity = p OR contains(lower(name), lower(p)) OR contains(lower(url), lower(p)) WHERE p <> '' GROUP BY p)
SELECT message_id, coalesce(a.id, b.id) AS source_id, CASE WHEN t <> '' THEN t WHEN u <> '' THEN '@' || u ELSE '{origins.UNKNOWN}' END AS reported FROM m LEFT JOIN f a ON a.p = u LEFT JOIN f b ON b.p = t""".replace("user_id::VARCHAR[1:2]", "substring(user_id::VARCHAR, 1, 2)"),
    "OPS19_peers": f"""
WITH m AS (SELECT event_id AS message_id, CASE WHEN event_id % 5 = 0 THEN '-100' || (user_id + 1000) WHEN event_id % 5 = 1 THEN (user_id + 1000)::VARCHAR WHEN event_id % 5 = 2 THEN '-' || (user_id + 1000) WHEN event_id % 5 = 3 THEN '@h' || user_id WHEN event_id % 10 = 4 THEN 'h' || user_id END AS p FROM events),
d AS (SELECT *, ltrim(CASE WHEN starts_with(p, '-100') THEN p[5:] ELSE p END, '-') AS digits FROM m), s AS MATERIALIZED (SELECT * FROM {_SOURCES})
SELECT message_id, coalesce((SELECT min(source_id) FROM s WHERE stable_id IN (p, digits, '-100' || digits)), (SELECT min(source_id) FROM s WHERE p IN (handle, '@' || handle))) AS source_id FROM d""",
}
#: The comparisons of the other queries, by the same rules.
ORACLES["STR09_claim_compare"] = f"""
WITH c AS (SELECT * FROM {claim_sql('conversations')})
SELECT a.conv_id, a.turn, CASE WHEN b.turn IS NULL THEN 'NEW_CLAIM' ELSE {DECISION} END AS decision, CASE WHEN b.turn IS NULL OR a.print = b.print THEN '' ELSE
 array_to_string(list_filter([CASE WHEN a.neg <> b.neg AND {_HEAVY} >= 4 THEN 'NEGATION_DIFFERS' END, CASE WHEN len(a.qty) > 0 AND len(b.qty) > 0 AND NOT list_has_any(a.qty, b.qty) THEN 'NUMBERS_DIFFER' END, CASE WHEN a.cert <> b.cert AND (a.cert = 'REPORTED' OR b.cert = 'REPORTED') THEN 'CERTAINTY_DIFFERS' END], lambda x: x IS NOT NULL), '|') END AS conflicts
FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = (SELECT max(turn) FROM conversations z WHERE z.conv_id = a.conv_id AND z.turn < a.turn)"""
ORACLES["JOIN30_claims_of_event"] = f"""
WITH c AS MATERIALIZED (SELECT *, conv_id % 20 AS event, conv_id * 100 + turn AS us, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id * 100 + turn) AS place FROM {claim_sql('conversations')}),
p AS (SELECT a.conv_id, a.turn, b.us, {DECISION} AS d FROM c a JOIN c b ON b.event = a.event AND b.place <= 50 AND b.us < a.us),
m AS (SELECT conv_id, turn, min(us) FILTER (d = 'SAME_CLAIM') AS same, min(us) FILTER (d = 'POTENTIAL_CONTRADICTION') AS against FROM p GROUP BY ALL)
SELECT c.conv_id, c.turn, CASE WHEN same IS NOT NULL THEN 'SAME_CLAIM' WHEN against IS NOT NULL THEN 'POTENTIAL_CONTRADICTION' ELSE 'NEW_CLAIM' END AS decision, coalesce(same, against) AS met FROM c LEFT JOIN m ON m.conv_id = c.conv_id AND m.turn = c.turn"""
