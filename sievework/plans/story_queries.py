"""Queries of items in the order of their source or event, and of what a site writes, on documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.functions import text as T
from sievework.functions.lexicon import EUROPEAN as LEX
from sievework.operators import claims, stories
from sievework.plans import text_queries as Q
from sievework.sources.shared import shared_folder
from sievework.sources import feeds
from sievework.streaming import contexts as live

BASE = "https://news.example"


def _docs(spark, sf):
    at = F.timestamp_seconds(F.col("doc_id") * 50 + F.floor(F.col("doc_id") / 10) * 400 + 1_700_000_000)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 3).alias("channel"), at.alias("at"))


def _turns(spark, sf, t=None):
    """Turns of conversations (or a stream of them) as items of ten channels; every third is a label."""
    t = spark.read.parquet(f"{sf}/conversations.parquet") if t is None else t
    label = F.concat(F.col("role"), F.lit(" "), F.col("conv_id") % 4, F.lit(":"))
    at = F.timestamp_seconds(F.col("conv_id") * 900 + F.col("turn") * 60 + 1_700_000_000)
    return t.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, label).otherwise(F.col("text")).alias("text"), (F.col("conv_id") % 10).alias("channel"), at.alias("at"))


def _contexts(spark, sf):
    return stories.contexts(_turns(spark, sf), "channel", ["at", "conv_id", "turn"], "at", "text", LEX).select("conv_id", "turn", "decision", "reason", "inherited_speaker")


def _live(spark, sf):
    """STR05_contexts from a stream over the same table, whose state is kept by key."""
    path = f"{sf}/conversations.parquet"
    turns = _turns(spark, sf, spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/conversation[s].parquet"))  # a pattern, as a stream's path can't be one file
    rows = turns.withColumn("item_id", F.col("conv_id") * 1000 + F.col("turn"))
    there = shared_folder(spark, "live-contexts")
    live.run_to_end(live.live_contexts(rows, "item_id", "channel", "at", "text", LEX, late="3650 days"), f"{there}/rows", f"{there}/state")
    out = spark.read.parquet(f"{there}/rows")
    return out.select(F.expr("item_id DIV 1000").alias("conv_id"), (F.col("item_id") % 1000).alias("turn"), "decision", "reason", "inherited_speaker")


def _against(spark, sf):
    turns = claims.with_claims(spark.read.parquet(f"{sf}/conversations.parquet"), "text", lex=LEX)
    return stories.against_existing(turns.withColumn("event", F.col("conv_id") % 20).withColumn("at", F.col("conv_id") * 100 + F.col("turn")), "event", "at").select("conv_id", "turn", "decision", "met")


def _material(spark, sf):
    """Five documents in a row are an event's claims."""
    from sievework.functions import rules as R

    text = F.col("text")
    facts = stories.material_facts(text, R.location(text, LEX), LEX, ["que", "the "], ["hehely"], ["sich"])
    kinds = T.once(C.normalized(text), lambda n: F.struct(C.claim_class(n, LEX.classes).alias("class"), C.certainty(n, LEX.reported, LEX.attributed).alias("certainty")))
    d = _docs(spark, sf).select(F.floor(F.col("doc_id") / 5).alias("event"), F.struct("doc_id", kinds.alias("kinds"), facts.alias("facts")).alias("claim"))
    every = d.groupBy("event").agg(F.collect_list("claim").alias("all"))  # five at most, without their texts
    rows = every.select(F.explode("all").alias("claim"), "all").select("claim", F.filter("all", lambda p: p["doc_id"] < F.col("claim.doc_id")).alias("priors"))
    reasons = stories.novel(F.col("claim.facts"), F.col("claim.kinds.class"), F.col("claim.kinds.certainty"), F.transform("priors", lambda p: p["facts"]))
    return rows.select("claim.doc_id", F.array_join(reasons, "|").alias("reasons"))


def _matched(spark, sf):
    """Each document against the three before it."""
    prints = _docs(spark, sf).select("doc_id", stories.event_print(F.col("text"), (F.col("doc_id") % 4).cast("string"), F.col("at"), LEX).alias("print"))
    # stretches of 256 ids, and a copy of each one's last three in the next, so that a print moves once
    stretch = F.floor(F.col("doc_id") / 256)
    rows = prints.select("doc_id", "print", stretch.alias("own"), F.explode(F.array_distinct(F.array(stretch, F.floor((F.col("doc_id") + 3) / 256)))).alias("stretch"))
    before = F.collect_list(F.struct(F.col("doc_id").alias("event_id"), F.col("print").alias("b"))).over(Window.partitionBy("stretch").orderBy("doc_id").rangeBetween(-3, -1))
    pairs = rows.withColumn("before", before).where(F.col("own") == F.col("stretch")).select(F.col("doc_id").alias("item_id"), F.col("print").alias("a"), F.explode_outer("before").alias("e")).select("item_id", "a", "e.event_id", "e.b")
    return stories.matched_events(pairs.withColumn("place", F.col("event_id") - F.col("item_id")))


def _structured(spark, sf):
    found = stories.structured(F.col("text"), LEX)
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", found.alias("c")).select("doc_id", "c.claim_class", "c.quantity", "c.time_ref", "c.certainty", "c.negation", F.md5("c.predicate").alias("predicate"))


def _story(make):
    def run(spark, sf):
        first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
        rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.slug(first).alias("slug"), first.alias("headline"), F.coalesce(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), 1), F.lit("")).alias("lead"), F.date_format(F.timestamp_seconds(F.col("doc_id") * 60 + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss").alias("published"))
        return rows.select("doc_id", make())

    return run


def _heads(spark, sf):
    """Pages whose links are feeds they offer, and whose titles are properties, in either order of attributes."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), '<a href="', '<link rel="alternate" type="application/rss+xml" href="')
    one, two = '<meta property="og:title" content="$1">', '<meta content="$1" property="og:title">'
    html = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(html, "<title>([^<]*)</title>", one)).otherwise(F.regexp_replace(html, "<title>([^<]*)</title>", two))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.array_join(feeds.linked_feeds(html), "|").alias("feeds"), feeds.open_graph(html, "title").alias("title"))


QUERIES = {
    "TXT38_speakers": lambda spark, sf: _turns(spark, sf).select("conv_id", "turn", stories.explicit_speaker(F.col("text")).alias("speaker")),
    "TXT40_structured_claims": _structured,
    "STR03_bursts": lambda spark, sf: stories.bursts(_docs(spark, sf), "doc_id", "channel", "at", "text", lex=LEX),
    "STR05_contexts": _contexts,
    "STR05_live_contexts": _live,
    "STR10_event_matches": _matched,
    "JOIN30_claims_of_event": _against,
    "OPS02_materiality": _material,
    "SNK02_rss_items": _story(lambda: feeds.rss_item(BASE, F.col("slug"), F.col("headline"), F.coalesce("lead", F.lit("")), F.col("published")).alias("item")),
    "SNK03_sitemap": _story(lambda: feeds.sitemap_entry(BASE, F.col("slug"), F.when(F.col("doc_id") % 2 == 0, F.col("published"))).alias("entry")),
    "SNK04_json_ld": _story(lambda: F.sha2(feeds.article_node(BASE, "Desk", "fa", F.col("slug"), F.col("headline"), F.coalesce("lead", F.lit("")), F.col("published")), 256).alias("node")),
    "SRC12_linked_feeds": _heads,
}

_ESC = "replace(replace(replace(replace(replace(X, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_CUT = rf"trim(substring(trim(regexp_replace({Q._FIRST}, '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+', '-', 'g'), '-'), 1, 60), '-')"
_SLUG = f"(CASE WHEN {_CUT} = '' THEN 'story' ELSE {_CUT} END)"
_AT = "strftime(make_timestamp((doc_id * 60 + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%S')"
_LEAD = f"coalesce(string_split({Q._T}, chr(10))[2], '')"
_SITE = f"'{BASE}/story/' || {_ESC.replace('X', _SLUG)}"
_NORMED = f"trim({Q._SPACED})"
_TOKENS = f"list_filter(list_distinct({Q._WORDS}), lambda w: length(w) > 1 AND NOT list_contains({Q._list(LEX.event_stop)}, w))"
_KIND = "CASE " + " ".join(f"WHEN {Q._any(f'lower({Q._T})', k)} THEN {Q._q(n)}" for n, k in LEX.event_types.items()) + " ELSE 'GENERAL_NEWS' END"
_MINUTES = "CASE a.kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in stories.CONTINUATION_MINUTES.items()) + " END"

ORACLES = {
    "TXT38_speakers": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || ' ' || (conv_id % 4) ELSE nullif(CASE WHEN regexp_matches(trim(split_part(trim(text), chr(10), 1)), ':$') THEN trim(rtrim(trim(split_part(trim(text), chr(10), 1)), ':')) ELSE trim(regexp_extract(trim(text), '(?s)^([0-9A-Za-z_][0-9A-Za-z_ .''-]{1,98}?)[ \\t\\n\\r\\f]*:[ \\t\\n\\r\\f]*(.*)$', 1)) END, '') END AS speaker FROM conversations",
    "TXT40_structured_claims": f"""
WITH n AS (SELECT doc_id, {Q._T} AS body, {_NORMED} AS t FROM documents)
SELECT doc_id, CASE {' '.join(f"WHEN {Q._any('t', k)} THEN '{n}'" for n, k in LEX.classes.items())} ELSE 'GENERAL' END AS claim_class, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)*'))), '، ') AS quantity,
       CASE {' '.join(f"WHEN contains(body, '{w}') THEN '{w}'" for w in LEX.time_markers)} END AS time_ref,
       CASE WHEN {Q._any('t', [w.strip() for w in LEX.reported])} THEN 'REPORTED' WHEN {Q._any('t', [w.strip() for w in LEX.attributed])} THEN 'ATTRIBUTED' ELSE 'ASSERTED' END AS certainty,
       {Q._any('t', [w.strip() for w in LEX.negation])} AS negation, md5(substring(body, 1, 80)) AS predicate FROM n""",
    "STR10_event_matches": f"""
WITH p AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS tokens, nullif(lower(regexp_extract({Q._T}, '(?i)({'|'.join(LEX.locations)})', 1)), '') AS place, regexp_matches({Q._T}, '(?i){LEX.second_occurrence}') AS second,
       CASE WHEN regexp_matches({Q._T}, '(?i){LEX.second_occurrence}') THEN 'LIVE_INCIDENT' ELSE {_KIND} END AS kind, doc_id * 50 + doc_id // 10 * 400 AS at, doc_id % 4 AS actor FROM documents),
c AS (SELECT a.doc_id AS item, b.doc_id AS cand, a.doc_id - b.doc_id AS back,
       (a.second AND b.at < a.at) OR coalesce(a.place <> b.place AND a.kind IN ('MILITARY_STRIKE', 'LIVE_INCIDENT', 'INTERNET_OUTAGE'), false)
       OR (a.kind <> b.kind AND (a.kind IN ('MILITARY_STRIKE', 'INTERNET_OUTAGE') OR b.kind IN ('MILITARY_STRIKE', 'INTERNET_OUTAGE') OR (a.kind = 'POLITICAL_ANNOUNCEMENT' AND b.kind IN ('INTERVIEW', 'PRESS_CONFERENCE')) OR (b.kind = 'POLITICAL_ANNOUNCEMENT' AND a.kind IN ('INTERVIEW', 'PRESS_CONFERENCE'))))
       OR abs(b.at - a.at) > 60 * {_MINUTES} AS conflict,
       len(list_intersect(a.tokens, b.tokens)) AS shared, len(a.tokens) AS na, len(b.tokens) AS nb, a.place AS pa, b.place AS pb, a.kind AS ka, b.kind AS kb, abs(b.at - a.at) AS apart, a.actor = b.actor AS same
      FROM p a JOIN p b ON b.doc_id BETWEEN a.doc_id - 3 AND a.doc_id - 1),
r AS (SELECT *, 0.30::DOUBLE * same::INT + 0.25::DOUBLE * CASE WHEN least(na, nb) = 0 THEN 0 ELSE greatest(shared::DOUBLE / (na + nb - shared), shared::DOUBLE / least(na, nb)) END
       + 0.15::DOUBLE * CASE WHEN pa = pb THEN 1 WHEN pa <> pb THEN 0 ELSE 0.5::DOUBLE END + 0.15::DOUBLE * (ka = kb)::INT + 0.10::DOUBLE * greatest(0, 1 - apart::DOUBLE / 21600) AS reduced FROM c),
t AS (SELECT *, round(reduced, 9) AS rr, round(reduced + CASE WHEN pa = pb AND ka = kb AND ka IN ('LIVE_INCIDENT', 'MILITARY_STRIKE') THEN 0.35::DOUBLE ELSE 0 END, 9) AS total FROM r),
o AS (SELECT * FROM t WHERE NOT conflict),
b AS (SELECT item, arg_max(cand, (total, back)) AS best, max(total) AS top FROM o GROUP BY item),
u AS (SELECT o.item, arg_max(o.rr, o.back) AS runner FROM o JOIN b ON b.item = o.item AND b.best <> o.cand GROUP BY o.item),
f AS (SELECT p.doc_id AS item_id, b.best, b.top, u.runner, (SELECT count(*) FROM p q WHERE q.doc_id BETWEEN p.doc_id - 3 AND p.doc_id - 1) AS n FROM p LEFT JOIN b ON b.item = p.doc_id LEFT JOIN u ON u.item = p.doc_id),
d AS (SELECT *, CASE WHEN best IS NULL THEN 'CREATE_NEW' WHEN top >= 0.62 THEN 'ATTACH_EXISTING' WHEN abs(top - runner) <= 0.12 THEN 'AMBIGUOUS_EVENT' ELSE 'CREATE_NEW' END AS decision FROM f)
SELECT item_id, decision, CASE WHEN decision <> 'CREATE_NEW' THEN best END AS event_id, CASE WHEN n = 0 THEN 'NO_CANDIDATES' WHEN best IS NULL THEN 'ALL_CANDIDATES_CONFLICT' WHEN decision = 'AMBIGUOUS_EVENT' THEN 'SCORE_IN_AMBIGUOUS_BAND' WHEN decision = 'CREATE_NEW' THEN 'BELOW_ATTACH_THRESHOLD' END AS reason FROM d""",
    "SNK02_rss_items": f"SELECT doc_id, '<item><title>' || {_ESC.replace('X', Q._FIRST)} || '</title><link>' || {_SITE} || '</link><guid>' || {_SITE} || '</guid><pubDate>' || {_AT} || '</pubDate><description>' || {_ESC.replace('X', _LEAD)} || '</description></item>' AS item FROM documents",
    "SNK03_sitemap": f"SELECT doc_id, '<url><loc>' || {_SITE} || '</loc>' || CASE WHEN doc_id % 2 = 0 THEN '<lastmod>' || {_AT} || '</lastmod>' ELSE '' END || '</url>' AS entry FROM documents",
    "SNK04_json_ld": f"""SELECT doc_id, sha256('{{"@type":"NewsArticle","@id":"{BASE}/story/' || s || '#article","headline":' || to_json(h) || ',"description":' || to_json(l) || ',"inLanguage":"fa","datePublished":"' || a || '","mainEntityOfPage":{{"@type":"WebPage","@id":"{BASE}/story/' || s || '"}},"url":"{BASE}/story/' || s || '","publisher":{{"@id":"{BASE}/#organization"}},"author":{{"@type":"Organization","@id":"{BASE}/#organization","name":"Desk"}},"isAccessibleForFree":true}}') AS node
FROM (SELECT doc_id, {_SLUG} AS s, {Q._FIRST} AS h, {_LEAD} AS l, {_AT} AS a FROM documents)""",
    "SRC12_linked_feeds": "SELECT page_id, array_to_string(regexp_extract_all(coalesce(html, ''), '<a href=\"([^\"'']+)', 1), '|') AS feeds, nullif(regexp_extract(coalesce(html, ''), '<title>([^<\"'']*)', 1), '') AS title FROM pages",
}
