"""Registries, endpoints and page views on the star schema and pages, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import registry as R

WORDS = ["", "real time", "1-2 min", "3–5 min", "5-15 minutes", "30 min", "event-driven", "daily digest", "slow"]
USES = ["Official statements", "Person", "OSINT lead", "analysis only", "news", ""]
INDEPENDENT = ["Yes", "No", "No - same entity as above", ""]
KINDS = ["newsroom", "government", "reporter", "data set", ""]
MEDIA = ["Telegram", "RSS", "web", "X", "Truth Social", "unknown"]


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _rows(spark, sf):
    """Suppliers as endpoints of a registry; one in nine without an address, two in a row share an entity."""
    k = F.col("s_suppkey")
    medium = _pick(MEDIA, k)
    address = F.when(k % 9 == 0, "").when(k % 6 == 0, F.concat(F.lit("https://t.me/s/Chan_"), F.expr("s_suppkey DIV 4"))).when(k % 12 == 6, "https://t.me/joinchat").otherwise(F.concat(F.lit("https://e.example/"), F.expr("s_suppkey DIV 4")))
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select(F.concat(F.lit(" E"), F.expr("s_suppkey DIV 2"), F.lit(" ")).alias("entity"), F.when(k % 5 == 0, "").otherwise(F.col("s_name")).alias("name"), medium.alias("platform"), address.alias("url"), F.when(k % 4 == 0, "English").when(k % 4 == 1, "FA").alias("language"), _pick(KINDS, k * 7).alias("kind"), _pick(USES, k * 5).alias("trust_use"), _pick(INDEPENDENT, k * 3).alias("independent"), _pick(WORDS, k).alias("speed"), F.when(k % 2 == 0, F.col("s_name")).alias("focus"), k.alias("nth"))


def _import(spark, sf):
    """The registry's second half upon its first, then the whole again."""
    rows = _rows(spark, sf)
    names = R.endpoint_rows(rows.where("false")).columns
    each = R.endpoint_rows(rows).alias("e")
    keyed = R.endpoint_rows(rows.withColumn("focus", F.concat_ws("\x01", F.coalesce("focus", F.lit("")), F.col("nth").cast("string"))))
    keyed = keyed.withColumn("nth", F.element_at(F.split("focus", "\x01"), -1).cast("long")).withColumn("focus", F.element_at(F.split("focus", "\x01"), 1))
    table = R.imported(each.where("false").select(names), keyed.where("nth % 2 = 1"), "nth")
    return R.imported(R.imported(table, keyed.where("nth % 2 = 0"), "nth"), keyed.where("nth % 2 = 0"), "nth").select("identity", "platform", "url", "name", "language", "external_id", "source_role", "verification_allowed", "can_increase", "polling_seconds", "endpoint_state", "focus")


def _texts(spark, sf):
    return _rows(spark, sf).select("nth", R.speed(F.col("speed")).alias("s"), R.trust(F.col("trust_use"), F.col("independent"), F.col("kind")).alias("t")).select("nth", "s.tier", "s.seconds", "t.role", "t.verification_allowed", "t.can_increase")


def _endpoints(spark, sf):
    """Pages' addresses as they are, as handles, and at private addresses."""
    k, url = F.col("page_id"), F.col("url")
    raw = F.when(k % 6 == 0, F.concat(F.lit(" @chan_"), k)).when(k % 6 == 1, F.concat(F.lit("t.me/chan_"), k, F.lit("/"))).when(k % 6 == 2, F.regexp_replace(url, "//[^/?#]*", "//10.0.0.8:80")).when(k % 6 == 3, F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/Feed"))).when(k % 6 == 4, F.regexp_replace(url, "^http", "ftp")).otherwise(url)
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", R.endpoint(raw).alias("e"), R.channel_handle(F.concat(F.lit("https://t.me/s/"), raw)).alias("handle")).select("page_id", "e.platform", "e.external_id", "e.url", "handle")


def _views(spark, sf):
    """Pages' addresses as what was viewed and as referrers; two days, the first counted before."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    k = F.col("page_id")
    path = F.when(k % 5 == 0, "/latest").when(k % 5 == 1, F.concat(F.lit("/story/"), k % 7)).when(k % 5 == 2, F.lit("")).otherwise(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1))
    made = R.view_keys(path, F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, "newsletter"), F.when(k % 4 == 0, "mail"), F.lit(None).cast("string"), F.when(k % 8 == 0, "may"))
    rows = p.select((k % 2).alias("day"), made.alias("v")).select("day", "v.*")
    before = R.counted_views(rows.where("false").withColumn("views", F.lit(0).cast("long")), rows.where("day = 0"), "day")
    return R.counted_views(before, rows, "day")


QUERIES = {"TXT55_speed_and_trust": _texts, "OPS16_registry_import": _import, "TXT58_endpoints": _endpoints, "TXT59_page_views": _views}


def _at(values: list[str], n: str) -> str:
    return f"[{', '.join(chr(39) + v + chr(39) for v in values)}][({n}) % {len(values)} + 1]"


_K = "s_suppkey"
_REG = f"""r AS (SELECT {_K} AS nth, 'E' || ({_K} // 2) AS identity, CASE WHEN {_K} % 5 = 0 THEN '' ELSE s_name END AS nm, lower({_at(MEDIA, _K)}) AS raw, CASE WHEN {_K} % 9 = 0 THEN '' WHEN {_K} % 6 = 0 THEN 'https://t.me/s/Chan_' || ({_K} // 4) WHEN {_K} % 12 = 6 THEN 'https://t.me/joinchat' ELSE 'https://e.example/' || ({_K} // 4) END AS url,
 CASE {_K} % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'fa' ELSE 'en' END AS language, lower({_at(KINDS, _K + ' * 7')}) AS k, lower({_at(USES, _K + ' * 5')}) AS u, lower({_at(INDEPENDENT, _K + ' * 3')}) AS i, {_at(WORDS, _K)} AS s, CASE WHEN {_K} % 2 = 0 THEN s_name ELSE '' END AS focus FROM supplier),
t AS (SELECT *, CASE raw WHEN 'telegram' THEN 'telegram' WHEN 'rss' THEN 'rss' WHEN 'x' THEN 'x' WHEN 'truth social' THEN 'x' ELSE 'website' END AS platform,
 CASE s WHEN '' THEN 'MID' WHEN 'real time' THEN 'FAST' WHEN '1-2 min' THEN 'FAST' WHEN '3–5 min' THEN 'MID' WHEN '5-15 minutes' THEN 'SLOW' WHEN '30 min' THEN 'SLOW' WHEN 'slow' THEN 'MID' ELSE 'EVENT' END AS tier, CASE s WHEN '' THEN 300 WHEN 'real time' THEN 120 WHEN '1-2 min' THEN 120 WHEN '3–5 min' THEN 240 WHEN '5-15 minutes' THEN 600 WHEN '30 min' THEN 900 WHEN 'slow' THEN 240 ELSE 1800 END AS seconds,
 CASE WHEN u = 'official statements' OR k = 'government' THEN 'OFFICIAL_PRIMARY' WHEN u = 'person' OR k = 'reporter' THEN 'PERSON_STATEMENT' WHEN u = 'osint lead' OR k = 'data set' THEN 'OSINT_DATA' WHEN u = 'analysis only' THEN 'ANALYSIS' ELSE 'INDEPENDENT_NEWSROOM' END AS role FROM r),
b AS (SELECT *, role = 'INDEPENDENT_NEWSROOM' AND NOT (i LIKE 'no%' AND i LIKE '%same%') AS va, CASE role WHEN 'OSINT_DATA' THEN NOT starts_with(i, 'no') WHEN 'INDEPENDENT_NEWSROOM' THEN NOT (i LIKE 'no%' AND i LIKE '%same%') ELSE false END AS ci FROM t)"""
_RAW = r"CASE page_id % 6 WHEN 0 THEN ' @chan_' || page_id WHEN 1 THEN 't.me/chan_' || page_id || '/' WHEN 2 THEN regexp_replace(url, '//[^/?#]*', '//10.0.0.8:80') WHEN 3 THEN regexp_replace(url, '[?#].*$', '') || '/Feed' WHEN 4 THEN regexp_replace(url, '^http', 'ftp') ELSE url END"
ORACLES = {
    "TXT55_speed_and_trust": f"WITH {_REG} SELECT nth, tier, seconds::INT AS seconds, role, va AS verification_allowed, ci AS can_increase FROM b",
    "OPS16_registry_import": f"""
WITH {_REG}, o AS (SELECT *, row_number() OVER (PARTITION BY identity, platform, url ORDER BY nth % 2 = 0, nth) AS f, row_number() OVER (PARTITION BY identity, platform, url ORDER BY nth % 2 = 0 DESC, nth DESC) AS l FROM b WHERE url <> '')
SELECT a.identity, a.platform, a.url, CASE WHEN a.nm = '' THEN a.identity ELSE a.nm END AS name, a.language, CASE WHEN a.platform = 'telegram' AND a.url LIKE '%Chan_%' THEN split_part(a.url, '/', 5) ELSE '' END AS external_id,
 CASE z.role WHEN 'INDEPENDENT_NEWSROOM' THEN 'MAJOR_NEWSROOM' WHEN 'OFFICIAL_PRIMARY' THEN 'OFFICIAL_PRIMARY' WHEN 'PERSON_STATEMENT' THEN 'JOURNALIST' ELSE 'AGGREGATOR' END AS source_role, z.va AS verification_allowed, z.ci AS can_increase, z.seconds::INT AS polling_seconds, CASE a.platform WHEN 'x' THEN 'BLOCKED_AUTH' WHEN 'website' THEN 'UNSUPPORTED' ELSE 'ACTIVE' END AS endpoint_state, z.focus
FROM o a JOIN o z ON z.identity = a.identity AND z.platform = a.platform AND z.url = a.url AND z.l = 1 WHERE a.f = 1""",
    "TXT58_endpoints": f"""
WITH x AS (SELECT page_id, trim({_RAW}) AS t, {_RAW} AS r FROM pages), y AS (SELECT *, CASE WHEN t LIKE '@%' THEN t[2:] ELSE regexp_extract(t, '{R.CHANNEL_URL}', 1) END AS h, regexp_extract(t, '(?i)^https?://([^/?#]*)', 1) AS n, lower(regexp_extract(t, '(?i)^https?://[^/?#]*([^?#]*)', 1)) AS path FROM x)
SELECT page_id, CASE WHEN h <> '' THEN 'telegram' WHEN n <> '' AND NOT n LIKE '10.%' THEN CASE WHEN regexp_matches(path, '(\\.xml|\\.rss|/feed|/rss|/atom)$') THEN 'rss' ELSE 'website' END END AS platform, CASE WHEN h <> '' THEN h WHEN n <> '' AND NOT n LIKE '10.%' THEN n END AS external_id, CASE WHEN h <> '' THEN 'https://t.me/s/' || h WHEN n <> '' AND NOT n LIKE '10.%' THEN t END AS url,
 CASE WHEN lower(regexp_extract('https://t.me/s/' || r, 't\\.me/(?:s/)?([A-Za-z0-9_]{{3,64}})', 1)) IN ('s', 'joinchat', 'c') THEN '' ELSE regexp_extract('https://t.me/s/' || r, 't\\.me/(?:s/)?([A-Za-z0-9_]{{3,64}})', 1) END AS handle FROM y""",
    "TXT59_page_views": r"""
WITH p AS (SELECT page_id % 2 AS day, page_id AS k, url, CASE page_id % 5 WHEN 0 THEN '/latest' WHEN 1 THEN '/story/' || (page_id % 7) WHEN 2 THEN '' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END AS path FROM pages),
v AS (SELECT day, CASE WHEN path IN ('', '/') THEN 'home' WHEN path = '/latest' THEN 'latest' WHEN starts_with(path, '/story/') THEN 'story:' || split_part(path, '/', 3) WHEN path IN ('/feed.xml') THEN 'rss' ELSE 'page:' || CASE WHEN split_part(path, '/', 2) = '' THEN 'other' ELSE substring(split_part(path, '/', 2), 1, 20) END END AS path_class,
 CASE k % 3 WHEN 0 THEN substring(split_part(url, '/', 3), 1, 60) WHEN 1 THEN 'newsletter' ELSE '-' END AS referrer_host, CASE WHEN k % 4 = 0 THEN 'mail' ELSE '-' END || '|-|' || CASE WHEN k % 8 = 0 THEN 'may' ELSE '-' END AS utm FROM p)
SELECT day, path_class, referrer_host, utm, sum(CASE WHEN day = 0 THEN 2 ELSE 1 END)::BIGINT AS views FROM v GROUP BY ALL""",
}
