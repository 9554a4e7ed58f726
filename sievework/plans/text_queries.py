"""Queries of the rules over text, on documents and pages, with SQL written from what each rule says."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.functions import rules as R
from sievework.functions.lexicon import EUROPEAN as LEX

LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"


def _docs(make):
    def run(spark, sf_dir):
        made = make(F.col("text"))
        return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *(made if isinstance(made, list) else [made]))

    return run


def _first(t):
    return F.substring_index(F.coalesce(t, F.lit("")), "\n", 1)


def _urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", R.canonical_url(F.col("url")).alias("canonical"))


def _identities(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", R.identity_key(F.col("s_name"), {"#000000001": "first"}).alias("identity"))


def _topic(t):
    found = R.topic(t, LEX)
    return [found["topic"].alias("topic"), found["weight"].alias("weight"), R.tier(found["weight"]).alias("tier")]


def _scores(t):
    home, near = R.language_scores(t, LEX)
    return [home.alias("home"), near.alias("near")]


QUERIES = {
    "TXT01_canonical_url": _urls,
    "TXT11_event_tokens": _docs(lambda t: F.size(R.event_tokens(t, LEX)).alias("n_tokens")),
    "TXT16_press_numbers": _docs(lambda t: F.array_join(R.press_numbers(t), "|").alias("numbers")),
    "TXT20_event_type": _docs(lambda t: R.event_type(t, LEX).alias("event_type")),
    "TXT21_second_occurrence": _docs(lambda t: R.second_occurrence(t, LEX).alias("second")),
    "TXT23_location": _docs(lambda t: R.location(t, LEX).alias("location")),
    "TXT24_language_content": _docs(lambda t: F.md5(R.language_content(t)).alias("content")),
    "TXT25_language_scores": _docs(_scores),
    "TXT26_home_language": _docs(lambda t: R.is_home_language(t, LEX, LETTERS).alias("home")),
    "TXT28_letter_share": _docs(lambda t: F.round(R.letter_share(t, "À-ÿ"), 6).alias("share")),
    "TXT30_topic": _docs(_topic),
    "TXT32_high_risk": _docs(lambda t: R.high_risk(t, LEX).alias("high_risk")),
    "TXT35_valid_headline": _docs(lambda t: R.valid_headline(F.trim(_first(t))).alias("valid")),
    "TXT36_headline": _docs(lambda t: R.headline(t).alias("headline")),
    "TXT43_without_links": _docs(lambda t: F.md5(R.without_links(t)).alias("cleaned")),
    "TXT44_without_repeated_lines": _docs(lambda t: F.md5(R.without_repeated_lines(t)).alias("lines")),
    "TXT49_resembles": _docs(lambda t: R.resembles(_first(t), F.coalesce(t, F.lit(""))).alias("resembles")),
    "TXT53_identity_key": _identities,
    "TXT61_cache_key": _docs(lambda t: R.cache_key("v1", F.col("lang"), _first(t), t).alias("cache_key")),
    "TXT63_redacted": _docs(lambda t: F.md5(R.redacted(t)).alias("redacted")),
    "TXT66_informative": _docs(lambda t: R.informative(t).alias("informative")),
    "FLT02_promotional": _docs(lambda t: R.promotional(_first(t), t, LEX).alias("promotional")),
    "FLT03_liveblog": _docs(lambda t: R.liveblog(_first(t), t, LEX).alias("liveblog")),
    "FLT05_low_value": _docs(lambda t: R.low_value(_first(t), t, LEX).alias("low_value")),
    "FLT06_ceremony": _docs(lambda t: R.ceremony(_first(t), t, LEX).alias("ceremony")),
    "FLT08_materiality_floor": _docs(lambda t: R.materiality_floor(_first(t), t, LEX).alias("least")),
    "FLT11_quality_gate": _docs(lambda t: R.quality_gate(_first(t), t, R.topic(t, LEX)["weight"], LEX).alias("reason")),
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


_T = "coalesce(text, '')"
_SPACED = r"regexp_replace(translate(" + _T + f", '{C.DIGITS[0] + C.ZWNJ}يك', '{C.DIGITS[1]} یک'), " + r"'[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')"
_WORDS = f"string_split(lower(trim({_SPACED})), ' ')"
_HASHED = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(X, 'يك', 'یک'), '[\x{064b}-\x{065f}\x{0670}]', '', 'g'), '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))"


def _hits(x: str, words) -> str:
    return f"len(list_intersect(list_distinct(regexp_extract_all({_HASHED.replace('X', x)}, '[\\p{{L}}\\p{{M}}]+')), {_list(words)}))"


_LINKS = r"https?://\S+|t\.me/\S+|@[A-Za-z0-9_]{3,}"
_CONTENT = r"array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(" + _T + r", '\r?\n'), lambda s: trim(s)), lambda s: NOT (starts_with(s, '—') OR starts_with(s, 'منبع:') OR starts_with(s, 'منابع:') OR starts_with(s, '🆔'))), lambda s: regexp_replace(s, '" + _LINKS + r"', ' ', 'g')), chr(10))"
_FIRST = f"string_split({_T}, chr(10))[1]"
_GATE = f"trim(translate({_FIRST} || ' ' || {_T}, 'يك{C.ZWNJ}', 'یک '))"
_WEIGHTS = sorted(((n, w, k) for n, (w, k) in LEX.topics.items()), key=lambda x: -x[1])
_LOWERED = f"translate(lower({_T}), 'يك', 'یک')"
_TOPIC = "CASE " + " ".join(f"WHEN {_any(_LOWERED, k)} THEN {_q(n)}" for n, w, k in _WEIGHTS) + " ELSE 'GENERAL_IMPORTANT' END"
_WEIGHT = "CASE " + " ".join(f"WHEN {_any(_LOWERED, k)} THEN {w}" for n, w, k in _WEIGHTS) + " ELSE 50 END"
_VALID = r"(length(s) >= 15 AND len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: length(w) > 1)) >= 3 AND NOT ends_with(s, ':'))"
_FLOOR = f"CASE WHEN {_any('g', LEX.home)} THEN 25 WHEN {_any('g', LEX.region)} THEN 45 ELSE 65 END"
_PROMO = f"({_any('lower(g)', LEX.promo_calls)} AND {_any('lower(g)', LEX.promo_offers)})"
_LIVE = "regexp_matches(g, '(?i)" + "|".join(LEX.liveblog) + "')"
_LOW = f"({_any('g', LEX.trivia)} AND NOT {_any('g', LEX.material[:24])})"
_CEREMONY = f"({_any('g', LEX.ceremony)} AND NOT {_any('g', LEX.material)})"
_GATED = f"(SELECT doc_id, {_GATE} AS g, {_WEIGHT} AS weight FROM documents)"


def _of(x: str, name: str) -> str:
    return f"SELECT doc_id, {x} AS {name} FROM documents"


ORACLES = {
    "TXT01_canonical_url": r"""
WITH u AS (SELECT page_id, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'port', 'path', 'query']) AS p FROM pages),
q AS (SELECT page_id, p, list_sort(list_transform(list_filter(string_split(p.query[2:], '&'), lambda v: v <> '' AND lower(string_split(v, '=')[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'ref_src', 'igshid', 'si', 'mibextid')), lambda v: url_decode(v) || CASE WHEN contains(v, '=') THEN '' ELSE '=' END)) AS kept FROM u)
SELECT page_id, lower(p.scheme) || '://' || lower(p.host) || CASE WHEN lower(p.scheme) || p.port IN ('http:80', 'https:443') THEN '' ELSE p.port END
       || CASE WHEN rtrim(p.path, '/') = '' THEN '/' ELSE replace(replace(replace(replace(url_encode(rtrim(p.path, '/')), '%2F', '/'), '%25', '%'), '%3A', ':'), '%40', '@') END
       || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM q""",
    "TXT11_event_tokens": _of(f"len(list_filter(list_distinct({_WORDS}), lambda w: length(w) > 1 AND NOT list_contains({_list(LEX.event_stop)}, w)))::INT", "n_tokens"),
    "TXT16_press_numbers": _of(f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(translate({_T}, '{C.DIGITS[0]}', '{C.DIGITS[1]}'), '[0-9]{{1,3}}(?:[,٬،][0-9]{{3}})+|[0-9]+'), lambda n: translate(n, ',٬،', '')))), '|')", "numbers"),
    "TXT20_event_type": _of("CASE " + " ".join(f"WHEN {_any(f'lower({_T})', k)} THEN {_q(n)}" for n, k in LEX.event_types.items()) + " ELSE 'GENERAL_NEWS' END", "event_type"),
    "TXT21_second_occurrence": _of(f"regexp_matches({_T}, '(?i){LEX.second_occurrence}')", "second"),
    "TXT23_location": _of(f"nullif(lower(regexp_extract({_T}, '(?i)({'|'.join(LEX.locations)})', 1)), '')", "location"),
    "TXT24_language_content": _of(f"md5({_CONTENT})", "content"),
    "TXT25_language_scores": f"SELECT doc_id, {_hits(_T, LEX.home_words)}::INT AS home, {_hits(_T, LEX.near_words)}::INT AS near FROM documents",
    "TXT26_home_language": rf"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array({_CONTENT}, '[\n.!?؟]+')) AS p FROM documents),
l AS (SELECT doc_id, {_hits('p', LEX.home_words)} AS home, {_hits('p', LEX.near_words)} AS near, length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) AS n, length(regexp_replace(p, '[^{LETTERS}]', '', 'g')) AS own FROM s WHERE regexp_matches(p, '\p{{L}}')),
g AS (SELECT doc_id, bool_and(home >= 2 AND home > near AND own * 2 >= n) AS good FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.good, false) AS home FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "TXT28_letter_share": _of(rf"coalesce(round(length(regexp_replace({_T}, '[^À-ÖØ-öø-ÿ]', '', 'g'))::DOUBLE / nullif(length(regexp_replace({_T}, '[^\p{{L}}]', '', 'g')), 0), 6), 0.0)", "share"),
    "TXT30_topic": f"SELECT doc_id, topic, weight, CASE WHEN weight >= 88 THEN 'P0' WHEN weight >= 75 THEN 'P1' WHEN weight >= 60 THEN 'P2' ELSE 'P3' END AS tier FROM (SELECT doc_id, {_TOPIC} AS topic, {_WEIGHT} AS weight FROM documents)",
    "TXT32_high_risk": _of(f"regexp_matches({_T}, '(?i){'|'.join(LEX.high_risk)}')", "high_risk"),
    "TXT35_valid_headline": f"SELECT doc_id, {_VALID} AS valid FROM (SELECT doc_id, trim({_FIRST}) AS s FROM documents)",
    "TXT36_headline": f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split({_T}, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS a FROM documents)
SELECT doc_id, coalesce(list_filter(a[1:5], lambda s: {_VALID})[1], list_filter(a, lambda s: length(s) = list_max(list_transform(a, lambda v: length(v))))[1], '') AS headline FROM l""",
    "TXT43_without_links": _of(rf"md5(trim(array_to_string(list_transform(list_filter(string_split(regexp_replace({_T}, '{_LINKS}', '', 'g'), chr(10)), lambda s: NOT (starts_with(trim(s), 'منبع:') OR starts_with(trim(s), 'منابع:') OR starts_with(trim(s), '🆔'))), lambda s: rtrim(regexp_replace(s, ' {{2,}}', ' ', 'g'))), chr(10))))", "cleaned"),
    "TXT44_without_repeated_lines": f"""
WITH l AS (SELECT doc_id, unnest(string_split({_T}, chr(10))) AS s, generate_subscripts(string_split({_T}, chr(10)), 1) AS k FROM documents),
f AS (SELECT doc_id, s, k, row_number() OVER (PARTITION BY doc_id, trim(s) ORDER BY k) AS nth FROM l)
SELECT doc_id, md5(coalesce(string_agg(s, chr(10) ORDER BY k), '')) AS lines FROM f WHERE nth = 1 OR trim(s) = '' GROUP BY doc_id""",
    "TXT49_resembles": rf"""
WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower({_FIRST}), '\s+'), lambda v: length(v) > 1)) AS a, list_distinct(list_filter(regexp_split_to_array(lower({_T}), '\s+'), lambda v: length(v) > 1)) AS b FROM documents)
SELECT doc_id, coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0) >= 0.65, false) AS resembles FROM w""",
    "TXT53_identity_key": r"SELECT s_suppkey, CASE WHEN contains(lower(trim(s_name)), '#000000001') THEN 'first' ELSE trim(regexp_replace(lower(trim(s_name)), '[^\p{L}\p{N}]+', ' ', 'g')) END AS identity FROM supplier",
    "TXT61_cache_key": _of(f"sha256('v1|' || coalesce(lang, '') || '|' || {_FIRST} || '|' || substring({_T}, 1, 4000))", "cache_key"),
    "TXT63_redacted": _of(rf"md5(regexp_replace({_T}, '(?i)(sk-[a-z0-9_\-]{{8,}}|bearer\s+[a-z0-9._\-]{{8,}}|(?:api[_-]?key|token|secret|password)\s*[=:]\s*\S+)', '[REDACTED]', 'g'))", "redacted"),
    "TXT66_informative": _of(f"len(list_filter(list_distinct({_WORDS}), lambda w: length(w) > 2))::INT", "informative"),
    "FLT02_promotional": f"SELECT doc_id, {_PROMO} AS promotional FROM {_GATED}",
    "FLT03_liveblog": f"SELECT doc_id, {_LIVE} AS liveblog FROM {_GATED}",
    "FLT05_low_value": f"SELECT doc_id, {_LOW} AS low_value FROM {_GATED}",
    "FLT06_ceremony": f"SELECT doc_id, {_CEREMONY} AS ceremony FROM {_GATED}",
    "FLT08_materiality_floor": f"SELECT doc_id, {_FLOOR} AS least FROM {_GATED}",
    "FLT11_quality_gate": f"SELECT doc_id, CASE WHEN {_PROMO} THEN 'HOLD_PROMOTIONAL_CONTENT' WHEN {_LIVE} THEN 'HOLD_LIVEBLOG_BOILERPLATE' WHEN {_LOW} THEN 'LOW_VALUE_CONTENT' WHEN {_CEREMONY} THEN 'LOW_MATERIALITY' WHEN weight < {_FLOOR} THEN 'MATERIALITY_FLOOR' END AS reason FROM {_GATED}",
}
