"""All queries of the engine by name, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.functions import text as T
from sievework.functions.lexicon import EUROPEAN as LEX
from sievework.operators import claims, dedup

from . import board_queries, claim_queries, copy_queries, gate_queries, newsroom_queries, publishing_queries, registry_queries, relational, storage_queries, story_queries, text_queries

FLAGSHIP = "JOIN04_simhash_near_duplicates"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _text(make):
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", make(F.col("text")))


def _prints(spark, sf_dir):
    """Documents as items: an address of their length and source, and their first line as a title."""
    url = F.concat(F.lit("http://"), F.coalesce("source", F.lit("none")), F.lit(".example.com:80/"), F.col("n_chars"), F.lit("?utm_source=x"))
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return dedup.fingerprints(_docs(spark, sf_dir).withColumn("url", url).withColumn("title", title), "doc_id", "url", "title", "text")


def _compared(spark, sf_dir):
    turns = claims.with_claims(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "text", lex=LEX)
    return claims.against_previous(turns, "conv_id", "turn").select("conv_id", "turn", "decision", F.array_join("conflicts", "|").alias("conflicts"))


_CLAIM = f"(SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{C.DIGITS[0] + C.ZWNJ}يك', '{C.DIGITS[1]} یک'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS t FROM documents)"


def _any(keywords):
    return "(" + " OR ".join(f"contains(t, '{k.replace(C.ZWNJ, ' ').strip()}')" for k in keywords) + ")"


#: No compatibility form, which SQL lacks: the test tables' texts have none of the characters that it changes.
_NORM = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'يك', 'یک'), '[\\x{064b}-\\x{065f}\\x{0670}]', '', 'g'), '[\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2066}-\\x{2069}\\x{feff}]', '', 'g'), '<[^>]+>', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')))"
_WORDS = f"list_filter(string_split({_NORM}, ' '), lambda w: w <> '')"
_SHINGLES = f"SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)"

QUERIES: dict = {
    "TXT02_normalized": _text(lambda t: T.normalized_for_hash(t).alias("norm")),
    "TXT03_content_hash": _text(lambda t: T.content_hash(t).alias("content_hash")),
    "TXT05_title_hash": _text(lambda t: F.sha2(T.normalized_title(t), 256).alias("title_hash")),
    "TXT06_shingle_counts": _text(lambda t: F.size(T.shingles(T.normalized_for_hash(t))).alias("n_shingles")),
    "TXT07_simhash": lambda spark, sf_dir: dedup.with_simhash(_docs(spark, sf_dir)),
    "TXT12_token_count": _text(lambda t: F.size(C.tokens(C.normalized(t))).alias("n_tokens")),
    "TXT15_numbers": _text(lambda t: F.array_join(T.numbers(t), "|").alias("numbers")),
    "TXT17_claim_class": _text(lambda t: C.claim_class(C.normalized(t), LEX.classes).alias("claim_class")),
    "TXT18_negation": _text(lambda t: C.negated(C.normalized(t), LEX.negation).alias("negation")),
    "TXT19_certainty": _text(lambda t: C.certainty(C.normalized(t), LEX.reported, LEX.attributed).alias("certainty")),
    "STR09_claim_compare": _compared,
    "TXT22_quarter_hour": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.bucket_15m(F.col("ts")).alias("bucket")),
    "TXT52_lineage": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.lineage_key(F.col("url")).alias("lineage")),
    "TXT60_slug": _text(lambda t: T.slug(t).alias("slug")),
    FLAGSHIP: lambda spark, sf_dir: dedup.near_documents(dedup.with_simhash(_docs(spark, sf_dir))),
    "STR07_staged_duplicates": lambda spark, sf_dir: dedup.staged_duplicates(_prints(spark, sf_dir)),
} | relational.QUERIES | text_queries.QUERIES | newsroom_queries.QUERIES | story_queries.QUERIES | board_queries.QUERIES | publishing_queries.QUERIES | storage_queries.QUERIES | gate_queries.QUERIES | claim_queries.QUERIES | registry_queries.QUERIES | copy_queries.QUERIES
_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(h) THEN {1 << i if i < 63 else -(1 << 63)}::HUGEINT ELSE 0::HUGEINT END" for i in range(64))
_SIMHASH = f"SELECT doc_id, ({_BITS})::BIGINT AS simhash FROM (SELECT doc_id, ('0x' || md5(s)[1:16])::UBIGINT AS h FROM (SELECT doc_id, unnest(CASE WHEN len(g) = 0 THEN [NULL] ELSE g END) AS s FROM ({_SHINGLES}))) GROUP BY doc_id"
_NEAR = f"""
WITH s AS MATERIALIZED ({_SIMHASH}), n AS MATERIALIZED (SELECT simhash, min(doc_id) AS doc_id FROM s GROUP BY simhash)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, bit_count(xor(a.simhash, b.simhash))::INT AS distance FROM n a JOIN n b ON a.doc_id < b.doc_id AND bit_count(xor(a.simhash, b.simhash)) <= 6
UNION ALL SELECT n.doc_id, s.doc_id, 0 FROM s JOIN n ON n.simhash = s.simhash AND s.doc_id > n.doc_id"""
_TITLE = r"trim(regexp_replace(regexp_replace(N, '[«»\"''()\[\]{}.،؛:!؟?…-]', ' ', 'g'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))"
_FIRST_LINE = "string_split(coalesce(text, ''), chr(10))[1]"
_STAGED = f"""
WITH s AS MATERIALIZED ({_SIMHASH}), n AS MATERIALIZED (SELECT simhash, min(doc_id) AS doc_id FROM s GROUP BY simhash),
k AS MATERIALIZED (SELECT d.doc_id, coalesce(source, 'none') || '/' || n_chars AS u, {_NORM} AS c, {_TITLE.replace('N', _NORM.replace('text', _FIRST_LINE))} AS t, s.simhash FROM documents d JOIN s ON s.doc_id = d.doc_id),
m AS (SELECT a.simhash, min(b.doc_id) AS least FROM n a JOIN n b ON bit_count(xor(a.simhash, b.simhash)) <= 6 GROUP BY a.simhash),
w AS (SELECT k.doc_id, min(k.doc_id) OVER (PARTITION BY u) AS by_url, min(k.doc_id) OVER (PARTITION BY c) AS by_text, CASE WHEN t <> '' THEN min(k.doc_id) OVER (PARTITION BY t) END AS by_title, m.least AS by_hash FROM k JOIN m ON m.simhash = k.simhash)
SELECT doc_id AS item_id, CASE WHEN by_url < doc_id THEN by_url WHEN by_text < doc_id THEN by_text WHEN by_title < doc_id THEN by_title WHEN by_hash < doc_id THEN by_hash END AS matched_id,
       CASE WHEN by_url < doc_id THEN 'url' WHEN by_text < doc_id THEN 'content_hash' WHEN by_title < doc_id THEN 'title' WHEN by_hash < doc_id THEN 'simhash' ELSE 'new' END AS stage FROM w"""
ORACLES: dict[str, str] = {
    "TXT05_title_hash": f"SELECT doc_id, sha256({_TITLE.replace('N', _NORM)}) AS title_hash FROM documents",
    "TXT07_simhash": _SIMHASH,
    "JOIN04_simhash_near_duplicates": _NEAR,
    "STR07_staged_duplicates": _STAGED,
    "TXT02_normalized": f"SELECT doc_id, {_NORM} AS norm FROM documents",
    "TXT03_content_hash": f"SELECT doc_id, sha256({_NORM}) AS content_hash FROM documents",
    "TXT06_shingle_counts": f"SELECT doc_id, len(g)::INT AS n_shingles FROM ({_SHINGLES})",
    "TXT12_token_count": f"SELECT doc_id, len(list_distinct(list_filter(string_split(lower(t), ' '), lambda w: length(w) > 1)))::INT AS n_tokens FROM {_CLAIM}",
    "TXT15_numbers": f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{C.DIGITS[0]}', '{C.DIGITS[1]}'), '[0-9]+(?:[.,][0-9]+)*'))), '|') AS numbers FROM documents",
    "TXT17_claim_class": "SELECT doc_id, CASE " + " ".join(f"WHEN {_any(k)} THEN '{n}'" for n, k in LEX.classes.items()) + f" ELSE 'GENERAL' END AS claim_class FROM {_CLAIM}",
    "TXT18_negation": f"SELECT doc_id, {_any(LEX.negation)} AS negation FROM {_CLAIM}",
    "TXT19_certainty": f"SELECT doc_id, CASE WHEN {_any(LEX.reported)} THEN 'REPORTED' WHEN {_any(LEX.attributed)} THEN 'ATTRIBUTED' ELSE 'ASSERTED' END AS certainty FROM {_CLAIM}",
    "TXT22_quarter_hour": "SELECT event_id, strftime(ts, '%Y%m%d%H') || (minute(ts) // 15)::VARCHAR AS bucket FROM events",
    "TXT52_lineage": "SELECT page_id, 'dom:' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS lineage FROM pages",
    "TXT60_slug": r"SELECT doc_id, CASE WHEN cut = '' THEN 'story' ELSE cut END AS slug FROM (SELECT doc_id, trim(substring(trim(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_\x{0600}-\x{06FF}]+', '-', 'g'), '-'), 1, 60), '-') AS cut FROM documents) AS s",
} | relational.ORACLES | text_queries.ORACLES | newsroom_queries.ORACLES | story_queries.ORACLES | board_queries.ORACLES | publishing_queries.ORACLES | storage_queries.oracles(_NORM) | gate_queries.ORACLES | claim_queries.ORACLES | registry_queries.ORACLES | copy_queries.ORACLES
