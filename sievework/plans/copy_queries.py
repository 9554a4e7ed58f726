"""Public copy of documents, with SQL written from what each rule says."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import copy as P
from sievework.plans import gate_queries as Q

PHRASES = ["that", "den "]
READ_ON = r"^\s*[A-Z][a-z]+ [a-z]+\s*[.:]?\s*$"
GENERIC = ["outh", "lich"]


def _shown(t):
    """A document behind its first line as a bold headline: cut after sixty characters for every other one."""
    first = F.substring_index(F.coalesce(t, F.lit("")), "\n", 1)
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.substring(first, 1, 60), F.lit("…"))).otherwise(first)
    return F.concat(F.lit("🟢 **"), head, F.lit("**\n\n"), F.coalesce(t, F.lit("")))


def _docs(name, make):
    return lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", make(F.col("text")).alias(name))


QUERIES = {
    "TXT45_without_boilerplate": _docs("kept", lambda t: F.sha2(P.without_boilerplate(t, PHRASES, READ_ON), 256)),
    "TXT46_squashed_lead": _docs("copy", lambda t: F.sha2(P.squashed_lead(_shown(t)), 256)),
    "TXT48_substantive": _docs("substantive", lambda t: P.substantive(t, Q.EUROPEAN, "A-Za-zÀ-ÿ", GENERIC)),
}

_S = r"'^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_S}, '', 'g')"


_T = "coalesce(text, '')"
_FIRST = f"string_split({_T}, chr(10))[1]"
_HEAD = f"CASE WHEN doc_id % 2 = 0 THEN substring({_FIRST}, 1, 60) || '…' ELSE {_FIRST} END"
_UNFIT = Q._UNFIT.replace("lines", "ls")
_ALL_LINES = Q._LINES.replace(f"{Q._HEAD} || chr(10) || {Q._BODY}", _strip(_T))
ORACLES = {
    "TXT45_without_boilerplate": f"""
SELECT doc_id, sha256({_strip(f"regexp_replace(array_to_string(list_filter(string_split({_T}, chr(10)), lambda s: NOT (length(s) < 120 AND (contains(s, 'that') OR contains(s, 'den '))) AND NOT regexp_matches({_strip('s')}, '{READ_ON}')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")}) AS kept FROM documents""",
    "TXT46_squashed_lead": f"""
WITH a AS (SELECT doc_id, '🟢 **' || {_HEAD} || '**' || chr(10) || chr(10) || {_T} AS shown FROM documents), b AS (SELECT *, regexp_split_to_array({_strip('shown')}, '\\n\\s*\\n') AS bl FROM a),
c AS (SELECT *, regexp_extract(bl[1], '(?s)\\*\\*(.+?)\\*\\*', 1) AS bold, {_strip("coalesce(bl[2], '')")} AS lead FROM b), d AS (SELECT *, {_strip('bold')} AS head FROM c),
e AS (SELECT *, ends_with(head, '…') OR ends_with(head, '...') AS cut, rtrim(regexp_replace(head, '(?:…|\\.\\.\\.)$', ''), '. ') AS stem FROM d), f AS (SELECT *, greatest(length(stem), 1) AS n, length(regexp_extract(substring(lead, greatest(length(stem), 1)), '(?s)^([^{P.SENTENCE_ENDS}]*[{P.SENTENCE_ENDS}])', 1)) AS stop FROM e),
g AS (SELECT *, CASE WHEN NOT cut THEN head WHEN stop = 0 THEN lead ELSE {_strip('substring(lead, 1, n + stop - 1)')} END AS new, CASE WHEN NOT cut THEN {_strip("ltrim(substring(lead, CASE WHEN starts_with(lead, head) THEN length(head) ELSE length(stem) END + 1), ' ' || chr(9) || chr(10) || '،,:؛-–—')")} WHEN stop = 0 THEN '' ELSE {_strip('substring(lead, n + stop)')} END AS rest FROM f)
SELECT doc_id, sha256(CASE WHEN len(bl) >= 2 AND bold <> '' AND length(stem) >= 30 AND starts_with(lead, stem) THEN array_to_string(list_concat(list_concat([replace(bl[1], '**' || bold || '**', '**' || new || '**')], CASE WHEN rest = '' THEN [] ELSE [rest] END), bl[3:]), chr(10) || chr(10)) ELSE shown END) AS copy FROM g""",
    "TXT48_substantive": f"""
WITH a AS (SELECT doc_id, {_strip(_T)} AS t, {_ALL_LINES} AS ls FROM documents), b AS (SELECT *, list_filter(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda s: {_strip('s')}), lambda s: NOT regexp_matches(s, '(?i)^\\s*(?:📖\\s*)?(?:منبع|source)\\s*[:：]')), lambda s: replace(s, '*', '')), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^\\s*read\\s+more\\s*[:：–—-]?\\s*$')) AS said FROM a),
c AS (SELECT *, coalesce(said[1], '') AS f, list_filter(flatten(list_transform(said, lambda s: regexp_split_to_array(s, '[\\s\\p{{Z}}]+'))), lambda w: length(w) > 1 AND regexp_matches(w, '[A-Za-zÀ-ÿ]')) AS ws FROM b)
SELECT doc_id, t <> '' AND ({_UNFIT}) IS NULL AND len(said) > 0 AND NOT (ends_with(f, '…') OR ends_with(f, '...')) AND len(list_filter(said, lambda s: NOT (contains(s, 'outh') OR contains(s, 'lich')))) > 0 AND len(ws) >= 4
 AND ((length(f[1:140]) >= 15 AND len(list_filter(regexp_split_to_array(f[1:140], '\\s+'), lambda w: length(w) > 1)) >= 3 AND NOT ends_with(f[1:140], ':')) OR len(ws) >= 6) AS substantive FROM c""",
}
