"""Document fingerprints: a Merkle tree over paragraphs and sections, in SQL functions alone.

A text is split at newlines into paragraphs.  A paragraph's node is the hash of its text, with short hashes
of its stretches of up to 96 characters as leaves; a section ends after a paragraph whose node begins with 0
or 1 in hexadecimal (an eighth of them, by content, so that an insertion shifts no later section) and its
node is the hash of what its paragraphs are; the root is the hash of the sections' nodes.  Equal roots mean
equal texts; where roots differ, differing section nodes and below them differing paragraph nodes locate
the edit.

A fingerprint is ``root:section|section``, a section ``node=paragraph,paragraph``, and a paragraph
``node+leaf+leaf``.  The likeness of two is 1 for equal roots.  Else both trees are descended: sections whose
nodes both have are alike below, and only the leaves of the others are compared.  It is twice the number of
distinct leaves that both have over the sum of what each has.

Defined results: null is an empty text, which is one empty paragraph, with no leaf.  Rows with a null id
take no part.  Of rows with one id the next document of the smaller text comes first; all get results.
Other columns are ignored.  With one document, it is its own next.  An empty table gives an empty result.
Rows of one id are ordered in one task.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch of ids that is ordered in one group, about, and stretches at most.
STRETCH = 4096
STRETCHES = 1 << 15


def _once(x: Column, f) -> Column:
    """f(x), with x computed once also where f uses it inside of lambdas."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _digest(x: Column, n: int) -> Column:
    return F.substring(F.sha2(x, 256), 1, n)


def _paragraph(p: Column) -> Column:
    leaves = F.transform(F.regexp_extract_all(p, F.lit(r"[^\n]{1,96}"), F.lit(0)), lambda c: F.concat(F.lit("+"), _digest(c, 8)))
    return F.concat(_digest(p, 16), F.array_join(leaves, ""))


def _ended(p: Column) -> Column:
    return F.concat(p, F.when(F.substring(p, 1, 1).isin("0", "1"), "|").otherwise(","))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text (see the module); the text must not be null."""
    joined = F.array_join(F.transform(F.split(text, "\n", -1), lambda p: _ended(_paragraph(p))), "")
    sections = F.transform(F.split(F.rtrim(joined, F.lit(",|")), r"\|", -1), lambda s: F.concat(_digest(s, 16), F.lit("="), s))
    return _once(sections, lambda all_: F.concat(F.sha2(F.array_join(_nodes(all_), "."), 256), F.lit(":"), F.array_join(all_, "|")))


def _sections(print_: Column) -> Column:
    return F.split(F.substring_index(print_, ":", -1), r"\|")


def _nodes(sections: Column) -> Column:
    return F.transform(sections, lambda s: F.substring(s, 1, 16))


def _leaves(sections: Column) -> Column:
    """Distinct leaves below some sections."""
    return F.array_distinct(F.regexp_extract_all(F.array_join(sections, ","), F.lit(r"\+([0-9a-f]{8})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1."""

    def descended(s: Column) -> Column:
        leaves = F.struct(
            _leaves(F.filter(s["x"], lambda v: F.array_contains(s["ny"], F.substring(v, 1, 16)))).alias("both"),
            _leaves(F.filter(s["x"], lambda v: ~F.array_contains(s["ny"], F.substring(v, 1, 16)))).alias("mine"),
            _leaves(F.filter(s["y"], lambda v: ~F.array_contains(s["nx"], F.substring(v, 1, 16)))).alias("other"),
        )
        return _once(leaves, shared)

    def shared(s: Column) -> Column:
        sizes = F.size(F.array_union(s["both"], s["mine"])) + F.size(F.array_union(s["both"], s["other"]))
        return F.when(sizes == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_union(s["both"], F.array_intersect(s["mine"], s["other"]))) / sizes)

    same = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return F.when(same, F.lit(1.0)).otherwise(_once(F.struct(_sections(a).alias("x"), _sections(b).alias("y"), _nodes(_sections(a)).alias("nx"), _nodes(_sections(b)).alias("ny")), descended))


def differing(a: Column, b: Column, paragraphs: bool = False) -> Column:
    """Places (from 0) in a's list of sections, or of paragraphs, whose nodes b doesn't have."""

    def nodes(x: Column) -> Column:
        return F.regexp_extract_all(x, F.lit(r"[=,]([0-9a-f]{16})"), F.lit(1)) if paragraphs else _nodes(_sections(x))

    other = nodes(b)
    return F.filter(F.transform(nodes(a), lambda v, k: F.when(~F.array_contains(other, v), k)), lambda k: k.isNotNull())


def _stretch(bounds: list[int]) -> Column:
    """How many bounds are at or below an id, by its place among groups of bounds and then within one."""
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    first = F.from_json(F.lit(str([g[0] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    group = F.greatest(F.size(F.filter(first, lambda v: v <= F.col("doc_id"))), F.lit(1))
    return (group - 1) * step + F.size(F.filter(F.element_at(inner, group), lambda v: v <= F.col("doc_id")))


def in_order(docs: DataFrame) -> tuple[DataFrame, object]:
    """doc_id, text, and a window in which each row's next document, by descending id, is the row behind.

    Ids are cut at quantiles into stretches of about equal numbers of rows, which the window orders one by
    one.  The last row of a stretch needs the first document below it, and the lowest stretch the first of
    all; it is added as a guard (guard = 1), to be dropped after use.
    """
    order = Window.partitionBy("stretch").orderBy("guard", F.desc("doc_id"), "text")
    count = docs.count()
    many = min(STRETCHES, max(1, count // STRETCH))
    cuts = [k / many for k in range(1, many)]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, 10 * many)).first()[0] if cuts and count else None
    rows = docs.withColumn("stretch", _stretch(sorted(set(bounds))) if bounds else F.lit(0))
    tops = {r["stretch"]: r["top"] for r in rows.groupBy("stretch").agg(F.max("doc_id").alias("top")).collect()}  # one row a stretch
    held = sorted(tops)
    guarded = [(tops[k], held[(bisect.bisect(held, k)) % len(held)]) for k in held]
    tops = docs.sparkSession.createDataFrame(guarded, "top long, guarded int")
    guards = rows.join(F.broadcast(tops), F.col("doc_id") == F.col("top"), "inner").groupBy("doc_id", F.col("guarded").alias("stretch")).agg(F.min("text").alias("text"))
    return rows.select("doc_id", "text", "stretch", F.lit(0).alias("guard")).unionByName(guards.select("doc_id", "text", "stretch", F.lit(1).alias("guard"))), order


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and likenesses to the edited and the next text."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    rows, order = in_order(docs)
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long")).withColumn("fingerprint", fingerprint(F.col("text")))
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("guard = 0")
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(next_text, 1, n_chars div 2))"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op4_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
      FROM d WINDOW w AS (ORDER BY doc_id DESC, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM n),
t AS (SELECT doc_id, 0 AS which, text AS x FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, next_text FROM e),
p AS (SELECT doc_id, which, list_transform(string_split(x, chr(10)), lambda s: sha256(s)[1:16] || array_to_string(list_transform(regexp_extract_all(s, '[^\n]{1,96}'), lambda c: '+' || sha256(c)[1:8]), '')) AS paragraphs,
             list_distinct(list_transform(regexp_extract_all(x, '[^\n]{1,96}'), lambda c: sha256(c)[1:8])) AS own FROM t),
j0 AS (SELECT *, array_to_string(list_transform(paragraphs, lambda q: q || CASE WHEN q[1] IN ('0', '1') THEN '|' ELSE ',' END), '') AS joined FROM p),
s AS (SELECT doc_id, which, own, list_transform(string_split(joined[1:length(joined) - 1], '|'), lambda v: sha256(v)[1:16] || '=' || v) AS sections FROM j0),
f AS (SELECT doc_id, which, own, sha256(array_to_string(list_transform(sections, lambda v: v[1:16]), '.')) AS root, array_to_string(sections, '|') AS listed FROM s),
j AS (SELECT a.doc_id, a.root || ':' || a.listed AS fingerprint, b.root || ':' || b.listed AS edited_fingerprint,
             CASE WHEN a.root = b.root THEN 1.0::DOUBLE WHEN len(a.own) + len(b.own) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.own, b.own)) / (len(a.own) + len(b.own)) END AS near_edited,
             CASE WHEN a.root = c.root THEN 1.0::DOUBLE WHEN len(a.own) + len(c.own) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.own, c.own)) / (len(a.own) + len(c.own)) END AS near_next
      FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.which = 0 AND b.which = 1 JOIN f c ON a.doc_id = c.doc_id AND c.which = 2)
SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, j.fingerprint, j.edited_fingerprint, j.near_edited, j.near_next
FROM e JOIN j ON e.doc_id = j.doc_id
"""
