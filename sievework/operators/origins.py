"""Whose message it is: stable ids in their spellings, and origins by parts of names and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
UNKNOWN, LIMITED = "منبع ناشناس", "LIMITED_X_ACCESS"
GRAM = 3


def _low(text: Column) -> Column:
    """Letters A to Z in lower case, as LIKE compares them."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _grams(text: Column, size: Column) -> Column:
    """Distinct stretches of so many characters; none of a shorter text."""
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contained(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """pattern and id of each text (id, text) that holds a pattern, letters A to Z alike.

    Texts are indexed by their stretches of one to three characters; a pattern is looked up by the one of its own that the fewest
    texts have, and what that finds is compared in full.  So a pattern meets the texts of its rarest stretch, not all texts.
    """
    t = texts.select("id", _low(F.col("text")).alias("low"))
    sizes = F.explode(F.array(*[F.lit(k) for k in range(1, GRAM + 1)])).alias("size")
    index = t.select("id", "low", sizes).select("id", "low", F.explode(_grams(F.col("low"), F.col("size"))).alias("gram"))
    p = patterns.select("pattern").where("pattern <> ''").distinct().withColumn("wanted", _low(F.col("pattern")))
    own = p.select("pattern", "wanted", F.explode(_grams(F.col("wanted"), F.least(F.length("wanted"), F.lit(GRAM)))).alias("gram"))
    own = own.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = own.groupBy("pattern", "wanted").agg(F.min(F.struct("n", "gram")).alias("r")).where("r.n > 0").select("pattern", "wanted", F.col("r.gram").alias("gram"))
    return rarest.join(index, "gram").where(F.contains("low", F.col("wanted"))).select("pattern", "id")


def mapped_origins(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """OPS-20: message_id, source_id and reported origin of forwarded messages (message_id, username, title).

    A source (source_id, identity, name, url, status) is found by the username, without its sign, or else by the title: its identity is equal, or its
    name or address holds it; sources with an identity come first, then smaller ids; those of limited access don't count.  Where none is found
    the id is null, which stands for manual submissions, and adds no confirmation.  Signs of LIKE in a name stand for themselves.
    """
    user = F.regexp_replace(F.coalesce("username", F.lit("")), "^@+", "")
    title = F.coalesce("title", F.lit(""))
    rows = messages.select("message_id", user.alias("user"), title.alias("title"))
    s = sources.where(~F.coalesce(F.col("status") == LIMITED, F.lit(False))).select("source_id", F.coalesce("identity", F.lit("")).alias("identity"), "name", "url")
    patterns = rows.select(F.explode(F.array("user", "title")).alias("pattern")).where("pattern <> ''").distinct()
    texts = s.select(F.col("source_id").alias("id"), F.explode(F.array(F.coalesce("name", F.lit("")), F.coalesce("url", F.lit("")))).alias("text"))
    equal = patterns.join(s.where("identity <> ''").select(F.col("identity").alias("pattern"), F.col("source_id").alias("id")), "pattern")
    hits = contained(patterns, texts).unionByName(equal).distinct().join(s.select(F.col("source_id").alias("id"), (F.col("identity") == "").cast("int").alias("bare")), "id")
    found = hits.groupBy("pattern").agg(F.min(F.struct("bare", "id")).alias("f")).select("pattern", F.col("f.id").alias("id"))
    out = rows.join(found.select(F.col("pattern").alias("user"), F.col("id").alias("by_user")), "user", "left").join(found.select(F.col("pattern").alias("title"), F.col("id").alias("by_title")), "title", "left")
    reported = F.when(F.col("title") != "", F.col("title")).when(F.col("user") != "", F.concat(F.lit("@"), "user")).otherwise(UNKNOWN)
    return out.select("message_id", F.coalesce("by_user", "by_title").alias("source_id"), reported.alias("reported"))


def resolved_peers(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """OPS-19: message_id and source_id of messages by their peer: a stable id in any of its spellings (as it is, its digits, -100 and its
    digits), else a source's handle with or without its sign; the smallest id of several, null for none.

    A changed handle makes no second source, as the stable id comes first.
    """
    peer = F.col("peer_id").cast("string")
    peers = messages.select(peer.alias("peer")).where("peer IS NOT NULL").distinct()
    digits = F.regexp_replace(F.regexp_replace("peer", "^-100", ""), "^-+", "")
    asked = peers.select("peer", F.explode(F.array_distinct(F.array(F.col("peer"), digits, F.concat(F.lit("-100"), digits)))).alias("spelling"))
    stable = asked.join(sources.select(F.col("stable_id").cast("string").alias("spelling"), "source_id"), "spelling").groupBy("peer").agg(F.min("source_id").alias("by_id"))
    handle = F.regexp_replace(F.coalesce("handle", F.lit("")), "^@+", "")
    named = sources.where("handle <> ''").select(F.explode(F.array(handle, F.concat(F.lit("@"), handle))).alias("peer"), "source_id").groupBy("peer").agg(F.min("source_id").alias("by_handle"))
    rows = messages.select("message_id", peer.alias("peer"))
    return rows.join(stable, "peer", "left").join(named, "peer", "left").select("message_id", F.coalesce("by_id", "by_handle").alias("source_id"))
