"""Claims against the recent ones of other events, claims of different events that are the same, and claims against groups
of evidence, each as joins whose groups stay bounded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.functions.text import once
from sievework.operators.stories import CONTINUATION_MINUTES
from sievework.sources.shared import shared_folder

#: Rows of a range that is numbered in one task, about.
RANGE_ROWS = 500_000
#: The same of claims, which come with all their words.
CLAIM_ROWS = 20_000


def numbered(rows: DataFrame, order: list[Column], name: str = "place", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with their place in an order, from 0, and the range they are in (``part``): ranges are numbered apart and shifted
    by the sizes of those before, so no task orders all rows.  The order has no ties."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // range_rows))
    path = shared_folder(spark, "numbered")
    rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before, shift = 0, []
    for r in sorted(ranged.groupBy("part").count().collect()):  # a row a range
        shift.append((r["part"], before))
        before += r["count"]
    shifts = spark.createDataFrame(shift, "part int, _before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(shifts), "part").withColumn(name, place.cast("long")).drop("_before")


def met(new: Column, old: Column) -> Column:
    """Why a claim joins the event of an earlier one: the same, in conflict about the same, or doubtful but alike; else null."""

    def of(like: C.Likeness) -> Column:
        a, b = like.content_sizes()
        alike = F.when(a + b > like.heavy, like.heavy / (a + b - like.heavy) >= 0.6).otherwise(False)
        close = (like.jaccard >= 0.40) & (like.heavy >= 3)

        def way(decision: Column) -> Column:
            return F.when(decision == "SAME_CLAIM", "SAME_CLAIM").when((decision == "POTENTIAL_CONTRADICTION") & close, "CONTRADICTION").when((decision == "AMBIGUOUS_CLAIM") & alike, "AMBIGUOUS")

        return F.when(like.n > 0, once(C.decided(new, old, like), way)).when(new["fingerprint"] == old["fingerprint"], "SAME_CLAIM")

    return C.met_in_words(new, old, of)


def joined_events(claims: DataFrame, claim_id: str, event: str, k: int = 40, range_rows: int = CLAIM_ROWS) -> DataFrame:
    """JOIN-31, JOIN-35: claim_id, joined_event and via of each claim (column ``claim``) against those before it: the newest with its
    fingerprint, however old, else the newest of the last ``k`` that it meets; null where it opens an event of its own.

    Places of claims in order of their ids are cut into stretches of ``k``; a claim meets its own stretch and the one before,
    so a task's group has at most twice ``k`` rows whatever the words are.
    """
    rows = claims.select(F.col(claim_id).alias("id"), F.col(event).alias("event"), "claim")
    rows = numbered(rows, [F.col("id")], range_rows=range_rows).withColumn("print", F.col("claim.fingerprint"))
    # the newest equal print: within a range, else the last one of the ranges before, of which each print has one row a range
    own = F.lag("event").over(Window.partitionBy("print", "part").orderBy("place"))
    last = rows.groupBy("print", "part").agg(F.max_by("event", "place").alias("last"))
    last = last.withColumn("earlier", F.lag("last").over(Window.partitionBy("print").orderBy("part"))).select("print", "part", "earlier")
    exact = rows.withColumn("_own", own).join(last, ["print", "part"]).select("id", F.coalesce("_own", "earlier").alias("exact"))
    stretch = F.floor(F.col("place") / k).cast("long")
    old = rows.select(F.col("place").alias("old_place"), F.col("event").alias("old_event"), F.col("claim").alias("old"), F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    pairs = rows.where(F.size(C.content(F.col("claim"))) > 0).withColumn("stretch", stretch).join(old, "stretch")
    pairs = pairs.where((F.col("old_place") < F.col("place")) & (F.col("old_place") >= F.col("place") - k))
    # no filter on via, which would be moved before the projection and compare each pair a second time
    near = pairs.select("id", "old_place", "old_event", met(F.col("claim"), F.col("old")).alias("via"))
    near = near.groupBy("id").agg(F.max(F.when(F.col("via").isNotNull(), F.struct("old_place", "old_event", "via"))).alias("near"))
    out = exact.join(near, "id", "left")
    return out.select(F.col("id").alias(claim_id), F.coalesce("exact", "near.old_event").alias("joined_event"), F.when(F.col("exact").isNotNull(), "FINGERPRINT").otherwise(F.col("near.via")).alias("via"))


def _window(kind: Column) -> Column:
    out = F.lit(90)
    for name, minutes in CONTINUATION_MINUTES.items():
        out = F.when(kind == name, minutes).otherwise(out)
    return out * 60


def same_across_events(claims: DataFrame, events: DataFrame, top: int = 3) -> DataFrame:
    """JOIN-32: event_a, event_b, claim_a, claim_b of the first ``top`` claims of two events (claim_id, event_id, claim; event_id, kind,
    last_seen) that are the same claim, the later event within the continuation time of the other's kind (event_a < event_b).

    Equal claims share a fingerprint, three tenths of the longer one's words, or four fifths of the shorter one's, so they share
    one of their rarest words (as many as these bounds leave room for): those are the join's keys, with the stretch of time.
    """
    nth = F.row_number().over(Window.partitionBy("event_id").orderBy("claim_id"))
    first = claims.withColumn("_nth", nth).where(F.col("_nth") <= top)
    longest = max(CONTINUATION_MINUTES.values()) * 60
    e = events.select("event_id", F.unix_timestamp("last_seen").alias("at"), _window(F.col("kind")).alias("within"))
    rows = first.join(e, "event_id").where("at IS NOT NULL").select("claim_id", "event_id", "claim", "at", "within", F.floor(F.col("at") / longest).alias("stretch"))
    words = rows.select("claim_id", F.explode("claim.tokens").alias("word"))
    words = words.join(words.groupBy("word").agg(F.count("*").alias("n")), "word")
    order = F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda s: s["word"])
    rows = rows.join(words.groupBy("claim_id").agg(order.alias("words")), "claim_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    n = F.size("words")

    def rarest(share: str) -> Column:
        return F.slice("words", 1, F.greatest(n - F.ceil(n * F.lit(share).cast("decimal(2,1)")).cast("int") + 1, F.lit(1)))

    def keyed(keys: Column, side: str, spread: bool) -> DataFrame:
        cells = F.array("stretch", F.col("stretch") - 1, F.col("stretch") + 1) if spread else F.array("stretch")
        return rows.select(F.struct("claim_id", "event_id", "at", "within").alias(side), F.explode(keys).alias("key"), cells.alias("cells")).select(side, "key", F.explode("cells").alias("cell"))

    prints = F.array(F.concat(F.lit("#"), "claim.fingerprint"))
    ways = [(rarest("0.3"), rarest("0.3")), (rarest("0.8"), F.col("words")), (F.col("words"), rarest("0.8")), (prints, prints)]
    pairs = None
    for left, right in ways:
        met_ = keyed(left, "a", False).join(keyed(right, "b", True), ["key", "cell"]).where("a.event_id < b.event_id AND abs(a.at - b.at) <= a.within")
        met_ = met_.select(F.col("a.claim_id").alias("claim_a"), F.col("a.event_id").alias("event_a"), F.col("b.claim_id").alias("claim_b"), F.col("b.event_id").alias("event_b"))
        pairs = met_ if pairs is None else pairs.unionByName(met_)
    a, b = (rows.select(F.col("claim_id").alias(f"claim_{x}"), F.col("claim").alias(x)) for x in "ab")
    full = pairs.distinct().join(a, "claim_a").join(b, "claim_b")
    return full.where(C.decision(F.col("a"), F.col("b")) == "SAME_CLAIM").select("event_a", "event_b", "claim_a", "claim_b")


def evidence_groups(items: DataFrame, most: int = 5) -> DataFrame:
    """AGG-17: event, key, line, n_items, independent and place of the groups of an event's items (event, item_id, title, text,
    lineage, trusted) by their first ``most`` lines of 26 to 299 characters; independent: lineages of trusted sources; place: in order of appearance.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: (F.length(s) > 25) & (F.length(s) < 300))
    rows = items.select("event", "item_id", "lineage", "trusted", F.posexplode(F.slice(lines, 1, most)).alias("nth", "line"))
    rows = rows.withColumn("key", F.substring(F.sha2("line", 256), 1, 16))
    found = rows.groupBy("event", "key").agg(F.min("line").alias("line"), F.count("*").alias("n_items"), F.count_distinct(F.when(F.col("trusted"), F.col("lineage"))).alias("independent"), F.min(F.struct("item_id", "nth")).alias("first"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("event").orderBy("first"))).drop("first")


def _overlaps(claims: pa.Table, groups: pa.Table) -> pa.Table:
    """claim_id, place, overlap of the group that shares most words with each of the claims, the first of equals."""
    groups = groups.sort_by("place")
    mine, theirs = (t[name].combine_chunks() for t, name in ((claims, "mine"), (groups, "theirs")))
    words = pc.drop_null(pc.unique(theirs.flatten()))
    held = np.zeros((len(words), len(groups)), np.uint8)
    place = pc.list_parent_indices(theirs).to_numpy()
    held[pc.index_in(theirs.flatten().drop_null(), words).to_numpy(zero_copy_only=False), place[theirs.flatten().is_valid().to_numpy(zero_copy_only=False)]] = 1
    known = pc.index_in(mine.flatten(), words, skip_nulls=True)
    some = known.is_valid().to_numpy(zero_copy_only=False)
    known, owner = known.drop_null().to_numpy(zero_copy_only=False), pc.list_parent_indices(mine).to_numpy()[some]
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    best, most = np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)
    step = max(1, (1 << 22) // max(1, len(groups)))  # words at a time
    at, ends = 0, np.append(start[1:], len(known))
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, start[at] + step, "right")))
        shared = np.add.reduceat(held[known[start[at] : ends[to - 1]]], start[at:to] - start[at], axis=0, dtype=np.int32)
        best[at:to] = shared.argmax(axis=1)
        most[at:to] = shared[np.arange(to - at), best[at:to]]
        at = to
    return pa.table({"claim_id": claims["claim_id"].take(pa.array(owner[start])), "place": groups["place"].take(pa.array(best)), "overlap": pa.array(most)})


def best_groups(claims: DataFrame, groups: DataFrame, most_claims: int = 100_000, most_groups: int = 1000) -> DataFrame:
    """JOIN-34: claim_id, place and overlap of the group (event, place, words) of a claim's event (event, claim_id, words) that shares
    most words with it, the first of equals; no row for a claim that shares none.

    Words are sets.  A claim moves once, with its words, to its event's groups, where a table of words by groups counts what they share.  Events of
    more claims or groups than ``most_claims`` or ``most_groups`` are dealt out in parts of about as many, each of claims against each of groups.
    """
    g = groups.select("event", "place", F.array_distinct("words").alias("theirs"))
    c = claims.select("event", "claim_id", F.array_distinct("words").alias("mine"))

    def parts(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy("event").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)

    wide = parts(c, most_claims, "_of_claims").join(parts(g, most_groups, "_of_groups"), "event", "full")

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in its own part, once for each part of the other side."""
        rows = rows.join(F.broadcast(wide), "event", "left")  # few: events of many claims or groups
        mine = F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int").alias(own)
        return rows.select(*[x for x in rows.columns if x not in (own, other)], mine, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other))

    kinds = {f.name: f.dataType.simpleString() for f in [*c.schema.fields, *g.schema.fields]}
    keys = ["event", "_of_claims", "_of_groups"]

    def best(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = _overlaps(mine, theirs) if len(mine) and len(theirs) else None
        found = found if found is not None else pa.table({"claim_id": mine["claim_id"].slice(0, 0), "place": theirs["place"].slice(0, 0), "overlap": pa.array([], pa.int32())})
        return found.add_column(0, "event", pa.repeat(key[0], len(found)))

    met_ = dealt(c, "claim_id", "_of_claims", "_of_groups").groupBy(*keys).cogroup(dealt(g, "place", "_of_groups", "_of_claims").groupBy(*keys)).applyInArrow(best, f"event {kinds['event']}, claim_id {kinds['claim_id']}, place {kinds['place']}, overlap int")
    best_ = F.max(F.struct("overlap", (-F.col("place")).alias("minus"))).alias("best")
    return met_.groupBy("event", "claim_id").agg(best_).select("claim_id", (-F.col("best.minus")).alias("place"), F.col("best.overlap").alias("overlap"))
