"""Items in the order of their source or event: contexts and bursts, claims against earlier ones, events that match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.functions import rules as R
from sievework.functions.lexicon import CONNECTIVES, EMPTY_LABELS, PERSIAN, Lexicon
from sievework.functions.text import numbers, once
from sievework.operators.folds import folded

# Fixed values.
HARD_TYPES = ["MILITARY_STRIKE", "LIVE_INCIDENT", "INTERNET_OUTAGE", "MARKET_MOVE"]
WEAK = ["شد", "است", "دارد", "بود", "کرد", "شود", "هستند", "باشد", "بوده", "می", "و", "را", "این", "آن", "نیز", "هم", "برای"]
CONTINUATION_MINUTES = {"INTERVIEW": 240, "PRESS_CONFERENCE": 240, "SPEECH": 240, "LIVE_INCIDENT": 120, "MILITARY_STRIKE": 45, "POLITICAL_ANNOUNCEMENT": 120, "MARKET_MOVE": 30, "INTERNET_OUTAGE": 180, "GENERAL_NEWS": 90}
WEIGHTS = {"actors": 0.30, "predicate": 0.25, "location": 0.15, "event_type": 0.15, "temporal": 0.10, "context": 0.05, "incident": 0.10, "occurrence": 0.10}
INCIDENT_BONUS, ATTACH, BAND = 0.25, 0.62, 0.12
OFFICIAL = ["ارتش", "وزارت", "وزیر", "کاخ سفید", "سخنگو", "فرمانده", "centcom", "idf", "پنتاگون", "شورای امنیت", "آژانس", "دولت", "رئیس‌جمهور", "نخست‌وزیر", "سازمان", "ایرنا", "رسمی", "اضلاعیه", "اطلاعیه"]
STATUS = ["لغو شد", "لغو", "متوقف", "برقرار", "از سر گرفته", "آزاد شد", "آتش‌بس", "سقوط", "استعفا", "انتقال", "افتاد", "کاهش یافت", "افزایش یافت", "توافق شد", "منعقد"]
VERBS = (["توافق", "صحبت", "مصاحبه", "تایم"], ["تحریم", "اعمال", "اعلام"])
LONE_OPENERS = ["عاجل", "فوری", "breaking", "خبر فوری", "در همین حال", "جزئیات بیشتر"]
CORRECTION = ["تصحیح", "اصلاح می", "تکذیب", "خلاف واقع", "اشتباه", "خطا"]

_LABEL = r"(?s)^([؀-ۿ\w][؀-ۿ\w .'\-]{1,98}?)\s*[:：]\s*(.*)$"
_SPOKEN = r"^([؀-ۿ\w ]{3,40}?)\s+(?:گفت|اعلام کرد|اظهار کرد)"


def _first_line(text: Column) -> Column:
    return F.trim(F.substring_index(F.trim(F.coalesce(text, F.lit(""))), "\n", 1))


def colon_label(text: Column) -> Column:
    """TXT-37: the first line without its colon where it ends with one, else null."""
    first = _first_line(text)
    return F.when(first.rlike("[:：]$"), F.trim(F.rtrim(first, F.lit(":："))))


def prefix_item(text: Column) -> Column:
    """TXT-37: a first line that is a label or a connective, with less than ten characters behind it."""
    first = _first_line(text)
    opener = F.lit(False)
    for word in CONNECTIVES:
        opener = opener | F.startswith(first, F.lit(word))
    alone = C.normalized(first).isin(LONE_OPENERS)
    fragment = (first == "") | first.rlike("[:：]$") | (opener & (F.length(first) <= 60)) | alone
    t = F.trim(F.coalesce(text, F.lit("")))
    return fragment & (F.length(F.trim(F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"(?s)^[^\n]*\n", "")).otherwise(""))) < 10)


def explicit_speaker(text: Column) -> Column:
    """TXT-38: a colon label, else a label before text that names someone, else who stands before a verb of saying."""
    t = F.trim(F.coalesce(text, F.lit("")))
    label = F.trim(F.regexp_extract(t, _LABEL, 1))
    named = (label != "") & ~F.lower(label).isin([w.lower() for w in EMPTY_LABELS])
    for word in CONNECTIVES:
        named = named & ~F.startswith(F.lower(label), F.lit(word.rstrip(":：").lower()))
    said = F.trim(F.regexp_extract(C.normalized(t), _SPOKEN, 1))
    return F.coalesce(F.nullif(colon_label(t), F.lit("")), F.when(named, label), F.nullif(said, F.lit("")))


def same_speaker(a: Column, b: Column) -> Column:
    """TXT-39: one name holds the other."""
    x, y = C.normalized(a), C.normalized(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def structured(text: Column, lex: Lexicon = PERSIAN) -> Column:
    """TXT-40: struct of speaker, body, class, numbers, time marker, certainty, negation and predicate."""
    t = F.coalesce(text, F.lit(""))
    alone = F.regexp_extract(t, r"(?s)^([^\n]{1,100})[:：]\s*\n(.*)$", 1)
    label, rest = F.trim(F.regexp_extract(t, _LABEL, 1)), F.trim(F.regexp_extract(t, _LABEL, 2))
    empty = F.lower(label).isin([w.lower() for w in EMPTY_LABELS])
    speaker = F.when(alone != "", F.trim(alone)).when((label != "") & ~empty & (rest != ""), label)
    body = F.when(alone != "", F.trim(F.regexp_extract(t, r"(?s)^[^\n]{1,100}[:：]\s*\n(.*)$", 1))).when((label != "") & (rest != ""), rest).otherwise(t)
    marker = F.lit(None).cast("string")
    for word in reversed(lex.time_markers):
        marker = F.when(F.contains(body, F.lit(word)), word).otherwise(marker)
    n = C.normalized(body)
    return F.struct(
        speaker.alias("speaker"),
        body.alias("body"),
        C.claim_class(n, lex.classes).alias("claim_class"),
        F.array_join(numbers(n), "، ").alias("quantity"),
        marker.alias("time_ref"),
        C.certainty(n, lex.reported, lex.attributed).alias("certainty"),
        C.negated(n, lex.negation).alias("negation"),
        F.substring(body, 1, 80).alias("predicate"),
    )


def contexts(items: DataFrame, source: str, order: list[str], time: str, text: str, lex: Lexicon = PERSIAN, ttl: int = 1800) -> DataFrame:
    """STR-05: the items with decision, reason and, where they inherit it, the speaker of their source's context.

    A colon label sets its source's context until the next label.  An item that can't belong to it (another
    speaker, a second occurrence, a hard type, another topic) resets it, and later items have none; after
    ``ttl`` seconds it is over.  So an item's decision follows from the last label and from the first reset since.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    label, prefix = colon_label(F.col(text)), prefix_item(F.col(text))
    kind = R.event_type(F.col(text), lex)
    rows = items.withColumns({
        "_prefix": prefix, "_stored": prefix & label.isNotNull(), "_speaker": explicit_speaker(F.col(text)), "_kind": kind,
        "_tokens": R.event_tokens(F.col(text), lex), "_second": R.second_occurrence(F.col(text), lex),
        "_quote": C.claim_class(C.normalized(F.col(text)), lex.classes) == "QUOTE", "_empty": t == "",
    })
    past = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    context = F.struct(F.col(time).alias("at"), label.alias("speaker"), R.event_type(label, lex).alias("kind"), R.event_tokens(label, lex).alias("tokens"))
    rows = rows.withColumns({"_context": F.last(F.when(F.col("_stored"), context), True).over(past), "_part": F.count(F.when(F.col("_stored"), 1)).over(past)})
    live = F.col("_context").isNotNull() & (F.unix_timestamp(time) < F.unix_timestamp("_context.at") + ttl)
    other = F.col("_speaker").isNotNull() & (F.col("_context.speaker") != "") & ~same_speaker(F.col("_speaker"), F.col("_context.speaker"))
    hard = F.col("_kind").isin(HARD_TYPES) & (F.col("_kind") != F.col("_context.kind"))
    apart = ~F.arrays_overlap("_tokens", "_context.tokens") & (F.col("_kind") != F.col("_context.kind"))
    goes_on = F.col("_speaker").isNull() & (F.col("_quote") | (F.col("_context.kind") == "INTERVIEW"))
    reset = F.when(other, "EXPLICIT_NEW_SPEAKER").when(F.col("_second"), "EVENT_BOUNDARY_MARKER").when(hard, "HARD_CATEGORY_SWITCH").when(apart & ~goes_on, "CLEAR_TOPIC_CHANGE")
    rows = rows.withColumn("_reset", F.when(live & ~F.col("_prefix") & ~F.col("_empty"), reset))
    since = Window.partitionBy(source, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    open_ = live & (F.coalesce(F.count("_reset").over(since), F.lit(0)) == 0)
    rows = rows.withColumn("_open", open_)
    decision = (
        F.when(F.col("_stored"), "PREFIX_STORED").when(F.col("_prefix"), "CONNECTIVE_FRAGMENT").when(F.col("_empty") | ~F.col("_open"), "NO_CONTEXT")
        .when(F.col("_reset").isNotNull(), "RESET").otherwise("INHERIT")
    )
    return rows.withColumn("decision", decision).select(*items.columns, "decision", F.when(F.col("decision") == "RESET", F.col("_reset")).alias("reason"), F.when(F.col("decision") == "INHERIT", F.col("_context.speaker")).alias("inherited_speaker"))


#: Rows of a range that is folded in one task: rows with all their words.
BURST_ROWS = 20_000


class Bursts:
    """The last groups of one source's items; only these can be joined, and one that has fallen behind never comes back."""

    def __init__(self, window: int, scan: int, state: list | None = None) -> None:
        self.window, self.scan = window, scan
        self.number, groups = state or [0, []]
        self.groups = [g | {"tokens": set(g["tokens"])} for g in groups]

    def state(self) -> list:
        """Groups numbered anew, as only the order of their numbers matters."""
        rank = {g["number"]: k for k, g in enumerate(sorted(self.groups, key=lambda g: g["number"]))}
        return [len(rank), [g | {"number": rank[g["number"]], "tokens": sorted(g["tokens"])} for g in self.groups]]

    def step(self, row: dict) -> tuple[int, int]:
        tokens, found = set(row["tokens"]), None
        strong = tokens.difference(WEAK)
        for g in self.groups:
            switch = g["kind"] in HARD_TYPES and row["kind"] in HARD_TYPES and g["kind"] != row["kind"]
            speakers = g["speaker"] and row["speaker"] and not (g["speaker"] in row["speaker"] or row["speaker"] in g["speaker"])
            linked = g["kind"] == row["kind"] or (g["ref"] and g["ref"] == row["ref"]) or not g["tokens"].isdisjoint(strong)
            if abs(row["at"] - g["seen"]) <= self.window and not row["second"] and not switch and not speakers and linked:
                found = g
                break
        if found is None:
            found = {"number": self.number, "id": row["item_id"], "kind": row["kind"], "ref": row["ref"], "speaker": row["speaker"], "tokens": set()}
            self.number += 1
            self.groups.append(found)
        found["seen"] = row["at"]
        found["tokens"].update(tokens)
        found["speaker"] = found["speaker"] or row["speaker"]
        live = [g for g in self.groups if row["at"] - g["seen"] <= self.window]
        self.groups = sorted(live, key=lambda g: (-g["seen"], -g["number"]))[: self.scan]
        return row["item_id"], found["id"]


def bursts(items: DataFrame, item_id: str, source: str, time: str, text: str, ref: str | None = None, lex: Lexicon = PERSIAN, window: int = 180, scan: int = 5, range_rows: int = BURST_ROWS) -> DataFrame:
    """STR-03: item_id and burst_id (the burst's first item); items without a time or source are bursts of their own.

    An item joins the most recent of the last ``scan`` groups of its source that it fits: a fold in time (``folds``) whose state
    is those groups, so a source that never falls quiet is cut like any other.
    """
    speaker = F.coalesce(C.normalized(explicit_speaker(F.col(text))), F.lit(""))
    rows = items.select(
        F.col(item_id).cast("long").alias("item_id"), F.col(source).cast("string").alias("source"), F.unix_timestamp(time).alias("at"), R.event_type(F.col(text), lex).alias("kind"),
        (F.coalesce(F.col(ref), F.lit("")) if ref else F.lit("")).alias("ref"), speaker.alias("speaker"), R.event_tokens(F.col(text), lex).alias("tokens"), R.second_occurrence(F.col(text), lex).alias("second"),
    )
    known = F.col("at").isNotNull() & F.col("source").isNotNull()
    grouped = folded(rows.where(known), "source", ["at", "item_id"], lambda state: Bursts(window, scan, state), "item_id long, burst_id long", range_rows)
    return grouped.unionByName(rows.where(~known).select("item_id", F.col("item_id").alias("burst_id")))


def against_existing(df: DataFrame, event: str, order: str, most: int = 50, part_rows: int = 10_000) -> DataFrame:
    """JOIN-30: decision of each claim against the first ``most`` of its event before it: SAME with the first that
    is, else a contradiction of the first that is one, else new; with the order of the one it met.

    Claims of an event with more than ``part_rows`` are dealt out in parts of about as many, each with a copy of the first ones.
    """
    place = F.row_number().over(Window.partitionBy(event).orderBy(order))
    first = df.withColumn("_place", place).where(F.col("_place") <= most)
    known = first.groupBy(F.col(event).alias("_event")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "claim"))).alias("known"))
    found = F.transform(F.filter("known", lambda k: k["at"] < F.col(order)), lambda k: F.struct(k["at"].alias("at"), C.decision(F.col("claim"), k["claim"]).alias("d")))
    wide = df.groupBy(F.col(event).alias("_event")).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts")).where(F.col("_parts") > 1)
    known = known.join(F.broadcast(wide), "_event", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    dealt = df.join(F.broadcast(wide), F.col(event) == F.col("_event"), "left").drop("_event").withColumn("_part", F.pmod(F.xxhash64(order), F.coalesce("_parts", F.lit(1))).cast("int"))
    rows = dealt.join(known.withColumnRenamed("_part", "_known_part"), (F.col(event) == F.col("_event")) & (F.col("_part") == F.col("_known_part")), "left").withColumn("_found", F.coalesce(found, F.expr("array()")))
    same = F.get(F.filter("_found", lambda x: x["d"] == "SAME_CLAIM"), 0)
    against = F.get(F.filter("_found", lambda x: x["d"] == "POTENTIAL_CONTRADICTION"), 0)
    met = F.coalesce(same, against)
    return rows.select(*df.columns, F.coalesce(met["d"], F.lit("NEW_CLAIM")).alias("decision"), met["at"].alias("met"))


def material_facts(text: Column, location: Column, lex: Lexicon = PERSIAN, official: list[str] = OFFICIAL, status: list[str] = STATUS, correction: list[str] = CORRECTION) -> Column:
    """What OPS-02 asks of a claim's text, found once a claim: ``novel`` compares these of a claim with those of earlier ones."""

    def of(n: Column) -> Column:
        return F.struct(
            F.array_union(numbers(text), R.press_numbers(text)).alias("numbers"), F.array_except(F.array_distinct(F.filter(F.split(F.lower(n), " "), lambda w: F.length(w) > 1)), F.array(*map(F.lit, lex.event_stop))).alias("words"),
            location.isNotNull().alias("placed"), F.lower(C.normalized(location)).alias("place"), C.negated(n, lex.negation).alias("negated"),
            R.any_of(n, official).alias("official"), R.any_of(n, status).alias("status"), R.any_of(n, correction).alias("correction"),
        )

    return once(C.normalized(text), of)


def novel(new: Column, claim_class: Column, certainty: Column, priors: Column) -> Column:
    """OPS-02: why a new claim is material; ``new`` and the array ``priors`` hold material_facts."""
    fresh = F.filter(F.array_except(new["numbers"], F.flatten(F.transform(priors, lambda p: p["numbers"]))), lambda n: F.length(n) >= 2)
    words = F.filter(F.array_except(new["words"], F.flatten(F.transform(priors, lambda p: p["words"]))), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$") & ~w.isin(WEAK))
    moved = new["placed"] & ~F.exists(priors, lambda p: p["placed"] & (p["place"] == new["place"]))
    flips = new["negated"] != F.exists(priors, lambda p: p["negated"])
    reasons = F.array_compact(F.array(
        F.when((claim_class != "INTERNET") & (F.size(fresh) > 0), "NEW_NUMBERS"),
        F.when(moved | ((claim_class == "ATTACK") & (F.size(words) >= 2)), "NEW_TARGET"),
        F.when((certainty == "ATTRIBUTED") & new["official"], "OFFICIAL_CONFIRMATION"),
        F.when(new["status"] | flips, "STATUS_TRANSITION"),
        F.when(new["correction"], "CORRECTION"),
    ))
    return F.when(F.size(priors) == 0, F.array(F.lit("FIRST_CLAIM"))).otherwise(reasons)


def materiality(text: Column, claim_class: Column, certainty: Column, location: Column, priors: Column, lex: Lexicon = PERSIAN, official: list[str] = OFFICIAL, status: list[str] = STATUS, correction: list[str] = CORRECTION) -> Column:
    """OPS-02: why a new claim is material; priors: array<struct<text, location>> of the event's earlier claims."""
    facts = lambda t, at: material_facts(t, at, lex, official, status, correction)
    both = F.struct(facts(text, location).alias("new"), F.transform(priors, lambda p: facts(p["text"], p["location"])).alias("priors"))
    return once(both, lambda x: novel(x["new"], claim_class, certainty, x["priors"]))


def event_print(text: Column, actor: Column, at: Column, lex: Lexicon = PERSIAN, context: Column | None = None, occurrence: Column | None = None) -> Column:
    """What an event is matched by."""
    return once(R.second_occurrence(text, lex), lambda second: _print(text, actor, at, lex, context, occurrence, second))


def _print(text: Column, actor: Column, at: Column, lex: Lexicon, context: Column | None, occurrence: Column | None, second: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.nullif(F.lower(C.normalized(actor)), F.lit("")).alias("actor"), R.event_tokens(text, lex).alias("tokens"), R.location(text, lex).alias("location"),
        F.when(second, "LIVE_INCIDENT").otherwise(R.event_type(text, lex)).alias("kind"), (none if context is None else context).alias("context"),
        (none if occurrence is None else occurrence).alias("occurrence"), at.alias("at"), second.alias("second"),
    )


def hard_conflicts(a: Column, b: Column) -> Column:
    """Codes that keep an item (a) from an event (b), whatever their likeness."""
    kinds = F.array(a["kind"], b["kind"])
    minutes = F.lit(90)
    for name, limit in CONTINUATION_MINUTES.items():
        minutes = F.when(a["kind"] == name, limit).otherwise(minutes)
    speaks, acts = (lambda tokens, words=words: F.arrays_overlap(tokens, F.array(*map(F.lit, words))) for words in VERBS)
    spoken = F.array_contains(kinds, "POLITICAL_ANNOUNCEMENT") & (F.array_contains(kinds, "INTERVIEW") | F.array_contains(kinds, "PRESS_CONFERENCE"))
    return F.array_compact(F.array(
        F.when(a["occurrence"] != b["occurrence"], "OCCURRENCE_ID_DIFFERS"),
        F.when(a["second"] & (b["at"] < a["at"]), "EXPLICIT_SECOND_OCCURRENCE"),
        F.when((a["location"] != b["location"]) & a["kind"].isin("MILITARY_STRIKE", "LIVE_INCIDENT", "INTERNET_OUTAGE"), "LOCATION_CONFLICT"),
        F.when((a["kind"] != b["kind"]) & (F.array_contains(kinds, "MILITARY_STRIKE") | F.array_contains(kinds, "INTERNET_OUTAGE") | spoken), "EVENT_TYPE_CONFLICT"),
        F.when((speaks(a["tokens"]) & acts(b["tokens"])) | (acts(a["tokens"]) & speaks(b["tokens"])), "PREDICATE_CONFLICT"),
        F.when(F.abs(F.unix_timestamp(b["at"]) - F.unix_timestamp(a["at"])) > minutes * 60, "CONTINUATION_WINDOW_EXCEEDED"),
    ))


def match_score(a: Column, b: Column) -> Column:
    """struct<total, reduced>: how well an item fits an event, and the sum that a runner-up is held against."""
    long, short = (f(F.size(a["tokens"]), F.size(b["tokens"])) for f in (F.greatest, F.least))
    fit = lambda shared: F.greatest(shared / F.greatest(long + short - shared, F.lit(1)), shared / F.greatest(short, F.lit(1)))
    predicate = F.when(short == 0, F.lit(0.0)).otherwise(once(F.size(F.array_intersect(a["tokens"], b["tokens"])), fit))
    here = F.coalesce(a["location"] == b["location"], F.lit(False))
    place = F.when(here, 1.0).when(a["location"].isNotNull() & b["location"].isNotNull(), 0.0).otherwise(0.5)
    kind = a["kind"] == b["kind"]
    apart = F.abs(F.unix_timestamp(b["at"]) - F.unix_timestamp(a["at"]))
    temporal = F.coalesce(F.greatest(F.lit(0.0), 1.0 - apart / (6 * 3600)), F.lit(0.5))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    incident = one(here & kind & a["kind"].isin("LIVE_INCIDENT", "MILITARY_STRIKE"))
    reduced = WEIGHTS["actors"] * one(a["actor"] == b["actor"]) + WEIGHTS["predicate"] * predicate + WEIGHTS["location"] * place + WEIGHTS["event_type"] * one(kind) + WEIGHTS["temporal"] * temporal
    total = reduced + WEIGHTS["context"] * one(a["context"] == b["context"]) + (WEIGHTS["incident"] + INCIDENT_BONUS) * incident + WEIGHTS["occurrence"] * one(a["occurrence"] == b["occurrence"])
    return F.struct(total.alias("total"), reduced.alias("reduced"))


def matched_events(pairs: DataFrame, item: str = "item_id", event: str = "event_id", place: str = "place") -> DataFrame:
    """STR-10: item, decision, event_id and reason, of pairs of an item's print ``a`` and candidates' prints ``b``.

    ``place`` orders the candidates, few for each item; an item without any has a null event.
    """
    scored = pairs.withColumns({"_codes": hard_conflicts(F.col("a"), F.col("b")), "_score": match_score(F.col("a"), F.col("b"))})
    fits = F.col(event).isNotNull() & (F.size("_codes") == 0)
    some = scored.groupBy(item).agg(
        F.count(event).alias("n"),
        F.array_sort(F.collect_list(F.when(fits, F.struct(F.col(place).alias("place"), F.col(event).alias("event"), F.round("_score.total", 9).alias("total"), F.round("_score.reduced", 9).alias("reduced"))))).alias("fit"),
    )
    best = F.aggregate("fit", F.get("fit", F.lit(0)), lambda x, y: F.when(y["total"] > x["total"], y).otherwise(x))
    some = some.withColumn("best", best)
    runner = F.get(F.filter("fit", lambda x: x["event"] != F.col("best.event")), 0)
    near = F.abs(F.col("best.total") - runner["reduced"]) <= BAND
    decision = F.when(F.col("best").isNull(), "CREATE_NEW").when(F.col("best.total") >= ATTACH, "ATTACH_EXISTING").when(runner.isNotNull() & near, "AMBIGUOUS_EVENT").otherwise("CREATE_NEW")
    reason = F.when(F.col("n") == 0, "NO_CANDIDATES").when(F.col("best").isNull(), "ALL_CANDIDATES_CONFLICT").when(decision == "AMBIGUOUS_EVENT", "SCORE_IN_AMBIGUOUS_BAND").when(decision == "CREATE_NEW", "BELOW_ATTACH_THRESHOLD")
    return some.select(item, decision.alias("decision"), F.when(decision != "CREATE_NEW", F.col("best.event")).alias("event_id"), reason.alias("reason"))
