"""Claims as column expressions: normal form, class, negation, certainty, fingerprint, and their comparison."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGITS, numbers, once, spaced, translated

# Fixed values.
ZWNJ = "‌"
NEGATION = ["نخواهد", "نمی ", "نیست", "نیستند", "نه", "نکرد", "نشد", "لغو", "تکذیب", "لا "]
REPORTED = ["گفته می‌شود", "احتمال دارد", "ممکن است", "به گزارش", "به نقل از"]
ATTRIBUTED = ["اعلام کرد", "تأیید کرد", "گفت", "اظهار کرد"]
CLASSES = {
    "ATTACK": ["حمله", "حمله موشکی", "پهپاد", "پهپادی", "حمله هوایی", "بمباران", "درگیری", "حمله پهپادی", "شلیک", "انفجار", "استهداف", "هدف قرار"],
    "CASUALTY": ["کشته", "زخمی", "تلفات", "جان باخت", "شهید", "جراحت"],
    "INTERNET": ["اینترنت", "فیلترینگ", "قطعی اینترنت", "اختلال اینترنت", "مخابرات", "پهنای باند"],
    "MARKET": ["دلار", "ارز", "طلا", "سکه", "بورس", "شاخص", "نفت", "تومان"],
    "QUOTE": ["گفت", "اظهار کرد", "اعلام کرد", "خبر داد", "هشدار داد", "تأکید کرد", "افزود"],
}
LIGHT_WORDS = ["و", "است", "به", "از", "را", "با", "این", "که", "در", "برای", "آن", "ها", "شد", "شده", "می", "کرد", "کند", "او", "وی", "هم", "نیز", "بر", "های", "تا", "همچنان"]
LOCATED = ["ATTACK", "CASUALTY", "INTERNET"]


def normalized(text: Column) -> Column:
    """TXT-09; null is empty."""
    x = translated(F.coalesce(text, F.lit("")), DIGITS[0] + ZWNJ + "يك", DIGITS[1] + " یک")
    return F.trim(spaced(x, r"\s\x1c-\x1f", "(?U)"))


def contains_any(norm: Column, keywords: list[str]) -> Column:
    """TXT-14, of a text in its normal form."""
    return reduce(or_, [F.contains(norm, F.lit(k.replace(ZWNJ, " ").strip())) for k in keywords])


def claim_class(norm: Column, classes: dict[str, list[str]] = CLASSES) -> Column:
    """TXT-17: the first class that has a keyword in the text."""
    out = F.lit("GENERAL")
    for name, keywords in reversed(classes.items()):
        out = F.when(contains_any(norm, keywords), name).otherwise(out)
    return out


def negated(norm: Column, words: list[str] = NEGATION) -> Column:
    """TXT-18."""
    return contains_any(norm, words)


def certainty(norm: Column, reported: list[str] = REPORTED, attributed: list[str] = ATTRIBUTED) -> Column:
    """TXT-19."""
    return F.when(contains_any(norm, reported), "REPORTED").when(contains_any(norm, attributed), "ATTRIBUTED").otherwise("ASSERTED")


def tokens(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(norm), " "), lambda w: F.length(w) > 1))


def claim(text: Column, actor: Column, location: Column, lex=None) -> Column:
    """A claim with all that comparison needs; actor and location may be null; lex: a Lexicon, or the Persian lists.

    The fingerprint takes the predicate from the first 80 characters as they stand.
    """
    words = (NEGATION, REPORTED, ATTRIBUTED, CLASSES) if lex is None else (lex.negation, lex.reported, lex.attributed, lex.classes)
    none = F.lit(None).cast("string")
    a, at = F.nullif(normalized(actor), F.lit("")), F.nullif(normalized(location), F.lit(""))

    def facts(n: Column) -> Column:
        return F.struct(claim_class(n, words[3]).alias("claim_class"), negated(n, words[0]).alias("negation"), certainty(n, words[1], words[2]).alias("certainty"), numbers(n).alias("quantity"), tokens(n).alias("tokens"))

    def of(f: Column) -> Column:
        parts = [F.coalesce(a, F.lit("")), normalized(F.substring(text, 1, 80)), F.coalesce(none, F.lit("")), F.coalesce(at, F.lit("")), F.array_join(f["quantity"], ","), F.when(f["negation"], "NEG").otherwise("POS"), f["claim_class"]]
        return F.struct(
            a.alias("actor"),
            at.alias("location"),
            *[f[name].alias(name) for name in ("claim_class", "negation", "certainty", "quantity", "tokens")],
            F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16).alias("fingerprint"),
        )

    return once(once(normalized(text), facts), of)


class Likeness:
    """How alike two claims are, all from the words that both have (``shared``); a claim's tokens are a set."""

    def __init__(self, new: Column, old: Column, shared: Column) -> None:
        self.new, self.old, self.n = new, old, F.size(shared)
        self.heavy = F.size(F.filter(shared, lambda w: ~w.isin(LIGHT_WORDS)))
        a, b = F.size(new["tokens"]), F.size(old["tokens"])
        self.jaccard = F.when(a + b == self.n, F.lit(0.0)).otherwise(self.n / (a + b - self.n))
        self.containment = F.when(F.least(a, b) == 0, F.lit(0.0)).otherwise(self.n / F.greatest(F.least(a, b), F.lit(1)))

    def content_sizes(self) -> tuple[Column, Column]:
        return F.size(content(self.new)), F.size(content(self.old))


def content(claim: Column) -> Column:
    return F.filter(claim["tokens"], lambda w: ~w.isin(LIGHT_WORDS))


def _differ(new: Column, old: Column, field: str) -> Column:
    return F.coalesce(new[field] != old[field], F.lit(False))


def _conflicts(new: Column, old: Column, like: Likeness) -> dict[str, Column]:
    reported = (new["certainty"] == "REPORTED") | (old["certainty"] == "REPORTED")
    return {
        "NEGATION_DIFFERS": (new["negation"] != old["negation"]) & (like.heavy >= 4),
        "NUMBERS_DIFFER": (F.size(new["quantity"]) > 0) & (F.size(old["quantity"]) > 0) & ~F.arrays_overlap(new["quantity"], old["quantity"]),
        "ACTOR_DIFFERS": _differ(new, old, "actor"),
        "LOCATION_CONFLICT": _differ(new, old, "location") & new["claim_class"].isin(LOCATED),
        "CERTAINTY_DIFFERS": (new["certainty"] != old["certainty"]) & reported,
    }


def decided(new: Column, old: Column, like: Likeness) -> Column:
    """STR-09: the decision; what is dear to compute comes last in each condition."""
    enough = (like.jaccard >= 0.30) & (like.heavy >= 3) & (like.heavy >= F.lit(0.25) * F.greatest(F.least(*like.content_sizes()), F.lit(1)))
    alike = (like.jaccard >= 0.55) | (like.containment >= 0.8) | enough
    return (
        F.when(new["fingerprint"] == old["fingerprint"], "SAME_CLAIM")
        .when(reduce(or_, _conflicts(new, old, like).values()), "POTENTIAL_CONTRADICTION")
        .when(new["actor"].eqNullSafe(old["actor"]) & (new["certainty"] == old["certainty"]) & alike, "SAME_CLAIM")
        .when(like.jaccard >= 0.40, "AMBIGUOUS_CLAIM")
        .otherwise("NEW_CLAIM")
    )


def met_in_words(new: Column, old: Column, f) -> Column:
    """f of the likeness of two claims, whose shared words are found once."""
    return once(F.array_intersect(new["tokens"], old["tokens"]), lambda shared: f(Likeness(new, old, shared)))


def decision(new: Column, old: Column) -> Column:
    """STR-09, the decision alone."""
    return met_in_words(new, old, lambda like: decided(new, old, like))


def compare(new: Column, old: Column) -> Column:
    """STR-09: struct<decision, conflicts> of two claims: equal, then in conflict, then alike in words."""

    def of(like: Likeness) -> Column:
        found = F.array_compact(F.array(*[F.when(holds, name) for name, holds in _conflicts(new, old, like).items()]))
        equal = new["fingerprint"] == old["fingerprint"]
        return F.struct(decided(new, old, like).alias("decision"), F.when(equal, F.array().cast("array<string>")).otherwise(found).alias("conflicts"))

    return met_in_words(new, old, of)
