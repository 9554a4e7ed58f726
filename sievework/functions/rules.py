"""Rules over text as column expressions: event types, places, topics and their weights, language, gates, copy."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import claims as C
from .lexicon import PERSIAN, Lexicon
from .text import ARABIC_LETTERS, folded, nfkc, nfkc_if_other, once, translated

# Fixed values.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_src", "igshid", "si", "mibextid"]
TIERS = (("P0", 88), ("P1", 75), ("P2", 60))
FOOTERS = ["—", "منبع:", "منابع:", "🆔"]
LINKS = r"https?://\S+|t\.me/\S+|@[A-Za-z0-9_]{3,}"
FLOORS = (25, 45, 65)


def trimmed(line: Column) -> Column:
    """Without spaces at its ends.  F.trim itself must not be given to F.transform: its second argument is what to trim, so it
    would get the line's place and take away that digit."""
    return F.trim(line)


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_match(text: Column, groups: dict[str, list[str]], other: str) -> Column:
    def of(t: Column) -> Column:
        out = F.lit(other)
        for name, words in reversed(groups.items()):
            out = F.when(any_of(t, words), name).otherwise(out)
        return out

    return once(text, of)


def canonical_url(url: Column) -> Column:
    """TXT-01: scheme and host in small letters, no default port, tracking parameter or fragment; parameters sorted."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://)(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"

    def part(k: int) -> Column:
        return F.regexp_extract(trimmed, pattern, k)

    scheme, host, port = F.lower(part(1)), F.lower(part(2)), part(3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.url_encode(part(4))
    for a, b in (("%2F", "/"), ("%25", "%"), ("%3A", ":"), ("%40", "@"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        path = F.replace(path, F.lit(a), F.lit(b))
    path = F.rtrim(path, F.lit("/"))
    pairs = F.transform(F.filter(F.split(part(5), "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    built = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", trimmed).otherwise(built)


def event_tokens(text: Column, lex: Lexicon = PERSIAN) -> Column:
    """TXT-11: distinct tokens of two characters or more, without stop words."""
    words = F.filter(F.split(F.lower(C.normalized(text)), " "), lambda w: F.length(w) > 1)
    return F.array_except(F.array_distinct(words), _strings(lex.event_stop))


def press_numbers(text: Column) -> Column:
    """TXT-16: distinct numbers, digits of any script, without separators of thousands; sorted."""
    digits = translated(F.coalesce(text, F.lit("")), *C.DIGITS)
    found = F.regexp_extract_all(digits, F.lit(r"[0-9]{1,3}(?:[,٬،][0-9]{3})+|[0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.translate(n, ",٬،", ""))))


def event_type(text: Column, lex: Lexicon = PERSIAN) -> Column:
    """TXT-20: the first type that has a keyword in the text."""
    return first_match(F.lower(F.coalesce(text, F.lit(""))), {k: [w.lower() for w in v] for k, v in lex.event_types.items()}, "GENERAL_NEWS")


def second_occurrence(text: Column, lex: Lexicon = PERSIAN) -> Column:
    """TXT-21."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + lex.second_occurrence)


def location(text: Column, lex: Lexicon = PERSIAN) -> Column:
    """TXT-23: the first place named, in small letters; null if none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)(" + "|".join(lex.locations) + ")", 1)
    return F.nullif(F.lower(found), F.lit(""))


def language_content(text: Column) -> Column:
    """TXT-24: the lines that aren't footers, without links and handles."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), trimmed)
    kept = F.filter(lines, lambda s: ~reduce(or_, [F.startswith(s, F.lit(w)) for w in FOOTERS]))
    linked = lambda s: F.when(any_of(s, ["://", "t.me/", "@"]), F.regexp_replace(s, LINKS, " ")).otherwise(s)
    return F.array_join(F.transform(kept, lambda s: linked(s)), "\n")


def language_scores(text: Column, lex: Lexicon = PERSIAN) -> tuple[Column, Column]:
    """TXT-25: how many of each list's words occur."""
    return _scores(nfkc(F.coalesce(text, F.lit(""))), lex)


def _scores(text: Column, lex: Lexicon) -> tuple[Column, Column]:
    words = F.array_distinct(F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    near = [w.translate(str.maketrans(*ARABIC_LETTERS)) for w in lex.near_words]
    both = once(words, lambda w: F.struct(F.size(F.array_intersect(w, _strings(lex.home_words))).alias("home"), F.size(F.array_intersect(w, _strings(near))).alias("near")))
    return both["home"], both["near"]


def is_home_language(text: Column, lex: Lexicon = PERSIAN, letters: str = "؀-ۿ") -> Column:
    """TXT-26: every sentence with letters has two home words, more of them than near ones, and home letters for half."""
    parts = F.filter(F.split(language_content(text), r"[\n.!?؟]+"), lambda p: p.rlike(r"\p{L}"))
    joined = F.array_join(parts, "\x1e")

    def good(both: Column) -> Column:
        scores = once(F.struct(*(c.alias(n) for c, n in zip(_scores(both["form"], lex), ("home", "near"), strict=True))), lambda s: (s["home"] >= 2) & (s["home"] > s["near"]))
        at_home = once(F.regexp_replace(both["raw"], r"[^\p{L}]+", ""), lambda p: F.length(F.regexp_replace(p, f"[^{letters}]+", "")) * 2 >= F.length(p))
        return at_home & scores

    def every(t: Column) -> Column:
        pairs = F.zip_with(F.split(t["raw"], "\x1e"), F.split(F.coalesce(t["form"], t["raw"]), "\x1e"), lambda a, b: F.struct(a.alias("raw"), b.alias("form")))
        return (t["raw"] != "") & F.forall(pairs, good)

    # sentences get their compatibility form together, as a lambda can't call Python
    return once(F.struct(joined.alias("raw"), nfkc_if_other(joined).alias("form")), every)


def detected_language(text: Column) -> Column:
    """TXT-27: ar, fa, ru, en or und."""
    content = language_content(text)
    fa, ar = language_scores(content)
    return (
        F.when((ar >= 2) & (ar > fa), "ar")
        .when(is_home_language(content), "fa")
        .when(content.rlike("[پچژگکی]"), "fa")
        .when(content.rlike("[يكةىؤإا]"), "ar")
        .when(content.rlike("[а-яА-Я]"), "ru")
        .when(content.rlike("[a-zA-Z]"), "en")
        .otherwise("und")
    )


def letter_share(text: Column, letters: str) -> Column:
    """TXT-28: the share of a text's letters that are of a range; 0 without letters."""
    all_ = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    return F.when(all_ == "", F.lit(0.0)).otherwise(F.length(F.regexp_replace(all_, f"[^{letters}]", "")) / F.length(all_))


def topic(text: Column, lex: Lexicon = PERSIAN) -> Column:
    """TXT-30: struct<topic, weight>: the heaviest topic named; light ones only where no other is."""
    return once(translated(F.lower(F.coalesce(text, F.lit(""))), *ARABIC_LETTERS), lambda t: _topic(t, lex))


def _topic(t: Column, lex: Lexicon) -> Column:
    def named(words: list[str]) -> Column:
        return any_of(t, [w.lower().translate(str.maketrans(*ARABIC_LETTERS)) for w in words])

    heavy = sorted(((n, w, k) for n, (w, k) in lex.topics.items() if n not in lex.low_topics and w > 50), key=lambda x: -x[1])
    light = [(n, *lex.topics[n]) for n in lex.topics if n in lex.low_topics]
    out = F.struct(F.lit("GENERAL_IMPORTANT").alias("topic"), F.lit(50).alias("weight"))
    for name, weight, words in [*reversed(light)]:
        out = F.when(named(words), F.struct(F.lit(name).alias("topic"), F.lit(weight).alias("weight"))).otherwise(out)
    for name, weight, words in reversed(heavy):
        out = F.when(named(words), F.struct(F.lit(name).alias("topic"), F.lit(weight).alias("weight"))).otherwise(out)
    return out


def tier(weight: Column) -> Column:
    """TXT-31."""
    out = F.lit("P3")
    for name, least in reversed(TIERS):
        out = F.when(weight >= least, name).otherwise(out)
    return out


def high_risk(text: Column, lex: Lexicon = PERSIAN) -> Column:
    """TXT-32."""
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(lex.high_risk))


def gate_form(*texts: Column) -> Column:
    """TXT-10, of texts joined by a space."""
    joined = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    return F.trim(translated(joined, ARABIC_LETTERS[0] + C.ZWNJ, ARABIC_LETTERS[1] + " "))


def promotional(headline: Column, body: Column, lex: Lexicon = PERSIAN) -> Column:
    """FLT-02: a call to act and an offer."""
    return once(F.lower(gate_form(headline, body)), lambda t: any_of(t, lex.promo_calls) & any_of(t, lex.promo_offers))


def liveblog(headline: Column, body: Column, lex: Lexicon = PERSIAN) -> Column:
    """FLT-03."""
    return gate_form(headline, body).rlike("(?i)" + "|".join(lex.liveblog))


def low_value(headline: Column, body: Column, lex: Lexicon = PERSIAN) -> Column:
    """FLT-05: trivia, unless the first 24 material words show substance."""
    t = gate_form(headline, body)
    return any_of(t, lex.trivia) & ~any_of(t, lex.material[:24])


def ceremony(headline: Column, body: Column, lex: Lexicon = PERSIAN) -> Column:
    """FLT-06."""
    t = gate_form(headline, body)
    return any_of(t, lex.ceremony) & ~any_of(t, lex.material)


def materiality_floor(headline: Column, body: Column, lex: Lexicon = PERSIAN) -> Column:
    """FLT-08: the least weight to publish: home, region, other."""
    t = gate_form(headline, body)
    return F.when(any_of(t, lex.home), FLOORS[0]).when(any_of(t, lex.region), FLOORS[1]).otherwise(FLOORS[2])


def quality_gate(headline: Column, body: Column, weight: Column, lex: Lexicon = PERSIAN) -> Column:
    """FLT-11: the first reason to hold a story, null to publish it."""
    return (
        F.when(promotional(headline, body, lex), "HOLD_PROMOTIONAL_CONTENT")
        .when(liveblog(headline, body, lex), "HOLD_LIVEBLOG_BOILERPLATE")
        .when(low_value(headline, body, lex), "LOW_VALUE_CONTENT")
        .when(ceremony(headline, body, lex), "LOW_MATERIALITY")
        .when(weight < materiality_floor(headline, body, lex), "MATERIALITY_FLOOR")
    )


def headline(text: Column) -> Column:
    """TXT-36: the first valid one of five lines, else the longest line (the first of equals)."""

    def of(lines: Column) -> Column:
        valid = F.filter(F.slice(lines, 1, 5), valid_headline)
        longest = F.aggregate(lines, F.lit(""), lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a))
        return F.coalesce(F.get(valid, 0), longest)

    return once(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda s: s != ""), of)


def valid_headline(line: Column) -> Column:
    """TXT-35: 15 characters, three words of two, and no label."""
    words = F.filter(F.split(line, r"\s+"), lambda w: F.length(w) > 1)
    return (F.length(line) >= 15) & (F.size(words) >= 3) & ~F.endswith(line, F.lit(":"))


def without_links(text: Column) -> Column:
    """TXT-43: no links, handles and source lines."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), LINKS, ""), "\n"), lambda s: ~reduce(or_, [F.startswith(F.trim(s), F.lit(w)) for w in FOOTERS[1:]]))
    return F.trim(F.array_join(F.transform(lines, lambda s: F.rtrim(F.regexp_replace(s, " {2,}", " "))), "\n"))


def without_repeated_lines(text: Column) -> Column:
    """TXT-44: of equal lines the first stays; blank ones stay."""

    def of(lines: Column) -> Column:
        def kept(bare: Column) -> Column:
            keep = F.filter(lines, lambda s, k: (F.get(bare, k) == "") | (F.array_position(bare, F.get(bare, k)) == k + 1))
            return F.array_join(keep, "\n")

        return once(F.transform(lines, trimmed), kept)

    return once(F.split(F.coalesce(text, F.lit("")), "\n"), of)


def resembles(a: Column, b: Column, least: float = 0.65) -> Column:
    """TXT-49: whether two texts share so many of their words."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: F.length(w) > 1)) for t in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(False)).otherwise(F.size(F.array_intersect(x, y)) / union >= least)


def identity_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """TXT-53: the identity an alias names, else the name with runs of other characters as one space."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    for alias, key in reversed(list((aliases or {}).items())):
        out = F.when(F.contains(low, F.lit(alias.lower())), key).otherwise(out)
    return out


def collapsed_origin(identity: Column, lineage: Column, name: Column, source_id: Column) -> Column:
    """TXT-54: one origin for each originator: identity, then lineage, then the name's identity, then the source."""
    key = identity_key(name)
    blank = F.lit("")
    return (
        F.when(F.coalesce(identity, blank) != "", F.concat(F.lit("identity:"), F.lower(F.trim(identity))))
        .when(F.coalesce(lineage, blank) != "", F.concat(F.lit("lineage:"), lineage))
        .when(key != "", F.concat(F.lit("identity:"), key))
        .otherwise(F.concat(F.lit("src:"), source_id.cast("string")))
    )


def cache_key(version: str, language: Column, title: Column, evidence: Column) -> Column:
    """TXT-61: evidence counts with its first 4000 characters."""
    return F.sha2(F.concat_ws("|", F.lit(version), F.coalesce(language, F.lit("")), F.coalesce(title, F.lit("")), F.substring(F.coalesce(evidence, F.lit("")), 1, 4000)), 256)


def redacted(text: Column) -> Column:
    """TXT-63: keys and tokens are masked."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)(sk-[a-z0-9_\-]{8,}|bearer\s+[a-z0-9._\-]{8,}|(?:api[_-]?key|token|secret|password)\s*[=:]\s*\S+)", "[REDACTED]")


def informative(text: Column) -> Column:
    """TXT-66: how many distinct words of three characters or more."""
    return F.size(F.array_distinct(F.filter(F.split(F.lower(C.normalized(text)), " "), lambda w: F.length(w) > 2)))


def split_speaker(text: Column) -> Column:
    """TXT-33: struct<speaker, body>: a first line that is a label is a speaker, never a headline."""
    label = r"^[^\w\s]*\s*[؀-ۿ\w .'\-]{2,100}\s*[:：]\s*$"

    def of(lines: Column) -> Column:
        first = F.coalesce(F.get(lines, 0), F.lit(""))
        said = first.rlike(label)
        speaker = F.when(said, F.trim(F.rtrim(F.trim(first), F.lit(":："))))
        return F.struct(speaker.alias("speaker"), F.array_join(F.when(said, F.slice(lines, 2, 1 << 30)).otherwise(lines), "\n").alias("body"))

    return once(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda s: s != ""), of)
