"""Audits of generated copy against its source, and objects out of answers that wrap them.

Both go to Python in Arrow batches.  All words that an audit looks for are one automaton a form of the text, so a text is
read once however many names there are; which texts hold which words decides the codes.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import claims as C

# Fixed values.
UNCERTAIN = ["ممکن است", "احتمال دارد", "به گزارش", "ادعا شده", "گفته می‌شود", "may", "might", "could", "reported", "alleged", "unconfirmed", "ربما", "قد", "يُحتمل", "وفقاً", "לפי הדיווח", "אולי"]
CERTAIN = ["قطعاً", "قطعا", "به‌طور قطعی", "به طور قطعی", "بدون شک", "تأیید شد که", "مسلم", "definitely", "certainly", "confirmed that", "proven"]
NOT_HERE = ["نکرد", "نشد", "نیست", "نخواهد", "ندارد", "نمی", "بدون", "خلاف", "نداد", "نگرفت", "نرفت", "نبود", "نگفت", "نداشت", "نخواست", "نگشت", "نیامد", "نتوانست", "غیر", "هیچ"]
NOT_THERE = ["not", "no ", "never", "without", "denied", "denies", "لم ", "لن ", "لا ", "ليس", "بدون", "رفض", "לא ", "בלי"]
NAMES = {"عراقچی": ["araghchi", "araqchi", "عباس عراقچي", "عراقچي", "عباس عراقجي", "عراقجي", "عراقچی"]}
MALFORMED = ["هوادع", "اصابات", "إصابات", "خاتیه", "آمریکاییها", "هستهای", "افشاگریهای", "گزینههای", "زیرساختها", "حلفایشان"]
LEAKS = ["قوات", "اقتحام", "مداهمات", "اعتقالات", "جبهات", "متطوعین", "جرحی", "غارات", "مطار", "فی", "عشرات"]
COUNTRIES = {
    "iran": "ایران", "tehran": "تهران", "israel": "اسرائیل", "gaza": "غزه", "america": "آمریکا", "american": "آمریکایی", "u.s.": "آمریکا", "us": "آمریکا", "united states": "آمریکا", "russia": "روس", "china": "چین",
    "turkey": "ترکیه", "turkiye": "ترکیه", "britain": "بریتانیا", "uk": "بریتانیا", "france": "فرانسه", "germany": "آلمان", "saudi": "عربستان", "emirates": "امارات", "uae": "امارات",
    "qatar": "قطر", "iraq": "عراق", "syria": "سوریه", "lebanon": "لبنان", "yemen": "یمن", "oman": "عمان", "egypt": "مصر", "pakistan": "پاکستان", "ایران": "ایران", "اسرائیل": "اسرائیل", "امریکا": "آمریکا",
}
WHOLE = {"us", "uk", "u.s.", "uae"}
HERE = ["ایران", "iran", "איראן", "טהראן", "تهران", "tehran"]
CALQUES = ["نقص بنزین", "نقص البنزين", "نقص البنزین"]
STRONG, MILITARY, ESCALATION, IN_HERE, DESECRATION, MADE = "زخم قوی", "تصاعد نظامی", "تصعید عسکری", "در ایران", "تدنيس", "تولید"
_LETTERS, _CJK = re.compile(r"[؀-ۿ]+"), re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f]")
_PRESS = re.compile(r"[0-9]{1,3}(?:[,٬،][0-9]{3})+|[0-9]+")
_DIGITS = str.maketrans(*C.DIGITS)


@lru_cache(maxsize=16)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


def held(text: str, words: tuple[str, ...], whole: frozenset[str] = frozenset()) -> set[str]:
    """Which of some words a text holds anywhere; those of ``whole`` without a small Latin letter beside them."""
    found: set[str] = set()
    for end, w in _automaton(words).iter(text):
        if w not in found:
            start = end - len(w)
            if w not in whole or not ("a" <= text[start : start + 1] <= "z" and start >= 0 or "a" <= text[end + 1 : end + 2] <= "z"):
                found.add(w)
    return found


def _folded(text: str) -> str:
    return text.lower().replace("ي", "ی").replace("ك", "ک")


def _gate(text: str) -> str:
    return text.replace("ي", "ی").replace("ك", "ک").replace("‌", " ").strip().translate(_DIGITS)


def _press(text: str) -> set[str]:
    return {re.sub("[,٬،]", "", n) for n in _PRESS.findall(text.translate(_DIGITS))}


def lost(source: str, generated: str) -> list[str]:
    """TXT-51: numbers (in order) and countries of a source that the copy lacks, each once."""
    src, out = _gate(source).lower(), _gate(generated)
    numbers = [f"num:{n}" for n in sorted(set(re.findall(r"\d+", src))) if n not in out]
    there, here = held(src, tuple(COUNTRIES), frozenset(WHOLE)), held(out, tuple(dict.fromkeys(COUNTRIES.values())))
    return numbers + list(dict.fromkeys(f"country:{fa}" for en, fa in COUNTRIES.items() if en in there and fa not in here))


_LOWER_SRC = tuple(w.lower() for w in dict.fromkeys(NOT_HERE + NOT_THERE + UNCERTAIN))
_LOWER_GEN = tuple(w.lower() for w in dict.fromkeys(NOT_HERE + CERTAIN))
_NOT, _MAYBE = {w.lower() for w in NOT_HERE + NOT_THERE}, {w.lower() for w in UNCERTAIN}
_NOT_FA, _SURE = {w.lower() for w in NOT_HERE}, {w.lower() for w in CERTAIN}
_ALIASES = {_folded(a): name for name, aliases in NAMES.items() for a in aliases}
_FOLDED_SRC = tuple(dict.fromkeys([*_ALIASES, *HERE, STRONG, ESCALATION]))
_FOLDED_GEN = tuple(dict.fromkeys([*NAMES, *CALQUES, IN_HERE, STRONG, MILITARY, MADE]))


def issues(source: str | None, generated: str | None) -> list[str]:
    """TXT-50: codes of what a translation invented, lost, reversed, made certain, or let through; none if it is safe."""
    src, gen = source or "", generated or ""
    out: list[str] = []
    numbers = _press(gen)
    if numbers and not numbers <= _press(src):
        out.append("NUMBERS_INVENTED")
    out += [f"ENTITY_LOST:{x}" for x in lost(src, gen)]
    said, told = held(src.lower(), _LOWER_SRC), held(gen.lower(), _LOWER_GEN)
    if said & _NOT and not told & _NOT_FA:
        out.append("NEGATION_REVERSED")
    if said & _MAYBE and told & _SURE:
        out.append("CERTAINTY_ESCALATED")
    fsrc, fgen = _folded(src), _folded(gen)
    named, kept = held(fsrc, _FOLDED_SRC), held(fgen, _FOLDED_GEN)
    out += [f"ENTITY_CHANGED:{name}" for name in NAMES if any(_ALIASES.get(w) == name for w in named) and name not in kept]
    words = {_folded(w) for w in _LETTERS.findall(gen)}
    shared = {_folded(w) for w in _LETTERS.findall(src)} & words
    out += [f"ARABIC_SOURCE_TOKEN_LEAK:{w}" for w in sorted(shared) if (w.startswith("ال") and len(w) >= 5) or w in LEAKS]
    if _CJK.search(gen):
        out.append("FOREIGN_SCRIPT_LEAK:CJK")
    out += [f"PERSIAN_ORTHOGRAPHY:{w}" for w in sorted(set(MALFORMED) & words)]
    if kept & set(CALQUES):
        out.append("PERSIAN_CALQUE:نقص_بنزین")
    if IN_HERE in kept and not named & set(HERE):
        out.append("UNSUPPORTED_IRAN_LOCATION")
    if STRONG in kept and STRONG in named:
        out.append("PERSIAN_CALQUE:زخم_قوی")
    if MILITARY in kept and ESCALATION in named:
        out.append("PERSIAN_CALQUE:تصاعد_نظامی")
    if DESECRATION in src and MADE in kept:
        out.append("SEMANTIC_MISTRANSLATION:TADNIS_ALAQSA")
    return out


def translation_issues(source: Column, generated: Column) -> Column:
    """TXT-50 as a column, array<string>."""

    @F.pandas_udf("array<string>")
    def audit(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([issues(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return audit(source, generated)


def first_object(text: str | None) -> str | None:
    """The first JSON object of an answer: in a code fence, behind prose, before other data, or in the last line of an event
    stream that isn't its end; None if there is none."""
    if text is None:
        return None
    body = text.strip()
    if body.startswith("data:"):
        lines = [line.strip()[5:].strip() for line in body.splitlines() if line.strip().startswith("data:") and "[DONE]" not in line]
        body = next((line for line in reversed(lines) if line), "")
    if body.startswith("```"):
        body = body.strip("`")
        body = body[4:] if body.lower().startswith("json") else body
    start, end = body.find("{"), body.rfind("}")
    if start < 0:
        return None
    try:
        if end > start and isinstance(json.loads(body[start : end + 1]), dict):
            return body[start : end + 1]
    except (ValueError, RecursionError):
        pass
    try:
        _, length = json.JSONDecoder().raw_decode(body[start:])
        return body[start : start + length]
    except (ValueError, RecursionError):
        return None


def tolerant_object(text: Column) -> Column:
    """TXT-62: the first object of an answer as a variant, null where there is none.

    Spark parses answers that are an object as they stand; only others go to Python.
    """

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    plain = F.try_parse_json(text)
    whole = plain.isNotNull() & text.rlike(r"^\s*\{")
    return F.when(whole, plain).otherwise(F.try_parse_json(found(F.when(~F.coalesce(whole, F.lit(False)), text))))
