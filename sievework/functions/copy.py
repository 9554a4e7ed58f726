"""Public copy put together: lines that are boilerplate, a headline that its lead repeats or completes, and whether what is left says anything."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gates import PERSIAN, Gates, unpublishable
from .rules import valid_headline
from .text import once

# Fixed values.
BOILERPLATE = ["بر پایه گزارش‌های رسیده", "این موارد از منابع تحت پایش", "بررسی منابع نشان می‌دهد", "سامانه راستی‌آزمایی", "مطابق بررسی سیستم", "این اطلاعات تاکنون به‌طور مستقل تأیید نشده است", "تأیید شد", "با ما اخبار جنگی بروز باشید", "چنل های بی سواد"]
READ_MORE = r"(?i)^\s*(?:بیشتر\s+بخوانید|ادامه\s+(?:مطلب|خبر)|جزئیات\s+بیشتر|مطالعه\s+بیشتر|برای\s+مطالعه\s+بیشتر|read\s+more)\s*[:：\-–—]?\s*$"
SOURCE_LINE = r"(?i)^\s*(?:📖\s*)?(?:منبع|source)\s*[:：]"
STATUS_ONLY = ["بررسی این موضوع در منابع در دسترس", "تا این لحظه به تأیید مستقل نرسیده است", "پایش ادامه دارد و در صورت تأیید"]
FOOTER, HANDLE = "؟ |", "🆔 @"
ICONS = "🟢🔴🟠⚠️❌"
SENTENCE_ENDS = "؛.!؟?"
SHORT_LINE, LEAST_HEAD, LEAST_WORDS = 120, 30, 4


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _has(x: Column, words: list[str]) -> Column:
    return reduce(or_, [F.contains(x, F.lit(w)) for w in words])


def without_boilerplate(text: Column, phrases: list[str] = BOILERPLATE, read_more: str = READ_MORE) -> Column:
    """TXT-45: no short line with a stock phrase, and no call to read on that has lost its link; two line breaks at most."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.filter(lines, lambda s: ~(_has(s, phrases) & (F.length(s) < SHORT_LINE)) & ~_strip(s).rlike("(?U)" + read_more))
    return _strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


def squashed_lead(text: Column) -> Column:
    """TXT-46: copy whose lead begins with its bold headline.

    A headline that was cut (it ends in an ellipsis) grows to the end of its sentence in the lead; a whole one stays.  What the lead
    says beyond it is the body.  Headlines under thirty characters, and leads that say something else, are left alone.
    """

    def of(blocks: Column) -> Column:
        first, lead = F.get(blocks, 0), _strip(F.coalesce(F.get(blocks, 1), F.lit("")))
        bold = F.regexp_extract(first, r"(?s)\*\*(.+?)\*\*", 1)
        head = _strip(bold)
        cut = head.rlike(r"(?:…|\.\.\.)$")
        stem = F.regexp_replace(F.regexp_replace(head, r"(?:…|\.\.\.)$", ""), r"[. ]+$", "")
        n = F.length(stem)
        # from the last letter of the stem on, the first end of a sentence
        tail = F.substring(lead, F.greatest(n, F.lit(1)), F.length(lead))
        end = F.length(F.regexp_extract(tail, f"(?s)^([^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}])", 1))
        grown = F.when(end == 0, lead).otherwise(_strip(F.substring(lead, F.lit(1), F.greatest(n, F.lit(1)) + end - 1)))
        beyond = F.when(end == 0, "").otherwise(_strip(F.substring(lead, F.greatest(n, F.lit(1)) + end, F.length(lead))))
        rest = F.substring(lead, F.when(F.startswith(lead, head), F.length(head)).otherwise(n) + 1, F.length(lead))
        rest = _strip(F.regexp_replace(rest, r"^[ \t\n،,:؛\-–—]+", ""))
        new, body = F.when(cut, grown).otherwise(head), F.when(cut, beyond).otherwise(rest)
        at = F.instr(first, "**")
        top = F.concat(F.substring(first, F.lit(1), at + 1), new, F.substring(first, at + 2 + F.length(bold), F.length(first)))
        kept = F.filter(F.concat(F.array(top), F.when(body == "", F.array().cast("array<string>")).otherwise(F.array(body)), F.slice(blocks, 3, F.greatest(F.size(blocks) - 2, F.lit(0)))), lambda b: b.isNotNull())
        hit = (F.size(blocks) >= 2) & (bold != "") & (n >= LEAST_HEAD) & F.startswith(lead, stem)
        return F.when(hit, F.array_join(kept, "\n\n"))

    return F.coalesce(once(F.split(_strip(F.coalesce(text, F.lit(""))), r"\n\s*\n"), of), F.coalesce(text, F.lit("")))


def substantive(text: Column, g: Gates = PERSIAN, letters: str = "؀-ۿ", generic: list[str] = STATUS_ONLY, footer: str = FOOTER) -> Column:
    """TXT-48: whether copy without icons, sources, footers and calls to read on still states something.

    Not if it is unfit to publish (FLT-01), its headline breaks off, nothing but its status is left, or it has under four words of the home letters.
    ``footer``: what marks a line with the publisher's own name.
    """
    t = _strip(F.coalesce(text, F.lit("")))
    lines = F.filter(F.transform(F.split(t, "\n"), _strip), lambda s: ~s.rlike("(?U)" + SOURCE_LINE) & ~F.contains(s, F.lit(footer)) & ~F.startswith(s, F.lit(HANDLE)))
    bare = F.transform(lines, lambda s: F.replace(F.when(s.rlike(f"^[{ICONS}]"), _strip(F.regexp_replace(s, f"^[{ICONS} ]+", ""))).otherwise(s), F.lit("*"), F.lit("")))
    said = F.filter(bare, lambda s: (s != "") & ~s.rlike("(?U)" + READ_MORE))

    def of(lines: Column) -> Column:
        first = F.coalesce(F.get(lines, 0), F.lit(""))
        words = F.filter(F.flatten(F.transform(lines, lambda s: F.split(s, r"(?U)\s+"))), lambda w: (F.length(w) > 1) & w.rlike(f"[{letters}]"))
        claims = F.filter(lines, lambda s: ~_has(s, generic))
        return (F.size(lines) > 0) & ~first.rlike(r"(?:…|\.\.\.)$") & (F.size(claims) > 0) & (F.size(words) >= LEAST_WORDS) & (valid_headline(F.substring(first, 1, 140)) | (F.size(words) >= 6))

    return (t != "") & unpublishable(t, F.lit(""), g).isNull() & once(said, of)
