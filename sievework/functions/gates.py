"""Gates on public copy: notices that aren't news, abuse, trivia, ceremony, subjects that nothing resolves, scope, and the
gate that asks them all in order; and whether a text is a complete claim.  Lists are a parameter (``Gates``)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import claims as C
from . import lexicon as L
from .rules import FLOORS, any_of, gate_form
from .text import ARABIC_LETTERS, once, stripped, translated

# Fixed values.
ERROR_NOTICES = [
    r"^خطا(?:ی|\s+در)?\s+ترجمه(?:\s*[:：.!]|$)",
    r"^این\s+(?:خبر|متن|مطلب).{0,60}(?:اشکال|خطا|مشکل)\s+(?:در\s+)?ترجمه.{0,80}(?:بازبینی|بررسی|ناموفق)",
    r"^ترجمه\s+(?:این\s+)?(?:متن|خبر|مطلب).{0,100}(?:امکان\s*پذیر\s*نیست|ناموفق|خطا)",
    r"^(?:مت[أا]سفم[،,\s]*)?(?:من\s+)?نمی\s*توانم.{0,80}(?:ترجمه|پردازش|خلاصه\s*سازی)",
    r"^(?:مت[أا]سفم[،,\s]*)?امکان\s+(?:ترجمه|پردازش).{0,100}(?:نیست|ندارد)",
    r"^(?:translation\s+(?:error|failed)|error\s+(?:in\s+)?translation)\b",
    r"^(?:sorry[,!\s]*)?i\s+(?:cannot|can't|am\s+unable\s+to).{0,80}(?:translate|summari[sz]e|process)\b",
]
BROADCAST = r"^(?:تازه\s*ترین|آخرین|جدیدترین)\s+(?:خبرها|اخبار|خبرهای).{0,180}(?:رادیو|پادکست|برنامه)"
MIXED_WORD = r"[A-Za-z][ء-يٱ-ۓ]|[ء-يٱ-ۓ][A-Za-z]"
DANGLING_END = r"(?:^|\s)(?:در|از|به|برای|بین|و|که|با|درباره|اگر|را|اما|یا|[ء-يٱ-ۓ])\s*[.!؟،؛:]*$"
FOOTER_STARTS = ["منبع:", "منابع:", "—", "🆔", "@"]
GENERIC_STARTS = ["این ادعا تا این لحظه به تأیید مستقل نرسیده", "پایش ادامه دارد"]
LIVE_PAGES = [
    r"(?:به\s+)?(?:صفحه|پوشش)\s+زنده(?:\s+ما)?[^\n]{0,100}خوش\s*آمدید",
    r"^(?:🔻|🔴|⚫|🟠|🟡|🟢)?\s*پایان\s+(?:این\s+)?پوشش\s+زنده",
    r"(?:صفحه|پوشش)\s+زنده(?:\s+ما)?[^\n]{0,80}(?:به\s+پایان\s+رسید|تمام\s+شد)",
    r"پوشش\s+زنده[^\n]{0,180}(?:در\s+این\s+صفحه|با\s+ما\s+همراه\s+باشید|همراه\s+ما\s+باشید|گزارش\s+خواهیم\s+کرد|اینجا\s+ببینید)",
    r"(?i)welcome\s+to\s+(?:our\s+)?live\s+(?:page|coverage)",
    r"(?i)(?:live\s+coverage|live\s+page)\s+(?:has\s+)?(?:ended|closed)",
    r"(?:أهلا|اهلا|مرحب[اأ])[^\n]{0,80}(?:التغط[يی]ة\s+المباشرة|البث\s+المباشر)",
    r"(?:انتهت|نهاية)\s+(?:هذه\s+)?التغط[يی]ة\s+المباشرة",
]
ABUSE = [
    r"\b(کص|کیر|جنده|قحبه|حروم‌زاده|حرومزاده|بی‌شرف|بیشرف|عوضی|فاحشه|شلوار|مرد\s?کون|کون\s?ده|هرمی|الکسی|لات\b|لاقول|مغز\s?کم|عقب‌مانده|کره|معلول|حیوان صفت)",
    r"زن\s?(موشلی|کثیف|بدکاره)|مرد\s?(کثیف|پست)|اخوند\s?(کذب|دزد)",
    r"تنکه|حروم|ننه\s?تو|دختت|خواهرت",
]
TRIVIA = [
    r"پرنده|پرندگان|حیوانات|فیل‌ها|فیل\b|خرگوش|گربه|سگ‌ها|سگ\b|موجود عجیب|دایناسور|نهنگ|دلفین",
    r"شگفت|عجیب‌ترین|باورنکردنی|جالب‌ترین|دانستنی‌ها|آیا می‌دانستید",
    r"سلبریتی|بازیگر出名|ستاره اینستاگرام|وایرال|ویدیوی واکنش",
    r"داماد|عروس|سفرهای .*سفری|دیلیتی|گوشتی‌ترین",
    r"آخرین فیلم|بوکس ?آفیس|پوستر فیلم|تیزر فیلم|فصل جدید سریال",
    r"به نظر جوان‌تر|به نظر پیرتر|استایل جدید|ازدواج سلبریتی|جدایی سلبریتی",
]
COUNTRIES = ["ایران", "تهران", "آمریکا", "واشنگتن", "اسرائیل", "تل‌آویو", "روس", "روسیه", "مسکو", "چین", "پکن", "ترکیه", "آنکارا", "آلمان", "برلین", "فرانسه", "پاریس", "بریتانیا", "لندن", "عربستان", "ریاض", "امارات", "ابوظبی", "دبی", "قطر", "بحرین", "کویت", "عمان", "مسقط", "یمن", "صنعا", "عراق", "بغداد", "سوریه", "دمشق", "لبنان", "بیروت", "فلسطین", "غزه", "اسلام‌آباد", "پاکستان", "افغانستان", "کابل", "هند", "دهلی", "ژاپن", "توکیو", "کره", "اوکراین", "کی‌یف", "لهستان", "آزربایجان", "باکو", "ارمنستان", "قزاقستان", "مصر", "قاهره", "اردن", "امان", "لیبی", "تونس", "الجزیره", "مراکش", "مغرب", "سودان", "اتیوپی", "کنیا", "نیجریه", "سومالی", "اریتره", "جیبوتی", "کانادا", "مکزیک", "برزیل", "آرژانتین", "استرالیا", "سعودی", "یمنی", "عراقی", "سوری", "لبنانی", "فلسطینی", "اماراتی", "عمانی", "ایرانی", "آمریکایی", "اسرائیلی", "روسی", "چینی", "ترکیه‌ای", "اروپا", "اتحادیه اروپا", "ناتو"]
ORGANISATIONS = ["سازمان ملل", "شورای امنیت", "آژانس", "اتحادیه اروپا", "ناتو", "اوپک", "بریکس", "شانگهای", "سازمان بهداشت جهانی", "صندوق بین‌المللی پول", "بانک مرکزی", "دادگاه", "نیروهای مسلح", "ارتش", "سپاه", "انرژی اتمی"]
PRONOUN_SUBJECT = r"^(?:او|وی|آنها|آن‌ها|این کشور|آن کشور)\b"
THIS_COUNTRY = r"(?:این|آن)\s+کشور\b"
ROLE_SUBJECT = r"(?:^|\s)(?:وزیر|رئیس|رئیس جمهور|رئیس‌جمهور|رئیس وزیران|نخست وزیر|سفیر|نماینده|مقامات|فرمانده|دبیرکل|جانشین)"
HOME_PHRASES = ["ایران", "تهران", "اصفهان", "مشهد", "تبریز", "شیراز", "اهواز", "کرمان", "قم", "کرج", "رشت", "زاهدان", "بندرعباس", "خلیج فارس", "تنگه هرمز", "هرمز", "آبادان", "بوشهر", "نطنز", "فردو", "اراک", "خوزستان", "سپاه پاسداران", "سپاه", "قدس", "بسیج", "irgc", "آیت الله", "رهبر انقلاب", "مجلس شورای اسلامی", "قوه قضائیه", "رئیس جمهور ایران", "وزیر خارجه ایران", "دیپلمات ایران", "تحریم", "sanction", "sanctions", "تومان", "ریال", "دلار تهران", "بورس تهران", "فیلترینگ", "شبکه ملی اطلاعات", "irna", "irib", "persian gulf", "hormuz", "strait of hormuz", "irani", "iranian", "iran", "tehran", "qom", "mashhad", "iaea", "آژانس بین المللی انرژی اتمی", "آژانس", "انرژی اتمی ایران", "برنامه هسته‌ای", "هسته‌ای", "غنی‌سازی"]
HOME_CORE = ["ایران", "تهران", "iran", "irani"]
GENERIC_BLOCKERS = ["فوتبال", "سینما", "سلبریتی", "باشگاه", "لیگ قهرمانان", "جام جهانی", "المپیک", "olympic", "celebrity", "league", "cup final", "box office"]
NEIGHBOURS = ["عراق", "بغداد", "ترکیه", "آنکارا", "سوریه", "دمشق", "لبنان", "بیروت", "اسرائیل", "تل‌آویو", "فلسطین", "غزه", "یمن", "حوثی", "عربستان", "ریاض", "امارات", "قطر", "بحرین", "کویت", "عمان", "افغانستان", "پاکستان", "آذربایجان", "ارمنستان", "ترکمنستان", "خلیج فارس", "دریای سرخ", "خاورمیانه", "قفقاز"]
SUBSTANCE = ["جنگ", "حمله", "موشک", "پهپاد", "بمباران", "آتش‌بس", "درگیری", "نظامی", "امنیت", "ترور", "کشته", "زخمی", "تلفات", "تهدید", "تحریم", "اقتصاد", "تورم", "ارز", "دلار", "نفت", "گاز", "تجارت", "صادرات", "واردات", "بانک", "سرمایه", "قیمت", "مرز", "مذاکره", "توافق", "دیپلماسی", "سفارت", "انتخابات", "اعتراض", "بحران", "war", "attack", "missile", "sanction", "oil", "trade", "border"]
CEREMONY = [r"استقبال کرد|استقبال نمود|استقبال به عمل آورد", r"اعتبارنامه خود را تقدیم|تقدیم اعتبارنامه", r"پیام تبریک|تبریک به مناسبت|پیام تسلیت رسمی متن", r"مراسم یادبود|جلسه تشریفاتی|دیدار تودیع", r"سفیر جدید", r"جشن روز ملی|روز ملی|مناسبت روز ملی"]
REQUIRED = {"QUOTE": ["actor", "predicate"], "ATTACK": ["predicate", "object_"], "CASUALTY": ["predicate", "quantity"], "MARKET": ["object_", "predicate", "time_ref"], "INTERNET": ["location", "predicate"], "GENERAL": ["predicate"]}
AREAS = ["استان", "شهر", "کشور", "منطقه", "سراسر"]
TARGETS = ["منطقه", "شهر", "مرز", "پایگاه", "مقر", "کشور", "بغداد", "تهران", "اسرائیل", "عراق", "سوریه", "لبنان", "یمن", "امریکا", "آمریکا"]
GOODS = ["دلار", "طلا", "سکه", "بورس", "شاخص", "نفت", "ارز", "تومان", "یورو"]
TODAY = ["امروز", "امشب"]
LEAST_WORDS = 5


@dataclass(frozen=True)
class Gates:
    """Word lists and patterns of the gates; the defaults are the newsroom's Persian ones."""

    lexicon: L.Lexicon = L.PERSIAN
    notices: list[str] = field(default_factory=lambda: ERROR_NOTICES)
    broadcast: str = BROADCAST
    mixed: str = MIXED_WORD
    dangling: str = DANGLING_END
    generic: list[str] = field(default_factory=lambda: GENERIC_STARTS)
    live: list[str] = field(default_factory=lambda: LIVE_PAGES)
    abuse: list[str] = field(default_factory=lambda: ABUSE)
    trivia: list[str] = field(default_factory=lambda: TRIVIA)
    ceremony: list[str] = field(default_factory=lambda: CEREMONY)
    countries: list[str] = field(default_factory=lambda: COUNTRIES)
    organisations: list[str] = field(default_factory=lambda: ORGANISATIONS)
    pronoun: str = PRONOUN_SUBJECT
    this_country: str = THIS_COUNTRY
    role: str = ROLE_SUBJECT
    home: list[str] = field(default_factory=lambda: HOME_PHRASES)
    core: list[str] = field(default_factory=lambda: HOME_CORE)
    blockers: list[str] = field(default_factory=lambda: GENERIC_BLOCKERS)
    neighbours: list[str] = field(default_factory=lambda: NEIGHBOURS)
    substance: list[str] = field(default_factory=lambda: SUBSTANCE)
    #: Whether words, their bounds and spaces in the patterns are those of any script; else letters, digits and spaces of ASCII are.
    any_script: bool = True

    def pattern(self, of: str, flags: str = "") -> str:
        """A pattern with its flags; before Java 19 a bound knows all letters whatever the flags, so that of ASCII is spelt out."""
        if self.any_script:
            return f"(?U{flags})" + of
        return f"(?d{flags}{'u' if 'i' in flags else ''})" + of.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))").replace(r"\s", r"[\t\n\f\r ]")


PERSIAN = Gates()


def _matches(text: Column, patterns: list[str], g: Gates) -> Column:
    return text.rlike(g.pattern("(?:" + ")|(?:".join(patterns) + ")"))


def copy_lines(headline: Column, body: Column) -> Column:
    """Lines of public copy without footers, marks of diacritics and emphasis, and what isn't a word at their start."""
    text = F.concat(F.coalesce(headline, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    # the range before && settles most characters by one comparison
    lines = F.transform(F.split(text, "\r\n|[\n-\x1e\x85-\u2029&&[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]]"), lambda s: stripped(s))
    kept = F.filter(lines, lambda s: (s != "") & ~s.rlike("^(?:" + "|".join(FOOTER_STARTS) + ")"))
    plain = F.transform(kept, lambda s: F.regexp_replace(translated(s, ARABIC_LETTERS[0] + C.ZWNJ, ARABIC_LETTERS[1] + " "), "[*\\u064b-\\u0670&&[\\u064b-\\u065f\\u0670*]]", ""))
    bare = F.transform(plain, lambda s: stripped(F.regexp_replace(s, r"^[^\p{L}\p{N}_؀-ۿ]+", "")))
    return F.filter(bare, lambda s: s != "")


def unpublishable(headline: Column, body: Column, g: Gates = PERSIAN) -> Column:
    """FLT-01: why copy isn't fit to publish: a notice of an error, words of mixed scripts, an end that dangles, an announcement
    of a programme; null if none."""
    return once(copy_lines(headline, body), lambda lines: _unfit(lines, g))


def _unfit(lines: Column, g: Gates) -> Column:
    notice = F.exists(lines, lambda s: s.rlike(g.pattern("(?:" + ")|(?:".join(g.notices) + ")", "i")))
    news = F.filter(lines, lambda s: ~F.lit(False) if not g.generic else ~s.rlike("^(?:" + "|".join(g.generic) + ")"))
    return (
        F.when(notice | F.exists(lines, lambda s: s.rlike(g.mixed)), "HOLD_TRANSLATION_QUALITY")
        .when(F.exists(lines, lambda s: s.rlike(g.pattern(g.dangling)) | s.rlike(r"(?:…|\.\.\.)$")), "CONTEXT_INCOMPLETE")
        .when((F.size(news) > 0) & F.forall(news, lambda s: s.rlike(g.pattern(g.broadcast))), "HOLD_NON_NEWS_CONTENT")
    )


def live_page(headline: Column, body: Column, g: Gates = PERSIAN) -> Column:
    """FLT-03: prose of a live page about itself."""
    return _matches(gate_form(headline, body), g.live, g)


def _abusive(t: Column, g: Gates) -> Column:
    return _matches(t, g.abuse, g) & ~any_of(t, g.lexicon.material)


def abusive(headline: Column, body: Column, g: Gates = PERSIAN) -> Column:
    """FLT-04: abuse, unless there is material substance."""
    return once(gate_form(headline, body), lambda t: _abusive(t, g))


def _trivial(t: Column, g: Gates) -> Column:
    return _matches(t, g.trivia, g) & ~any_of(t, g.lexicon.material[:24])


def trivial(headline: Column, body: Column, g: Gates = PERSIAN) -> Column:
    """FLT-05: trivia, unless the first 24 material words show substance."""
    return once(gate_form(headline, body), lambda t: _trivial(t, g))


def _ceremonial(t: Column, g: Gates) -> Column:
    return _matches(t, g.ceremony, g) & ~any_of(t, g.lexicon.material)


def ceremonial(headline: Column, body: Column, g: Gates = PERSIAN) -> Column:
    """FLT-06: protocol alone."""
    return once(gate_form(headline, body), lambda t: _ceremonial(t, g))


def anchored(text: Column, g: Gates = PERSIAN) -> Column:
    """Whether a text names a country, a body, something in Latin letters, or quotes."""
    return any_of(text, g.countries) | any_of(text, g.organisations) | text.rlike("[A-Za-z]{3,}") | text.rlike("(?d)[«“\"'].{2,60}[»”\"']")


def context_incomplete(headline: Column, body: Column, g: Gates = PERSIAN) -> Column:
    """FLT-07: a headline whose subject nothing in the public text resolves.

    "This country" needs a country before it; what comes after is often whom it acts upon.
    """
    return once(F.struct(gate_form(headline).alias("h"), gate_form(headline, body).alias("t")), lambda x: _incomplete(x["h"], x["t"], g))


def _incomplete(h: Column, full: Column, g: Gates) -> Column:
    before = F.regexp_extract(h, g.pattern(f"^(.*?){g.this_country}", "s"), 1)
    unnamed = h.rlike(g.pattern(g.this_country)) & ~any_of(before, g.countries)
    bare = (h.rlike(g.pattern(g.pronoun)) | h.rlike(g.pattern(g.role))) & ~anchored(full, g)
    return (h == "") | unnamed | bare


def home_related(text: Column, g: Gates = PERSIAN) -> Column:
    """FLT-10: about the home country; sport and entertainment only where its name is in the text."""
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda t: _about_home(t, g))


def _about_home(t: Column, g: Gates) -> Column:
    return ~(any_of(t, g.blockers) & ~any_of(t, g.core)) & any_of(t, g.home)


def in_scope(headline: Column, body: Column, g: Gates = PERSIAN) -> Column:
    """FLT-10: about home, or of substance and about a neighbour."""
    t = F.lower(F.concat_ws(" ", F.coalesce(headline, F.lit("")), F.coalesce(body, F.lit(""))))
    return once(t, lambda t: _about_home(t, g) | (any_of(t, g.neighbours) & any_of(t, g.substance)))


def publication_gate(headline: Column, body: Column, weight: Column, duplicate: Column | None = None, g: Gates = PERSIAN) -> Column:
    """FLT-11: the first of ten reasons to hold a story, null to publish it; duplicate: whether FLT-09 found it sent before."""

    def rest(t: Column) -> Column:
        floor = F.when(any_of(t, g.lexicon.home), FLOORS[0]).when(any_of(t, g.lexicon.region), FLOORS[1]).otherwise(FLOORS[2])
        return (
            F.when(once(F.lower(t), lambda low: any_of(low, g.lexicon.promo_calls) & any_of(low, g.lexicon.promo_offers)), "HOLD_PROMOTIONAL_CONTENT")
            .when(_matches(t, g.live, g), "HOLD_LIVEBLOG_BOILERPLATE")
            .when(_abusive(t, g), "HOLD_ABUSIVE")
            .when(_trivial(t, g), "LOW_VALUE_CONTENT")
            .when(_ceremonial(t, g), "LOW_MATERIALITY")
            .when(once(gate_form(headline), lambda h: _incomplete(h, t, g)), "CONTEXT_INCOMPLETE")
            .when(weight < floor, "MATERIALITY_FLOOR")
            .when(F.lit(False) if duplicate is None else F.coalesce(duplicate, F.lit(False)), "DROP_DUPLICATE")
            .when(~in_scope(headline, body, g), "OUT_OF_EDITORIAL_SCOPE")
        )

    return F.coalesce(unpublishable(headline, body, g), once(gate_form(headline, body), rest))


def completeness(text: Column, hint: Column | None = None, lex: L.Lexicon = L.PERSIAN) -> Column:
    """TXT-42: struct<state, reason, missing> of a text as a claim: COMPLETE, CONTEXT_ONLY (a label or opener), or INCOMPLETE.

    What a class needs and the text lacks is missing; words of a list stand for a place, a target, goods or a day.
    """
    from sievework.operators.stories import prefix_item, structured

    t = F.trim(F.coalesce(text, F.lit("")))
    claim = structured(t, lex)
    kind = C.claim_class(C.normalized(t), lex.classes)
    said = F.trim(F.regexp_extract(t, r"(?U)^([؀-ۿ\w ]{3,40}?)\s+(?:گفت|اعلام کرد|اظهار کرد)", 1))
    speaker = F.coalesce(claim["speaker"], hint if hint is not None else F.lit(None).cast("string"), F.when((kind == "QUOTE") & (said != ""), said))
    has = {
        "actor": F.coalesce(speaker, F.lit("")) != "", "predicate": F.coalesce(claim["predicate"], F.lit("")) != "", "quantity": F.coalesce(claim["quantity"], F.lit("")) != "",
        "location": any_of(t, AREAS), "object_": F.when(kind == "ATTACK", any_of(t, TARGETS)).otherwise(any_of(t, GOODS)), "time_ref": claim["time_ref"].isNotNull() | any_of(t, TODAY),
    }
    missing = F.array().cast("array<string>")
    for name, slots in REQUIRED.items():
        missing = F.when(kind == name, F.array_compact(F.array(*[F.when(~has[s], s) for s in slots]))).otherwise(missing)
    opener = t.rlike("^(?:" + "|".join(L.CONNECTIVES) + ")") & (F.length(t) <= 60)
    few = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) > 1)) < LEAST_WORDS
    none = F.array().cast("array<string>")

    def is_(state: str, reason: str, slots: Column = none) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"), slots.alias("missing"))

    return (
        F.when(t == "", is_("INCOMPLETE", "EMPTY_TEXT"))
        .when(prefix_item(t), is_("CONTEXT_ONLY", "SPEAKER_OR_CONTEXT_PREFIX"))
        .when(opener, is_("CONTEXT_ONLY", "CONNECTIVE_FRAGMENT"))
        .when(F.size(missing) > 0, is_("INCOMPLETE", "MISSING_SLOTS", missing))
        .when(few, is_("INCOMPLETE", "TOO_FEW_TOKENS"))
        .otherwise(is_("COMPLETE", ""))
    )
