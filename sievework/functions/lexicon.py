"""Word lists as a parameter: the newsroom's Persian lists, and a list for text of other languages."""

from __future__ import annotations

from dataclasses import dataclass, field

from . import claims as C

# Fixed values.
EVENT_TYPES = {
    "LIVE_INCIDENT": ["انفجار", "انفجاری", "آتش‌سوزی", "explosion"],
    "MILITARY_STRIKE": ["حمله موشکی", "حمله پهپادی", "حمله هوایی", "موشک", "پهپاد", "strike", "missile", "drone"],
    "INTERNET_OUTAGE": ["قطعی اینترنت", "اختلال اینترنت", "فیلترینگ", "اینترنت", "internet outage", "اختلال"],
    "MARKET_MOVE": ["دلار", "ارز", "طلا", "سکه", "بورس", "شاخص", "dollar", "currency"],
    "INTERVIEW": ["مصاحبه", "مجله", "interview"],
    "PRESS_CONFERENCE": ["نشست خبری", "کنفرانس خبری", "press conference"],
    "SPEECH": ["نطق", "سخنرانی", "speech"],
    "POLITICAL_ANNOUNCEMENT": ["اعلام کرد", "اعلام می‌کند", "دستور داد", "اعلامیه", "تحریم‌های جدید", "announcement"],
}
SECOND_OCCURRENCE = "(حمله دوم|حمله دیگری|حادثه‌ای دیگر|دور جدید|حمله جداگانه|حمله مجدد|another (strike|attack|wave)|second (strike|attack))"
EVENT_STOP = ["از", "به", "با", "در", "که", "و", "این", "برای", "است", "را", "های", "the", "a", "an", "of", "to", "in", "on", "and", "is", "are"]
LOCATIONS = ["بغداد", "تهران", "اسرائیل", "عراق", "سوریه", "لبنان", "یمن", "شیراز", "اصفهان", "کرمانشاه", "american", "iran", "iraq", "israel", "tehran", "baghdad", "shiraz"]
FA_WORDS = "را از در با برای این آن یک است شد شدند کرد کردند گفت گفتند می نمی خواهد دارد دارند امروز افزایش کاهش یافت رسید داد اعلام".split()
AR_WORDS = "في من على عن أن إن إلى الى التي الذي هذا هذه مع قد لا ما لم لن كان كانت يكون قال قالت أعلن أعلنت اليوم عاجل بعد بين عبر نحو أكثر حتى حيث حول".split()
TOPICS = {
    "WAR_MILITARY": (100, ["جنگ", "حمله موشکی", "پهپاد", "نظامی", "بمبار", "تحریم نظامی", "missile", "strike", "military", "war", "حرب", "عسكري", "عسکری", "الجیش", "الجيش", "قوات", "هجوم", "غارة", "غارات", "قصف", "صاروخ", "صواريخ", "صواریخ", "مسيرة", "مسيرات", "طائرة مسيرة", "طائرات", "دفاع جوي", "دفاع هوایی", "انفجار", "اشتباكات", "اشتباکات", "جبهة", "قاعدة عسكرية", "تحرك عسكري", "انتشار", "استهداف", "اغتیال", "کشته", "قتل"]),
    "INTERNET": (95, ["اینترنت", "فیلترینگ", "قطعی اینترنت", "اتصال", "پهنای باند", "internet", "shutdown", "filternet", "انترنت", "قطع الانترنت", "حجب", "اتصالات", "شبكة", "شبكات", "تعطيل"]),
    "CURRENCY": (92, ["دلار", "ارز", "تومان", "طلا", "سکه", "بورس", "دولار", "صرف", "عملة", "عملات", "ذهب", "سعر الصرف", "dollar", "currency", "gold", "fx"]),
    "DIPLOMACY": (88, ["دیپلماس", "مذاکره", "وزیر خارجه", "سفیر", "diplomat", "talks", "مفاوضات", "خارجية"]),
    "IRAN_IRAQ": (88, ["ایران", "تهران", "مجلس", "رئیس‌جمهور", "عراق", "بغداد", "ایربیل", "اربیل", "بصره", "iraq", "baghdad", "کرمانشاه"]),
    "ECONOMY": (75, ["اقتصاد", "نفتی", "بازار", "تورم", "economy", "oil", "نفط"]),
    "TECH": (60, ["فناوری", "هوش مصنوعی", "تراشه", "ai", "chip", "tech"]),
    "SPORT": (15, ["فوتبال", "football", "soccer", "كرة القدم", "کرة القدم", "باشگاه", "لیگ", "مباراة", "مسابقه", "olympic", "المپیک", "المپیاد", "دویدن", "goal", "وردی"]),
    "ENTERTAINMENT": (15, ["سلبریتی", "بازیگر", "سینما", "موسیقی", "کنسرت", "تفریحی", "celebrity", "فیلم", "سریال", "شو", "استیج"]),
}
HIGH_RISK = [
    r"(?:\d+\s*)?(?:کشته|قتل|جان ?باخت|تلفات|مجروح|زخمی)",
    r"(?:قتلع|إصابات|خسائر بشرية|حصيلة)",
    r"(?:killed|casualt\w+|injur\w+|dead|wounded)",
    r"(?:حمله نظامی|حمله موشکی|پیشمرگ|بمباران|تهاجم)",
    r"(?:بازداشت|دستگیر)",
    r"(?:اعلام مسئولیت|مسئولیت حمله)",
    r"(?:اعلام جنگ|جنگ اعلام)",
    r"(?:تصمیم رسمی|فرمان رسمی|تحریم جدید)",
]
PROMO_CALLS = ["عضو شوید", "ثبت نام کنید", "ثبت‌نام کنید", "امتیاز کسب کنید", "جوایز دریافت", "جایزه دریافت", "کلیک کنید", "وارد سایت شوید", "کانال تلگرام:", "آدرس سایت:", "شرط بندی کنید", "شرط‌بندی کنید"]
PROMO_OFFERS = ["کازینو", "شرط بندی", "شرط‌بندی", "آپشن بری بت", "آپسینه بری بت", "جعبه جایزه", "گنجینه", "جوایز", "جایزه", "بونوس", "پاداش"]
MATERIAL = ["تحریم", "جنگ", "آتش‌بس", "حمله", "موشک", "پهپاد", "ایران", "اسرائیل", "آمریکا", "هسته‌ای", "غنی‌سازی", "توافق", "قرارداد سرنوشتساز", "نظامی", "امنیتی", "ترور", "تروریست", "کشته", "زخمی", "تلفات", "اخراج", "استعفا", "انتخابات", "سرکوب", "اعتراض", "تحول", "دلار", "تومان", "نفت", "گاز", "صادرات", "واردات", "تحریم‌ها", "دیپلماسی", "مذاکره", "گفت‌وگو", "بن‌بست", "قطع رابطه", "حمله نظامی", "بازداشت", "دستگیر", "محاکمه", "اعدام", "جواز", "لغو", "توقف", "جزایر", "خلیج فارس", "هرمز", "تحریم جدید"]
CEREMONY = ["استقبال کرد", "استقبال نمود", "استقبال به عمل آورد", "اعتبارنامه خود را تقدیم", "تقدیم اعتبارنامه", "پیام تبریک", "تبریک به مناسبت", "پیام تسلیت رسمی متن", "مراسم یادبود", "جلسه تشریفاتی", "دیدار تودیع", "سفیر جدید", "جشن روز ملی", "روز ملی", "مناسبت روز ملی"]
TRIVIA = ["پرنده", "حیوانات", "فیل‌ها", "خرگوش", "گربه", "سگ‌ها", "موجود عجیب", "دایناسور", "نهنگ", "دلفین", "شگفت", "عجیب‌ترین", "باورنکردنی", "جالب‌ترین", "دانستنی‌ها", "آیا می‌دانستید", "سلبریتی", "ستاره اینستاگرام", "وایرال", "ویدیوی واکنش", "داماد", "عروس", "آخرین فیلم", "پوستر فیلم", "تیزر فیلم", "فصل جدید سریال", "استایل جدید"]
HOME = ["ایران", "تهران", "ایرانی", "Iran", "Tehran"]
REGION = ["اسرائیل", "فلسطین", "غزه", "لبنان", "سوریه", "عراق", "یمن", "حوثی", "خلیج فارس", "هرمز", "عربستان", "امارات", "قطر", "بحرین", "کویت", "عمان", "اردن", "مصر", "ناتو", "بغداد", "بیروت", "دمشق", "صنعا", "تل‌آویو", "الریاض", "جنگ منطقه", "شورای همکاری"]
LIVEBLOG = [r"welcome\s+to\s+(?:our\s+)?live\s+(?:page|coverage)", r"(?:live\s+coverage|live\s+page)\s+(?:has\s+)?(?:ended|closed)"]
EMPTY_LABELS = ["عاجل", "فوری", "breaking", "خبر فوری", "مهم", "هشدار", "ویژه"]
CONNECTIVES = ["در همین حال", "در ادامه", "همچنین", "جزئیات بیشتر", "و تأکید کرد", "افزود:", "گفت:", "خبر فوری", "عاجل", "BREAKING", "فوری:"]
TIME_MARKERS = ["امروز", "دیروز", "امشب", "صبح امروز", "چند ساعت", "ساعات آینده"]


@dataclass(frozen=True)
class Lexicon:
    """All lists that rules over text need; words are matched as parts of the normal form."""

    negation: list[str] = field(default_factory=lambda: C.NEGATION)
    reported: list[str] = field(default_factory=lambda: C.REPORTED)
    attributed: list[str] = field(default_factory=lambda: C.ATTRIBUTED)
    classes: dict[str, list[str]] = field(default_factory=lambda: C.CLASSES)
    event_types: dict[str, list[str]] = field(default_factory=lambda: EVENT_TYPES)
    second_occurrence: str = SECOND_OCCURRENCE
    event_stop: list[str] = field(default_factory=lambda: EVENT_STOP)
    locations: list[str] = field(default_factory=lambda: LOCATIONS)
    home_words: list[str] = field(default_factory=lambda: FA_WORDS)
    near_words: list[str] = field(default_factory=lambda: AR_WORDS)
    topics: dict[str, tuple[int, list[str]]] = field(default_factory=lambda: TOPICS)
    low_topics: tuple[str, ...] = ("SPORT", "ENTERTAINMENT")
    high_risk: list[str] = field(default_factory=lambda: HIGH_RISK)
    promo_calls: list[str] = field(default_factory=lambda: PROMO_CALLS)
    promo_offers: list[str] = field(default_factory=lambda: PROMO_OFFERS)
    material: list[str] = field(default_factory=lambda: MATERIAL)
    ceremony: list[str] = field(default_factory=lambda: CEREMONY)
    trivia: list[str] = field(default_factory=lambda: TRIVIA)
    home: list[str] = field(default_factory=lambda: HOME)
    region: list[str] = field(default_factory=lambda: REGION)
    liveblog: list[str] = field(default_factory=lambda: LIVEBLOG)
    time_markers: list[str] = field(default_factory=lambda: TIME_MARKERS)


PERSIAN = Lexicon()
#: For invented prose in four European languages: words of it that occur in some texts and not in others.
EUROPEAN = Lexicon(
    negation=["nicht", " pas ", " not ", " no "],
    reported=["según", "selon", "sich"],
    attributed=["dass", " que ", " that "],
    classes={"ATTACK": ["thth"], "CASUALTY": ["hehely"], "INTERNET": ["ononst"], "MARKET": ["inoran"], "QUOTE": ["thatin", "rewh"]},
    event_types={"LIVE_INCIDENT": ["thwh"], "MILITARY_STRIKE": ["erwh"], "INTERNET_OUTAGE": ["hehely"], "MARKET_MOVE": ["ononst"], "INTERVIEW": ["inoran"], "PRESS_CONFERENCE": ["enque"], "SPEECH": ["vipa"], "POLITICAL_ANNOUNCEMENT": ["lich"]},
    second_occurrence="(thing the|in the|de la|von der)",
    event_stop=EVENT_STOP,
    locations=["thble", "onan", "eauch", "ungen"],
    home_words="the of and to in is that it for was with as by this are from".split(),
    near_words="der die und den von das mit sich auf dem nicht ein".split(),
    topics={"WAR_MILITARY": (100, ["thwh"]), "INTERNET": (95, ["hehely"]), "CURRENCY": (92, ["ononst"]), "DIPLOMACY": (88, ["inoran"]), "IRAN_IRAQ": (88, ["enque"]), "ECONOMY": (75, ["lich"]), "TECH": (60, ["ción"]), "SPORT": (15, ["eaux"]), "ENTERTAINMENT": (15, ["los "])},
    high_risk=[r"\d+ ?%", "killed|dead", "thnd"],
    promo_calls=["for the", "de la", "der "],
    promo_offers=["thre", "ier", "unger"],
    material=["thha", "onan"],
    ceremony=["thing", "ment", "keit"],
    trivia=["thly", "eau", "schl"],
    home=["that", "que"],
    region=["the ", "los ", "der "],
    liveblog=[r"in (?:the|der) ", "est(?:a|e) "],
    time_markers=["this", "heute", "dans", "por"],
)
