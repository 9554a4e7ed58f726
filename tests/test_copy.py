"""Public copy: boilerplate, headlines that their leads repeat, and whether anything is said."""

import re

from pyspark.sql import functions as F

from sievework.functions import copy as P

LONG = "وزارت خارجه ایران اعلام کرد مذاکرات در تهران ادامه دارد"
MORE = "هیئت‌ها فردا نیز دیدار می‌کنند."


def one(spark, make, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", make(F.col("t")).alias("x")).orderBy("k").collect()
    return [r.x for r in rows]


def plain_squash(text):
    blocks = re.split(r"\n\s*\n", (text or "").strip())
    m = re.search(r"\*\*(.+?)\*\*", blocks[0], re.S)
    if len(blocks) < 2 or not m:
        return text or ""
    head, lead = m[1].strip(), blocks[1].strip()
    stem = re.sub(r"(?:…|\.\.\.)$", "", head).rstrip(". ")
    if len(stem) < 30 or not lead.startswith(stem):
        return text
    if head.endswith(("…", "...")):
        end = next((i for i in range(len(stem) - 1, len(lead)) if lead[i] in "؛.!؟?"), None)
        new, rest = (lead, "") if end is None else (lead[: end + 1].strip(), lead[end + 1 :].strip())
    else:
        new, rest = head, (lead[len(head) :] if lead.startswith(head) else lead[len(stem) :]).lstrip(" \t\n،,:؛-–—").strip()
    return "\n\n".join([blocks[0][: m.start(1)] + new + blocks[0][m.end(1) :], *([rest] if rest else []), *blocks[2:]])


def test_leads_that_repeat_their_headline(spark):
    texts = [
        f"🟢 **{LONG[:40]}…**\n\n{LONG}. {MORE}", f"**{LONG[:40]}...**\n\n{LONG}", f"**{LONG}**\n\n{LONG}، {MORE}\n\nمنبع: x", f"**{LONG}.**\n\n{LONG} و {MORE}", f"**{LONG}**\n\n{LONG}", f"**{LONG}**\n\nخبر دیگری", f"**کوتاه…**\n\nکوتاه است و ادامه دارد. {MORE}", f"{LONG}\n\n{LONG}", f"**{LONG}**", "", None, f"a **{LONG} ** b\n \n{LONG}: {MORE}\n\nx\n\ny",
        f"**{LONG}…**\n\n{LONG}؟ {MORE}", f"**{LONG[:-1]}!…**\n\n{LONG[:-1]}! {MORE}",
    ]
    got = one(spark, P.squashed_lead, texts)
    assert got == [plain_squash(t) for t in texts]
    assert got[0] == f"🟢 **{LONG}.**\n\n{MORE}" and got[2] == f"**{LONG}**\n\n{MORE}\n\nمنبع: x"


def test_boilerplate(spark):
    texts = [f"{LONG}\nبیشتر بخوانید:\n{MORE}", f"بررسی منابع نشان می‌دهد\n{LONG}\n\n\n\n{MORE}", "بررسی منابع نشان می‌دهد " + "که این خبر درست است " * 8, "Read more", "a\n  ادامه مطلب – \nb", None, "او گفت بیشتر بخوانید"]
    assert one(spark, P.without_boilerplate, texts) == [f"{LONG}\n{MORE}", f"{LONG}\n\n{MORE}", texts[2].strip(), "", "a\nb", "", texts[6]]


def test_what_is_left_must_state_something(spark):
    cases = {
        LONG + ".": True, f"🟢 **{LONG}**\n\nمنبع: ایرنا\n\n— نام؟ | شعار\n🆔 @handle": True, "منبع: ایرنا\n🆔 @handle": False, "": False, None: False, "ترامپ:": False, f"**{LONG}…**": False, "🟠 بررسی این موضوع در منابع در دسترس ادامه دارد": False,
        "⚠️ این خبر به‌دلیل اشکال در ترجمه موقتاً در حال بازبینی است.": False, "Only English words stand here today": False, "سه واژه کوتاه": False, f"بیشتر بخوانید:\n{LONG}.": True, f"{LONG} را": False,
    }
    got = one(spark, P.substantive, list(cases))
    assert dict(zip(cases, got, strict=True)) == cases
