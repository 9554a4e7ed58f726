"""Normal forms of texts against unicodedata, and slugs."""

import hashlib
import random
import re
import time
import tracemalloc
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from sievework.functions import gates as G
from sievework.functions import rules as R
from sievework.functions import text as T

PAIRS = [("ｆｕｌｌ ｗｉｄｔｈ １２", "full width 12"), ("ﻻ ﻣﺮﺣﺒﺎ", "لا مرحبا"), ("ﬁne ② ½", "fine 2 1⁄2"), ("été", "été"), ("a b c", "a b c"), ("علي‌ كتاب", "علی کتاب"), ("مُحَمَّد", "محمد"), ("Tag <b>x</b>", "tag x"), ("x…y", "x...y")]


def plain(t):
    t = unicodedata.normalize("NFKC", t or "").replace("ي", "ی").replace("ك", "ک")
    t = re.sub("[ً-ٰٟ]", "", t)
    t = re.sub("[​-‏‪-‮⁦-⁩﻿]", "", t)
    return re.sub(r"\s+", " ", re.sub("<[^>]+>", " ", t)).strip().lower()


def test_hashes_of_equal_forms_are_equal(spark):
    texts = [x for p in PAIRS for x in p] + [None, "", "plain", "Ünïcode ÀÉ", "ß «x»", "‏mark‎", "日本 ㈱"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.normalized_for_hash(F.col("t")).alias("n"), T.content_hash(F.col("t")).alias("h"), T.normalized_title(F.col("t")).alias("title")).orderBy("k").collect()
    assert [r.n for r in rows] == [plain(t) for t in texts]
    assert [r.h for r in rows] == [hashlib.sha256(plain(t).encode()).hexdigest() for t in texts]
    for k in range(0, 2 * len(PAIRS), 2):
        assert rows[k].h == rows[k + 1].h, texts[k]


def test_settled_characters_stay_beside_any_other():
    settled = [c for c in map(chr, range(0x3000)) if re.match(f"[{T.SETTLED}]", c)]
    assert len(settled) > 250 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in settled)
    for c in settled:
        row = "".join(c + d for d in settled)
        assert unicodedata.normalize("NFKC", row) == row


def test_slugs(spark):
    cases = {"***": "story", "": "story", None: "story", "  Hello, World!  ": "Hello-World", "a" * 59 + " b": "a" * 59, "خبر فوری: تهران": "خبر-فوری-تهران", "under_score 9": "under_score-9", "-x-": "x"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.slug(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases


def test_digits_at_the_ends_of_lines_stay_in_language_content(spark):
    """the n-th line's place, n, was trimmed off its ends."""
    text = "00 is first 0\n 1 second 11 \n2\n— footer\n4 @handle 4"
    assert spark.createDataFrame([(text,)], "t string").select(R.language_content(F.col("t")).alias("c")).first().c == "00 is first 0\n1 second 11\n2\n4   4"


def test_digits_at_the_ends_of_headlines_stay(spark):
    """the n-th line's place, n, was trimmed off its ends."""
    cases = ["0 killed and many hurt in 2020", "short\n1 more headline of the year 1991", "0\n 1 \n22", " \n12 words of a longer headline 1"]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", R.headline(F.col("t")).alias("h")).orderBy("k").collect()
    assert [r.h for r in rows] == [cases[0], "1 more headline of the year 1991", "22", "12 words of a longer headline 1"]


def test_digits_at_the_ends_of_lines_tell_them_apart(spark):
    """the n-th line's place, n, was trimmed off the ends of the lines that it is held against."""
    cases = ["0", "a\n1\nb\n1", "x 0\nx\n x 0\n\n\nx", "10\n01\n10"]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", R.without_repeated_lines(F.col("t")).alias("l")).orderBy("k").collect()
    assert [r.l for r in rows] == ["0", "a\n1\nb", "x 0\nx\n\n", "10\n01"]
    labels = spark.createDataFrame([("Speaker:\n1 said so 1",)], "t string").select(R.split_speaker(F.col("t")).alias("s")).first().s
    assert labels.body == "1 said so 1"


def test_shingles_of_a_long_text_cost_no_more_than_of_short_ones(spark):
    """each shingle copied the whole list of words before."""
    n = 150_000
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))
    df = spark.range(1).select(F.array_join(words, " ").alias("t"))
    start = time.time()
    assert df.select(F.size(T.shingles(F.col("t"))).alias("n")).first().n == n - 2
    assert time.time() - start < 8


def test_white_space_of_any_script_becomes_one_space(spark):
    """lone spaces stay as they are instead of being built anew."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(" a\t\n\x0b\x1c\x1f\x85\xa0\u2003\u2028\u3000b\u064b\u200c") for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for spaces, flags in ((T.SPACES, ""), (r"\s\x1c-\x1f", "(?U)")):
        got = df.select(T.spaced(F.col("t"), spaces, flags).alias("a"), F.regexp_replace("t", f"{flags}[{spaces}]+", " ").alias("b")).collect()
        assert all(r.a == r.b for r in got)
    assert {r.a for r in df.select(T.translated(F.lit("1x۲٣"), *T.DIGITS).alias("a")).limit(1).collect()} == {"1x23"}


def test_simhash_bits_are_counted_in_small_pieces():
    """F16: the bits of a quarter of a million hashes were widened to eight bytes each at once."""
    rng = np.random.default_rng(3)
    sizes = [0, 3, 40_000, 1, 0, 17_000, 500]
    flat, offsets = rng.integers(-(1 << 63), 1 << 63, sum(sizes), dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)])
    tracemalloc.start()
    got = T.majority(flat, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for k, n in enumerate(sizes):
        own = flat[offsets[k] : offsets[k + 1]].view(np.uint64)
        want = sum(1 << i for i in range(64) if 2 * int(((own >> np.uint64(i)) & np.uint64(1)).sum()) > n)
        assert int(got[k]) & ((1 << 64) - 1) == want
    assert peak < 20 << 20


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_home_language_cuts_a_text_into_sentences_at_most_twice(spark):
    """once for the forms that Python makes, once after them; before, for each use of the sentences."""
    df = spark.createDataFrame([("x",)], "t string").select(R.is_home_language(F.col("t")).alias("h"))
    assert plan(df).count("؟]+") <= 2


def test_the_gate_cuts_copy_into_lines_once(spark):
    """each rule cut and cleaned the copy anew."""
    df = spark.createDataFrame([("x", "y")], "h string, b string").select(G.publication_gate(F.col("h"), F.col("b"), F.lit(5)).alias("g"))
    assert plan(df).count("split(") == 1


def test_stripped_is_what_its_pattern_leaves(spark):
    """lines without white space at their ends aren't searched."""
    rng = random.Random(6)
    df = spark.createDataFrame([("".join(rng.choice(" a\t\xa0\u2003b\x1c") for _ in range(rng.randint(0, 6))),) for _ in range(300)] + [("",), (None,)], "t string")
    assert all(r.a == r.b for r in df.select(T.stripped(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("b")).collect())


def test_prints_of_items_take_one_normal_form_a_text(spark):
    """the text's hash, its shingles and the title's test for emptiness each made the form anew."""
    from sievework.operators import dedup

    df = spark.createDataFrame([(1, "http://a", "b", "c")], "i long, u string, h string, t string")
    assert plan(dedup.fingerprints(df, "i", "u", "h", "t")).count("<[^>]+>") == 2
