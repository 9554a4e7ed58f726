"""Each corpus operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sievework.llm import ann, html_text, merkle, mixing, ngram_join, packing, quality, substring_dedup, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block long, node long, piece int"


def texts():
    rng = random.Random(4)
    vocabulary = ["w%d" % k for k in range(300)] + ["é", "ß", "日本"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(70), say(120)
    near = base.split()
    near[50] = "changed"
    out = [None, "", "   \n", "one", "two words", say(9000), base, base, " ".join(near), say(40) + " " + passage, passage + "\n" + say(30), say(10) + " " + passage + " " + say(5), "be " * 400, say(200), "A B C D E", "a b c d e"]
    return list(enumerate(out)) + [(3, "one"), (13, "other text of the same id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i % 4 == 0 else "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 1, 2, 3, 4) for i, t in texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for i, x in texts():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    rows = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0


def test_packing_with_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "same words " * 5)] * 3000, "doc_id long, text string")
    pieces = packing.token_pieces(df, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.ids[-1] == 0 for r in pieces)
    packed = packing.packed(packing.token_pieces(df.repartition(8)), partition_pieces=800)
    shares = Counter(r.sequence_id >> 32 for r in packed.collect())
    assert len(shares) == 4 and max(shares.values()) < 1500


def test_best_fit_closes_the_fullest():
    bins, offsets = packing.best_fit([6, 5, 4, 3], 10, 2)
    assert bins == [0, 1, 0, 1] and offsets == [0, 0, 6, 5]
    assert packing.best_fit([9, 8, 7, 1], 10, 2)[0] == [0, 1, 2, 1]


def test_word_windows(docs, empty):
    data = [(i, WORD.findall(t or "")) for i, t in texts()]
    least: dict = {}
    for i, w in data:
        for k in range(len(w) - 49):
            least[tuple(w[k : k + 50])] = min(i, least.get(tuple(w[k : k + 50]), i))
    want = []
    for i, w in data:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_word_windows(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 0
    assert substring_dedup.repeated_word_windows(empty).count() == 0


@pytest.mark.parametrize("split", [1, 20_000])
def test_byte_strings(docs, empty, split):
    data = [(i, (t or "").encode()) for i, t in texts()]
    count = Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    want = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_byte_strings(docs, split=split).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert suffix_dedup.repeated_byte_strings(empty).count() == 0


def test_suffix_array_and_prefixes():
    buf = np.frombuffer(b"banana" * 30 + b"bandana", np.uint8)
    ends = np.full(len(buf), len(buf))
    order, rank = suffix_dedup.suffix_array(buf, ends, len(buf))
    raw = buf.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
    lcp = suffix_dedup.common_prefixes(buf, ends, order, rank, 1000, lane=16)
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        assert lcp[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_repeated_windows_of_texts_that_part_late():
    wrong = found = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        say = lambda n: rng.integers(97, 101, n, np.uint8).tobytes()  # noqa: E731, B023
        data = [say(rng.integers(0, 30)) + shared + say(rng.integers(1, 60)) for _ in range(10) for shared in [say(rng.integers(224, 301))] for _ in range(2)]
        lens = np.array([len(t) for t in data])
        ends = np.repeat(np.cumsum(lens), lens)
        buf = np.frombuffer(b"".join(data), np.uint8)
        order, same = suffix_dedup.repeated_windows(buf, ends, 200)
        got = set(order[same].tolist()) | set(order[np.flatnonzero(same) - 1].tolist())
        windows = {k: buf[k : k + 200].tobytes() for k in range(len(buf)) if k + 200 <= ends[k]}
        count = Counter(windows.values())
        want = {k for k, w in windows.items() if count[w] > 1}
        wrong += len(got ^ want)
        found += len(want)
    assert wrong == 0 and found > 0


def test_ngram_join(docs, empty):
    sets: dict = {}
    root = {i: i for i, _ in texts()}
    rows = []
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in texts():
        w = WORD.findall((t or "").translate(low))
        s = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
        rows.append((i, s))
    for i, a in rows:
        for j, b in rows:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    del sets
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked_components(docs).collect()]
    assert sorted(got) == sorted((i, len(s), find(i)) for i, s in rows)
    assert ngram_join.linked_components(empty).count() == 0


def test_components_agree(spark):
    from sievework.llm.components import components

    rng = random.Random(1)
    edges = spark.createDataFrame([(rng.randrange(200), rng.randrange(200)) for _ in range(150)], "u long, v long")
    assert sorted(map(tuple, components(edges).collect())) == sorted(map(tuple, components(edges, few=0).collect()))


def test_merkle(docs, empty):
    rows = merkle.compared(docs).collect()
    data = sorted(((i, t or "") for i, t in texts()), key=lambda p: (-p[0], p[1]))
    want = Counter()
    for k, (i, t) in enumerate(data):
        after = data[(k + 1) % len(data)][1]
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = {r.doc_id: r.fingerprint for r in rows}
    assert same[6] == same[7] and same[14] != same[15]
    assert merkle.compared(empty).count() == 0


def test_merkle_of_wide_and_uneven_ids(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(merkle, "STRETCH", 16)
    ids = [-(1 << 63), *range(200), 1 << 50, (1 << 63) - 1]
    df = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in merkle.compared(df).collect()}
    for k, i in enumerate(ids):
        t, after = f"text of {i}", f"text of {ids[k - 1]}"
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    rows, _ = merkle.in_order(df)
    assert rows.where("guard = 0").groupBy("stretch").count().agg(F.max("count")).first()[0] < 60


def test_merkle_sections_and_edits(spark):
    from pyspark.sql import functions as F

    ends = [t for t in (f"line {k}" for k in range(400)) if hashlib.sha256(t.encode()).hexdigest()[0] in "01"]
    lines = ["first", ends[0], ends[1], "last"]
    a, b = "\n".join(lines), "\n".join([*lines[:3], "other"])
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    row = row.select("a", merkle.differing(F.col("a"), F.col("b")).alias("s"), merkle.differing(F.col("a"), F.col("b"), True).alias("p"), merkle.likeness(F.col("a"), F.col("b")).alias("like")).first()
    ended = [len(re.split(r"[,]", part)) for part in row.a.split(":")[1].split("|")]
    want, run = [], 0
    for t in lines:
        run += 1
        if hashlib.sha256(t.encode()).hexdigest()[0] in "01":
            want.append(run)
            run = 0
    assert ended == want + [run] * (run > 0)
    assert row.s == [len(ended) - 1] and row.p == [3] and row.like == pytest.approx(0.75)


def plain_targets(sizes, weights, most):
    """Shares of all sizes by weight, none over most times its own."""
    out, left = [0.0] * len(sizes), float(sum(sizes))
    free = [k for k, v in enumerate(sizes) if v > 0]
    while free:
        share = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / share > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / share
            break
        for k in over:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in over)
        free = [k for k in free if k not in set(over)]
    return out


def mix_case(rows):
    """Totals, targets and what is taken of each source, of (doc_id, source, size, source_size, target, taken)."""
    sizes, got = Counter(), Counter()
    for _, source, size, _, _, taken in rows:
        sizes[source] += size
        got[source] += taken
    names = sorted(sizes, key=lambda v: (v is None, (v or "").encode()))
    want = dict(zip(names, plain_targets([sizes[n] for n in names], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))], 3), strict=True))
    largest = Counter()
    for _, source, size, total, target, taken in rows:
        assert total == sizes[source] and target == pytest.approx(want[source])
        assert taken % max(size, 1) == 0 and taken <= 3 * size
        largest[source] = max(largest[source], size)
    for n in names:
        assert abs(got[n] - want[n]) <= max(1, largest[n]), (n, got[n], want[n])


def test_mixing(docs, empty, spark):
    quotas = np.array([7, 0, 11])
    assert (mixing.split_quotas(quotas, 5, 1).sum(0) == quotas).all()
    sources = {(i, len(WORD.findall(t or ""))): f"s{i % 3}" if i % 5 else None for i, t in texts()}
    rows = mixing.taken(docs).collect()
    mix_case([(r.doc_id, sources[r.doc_id, r["size"]], r["size"], r.source_size, r.target, r.taken) for r in rows])
    assert len(rows) == docs.count() and mixing.mixed(docs).count() == sum(r.copies for r in rows)
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0
    again = mixing.taken(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixing_of_many_sources_and_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "OWN", 20)
    monkeypatch.setattr(mixing, "RANKED", 700)
    monkeypatch.setattr(mixing, "FEW", 12)
    rows = [(k, "a b c " * (1 + k % 4), f"h{k % 2500}") for k in range(5000)] + [(None, "ten words are here so that all are of one", "zero")] * 50 + [(7, "same id and other text", "one")] * 40 + [(-k, "big " * 30, None) for k in range(1, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sources = {}
    for i, t, name in rows:
        sources[i, len(t.split())] = name
    for few in (100_000, 10):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
        got = mixing.taken(df).collect()
        assert len(got) == len(rows)
        mix_case([(r.doc_id, sources[r.doc_id, r["size"]], r["size"], r.source_size, r.target, r.taken) for r in got])
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.mixed(df, shards=7).collect()) == +copies


def test_taken_counts_what_is_drawn(docs, monkeypatch):
    plan = mixing.mix_plan(docs)
    assert sum(r.copies for r in mixing.taken(docs).collect()) > 0
    monkeypatch.setattr(mixing, "mix_plan", lambda *a, **k: plan._replace(places=plan.places.where("false")))
    assert sum(r.copies for r in mixing.taken(docs).collect()) == 0


def test_html_open_heads_and_embedded_text():
    said = lambda p: [b.text for b in html_text.blocks_of(p)]
    assert said("<html><head><title>t</title><meta a=b><body><p>one</p></body></html>") == ["one"]
    assert said("<html><head><script>x</script><p>one<p>two</html>") == ["one", "two"]
    assert said("<head><title>t</title>\nbare text") == ["bare text"]
    assert said("<article><svg><text>in</text><p>after</p><select><option>o<p>last</article>") == ["in", "after", "o", "last"]
    assert said("<article>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is<object>old</object></article>") == ["so", "x=1", "is", "old"]


def test_html(spark):
    p = "<html><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>one\n two<script>var x='</p>'</script></p></article><footer>end</footer></html>"
    assert [b.text for b in html_text.blocks_of(p)] == ["menu", "A & B", "one two", "end"]
    df = spark.createDataFrame([(k, "u", p) for k in range(60)] + [(90, None, None), (91, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(df).collect()}
    assert got[5] == ("A & B\none two", 13) and got[90] == ("", 0) and got[91] == ("", 0)


def test_html_without_labels_and_with_clashes(spark):
    df = spark.createDataFrame([(1, "u", "<div>a page of plain blocks and nothing else that says what it is</div>", 1, "x")], "page_id long, url string, html string, i int, h string")
    assert html_text.extracted(df).collect() == html_text.extracted(df).collect()
    labelled = "<html><body><nav><a>home</a></nav><article><h1>w1 w2</h1><p>w3 w4 w5 w6</p></article><footer><p>end</p></footer></body></html>"
    one = spark.createDataFrame([(1, "u", labelled)], "page_id long, url string, html string")
    assert html_text.extracted(one).first().text == "w1 w2\nw3 w4 w5 w6"
    assert html_text.extracted(one.where("false")).count() == 0
    long_ = "<article>" + "".join(f"<p>word{k} of a long page</p>" for k in range(900)) + "</article>"
    assert html_text.extracted(spark.createDataFrame([(k, "u", long_) for k in range(25)], "page_id long, url string, html string")).first().n_chars == len("\n".join(f"word{k} of a long page" for k in range(900)))


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 8))
    x[100:140] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=256).collect()
    hits = total = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        best = [k for k in np.lexsort((np.arange(600), -np.round(s, 12))) if k != q][:20]
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        hits += len({v for _, v in mine} & set(best))
        total += 20
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(range(0, 600, 20))


def test_neighbours_with_one_outlier(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[7] *= 1e6
    x[20] *= 1e5
    got = ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        best = [k for k in np.argsort(-s) if k != q][:20]
        hits += len({r.vec_id for r in got if r.query_id == q} & set(best))
    assert hits / 600 >= 0.9


def test_toxicity_reads_long_words_whole(spark):
    rng = random.Random(2)
    calm, nasty = "天地人山水火木金土日月星", "毒恶骂打杀坏"
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    rows = [(k, say(calm, 60) + (say(nasty, 20) if k % 4 == 0 else say(calm, 20)) + say(calm, 20)) for k in range(300)]
    labelled = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), labelled).collect()}
    held = [k for k, _ in rows if got[k].held_out]
    assert sum(got[k].predicted == int(k % 4 == 0) for k in held) >= 0.9 * len(held)
    first, last, of = toxicity.stretches(np.array([0, 50]), np.array([40, 150]), np.array([0, 1]))
    assert first.tolist() == [0, 50, 82, 114] and last.tolist() == [40, 90, 122, 150] and of.tolist() == [0, 1, 1, 1]


def test_classifiers_with_clashing_columns(spark):
    rows = [(k, ("calm words number%d " % k) * 6 + ("nasty###" if k % 4 == 0 else ""), 1, 2, 3) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, _id int, l int")
    labelled = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 4 == 0), 1) for k in range(60)], "doc_id long, quality int, toxic int, y int")
    for module in (quality, toxicity):
        assert module.scored(df, labelled).count() == 60
    assert set(toxicity.clean(df, labelled).columns) == set(df.columns)


def test_classifiers(spark, docs, empty):
    rows = [(k, ("plain calm words number%d here " % k) * 6 + ("nasty###" if k % 4 == 0 else "")) for k in range(240)]
    labelled = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 4 == 0)) for k, _ in rows], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows + [(500, None), (501, "")], "doc_id long, text string")
    for module, right in ((quality, lambda k: int(k % 4 != 0)), (toxicity, lambda k: int(k % 4 == 0))):
        got = {r.doc_id: r for r in module.scored(df, labelled).collect()}
        held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
        assert all(got[k].held_out for k in held) and 0 <= got[500].score <= 1
        assert sum(got[k].predicted == right(k) for k in held) >= 0.9 * len(held)
        none = labelled.where("doc_id < 0")
        assert module.scored(empty, none).count() == 0 and module.scored(docs, none).count() == docs.count()
