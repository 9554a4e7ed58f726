"""Clustering, archives and resampling against plain versions, on nulls, empties, ties, repeats, long texts and clashing columns."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievework.llm import centroids, importance, warc


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) < 1 << 27]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for j, vs in own.items():
            at[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    each = Counter()
    for _, d, j in found:
        each[j] += d
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def test_clusters(spark):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((6, 64))
    rows = [(k, (middles[k % 6] + 0.3 * rng.standard_normal(64)).tolist()) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(40)] + [(7, rows[9][1]), (7, rows[9][1]), (None, rows[5][1])]  # copies, repeats
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [1.0] * 63 + [float("nan")]), (305, [float("-inf")] + [1.0] * 63), (306, [1e30] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, total long").repartition(3)
    got = sorted(map(tuple, centroids.clustered(df).collect()), key=str)
    assert got == plain_clusters(rows)
    few = df.where("vec_id < 3")
    assert sorted(map(tuple, centroids.clustered(few).collect()), key=str) == plain_clusters(rows[:3])
    assert centroids.clustered(df.where("false")).count() == 0
    assert centroids.clustered(df.where("vec_id = 300")).count() == 0


def test_clusters_that_tie_and_clusters_without_vectors(spark):
    rows = [(k, [0.0] * 64) for k in range(20)] + [(k, [1.0] + [0.0] * 63) for k in range(20, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, centroids.clustered(df).collect()), key=str) == plain_clusters(rows)


def test_screening_prunes_and_keeps_the_nearest():
    rng = np.random.default_rng(1)
    middles = rng.integers(-9000, 9000, (32, 8))
    x = (np.repeat(middles, 8, axis=1)[rng.integers(0, 32, 4000)] + rng.integers(-300, 300, (4000, 64))).astype("<i4")
    c = x[rng.choice(4000, 32, False)].astype(np.int64)
    cluster, distance, exact = centroids.nearest(x, centroids.segment_norms(x), c)
    every = ((x[:, None, :].astype(np.int64) - c) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert exact < 0.5 * every.size


def plain_archive(rows, least=0):
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    raw = [(i, (h or "").encode()) for i, h in rows]
    last = {}
    for i, b in raw:
        last[b] = i if last.get(b) is None else max(last[b], i if i is not None else last[b])
    out, used = [], set()
    for i, b in sorted(raw, key=lambda r: (r[0] is None, r[0] or 0)):
        first = len(b) < least or (i == last[b] and b not in used)
        used |= {b} if first and len(b) >= least else set()
        out.append((i, len(b), digest(b), "response" if first else "revisit", None if first else last[b]))
    return sorted(out, key=str)


PAGES = [(1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y", "<p>one</p>"), (3, None, None), (4, "http://a b.example/\n\t", ""), (5, "", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nHTTP/1.1 200 OK\n\nhttp://x 1.2.3.4 20200101000000 text/html 5\nabc"), (6, "u", "long " * 60_000), (2, "http://a.example/y", "<p>one</p>"), (None, "v", "<p>one</p>"), (None, "w", "no id"), (7, "z", "long " * 60_000)]


@pytest.mark.parametrize("least", [0, 11])
def test_archives(spark, least):
    df = spark.createDataFrame([(*r, "x", 3) for r in PAGES], "page_id long, url string, html string, file string, start int").repartition(3)
    got = warc.archived(df, least, archive_bytes=1000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain_archive([(i, h) for i, _, h in PAGES], least)
    assert warc.archived(df.where("false")).count() == 0


def test_archive_files_are_whole_and_rerun_alike(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_arc(df, f"{tmp_path}/arc", archive_bytes=1 << 20)
    records = warc.read_arc(spark, f"{tmp_path}/arc").orderBy("start").collect()
    assert [r.version for r in records] == [1] * len(records) and records[0].url == "filedesc://pages-000000-000000.arc"
    assert not any(r.damaged or r.truncated for r in records) and len(records) == len(PAGES) + 1
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/again")
    one, two = (sorted((r.type, str(sorted(r.fields.items())), bytes(r.block)) for r in warc.read_warc(spark, f"{tmp_path}/{p}").collect()) for p in ("warc", "again"))
    assert one == two and Counter(t for t, _, _ in one) == {"warcinfo": 1, "response": 5, "revisit": 5}
    (file,) = (tmp_path / "warc").glob("part-*")
    raw = gzip.decompress(file.read_bytes())
    at = 0
    while at < len(raw):  # records follow each other without a byte between
        m = re.compile(rb"WARC/1\.1\r\n(?:[^\r\n]+\r\n)*?Content-Length: (\d+)\r\n(?:[^\r\n]+\r\n)*\r\n").match(raw, at)
        at = m.end() + int(m[1])
        assert raw[at : at + 4] == b"\r\n\r\n"
        at += 4
    heads = [r.fields for r in warc.read_warc(spark, f"{tmp_path}/warc").where("type = 'revisit'").collect()]
    ids = {r.fields["WARC-Record-ID"]: r.fields for r in warc.read_warc(spark, f"{tmp_path}/warc").where("type = 'response'").collect()}
    for f in heads:
        kept = ids[f["WARC-Refers-To"]]
        assert (kept["WARC-Payload-Digest"], kept["WARC-Target-URI"], kept["WARC-Date"]) == (f["WARC-Payload-Digest"], f["WARC-Refers-To-Target-URI"], f["WARC-Refers-To-Date"])


def test_arc_lines_of_both_versions():
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nhttp://no.example/ 1.1.1.1 20200101000000 text/html 3\nx"
    v1 = warc.arc_start(1, "one.arc", "19970101000000") + b"http://a.example/with space.html 10.0.0.1 199701020304 text/html; charset=utf-8 %d\n%s\n" % (len(http), http) + b"dns:a.example 10.0.0.1 19970102030405 text/dns 4\n1.1.\n"
    got = list(warc.arc_records(v1))
    assert [(r.url, r.ip, r.date, r.type, r.length, r.block) for r in got[1:]] == [("http://a.example/with space.html", "10.0.0.1", "199701020304", "text/html; charset=utf-8", len(http), http), ("dns:a.example", "10.0.0.1", "19970102030405", "text/dns", 4, b"1.1.")]
    v2 = warc.arc_start(2, "two.arc") + b"http://b.example/ ::1 20010203040506 text/html 404 ABC http://c.example/ 123 two.arc 5\nhello\n" + b"this is no header line\nnor this\n" + b"http://d.example/ 1.2.3.4 20010203 - 200 - - 9 two.arc 50\ncut short"
    got = list(warc.arc_records(v2))
    assert [r.version for r in got] == [2] * 4 and (got[1].status, got[1].checksum, got[1].location, got[1].block) == ("404", "ABC", "http://c.example/", b"hello")
    assert got[2].damaged and got[2].block == b"this is no header line\nnor this\n"
    assert got[3].truncated and got[3].block == b"cut short" and got[3].checksum is None
    assert [warc.iso_date(d) for d in ("199701020304", "20010203", "20019999000000", "-")] == ["1997-01-02T03:04:00Z", "2001-02-03T00:00:00Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]
    kinds = [re.search(rb"WARC-Type: (\w+)", warc.warc_record("f", r, None))[1] for r in warc.arc_records(v1)]
    assert kinds == [b"warcinfo", b"response", b"resource"]
    assert b"WARC-IP-Address: 10.0.0.1" in warc.warc_record("f", list(warc.arc_records(v1))[1], None) and b"WARC-Truncated" in warc.warc_record("f", got[3], None)
    members = b"".join(gzip.compress(part) for part in (v1[:100], v1[100:]))
    assert warc.plain(members) == v1 and warc.plain(v1) == v1 and v1.startswith(warc.plain(members[:-20])[:100])


FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resampling(docs, target, buckets=10_000, percent=5, least=20):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(t):
        w = FEATURE_WORD.findall((t or "").translate(low))
        return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for side, rows in ((s, [x for _, x in docs]), (t, target)):
        for x in rows:
            side.update(map(bucket, features(x)[1]))
    S, T = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * S / ((s[b] + 1.0) * T))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[bucket(g)] for g in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, n >= least and i is not None])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    out = [(*r[:4], k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return sorted(out + [(*r[:4], None) for r in rows if not r[4]], key=str)


def resampling_docs():
    rng = random.Random(8)
    words = ["Wort%d" % k for k in range(120)] + ["é", "ß", "日本", "x-y", "_", "9"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, say(rng.randint(0, 60))) for k in range(160)]
    docs += [(200, None), (201, ""), (202, " .,;\n"), (203, "one"), (204, "two words"), (205, say(9000)), (206, "A" * 5000), (None, say(30)), (None, say(30)), (3, docs[3][1]), (3, docs[3][1])]
    docs += [(300 + k, f"Hot pair Hot pair {say(3)} Hot pair z{k} Hot pair y{k} " * 3) for k in range(80)]
    return docs, [say(40) for _ in range(5)] + [None, "", "Hot pair once"]


@pytest.mark.parametrize(("block", "shard"), [(1 << 20, 1 << 24), (3000, 2000)])
def test_resampling(spark, block, shard):
    docs, target = resampling_docs()
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, row int, score int, block int").repartition(3)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    from sievework.llm.store import written

    df = written(df, "docs")
    got = importance.resampled(df, goal, percent=20, block_bytes=block, shard_bytes=shard).collect()
    assert sorted(map(tuple, got), key=str) == plain_resampling(docs, target, percent=20)
    assert sum(r["rank"] is not None for r in got) > 20


def test_resampling_of_empty_tables(spark):
    docs, target = resampling_docs()
    docs = docs[:40]
    df, goal = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    assert importance.resampled(df.where("false"), goal).count() == 0
    assert sorted(map(tuple, importance.resampled(df, goal.where("false")).collect()), key=str) == plain_resampling(docs, [])


def test_runs_after_a_common_pair_are_dealt_out():
    say = b" ".join(b"hot pair w%d" % k for k in range(3000))
    block = {"data": say, "lens": np.array([len(say)]), "own": np.array([-1])}
    f = importance._Features(block, 8)
    share = np.diff(np.searchsorted(f.shard3, np.arange(9)))
    assert share.max() < 0.3 * share.sum()
    rows = [{"block": 0, "check": 0, "shard": s, "target": False, "data": f.message(s)} for s in f.shards.tolist()]
    total = sum(np.frombuffer(importance._opened(importance._dictionary([r], 10_000)[-1]["sums"], 1)[0], np.int64).reshape(2, -1)[0].sum() for r in rows)
    assert total == 9000 + 8999 + 8998
