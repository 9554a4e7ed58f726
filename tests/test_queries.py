"""Queries of the reference's operators against DuckDB, and SimHash against a plain version."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.plans import catalog
from sievework.plans.relational import TABLES

SF = "/root/testdata/sf0.001"


def rows(cursor):
    names = [c[0] for c in cursor.description]
    return names, sorted((tuple(r) for r in cursor.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names, want = rows(c.execute(catalog.ORACLES[name]))
    df = catalog.QUERIES[name](spark, SF)
    assert set(df.columns) == set(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == want


def test_simhash(spark):
    texts = ["one two three four five", "a b", "", "x " * 40 + "y z"]

    def plain(t):
        w = t.split()
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        sums = [0] * 64
        for g in grams:
            h = int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big")
            for i in range(64):
                sums[i] += 1 if h >> i & 1 else -1
        out = sum(1 << i for i in range(64) if sums[i] > 0)
        return out - (1 << 64) if out >> 63 else out

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df = T.with_simhash64(df, T.shingles(T.normalized_for_hash(F.col("t"))), "h")
    assert [r["h"] for r in df.collect()] == [plain(t) for t in texts]


def test_near_documents_give_all_pairs(spark):
    hashed = {r["doc_id"]: r["simhash"] for r in catalog.QUERIES["TXT07_simhash"](spark, SF).collect()}
    items = sorted(hashed.items())
    want = {(a, b) for k, (a, x) in enumerate(items) for b, y in items[k + 1 :] if bin((x ^ y) & (1 << 64) - 1).count("1") <= 6}
    rows = catalog.QUERIES[catalog.FLAGSHIP](spark, SF).collect()
    first = {d: d for d in hashed} | {r["doc_b"]: r["doc_a"] for r in rows if r["distance"] == 0}
    members = {}
    for d, c in first.items():
        members.setdefault(c, []).append(d)
    linked = [(r["doc_a"], r["doc_b"]) for r in rows if r["distance"]] + [(c, c) for c in members]
    got = {(min(x, y), max(x, y)) for a, b in linked for x in members[a] for y in members[b] if x != y}
    assert got == want and any(hashed[a] == hashed[b] for a, b in want)


def test_title_hash_and_slug_read_the_whole_text(spark, tmp_path):
    a, b = "same words " * 10 + "one", "same words " * 10 + "two"
    spark.createDataFrame([(1, a), (2, b), (3, "*" * 120 + " tail of it")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["title_hash"] for r in catalog.QUERIES["TXT05_title_hash"](spark, str(tmp_path)).collect()}
    assert got[1] == hashlib.sha256(a.encode()).hexdigest() and got[2] == hashlib.sha256(b.encode()).hexdigest()
    slugs = {r["doc_id"]: r["slug"] for r in catalog.QUERIES["TXT60_slug"](spark, str(tmp_path)).collect()}
    assert slugs[3] == "tail-of-it" and slugs[1] == a.replace(" ", "-")[:60].strip("-")


def test_near_pairs_of_any_size_come_once(spark):
    from sievework.operators import dedup

    assert [dedup.block_count(n) for n in (10, 1 << 24, 1 << 25, 1 << 30, 1 << 50)] == [8, 8, 9, 10, 10]
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = {b: None for b in base}
    for _ in range(900):  # many near ones, many that share a block
        h = rng.choice(base)
        for _ in range(rng.randint(1, 7)):
            h ^= 1 << rng.randrange(64)
        hashes[h] = None
    hashes |= {(0xABCD << 48) | rng.getrandbits(40): None for _ in range(300)}
    rows = list(enumerate(h - (1 << 64) if h >> 63 else h for h in hashes))
    want = sorted((a, b, bin((x ^ y) & (1 << 64) - 1).count("1")) for a, x in rows for b, y in rows if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= 6)
    df = spark.createDataFrame(rows, "doc_id long, simhash long")
    for bucket in (256, 1e-3, 1e-9):  # eight, nine and ten blocks
        assert sorted(map(tuple, dedup.near_pairs(df, bucket=bucket).collect())) == want
    assert dedup.near_pairs(df.where("false")).count() == 0 and len(want) > 1000
