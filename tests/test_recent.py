"""Claims against recent ones, evidence groups and origins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import claims as C
from sievework.operators import claims, origins, recent


def claim_rows(seed, n=160):
    rng = random.Random(seed)
    words = ["حمله", "تهران", "دلار", "مذاکره", "وزیر", "گفت", "نیست", "۱۲", "۱۵", "بازار", "نفت", "توافق", "ایران", "روز", "شهر", "و", "است"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 9))) for _ in range(25)]
    out = []
    for k in range(n):
        t = rng.choice(base)
        if rng.random() < 0.6:
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        out.append((k * 3, k % 40, t))
    return out + [(10_000, 99, ""), (10_001, 98, None), (10_002, 97, "و است")]


def decisions(spark, df):
    """decision and both claims' words of every pair, by the column the operators use."""
    a, b = (df.select(F.col("claim_id").alias(f"id_{x}"), F.col("claim").alias(x)) for x in "ab")
    return {(r.id_a, r.id_b): r for r in a.join(b, F.col("id_b") < F.col("id_a")).select("id_a", "id_b", recent.met(F.col("a"), F.col("b")).alias("via"), C.compare(F.col("a"), F.col("b"))["decision"].alias("d"), (F.col("a.fingerprint") == F.col("b.fingerprint")).alias("same")).collect()}


@pytest.mark.parametrize(("k", "ranges"), [(40, 10_000), (7, 30)])
def test_recent_claims(spark, k, ranges):
    rows = claim_rows(1)
    df = claims.with_claims(spark.createDataFrame(rows, "claim_id long, event_id long, text string"), "text")
    pairs = decisions(spark, df)
    ids, event = [r[0] for r in rows], {r[0]: r[1] for r in rows}
    want = []
    for n, i in enumerate(ids):
        equal = [j for j in ids[:n] if pairs[i, j].same]
        near = [j for j in ids[max(0, n - k) : n] if pairs[i, j].via]
        content = set((rows[n][2] or "").split()) - set(C.LIGHT_WORDS)
        if equal:
            want.append((i, event[equal[-1]], "FINGERPRINT"))
        elif near and content:
            want.append((i, event[near[-1]], pairs[i, near[-1]].via))
        else:
            want.append((i, None, None))
    got = recent.joined_events(df, "claim_id", "event_id", k, ranges).collect()
    assert sorted(map(tuple, got)) == want and {w for _, _, w in want} >= {"FINGERPRINT", "SAME_CLAIM", None}


def test_recent_claims_are_compared_once_a_pair(spark):
    """a filter on the outcome repeated the whole comparison, which itself found the shared words several times over."""
    df = claims.with_claims(spark.createDataFrame(claim_rows(1, 50), "claim_id long, event_id long, text string"), "text")
    plan = recent.joined_events(df, "claim_id", "event_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1


def test_same_claims_across_events(spark):
    rows = claim_rows(2)
    df = claims.with_claims(spark.createDataFrame(rows, "claim_id long, event_id long, text string"), "text")
    kinds = ["INTERVIEW", "MARKET_MOVE", "GENERAL_NEWS"]
    minutes = {"INTERVIEW": 240, "MARKET_MOVE": 30, "GENERAL_NEWS": 90}
    events = {e: (kinds[e % 3], 1_700_000_000 + e * 1500) for e in {r[1] for r in rows}}
    e = spark.createDataFrame([(k, v[0], v[1]) for k, v in events.items()], "event_id long, kind string, s long").select("event_id", "kind", F.timestamp_seconds("s").alias("last_seen"))
    pairs, first = decisions(spark, df), {}
    for i, v, _ in rows:
        first.setdefault(v, []).append(i)
    want = set()
    for a in first:
        for b in first:
            if a < b and abs(events[a][1] - events[b][1]) <= minutes[events[a][0]] * 60:
                for x in first[a][:3]:
                    for y in first[b][:3]:
                        hit = pairs.get((max(x, y), min(x, y)))
                        want |= {(a, b, x, y)} if hit.d == "SAME_CLAIM" else set()
    assert set(map(tuple, recent.same_across_events(df, e).collect())) == want and len(want) > 5
    plan = recent.same_across_events(df, e)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_best_groups(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(14)] + ["common"] * 6
    groups = [(e, p, [rng.choice(words) for _ in range(rng.randint(1, 8))]) for e in range(4) for p in range(1, 20)]
    asked = [(e, k * 10 + e, [rng.choice([*words, "nowhere"]) for _ in range(rng.randint(0, 9))]) for e in range(5) for k in range(30)]
    want = []
    for e, c, w in asked:
        best, most = None, 0
        for v, p, t in groups:
            if v == e and len(set(w) & set(t)) > most:
                best, most = p, len(set(w) & set(t))
        want += [(c, best, most)] if best is not None else []
    got = recent.best_groups(spark.createDataFrame(asked, "event int, claim_id int, words array<string>"), spark.createDataFrame(groups, "event int, place int, words array<string>"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_best_groups_of_large_events(spark):
    """a claim moves once, not once a word, and an event of many claims and groups is dealt out with the same results."""
    rng = random.Random(6)
    words = [*map("w{}".format, range(30)), *["common"] * 9, None]
    groups = spark.createDataFrame([(e, p, [rng.choice(words) for _ in range(rng.randint(0, 8))]) for e, n in ((0, 60), (1, 2), (2, 1)) for p in range(1, n)], "event int, place int, words array<string>")
    asked = spark.createDataFrame([(e, k * 10 + e, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for e, n in ((0, 90), (1, 5), (2, 3)) for k in range(n)], "event int, claim_id int, words array<string>")
    groups.createOrReplaceTempView("f1_groups")
    asked.createOrReplaceTempView("f1_claims")
    want = spark.sql("""SELECT claim_id, -best.m AS place, best.n AS overlap FROM (SELECT claim_id, max(struct(n, m)) AS best FROM (SELECT c.claim_id, -g.place AS m, size(array_intersect(filter(c.words, w -> w IS NOT NULL), g.words)) AS n
        FROM f1_claims c JOIN f1_groups g ON g.event = c.event) WHERE n > 0 GROUP BY claim_id)""")
    whole = recent.best_groups(asked, groups)
    assert "explode(mine" not in whole._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 60 and sorted(map(tuple, whole.collect())) == want
    assert sorted(map(tuple, recent.best_groups(asked, groups, 7, 4).collect())) == want


def test_evidence_groups(spark):
    long_ = "a line of the report that is long enough"
    items = [(1, 1, "t", f"{long_}\nshort\n{long_} two\n" + "x" * 300, "dom:a", True), (1, 2, long_, f"  {long_}  ", "dom:b", True), (1, 3, "", long_, "dom:a", False), (2, 4, None, None, "dom:a", True), (1, 5, "", "\n".join(f"{long_} {k}" for k in range(9)), "dom:c", True)]
    df = spark.createDataFrame(items, "event int, item_id int, title string, text string, lineage string, trusted boolean")
    got = {r.line: (r.n_items, r.independent, r.place) for r in recent.evidence_groups(df).collect()}
    assert got[long_] == (4, 2, 1) and got[f"{long_} two"] == (1, 1, 2) and len(got) == 7 and got[f"{long_} 4"] == (1, 1, 7)


def test_origins(spark):
    rng = random.Random(5)
    sources = [(k, rng.choice(["", "", f"id{k}"]), rng.choice([f"Agency {k}", f"NEWS_{k}", "الف ب", None]), rng.choice([f"https://x.example/{k}", None, "https://t.example/Agency"]), rng.choice(["APPROVED", None, origins.LIMITED])) for k in range(40)]
    asked = [(k, rng.choice([None, "", "@id3", "@news_1", "@@id7", "agency", "e", "1", "ا", "%", "_1"]), rng.choice([None, "Agency 2", "الف", "ب", "nobody at all", "https://"])) for k in range(120)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for k, user, title in asked:
        user, title, found = (user or "").lstrip("@"), title or "", None
        for p in (user, title):
            hits = [(i == "", s) for s, i, n, u, st in sources if p and st != origins.LIMITED and (i == p or p.translate(low) in (n or "").translate(low) or p.translate(low) in (u or "").translate(low))]
            if hits:
                found = min(hits)[1]
                break
        want.append((k, found, title or (f"@{user}" if user else origins.UNKNOWN)))
    df = spark.createDataFrame(sources, "source_id int, identity string, name string, url string, status string")
    out = origins.mapped_origins(spark.createDataFrame(asked, "message_id int, username string, title string"), df)
    assert sorted(map(tuple, out.collect())) == want and sum(w[1] is not None for w in want) > 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_peers(spark):
    sources = spark.createDataFrame([(1, "-100555", "one"), (2, "555", "@two"), (3, "777", ""), (4, None, "four"), (5, "-888", None)], "source_id int, stable_id string, handle string")
    asked = [(1, "-100555"), (2, "555"), (3, "-777"), (4, "@four"), (5, "four"), (6, "two"), (7, None), (8, "999"), (9, "-888"), (10, "@two")]
    got = {r.message_id: r.source_id for r in origins.resolved_peers(spark.createDataFrame(asked, "message_id int, peer_id string"), sources).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 2, 7: None, 8: None, 9: 5, 10: 2}
