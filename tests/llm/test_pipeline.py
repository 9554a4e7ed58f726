"""Each stage of the corpus pipeline against a plain version, on a table with copies, shared passages and repeated ids."""

import re
from collections import Counter

import pytest

import corpus_pipeline as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def say(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = []
    for k in range(150):
        rows.append((k, say(k, 60) + (" nasty### vile###" if k % 5 == 0 else ""), "en", f"s{k % 4}"))
    base = say(900, 80)
    near = base.split()
    near[3] = "changed"
    rows += [(200, base, "en", "s0"), (201, base, "en", "s1"), (202, " ".join(near), "en", "s0"), (202, " ".join(near), "en", "s0"), (203, None, "en", None), (None, say(901, 30), "en", "s1"), (200, base, "en", "s0")]
    passage = say(902, 60)
    rows += [(300, say(1, 70) + " " + passage, "en", "s2"), (301, passage + " " + say(2, 70), "en", "s3")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, 8) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, y int, _id int")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    found = {}
    for name, stage in P.STAGES:
        before, docs = docs, P.store.written(stage(spark, docs, folder), name)
        found[name] = (before.collect(), docs.collect())
        assert name == P.STAGES[-1][0] or docs.columns == columns

    before, after = found["toxicity"]
    gone = Counter(before) - Counter(after)
    toxic = sum("###" in r.text for r in gone)
    assert toxic >= 27 and sum(gone.values()) - toxic <= 2 and any(r.doc_id is None for r in after)

    before, after = found["near_duplicates"]
    least, sets = {}, {}
    for r in before:
        if r.doc_id is not None:
            sets[r.doc_id] = shingles(r.text)
    for a in sorted(sets):
        least[a] = min([a] + [b for b in sets if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    kept = {a for a in sets if least[a] == a}
    assert Counter(r.doc_id for r in after) == Counter([*kept, None])

    before, after = found["repeated_strings"]
    seen = Counter()
    for r in before:
        b = (r.text or "").encode()
        seen.update(b[k : k + 200] for k in range(len(b) - 199) if r.doc_id is not None)
    want = Counter()
    for r in before:
        b = (r.text or "").encode()
        cut = [False] * len(b)
        for k in range(len(b) - 199):
            if r.doc_id is not None and seen[b[k : k + 200]] > 1:
                cut[k : k + 200] = [True] * 200
        want[r.doc_id, None if r.text is None else bytes(x for x, c in zip(b, cut, strict=True) if not c).decode()] += 1
    assert Counter((r.doc_id, r.text) for r in after) == want and any(len(t or "") < len(r.text or "") for r in before for (i, t) in want if i == r.doc_id)

    before, after = found["mixing"]
    rows = {r.doc_id: r for r in before}
    assert all(r == rows[r.doc_id] for r in after) and max(Counter(r.doc_id for r in after).values()) <= 3
    total = sum(len(WORD.findall(r.text or "")) for r in before)
    assert abs(sum(len(WORD.findall(r.text or "")) for r in after) - total) <= 5 * 130

    before, after = found["packing"]
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
    ends = Counter()
    for r in after:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


def test_run_leaves_only_what_it_needs(spark, folder):
    rows = P.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 100
