import random
import re

import numpy as np
import pytest

from footfall.llm import ngram_join as N


def shingles(text):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return set()
    return {tuple(ws)} if len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows, shape="doc_id long, text string"):
    df = spark.createDataFrame(rows, shape).selectExpr("*", "1 AS set_id", "2 AS component", "3 AS kept")
    out = N.near_documents(df.repartition(3))
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=str)


def mutated(rng, words, share):
    return [w if rng.random() > share else f"m{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("seed", [0, 1])
def test_random_near_copies(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 120]))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows), " ".join(mutated(rng, base, rng.choice([0, 0.01, 0.03, 0.06])))))
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for _ in range(25):  # a passage that many documents are mostly made of
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 16))]
        rows.append((len(rows), " ".join([*own, *passage])))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (2, text.upper()), (None, text), (9, "a b"), (8, "A  b"), (1, None), (0, ""), (3, " \t "), (7, "a b c"), (7, "a b c"),
            (None, None), (4, "x" * 700_000 + " y"), (6, "w " * 50_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_keep_one(odd_docs, no_docs, spark):
    kept = N.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert N.keep_one(no_docs).count() == 0


def test_hashes_do_not_depend_on_place():
    text = "Alpha beta,  gamma\n" * 3 + "ÄÖ alpha"
    h = N.word_hashes(text)
    assert len(h) == 11 and h[0] == h[3] == h[10] and h[0] != h[9]
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    whole = N.word_hashes(long)
    assert (whole[:977] == whole[977 * 40 : 977 * 41]).all() and len(np.unique(whole)) == 977


@pytest.mark.parametrize("percent", [75, 60, 90])
def test_overlap_bounds(percent):
    for n in range(1, 60):
        for m in range(n, 60):
            linked = [o for o in range(n + 1) if 100 * o >= percent * (n + m - o)]
            assert N.least_overlap(n, m, percent) == (linked[0] if linked else N.least_overlap(n, m, percent))
            if linked:
                assert N.needed(m, percent) <= linked[0]


def test_components(spark):
    from footfall.llm.components import components
    from footfall.llm.scratch import Scratch

    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(300, i) for i in range(301, 350)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    want = {}
    for a, b in links:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(400):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}


def test_hot_shingles(spark):
    """A passage in over a third of all sets: its shingles are hot, and links through it stay."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(24))
    rows = []
    for i in range(900):
        own = " ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.choice([0, 1, 3, 30])))
        rows.append((i, f"{passage} {own}" if i % 3 else f"{own} x{i} y z {own}"))
    own = spark.createDataFrame(rows, "doc_id long, text string")
    hot = N.hot_shingles(N.described(own))
    assert len(hot) == 20
    assert run(spark, rows) == brute(rows)


def test_one_row_of_a_group_stays(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a), (5, a), (5, b), (6, near), (6, near + " end"), (None, b), (None, "x y z"), (None, "x y z"), (7, None), (7, None)]
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert [g for g in got if g[0] != 6] == sorted([(1, a), (5, b), (None, "x y z"), (7, None), (7, None)], key=str)
    assert len([g for g in got if g[0] == 6]) == 1


def test_rounds_read_contested_shingles_only(spark):
    """A shingle that one component holds alone is not shuffled again, and prefixes are unrolled by Spark."""
    sets = spark.createDataFrame([(1, 5, 2, [7, 8]), (2, 5, 3, [7]), (3, 5, 1, [8, 9])], "set_id long, n long, unshared long, prefix array<long>")
    entries = N.prefix_entries(sets)
    assert sorted((r["h"], r["set_id"], r["pos"]) for r in entries.collect()) == [(7, 1, 2), (7, 2, 3), (8, 1, 3), (8, 3, 1), (9, 3, 2)]
    groups = spark.createDataFrame([(1, 1), (2, 1)], "node long, component long")
    left = N.contested(entries, groups)
    assert left.columns == entries.columns
    assert sorted((r["h"], r["set_id"]) for r in left.collect()) == [(8, 1), (8, 3)]


def test_small_rounds_write_few_tables(spark, monkeypatch):
    """Few pairs are verified in one step; all ways agree."""
    from footfall.llm import components as C
    from footfall.llm.scratch import Scratch

    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(mutated(rng, base, rng.choice([0, 0.02, 0.04])))) for k in range(30)]
    names, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: names.append(name) or keep(self, df, name))
    assert run(spark, rows) == brute(rows)
    assert not [x for x in names if x.startswith("near-")] and "links-0" in names
    monkeypatch.setattr(N, "ONE_STEP_SHINGLES", 0)
    monkeypatch.setattr(C, "BROADCAST_LINKS", 0)
    assert run(spark, rows) == brute(rows)
    assert "near-0" in names
