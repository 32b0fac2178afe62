import numpy as np

from footfall.llm import pivots

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    usable = []
    for i, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.append(i)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(usable):
        for j in usable[:x]:
            a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], links[i], least.get(find(i), r[0]), least.get(find(i), r[0]) == r[0]) for i, r in enumerate(rows)), key=str)


def test_near_vectors_and_recall(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for g in range(120):
        base = rng.normal(size=32)
        for k in range(1 + g % 4):
            v = base + rng.normal(size=32) * 0.12 * (k > 0)
            rows.append((n, [float(x) for x in v.astype(np.float32)], g % 3))
            n += 1
    want = brute(rows)
    got = sorted((tuple(r) for r in pivots.near_vectors(spark.createDataFrame(rows, SHAPE)).collect()), key=str)
    assert len(got) == len(want)
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= true and found >= 0.97 * true
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 1.0], 0),
        (8, [float("nan"), 1.0, 1.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (10, [], 0), (11, [1.0, 2.0], 0), (12, [2.0, 4.0], 0),
        (None, v, 0), (13, [1.0, 2.0, 3.05], 0), (14, [-0.0, 1.0, 0.0], 2), (15, [0.0, 1.0, -0.0], 2), (16, [-1.0, -2.0, -3.0], 0),
    ]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS point", "2 AS n_links", "3 AS v")
    got = sorted((tuple(r) for r in pivots.near_vectors(df).collect()), key=str)
    assert got == brute(rows)
    assert pivots.near_vectors(spark.createDataFrame([], SHAPE)).count() == 0


def test_a_large_group_of_copies_is_counted(spark):
    rows = [(i, [1.0, 0.5, 0.25], 0) for i in range(500)]
    out = pivots.near_vectors(spark.createDataFrame(rows, SHAPE)).collect()
    assert {(r["n_links"], r["component_id"]) for r in out} == {(499, 0)}


def test_recall_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)

    def around(base, cosine):
        noise = rng.normal(size=base.shape)
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        v = base * np.sqrt(cosine) + noise * np.sqrt(1 - cosine)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    far = around(np.zeros((1600, 64)), 0.0)
    x = np.concatenate([around(np.repeat(far[:1], 1600, axis=0), 0.94), far, around(far, 0.94**2)]).astype(np.float32)
    order = rng.permutation(len(x))
    rows = [(int(i), x[k].tolist(), 0) for i, k in enumerate(order)]
    x = x[order].astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    out = pivots.near_vectors(spark.createDataFrame(rows, SHAPE)).collect()
    got = np.zeros(len(x), int)
    for r in out:
        got[r["vec_id"]] = r["n_links"]
    assert (got <= want).all()
    in_group = order < 1600
    assert got[in_group].sum() >= 0.999 * want[in_group].sum()
    assert got[~in_group].sum() >= 0.97 * want[~in_group].sum()


def test_blocks_of_a_cell_meet(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.28).astype(np.float32).tolist(), i % 2) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(10)]
    got = sorted((tuple(r) for r in pivots.near_vectors(spark.createDataFrame(rows, SHAPE)).collect()), key=str)
    assert got == brute(rows)


def test_recall_over_twenty_thousand_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(10_000, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.96, (len(base), 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * noise]).astype(np.float32)
    label = np.tile(np.arange(10_000) % 5, 2)
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), label))]
    out = pivots.near_vectors(spark.createDataFrame(rows, SHAPE)).collect()
    got = np.zeros(len(x), int)
    for r in out:
        got[r["vec_id"]] = r["n_links"]
    want = np.zeros(len(x), int)
    for k in range(5):
        own = np.flatnonzero(label == k)
        v = x[own].astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        want[own] = (v @ v.T >= 0.93).sum(axis=1) - 1
    assert (got <= want).all() and want.sum() >= 20_000
    assert got.sum() >= 0.99 * want.sum()


def test_shared_counts():
    near = [np.array([7, 3, 1]), np.array([3, 7, 9]), np.array([2, 4, 9])]
    counts = pivots.shared_counts(near)
    assert counts[0, 1] == 2 and counts[1, 2] == 1 and counts[0, 2] == 0
    assert pivots.shared_counts(near, below=7)[0, 1] == 1
