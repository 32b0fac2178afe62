import hashlib

import numpy as np
import pytest

from footfall.llm import vector_codes
from footfall.llm.vector_codes import op11_vector_codes

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    v = [[int(np.floor(4096 * float(np.float32(x)))) for x in r[1]] for r in kept]
    w = len(v[0]) // parts
    cut = [[x[p * w : p * w + w] for p in range(parts)] for x in v]
    seeds = [c for r, c in zip(kept, cut) if r[0] is not None][:entries]
    books = [[s[p] for s in seeds] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(x) for x in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    best = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(e for e, _ in b) for b in best]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{i:02x}" for _, i in b), e, by_label[r[2]], sha) for r, b, e in zip(kept, best, errors)], key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("n, width", [(150, 16), (9, 8), (1, 24)])
def test_equals_plain_lloyd(spark, n, width):
    rng = np.random.default_rng(n)
    rows = [(int(i) * 3 % 101, rng.normal(size=width).tolist(), int(i) % 4 if i % 7 else None) for i in range(n)]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(900 + i, rows[0][1], 1) for i in range(n // 3)] + [(7000, rows[-1][1], None), (7000, rows[-1][1], None), (None, rows[-1][1], 2)]
    rows += [(1, None, 1), (2, [1.0, None] * (width // 2), 1), (0, [float("nan")] * width, 1), (3, [float("inf")] * width, 1)]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS row", "2 AS pos", "3 AS part", "4 AS code", "5 AS error")
    assert rows_of(op11_vector_codes(df)) == brute(rows)


def test_lengths_and_sizes_that_do_not_fit(spark):
    rows = [(1, [], 0), (2, [1.0] * 5, 0), (3, [0.5] * 8, 0), (4, [0.25] * 8, 0), (5, [3e38] * 8, 0), (6, [1.0] * 16, 1)]
    got = {r["vec_id"]: r for r in op11_vector_codes(spark.createDataFrame(rows, SHAPE)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert (got[3]["code"], got[4]["code"], got[3]["error"]) == ("00" * 8, "01" * 8, 0)
    assert all(got[k]["code"] is None and got[k]["error"] is None for k in (1, 2, 5, 6))
    assert got[1]["label_error"] == 0 and got[6]["label_error"] is None


def test_tables_without_vectors(spark):
    assert op11_vector_codes(spark.createDataFrame([], SHAPE)).count() == 0
    none = spark.createDataFrame([(1, None, 1), (None, [1.0] * 8, 1)], SHAPE)
    (row,) = op11_vector_codes(none).collect()
    assert row["vec_id"] is None and row["code"] is None


def test_other_numbers_of_parts_and_approximations(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist(), 0) for i in range(40)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SHAPE), parts=3, entries=40, rounds=2)
    assert books.shape == (3, 40, 4)
    for r in vector_codes.approximations(coded, books).collect():
        assert np.abs(np.array(r["approximation"]) - rows[r["vec_id"]][1]).max() <= 1 / 4096 and r["error"] == 0
