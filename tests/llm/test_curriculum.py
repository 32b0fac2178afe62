import pytest

from footfall.llm import curriculum


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_targets_and_takes(spark):
    rows = [(i, "w " * (1 + i % 13), "en", [None, "a", "b", "b", "b", "b", "c"][i % 7], 0) for i in range(400)]
    df = docs(spark, rows)
    out = curriculum.mix(df).collect()
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets_by_hand(sizes)
    for s, t in want.items():
        own = [r for r in out if r["source"] == s]
        assert own[0]["target"] == pytest.approx(t)
        assert own[0]["source_size"] == sizes[s]
        assert sum(r["taken"] for r in own) == round(t)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    again = {(r["doc_id"], r["taken"], r["position"]) for r in curriculum.mix(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"], r["position"]) for r in out}


def test_demand_is_inverted(spark):
    from pyspark.sql import functions as F

    df = spark.range(1, 100).select((F.col("id") / 100.0).alias("t"))
    for a, b in curriculum.SCHEDULE:
        asked = (a * F.col("t") + (b - a) * F.col("t") ** 2 / 2) / ((a + b) / 2) * 1000
        back = curriculum.time_of(asked, F.lit(1000.0), F.lit(0), [(a, b)])
        assert df.where(F.abs(back - F.col("t")) > 1e-9).count() == 0


def test_running_sums_match_a_plain_window(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").alias("source"), (F.col("id") % 11).alias("size"),
        curriculum.hash_order(F.col("id")).alias("order_key"),
    )
    n = df.groupBy("source").agg(F.count("*").alias("n_docs")).withColumnRenamed("source", "s")
    got = curriculum.with_words_before(df.join(n, df["source"].eqNullSafe(n["s"])).drop("s"), bucket_rows=4)
    rows = sorted(got.collect(), key=lambda r: (r["source"] is None, r["order_key"], r["doc_id"]))
    at = {}
    for r in rows:
        assert r["before"] == at.get(r["source"], 0)
        at[r["source"]] = r["before"] + r["size"]


def test_applied_mix_has_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i % 9)), "en", "ab"[i % 2], 0) for i in range(60)] + [(99, None, "en", "a", 0)]
    df = docs(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in curriculum.mix(df).collect()}
    out = curriculum.apply_mix(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert words == {d: t for d, t in taken.items() if t}


def test_odd_rows(odd_docs, no_docs):
    out = curriculum.mix(odd_docs).collect()
    assert len(out) == odd_docs.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in out if r["doc_id"] in (3, 4, 5))
    assert curriculum.mix(no_docs).count() == 0
    assert curriculum.apply_mix(odd_docs).columns == odd_docs.columns


def test_repeated_rows_share_what_is_taken(spark):
    rows = [(1, "w " * 50, "en", "a", 0)] * 4 + [(2, "v " * 68, "en", "b", 0)] * 1
    df = docs(spark, rows).selectExpr("*", "1 AS size", "2 AS take", "3 AS at", "4 AS own_id", "5 AS rank")
    for share in (0.5, 1.1, 1.5):
        want, got = {}, {}
        for r in curriculum.mix(df, share=share).collect():
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
        out = curriculum.apply_mix(df, share=share)
        assert out.columns == df.columns
        for r in out.collect():
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert got == {d: t for d, t in want.items() if t}
