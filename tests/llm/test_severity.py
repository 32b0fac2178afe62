import random

import numpy as np
import pytest

from footfall.llm import severity

MARKS = ["grumble", "snarl", "sneer", "scoff", "jeer"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        ws = rng.choices(common, k=60)
        if toxic:
            ws[10 : 10 + 1 + i % 4] = rng.sample(MARKS, 1 + i % 4)
        docs.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_documents(corpus):
    docs, labels = corpus
    model = severity.train(docs, labels.where("doc_id % 3 < 2"))
    assert list(model.thresholds) == sorted(model.thresholds)
    out = severity.score(docs, model).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 3 = 2"), "doc_id").collect()
    right = [r["said"] == bool(r["toxic"]) for r in out]
    assert np.mean(right) > 0.95
    assert not [r for r in out if r["said"] and not r["toxic"]]
    assert model.score(sum(model.weights.get(severity.feature(m.encode()), 0) for m in MARKS))[0] > model.score(
        model.weights.get(severity.feature(MARKS[0].encode()), 0)
    )[0]


def test_same_labels_give_the_same_model(corpus):
    docs, labels = corpus
    a, b = severity.train(docs, labels), severity.train(docs.repartition(5), labels.repartition(3))
    assert a.weights == b.weights and (a.thresholds == b.thresholds).all()


def test_gradient_reaches_the_optimum():
    rng = np.random.default_rng(0)
    docs = [np.array(sorted({1 for _ in range(1) if rng.random() < 0.5} | {2 for _ in range(1) if rng.random() < 0.3}), np.int64) for _ in range(300)]
    grades = np.array([min(2, int((1 in d) + (rng.random() < 0.2) + (2 in d))) for d in docs])
    names = np.array([1, 2])

    def loss(model):
        total = sum(0.3 * w * w / 2 / 300 for w in model.weights.values())
        for d, g in zip(docs, grades):
            x = sum(model.weights[f] for f in d.tolist())
            up = 1.0 if g == 2 else 1 / (1 + np.exp(x - model.thresholds[g]))
            down = 0.0 if g == 0 else 1 / (1 + np.exp(x - model.thresholds[g - 1]))
            total -= np.log(up - down) / 300
        return total

    best = severity.fit(docs, grades, names, steps=1500)
    for f in (1, 2):
        for step in (-0.05, 0.05):
            moved = severity.OrdinalModel(best.weights | {f: best.weights[f] + step}, best.thresholds)
            assert loss(moved) >= loss(best) - 1e-6


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(None, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    out = severity.op6_ordinal_toxicity(odd_docs, none).collect()
    assert len(out) == odd_docs.count() and not any(r["toxic"] for r in out)
    assert severity.op6_ordinal_toxicity(no_docs, none).count() == 0
    clash = odd_docs.withColumn("toxic", odd_docs["doc_id"])
    assert severity.score(clash, severity.OrdinalModel({}, np.array([5.0]))).count() == odd_docs.count()


def test_query_output_against_plain_scores(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = severity.train(docs, labels)
    out = {r["doc_id"]: r for r in severity.op6_ordinal_toxicity(docs, labels).collect()}
    fold = str.maketrans({c: c.lower() if c.isalnum() else " " for c in map(chr, range(128))})
    for d in docs.collect():
        own = set((d["text"] or "").translate(fold).split(" ")) - {""}
        x = sum(model.weights.get(severity.feature(w.encode()), 0.0) for w in own)
        above = [1 / (1 + np.exp(t - x)) for t in model.thresholds]
        chance = [a - b for a, b in zip([1.0, *above], [*above, 0.0])]
        r = out[d["doc_id"]]
        assert r["expected_severity"] == pytest.approx(sum(k * c for k, c in enumerate(chance)), abs=1e-9)
        assert chance[r["severity_grade"]] == pytest.approx(max(chance), abs=1e-9)
        assert r["toxic"] == (above[0] >= 0.5)


def test_only_near_copies_count_once(spark):
    text = " ".join(f"w{i}" for i in range(60))
    far = " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"x{i}" for i in range(30))
    rows = [(1, text), (2, text + " end"), (3, far), (4, None), (5, None)]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(1, 6)], "doc_id long, quality int, toxic int")
    got = severity.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, 100)
    assert got["doc_id"].tolist() == [1, 3, 4, 5] and got["grade"].tolist() == [1, 1, 2, 1]
