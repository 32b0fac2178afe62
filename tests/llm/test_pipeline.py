from pathlib import Path

import corpus_pipeline
from footfall.llm import curriculum, fertility, lines, ngram_join, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_on_what_the_one_before_kept(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "source mix", "packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(Path(tmp_path) / str(i)))
        docs = spark.read.parquet(str(Path(tmp_path) / str(i)))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            kept = {r["doc_id"] for r in fertility.op2_tokenizer_fertility(before).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept
        if i == 1:
            own = {r["doc_id"]: r["text"] for r in lines.dedup_lines(before).collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == own
        if i == 2:
            near = ngram_join.near_documents(before).collect()
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({r["component_id"] for r in near})
        if i == 3:
            taken = {r["doc_id"]: r["taken"] for r in curriculum.mix(before).collect()}
            words = {}
            for r in docs.collect():
                words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
            assert words == {d: t for d, t in taken.items() if t}
    assert 0 < sizes[3] <= sizes[2] == sizes[1] <= sizes[0]
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[5]


def test_empty_documents(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_odd_documents_through_all_stages(spark, odd_docs, sf_dir, tmp_path):
    real = fertility.reject_unfit(spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'"))
    long = max((r["text"] for r in real.collect() if "\n" not in r["text"]), key=len)
    more = [(100 + i, f"{long} and {i}", "en", None if i % 2 else "a", 1) for i in range(3)] + [(None, long, None, "b", 1)] * 2
    docs = odd_docs.unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True)
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, "").write.parquet(str(Path(tmp_path) / str(i)))
        docs = spark.read.parquet(str(Path(tmp_path) / str(i)))
        assert docs.columns == columns
        if i == 0:
            assert docs.where("doc_id >= 100").count() == 3 and docs.where("doc_id is null").count() >= 2
    assert {r["doc_id"] for r in docs.collect()} >= {100} and docs.where("doc_id > 100 or doc_id is null").count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    assert {p["doc_id"] for p in packed} == {r["doc_id"] for r in docs.collect()}


def test_the_driver_tidies_up_after_every_second_table(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(scratch, "tidy", calls.append)
    own = scratch.Scratch(spark, "tidy")
    for k in range(4):
        own.keep(spark.range(3), str(k))
    assert len(calls) == 2
