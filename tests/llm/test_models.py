"""Trained operators by held-out accuracy, and the pipeline by what its stages must and mustn't drop."""

import corpus_pipeline
import pytest
from panelloom.llm import language, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_documents(spark, documents):
    model = language.train(documents.where(~language.held_out()))
    out = language.identify(documents, model, carry=["doc_id", "lang"]).where(language.held_out())
    row = out.agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score"), F.max("score")).first()
    assert row["n"] > 150 and row["a"] > 0.95 and 0 <= row[2] <= row[3] <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? 4"), (4, "é")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] in set(model.langs)
    assert language.identify(odd.limit(0), model).count() == 0
    nothing = language.train(documents.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


def test_toxicity_of_unseen_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train(documents, labels.where("doc_id % 4 <> 0"), ["low_quality", "toxic"])
    out = toxicity.classify(documents, chain).join(labels.where("doc_id % 4 = 0"), "doc_id")
    n = {(r["toxic"], r["is_toxic"]): r["count"] for r in out.groupBy("toxic", "is_toxic").count().collect()}
    assert n.get((1, True), 0) >= 0.6 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.02 * n[0, False]
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["is_toxic"] for r in toxicity.classify(odd, chain).collect()] == [False, False]
    empty = toxicity.train(documents, labels.limit(0), ["toxic"])
    assert toxicity.classify(odd, empty).count() == 2


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= before
        if name == "language_id":
            assert after == before
        if name == "toxicity":
            gone = before - after
            assert all(labels.get(d, 1) == 1 for d in gone)
        if name != "best_fit_packing":
            assert docs.columns == columns
        else:
            assert after == before


def test_pipeline_stages_with_odd_rows_and_clashing_names(spark):
    names = ["score", "lang_pred", "rejected", "is_toxic", "p_toxic", "n_lines", "n_removed", "earlier", "_text"]
    text = "these are the plain words of a document that is written in one language and not in another"
    rows = [(1, text, 9), (2, text, 9), (2, text, 9), (3, None, 9), (4, "", 9), (None, "a text without an id but with words of its own language", 9), (5, text + " now", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    docs = docs.select("*", *(F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))).alias(c) for c in names))
    sf_dir = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        got = kept.collect()
        assert all(r[c] == f"{c}{r['doc_id'] or 0}" for r in got for c in names) and stage(spark, docs.limit(0), sf_dir).count() == 0
        ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got)
        want = {"toxicity": [0, 1, 2, 2, 3, 4, 5], "line_dedup": [0, 1, 3, 4, 5], "ngram_jaccard_join": [0, 1, 3, 4]}[name]
        assert [d for _, d in ids] == want, name
    language_stage = dict(corpus_pipeline.STAGES)["language_id"]
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("mine"))
    kept = language_stage(spark, real.unionByName(docs.select("doc_id", "text", "n_chars", "score"), allowMissingColumns=True), sf_dir)
    assert kept.columns == real.columns and not {3, 4} & {r["doc_id"] for r in kept.where("n_chars = 9").collect()}


def test_toxicity_counts_all_labelled_rows(spark):
    rows = [(i, f"plain words number{i} " + ("zyxwv" if i % 10 == 0 else "good day")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    few = toxicity.train(docs, labels, ["toxic"], sample=20)  # the word stands in about two of these
    every = toxicity.train(docs, labels, ["toxic"], sample=10_000)
    assert len(every.keys) > 0 and few.keys.tolist() == every.keys.tolist()


def test_labels_by_bitmaps_and_by_a_shuffle(spark, monkeypatch):
    ids = [0, 1, -1, 7, 8, 32768, 32769, 65536, -32768, 10**12, None]
    docs = spark.createDataFrame([(d, f"text {d}") for d in ids] + [(7, "text 7"), (8, None), (9, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, i % 2, i % 3 % 2) for i, d in enumerate(ids) if d is not None], "doc_id long, a int, b int")
    want = sorted((f"text {d}", i % 2, i % 3 % 2) for i, d in enumerate([*ids[:-1]]) for _ in range(2 if d == 7 else 1))
    for most in (1 << 26, 0):
        monkeypatch.setattr(toxicity, "_BITMAP_BYTES", most)
        assert sorted(tuple(r) for r in toxicity.labelled_texts(docs, labels, ["a", "b"]).collect()) == want
