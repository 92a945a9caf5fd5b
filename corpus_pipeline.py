"""A training-corpus pipeline: five stages over the documents table, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import jaccard, language, lines, packing, toxicity
from panelloom.llm.tasks import written


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with every column but the text and the doc_id under a name that no operator uses, and the names."""
    names = [c if c in ("doc_id", "text") else f"_kept{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified; null texts and texts without letters go too."""
    model = language.train(docs)
    rows, names = _apart(docs)
    return language.identify(rows, model, carry=names).where("not rejected").select(*names).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier chain, trained on the labels table, doesn't find toxic; a null text
    counts as empty, a null doc_id has no label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.train(docs, labels, ["low_quality", "toxic"])
    rows, names = _apart(docs)
    return toxicity.classify(rows, chain, carry=names).where("not is_toxic").select(*names).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that an earlier document has; a document of which no word is left goes.

    Rows with a null doc_id or text stay as they are; n_chars, where there is one, becomes that of the new text.
    """
    rows, names = _apart(docs)
    found = lines.dedup(rows)
    text = F.col("text")
    keep = (F.col("n_removed") == 0) | (F.length(F.trim(F.translate(text, "\n\t\r", "   "))) > 0)
    length = lambda c: F.length(text).cast(docs.schema[c].dataType)
    return found.where(keep).select(*((length(c) if c == "n_chars" else F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near duplicates: shingles of five words, similarity 0.8.

    Rows with a null doc_id can't be named by a group and stay; of equal rows with one doc_id one stays.
    """
    first = jaccard.join(docs, k=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    rows, names = _apart(docs)
    kept = rows.join(first, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"])
    return kept.select(*names).unionAll(rows.where("doc_id is null")).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048)


STAGES = [
    ("language_id", language_id),
    ("toxicity", drop_toxic),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard),
    ("best_fit_packing", best_fit_packing),
]

#: None: the stages' models, alignment and tokenizer have no SQL. The tests hold each stage against brute force
#: or labels on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
