"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import dac, jaccard, language, licences, lines, packing, periods, pieces, spelling, sql, topk, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, labels, ["low_quality", "toxic"]))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "earlier")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = dac.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return dac.read(folder, manifest)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), drop_every=31)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """documents whose h = crc32(doc_id) is a multiple of 10 repeat their words from word a on with period p, joined by one space."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.withColumn("_words", F.when(crc % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    g, n = F.floor(crc / 10), F.size("_words")
    a = F.when(n > 0, g % n)
    period = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i >= a, a + (i - a) % period).otherwise(i)
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", place(i).cast("int"))))
    return rows.withColumn("text", F.when(n > 0, words).otherwise(F.col("text"))).drop("_words")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periods.runs(docs, min_words=24, min_periods=3)
    # The greatest length / period compared as a fraction, ties to the smaller start, then period.
    better = lambda x, y: F.when(x.length * y.period < y.length * x.period, y).otherwise(x)
    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), better))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_toxicity": op5_toxicity,
        "op6_line_dedup": op6_line_dedup,
        "op7_token_files": op7_token_files,
        "op8_language_id": op8_language_id,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_license_scan": op10_license_scan,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_exact_topk": op13_exact_topk,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries' SQL would need their model, tokenizer, index or alignment."""
    return {"op11_spelling_variants": sql.SPELLING, "op12_periodic_runs": sql.PERIODS, "op13_exact_topk": sql.TOP_K}
