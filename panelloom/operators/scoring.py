"""Label-distribution scorers behind one extension point, in batches, with a cache of what was scored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.sources.ledger_log import append_once, read_log


class Scorer(Protocol):
    """What a scorer must have: a name (with its version: it is part of the cache's key), its labels, and a function
    from a batch of texts to a probability for each text and label. Tasks get a pickled copy."""

    name: str
    labels: tuple[str, ...]

    def score(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class LetterShares:
    """Shares of some letters, each counted once more than it occurs; one letter a label."""

    labels: tuple[str, ...]
    chars: str
    name: str = "letters-1"

    def score(self, texts: list[str]) -> np.ndarray:
        n = np.array([[t.count(c) + 1 for c in self.chars] for t in texts], np.float64).reshape(len(texts), len(self.chars))
        return n / n.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Lexicon:
    """Softmax of a weight for each listed word's occurrence (lower-cased, parted by white space)."""

    labels: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    name: str = "lexicon-1"

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.labels)))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                if w in self.weights:
                    out[i] += self.weights[w]
        e = np.exp(out - out.max(axis=1, keepdims=True, initial=-np.inf))
        return e / e.sum(axis=1, keepdims=True)


_SCORED = "content_key string, scorer string, labels array<string>, probabilities array<double>"


def keyed(rows: DataFrame, text: str, scorer: Scorer) -> DataFrame:
    """Adds content_key, a hash of the scorer's name and labels and of the text (null: empty)."""
    return rows.withColumn("content_key", F.sha2(F.concat_ws("\x1f", F.lit(scorer.name), F.lit("\x1e".join(scorer.labels)), F.coalesce(F.col(text), F.lit(""))), 256))


def forwarded(rows: DataFrame, text: str, scorer: Scorer, batch_size: int) -> DataFrame:
    """Scores of rows (content_key and text), as many texts at a time as batch_size."""
    schema = T.StructType.fromDDL(_SCORED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = (batch.column(i).to_pylist() for i in (0, 1))
            for a in range(0, len(keys), batch_size):
                own = texts[a : a + batch_size]
                p = np.asarray(scorer.score(own), np.float64)
                if p.shape != (len(own), len(scorer.labels)):
                    raise ValueError(f"{scorer.name} gave {p.shape} for {len(own)} texts and {len(scorer.labels)} labels")
                n = len(own)
                columns = [pa.array(keys[a : a + n]), pa.array([scorer.name] * n), pa.array([list(scorer.labels)] * n, pa.list_(pa.string())), pa.array(p.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.select("content_key", F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInArrow(work, schema)


def scored(rows: DataFrame, text: str, scorer: Scorer, cache: str, batch_size: int = 32) -> DataFrame:
    """rows with p_<label> for each label, and hit: whether the score was in the cache before.

    cache is a folder that all executors reach. Contents that it doesn't have are scored, each once, and appended to
    it before the result is joined from it; scorers of other names share the folder. Null texts count as empty.
    """
    spark = rows.sparkSession
    mine = keyed(rows, text, scorer)
    known = read_log(spark, cache, _SCORED).where(F.col("scorer") == scorer.name).select("content_key").distinct()
    new = mine.select("content_key", text).join(known, "content_key", "left_anti").dropDuplicates(["content_key"])
    number = append_once(forwarded(new, text, scorer, batch_size), cache)
    log = read_log(spark, cache, _SCORED).where(F.col("scorer") == scorer.name).groupBy("content_key").agg(F.first("probabilities").alias("_p"), F.min("batch").alias("_batch"))
    out = mine.join(log, "content_key", "left")
    return out.select(*rows.columns, *(F.get("_p", F.lit(i)).alias(f"p_{label}") for i, label in enumerate(scorer.labels)), (F.col("_batch") != number).alias("hit"))
