"""Toxicity by a classifier chain over selected word and word-beginning features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tasks import annotate, emit, longs, written

BEGINNINGS = (4, 5, 6)
#: Bitmaps of labels of so many bytes at most go to every task; beyond it texts and labels are shuffled.
_BITMAP_BYTES = 1 << 26


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, text by text, and the offsets.

    A feature is the hash of a lower-cased word or of the first 4, 5 or 6 bytes of a longer one.
    """
    data = tb.LOWER[data]
    starts, stops, text = tb.words(data, ends, tb.ALNUM)
    values, owner = [tb.hashes(data, starts, stops)], [text]
    for k in BEGINNINGS:
        long = stops - starts > k
        values.append(tb.hashes(data, starts[long], starts[long] + k) ^ tb.U64(k * 0x1F123BB5))
        owner.append(text[long])
    return np.concatenate(values), np.concatenate(owner)


def present(data: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(texts, keys) float32: 1 where a text has a feature. keys: ascending."""
    out = np.zeros((len(ends) - 1, len(keys)), np.float32)
    if len(keys) and len(data):
        values, owner = features(data, ends)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        hit = keys[at] == values
        out[owner[hit], at[hit]] = 1
    return out


def _linear(x: np.ndarray, z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x, the float32 features, and z, the probabilities fed, times the weights, plus the last one."""
    m = x.shape[1]
    return (x @ w[:m].astype(np.float32)).astype(np.float64) + z @ w[m:-1] + w[-1]


def _transposed(x: np.ndarray, z: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.concatenate([(r.astype(np.float32) @ x).astype(np.float64), r @ z, [r.sum()]])


def fit_logistic(x: np.ndarray, z: np.ndarray, y: np.ndarray, on: np.ndarray, l2: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights with a last intercept of an L2-penalised logistic regression over the rows that `on` marks,
    by Newton's method with conjugate gradients; with one class only, just the intercept of the smoothed
    rate. No copy of x is made."""
    w, n = np.zeros(x.shape[1] + z.shape[1] + 1), on.sum()
    rate = ((y * on).sum() + 0.5) / (n + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not n or y[on].min() == y[on].max():
        return w
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(_linear(x, z, w), -30, 30)))
        gradient = _transposed(x, z, (p - y) * on) + penalty * w
        if np.abs(gradient).max() < 1e-2:
            break
        curve = p * (1 - p) * on
        step, left = np.zeros_like(w), -gradient
        towards, size = left.copy(), left @ left
        for _ in range(25):
            image = _transposed(x, z, curve * (_linear(x, z, towards))) + penalty * towards
            scale = size / max(towards @ image, 1e-30)
            step += scale * towards
            left -= scale * image
            new = left @ left
            if new < 1e-6 * max(1e-6, gradient @ gradient):
                break
            towards, size = left + (new / size) * towards, new
        w += step
    return w


def _probability(x: np.ndarray, z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_linear(x, z, w), -30, 30)))


@dataclass
class Chain:
    """Linear models in the order of the chain: model j sees the features and the j probabilities before."""

    categories: list[str]
    keys: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            out = np.concatenate([out, _probability(x, out, w)[:, None]], axis=1)
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, categories: list[str], keys: np.ndarray) -> Chain:
    """Each model is fitted on all rows; what it feeds to later models is predicted out of fold, by
    models of the same place in the chain that haven't seen the row."""
    chain, fed = Chain(categories, keys), np.zeros((len(x), 0))
    every = np.ones(len(x), bool)
    for j in range(len(categories)):
        chain.weights.append(fit_logistic(x, fed, y[:, j], every))
        out = np.zeros(len(x))
        for f in np.unique(fold):
            out[fold == f] = _probability(x, fed, fit_logistic(x, fed, y[:, j], fold != f))[fold == f]
        fed = np.concatenate([fed, out[:, None]], axis=1)
    return chain


def labelled_texts(docs: DataFrame, ready: DataFrame, categories: list[str]) -> DataFrame:
    """text and categories of every document with a text and a label.

    Labels are bits at the places of their ids, 4 KiB for 32,768 neighbouring ids, so those of dense ids
    are small enough for every task and no text is shuffled. Bitmaps of scattered ids are not: then both
    sides are dealt by id. ready: distinct doc_ids with categories of 0 or 1.
    """
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = F.bitmap_bit_position("doc_id")
    maps = ready.groupBy(F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(place).alias("known"), *(F.bitmap_construct_agg(F.when(F.col(c) == 1, place)).alias(c) for c in categories))
    bucket_bytes = 4096 * (1 + len(categories))
    if ready.select(F.bitmap_bucket_number("doc_id")).distinct().count() * bucket_bytes > _BITMAP_BYTES:
        return rows.join(ready.hint("merge"), "doc_id").select("text", *categories)
    bit = lambda c: F.getbit(F.conv(F.hex(F.substring(c, (place / 8).cast("int") + 1, 1)), 16, 10).cast("int"), (place % 8).cast("int"))
    met = rows.withColumn("bucket", F.bitmap_bucket_number("doc_id")).join(F.broadcast(maps), "bucket").where(bit(F.col("known")) == 1)
    return met.select("text", *(bit(F.col(c)).cast("int").alias(c) for c in categories))


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = 12_000, n_features: int = 1200, folds: int = 5, least_docs: int = 4) -> Chain:
    """Fit the chain on a bounded sample: about `sample` labelled rows, those with the smallest hashed id.

    labels: doc_id and a 0/1 column for each category. Features are the n_features with the largest
    |z| of the difference between the share of positive and of negative texts that have them, over all
    categories; Spark counts them over all labelled rows. Rows with a null id, text or label teach nothing;
    of several labels of one id the larger ones count.
    """
    ready = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *categories).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    total = ready.count()
    key = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = ready.where(key < sample / max(total, 1)).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(folds)).cast("int"))
    held = written(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id"), "labelled")  # at most about `sample` ids
    k = len(categories)

    def count(batch: pa.RecordBatch) -> Iterator[list]:
        y = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in categories], axis=1)
        row = 0
        for part, data, ends in tb.slices(batch, most=1 << 20):  # counts of more texts at once are fewer rows
            n = part.num_rows
            values, owner = features(data, ends)
            values, at = tb.distinct(values, owner, n)
            owner = np.repeat(np.arange(n), np.diff(at))
            unique, where = np.unique(values, return_inverse=True)
            sums = [np.bincount(where, minlength=len(unique))] + [np.bincount(where, weights=y[row : row + n][owner, j], minlength=len(unique)) for j in range(k)]
            row += n
            yield [pa.array(unique.view(np.int64)), *(pa.array(s.astype(np.int64)) for s in sums)]

    names = ["n", *(f"pos{j}" for j in range(k))]
    labelled = labelled_texts(docs, ready, categories)
    seen = emit(labelled, longs("feature", *names), count).groupBy("feature").agg(*(F.sum(c).alias(c) for c in names))
    rows = labelled.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"pos{j}") for j, c in enumerate(categories))).first()
    n = rows["n"]
    score = F.lit(0.0)
    for j in range(k):
        pos = float(rows[f"pos{j}"] or 0)
        if 0 < pos < n:
            share = F.col("n") / float(n)
            z = F.abs(F.col(f"pos{j}") / pos - (F.col("n") - F.col(f"pos{j}")) / (n - pos)) / F.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos)) + 1e-12)
            score = F.greatest(score, z)
    best = seen.where(f"n >= {least_docs}").withColumn("z", score).where("z >= 4").orderBy(F.desc("z"), "feature").limit(n_features).select("feature").collect() if n else []
    keys = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))

    def design(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        for part, data, ends in tb.slices(batch):
            yield part, [pa.array([np.flatnonzero(x).astype(np.int32) for x in present(data, ends, keys)], pa.list_(pa.int32()))]

    table = annotate(held, T.StructType([T.StructField("at", T.ArrayType(T.IntegerType()))]), design, ["doc_id", "fold", *categories]).toPandas().sort_values("doc_id", kind="stable")
    x = np.zeros((len(table), len(keys)), np.float32)
    for i, at in enumerate(table["at"]):
        x[i, np.asarray(at, np.int64)] = 1
    return fit_chain(x, table[categories].to_numpy(np.float64), table["fold"].to_numpy(), categories, keys)


def classify(docs: DataFrame, chain: Chain, threshold: float = 0.5, target: str = "toxic", carry: list[str] | None = None) -> DataFrame:
    """Adds p_<category> for every category of the chain, and is_<target>: p_<target> >= threshold.

    A null text counts as empty: it has no feature and gets the probability of that. Repeated rows give
    repeated results; an empty table gives an empty one; other columns are ignored unless carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # n_features weights a category
    place = chain.categories.index(target)

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        for part, data, ends in tb.slices(batch):
            p = shared.value.probabilities(present(data, ends, shared.value.keys))
            yield part, [*(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, place] >= threshold)]

    kinds = T.StructType([T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories] + [T.StructField(f"is_{target}", T.BooleanType())])
    return annotate(docs, kinds, work, carry or ["doc_id"])
