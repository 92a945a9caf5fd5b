"""Language identification by nearest centroid over TF-IDF byte n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tasks import annotate, emit, longs

UNKNOWN = "und"
BUCKETS = 4096
_ROWS = 512  # texts whose counts a task holds at once, BUCKETS numbers each
LENGTHS = (1, 2, 3)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: ASCII bytes that aren't letters count as one separator; letters are lower-cased.
_FOLD = tb.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20

NEW = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """n-gram counts of each text of a slice in hashed buckets, (texts, BUCKETS)."""
    n = len(ends) - 1
    out = np.zeros(n * BUCKETS, np.float32)
    if len(data):
        folded = _FOLD[data]
        # A run of separators is one: only its first byte stays.
        keep = folded != 0x20
        keep[1:] |= folded[:-1] != 0x20
        keep[ends[:-1][ends[:-1] < len(data)]] = True
        owner = np.repeat(np.arange(n), np.diff(ends))[keep]
        folded = tb.BYTE_VALUE[folded[keep]]
        rolled = np.zeros(len(folded), np.uint64)
        for k in range(1, max(LENGTHS) + 1):
            m = len(folded) - k + 1
            if m <= 0:
                break
            rolled = rolled[:m] * _STEP + folded[k - 1 :]
            if k in LENGTHS:
                own = owner[:m] == owner[k - 1 :]
                bucket = (rolled ^ (rolled >> np.uint64(29))) * tb.U64(0xBF58476D1CE4E5B9) >> np.uint64(52)
                out += np.bincount((owner[:m] * BUCKETS + bucket.astype(np.int64))[own], minlength=len(out)).astype(np.float32)
    return out.reshape(n, BUCKETS)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of (1 + log count) times idf; a text without n-grams is the zero vector."""
    v = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Centroids with their languages, and the least cosine that each accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: np.ndarray


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all the given texts each bucket occurs, and the number of texts."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for part, data, ends in tb.slices(batch, rows=_ROWS):
            total[:-1] += (counts(data, ends) > 0).sum(axis=0)
            total[-1] += part.num_rows
        at = np.flatnonzero(total)
        yield [pa.array(at, pa.int64()), pa.array(total[at])]

    seen = emit(docs.select("text"), longs("bucket", "n"), work)
    df = np.zeros(BUCKETS + 1, np.int64)
    for r in seen.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def _cluster(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means with far-point starts."""
    rng = np.random.default_rng(seed)
    centres = points[[rng.integers(len(points))]]
    while len(centres) < min(k, len(points)):
        centres = np.concatenate([centres, points[[np.argmin((points @ centres.T).max(axis=1))]]])
    for _ in range(12):
        own = (points @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = points[own == c].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def train(docs: DataFrame, lang: str = "lang", sample_per_lang: int = 500, centroids_per_lang: int = 4, slack: float = 0.5) -> Model:
    """Learn from labelled texts. Document frequencies come from all of them; centroids from a sample.

    The sample is bounded: about sample_per_lang texts of each language, those whose hashed key is
    smallest, so that it doesn't depend on the partitioning. A centroid accepts a cosine of at least
    (1 - slack) times the least one of its own sample texts. Rows with a null text or language teach
    nothing; without any row the model has no language.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col(lang).isNotNull())
    df, n = document_frequency(usable)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sizes = {r["l"]: r["n"] for r in usable.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, size in sizes.items():
        share = F.when(F.col(lang) == value, F.lit(sample_per_lang / size)).otherwise(share)
    key = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        for part, data, ends in tb.slices(batch, rows=_ROWS):
            count = counts(data, ends)
            yield part, [pa.array([np.flatnonzero(c).astype(np.int32) for c in count], pa.list_(pa.int32())), pa.array([c[c > 0] for c in count], pa.list_(pa.float32()))]

    kinds = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.FloatType()))])
    sample = annotate(usable.where(key < share), kinds, work, ["doc_id", lang]).toPandas().sort_values("doc_id", kind="stable")
    centroids, langs, floors = [], [], []
    for value in sorted(sizes):
        rows = sample[sample[lang] == value].head(2 * sample_per_lang)
        if not len(rows):
            continue
        count = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (at, c) in enumerate(zip(rows["at"], rows["n"], strict=True)):
            count[i, np.asarray(at, np.int64)] = c
        points = vectors(count, idf)
        points = points[np.linalg.norm(points, axis=1) > 0.5]
        if not len(points):
            continue
        centres = _cluster(points, centroids_per_lang, 7)
        near = (points @ centres.T).max(axis=1)
        centroids.append(centres)
        langs += [value] * len(centres)
        floors += [float(near.min()) * (1 - slack)] * len(centres)
    empty = np.zeros((0, BUCKETS), np.float32)
    return Model(idf, np.concatenate(centroids) if centroids else empty, langs, np.array(floors))


def has_letter(text: bytes) -> bool:
    return any(ch.isalpha() for ch in text.decode("utf-8", "ignore"))


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and rejected to every row.

    lang_pred is the language of the centroid with the largest cosine (ties: the first in the order of
    language names); und if the text is null or has no letter, or if no language was learned. score is
    that cosine, cut to 0..1; 0 for und. rejected: und, or farther from the nearest centroid than that
    centroid accepts. Repeated rows give repeated results; an empty table gives an empty one; other
    columns are ignored unless carried.
    """
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[b for b in range(128) if chr(b).isalpha()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a centroid: bounded by the number of languages

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        m = shared.value
        for part, data, ends in tb.slices(batch, rows=_ROWS):
            n = part.num_rows
            letters = np.concatenate([[0], np.cumsum(ascii_letter[data])])
            lettered = letters[ends[1:]] > letters[ends[:-1]]
            for i in np.flatnonzero(~lettered & (np.diff(ends) > 0)):
                lettered[i] = has_letter(data[ends[i] : ends[i + 1]].tobytes())
            if len(m.langs):
                cosine = vectors(counts(data, ends), m.idf) @ m.centroids.T
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(n), best].astype(np.float64), 0, 1)
                rejected = ~lettered | (score < m.floors[best])
            else:
                lettered[:] = False
                best, score, rejected = np.zeros(n, int), np.zeros(n), np.ones(n, bool)
            yield part, [pa.array([m.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(rejected)]

    return annotate(docs, NEW, work, carry or ["doc_id"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
