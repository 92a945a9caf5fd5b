"""Exact top-k search by inner product: block-at-a-time pruning over block forward indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tasks import emit, longs, written
from .vectors import _sample, k_means

_LISTS = T.ArrayType(T.LongType())
_BLOCK = T.StructType([*longs("shard", "block").fields, *(T.StructField(c, _LISTS) for c in ("ids", "rows", "hi", "lo"))])
_ASKED = T.StructType([*longs("shard", "q", "query_id").fields, T.StructField("v", _LISTS), T.StructField("theta", T.LongType())])
_FOUND = longs("q", "query_id", "vec_id", "score")
_EXACT = 1 << 53  # sums of whole numbers below this are exact in double precision


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """id and v: the vectors that take part, each component x as floor(scale * x)."""
    x = F.col(vector).cast(T.ArrayType(T.DoubleType()))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    good = rows.where(F.col(key).isNotNull() & F.coalesce(x.isNotNull() & fine, F.lit(False)))
    return good.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)), pa.array(x.reshape(-1)))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of whole numbers, exactly: in double precision where no sum can pass 2**53, else in Python's whole numbers."""
    most = x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0))
    if most < _EXACT:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return (x.astype(object) @ y.astype(object).T).astype(np.int64)  # raises if a score needs more than 64 bits


def bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For each query and block the sum of each component's largest contribution: no row of the block scores more."""
    return products(np.maximum(q, 0), hi) + products(np.minimum(q, 0), lo)


def best_in_blocks(query_id: int, q: np.ndarray, order: np.ndarray, bound: np.ndarray, starts: np.ndarray, ids: np.ndarray, rows: np.ndarray, top: int, theta: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The query's top rows among blocks, their scores, and how many blocks were scored.

    Blocks are taken by descending bound, one, then two, then four and so on at a time, until the next bound
    is below the k-th score so far (or theta, a k-th score known from elsewhere); an equal bound still counts,
    as it can hold a tie of a smaller id.
    """
    held, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step, least = 0, 1, theta
    while at < len(order) and (least is None or bound[order[at]] >= least):
        taken = order[at : at + step]
        if least is not None:
            taken = taken[bound[taken] >= least]
        at, step = at + step, 2 * step
        rows_of = np.concatenate([np.arange(starts[b], starts[b + 1]) for b in taken])
        rows_of = rows_of[ids[rows_of] != query_id]
        held = np.concatenate([held, ids[rows_of]])
        score = np.concatenate([score, products(rows[rows_of], q[None])[:, 0]])
        best = np.lexsort((held, -score))[:top]
        held, score = held[best], score[best]
        if len(held) == top:
            least = int(score[-1]) if theta is None else max(theta, int(score[-1]))
    return held, score, min(at, len(order))


def build_blocks(good: DataFrame, n: int, d: int, block_rows: int, shard_rows: int, most_shards: int, fit_rows: int) -> DataFrame:
    """Written blocks of a forward index with each component's largest and smallest value.

    Rows are numbered by the nearest of a few centroids (fitted on at most fit_rows rows) and then by id, so
    a range of numbers holds similar rows. A shard is a range of about shard_rows, a block one of block_rows;
    the row with block -1 has the shard's own maxima and minima.
    """
    points = _sample(good, "id", "v", fit_rows)
    centres = k_means(points, int(np.clip(n // (4 * block_rows), 1, min(256, len(points)))))

    def code(batch: pa.RecordBatch) -> Iterator[list]:
        near = (2 * _matrix(batch.column("v"), d).astype(np.float64) @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
        yield [pa.array(near), batch.column("id"), batch.column("v").cast(pa.list_(pa.int64()))]

    coded = emit(good, T.StructType([*longs("code", "id").fields, T.StructField("v", _LISTS)]), code)
    shards = int(np.clip(-(-n // shard_rows), 1, most_shards))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        ids, rows = np.zeros(0, np.int64), np.zeros((0, d), np.int64)
        hi, lo = [], []

        def block(k: int, a: np.ndarray, x: np.ndarray, up: np.ndarray, down: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array([shard]), pa.array([k]), *(pa.array([c.reshape(-1)], pa.list_(pa.int64())) for c in (a, x, up, down))]
            return pa.RecordBatch.from_arrays(columns, _BLOCK.names)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, number
            at = 0
            while len(ids) - at >= (1 if last else block_rows):
                a, x = ids[at : at + block_rows], rows[at : at + block_rows]
                hi.append(x.max(axis=0)), lo.append(x.min(axis=0))
                yield block(number, a, x, hi[-1], lo[-1])
                number, at = number + 1, at + block_rows
            ids, rows = ids[at:], rows[at:]

        for batch in batches:
            ids, rows = np.concatenate([ids, np.asarray(batch.column("id"))]), np.concatenate([rows, _matrix(batch.column("v"), d)])
            yield from cut(False)
        yield from cut(True)
        if number:
            yield block(-1, ids[:0], rows[:0], np.max(hi, axis=0), np.min(lo, axis=0))

    return written(coded.repartitionByRange(shards, "code", "id").sortWithinPartitions("code", "id").select("id", "v").mapInArrow(build, _BLOCK), "blocks")


def _meet(blocks: DataFrame, asked: DataFrame, d: int, top: int, query_part: int) -> DataFrame:
    """Every query against the blocks of each shard that it asks; a shard's queries are cut into parts of about
    query_part, and its blocks are copied once for each part."""
    parts = asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(query_part)).alias("parts"))  # a row for each of most_shards at most
    left = blocks.where("block >= 0").join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = asked.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")))

    def solve(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if index.num_rows and queries.num_rows:
            sizes = index.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            ids = index.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            rows, hi, lo = (_matrix(index.column(c), d) for c in ("rows", "hi", "lo"))
            q = _matrix(queries.column("v"), d)
            bound = bounds(q, hi, lo)
            for i, (number, query_id, theta) in enumerate(zip(*(queries.column(c).to_pylist() for c in ("q", "query_id", "theta")), strict=True)):
                held, score, _ = best_in_blocks(query_id, q[i], np.argsort(-bound[i], kind="stable"), bound[i], starts, ids, rows, top, theta)
                out.append((np.full(len(held), number), np.full(len(held), query_id), held, score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=_FOUND.names)

    keys = ("shard", "part")
    return left.select(*keys, "ids", "rows", "hi", "lo").groupBy(*keys).cogroup(right.select(*keys, "q", "query_id", "v", "theta").groupBy(*keys)).applyInArrow(solve, _FOUND)


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 10, scale: float = 1024, block_rows: int = 64, shard_rows: int = 8192, most_shards: int = 16384, query_part: int = 8192, fit_rows: int = 8192) -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score of each query's rows with the largest whole inner product, exactly.

    Components become floor(scale * x). Rows are put in an order of likeness and cut into blocks with every
    component's largest and smallest value, blocks into shards. A query first asks the shard of the largest
    bound; its k-th score there is a threshold, and of the other shards it asks only those whose bound reaches
    it. Within a shard it scores blocks by descending bound until the next bound is below the k-th score.
    The maxima of at most most_shards shards are held by the driver and sent with the tasks; beyond
    most_shards * shard_rows rows the shards get longer instead of more.

    Every query row gets its own ranks, so a repeated query row repeats its answers; rows of the query's own
    key are no candidates, other repeated rows are candidates of their own; ties go to the smaller key.
    Rows with a null key, a null vector, null or non-finite components, or another length than most (ties: the
    shortest) take no part; zero vectors do. An empty table, or vectors without components, give no answers.
    A score that needs more than 64 bits is an error.
    """
    spark = rows.sparkSession
    good = whole_vectors(rows, key, vector, scale)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return spark.createDataFrame([], T.StructType([*longs("query_id").fields, T.StructField("rank", T.IntegerType()), *longs("vec_id", "score").fields]))
    n, d = sizes[0]["n"], sizes[0]["d"]
    good = good.where(F.size("v") == d)
    blocks = build_blocks(good, n, d, block_rows, shard_rows, most_shards, fit_rows)
    top_of = blocks.where("block = -1").select("shard", "hi", "lo").orderBy("shard").collect()  # at most most_shards rows
    shard, hi, lo = (np.array([r[c] for r in top_of], np.int64) for c in ("shard", "hi", "lo"))
    own = whole_vectors(rows.where(is_query), key, vector, scale).where(F.size("v") == d)
    queries = written(own.select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "v"), "queries")

    def route(batch: pa.RecordBatch, chosen: np.ndarray, theta: pa.Array) -> list:
        which, to = np.nonzero(chosen)
        taken = batch.take(pa.array(which))
        return [pa.array(shard[to]), taken.column("q"), taken.column("query_id"), taken.column("v").cast(pa.list_(pa.int64())), theta.take(pa.array(which))]

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        step = max(1, (1 << 20) // len(shard))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part, bounds(_matrix(part.column("v"), d), hi, lo)

    def first(batch: pa.RecordBatch) -> Iterator[list]:
        for part, bound in pieces(batch):
            yield route(part, np.arange(len(shard)) == bound.argmax(axis=1)[:, None], pa.nulls(part.num_rows, pa.int64()))

    def others(batch: pa.RecordBatch) -> Iterator[list]:
        for part, bound in pieces(batch):
            theta = part.column("theta")
            least = theta.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield route(part, (np.arange(len(shard)) != bound.argmax(axis=1)[:, None]) & (bound >= least[:, None]), theta)

    probed = written(_meet(blocks, emit(queries, _ASKED, first), d, top, query_part), "probed")
    known = probed.groupBy("q").agg(F.when(F.count("*") >= top, F.min("score")).alias("theta"))
    rest = _meet(blocks, emit(queries.join(known, "q", "left"), _ASKED, others), d, top, query_part)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = probed.unionAll(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
