"""Nearest neighbours by an inverted multi-index, and near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tasks import components, emit, longs, written


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def kind(rows: DataFrame, vector: str) -> tuple[T.ArrayType, pa.DataType]:
    """How tasks exchange the vectors: 32-bit floats as they are, every other number as a double."""
    single = rows.schema[vector].dataType.elementType == T.FloatType()
    return T.ArrayType(T.FloatType() if single else T.DoubleType()), pa.list_(pa.float32() if single else pa.float64())


def unit(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled by powers of two before, so that no square overflows or vanishes."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0))[1])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _sample(rows: DataFrame, key: str, vector: str, n: int) -> np.ndarray:
    """At most n rows' vectors, those with the smallest hashed keys."""
    got = rows.orderBy(F.xxhash64(key, F.lit(101)), key).limit(n).select(vector).collect()
    return np.array([r[0] for r in got], np.float64)


def _ready(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """Rows that take part, their number, and their length, the most frequent one (ties: the least)."""
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind(rows, vector)[0]).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return good, 0, 0
    return good.where(F.size("v") == sizes[0]["d"]), sizes[0]["n"], sizes[0]["d"]


# --- inverted multi-index -----------------------------------------------------------------------


def k_means(points: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    centres = points[np.random.default_rng(5).permutation(len(points))[:k]].copy()
    for _ in range(steps):
        own = (2 * points @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(axis=0)
    return centres


@dataclass
class MultiIndex:
    """Two codebooks, one for each half of a vector, and how many vectors each pair of codes has."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray

    def codes(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return tuple((2 * x @ c.T - (c**2).sum(axis=1)).argmax(axis=1) for x, c in ((v[:, :half], self.first), (v[:, half:], self.second)))

    def cells(self, q: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Pairs of centroids by ascending summed distance, with their sizes: a heap over both sorted lists.

        The distance of a half is its negated inner product, so that the sum is that of the whole vector.
        """
        half = self.first.shape[1]
        d1, d2 = -(self.first @ q[:half]), -(self.second @ q[half:])
        o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        heap = [(s1[0] + s2[0], 0, 0)]
        while heap:
            _, a, b = heapq.heappop(heap)
            yield o1[a], o2[b], int(self.sizes[o1[a], o2[b]])
            if b + 1 < len(s2):
                heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
            if b == 0 and a + 1 < len(s1):
                heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))


def build_index(rows: DataFrame, n: int, fit_rows: int = 8192, vectors_per_cell: int = 48) -> MultiIndex:
    """Codebooks fitted on at most fit_rows rows; every row is counted in its cell."""
    points = _sample(rows, "id", "v", fit_rows)
    k = int(np.clip(round((n / vectors_per_cell) ** 0.5), 1, min(256, len(points))))
    half = points.shape[1] // 2
    index = MultiIndex(k_means(points[:, :half], k), k_means(points[:, half:], k), np.zeros((k, k), np.int64))

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        a, b = index.codes(matrix(batch.column("v")))
        cell, count = np.unique(a * k + b, return_counts=True)
        yield [pa.array(cell), pa.array(count)]

    for r in emit(rows, longs("cell", "n"), work).groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most k * k rows
        index.sizes[r["cell"] // k, r["cell"] % k] = r["n"]
    return index


def best(ids: np.ndarray, v: np.ndarray, query_id: int, q: np.ndarray, near: np.ndarray, top: int, largest: float) -> list[tuple[float, int]]:
    """The top rows by exact inner product, ties to the smaller id. near: the products up to rounding, whose
    error no component over `largest` makes greater."""
    at = np.flatnonzero((ids != query_id) & (near > -np.inf))
    if len(at) > top:
        least = np.partition(near[at], len(at) - top)[len(at) - top]
        at = at[near[at] >= least - 1e-15 * len(q) * largest * np.abs(q).sum()]
    score = (v[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:top]
    return list(zip(score[order].tolist(), ids[at][order].tolist(), strict=True))


def _answers(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


_FOUND = T.StructType([*longs("q", "query_id", "vec_id").fields, T.StructField("score", T.DoubleType())])
_FOUND_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.float64())


def exact_search(rows: DataFrame, queries: list[tuple[int, list[float]]], top: int) -> DataFrame:
    """Brute force for a bounded list of queries against all rows, batch by batch."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        ids, v = np.asarray(batch.column("id")), matrix(batch.column("v"))
        largest = np.abs(v).max(initial=0)
        out = [(n, qid, i, s) for n, (qid, q) in enumerate(queries) for s, i in best(ids, v, qid, np.array(q, np.float64), v @ np.array(q, np.float64), top, largest)]
        yield [pa.array([x[j] for x in out], t) for j, t in enumerate(_FOUND_ARROW)]

    return _answers(emit(rows, _FOUND, work), top)


def candidates_needed(rows: DataFrame, queries: DataFrame, index: MultiIndex, top: int, recall: float, sample: int) -> int:
    """How many candidates a query must collect so that the given share of true neighbours is among them.

    Measured by brute force for a bounded sample of queries against all rows: the true neighbours' places
    in the order in which the traversal reaches them.
    """
    chosen = [(r["id"], list(r["v"])) for r in queries.dropDuplicates(["id"]).orderBy(F.xxhash64("id", F.lit(103)), "id").limit(sample).collect()]
    truth = exact_search(rows, chosen, top)
    near: dict[int, list[int]] = {}
    for r in truth.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").collect():  # sample * top rows
        a, b = index.codes(np.array([r["v"]], np.float64))
        near.setdefault(r["query_id"], []).append(int(a[0]) * len(index.second) + int(b[0]))
    places = []
    for qid, q in chosen:
        want, reached = set(near.get(qid, ())), 0
        at = {}
        for a, b, n in index.cells(np.array(q, np.float64)):
            reached += n
            if a * len(index.second) + b in want:
                at[a * len(index.second) + b] = reached
        places += [at[c] for c in near.get(qid, ())]
    return int(np.quantile(places, recall, method="higher")) if places else 0


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 20, recall: float = 0.97, sample: int = 100, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest rows by inner product.

    Every row is indexed by the centroids of its halves. A query walks the centroid pairs by summed
    distance until it has as many candidates as the calibration found necessary for the wanted recall
    (never fewer than 2 * top), and reranks them with exact products in double precision. Rows are dealt
    by the first centroid and hashed blocks, queries by hashed blocks, so neither a frequent vector nor
    the number of queries makes a large group. Rows whose vector or key is null, whose vector is zero, has
    null or non-finite components or another length than most take no part. A row of the query's own key
    is never its candidate; repeated rows are candidates of their own; a repeated query row gets its own ranks
    and so repeats its answers; an empty table gives no answers.
    """
    good, n, size = _ready(rows, key, vector)
    flagged = rows.where(is_query)
    if n < 1 or size < 2:
        return rows.sparkSession.createDataFrame([], T.StructType([*longs("query_id").fields, T.StructField("rank", T.IntegerType()), *longs("vec_id").fields, T.StructField("score", T.DoubleType())]))
    queries, _, _ = _ready(flagged, key, vector)
    queries = written(queries.where(F.size("v") == size).withColumn("q", F.monotonically_increasing_id()), "queries")
    index = build_index(good, n)
    need = max(candidates_needed(good, queries, index, top, recall, sample), 2 * top) + 1
    k = len(index.first)
    # First centroids are put into groups of about `block` rows; what is larger is cut into hashed blocks.
    per_first = index.sizes.sum(axis=1)
    group = np.minimum(np.cumsum(per_first) - per_first, n - 1) // block
    blocks = np.maximum(1, np.ceil(np.bincount(group, weights=per_first) / (1.5 * block))).astype(np.int64)
    n_queries = queries.count()
    parts = max(1, -(-n_queries // query_block))
    of_vector, arrow_kind = kind(rows, vector)
    kinds = T.StructType([*longs("grp", "blk", "part", "id", "code").fields, T.StructField("v", of_vector)])

    def repeat(batch: pa.RecordBatch, at: np.ndarray, grp: np.ndarray, blk: np.ndarray, part: np.ndarray, code: np.ndarray) -> list:
        taken = batch.take(pa.array(at))
        return [pa.array(grp), pa.array(blk), pa.array(part), taken.column("id"), pa.array(code), taken.column("v").cast(arrow_kind)]

    def deal(batch: pa.RecordBatch) -> Iterator[list]:
        a, b = index.codes(matrix(batch.column("v")))
        ids = np.asarray(batch.column("id"))
        at = np.repeat(np.arange(len(ids)), parts)
        yield repeat(batch, at, group[a][at], (_spread(ids) % blocks[group[a]].astype(np.uint64)).astype(np.int64)[at], np.tile(np.arange(parts), len(ids)), (a * k + b)[at])

    def ask(batch: pa.RecordBatch) -> Iterator[list]:
        """A row for each group that the query looks into, with its cells, and for each block of it."""
        at, grp, blk, cells, part = [], [], [], [], []
        v, ids = matrix(batch.column("v")), np.asarray(batch.column("id"))
        own = (_spread(ids + 1) % np.uint64(parts)).astype(np.int64)
        for i, q in enumerate(v):
            reached, mine = 0, {}
            for a, b, size_ in index.cells(q):
                if size_:
                    mine.setdefault(int(group[a]), []).append(a * k + b)
                reached += size_
                if reached >= need:
                    break
            for g, c in mine.items():
                for x in range(blocks[g]):
                    at.append(i), grp.append(g), blk.append(x), cells.append(c), part.append(own[i])
        taken = batch.take(pa.array(at, pa.int64()))
        yield [pa.array(grp, pa.int64()), pa.array(blk, pa.int64()), pa.array(part, pa.int64()), taken.column("q"), taken.column("id"), pa.array(cells, pa.list_(pa.int64())), taken.column("v").cast(arrow_kind)]

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, code, v = np.asarray(left.column("id")), np.asarray(left.column("code")), matrix(left.column("v"))
        out = []
        if len(ids) and right.num_rows:
            q = matrix(right.column("v"))
            near, largest = v @ q.T, np.abs(v).max(initial=0)
            for i, (n, qid, cells) in enumerate(zip(*(right.column(c).to_pylist() for c in ("q", "id", "cells")), strict=True)):
                inside = np.zeros(k * k, bool)
                inside[cells] = True
                out += [(n, qid, vec, s) for s, vec in best(ids, v, qid, q[i], np.where(inside[code], near[:, i], -np.inf), top, largest)]
        return pa.table([pa.array([x[j] for x in out], t) for j, t in enumerate(_FOUND_ARROW)], names=_FOUND.names)

    asked = T.StructType([*longs("grp", "blk", "part", "q", "id").fields, T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("v", of_vector)])
    keys = ("grp", "blk", "part")
    found = emit(good, kinds, deal).groupBy(*keys).cogroup(emit(queries, asked, ask).groupBy(*keys)).applyInArrow(rerank, _FOUND)
    return _answers(found, top)


def _spread(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


# --- pivot-permutation index --------------------------------------------------------------------


def pivot_lists(v: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """For each unit vector its m nearest pivots, nearest first."""
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :m]


def _local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, list_length: int = 6, shared_pivots: int = 2, rows_per_pivot: int = 100, most_pivots: int = 4096, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row, by links of cosine `least` or more.

    Equal vectors are one class with a count. A class is described by the ordered list of its nearest
    pivots, which are a bounded sample of the classes, about one for rows_per_pivot of them. Each pivot's
    list of classes is cut into hashed blocks of about `block`; all pairs of blocks of a list are compared,
    each in a task's group of bounded size. A pair with at least shared_pivots common pivots is verified
    by its cosine in double precision, and counts only in the list of the smallest pivot that it shares.
    A block returns sums and a spanning forest, never all its pairs.
    A vector that is null, zero, has null or non-finite components or another length than most, or a null
    key, links with nothing: n_links 0, its own component, kept. Repeated rows count as vectors of their
    own. An empty table gives an empty one.
    """
    good, n, size = _ready(rows, key, vector)
    spark = rows.sparkSession
    of_vector, arrow_kind = kind(rows, vector)
    alone = rows.select(F.col(key).cast("long").alias("vec_id"), F.xxhash64(F.col(vector).cast(of_vector)).alias("c"), F.when(usable(vector) & (F.size(vector) == size), F.col(key)).isNotNull().alias("ok"))
    lone = alone.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return lone
    classes = written(good.groupBy("v").agg(F.count("*").alias("n")).select(F.xxhash64("v").alias("c"), "v", "n"), "classes")
    n_classes = classes.count()
    pivots = _sample(classes, "c", "v", int(np.clip(n_classes // rows_per_pivot, min(n_classes, 32), most_pivots)))
    pivots = unit(pivots)
    m, words = min(list_length, len(pivots)), -(-len(pivots) // 64)
    shared_pivots = min(shared_pivots, m)

    def describe(batch: pa.RecordBatch) -> Iterator[list]:
        v = matrix(batch.column("v"))
        lists = pivot_lists(unit(v), pivots, m).astype(np.int32)
        yield [batch.column("c"), batch.column("n"), pa.array(list(lists), pa.list_(pa.int32())), batch.column("v").cast(arrow_kind)]

    described_as = [T.StructField("list", T.ArrayType(T.IntegerType())), T.StructField("v", of_vector)]
    described = written(emit(classes, T.StructType([*longs("c", "n").fields, *described_as]), describe), "lists")
    counts = np.zeros(len(pivots), np.int64)
    for r in described.select(F.explode("list").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect():  # a row for each pivot
        counts[r["p"]] = r["n"]
    blocks = np.maximum(1, -(-counts // block))

    def post(batch: pa.RecordBatch) -> Iterator[list]:
        lists = np.stack(batch.column("list").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, m), np.int64)
        own = _spread(np.asarray(batch.column("c")))[:, None] % blocks[lists].astype(np.uint64)
        for j in range(m):
            p, mine = lists[:, j], own[:, j].astype(np.int64)
            at = np.repeat(np.arange(len(p)), blocks[p])
            other = np.concatenate([np.arange(b) for b in blocks[p]]) if len(p) else at
            one, two = np.minimum(mine[at], other), np.maximum(mine[at], other)
            taken = batch.take(pa.array(at))
            yield [pa.array(p[at].astype(np.int64)), pa.array(one), pa.array(two), taken.column("c"), taken.column("n"), pa.array((mine[at] == two).astype(np.int64)), taken.column("list"), taken.column("v")]

    def compare(group: pa.Table) -> pa.Table:
        c, count, side = (np.asarray(group.column(x)) for x in ("c", "n", "side"))
        pivot, same = group.column("pivot")[0].as_py(), group.column("one")[0].as_py() == group.column("two")[0].as_py()
        v = unit(matrix(group.column("v")))
        lists = np.stack(group.column("list").combine_chunks().to_numpy(zero_copy_only=False)).astype(np.int64)
        bits = np.zeros((len(c), words), np.uint64)
        for j in range(m):
            bits[np.arange(len(c)), lists[:, j] >> 6] |= np.uint64(1) << (lists[:, j] & 63).astype(np.uint64)
        left, right = (np.arange(len(c)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        shared = sum(np.bitwise_count(bits[left, None, w] & bits[None, right, w]).astype(np.int16) for w in range(words))
        i, j = np.nonzero((shared >= shared_pivots) & (v[left] @ v[right].T >= least - 1e-9))
        i, j = left[i], right[j]
        keep = i < j if same else i >= 0
        i, j = i[keep], j[keep]
        exact = np.concatenate([(v[i[s : s + 65536]] * v[j[s : s + 65536]]).sum(axis=1) for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        keep = exact >= least
        i, j = i[keep], j[keep]
        below = np.zeros(words, np.uint64)
        below[: pivot >> 6] = ~np.uint64(0)
        below[pivot >> 6] = (np.uint64(1) << np.uint64(pivot & 63)) - np.uint64(1)
        keep = ~((bits[i] & bits[j] & below) > 0).any(axis=1)
        i, j = i[keep], j[keep]
        links = np.bincount(i, weights=count[j], minlength=len(c)) + np.bincount(j, weights=count[i], minlength=len(c))
        root = c[_local_components(len(c), i, j)]
        some = links > 0
        return pa.table([pa.array(c[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["c", "links", "root"])

    found = written(emit(described, T.StructType([*longs("pivot", "one", "two", "c", "n", "side").fields, *described_as]), post).groupBy("pivot", "one", "two").applyInArrow(compare, longs("c", "links", "root")), "links")
    label = written(components(found, "c", "root").select(F.col("node").alias("c"), "component"), "labels")
    per_class = classes.select("c", "n").join(found.groupBy("c").agg(F.sum("links").alias("links")), "c", "left").join(label, "c", "left")
    per_class = per_class.select("c", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "c").alias("label"))
    placed = written(alone.where("ok").join(per_class, "c").select("vec_id", "n_links", "label"), "placed")
    least_id = placed.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least_id, "label").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionAll(lone)
