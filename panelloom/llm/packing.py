"""Best-fit packing of documents into sequences by exact-complement hashing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as tk
from .tasks import emit, longs, written


class SumIndex:
    """Which lengths are left, and which sums of two lengths that are left exist."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64).copy()
        self.have = self.left > 0
        self.pairs = np.convolve(self.have.astype(np.int64), self.have.astype(np.int64))[: len(counts)]

    def take(self, lengths: Counter, times: int) -> None:
        for length, k in lengths.items():
            self.left[length] -= k * times
            if not self.left[length] and self.have[length]:
                # The sums with this length go: once for its double, twice (both orders) for the others.
                size = len(self.left)
                others = np.flatnonzero(self.have[: size - length])
                self.pairs[others + length] -= 2
                if 2 * length < size:
                    self.pairs[2 * length] += 1
                self.have[length] = False

    def _free(self, length: int, used: Counter) -> int:
        return int(self.left[length]) - used[length]

    def fill(self, gap: int, used: Counter) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly, with the longest first; None if there are none.

        used: what the sequence holds already, which isn't available any more.
        """
        if self._free(gap, used) > 0:
            return [gap]
        if self.pairs[gap] > 0 and (pair := self._pair(gap, used)):
            return pair
        firsts = np.flatnonzero(self.have[1:gap] & (self.pairs[gap - 1 : 0 : -1] > 0)) + 1
        for a in firsts[::-1].tolist():
            if 3 * a < gap:
                break
            if self._free(a, used) > 0 and (pair := self._pair(gap - a, used + Counter([a]))):
                return [a, *pair]
        return None

    def _pair(self, total: int, used: Counter) -> list[int] | None:
        half = np.arange((total + 1) // 2, total)
        for a in half[self.have[half] & self.have[total - half]][::-1].tolist():
            if self._free(a, used) >= 1 + (2 * a == total) and self._free(total - a, used) > 0:
                return [a, total - a]
        return None

    def best_fit(self, gap: int, used: Counter) -> int | None:
        """The longest length that is left and not longer than the gap."""
        for length in np.flatnonzero(self.have[: gap + 1])[::-1].tolist():
            if self._free(length, used) > 0:
                return length
        return None


def pack_lengths(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, number of sequences) that use every piece.

    counts[n]: pieces of length n, for n up to size. From the longest length down: while a combination
    of one, two or three other lengths fills the gap exactly, it is consumed as often as the counts
    allow; what has no such combination takes the longest piece that fits, and so on. Every step uses up
    a length or halves what is left of one, so there are at most a few thousand patterns whatever the
    number of pieces.
    """
    index, out = SumIndex(counts), []
    for length in range(size, 0, -1):
        while index.left[length] > 0:
            pattern, used, gap = [length], Counter([length]), size - length
            while gap > 0:
                more = index.fill(gap, used) or ([x] if (x := index.best_fit(gap, used)) else None)
                if not more:
                    break
                pattern += more
                used.update(more)
                gap -= sum(more)
            times = min(int(index.left[n]) // k for n, k in used.items())
            index.take(used, times)
            out.append((pattern, times))
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and task and ordinal: the number of the task and of the
    piece among those of its length in that task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for rows, ids, at in tk.encode_slices(batch, tokenizer, end_id):
                own, out = rows.column("doc_id").to_pylist(), []
                for d, a, b in zip(own, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    first = (b - a) % size or size
                    bounds = [0, *range(first, b - a + 1, size)]
                    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        out.append((d, k, lo, hi - lo, tk.crc32(ids[a + lo : a + hi]), task, int(seen[hi - lo])))
                        seen[hi - lo] += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(7)], schema.names)
        tk.release()

    schema = longs("doc_id", "piece", "start", "length", "ids_crc32", "task", "ordinal")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """Every document's pieces with the sequence and the place that they get.

    A document is its ids and then end_id; a longer one than size is cut into pieces of size, the first
    of which may be shorter. Tasks number the pieces of each length, Spark adds these numbers up to
    ranks, and the patterns, made from the counts of at most `size` lengths, say where each rank goes.
    A null or empty text is the end_id alone; rows with the same or a null id are packed each for
    itself; an empty table gives an empty one; other columns are ignored.
    """
    table = written(pieces(docs, tokenizer, end_id, size), "pieces")
    by_task = table.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    counts = np.zeros(size + 1, np.int64)
    for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most size rows
        counts[r["length"]] = r["n"]
    keys, bases, places, given, base = [], [], [], Counter(), 0
    for pattern, times in pack_lengths(counts, size):
        place = 0
        for length in pattern:
            keys.append((length << 48) + given[length])
            bases.append(base - given[length])
            places.append(place)
            given[length] += times
            place += length
        base += times
    order = np.argsort(np.array(keys, np.int64))
    keys, bases, places = (np.array(x, np.int64)[order] for x in (keys, bases, places))

    def assign(batch: pa.RecordBatch) -> Iterator[list]:
        length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
        run = np.searchsorted(keys, (length << 48) + rank, "right") - 1
        yield [*(batch.column(c) for c in names[:5]), pa.array(bases[run] + rank), pa.array(places[run])]

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ranked = table.join(offsets.select("task", "length", "before"), ["task", "length"]).select(*names[:5], (F.col("before") + F.col("ordinal")).alias("rank"))
    return emit(ranked, longs(*names), assign)
