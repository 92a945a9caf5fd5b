"""Maximal periodic runs of words: tiles for each octave of periods, solved alone and stitched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tasks import annotate, emit, longs, written

_LEAST_BLOCK = 8
_FLUSH = 1 << 20  # bytes of tiles that a task holds before it sends them on
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "period", "length")])
_FRAGMENT = longs("key", "period", "lo", "hi")


def boundaries(h: np.ndarray, min_words: int, min_periods: int) -> Iterator[tuple[int, int]]:
    """(block, place): where the block of words at a multiple of its length recurs at a distance of its octave.

    The octave of a block of b words is [b, 2b), for the least block [1, 2b). A run of at least min_periods
    (3 or more) periods has so many words that equal the one a period later that they hold a whole block, so
    each run has a boundary in the list for each block that it covers.
    """
    n, size, window = len(h), 1, h
    while size < _LEAST_BLOCK and size < len(window):
        window, size = tb.mix(window[:-size] * tb.U64(0x9E3779B97F4A7C15) + window[size:]), 2 * size
    while n >= max(min_words, min_periods * size) and len(window) > size:
        rows = -(-(len(window) - size) // size)
        ahead = np.zeros(rows * size, tb.U64)
        ahead[: len(window) - size] = window[size:]
        hit = (ahead.reshape(rows, size) == window[: rows * size : size, None]).any(axis=1)
        if size == _LEAST_BLOCK:
            grid = window[::size]
            wide = np.zeros(len(grid), bool)
            wide[:rows] = hit
            for q in range(1, size):
                later = window[q::size]
                wide[: len(later)] |= grid[: len(later)] == later
            hit = wide
        for j in np.flatnonzero(hit).tolist():
            yield size, j * size
        if len(window) <= 2 * size:
            return
        window, size = tb.mix(window[:-size] * tb.U64(0x9E3779B97F4A7C15) + window[size:]), 2 * size


def z_function(s: list) -> list[int]:
    """z[i]: how many items from i on equal those from 0 on; z[0] is the whole length."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(words: list[int], left: int, block: int) -> list[tuple[int, int, int]]:
    """(period, lo, hi): around the boundary at `left`, the places lo..hi-1 whose words equal the one a period later.

    For every period of the octave under which the block at the boundary recurs; up to a block to the left and
    two to the right of it, where the neighbouring boundaries go on.
    """
    right = words[left:]
    ahead = z_function(right)
    before = words[:left][::-1]
    behind = z_function([*before, -1, *words[: left + 2 * block][::-1]])
    shown = min(len(words), left + 2 * block)
    out = []
    for q in range(1 if block == _LEAST_BLOCK else block, min(2 * block, len(right))):
        forward = min(ahead[q], 2 * block)
        if forward >= block:
            back = min(behind[left + 1 + shown - left - q], left) if left else 0
            out.append((q, left - back, left + forward))
    return out


def _tiles_of(docs: DataFrame, min_words: int, min_periods: int) -> DataFrame:
    """Tiles of all texts, and the texts (words joined by one space) that have tiles; key names a row's text."""
    kind = docs.schema["doc_id"].dataType
    new = T.StructType([*longs("key").fields, T.StructField("doc_id", kind), T.StructField("text", T.StringType()), *longs("at", "left", "block").fields, T.StructField("words", T.BinaryType())])

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        doc_type = batch.schema.field("doc_id").type
        rows: list[tuple] = []
        held = 0

        def flush() -> list:
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), doc_type, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            rows.clear()
            return columns

        for part, data, ends in tb.slices(batch):
            starts, stops, text = tb.words(data, ends, tb.NOT_SPACE)
            h = tb.hashes(data, starts, stops)
            first = np.searchsorted(text, np.arange(part.num_rows + 1))
            keys, ids = part.column("key").to_pylist(), part.column("doc_id").to_pylist()
            for i in np.flatnonzero(np.diff(first) >= min_words).tolist():
                own, any_tile = h[first[i] : first[i + 1]], False
                for block, c in boundaries(own, min_words, min_periods):
                    lo = max(0, c - block)
                    tile = np.unique(own[lo : c + 4 * block], return_inverse=True)[1].astype("<i4").tobytes()
                    rows.append((keys[i], None, None, lo, c - lo, block, tile))
                    any_tile, held = True, held + len(tile)
                    if held >= _FLUSH:
                        yield flush()
                        held = 0
                if any_tile:
                    words = b" ".join(data[ends[i] : ends[i + 1]].tobytes().split()).decode()
                    rows.append((keys[i], ids[i], words, None, None, None, None))
                    held += len(words)
            if held >= _FLUSH:
                yield flush()
                held = 0
        if rows:
            yield flush()

    return written(emit(docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text"), new, work), "tiles")


def _fragments(tiles: DataFrame) -> DataFrame:
    """Tiles dealt anew, so that those of a long text are solved by many tasks."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        out = []
        for key, at, left, block, words in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "left", "block", "words")), strict=True):
            out += [(key, q, at + lo, at + hi) for q, lo, hi in solve_tile(np.frombuffer(words, "<i4").tolist(), left, block)]
        yield [pa.array([r[j] for r in out], pa.int64()) for j in range(4)]

    return emit(tiles.select("key", "at", "left", "block", "words").repartition("key", "block", "at"), _FRAGMENT, work)


def stitch(fragments: DataFrame, min_words: int, min_periods: int) -> DataFrame:
    """key and runs: overlapping or touching fragments of a text and period are one; a stretch found under several
    periods has the smallest. Runs are ordered by start, then period."""
    own = Window.partitionBy("key", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1))
    apart = fragments.withColumn("begins", (F.coalesce(F.col("lo") > reach, F.lit(True))).cast("long"))
    whole = apart.withColumn("island", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    runs = whole.select("key", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length"), "period").where((F.col("length") >= min_words) & (F.col("length") >= min_periods * F.col("period")))
    least = runs.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    return least.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def _collapsed(found: DataFrame) -> DataFrame:
    """Texts without the words of a run behind its first period."""
    new = T.StructType([*longs("n_words").fields, T.StructField("collapsed", T.StringType())])

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        counts, texts = [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            words = text.split(" ") if text else []
            keep = np.ones(len(words), bool)
            for r in runs:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
            counts.append(len(words))
            texts.append(" ".join(words[i] for i in np.flatnonzero(keep).tolist()))
        yield batch, [pa.array(counts, pa.int64()), pa.array(texts, pa.string())]

    return annotate(found, new, work, ["doc_id", "runs"])


def runs(docs: DataFrame, min_words: int = 24, min_periods: int = 3) -> DataFrame:
    """doc_id, n_words, runs and collapsed: the maximal periodic runs of every text's words.

    A run is a stretch of words with the smallest period q, words q apart being equal, of at least
    max(min_words, min_periods * q) words, that can't be made longer at either end. runs has start (word
    number from 0), period and length, ordered by start and period; collapsed is the text without the words
    of any run behind its first q, its words joined by one space.

    Every text is cut into tiles for each octave of periods, around boundaries whose block of words recurs at
    a distance of that octave; a tile is solved by two Z-functions at its boundary, apart from all others, and
    the fragments of a text and period are stitched. Tiles of one text are solved by many tasks. Only texts
    with tiles are shuffled; the others are read a second time and never leave their task.

    Words are what stands between ASCII white space. A null or empty text has no words and an empty collapsed
    text; rows are never merged, so repeated rows give repeated results; a null doc_id stays null; other
    columns are ignored; an empty table gives an empty one. min_words is 24 or more and min_periods 3 or more.
    """
    if min_words < 3 * _LEAST_BLOCK or min_periods < 3:
        raise ValueError(f"runs of at least {3 * _LEAST_BLOCK} words and 3 periods are found")
    docs = docs.select("doc_id", "text")
    rows = _tiles_of(docs, min_words, min_periods)
    found = stitch(_fragments(rows.where("text is null")), min_words, min_periods)
    none = F.array().cast(T.ArrayType(RUN))
    with_tiles = rows.where("text is not null").select("key", "doc_id", "text").join(found, "key", "left").withColumn("runs", F.coalesce("runs", none))

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        for part, data, ends in tb.slices(batch):
            starts, stops, text = tb.words(data, ends, tb.NOT_SPACE)
            h = tb.hashes(data, starts, stops)
            first = np.searchsorted(text, np.arange(part.num_rows + 1))
            n = np.diff(first)
            keep = [i for i in range(part.num_rows) if n[i] < min_words or next(boundaries(h[first[i] : first[i + 1]], min_words, min_periods), None) is None]
            texts = [b" ".join(data[ends[i] : ends[i + 1]].tobytes().split()).decode() for i in keep]
            yield part.take(pa.array(keep, pa.int64())), [pa.array(n[keep].astype(np.int64)), pa.array(texts, pa.string())]

    plain = annotate(docs, T.StructType([*longs("n_words").fields, T.StructField("collapsed", T.StringType())]), work, ["doc_id"])
    columns = ("doc_id", "n_words", "runs", "collapsed")
    return plain.withColumn("runs", none).select(*columns).unionAll(_collapsed(with_tiles).select(*columns))
