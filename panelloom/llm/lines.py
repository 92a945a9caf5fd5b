"""Line dedup by pairwise patience alignment with the earlier documents that share runs of lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tasks import annotate, emit, written

_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def line_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of words, place and text number of each line that holds a word.

    A line's hash is that of its words, so white space at its ends and between words doesn't count.
    Places count all lines of the text, from 0.
    """
    starts, stops, text = tb.words(data, ends, tb.NOT_SPACE)
    breaks = np.concatenate([[0], np.cumsum(_NEWLINE[data])])
    place = breaks[starts] - breaks[ends[text]]
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    first = np.ones(len(starts), bool)
    first[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(starts)))
    # Each word is hashed with its place in the line; the line is the mixed sum.
    within = np.arange(len(starts)) - np.repeat(at, size)
    word = tb.mix(tb.hashes(data, starts, stops) + within.astype(np.uint64) * tb.U64(0x9E3779B97F4A7C15))
    return tb.mix(np.add.reduceat(word, at) + size.astype(np.uint64)), size, place[at], text[at]


def _increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (i, j), ascending in i, with ascending j: patience sorting."""
    tops, at, back = [], [], [-1] * len(places)
    for n, (_, j) in enumerate(places):
        pile = bisect_left(tops, j)
        back[n] = at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[pile], at[pile] = j, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(places[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i in a, j in b) of equal lines, ascending in both.

    Lines that are unique in both pieces are aligned by their longest increasing subsequence; between
    them the same is done anew, and equal lines at the ends of a piece are always aligned.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        n_a, n_b = Counter(a[lo:hi]), Counter(b[low:high])
        where = {x: j for j, x in enumerate(b[low:high], low) if n_b[x] == 1 and n_a.get(x) == 1}
        found = _increasing([(i, where[a[i]]) for i in range(lo, hi) if a[i] in where])
        if found:
            out += found
            edges = [(lo - 1, low - 1), *found, (hi, high)]
            todo += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], least_words: int) -> list[int]:
    """Places of b in aligned blocks, runs that are contiguous in both, of at least so many words."""
    out: list[int] = []
    block: list[tuple[int, int]] = []
    for pair in [*patience(a, b), (-9, -9)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[j] for _, j in block) >= least_words:
                out += [j for _, j in block]
            block = []
        block.append(pair)
    return out


_SEQUENCE = T.StructType(
    [T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("n_lines", T.LongType())]
)


def _sequences(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the text's sequence of lines that hold a word."""

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        for part, data, ends in tb.slices(batch):
            hash_, size, place, text = line_hashes(data, ends)
            at = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
            breaks = np.concatenate([[0], np.cumsum(_NEWLINE[data])])
            n_lines = np.where(np.diff(ends) > 0, breaks[ends[1:]] - breaks[ends[:-1]] + 1, 0)
            yield part, [pa.ListArray.from_arrays(at, pa.array(x)) for x in (hash_.view(np.int64), size.astype(np.int32), place.astype(np.int32))] + [pa.array(n_lines, pa.int64())]

    return annotate(docs, _SEQUENCE, work, ["doc_id", "text_key"])


def runs(hashes: np.ndarray, words: np.ndarray, at: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line, number of lines and text of the shortest runs of lines with so many words.

    They are the shortest from each line on and the shortest up to each line, within the texts that end at
    at[1:]. Every line of a block of least_words words or more lies in such a run that lies in the block.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    here = np.arange(len(hashes))
    stop = np.searchsorted(total, total[:-1] + least_words)
    start = np.searchsorted(total, total[1:] - least_words, "right") - 1
    on, upto = stop <= at[1:][text], start >= at[:-1][text]
    both = np.unique(np.stack([np.concatenate([here[on], start[upto]]), np.concatenate([stop[on], here[upto] + 1])], axis=1), axis=0)
    first, size = both[:, 0], both[:, 1] - both[:, 0]
    key = size.astype(np.uint64)
    for i in range(int(size.max(initial=0))):  # a line has a word, so least_words at most
        more = np.flatnonzero(size > i)
        key[more] += tb.mix(hashes[first[more] + i] + tb.U64((i * 0x9E3779B97F4A7C15) % 2**64))
    return tb.mix(key), first - at[text[first]], size, text[first]


_RUN = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("run", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType())])


def _runs(heads: DataFrame, least_words: int) -> DataFrame:
    """doc_id, text_key, run, at (its first line among those that hold a word) and size of every run."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        hashes, words = batch.column("lines"), batch.column("words")
        ends = np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        key, first, size, text = runs(hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), words.flatten().to_numpy(zero_copy_only=False), ends, least_words)
        yield [batch.column("doc_id").take(pa.array(text)), batch.column("text_key").take(pa.array(text)), pa.array(key.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))]

    return emit(heads.select("doc_id", "text_key", "lines", "words"), _RUN, work)


def _openings(heads: DataFrame, asking: DataFrame) -> DataFrame:
    """doc_id, text_key and opening: what lets patience align two texts at all, of texts that share one with an asking text.

    That is a line that stands once in each, the same first line, or the same last line.
    """

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        rows, values = [], []
        for i, lines in enumerate(batch.column("lines").to_pylist()):
            if lines:
                own = np.array(lines, np.int64).view(np.uint64)
                value, n = np.unique(own, return_counts=True)
                found = np.unique(tb.mix(np.concatenate([value[n == 1], [own[0] + tb.U64(1)], [own[-1] + tb.U64(2)]])))
                rows.append(np.full(len(found), i)), values.append(found.view(np.int64))
        at = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64))
        yield [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int64))]

    schema = T.StructType([heads.schema["doc_id"], heads.schema["text_key"], T.StructField("opening", T.LongType())])
    every = emit(heads.select("doc_id", "text_key", "lines"), schema, work)
    asked = every.join(asking, ["doc_id", "text_key"], "left_semi").select("opening").distinct()
    held = every.groupBy("opening").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("opening").join(asked, "opening", "left_semi")
    return every.join(held, "opening", "left_semi").select("doc_id", "text_key", "opening")


def _align(pairs: DataFrame, heads: DataFrame, least_words: int) -> DataFrame:
    """doc_id, text_key, first_id and at, the lines of the document in its common blocks with the first."""
    with_a = pairs.join(heads.select(F.col("doc_id").alias("first_id"), F.col("lines").alias("a")), "first_id")
    rows = with_a.join(heads.select("doc_id", "text_key", F.col("lines").alias("b"), "words"), ["doc_id", "text_key"])

    def align(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        out = []
        for a, b, words in zip(*(batch.column(c) for c in ("a", "b", "words")), strict=True):
            a, b, words = (x.values.to_numpy().tolist() for x in (a, b, words))
            out.append(common_blocks(a, b, words, least_words))
        yield batch.select(["doc_id", "text_key", "first_id"]), [pa.array(out, pa.list_(pa.int32()))]

    sent = rows.select("doc_id", "text_key", "first_id", "a", "b", "words")
    schema = T.StructType([sent.schema[c] for c in ("doc_id", "text_key", "first_id")] + [T.StructField("at", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, columns in align(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema.names)

    return sent.mapInArrow(run, schema).where(F.size("at") > 0)


def removals(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """doc_id, text_key, n_lines, removed (places of lines) and earlier (doc_ids) of every distinct document.

    A document is a doc_id with a text; it comes after those with a smaller doc_id. Exact copies of a
    text but the first are common blocks as a whole; only distinct texts go on. Blocks of at least
    least_words words that a document has in common with any earlier one are removed. A pair is found by
    the runs of lines that both hold (see runs). A document is first aligned with the first holder of each
    of its runs, then, for runs of which a line is left, with the first that holds the run as often, and
    then with a growing share of the earlier holders, at last with all that are left, of those that share a
    line that could be aligned first (see _openings). A pair that isn't aligned has no run of which a line is left,
    or nothing that patience could align, so the result is that of aligning all pairs.
    """
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    seqs = written(_sequences(keyed).dropDuplicates(["doc_id", "text_key"]), "lines")
    first = seqs.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    marked = seqs.select("doc_id", "text_key").join(first, "text_key")
    copies = marked.where("doc_id > first_id and text_key is not null")
    heads = written(seqs.join(marked.where("doc_id = first_id").select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi"), "heads")
    every = _runs(heads, least_words)
    shared = every.groupBy("run").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    own = written(every.join(shared.select("run", "first_id"), "run"), "runs")
    counted = own.groupBy("run", "doc_id", "text_key").agg(F.count("*").alias("n"))
    # Two texts with one doc_id can't be told apart by order, so they aren't aligned with each other.
    left = own.where("doc_id > first_id")
    by_count = counted.groupBy("run", "n").agg(F.min("doc_id").alias("other_id"))
    key, pair = ["doc_id", "text_key"], ["doc_id", "text_key", "first_id"]

    opened = None

    def further(left: DataFrame, share: int) -> DataFrame:
        """Pairs with the holders of a run that also share an opening: without one patience aligns nothing."""
        nonlocal opened
        opened = written(_openings(heads, left.select(*key).distinct()), "openings") if opened is None else opened
        holders = own.select("run", F.col("doc_id").alias("other_id")).distinct().where(F.pmod(F.xxhash64("other_id"), F.lit(share)) == 0)
        theirs = holders.join(opened.select(F.col("doc_id").alias("other_id"), "opening"), "other_id")
        ours = left.select("run", *key).distinct().join(opened, key)
        return ours.join(theirs.distinct(), ["run", "opening"])

    rounds = [
        lambda left: left.select(*key, F.col("first_id").alias("other_id")),
        lambda left: left.select("run", *key).distinct().join(counted, ["run", *key]).join(by_count, ["run", "n"]),
        *(lambda left, share=share: further(left, share) for share in (64, 8, 1)),
    ]
    tried = found = None
    for candidates in rounds:
        pairs = candidates(left).where("other_id < doc_id").select(*key, F.col("other_id").alias("first_id")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, pair, "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionAll(pairs)
        now = written(_align(pairs, heads, least_words), "blocks")
        found = now if found is None else found.unionAll(now)
        gone = now.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))
        covered = F.size(F.array_except(F.sequence("at", F.col("at") + F.col("size") - 1), F.coalesce("gone", F.array().cast("array<int>")))) == 0
        # A run whose lines went in different rounds is kept for the next one, which costs a pair and loses none.
        left = written(left.join(gone, key, "left").where(~covered).drop("gone"), "left")
        if left.isEmpty():
            break
    cut = found.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.sort_array(F.collect_set("first_id")).alias("earlier"))
    cut = cut.join(heads.select(*key, "places"), key).select(*key, F.sort_array(F.transform("at", lambda j: F.get("places", j))).alias("removed"), "earlier")
    whole = copies.join(seqs.select("doc_id", "text_key", "places"), ["doc_id", "text_key"]).select("doc_id", "text_key", F.col("places").alias("removed"), F.array("first_id").alias("earlier"))
    return seqs.select("doc_id", "text_key", "n_lines").join(cut.unionAll(whole), ["doc_id", "text_key"], "left")


def dedup(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """All rows and columns of docs, the text without the removed lines; and n_lines, n_removed, earlier.

    earlier: the doc_ids of the documents that hold what was removed. Lines are parted by line feeds; a
    line without a word is never removed by itself. A null text stays null with 0 lines; a row with a null
    doc_id is neither changed nor compared; repeated rows are one document and change alike; an empty
    table gives an empty one. Columns of docs named like the new ones are replaced.
    """
    new = ("n_lines", "n_removed", "earlier")
    found = written(removals(docs, least_words), "removals")
    # Every column but these two gets a name of its own, so none can be taken for one of ours.
    own = {c: c if c in ("doc_id", "text") else f"_kept{i}" for i, c in enumerate(docs.columns) if c not in new}
    kept = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())).withColumn("_id", F.col("doc_id").cast("long")).withColumn("_key", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    facts = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_lines", "removed", "earlier")
    joined = kept.join(facts, ["_id", "_key"], "left").drop("_id", "_key")
    left = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("removed", i))
    text = F.when(F.size("removed") > 0, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text")
    columns = [text if c == "text" else F.col(n).alias(c) for c, n in own.items()]
    return joined.select(*columns, F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("earlier", F.array().cast("array<bigint>")).alias("earlier"))
