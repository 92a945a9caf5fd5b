"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are banded by size so that two sets with enough similarity are in one band or in
neighbouring ones. For each band the similarity bounds the symmetric difference by K. The hashed feature
domain is cut into n1 parts of n2 subparts each; some part then holds at most k2 = 1 differing feature,
so some subset of n2 - k2 of its subparts is equal in both sets. A set signs with every such subset of
every part, for its own band and for the next one, so that similar sets always share a signature.

More parts than needed make them share several, so a set may leave out its most frequent ones: with r in
common, two sets still have one in common without the r - 1 most frequent of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tasks import components, emit, longs, written

K2 = 1
_FLUSH = 1_000_000
_SMALL, _WIDE = 8, 32
_WIDE_FROM = 512  # larger sets have sketches of _WIDE longs or more
_BLOCK = 64
#: A join with so many ids at most is a broadcast (about 50 bytes each in memory), with more a shuffle.
_FEW = 2_000_000


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice, and the offsets."""
    data = tb.LOWER[data]
    starts, stops, text = tb.words(data, ends, tb.NOT_SPACE)
    values, owner = tb.shingles(tb.hashes(data, starts, stops), text, len(ends) - 1, k)
    return tb.distinct(values, owner, len(ends) - 1)


def set_hash(values: np.ndarray) -> int:
    """A set's own hash, as a signed long."""
    n = np.array([len(values)], np.uint64)
    with np.errstate(over="ignore"):
        return int(tb.mix(tb.mix(values ^ tb.U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + n).view(np.int64)[0])


@lru_cache(maxsize=4096)
def bands(percent: int, upto: int) -> tuple[tuple[int, int], ...]:
    """Size bands (least, most), from size 1 until a band holds upto."""
    out, low = [], 1
    while not out or out[-1][1] < upto:
        out.append((low, low * 100 // percent))
        low = out[-1][1] + 1
    return tuple(out)


Layer = tuple[int, int, int, np.ndarray]


@lru_cache(maxsize=4096)
def scheme(percent: int, band: int) -> tuple[Layer, ...]:
    """The layers (n1, n2, slack, constants) with which sets of a band and of the one below it sign.

    Empty if sets of these sizes are similar enough only if they are equal. slack: so many parts more than
    needed that most sets have no more parts than these of which some subset is empty. The second layer
    has one subpart more in a part, so larger subsets, for the sets that have more such parts.
    """
    limits = bands(percent, 1)
    while len(limits) <= band:
        limits = bands(percent, limits[-1][1] + 1)
    low, high = limits[max(band - 1, 0)][0], limits[band][1]
    most = 2 * high * (100 - percent) // (100 + percent)
    if not most:
        return ()
    out, base = [], most // (K2 + 1) + 1
    for layer, n2 in enumerate((3, 4) if high < 128 else (2, 3)):
        slack = _slack(base, n2, low)
        n1, subsets = base + slack, comb(n2, K2)
        out.append((n1, n2, slack, tb.mix(np.arange(n1 * subsets, dtype=np.uint64) + tb.U64((band + 1) << 32 | layer << 30)).reshape(n1, subsets)))
    return tuple(out)


def _slack(base: int, n2: int, low: int) -> int:
    """The least slack that exceeds the mean number of parts with an empty subset by 2.5 deviations, or a
    third of base where more parts only make more empty ones."""
    for slack in range(base + 1):
        n1 = base + slack
        weak = min(n1, n1 * comb(n2, K2) * exp(-low / n1 * (n2 - K2) / n2))
        if slack >= weak + 2.5 * sqrt(weak):
            return slack
    return max(1, base // 3)


def signatures(values: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """PartEnum signatures of a set, by band and layer. values: its sorted distinct 64-bit features.

    With each layer comes how many of its signatures the set shares at least with a similar one that has
    the layer. slack + 1 parts have at most k2 differing features, so a subset in common; a part of which
    some subset is empty counts as lost. A set with more than slack such parts signs in the next layer
    too, where it meets others like it; in the last one, empty subsets have signatures as well.
    """
    if not len(values):
        return []
    band, out = len(bands(percent, len(values))) - 1, []
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(tb.mix(values), out=sums[1:])
    for b in (band, band + 1):
        layers = scheme(percent, b)
        for n1, n2, slack, constants in layers:
            # Subparts are equal ranges of the hash's upper half, so each is a run of the sorted values.
            subpart = (values >> np.uint64(32)) * tb.U64(n1 * n2) >> np.uint64(32)
            at = np.searchsorted(subpart, np.arange(n1 * n2 + 1, dtype=np.uint64))
            count, total = np.diff(at).reshape(n1, n2), (sums[at[1:]] - sums[at[:-1]]).reshape(n1, n2)
            chosen = list(combinations(range(n2), n2 - K2))
            has = np.stack([count[:, c].sum(axis=1) > 0 for c in chosen], axis=1)
            sign = tb.mix(np.stack([total[:, c].sum(axis=1) for c in chosen], axis=1) + constants)
            weak = int((~has.all(axis=1)).sum())
            if weak <= slack:
                out.append((sign[has], 1 + slack - weak))
                break
            out.append((sign.ravel() if constants is layers[-1][-1] else sign[has], 1))
    return out


def parity_sketch(values: np.ndarray) -> np.ndarray:
    """A bitmap of at least 2 bits a feature, a power of two of them and 512 at least, in which each feature
    flips the bit that its hash's upper part names."""
    bits = max(9, int(2 * max(len(values), 1) - 1).bit_length())
    odd = np.bincount((values >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of two sets' symmetric difference, from their sketches: a feature that both have flips
    a bit twice, so every bit that is left comes from a feature of one of them."""
    while len(a) > len(b):
        a = _folded(a)
    while len(b) > len(a):
        b = _folded(b)
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())  # of signed numbers it would count the absolute value


def _folded(x: np.ndarray) -> np.ndarray:
    """The sketch of half the size: neighbouring bits become their parity."""
    bits = np.unpackbits(x.view(np.uint8), bitorder="little")
    return np.packbits(bits[0::2] ^ bits[1::2], bitorder="little").view(np.int64)


def cut_sketch(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of at most so many longs."""
    while len(sketch) > size:
        sketch = _folded(sketch)
    return sketch


def _node(docs: DataFrame) -> Column:
    """What stands for a row: its doc_id, or a hash of its text where that is null."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("node")


def sets(docs: DataFrame, k: int) -> DataFrame:
    """node, doc_id, n_shingles and h, the set's hash; h is null for an empty set."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        for part, data, ends in tb.slices(batch):
            values, at = shingle_sets(data, ends, k)
            h = [set_hash(values[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            yield [part.column("node"), part.column("doc_id"), pa.array(np.diff(at)), pa.array(h, pa.int64())]

    return emit(docs.select(_node(docs), F.col("doc_id").cast("long"), "text"), longs("node", "doc_id", "n_shingles", "h"), work)


def sketched(texts: DataFrame, k: int) -> DataFrame:
    """node, h, n_shingles and the sketch of the texts' sets."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        for part, data, ends in tb.slices(batch):
            values, at = shingle_sets(data, ends, k)
            own = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            sketches = pa.array([parity_sketch(v) for v in own], pa.list_(pa.int64()))
            yield [part.column("node"), pa.array([set_hash(v) for v in own], pa.int64()), pa.array(np.diff(at)), sketches]

    return emit(texts, T.StructType([*longs("node", "h", "n_shingles").fields, T.StructField("sketch", T.ArrayType(T.LongType()))]), work)


def bucket_edges(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, a, b): for every signature that several sets share, a star that joins all of them.

    Each task first joins the sets that it has itself and sends one of each of its buckets on, so a
    signature of very many sets sends as many rows as there are tasks. These are sorted by signature and
    joined to the first one, as they stream by. Equal sets are one and never make an edge.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        size, seen = 0, set()

        def flush() -> pa.RecordBatch:
            sig = np.concatenate([s for s, _ in held])
            node = np.repeat(np.array([n for _, n in held], np.int64), [len(s) for s, _ in held])
            order = np.argsort(sig, kind="stable")
            sig, node = sig[order], node[order]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            leader = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
            keep = first | (node != leader)
            return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)[keep]), pa.array(node[keep]), pa.array(leader[keep], mask=first[keep])], ["sig", "node", "leader"])

        for batch in batches:
            for _, data, ends in tb.slices(batch):
                values, at = shingle_sets(data, ends, k)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = values[a:b]
                    if a == b or (h := set_hash(own)) in seen:
                        continue
                    seen.add(h)
                    signed = [sig for sig, _ in signatures(own, percent)]
                    held.append((np.concatenate(signed) if signed else np.zeros(0, np.uint64), h))
                    size += len(held[-1][0])
                if size > _FLUSH:
                    yield flush()
                    held, size, seen = [], 0, set()
        if held:
            yield flush()

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig, last_leader = None, 0
        for batch in batches:
            sig, node = np.asarray(batch.column("sig")), np.asarray(batch.column("node"))
            if not len(sig):
                continue
            local = np.asarray(batch.column("leader").is_valid())
            given = np.asarray(batch.column("leader").fill_null(0))
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            first[0] = sig[0] != last_sig
            at = np.maximum.accumulate(np.where(first, np.arange(len(sig)), -1))
            leader = np.where(at >= 0, node[at], last_leader)
            last_sig, last_leader = sig[-1], leader[-1]
            # A local edge stands among the rows of other signatures; its own leader was sent apart.
            a = np.where(local, given, leader)
            edge = local | (node != leader)
            yield pa.RecordBatch.from_arrays([pa.array(x[edge]) for x in (sig, a, node)], ["sig", "a", "b"])

    signed = docs.select("text").mapInArrow(sign, longs("sig", "node", "leader"))
    dealt = signed.repartition(F.when(F.col("leader").isNull(), F.xxhash64("sig")).otherwise(F.xxhash64("node", "leader")))
    return dealt.sortWithinPartitions(F.col("leader").isNotNull(), "sig", "node").mapInArrow(star, longs("sig", "a", "b"))


def possible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Of pairs (ha, hb), those whose sizes and sketches allow enough similarity, with both sets' nodes."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        n = batch.num_rows
        na, nb = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
        most = (na + nb) * (100 - percent) // (100 + percent)
        left, right = batch.column("s_a"), batch.column("s_b")
        keep = np.fromiter((least_difference(left[i].values.to_numpy(), right[i].values.to_numpy()) <= most[i] for i in range(n)), bool, n)
        yield [batch.column(c).filter(pa.array(keep)) for c in ("ha", "hb", "node_a", "node_b")]

    side = lambda x: info.select(F.col("h").alias(f"h{x}"), F.col("node").alias(f"node_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "ha").join(side("b"), "hb").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return emit(both.select("ha", "hb", "node_a", "node_b", "n_a", "n_b", "s_a", "s_b"), longs("ha", "hb", "node_a", "node_b"), work)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (ha, hb, node_a, node_b), (ha, hb) of those similar enough, by the sets of both texts."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        sizes = np.cumsum(np.diff(tb.buffers(batch.column("ta"))[1]) + np.diff(tb.buffers(batch.column("tb"))[1]))
        row = 0
        while row < batch.num_rows:  # pieces of bounded size
            before = int(sizes[row - 1]) if row else 0
            to = max(row + 1, int(np.searchsorted(sizes, before + tb.SLICE_BYTES, "right")))
            piece = batch.slice(row, to - row)
            row = to
            (va, at_a), (vb, at_b) = (shingle_sets(*tb.buffers(piece.column(c)), k) for c in ("ta", "tb"))
            linked = []
            for i, (ha, hb) in enumerate(zip(piece.column("ha").to_pylist(), piece.column("hb").to_pylist(), strict=True)):
                a, b = va[at_a[i] : at_a[i + 1]], vb[at_b[i] : at_b[i + 1]]
                if set_hash(a) == ha and set_hash(b) == hb:
                    both = np.concatenate([a, b])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        linked.append((ha, hb))
            yield [pa.array([x[j] for x in linked], pa.int64()) for j in range(2)]

    left = texts.select(F.col("node").alias("node_a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("node_b"), F.col("text").alias("tb"))
    return emit(pairs.join(left, "node_a").join(right, "node_b").select("ha", "hb", "ta", "tb"), longs("ha", "hb"), work).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("ha"), F.greatest("a", "b").alias("hb")).where("ha < hb").distinct()


def _labels(links: DataFrame) -> DataFrame:
    return components(links, "ha", "hb").select(F.col("node").alias("h"), "component")


def _open(rows: DataFrame) -> DataFrame:
    """Rows with a sig and a label of the buckets that hold several labels, and the bucket's size."""
    mixed = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    return rows.join(mixed.select("sig", "size"), "sig")


_OPEN = T.StructType([*longs("sig", "size", "h", "n_shingles", "label").fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("small", "wide"))])


def rarest(rows: DataFrame, one_of: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows of mixed buckets (sig, h, label, size) that are needed, with the sets' sizes and sketches.

    Each set leaves out its most frequent signatures of each layer, one fewer than it must share with a
    similar set. Buckets are ordered by their size and signature, for all sets alike, so of the signatures
    that two similar sets share the rarest one stays in both.
    """

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        row = 0
        for part, data, ends in tb.slices(batch):
            values, at = shingle_sets(data, ends, k)
            for i in range(part.num_rows):
                h, label, held = (batch.column(c)[row].as_py() for c in ("h", "label", "held"))
                row += 1
                own = values[at[i] : at[i + 1]]
                if set_hash(own) != h:  # another text of this doc_id
                    continue
                place = {x["sig"]: (x["size"], x["sig"]) for x in held}
                kept: list[tuple[int, int]] = []
                for signed, shared in signatures(own, percent):
                    mine = sorted((place[x] for x in signed.view(np.int64).tolist() if x in place), reverse=True)
                    kept += mine[shared - 1 :]
                if kept:
                    full = parity_sketch(own)
                    wide = cut_sketch(full, _WIDE) if len(own) > _WIDE_FROM else full[:0]
                    yield [*(pa.array([x[j] for x in kept], pa.int64()) for j in (1, 0)), *(pa.array([x] * len(kept), pa.int64()) for x in (h, len(own), label)), *(pa.array([x] * len(kept), pa.list_(pa.int64())) for x in (cut_sketch(full, _SMALL), wide))]

    held = rows.groupBy("h").agg(F.first("label").alias("label"), F.collect_list(F.struct("sig", "size")).alias("held"))  # a set's own signatures
    named = held.join(one_of.select("h", "node"), "h").join(texts, "node")
    return emit(named.select("h", "label", "held", "text"), _OPEN, work)


def near_in_buckets(rows: DataFrame, percent: int) -> DataFrame:
    """(ha, hb) of different labels in one bucket whose sizes and sketches allow enough similarity.

    A bucket whose size is over _BLOCK is cut into hashed blocks, and each pair of its blocks is a group
    of its own, so no task gets a whole bucket. Groups stream by in order of their keys.
    """

    def pairs(t: pa.Table) -> pa.RecordBatch:
        sig, one, two, own, h, n, label = (np.asarray(t.column(c)) for c in ("sig", "one", "two", "own", "h", "n_shingles", "label"))
        small = t.column("small").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, _SMALL)
        wide = t.column("wide").combine_chunks()
        has_wide = wide.value_lengths().to_numpy(zero_copy_only=False) > 0
        at_wide = np.cumsum(has_wide) - 1
        wide = wide.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, _WIDE)
        group = np.cumsum(np.concatenate([[0], _changes(sig, one, two)]))
        ha, hb = [h[:0]], [h[:0]]
        for d in range(1, len(h)):
            i = np.flatnonzero(group[d:] == group[:-d])
            if not len(i):
                break
            j = i + d
            fits = (label[i] != label[j]) & ((one[i] == two[i]) | (own[i] != own[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[fits], j[fits]
            most = (n[i] + n[j]) * (100 - percent) // (100 + percent)
            fits = np.bitwise_count(small[i] ^ small[j]).sum(axis=1) <= most
            both = np.flatnonzero(fits & has_wide[i] & has_wide[j])
            fits[both] = np.bitwise_count(wide[at_wide[i[both]]] ^ wide[at_wide[j[both]]]).sum(axis=1) <= most[both]
            ha.append(h[i[fits]])
            hb.append(h[j[fits]])
        a, b = np.concatenate(ha), np.concatenate(hb)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["ha", "hb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            ends = np.flatnonzero(_changes(*(np.asarray(t.column(c)) for c in ("sig", "one", "two")))) + 1
            last = int(ends[-1]) if len(ends) else 0
            if last:
                yield pairs(t.slice(0, last))
            held = t.slice(last)  # the last group may go on
        if held is not None and held.num_rows:
            yield pairs(held)

    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("h"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(*(c for c in _OPEN.names if c != "size"), "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    return dealt.repartition("sig", "one", "two").sortWithinPartitions("sig", "one", "two").mapInArrow(run, longs("ha", "hb")).distinct()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row's columns differ from those of the row before, from the second row on."""
    return np.any([c[1:] != c[:-1] for c in columns], axis=0)


def links_between_sets(docs: DataFrame, info: DataFrame, k: int, percent: int) -> DataFrame:
    """Enough verified links (ha, hb) to give the components of all links.

    Every bucket is joined as a star and the star's pairs are verified. In buckets that hold several
    components then, all sets are compared with the one that shares most buckets, the likeliest original
    of near copies, and labels that get linked so become one. What still has different labels in a bucket is
    compared pair by pair, but for the signatures that sets can do without (see rarest). A pair is left out
    only if both sets are in one component anyway, or if their sizes or sketches show that they can't be
    linked.
    """
    edges = written(bucket_edges(docs, k, percent), "buckets")
    members = edges.select(F.col("a").alias("h")).unionAll(edges.select(F.col("b").alias("h"))).distinct()
    named = info.where("h is not null").groupBy("h").agg(F.min("node").alias("node")).join(members, "h", "left_semi")
    named = written(named, "members")
    nodes = named.select("node").distinct()
    few = nodes.limit(_FEW + 1).count() <= _FEW
    texts = written(docs.select(_node(docs), "text").join(F.broadcast(nodes) if few else nodes.hint("shuffle_hash"), "node", "left_semi"), "texts")
    one_of = written(sketched(texts, k).join(named, ["node", "h"], "left_semi").dropDuplicates(["h"]), "classes")
    seen = written(_ordered(edges), "pairs")
    check = lambda pairs: written(verified(possible(pairs, one_of, percent), texts, k, percent), "links")
    links = check(seen)
    label = one_of.select("h").join(_labels(links), "h", "left").select("h", F.coalesce("component", "h").alias("label"))
    label = written(label, "labels")
    side = lambda x: label.select(F.col("h").alias(f"h{x}"), F.col("label").alias(f"l{x}"))
    apart = seen.join(side("a"), "ha").join(side("b"), "hb").where("la <> lb").select("ha", "hb")
    sigs = edges.withColumns({"ha": F.least("a", "b"), "hb": F.greatest("a", "b")}).join(apart, ["ha", "hb"], "left_semi").select("sig").distinct()
    stars = edges.join(sigs, "sig", "left_semi")
    rows = stars.select("sig", F.col("a").alias("h")).unionAll(stars.select("sig", F.col("b").alias("h"))).distinct()
    rows = written(rows.join(label, "h").select("sig", "h", "label"), "open")
    # The set that shares most buckets with others leads each of its buckets.
    size = rows.groupBy("sig").agg(F.count("*").alias("size"))
    shared = rows.join(size, "sig").groupBy("h").agg(F.sum("size").alias("shared"))
    leader = rows.join(shared, "h").groupBy("sig").agg(F.max(F.struct("shared", "h", "label")).alias("top"))
    star = rows.join(leader, "sig").where("label <> top.label").select(F.col("h").alias("a"), F.col("top.h").alias("b"))
    pairs = written(_ordered(star).join(seen, ["ha", "hb"], "left_anti"), "pairs")
    more = check(pairs)
    # What the second star linked takes one label: the components of the labels that its links join.
    joined = more.join(side("a"), "ha").join(side("b"), "hb").select("la", "lb")
    moved = components(joined, "la", "lb").select(F.col("node").alias("label"), F.col("component").alias("to"))
    rows = rows.join(moved, "label", "left").select("sig", "h", F.coalesce("to", "label").alias("label"))
    rows = written(rarest(_open(rows), one_of, texts, k, percent), "open")
    rest = near_in_buckets(rows, percent).join(seen.unionAll(pairs), ["ha", "hb"], "left_anti")
    return links.unionAll(more).unionAll(check(written(rest, "pairs")))


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, by links of Jaccard percent/100 or more.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set is a text's distinct shingles
    of k words, or all words of a shorter text. The join is exact, up to equal 64-bit hashes.
    An empty or null text has no set and is its own component. Rows of equal sets are linked, repeated
    rows among them; a null doc_id takes part but never names a component (null if all its ids are). An
    empty table gives an empty one. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    info = written(sets(docs, k), "sets")
    final = _labels(links_between_sets(docs, info, k, percent))
    named = info.where("h is not null").select("doc_id", "n_shingles", "h").join(final, "h", "left").select("doc_id", "n_shingles", F.coalesce("component", "h").alias("label"))
    named = written(named, "named")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    lone = info.where("h is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.join(least, "label").select("doc_id", "n_shingles", "component_id").unionAll(lone)
