"""Spelling variants: words that differ by one edit, found in bit-sliced position indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tasks import emit, written

U64 = np.uint64
#: Letters are a-z and U+00C0 to U+00FF; code 0 is the place behind a word's end.
_LETTERS = 27 + 64
_CODE = np.zeros(256, np.uint8)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODE[0xC0:] = np.arange(27, _LETTERS)
_WORD_COUNT = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
_NEAR = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_near", T.LongType()), T.StructField("form", T.StringType()), T.StructField("form_n", T.LongType())])


# --- words and their counts ---------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each byte range, continued from a crc32 of what stands before it."""
    order = np.argsort(starts - stops, kind="stable")  # longest first
    at, left = starts[order], (stops - starts)[order]
    crc = ~state[order].astype(np.uint32)
    live = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")  # how many are longer than j
    for j, n in enumerate(live.tolist()):
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def _marks(data: np.ndarray) -> np.ndarray:
    """The bytes of letters: of ASCII, and of U+00C0 to U+00FF (0xC3 and the byte behind it)."""
    lead = data == 0xC3
    inside = lead | ((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x61) & (data <= 0x7A))
    inside[1:] |= lead[:-1]
    return inside


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    marked = _marks(data).view(np.uint8)
    return tb.words(marked, ends, np.arange(256) == 1)


def _without(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copies of byte ranges, each without the bytes at..at+width, as new bytes with starts and stops."""
    two = np.stack([starts, at + width], axis=1).reshape(-1)
    n = np.stack([at - starts, stops - at - width], axis=1).reshape(-1)
    out = data[tb.gather_ranges(two, n)]
    ends = np.cumsum(n.reshape(-1, 2).sum(axis=1))
    return out, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, drop_every: int | None = None) -> DataFrame:
    """word and n: the runs of letters of all whole texts, A-Z lower-cased, of at least so many letters and occurrences.

    With drop_every, where that divides h, the unsigned crc32 of `<doc_id>:<run>`, the run loses its letter
    number h modulo its length; a null doc_id loses none. Tasks add up each batch before Spark does.
    """

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        seen: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        for part, data, ends in tb.slices(batch):
            data = tb.LOWER[data]
            starts, stops, text = _runs(data, ends)
            places = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
            first = np.searchsorted(places, starts)
            length = np.searchsorted(places, stops) - first
            keep = length >= least_length
            starts, stops, text, first, length = (x[keep] for x in (starts, stops, text, first, length))
            groups = [(data, starts, stops)]
            if drop_every:
                ids = part.column("doc_id")
                key_data, key_ends = tb.buffers(pa.array([f"{d}:" if d is not None else "" for d in ids.to_pylist()], pa.string()))
                zero = np.zeros(part.num_rows, np.uint32)
                h = crc32_of(data, starts, stops, crc32_of(key_data, key_ends[:-1], key_ends[1:], zero)[text]).astype(np.int64)
                hit = (h % drop_every == 0) & ids.is_valid().to_numpy(zero_copy_only=False)[text]
                groups = [(data, starts[~hit], stops[~hit])]
                hit &= length > least_length
                at = places[(first + h % np.maximum(length, 1))[hit]]
                groups.append(_without(data, starts[hit], stops[hit], at, np.where(data[at] >= 0x80, 2, 1)))
            for own, a, b in groups:
                values, one, n = np.unique(tb.hashes(own, a, b), return_index=True, return_counts=True)
                ends_of = np.concatenate([[0], np.cumsum(b[one] - a[one])]).astype(np.int32)
                raw = own[tb.gather_ranges(a[one], b[one] - a[one])]
                seen.append((values, n, pa.StringArray.from_buffers(len(one), pa.py_buffer(ends_of), pa.py_buffer(raw.tobytes()))))
        if seen:
            _, one, of = np.unique(np.concatenate([v for v, _, _ in seen]), return_index=True, return_inverse=True)
            n = np.bincount(of, weights=np.concatenate([c for _, c, _ in seen]), minlength=len(one)).astype(np.int64)
            yield [pa.concat_arrays([w for _, _, w in seen]).take(pa.array(one)), pa.array(n)]

    return emit(docs.select("doc_id", "text"), _WORD_COUNT, work).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- buckets of words that agree on one side of a place ------------------------------------------


def _buckets(rows: DataFrame, side: str) -> DataFrame:
    """The next split: m, lo and hi say that words of m and m + 1 letters agree in the first lo and the last hi letters.

    One edit between two words of such a bucket lies in the first or in the second half of what is between, so
    they agree in the other half: every pair meets in at least one of the two buckets.
    """
    half = F.floor((F.col("m") - F.col("lo") - F.col("hi")) / 2).cast("int")
    new = {"lo": F.col("lo") + half} if side == "front" else {"hi": F.col("m") - F.col("lo") - half}
    return rows.withColumns(new)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.xxhash64("m", "lo", "hi", F.expr("left(word, lo)"), F.expr("right(word, hi)")))


def meeting(words: DataFrame, least_length: int, most: int) -> DataFrame:
    """word, n, m, lo, hi and bucket: buckets in which all words one edit apart meet, none much larger than `most`.

    Words of L letters stand in the class m = L with those of L + 1 letters, and in the class L - 1. Buckets
    of more than `most` words are split again, until a place of one letter is left, where no bucket is large.
    """
    one = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1))).where(F.col("m") >= least_length)
    rows = one.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    done = None
    while True:
        rows = written(_keyed(_buckets(rows, "front").unionAll(_buckets(rows, "back"))), "buckets")
        large = rows.where("m - lo - hi > 1").groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("bucket")
        large = written(large, "large")
        if large.isEmpty():
            return rows if done is None else done.unionAll(rows)
        settled = rows.join(large, "bucket", "left_anti").select(rows.columns)
        done = settled if done is None else done.unionAll(settled)
        rows = rows.join(large, "bucket", "left_semi").select(rows.columns).drop("bucket")


# --- the index ------------------------------------------------------------------------------------


def letters(words: list[bytes], width: int) -> np.ndarray:
    """Codes of the words' letters, a row a word, 0 behind its end."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), width), np.uint8)
    out[np.arange(width) < n[:, None]] = _CODE[np.frombuffer(b"".join(words), np.uint8)]
    return out


class PositionIndex:
    """Blocks of up to 64 words: at each position and for each letter a bitset of the block's words that have it there."""

    def __init__(self, codes: np.ndarray, block: np.ndarray, slot: np.ndarray, n_blocks: int) -> None:
        self.codes, self.block, self.n_blocks = codes, block, n_blocks
        self.halves = np.where(slot < 32, 2.0**slot, 0), np.where(slot >= 32, 2.0 ** (slot - 32), 0)

    def _bits(self, cell: np.ndarray, cells: int) -> np.ndarray:
        """A bitset for each cell. Words of a block have bits of their own, so sums are unions."""
        low, high = (np.bincount(cell, half, cells).astype(U64) for half in self.halves)
        return low | (high << U64(32))

    def at(self, i: int) -> np.ndarray:
        return self._bits(self.block * _LETTERS + self.codes[:, i], self.n_blocks * _LETTERS)

    def having(self, which: np.ndarray) -> np.ndarray:
        """For each block the words that `which` marks."""
        return self._bits(np.where(which, self.block, self.n_blocks), self.n_blocks + 1)[:-1]

    def near(self, word: np.ndarray, block: np.ndarray, m: np.ndarray, n: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """For each asking word and block of its bucket, the block's words that are exactly one edit away, as a bitset.

        word and block are places here; m, n and cut are of all words of the index. Four sets are carried along
        the letters of all asking words at once: no error, one replaced letter, one letter more in the index (its
        positions run one ahead) and one less (one behind). In a bucket of class m pairs of m and m letters and of
        m and m + 1 letters count. Words that agree in the first cut letters (cut > 0) don't count: they meet in
        another bucket too.
        """
        short, long = self.having(n == m)[block], self.having(n > m)[block]
        zero, none = short | long, np.zeros(len(block), U64)
        replaced, more, less, agree, got = none, none, none, none.copy(), none.copy()
        length, cut, is_short = n[word], cut[word], (n == m)[word]
        row = block * _LETTERS
        behind, here, ahead = None, self.at(0), self.at(1)
        for i in range(int(length.max(initial=0)) + 1):
            np.copyto(agree, zero, where=(cut == i) & (cut > 0))
            ended = length == i
            if ended.any():
                got[ended] = np.where(is_short, (replaced & short) | ((more | zero) & long), less & short)[ended]
            if i + 2 > self.codes.shape[1] - 1:
                continue
            own = row + self.codes[word, i]
            same = here[own]
            less = (less & (behind[own] if i else U64(0))) | zero
            more = (more | zero) & ahead[own]
            replaced = (replaced & same) | (zero & ~same)
            zero = zero & same
            behind, here, ahead = here, ahead, self.at(i + 2)
        return got & ~agree


def _chunks(width: np.ndarray, most_blocks: int = 1024, most_bytes: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Consecutive blocks whose padded letters stay within most_bytes; width: the letters of each block's longest word, ascending."""
    a = 0
    for b in range(1, len(width) + 1):
        if b == len(width) or b - a == most_blocks or (b + 1 - a) * 64 * int(width[b]) > most_bytes:
            yield a, b
            a = b


def near_in_buckets(words: pa.Array, count: np.ndarray, bucket: np.ndarray, m: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many words of its bucket count as near, and the row of the one of largest count (ties: the
    least word; -1 if none). A bucket is cut into blocks of 64 words, and each of its words asks each block."""
    by_word = np.empty(len(words), np.int64)
    by_word[np.array(pc.sort_indices(words))] = np.arange(len(words))
    # Best first: the lowest bit of a block is its best word, and earlier blocks of a bucket have better ones.
    order = np.lexsort((by_word, -count, bucket, m))
    raw = [w.encode("latin-1") for w in words.take(pa.array(order)).to_pylist()]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    bucket, m, hi = bucket[order], m[order], hi[order]
    cut = np.where(hi > 0, m - hi, 0)
    new = np.ones(len(order), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (m[1:] != m[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    per_bucket = -(-size // 64)
    first_block, own_blocks = np.repeat(np.cumsum(per_bucket) - per_bucket, size), np.repeat(per_bucket, size)
    place = np.arange(len(order)) - np.repeat(start, size)
    block = first_block + place // 64
    first_row = np.searchsorted(block, np.arange(int(per_bucket.sum()) + 1))
    total, best = np.zeros(len(order), np.int64), np.full(len(order), -1, np.int64)
    for b, to in _chunks(m[first_row[:-1]] + 3 if len(order) else m):
        # The words that ask blocks b to `to` are those of these blocks' buckets; the index itself holds only the blocks.
        a, z = (int(x) for x in (np.searchsorted(first_block + own_blocks, b, "right"), np.searchsorted(first_block, to)))
        codes = letters(raw[a:z], int(m[z - 1]) + 3)
        inside = (block[a:z] >= b) & (block[a:z] < to)
        index = PositionIndex(codes, np.where(inside, block[a:z] - b, to - b), place[a:z] % 64, to - b + 1)
        low = np.maximum(first_block[a:z], b)
        many = np.minimum(first_block[a:z] + own_blocks[a:z], to) - low
        upto = np.cumsum(many)
        x = 0
        while x < z - a:  # pieces of about 2**18 pairs of a word and a block
            y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + (1 << 18), "right")))
            word, of = np.repeat(np.arange(x, y), many[x:y]), tb.gather_ranges(low[x:y], many[x:y])
            hit = index.near(word, of - b, m[a:z], n[a:z], cut[a:z])
            found = np.flatnonzero(hit)
            word, of, hit = word[found] + a, of[found], hit[found]
            np.add.at(total, word, np.bitwise_count(hit).astype(np.int64))
            lowest = first_row[of] + np.bitwise_count((hit & (~hit + U64(1))) - U64(1)).astype(np.int64)
            seen, one = np.unique(word, return_index=True)
            free = best[seen] < 0
            best[seen[free]] = lowest[one[free]]
            x = y
    counted, chosen = np.zeros(len(order), np.int64), np.full(len(order), -1, np.int64)
    counted[order] = total
    chosen[order] = np.where(best >= 0, order[best], -1)
    return counted, chosen


def _solve(rows: DataFrame, group_rows: int) -> DataFrame:
    """Each word's near words in each of its buckets: how many, and the best. Buckets are put together in groups of about group_rows."""
    n_groups = max(1, -(-rows.count() // group_rows))

    def solve(group: pa.Table) -> pa.Table:
        words = group.column("word").combine_chunks()
        count, bucket, m, hi = (group.column(c).to_numpy() for c in ("n", "bucket", "m", "hi"))
        near, form = near_in_buckets(words, count, bucket, m.astype(np.int64), hi.astype(np.int64))
        has = np.flatnonzero(near)
        of = pa.array(form[has])
        columns = [words.take(pa.array(has)), pa.array(count[has]), pa.array(near[has]), words.take(of), pa.array(count[form[has]])]
        return pa.table(columns, names=_NEAR.names)

    dealt = rows.select("word", "n", "bucket", "m", "hi", F.pmod(F.xxhash64("bucket"), F.lit(n_groups)).alias("grp"))
    return dealt.groupBy("grp").applyInArrow(solve, _NEAR)


def group(words: DataFrame, least_length: int = 7, factor: int = 10, most: int = 4096, group_rows: int = 32768) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word (of letters a-z and U+00C0 to U+00FF) with its count n.

    Near words differ by exactly one inserted, deleted or replaced letter; n_near counts them. form is the near
    word of largest count (ties: the first in code-point order) if its count, form_n, is at least factor times
    the word's own; root follows forms to the last. Words meet in buckets of those that agree on one side of a
    place; a bucket's words are bitsets for each position and letter, and each word runs along them.

    Counts must be positive and words distinct; an empty table gives an empty one.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    found = _solve(meeting(words, least_length, most), group_rows)
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    order = F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))
    summed = own.unionAll(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(order).alias("best"))
    far = -F.col("best.less") >= factor * F.col("n")
    rows = written(summed.select("word", "n", "n_near", F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")), "forms")
    return rows.join(roots(rows.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, for words with a form. Each round doubles how far a word has followed its forms; as counts
    grow by a factor at each step, chains are short."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, factor: int = 10, drop_every: int | None = None) -> DataFrame:
    """Spelling variants among the words of all whole texts; see word_counts and group.

    A null or empty text has no words; a repeated row counts again; other columns are ignored; an empty table
    gives an empty one.
    """
    words = written(word_counts(docs, least_length, least_count, drop_every), "words")
    return group(words, least_length, factor).select("word", "form", "root", "n", "n_near", "form_n")
