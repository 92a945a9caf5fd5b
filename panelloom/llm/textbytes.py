"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

Tasks get whole Arrow batches; these helpers cut them into slices of a bounded number of bytes and
find words and hash them with NumPy, so no Python string is made for a word. A text that is longer
than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 18

#: Words of op 1: everything but ASCII white space. Words of op 10: ASCII letters, digits, all non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


BYTE_VALUE = _table(20_240_501)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for at least n places."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 65_536)
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, U64(base))
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    parts = column.buffers()
    ends = np.frombuffer(parts[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(parts[2], np.uint8)[ends[0] : ends[-1]] if parts[2] is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch with at most so many bytes of text, and rows, with the text's bytes and offsets."""
    data, ends = buffers(batch.column(text))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        to = min(to, row + rows) if rows else to
        yield batch.slice(row, to - row), data[ends[row] : ends[to]], ends[row : to + 1] - ends[row]
        row = to


def words(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of the bytes that table marks."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(ends[1:], starts, "right")


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the range stands.

    A polynomial in a fixed odd base over random byte values, taken from running sums, then mixed
    with the length. Two different words get the same value with a chance of about 2**-64.
    """
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingles(word_hash: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of all runs of k words; a shorter text is one shingle of all its words."""
    n = len(word_hash)
    count = np.bincount(text, minlength=n_texts)
    rolled, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    if n >= k:
        rolled = np.zeros(n - k + 1, U64)
        for j in range(k):
            rolled = rolled * U64(_BASE) + word_hash[j : n - k + 1 + j]
        keep = text[: n - k + 1] == text[k - 1 :]
        rolled, owner = mix(rolled[keep]), text[: n - k + 1][keep]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.concatenate([[0], np.cumsum(count)])
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):  # word j of every short text that has so many
            has = count[short] > j
            extra[has] = extra[has] * U64(_BASE) + word_hash[at[short[has]] + j]
        rolled, owner = np.concatenate([rolled, mix(extra ^ U64(0xA5A5A5A5) * count[short].astype(U64))]), np.concatenate([owner, short])
    return rolled, owner


def distinct(values: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, one text after the other, and the n + 1 offsets."""
    order = np.argsort(owner, kind="stable") if len(owner) and (owner[1:] < owner[:-1]).any() else None
    if order is not None:
        values, owner = values[order], owner[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_texts))]).astype(np.int64)
    values = values.copy()
    for i in range(n_texts):
        values[at[i] : at[i + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n_texts))]).astype(np.int64)


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all given ranges, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
