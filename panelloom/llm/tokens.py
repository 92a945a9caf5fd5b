"""Token ids of whole texts with the tokenizers library, word by word with a bounded memo.

Both byte-level tokenizers used here split a text into words before they merge, and never across the
places where units are cut here: before ASCII white space that follows something else, after a single
line feed, and before ASCII punctuation (but the apostrophe) that follows an ASCII letter or digit. So
the ids of a text are those of its units, and a unit that was met before needn't be encoded again.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa

from . import textbytes as tb

_SPACE = ~tb.NOT_SPACE
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True
_SOLID = np.zeros(256, bool)  # bytes after which white space can be cut off, but for the ends of non-ASCII spaces
_SOLID[[*range(0x21, 0x7F), *range(0x80, 0x100)]] = True
_PLAIN = np.zeros(256, bool)  # bytes that surely start something other than white space
_PLAIN[[*range(0x21, 0x7F), 0xC3]] = True
#: A unit of ASCII and Latin-1 letters only, perhaps after a space: one word for both tokenizers.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _byte_alphabet() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of units: of each text that isn't empty, and the places named above."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n:
        cut[1:] = _SPACE[data[1:]] & _SOLID[data[:-1]]
        # Non-ASCII white space ends in C2 85, C2 A0, or is of three bytes that start with E1-E3.
        after = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
        two = np.where(after >= 2, data[after - 2], 0)
        three = np.where(after >= 3, data[after - 3], 0)
        cut[after[(two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))]] = False
        line = np.flatnonzero(cut & (data == 0x0A)) + 1
        line = line[line < n]
        cut[line[_PLAIN[data[line]]]] = True
        cut[1:] |= _PUNCTUATION[data[1:]] & _WORD[data[:-1]]
        cut[ends[:-1][np.diff(ends) > 0]] = True
    return np.flatnonzero(cut)


class UnitMemo:
    """Ids of units by the units' hashes: a direct-mapped table over a pool, both of a fixed size."""

    def __init__(self, bits: int = 22, pool: int = 1 << 24) -> None:
        self.bits, self.size = bits, pool
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.zeros(1 << bits, np.int32)
        self.n = np.zeros(1 << bits, np.int32)
        self.pool = np.zeros(pool, np.uint32)
        self.used = 0

    def ids(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """All units' ids, one after the other, and how many each has. make(places) encodes the units at
        these places, which are new, into their ids and counts."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, n, pool = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64), self.pool
        missing = np.flatnonzero(self.keys[slot] != keys)
        if len(missing):
            new, first, where = np.unique(keys[missing], return_index=True, return_inverse=True)
            flat, count = make(missing[first])
            begin = np.cumsum(count) - count
            if self.used + len(flat) <= self.size:
                pool[self.used : self.used + len(flat)] = flat
                begin += self.used
                self.used += len(flat)
                slots = (new >> np.uint64(64 - self.bits)).astype(np.int64)
                self.keys[slots], self.at[slots], self.n[slots] = new, begin, count
            else:  # full: this slice reads from a longer copy, the next ones start anew
                pool = np.concatenate([pool, flat])
                begin += self.size
                self.used = 0
                self.keys[:] = 0
            at[missing], n[missing] = begin[where], count[where]
        return pool[tb.gather_ranges(at, n)], n


def flattened(ids: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for own in ids for i in own), np.uint32, int(n.sum())), n


class Encoder:
    """Encodes slices of texts; one per Python worker and tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # units are ordinary text; texts with a special token's string go whole
        self.path, self.whole = path, None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Whether case and white space are dropped: then a unit is looked up without them.
        self.folds = self._ids([" A\n b"]) == self._ids(["a  B "])
        self.memo = UnitMemo()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit. The library's model takes a unit of letters as it is; the others go through
        its normalizer and splitter too."""
        ids: list[list[int]] = [[]] * len(units)
        merge, other = self.tokenizer.model.tokenize, []
        for i, unit in enumerate(units):
            if _LETTERS.fullmatch(unit):
                if self.folds:
                    unit = unit.decode().strip().lower().encode()
                text = unit.decode("latin-1")
                ids[i] = [t.id for t in merge(text.replace(" ", "Ġ") if text.isascii() else text.translate(_ALPHABET))]
            else:
                other.append(i)
        for i, own in zip(other, self._ids([units[i].decode("utf-8", "replace") for i in other]), strict=True):
            ids[i] = own
        return flattened(ids)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's texts, one after the other, and the n + 1 offsets: those of the library, which takes a
        special token's string in a text for that token."""
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return self._by_units(data, ends)
        parts = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if any(s in raw[a:b] for s in self.special):
                parts.append(self._whole(raw[a:b].decode("utf-8", "replace")))
            else:
                parts.append(self._by_units(data[a:b], np.array([0, b - a]))[0])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def _whole(self, text: str) -> np.ndarray:
        if self.whole is None:
            self.whole = type(self.tokenizer).from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _by_units(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = cuts(data, ends)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        stops = np.append(starts[1:], len(data))
        key_data, key_starts = data, starts
        if self.folds:
            key_data, key_starts = tb.LOWER[data], starts + _SPACE[data[starts]]
        raw = data.tobytes()
        ids, n = self.memo.ids(tb.hashes(key_data, key_starts, stops), lambda at: self._encode([raw[a:b] for a, b in zip(key_starts[at].tolist(), stops[at].tolist(), strict=True)]))
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, ends)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release() -> None:
    """Give the encoders' memory back at a task's end: the worker may go on to other work."""
    _encoders.clear()


def encode_slices(batch: pa.RecordBatch, path: str, end_id: int, text: str = "text"):
    """For each slice: its rows, all ids with end_id after each text, and the offsets."""
    e = encoder(path)
    for part, data, ends in tb.slices(batch, text, 1 << 19):
        ids, at = e.encode(data, ends)
        n = part.num_rows
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
        yield part, out, at + np.arange(n + 1)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
