"""Licence scan by an exact set-similarity join between text blocks and licence templates."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tasks import annotate

#: Phrases of the contract with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short statements of public licences, with a label each.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

MATCHES = T.ArrayType(T.StructType([T.StructField("template", T.IntegerType()), T.StructField("block_word", T.LongType()), T.StructField("containment", T.DoubleType())]))
NEW = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())]
    + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("matches", MATCHES)]
)
_ARROW_MATCHES = pa.list_(pa.struct([("template", pa.int32()), ("block_word", pa.int64()), ("containment", pa.float64())]))


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(tb.hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


class _Vocabulary:
    """Tokens that templates or phrases hold; a word's token is its place here, or -1."""

    def __init__(self, texts: list[str]) -> None:
        self.words = sorted({w for t in texts for w in t.split()})
        self.of = {w: i for i, w in enumerate(self.words)}
        keys = np.array([_hash_of(w) for w in self.words], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def tokens(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token of each word of a slice and the word's text number."""
        data = tb.LOWER[data]
        starts, stops, text = tb.words(data, ends, tb.ALNUM)
        found = tb.hashes(data, starts, stops)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return np.where(self.keys[at] == found, self.order[at], -1), text


def token_counts(docs: DataFrame, vocabulary: _Vocabulary) -> dict[int, int]:
    """How often each token of the vocabulary stands in all texts: tasks count, Spark adds."""

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for _, data, ends in tb.slices(batch):
            tokens, _ = vocabulary.tokens(data, ends)
            total += np.bincount(tokens[tokens >= 0], minlength=len(total))
        keep = np.flatnonzero(total)
        if len(keep):
            yield batch.slice(0, len(keep)), [pa.array(keep, pa.int64()), pa.array(total[keep])]

    counted = annotate(docs, T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())]), work, [])
    return {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


class _Templates:
    """Templates as token lists in the order of global frequency, with their prefixes."""

    def __init__(self, templates: tuple, vocabulary: _Vocabulary, counts: dict[int, int], threshold: float) -> None:
        self.labels = [label for label, _ in templates]
        self.rank = np.empty(len(vocabulary.words), np.int64)
        self.rank[sorted(range(len(vocabulary.words)), key=lambda t: (counts.get(t, 0), vocabulary.words[t]))] = np.arange(len(vocabulary.words))
        self.sets = [sorted({int(self.rank[vocabulary.of[w]]) for w in text.split()}) for _, text in templates]
        self.need = [max(1, ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for k, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for place, token in enumerate(s[: len(s) - need + 1]):
                self.prefixes.setdefault(token, []).append((k, place))

    def matches(self, block: np.ndarray) -> list[tuple[int, float]]:
        """Templates of which the block holds enough tokens. block: its distinct ranks, ascending."""
        tried, out = set(), []
        held = None
        for at, token in enumerate(block.tolist()):
            for k, place in self.prefixes.get(token, ()):
                if k in tried:
                    continue
                tried.add(k)
                size, need = len(self.sets[k]), self.need[k]
                # The length filter, and the positional one: what can still follow in both lists.
                if len(block) < need or 1 + min(size - place - 1, len(block) - at - 1) < need:
                    continue
                held = set(block.tolist()) if held is None else held
                shared = sum(t in held for t in self.sets[k])
                if shared >= need:
                    out.append((k, shared / size))
        return out


def scan(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9, block_words: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Licence statements in every text.

    Blocks are the windows of block_words words that start at each multiple of half as many, so any run
    of up to half as many words lies whole in a block. A block matches a template if it holds at least
    the threshold's share of the template's distinct words. Words of the templates are ordered by their
    frequency in all texts, rarest first; a block is compared only if it holds a word of the template's
    prefix, and only if the length and positional filters allow enough common words. The filters lose
    nothing, so the result is that of comparing every block with every template.

    Adds n_words, n_base (places of the phrases), first_word, last_word (null without a phrase),
    base_labels, labels (comma-joined, empty if none), score (1 with a phrase, else the largest
    containment that reached the threshold, else 0) and matches. A null text counts as empty; rows are
    never merged, so repeated rows give repeated results; an empty table gives an empty one; other
    columns are ignored unless carried.
    """
    vocabulary = _Vocabulary([*phrases, *(text for _, text in templates)])
    ready = _Templates(templates, vocabulary, token_counts(docs, vocabulary), threshold)
    lists = [([vocabulary.of[w] for w in p.split()], label) for p, label in phrases.items()]
    hot = np.zeros(len(vocabulary.words) + 1, bool)
    for r in ready.prefixes:
        hot[np.flatnonzero(ready.rank == r)] = True
    longest = max((len(text.split()) for _, text in templates), default=0)
    block_words = block_words or max(48, 2 * longest)  # any run of as many words as a template has lies in a block
    half = block_words // 2

    def one_slice(data: np.ndarray, ends: np.ndarray) -> list:
        n = len(ends) - 1
        tokens, text = vocabulary.tokens(data, ends)
        first_of = np.searchsorted(text, np.arange(n + 1))
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        for seq, label in lists:
            k = len(seq)
            if len(tokens) < k:
                continue
            hit = text[: len(tokens) - k + 1] == text[k - 1 :]
            for j, t in enumerate(seq):
                hit = hit & (tokens[j : len(tokens) - k + 1 + j] == t)
            for i in np.flatnonzero(hit).tolist():
                d = int(text[i])
                places[d].append(i - int(first_of[d]))
                base[d].add(label)
        # Blocks that hold a word of some prefix.
        rare = np.flatnonzero(hot[tokens])
        number = (rare - first_of[text[rare]]) // half
        blocks = {(int(d), int(x)) for d, x in zip(text[rare], number, strict=True)}
        blocks |= {(d, x - 1) for d, x in blocks if x}
        found: list[list[dict]] = [[] for _ in range(n)]
        for d, x in sorted(blocks):
            lo = int(first_of[d]) + x * half
            own = tokens[lo : min(lo + block_words, int(first_of[d + 1]))]
            for k, share in ready.matches(np.unique(ready.rank[own[own >= 0]])):
                found[d].append({"template": k, "block_word": x * half, "containment": share})
        labels = [",".join(sorted(b | {ready.labels[m["template"]] for m in f})) for b, f in zip(base, found, strict=True)]
        score = [1.0 if p else max((m["containment"] for m in f), default=0.0) for p, f in zip(places, found, strict=True)]
        return [
            pa.array(np.diff(first_of).astype(np.int64)),
            pa.array([len(p) for p in places], pa.int64()),
            pa.array([min(p) if p else None for p in places], pa.int64()),
            pa.array([max(p) if p else None for p in places], pa.int64()),
            pa.array([",".join(sorted(b)) for b in base], pa.string()),
            pa.array(labels, pa.string()),
            pa.array(score, pa.float64()),
            pa.array(found, _ARROW_MATCHES),
        ]

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        for part, data, ends in tb.slices(batch):
            yield part, one_slice(data, ends)

    return annotate(docs, NEW, work, carry or ["doc_id"])
