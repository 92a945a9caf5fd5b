"""Token files with directly addressable codes: any token can be read without decoding a block."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from . import tokens as tk
from .tasks import emit, longs, shared_dir, written

MAGIC = b"PLDAC01\0"
WIDTH = 8
_RANK_BYTES = 64  # a rank directory entry for every 512 continuation bits
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def _rank_directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each run of _RANK_BYTES bytes."""
    pad = np.zeros(-len(bits) % _RANK_BYTES, np.uint8)
    per = _ONES[np.concatenate([bits, pad])].reshape(-1, _RANK_BYTES).sum(axis=1) if len(bits) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(per)]).astype("<i8")


def encode(ids: np.ndarray, doc_ids: list[int | None], n_tokens: np.ndarray) -> bytes:
    """A file: header, document directory, then each level's chunks, continuation bits and ranks.

    An id is cut into chunks of 8 bits, lowest first. Level k holds chunk k of the ids that have one;
    a bit beside it says whether the id goes on, and the number of set bits before it is the id's place
    in the next level.
    """
    levels, rest = [], np.asarray(ids, np.uint64)
    while True:
        more = rest >> np.uint64(WIDTH) > 0
        bits = np.packbits(more, bitorder="little")
        levels.append(((rest & np.uint64(0xFF)).astype(np.uint8), bits, _rank_directory(bits)))
        if not more.any():
            break
        rest = rest[more] >> np.uint64(WIDTH)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    out = [MAGIC, struct.pack("<qqq", len(doc_ids), len(ids), len(levels)), known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.concatenate([[0], np.cumsum(n_tokens)]).astype("<i8").tobytes()]
    for chunks, bits, ranks in levels:
        out += [struct.pack("<qqq", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class TokenFile:
    """Reads a file's bytes. token(i) and tokens(a, b) touch only the chunks they need."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        at = 8
        n_docs, self.n_ids, n_levels = struct.unpack_from("<qqq", raw, at)
        at += 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        known, ids, self.starts = take("u1", n_docs), take("<i8", n_docs), take("<i8", n_docs + 1)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, ids, strict=True)]
        self.levels = []
        for _ in range(n_levels):
            sizes = struct.unpack_from("<qqq", raw, at)
            at += 24
            self.levels.append((take("u1", sizes[0]), take("u1", sizes[1]), take("<i8", sizes[2])))

    def _rank(self, level: int, i: int) -> int:
        """Set continuation bits before place i."""
        _, bits, ranks = self.levels[level]
        byte = i >> 3
        run = byte // _RANK_BYTES
        rank = int(ranks[run]) + int(_ONES[bits[run * _RANK_BYTES : byte]].sum())
        return rank + (int(_ONES[bits[byte] & ((1 << (i & 7)) - 1)]) if i & 7 else 0)

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def tokens(self, a: int, b: int) -> np.ndarray:
        if not 0 <= a <= b <= self.n_ids:
            raise IndexError((a, b))
        out, places, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a >= b:
                break
            out[places] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            places = places[more]
            if not len(places):
                break
            a = self._rank(level, a)
            b, shift = a + len(places), shift + WIDTH
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for k, d in enumerate(self.doc_ids):
            yield d, int(self.starts[k]), self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, tokenizer: str, end_id: int, where: str | None = None, file_ids: int = 1 << 22) -> tuple[str, DataFrame]:
    """Encode all texts and write token files in ascending doc_id order to a folder that all executors share.

    Spark deals the rows out by doc_id ranges and sorts them; each task writes files of about file_ids
    ids under names of its own and returns them, so what a lost or repeated attempt has left is never
    read. Returns the folder and the manifest: file, part, number, n_docs, n_ids and start, the ids of
    all files before. Null ids come first; rows with the same id are ordered by their text; a null text
    is empty; an empty table has no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = where or f"{shared_dir(spark)}/panelloom-tokens-{uuid.uuid4().hex}"
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        part, number, ids, keys, sizes, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            store.create_dir(base, recursive=True)
            name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.dac"
            raw = encode(np.concatenate(ids), keys, np.array(sizes, np.int64))
            with store.open_output_stream(f"{base}/.{name}") as f:
                f.write(raw)
            store.move(f"{base}/.{name}", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, part, number, len(keys), held)], ["file", "part", "number", "n_docs", "n_ids"])

        for batch in batches:
            for rows, flat, at in tk.encode_slices(batch, tokenizer, end_id):
                ids.append(flat)
                keys += rows.column("doc_id").to_pylist()
                sizes += np.diff(at).tolist()
                held += len(flat)
                if held >= file_ids:
                    yield flush()
                    number, ids, keys, sizes, held = number + 1, [], [], [], 0
        if keys:
            yield flush()

    schema = T.StructType([T.StructField("file", T.StringType()), *longs("part", "number", "n_docs", "n_ids").fields])
    files = written(ordered.mapInArrow(run, schema), "manifest")
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return folder, files.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """Read the manifest's files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], longs("doc_id", "start", "n_tokens", "ids_crc32"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = [(d, s, len(ids), tk.crc32(ids)) for d, s, ids in TokenFile(content.as_buffer().to_pybytes()).documents()]
            yield [pa.array([name.as_py()] * len(rows)), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))]

    schema = T.StructType([T.StructField("file", T.StringType()), *longs("doc_id", "local", "n_tokens", "ids_crc32").fields])
    return emit(raw, schema, work).join(manifest.select("file", F.col("start").alias("before")), "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
