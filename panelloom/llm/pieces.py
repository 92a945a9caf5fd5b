"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's pieces are a path through the lattice of all vocabulary pieces that match it. For a unigram
model the path's weight is the sum of its scores. A BPE model's merges give the one path in which every
two neighbours, joined, fall apart into just these two again; so a step between neighbours weighs minus
infinity if they don't. Either way a chunk of a text is a max-plus matrix from the states at its left
edge (pieces that reach over or up to it) to those at its right edge, and matrices combine associatively.

No piece goes across some pairs of characters (such as anything before a space). At such a cut all
states are one, so what stands between two cuts has its own path and is kept in a bounded memo.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tasks import annotate, emit, longs, written
from .tokens import UnitMemo, flattened

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
State = tuple[int, int]  # where a piece starts and ends, from the chunk's edge; (0, 0): the text's start


class Lattice:
    """A model's pieces, the allowed steps between them, and a memo of what stands between cuts."""

    STEPS = 1 << 19

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        # What decoding writes for each id.
        text = [b""] * n
        for piece, i in self.ids.items():
            text[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            text[i] = bytes([b])
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_n = np.array([len(t) for t in text], np.int64)
        self.text_at = np.cumsum(self.text_n) - self.text_n
        # cut[a, b]: no piece holds byte b right after byte a. Only ASCII, and anything before a space.
        self.cut = np.zeros((256, 256), bool)
        self.cut[:128, :128] = True
        self.cut[:, 0x20] = True
        for piece in self.ids:
            raw = piece.replace(SPACE, " ").encode()
            for a, b in zip(raw, raw[1:], strict=False):
                self.cut[a, b] = False
        self.steps: dict[int, bool] = {}
        self.scores = np.array([model.get_score(i) for i in range(n)], np.float64)
        self.memo = UnitMemo(21, 1 << 23)

    def merged(self, text: str) -> list[str]:
        """The merges of a short text: always the best-scored neighbours, the leftmost of equal ones."""
        parts = list(text)
        while True:
            found = [(-self.score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def step(self, a: str, b: str) -> bool:
        """Whether pieces a and b can stand side by side; an empty a: whether b can stand alone. Nothing
        merges with a character that the vocabulary lacks."""
        one, two = self.ids.get(a, -1), self.ids.get(b, -1)
        if two < 0:
            return True
        key = (one + 1) << 32 | two
        known = self.steps.get(key)
        if known is None:
            if len(self.steps) >= self.STEPS:
                self.steps.clear()
            known = self.steps[key] = self.merged(b) == [b] if one < 0 else self.merged(a + b) == [a, b]
        return known

    def matches(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that start here; a character that the vocabulary lacks is a piece of its own."""
        out, end = [], at + 1
        while end <= len(text) and text[at:end] in self.prefixes:
            if text[at:end] in self.ids:
                out.append(end)
            end += 1
        return out if text[at : at + 1] in self.ids else [at + 1, *out]

    def best_paths(self, text: str, entry: State, hi: int, closed: bool) -> dict[State, tuple[float, list[State]]]:
        """From one entry state, the best path to every exit state: pieces that reach hi or over it.

        closed: a cut at hi, so that only pieces that end there count.
        """
        at = {entry: (0.0, None)}
        queue, ends = [entry[1]], {entry[1]: [entry]}
        done: list[State] = []
        while queue:
            p = heapq.heappop(queue)
            here = ends.pop(p)
            if p >= hi:
                done += here
                continue
            matches = self.matches(text, p)
            for state in here:
                value, before = at[state][0], text[state[0] : state[1]]
                for q in matches:
                    if (closed and q > hi) or not self.step(before, text[p:q]):
                        continue
                    new, total = (p, q), value + self.score.get(text[p:q], 0.0)
                    if new not in at:
                        if q not in ends:
                            heapq.heappush(queue, q)
                            ends[q] = []
                        ends[q].append(new)
                    if new not in at or total > at[new][0]:
                        at[new] = (total, state)
        out = {}
        for state in done:
            path, s = [], state
            while s is not None and s != entry:
                path.append(s)
                s = at[s][1]
            out[state] = (at[state][0], path[::-1])
        return out

    def to_ids(self, text: str, path: list[State]) -> list[int]:
        out: list[int] = []
        for a, b in path:
            i = self.ids.get(text[a:b])
            out += [i] if i is not None else [self.bytes[x] for x in text[a:b].encode()]
        return out

    def solve(self, unit: bytes) -> list[int]:
        """Ids of what stands between two cuts, or of a whole text: the best path through a 1 x 1 matrix.

        All steps of a BPE path weigh something finite only if it is the one path that the merges give, so
        the first finite path that a depth-first walk finds is the best one. Longest pieces go first, and
        no piece at one place is tried twice.
        """
        text = unit.decode("utf-8", "replace").replace(" ", SPACE)
        ids, n = self.ids, len(text)
        whole = ids.get(text)
        if whole is not None and self.step("", text):
            return [whole]
        step, matches, tried = self.step, self.matches, set()
        path, todo = [(0, 0)], [matches(text, 0)]
        while path[-1][1] < n:
            ends = todo[-1]
            if not ends:
                path.pop()
                todo.pop()
                continue
            before, p = text[path[-1][0] : path[-1][1]], path[-1][1]
            q = ends.pop()
            if (p, q) in tried:
                continue
            if step(before, text[p:q]):
                tried.add((p, q))
                path.append((p, q))
                todo.append(matches(text, q))
        return self.to_ids(text, path[1:])

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of normalized texts, one after the other, and the n + 1 offsets."""
        cut = np.zeros(len(data), bool)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        cut[1:] = self.cut[data[:-1], data[1:]]
        cut[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(data))
        raw = data.tobytes()
        ids, n = self.memo.ids(tb.hashes(data, starts, stops), lambda at: flattened([self.solve(raw[a:b]) for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]))
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, ends)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts and their offsets: the inverse of encode and of normalized."""
        n = self.text_n[ids]
        total = np.concatenate([[0], np.cumsum(n)])[at]
        data = self.text[tb.gather_ranges(self.text_at[ids], n)]
        lead = np.zeros(len(data), bool)
        filled = total[:-1][np.diff(total) > 0]
        lead[filled] = data[filled] == 0x20
        before = np.concatenate([[0], np.cumsum(lead)])
        return data[~lead], total - before[total]

    # --- chunks of giant texts ---

    def is_cut(self, text: str, i: int) -> bool:
        a, b = text[i - 1].replace(SPACE, " ").encode()[-1], text[i].replace(SPACE, " ").encode()[0]
        return bool(self.cut[a, b])

    def entries(self, text: str, lo: int) -> list[State]:
        """States at an edge: every piece that starts before it and reaches up to it or over it; one, that
        of the edge itself, if it is a cut."""
        if self.is_cut(text, lo):
            return [(lo, lo)]
        return [(a, b) for a in range(max(0, lo - self.longest), lo) for b in self.matches(text, a) if b >= lo]

    def chunk(self, text: str, lo: int, hi: int, first: bool, last: bool):
        """How a chunk text[lo:hi] is walked: its entries, its inner cuts, and the paths at its edges."""
        entries = [(0, 0)] if first else self.entries(text, lo)
        one = next((i for i in range(lo, hi + (not last)) if 0 < i < len(text) and self.is_cut(text, i)), None)
        two = None if one is None else next(i for i in range(hi if not last else hi - 1, one - 1, -1) if self.is_cut(text, i))
        if one is None:
            return {e: self.best_paths(text, e, hi, last) for e in entries}, None, None, None
        heads = {e: p for e in entries if (p := self.best_paths(text, e, one, True))}
        middle = text[one:two].replace(SPACE, " ").encode()
        return heads, self.best_paths(text, (two, two), hi, last) if two < hi or last else {(two, two): (0.0, [])}, (one, two), middle

    def matrix(self, text: str, lo: int, hi: int, first: bool, last: bool) -> list[tuple[State, State, float]]:
        """The chunk's finite entries: state at its left edge (from lo), at its right edge (from hi), weight."""
        heads, tails, span, middle = self.chunk(text, lo, hi, first, last)
        shift = lambda s, edge: (s[0] - edge, s[1] - edge)
        if span is None:
            return [(shift(e, lo), shift(x, hi), v) for e, found in heads.items() for x, (v, _) in found.items()]
        inner, _ = self.encode(np.frombuffer(middle, np.uint8), np.array([0, len(middle)]))
        weight = float(self.scores[inner].sum())
        best = {e: max(v for v, _ in found.values()) for e, found in heads.items()}
        return [(shift(e, lo), shift(x, hi), v + weight + w) for e, v in best.items() for x, (w, _) in tails.items()]

    def backtrace(self, text: str, lo: int, hi: int, first: bool, last: bool, entry: State, leave: State) -> list[int]:
        """The chunk's own ids, those of the pieces that start in it, given its states at both edges."""
        heads, tails, span, middle = self.chunk(text, lo, hi, first, last)
        entry, leave = (entry[0] + lo, entry[1] + lo), (leave[0] + hi, leave[1] + hi)
        if span is None:
            return self.to_ids(text, heads[entry][leave][1])
        head = max(heads[entry].values(), key=lambda x: x[0])[1]
        inner, _ = self.encode(np.frombuffer(middle, np.uint8), np.array([0, len(middle)]))
        return self.to_ids(text, head) + inner.tolist() + self.to_ids(text, tails[leave][1])


Matrix = dict[tuple[State, State], float]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two matrices, which is associative."""
    by_entry: dict[State, list[tuple[State, float]]] = {}
    for (e, x), v in b.items():
        by_entry.setdefault(e, []).append((x, v))
    out: Matrix = {}
    for (e, m), v in a.items():
        for x, w in by_entry.get(m, ()):
            if v + w > out.get((e, x), -np.inf):
                out[(e, x)] = v + w
    return out


def edge_states(matrices: list[Matrix]) -> list[State]:
    """The states of the best path at all edges, from the prefix products of the chunks' matrices."""
    prefix = [matrices[0]]
    for m in matrices[1:]:
        prefix.append(product(prefix[-1], m))
    states = [max(prefix[-1], key=prefix[-1].get)[1]]
    for k in range(len(matrices) - 1, 0, -1):
        ways = {e: v for (e, x), v in matrices[k].items() if x == states[-1]}
        reach = {x: v for (_, x), v in prefix[k - 1].items()}
        states.append(max((s for s in ways if s in reach), key=lambda s: reach[s] + ways[s]))
    return [(0, 0), *states[::-1]]


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def normalized(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the model sees: a space before every text that isn't empty, and the space sign as a space."""
    if _SPACE_BYTES in data.tobytes():
        texts = [data[a:b].tobytes().replace(_SPACE_BYTES, b" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    filled = np.diff(ends) > 0
    return np.insert(data, ends[:-1][filled], 0x20), ends + np.concatenate([[0], np.cumsum(filled)])


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_DIGEST = longs("n_tokens", "ids_crc32", "n_bytes", "text_crc32")


def _ids_column(model: str, ids: np.ndarray, at: np.ndarray) -> list:
    return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))]


def _digest_columns(model: str, ids: np.ndarray, at: np.ndarray) -> list:
    data, ends = lattice(model).decode(ids, at)
    raw, flat = ids.astype("<u4"), np.ascontiguousarray(data)
    return [
        pa.array(np.diff(at)),
        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
        pa.array(np.diff(ends)),
        pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
    ]


def encode(docs: DataFrame, model: str, digest: bool = False, giant_bytes: int = 1 << 15, chunk_chars: int = 1 << 13) -> DataFrame:
    """doc_id, n_chunks and ids of every row; with digest, instead of the ids, n_tokens, ids_crc32 (of
    little-endian unsigned 32-bit ids), and n_bytes and text_crc32 of what the ids decode to.

    A text of up to giant_bytes is one chunk, solved in one task. A longer one is cut into chunks of
    chunk_chars characters with the context that states at their edges need; tasks make the chunks'
    matrices, a fold over one text's small matrices finds the states at its edges, and tasks backtrace
    the chunks independently. A null or empty text has no ids; repeated rows give repeated results, null
    doc_ids too; an empty table gives an empty one; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_giant = F.coalesce(F.octet_length("text") > giant_bytes, F.lit(False))
    columns = _digest_columns if digest else _ids_column
    fields = _DIGEST.fields if digest else [_IDS]

    def whole(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        for part, data, ends in tb.slices(batch, most=1 << 19):
            ids, at = lattice(model).encode(*normalized(data, ends))
            yield part, [pa.array(np.ones(part.num_rows, np.int64)), *columns(model, ids, at)]

    def giant(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        for row in range(batch.num_rows):
            part = batch.slice(row, 1)
            yield part, columns(model, *_flat(part.column("ids")))

    short = annotate(docs.where(~is_giant), T.StructType([*longs("n_chunks").fields, *fields]), whole, ["doc_id"])
    long = _encode_giants(docs.where(is_giant), model, chunk_chars).select("doc_id", "n_chunks", "ids")
    return short.unionAll(annotate(long, T.StructType(fields), giant, ["doc_id", "n_chunks"], "ids") if digest else long)


def _encode_giants(docs: DataFrame, model: str, chunk_chars: int) -> DataFrame:
    key = ["doc_id", "text_key"]
    rows = docs.groupBy("doc_id", F.xxhash64("text").alias("text_key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def cut(batch: pa.RecordBatch) -> Iterator[list]:
        reach = lattice(model).longest + 1
        for d, k, text in zip(*(batch.column(c).to_pylist() for c in (*key, "text")), strict=True):
            text = SPACE + text.replace(" ", SPACE)
            n = -(-len(text) // chunk_chars)
            for c in range(n):
                lo, hi = c * chunk_chars, min((c + 1) * chunk_chars, len(text))
                left = max(0, lo - reach)
                yield [pa.array([x], t) for x, t in ((d, pa.int64()), (k, pa.int64()), (c, pa.int64()), (n, pa.int64()), (lo - left, pa.int64()), (hi - left, pa.int64()), (text[left : hi + reach], pa.string()))]

    chunks = written(emit(rows.select(*key, "text"), T.StructType([*longs(*key, "chunk", "n_chunks", "lo", "hi").fields, T.StructField("window", T.StringType())]), cut).repartition(*key, "chunk"), "chunks")
    state = T.ArrayType(T.LongType())
    cells = T.StructType([*longs(*key, "chunk").fields, T.StructField("cells", T.ArrayType(state)), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def walk(batch: pa.RecordBatch) -> Iterator[dict]:
        for r in batch.to_pylist():
            yield r | {"first": r["chunk"] == 0, "last": r["chunk"] == r["n_chunks"] - 1}

    def matrices(batch: pa.RecordBatch) -> Iterator[list]:
        for r in walk(batch):
            m = lattice(model).matrix(r["window"], r["lo"], r["hi"], r["first"], r["last"])
            yield [pa.array([r[c]], pa.int64()) for c in (*key, "chunk")] + [pa.array([[[*e, *x] for e, x, _ in m]], pa.list_(pa.list_(pa.int64()))), pa.array([[v for *_, v in m]], pa.list_(pa.float64()))]

    edges = T.StructType([*longs(*key, "chunk").fields, T.StructField("edge", state)])

    def combine(group: pa.Table) -> pa.Table:
        got = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        states = edge_states([{((c[0], c[1]), (c[2], c[3])): v for c, v in zip(r["cells"], r["weights"], strict=True)} for r in got])
        return pa.table([pa.array([r[c] for r in got], pa.int64()) for c in (*key, "chunk")] + [pa.array([[*a, *b] for a, b in zip(states, states[1:], strict=False)], pa.list_(pa.int64()))], names=edges.names)

    def trace(batch: pa.RecordBatch) -> Iterator[list]:
        for r in walk(batch):
            e = r["edge"]
            ids = lattice(model).backtrace(r["window"], r["lo"], r["hi"], r["first"], r["last"], (e[0], e[1]), (e[2], e[3]))
            yield [pa.array([r[c]], pa.int64()) for c in (*key, "chunk")] + [pa.array([ids], pa.list_(pa.int32()))]

    own_ids = T.StructType([*longs(*key, "chunk").fields, _IDS])
    found = emit(chunks, cells, matrices).groupBy(*key).applyInArrow(combine, edges)
    on = [chunks[c].eqNullSafe(found[c]) for c in (*key, "chunk")]
    traced = emit(chunks.join(found, on).select(*(chunks[c] for c in chunks.columns), "edge"), own_ids, trace)
    # A text's own chunks: as large as the row that it came from.
    put = traced.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"), F.count("*").alias("n_chunks"))
    put = put.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.flatten(F.col("parts.ids")).alias("ids"), "n_chunks")
    copies = rows.select(*key, "copies")
    back = copies.join(put, copies["doc_id"].eqNullSafe(F.col("d")) & (copies["text_key"] == F.col("k")))
    return back.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "ids", "n_chunks")


def decode(rows: DataFrame, model: str, carry: list[str] | None = None) -> DataFrame:
    """Adds text, what the ids stand for; a null list counts as empty. Bytes that aren't UTF-8 become U+FFFD."""

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            data, at = lattice(model).decode(*_flat(part.column("ids")))
            yield part, [pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())]

    carry = carry or ["doc_id"]
    return annotate(rows.select(*dict.fromkeys([*carry, "ids"])), T.StructType([T.StructField("decoded", T.StringType())]), work, carry, "ids").withColumnRenamed("decoded", "text")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(n)])
