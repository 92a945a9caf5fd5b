"""Spelling variants, periodic runs and exact top-k search against brute force on small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from panelloom.llm import entry, periods, spelling, topk
from pyspark.sql import functions as F

ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "One word"), (4, "One word"), (None, "a null id here"), (5, "Ünïcode ﬁ 漢字 😀 Ünïcode")]


def _near(a, b):
    """Whether two different words are one edit apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[i + 1 :] == long[i + 1 :] if len(a) == len(b) else short[i:] == long[i + 1 :]


def _variants(rows, least_length=7, least_count=2, factor=10, drop_every=31):
    count = collections.Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda x: x[0].lower(), w)
            h = zlib.crc32(f"{d}:{w}".encode()) if d is not None else 1
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    count = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    form, near = {}, {}
    by_length = collections.defaultdict(list)
    for w in count:
        by_length[len(w)].append(w)
    for w, n in count.items():
        others = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if _near(w, v)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= factor * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, near[w], count[form[w]] if form[w] else None) for w, n in count.items())


def _rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("most", [4096, 8])
def test_words_one_edit_apart(spark, most):
    rng = np.random.default_rng(2)
    base = ["aaaaaaaa", "abababab", "straßeÿàà", "internationalisation", "mississippi"]
    words = set(base)
    for w in base:
        for _ in range(60):
            i, c = int(rng.integers(0, len(w))), chr(rng.choice([97, 98, 115, 0xDF, 0xFF]))
            words |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], "inter" + w[:i] + c + w[i:]}
    words = sorted(w for w in words if len(w) >= 7)
    count = {w: int(n) for w, n in zip(words, 10 ** rng.integers(0, 4, len(words)), strict=True)}
    got = {r["word"]: r for r in spelling.group(spark.createDataFrame(list(count.items()), "word string, n int"), most=most).collect()}
    assert len(got) == len(count)
    for w in words:
        others = [v for v in words if _near(w, v)]
        best = min(others, key=lambda v: (-count[v], v), default=None)
        best = best if best and count[best] >= 10 * count[w] else None
        assert (got[w]["n_near"], got[w]["form"], got[w]["form_n"]) == (len(others), best, count.get(best))


def test_long_words_stay_within_memory(spark):
    long = "z" * 200_000
    df = spark.createDataFrame([(long, 50), (long[1:] + "y", 2), (long + "z", 3), ("shortword", 4), ("shortwords", 40)], "word string, n long")
    got = {r["word"]: (r["n_near"], r["form"]) for r in spelling.group(df).collect()}
    assert got["shortword"] == (1, "shortwords") and got[long][0] == 2 and got[long + "z"] == (1, long)


def test_spelling_variants_of_documents(spark):
    rng = np.random.default_rng(4)
    words = ["Example", "exemple", "Éxample", "harbour", "harbor", "harbours", "different", "diferent", "Overlook-overlook"]
    rows = [*ODD, *((int(d), " ".join(rng.choice(words, 40, p=[0.5, 0.05, 0.05, 0.1, 0.05, 0.05, 0.1, 0.05, 0.05]))) for d in range(100, 160)), (9, "example " * 30_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, word string")
    got = spelling.variants(df, drop_every=31)
    assert _rows(got) == sorted(_variants(rows), key=str)
    assert _rows(spelling.variants(df)) == sorted(_variants(rows, drop_every=None), key=str)
    assert spelling.variants(df.limit(0)).count() == 0


def test_op11_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = entry.op11_spelling_variants(spark, "/root/testdata/sf0.001")
    assert _rows(got) == sorted(_variants([tuple(r) for r in docs]), key=str)


def _brute_runs(words, min_words=24, min_periods=3):
    """Every maximal stretch of each period, those of a smaller period in the same place aside."""
    n, least = len(words), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, min_periods * q):
                least.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, n_) for (s, n_), q in least.items())


def _planted(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def _collapsed(words, runs):
    drop = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def test_periodic_runs(spark):
    rng = np.random.default_rng(7)
    texts = [t for _, t in ODD] + ["a " * 23, "a " * 24, "x " * 1000 + "end", "b a a " * 9, "a b " * 5000 + " ".join(map(str, range(500)))]
    for _ in range(150):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            p, k = int(rng.integers(1, 60)), float(rng.uniform(1, 6))
            unit = rng.integers(0, int(rng.choice([2, 3, 50])), p)
            parts += [*(f"w{unit[i % p]}" for i in range(int(p * k))), *(f"v{x}" for x in rng.integers(0, 9, int(rng.integers(0, 30))))]
        texts.append(" ".join(parts) if rng.random() < 0.8 else "\n\t ".join(parts))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(4, "One word"), (7, texts[9]), (7, texts[9])]
    df = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, runs int, key string")
    got = collections.Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periods.runs(df).collect())
    want = collections.Counter()
    for d, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = _brute_runs(words)
        want[d, len(words), tuple(runs), _collapsed(words, runs)] += 1
    assert got == want and sum(bool(k[2]) for k in want) > 50
    assert periods.runs(df.limit(0)).count() == 0


def test_tiles_of_a_run_meet(monkeypatch):
    words = [f"u{i % 37}" for i in range(900)]
    h = np.array([zlib.crc32(w.encode()) * 2654435761 + 1 for w in words], np.uint64)
    found = list(periods.boundaries(h, 24, 3))
    assert {c for b, c in found if b == 32} >= set(range(0, 900 - 96, 32))
    ids = np.unique(h, return_inverse=True)[1]
    for b, c in found:
        for q, lo, hi in periods.solve_tile(ids[max(0, c - b) : c + 4 * b].tolist(), c - max(0, c - b), b):
            assert q % 37 == 0 and 0 <= lo < hi


def test_op12_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in entry.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        words = _planted(d, t)
        runs = _brute_runs(words)
        best = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        r = got[d]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(_collapsed(words, runs).encode()).hexdigest()
    assert sum(r["n_runs"] > 0 for r in got.values()) > 10


@pytest.mark.parametrize(("of", "shard_rows", "scale"), [("float", 8192, 1024), ("double", 64, 1024), ("double", 100, 1e7)])
def test_exact_topk(spark, of, shard_rows, scale):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 8)) + 3 * rng.normal(size=(6, 8))[rng.integers(0, 6, 600)]
    v[200:260] = v[5]
    v[300] = 0
    v = v.astype(np.float32).astype(float)
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(40, [float(x) for x in v[41]], 0), (40, [float(x) for x in v[40]], 1), (7, [float(x) for x in v[7]], 1)]
    bad = [(1000, None, 0), (1020, [float("nan")] + [1.0] * 7, 0), (1040, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (1060, [1.0, 2.0], 0), (1080, [float("inf")] + [1.0] * 7, 0)]
    df = spark.createDataFrame(rows + bad, f"vec_id long, embedding array<{of}>, score int")
    whole = [(i, np.floor(np.array(r) * scale).astype(np.int64)) for i, r, _ in rows]
    want = collections.Counter()
    for i, q in whole:
        if i % 20 == 0:
            ranked = sorted((-int(q @ x), j) for j, x in whole if j != i)[:10]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(ranked))
    got = topk.search(df, F.col("vec_id") % 20 == 0, scale=scale, shard_rows=shard_rows, block_rows=16, query_part=16)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert topk.search(df.limit(0), F.lit(True)).count() == 0
    few = topk.search(df.where("vec_id in (20, 21, 22)"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in few)[0][0] == 1 and len(few) == 2


def test_blocks_below_the_kth_score_are_not_read():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(640, 4)) * 20 + np.repeat(rng.normal(size=(10, 4)) * 900, 64, axis=0)).astype(np.int64)
    hi, lo = (np.stack([f(x[a : a + 64], axis=0) for a in range(0, 640, 64)]) for f in (np.max, np.min))
    starts = np.arange(0, 641, 64)
    q = x[5]
    bound = topk.bounds(q[None], hi, lo)[0]
    held, score, read = topk.best_in_blocks(5, q, np.argsort(-bound, kind="stable"), bound, starts, np.arange(640), x, 10, None)
    exact = x @ q
    exact[5] = np.iinfo(np.int64).min
    assert score.tolist() == sorted(exact.tolist(), reverse=True)[:10] and read < 10
    assert all((bound[b] >= exact[starts[b] : starts[b + 1]]).all() for b in range(10))
    big = np.full((2, 3), 1 << 30)
    assert topk.products(big, big).tolist() == [[3 << 60] * 2] * 2 if 3 << 60 < 1 << 63 else True


# --- faults of earlier rounds ---------------------------------------------------------------------


def test_repeated_query_rows_have_their_own_ranks(spark):
    from panelloom.llm import vectors

    v = np.random.default_rng(8).normal(size=(120, 8))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(20, [float(x) for x in v[20]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r for r in vectors.search(df, F.col("vec_id") % 20 == 0).collect() if r["query_id"] == 20]
    pairs = collections.Counter((r["rank"], r["vec_id"]) for r in got)
    assert len(got) == 40 and set(pairs.values()) == {2} and len({i for _, i in pairs}) == 20 and {k for k, _ in pairs} == set(range(1, 21))


def test_a_template_with_repeated_words_is_found_at_every_place(spark):
    from panelloom.llm import licences

    template = " ".join(f"w{i % 104}" for i in range(180))
    rows = [(k, " ".join(f"x{j}" for j in range(k)) + " " + template + " y" * 200) for k in range(0, 200, 13)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=(("own", template),)).collect()
    assert len(got) == len(rows) and all(r["labels"] == "own" and r["score"] == 1.0 for r in got)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_in_texts_are_the_librarys(spark, name):
    import public_tokenizers
    from panelloom.llm import dac, packing
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a<|endoftext|> b", "<|startoftext|> C <|endoftext|><|endoftext|>", "plain text", "", "<|ENDOFTEXT|> endoftext", "x " * 3000 + "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    for r in dac.read(*dac.write(df, path, 2)).collect():
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    packed = collections.Counter()
    for r in packing.pack(df, path, end_id=2).collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == {i: len(x) for i, x in want.items()}


def test_line_dedup_with_columns_of_its_names_and_a_line_that_stands_twice(spark, monkeypatch):
    from panelloom.llm import lines

    nav = "home news about contact terms privacy help and more links"
    rows = [(i, f"own start {i}\n{nav}\nown middle of {i}\n{nav}\nown end {i}", 1, 2, "k", True, "z") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _key int, removed string, gone boolean, `a.b` string")
    pairs = []
    real = lines._align
    monkeypatch.setattr(lines, "_align", lambda p, *a: pairs.append(p.count()) or real(p, *a))
    got = lines.dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed", "earlier"]
    assert {(r["n_removed"], r["_id"], r["_key"], r["removed"], r["gone"], r["a.b"]) for r in got.collect()} == {(0, 1, 2, "k", True, "z")}
    assert sum(pairs) <= 4 * len(rows)


def test_many_short_texts_need_little_memory():
    import pyarrow as pa
    from panelloom.llm import language
    from panelloom.llm import textbytes as tb

    batch = pa.RecordBatch.from_arrays([pa.array([f"short text {i:09d}" for i in range(10_000)])], ["text"])
    sizes = [part.num_rows for part, _, _ in tb.slices(batch, rows=language._ROWS)]
    assert sum(sizes) == 10_000 and max(sizes) <= 512


# --- whole pipeline, and recall at some size --------------------------------------------------------


def test_pipeline_run_is_its_stages_one_after_the_other(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert docs.columns == columns
            rows = docs.collect()
            kept.append(len(rows))
            docs = spark.createDataFrame(rows, docs.schema)
    assert kept == sorted(kept, reverse=True) and kept[-1] < kept[0]
    out = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, out)) == sorted(map(key, docs.collect())) and len({r["doc_id"] for r in out}) == kept[-1]
    places = collections.defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in places.values():
        ends = np.cumsum([n for _, n in sorted(rows)])
        assert [a for a, _ in sorted(rows)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_recall_of_the_vector_indexes(spark):
    from panelloom.llm import vectors

    rng = np.random.default_rng(12)
    v = rng.normal(size=(5000, 32))
    v[3000:4500] = v[rng.integers(0, 600, 1500)] + rng.normal(scale=0.04, size=(1500, 32))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    want = near.sum(axis=1)
    assert all(got[i] <= want[i] for i in range(5000)) and sum(got.values()) >= 0.99 * want.sum() > 1000
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    found = collections.defaultdict(set)
    for r in vectors.search(df, F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    truth = {q: set(np.argsort(-scores[q])[:20].tolist()) for q in range(0, 5000, 20)}
    assert sum(len(found[q] & t) for q, t in truth.items()) >= 0.95 * 20 * len(truth)
