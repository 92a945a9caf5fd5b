"""Operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from panelloom.llm import dac, jaccard, licences, lines, packing, pieces, vectors
from panelloom.llm import textbytes as tb
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_shingles int, score string"  # with names that results use too

ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "One word"), (5, "One word"), (6, "x " * 3000), (7, "Ünïcode ﬁ 漢字 😀 ▁ 'tis  the\r\n\n end."), (None, "a null id here"), (7, "another text of id seven"), (5, "One word")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, 0, "s") for d, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def _components(rows, k, percent):
    sets = [(_sets(t, k), d) for d, t in rows]
    label = list(range(len(rows)))
    for i, (a, _) in enumerate(sets):
        for j in range(i):
            b = sets[j][0]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = collections.defaultdict(list)
    for x, (_, d) in zip(label, sets, strict=True):
        least[x].append(d)
    return sorted(((d, len(s), min((y for y in least[x] if y is not None), default=None)) for x, (s, d) in zip(label, sets, strict=True)), key=str)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_join_is_exact(spark, documents, odd, k, percent):
    base = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals in the wood".split()
    near = [(900 + i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in range(len(base))]
    rows = documents.select("doc_id", "text").limit(60).collect()
    rows = [(r[0] + 100, r[1]) for r in rows] + ODD + near + [(950, " ".join(base) * 3)]
    df = spark.createDataFrame([(d, t, 0, "s") for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in jaccard.join(df, k, percent).collect()), key=str)
    assert got == _components(rows, k, percent)
    assert jaccard.join(df.limit(0), k, percent).count() == 0


def test_jaccard_join_of_a_passage_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_BLOCK", 8)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(90):
        size = (700, 300, 40)[i % 3]
        passage = [f"p{i % 3}x{j}" for j in range(int(size * 0.84))]
        own = [f"d{i}x{j}" for j in range(int(rng.integers(size * 0.06, size * 0.16)))]
        rows.append((i, " ".join(own[: i % 7] + passage + own[i % 7 :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.join(df, 5, 80).collect()), key=str)
    want = _components(rows, 5, 80)
    assert got == want and 3 < len({c for *_, c in want}) < 90


def test_signatures_are_shared_and_sketches_never_overrate():
    rng = np.random.default_rng(3)
    for n in (6, 7, 13, 40, 150, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2 + 1)
            drop = int(0.07 * len(a))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            union = len(a) + len(b) - both
            if 100 * both >= 85 * union and both < union:
                one, two = ([(set(x.tolist()), shared) for x, shared in jaccard.signatures(v, 85)] for v in (a, b))
                assert any(len(x & y) >= max(r, t) for x, r in one for y, t in two)
            assert jaccard.least_difference(jaccard.parity_sketch(a), jaccard.parity_sketch(b)) <= union - both


def test_token_files_round_trip(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    folder, manifest = dac.write(odd, path, 2, file_ids=500)
    got = dac.read(folder, manifest).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (d, text) in zip(got, rows, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = dac.write(odd.limit(0), path, 2)
    assert dac.read(*empty).count() == 0


def test_any_token_without_its_neighbours():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32) >> np.random.default_rng(2).integers(0, 20, 5000).astype(np.uint32)
    f = dac.TokenFile(dac.encode(ids, [None, 5], np.array([2000, 3000])))
    assert [f.token(i) for i in (0, 1, 777, 4999)] == [int(ids[i]) for i in (0, 1, 777, 4999)]
    assert (f.tokens(1234, 4321) == ids[1234:4321]).all() and f.doc_ids == [None, 5]


def test_packing(spark, documents, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for df in (documents.select("doc_id", "text"), odd, odd.limit(0)):
        rows = packing.pack(df, path).collect()
        total = collections.defaultdict(list)
        for r in rows:
            assert 1 <= r["length"] <= 2048
            total[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in total.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        ids = [[*t.encode(x["text"] or "", add_special_tokens=False).ids, 0] for x in df.collect()]
        want = sorted((len(i) - (k + 1) * 2048 if len(i) - (k + 1) * 2048 > 0 else 0, min(len(i) - k * 2048, 2048)) for i in ids for k in range(-(-len(i) // 2048)))
        assert sorted((r["start"], r["length"]) for r in rows) == want
        assert len(total) <= -(-sum(map(len, ids)) // 2048) + 1


def test_packing_fills_gaps_exactly():
    counts = np.zeros(2049, np.int64)
    counts[[1000, 500, 548, 2048, 3]] = [2, 1, 2, 4, 1]
    plan = packing.pack_lengths(counts, 2048)
    assert sum(n for _, n in plan) == 4 + 2
    used = collections.Counter()
    for pattern, n in plan:
        for x in pattern:
            used[x] += n
    assert used == collections.Counter({1000: 2, 500: 1, 548: 2, 2048: 4, 3: 1})


@pytest.mark.parametrize("giant, chunk", [(1 << 15, 1 << 13), (10, 7)])
def test_sentencepiece_is_the_librarys(spark, documents, odd, giant, chunk):
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    df = odd.select("doc_id", "text").unionByName(documents.select("doc_id", "text").where("doc_id % 40 = 0").withColumn("text", F.substring("text", 1, 700)))
    got = pieces.encode(df, model, giant_bytes=giant, chunk_chars=chunk)
    key = lambda r: (str(r[0]), list(r[1]))
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got.collect()), key=key) == sorted(((r["doc_id"], sp.encode(r["text"] or "")) for r in df.collect()), key=key)
    texts = sorted(r["text"] for r in pieces.decode(got, model).collect())
    assert texts == sorted((r["text"] or "").replace("▁", " ") for r in df.collect())
    assert pieces.encode(df.limit(0), model, digest=True).count() == 0


def test_matrices_combine_associatively():
    lattice = pieces.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    text = "▁thequickbrown▁foxesjumped▁overtheinternationalization"
    cuts = [0, 9, 17, 30, len(text)]
    m = [{(e, x): v for e, x, v in lattice.matrix(text, a, b, a == 0, b == len(text))} for a, b in zip(cuts, cuts[1:], strict=False)]
    left = pieces.product(pieces.product(pieces.product(m[0], m[1]), m[2]), m[3])
    right = pieces.product(m[0], pieces.product(m[1], pieces.product(m[2], m[3])))
    assert left.keys() == right.keys() and all(left[k] == pytest.approx(right[k]) for k in left) and left


def test_licences_are_those_of_every_block(spark, documents, odd):
    extra = spark.createDataFrame([(8001, "A b. Released under the MIT License! Apache license; the mit license", 0, "s"), (8002, "license mit the under released x " * 30, 0, "s")], SCHEMA)
    df = odd.unionByName(extra).select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    got = {(r["doc_id"], r["n_words"]): r for r in licences.scan(df).collect()}
    for r in df.collect():
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r["text"] or "").encode().translate(bytes(tb.LOWER)))
        places, labels = [], set()
        for phrase, label in licences.PHRASES.items():
            p = [w.encode() for w in phrase.split()]
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        base = ",".join(sorted(labels))
        best = 0.0
        for at in range(0, len(words), 24):
            block = set(words[at : at + 48])
            for label, template in licences.TEMPLATES:
                t = {w.encode() for w in template.split()}
                share = len(t & block) / len(t)
                if share >= 0.9 - 1e-9:
                    labels.add(label)
                    best = max(best, share)
        row = got[r["doc_id"], len(words)]
        assert (row["n_base"], row["base_labels"], row["labels"]) == (len(places), base, ",".join(sorted(labels)))
        assert (row["first_word"], row["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert row["score"] == pytest.approx(1.0 if places else best)
    assert licences.scan(df.limit(0)).count() == 0


def test_line_dedup(spark):
    shared = "this line has more than eight words in it so it counts"
    rows = [(1, f"first own line of the first document\n{shared}\nshort"), (2, f"another text that is not the same\n{shared}\nshort\nand an end of its own here"), (3, "first own line of the first document\n" + shared + "\nshort"), (4, None), (5, ""), (6, "nothing of this is shared with any other document"), (2, f"another text that is not the same\n{shared}\nshort\nand an end of its own here"), (None, shared)]
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, n_removed int")
    got = collections.Counter((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup(df).collect())
    two = (2, "another text that is not the same\nand an end of its own here", 2)
    assert got == collections.Counter([(1, rows[0][1], 0), two, two, (3, "", 3), (4, None, 0), (5, "", 0), (6, rows[5][1], 0), (None, shared, 0)])
    assert lines.dedup(df.limit(0)).count() == 0


def _removed_by_all_pairs(rows, least):
    """Places of lines that alignment with every earlier distinct text removes, by brute force."""
    seqs = []
    for d, t in sorted({(d, t) for d, t in rows if d is not None and t is not None}):
        held = [(p, x.split()) for p, x in enumerate(t.split("\n")) if x.split()]
        seqs.append((d, t, [p for p, _ in held], [" ".join(x) for _, x in held], [len(x) for _, x in held]))
    first = {}
    for d, t, *_ in seqs:
        first.setdefault(t, d)
    heads = [s for s in seqs if first[s[1]] == s[0]]
    out = {}
    for d, t, places, b, words in seqs:
        if first[t] != d:
            out[d, t] = set(places)
        else:
            out[d, t] = {places[j] for e in heads if e[0] < d for j in lines.common_blocks(e[3], b, words, least)}
    return out


def _by_lines(spark, rows, least=8):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = df.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key")).distinct()
    return {(r["doc_id"], r["text"]): set(r["removed"] or []) for r in keys.join(lines.removals(df, least_words=least), ["doc_id", "text_key"]).collect()}


def test_line_dedup_with_further_holders(spark):
    x, y = ("a line of eight words or more stands " + c for c in ("here x", "here y"))
    crossed = [(1, f"one\n{x}\na\n{y}\nend"), (2, f"two\n{y}\nb\n{x}\nfin"), (3, f"three\n{y}\nc\n{x}\nstop")]
    twice = [(4, f"p\n{x}w\nq"), (5, f"r\n{x}w\nmore\n{x}w\ns"), (6, f"t\n{x}w\nu\n{x}w\nv")]
    short = [(7, "k1 k2 k3\nk4 k5 k6\nk7 k8 k9\nthe seventh"), (8, "eighth text\nk1 k2 k3\nk4 k5 k6\nk7 k8 k9\nanother end")]
    parted = [(9, "m1 m2 m3 m4 m5\nlone"), (10, "own\nn1 n2 n3 n4 n5\nalone"), (11, "start\nm1 m2 m3 m4 m5\nn1 n2 n3 n4 n5\nthen"), (12, "begin\nm1 m2 m3 m4 m5\nn1 n2 n3 n4 n5\nafter")]
    rows = crossed + twice + short + parted
    got = _by_lines(spark, rows)
    assert got == _removed_by_all_pairs(rows, 8)
    assert got[crossed[2]] == {1, 3} and got[short[1]] == {1, 2, 3} and got[parted[3]] == {1, 2}


def test_line_dedup_against_all_pairs(spark, documents):
    rng = np.random.default_rng(5)
    pool = [" ".join(f"w{i}x{j}" for j in range(1 + i % 11)) for i in range(14)]
    rows = [(int(i), "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 9)))) for i in rng.integers(0, 100, 120)]
    assert _by_lines(spark, rows) == _removed_by_all_pairs(rows, 8)
    rows = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").limit(150).collect()]
    rows += [(d + 10**6, "\n".join(reversed((t or "").split("\n")))) for d, t in rows[:50]]
    assert _by_lines(spark, rows) == _removed_by_all_pairs(rows, 8)


def test_patience_blocks():
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert lines.common_blocks([1, 2, 3], [1, 2, 3], [4, 4, 4], 8) == [0, 1, 2]
    assert lines.common_blocks([5, 1, 6], [1, 7], [4, 4], 8) == []


def _vectors(spark, of="float", scale=1.0):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 8))
    v[100:140] = v[0] + rng.normal(scale=0.05, size=(40, 8))
    v[200:230] = v[5]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v.astype(np.float32) if of == "float" else v * scale)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] + [1.0] * 7, 0), (1003, [None] + [1.0] * 7, 0), (None, [1.0] * 8, 0), (1020, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{of}>, rank int"), {i: np.array(r, np.float64) for i, r, _ in rows[:300]}


@pytest.mark.parametrize(("of", "scale"), [("float", 1.0), ("double", 1e180)])
def test_near_duplicate_vectors(spark, of, scale):
    df, good = _vectors(spark, of, scale)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df, block=16).collect()}
    unit = np.stack([v / scale / np.linalg.norm(v / scale) for v in good.values()])
    near = unit @ unit.T >= 0.95
    label = np.arange(len(unit))
    for _ in range(20):
        label = np.array([label[row].min() for row in near])
    assert all(got[i]["n_links"] == near[i].sum() - 1 and got[i]["component_id"] == label[i] for i in good)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1020))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("of", "scale"), [("float", 1.0), ("double", 1e60), ("double", 1e-60)])
def test_nearest_neighbours(spark, of, scale):
    df, good = _vectors(spark, of, scale)
    rows = vectors.search(df, F.col("vec_id") % 20 == 0, block=64).collect()
    ids, v = np.array(list(good)), np.stack(list(good.values()))
    hit = total = 0
    for q in [i for i in good if i % 20 == 0]:
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        s = v @ good[q]
        s[q] = -np.inf
        hit += len({r["vec_id"] for r in mine} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        total += 20
        assert all(r["score"] == pytest.approx(float(good[r["vec_id"]] @ good[q]), rel=1e-12, abs=1e-12 * scale**2) for r in mine)
    assert hit / total >= 0.9
    assert vectors.search(df.limit(0), F.lit(True)).count() == 0


def test_word_hashes_do_not_depend_on_the_place():
    data, ends = tb.buffers(pa.array(["abc de", None, "", "de abc"]))
    starts, stops, text = tb.words(data, ends, tb.NOT_SPACE)
    h = tb.hashes(data, starts, stops)
    assert text.tolist() == [0, 0, 3, 3] and h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
