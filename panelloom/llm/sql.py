"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"


def _crc32(text: str) -> str:
    """crc32 of a string whose code points are below 256, as UTF-8; t is crc_table's."""
    as_bytes = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [195, unicode(ch) - 64] END))"
    return f"xor(list_reduce([4294967295]::BIGINT[] || {as_bytes}::BIGINT[], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: Words that are one edit apart have a deletion of one letter at the same place in common (a replaced letter), or one is a deletion of the other.
SPELLING = f"""WITH RECURSIVE {_CRC_TABLE},
own AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT own.*, {_crc32("doc_id || ':' || w")} AS h FROM own, crc_table),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
one_less AS (SELECT DISTINCT d.word AS a, v.word AS b FROM d JOIN v ON d.less = v.word),
pairs AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.less = y.less AND x.p = y.p AND x.word <> y.word UNION SELECT a, b FROM one_less UNION SELECT b, a FROM one_less),
ranked AS (SELECT a, b, v.n AS bn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS r FROM pairs JOIN v ON b = v.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * v.n THEN b END AS form, CASE WHEN bn >= 10 * v.n THEN bn END AS form_n FROM v LEFT JOIN ranked ON v.word = a AND r = 1),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT chain.word, root FROM chain JOIN f e ON chain.root = e.word WHERE e.form IS NULL) USING (word)"""

PERIODS = f"""WITH {_CRC_TABLE},
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc_table),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM split),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
repeated AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE w[i + 1] END) END AS w, n FROM placed),
word AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM repeated),
equal AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM word l JOIN word r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM equal),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM isles GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, s, n, min(q) AS q FROM stretches GROUP BY doc_id, s, n),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) AS r FROM runs)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM repeated d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN best ON best.doc_id = d.doc_id AND r = 1"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10"""
