"""DuckDB SQL of operators whose results SQL can express on whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN rep USING (h)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [1] ELSE range(1, len(w) - 2) END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT t.id, e.b FROM t JOIN e ON e.a = t.root)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(root) AS root FROM t GROUP BY id) c ON c.id = d.doc_id
"""

LINES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, k, line, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS ws FROM l),
f AS (SELECT doc_id, k, ws, len(ws) AS n FROM s WHERE len(ws) >= 1),
g AS (SELECT list_sort(ws) AS ws, n, min((doc_id, k)) AS first FROM f GROUP BY 1, 2),
u AS (SELECT row_number() OVER (ORDER BY first) AS u, * FROM g),
tok AS (SELECT u, n, unnest(ws) AS w FROM u),
fr AS (SELECT w, count(*) AS c FROM tok GROUP BY w),
pre AS (SELECT u, n, w FROM (SELECT u, n, w, row_number() OVER (PARTITION BY u ORDER BY c, w) AS p FROM tok JOIN fr USING (w)) WHERE p <= n - (4 * n + 4) // 5 + 1),
pair AS (SELECT DISTINCT x.u AS x, y.u AS y FROM pre x JOIN pre y ON x.w = y.w AND y.u < x.u AND least(x.n, y.n) * 5 >= greatest(x.n, y.n) * 4),
sim AS (SELECT DISTINCT x FROM (SELECT pair.x, a.n AS na, b.n AS nb, len(list_intersect(a.ws, b.ws)) AS c FROM pair JOIN u a ON a.u = pair.x JOIN u b ON b.u = pair.y) WHERE 100 * c >= 80 * (na + nb - c)),
gone AS (SELECT f.doc_id, f.k FROM f JOIN u ON u.ws = list_sort(f.ws) LEFT JOIN sim ON sim.x = u.u WHERE sim.x IS NOT NULL OR u.first <> (f.doc_id, f.k)),
kept AS (SELECT l.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS t FROM l ANTI JOIN gone USING (doc_id, k) GROUP BY l.doc_id),
all_ AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(kept.n, 0) AS BIGINT) AS lines_kept, CAST(coalesce(all_.n, 0) - coalesce(kept.n, 0) AS BIGINT) AS lines_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN all_ USING (doc_id)
"""

#: CRC-32 of the UTF-8 bytes of a text: the table by its rule, the bytes of each code point by its range.
_CRC_TABLE = "(SELECT list(t ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM range(256) r(i)))"
_BYTES = (
    "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] WHEN unicode(x) < 2048 THEN [192 + unicode(x) // 64, 128 + unicode(x) % 64]"
    " WHEN unicode(x) < 65536 THEN [224 + unicode(x) // 4096, 128 + unicode(x) // 64 % 64, 128 + unicode(x) % 64]"
    " ELSE [240 + unicode(x) // 262144, 128 + unicode(x) // 4096 % 64, 128 + unicode(x) // 64 % 64, 128 + unicode(x) % 64] END))"
)


def crc32(text: str, table: str = "tab.t") -> str:
    """DuckDB expression; a CROSS JOIN with ``tab`` (one row) is needed."""
    step = f"xor(c // 256, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({_BYTES.format(text)}, lambda y: y::BIGINT)), lambda c, b: {step}), 4294967295)"


SPELLING = rf"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform({_CRC_TABLE}, lambda v: v::BIGINT) AS t),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, {_LOWER.replace("coalesce(text, '')", "w")} AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS w FROM documents)),
h AS (SELECT w, {crc32("d || ':' || w")} AS h FROM r, tab),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word FROM h),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON c.d = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON c.d = w.word
),
best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS b FROM near GROUP BY word),
form AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * n THEN -b[1] END AS form_n FROM words LEFT JOIN best USING (word)),
path AS (SELECT word, word AS at FROM form UNION ALL SELECT path.word, form.form FROM path JOIN form ON form.word = path.at WHERE form.form IS NOT NULL)
SELECT form.word, form.form, path.at AS root, form.n, form.n_near, form.form_n
FROM form JOIN path ON path.word = form.word JOIN form last ON last.word = path.at AND last.form IS NULL
"""

_FEATURES = rf"""
  SELECT k, f FROM (SELECT k, unnest(w) AS f FROM {{0}}) UNION ALL
  SELECT k, w[i] || ' ' || w[i + 1] FROM (SELECT k, w, unnest(range(1, len(w))) AS i FROM {{0}})
"""
RESAMPLE = rf"""
WITH tab AS MATERIALIZED (SELECT list_transform({_CRC_TABLE}, lambda v: v::BIGINT) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS MATERIALIZED (SELECT row_number() OVER () AS k, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS MATERIALIZED ({_FEATURES.format("d")}), gf AS MATERIALIZED ({_FEATURES.format("g")}),
b AS MATERIALIZED (SELECT f, {crc32("f")} % 10000 AS b FROM (SELECT f FROM df UNION SELECT f FROM gf), tab),
s AS (SELECT b, count(*) AS s FROM df JOIN b USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM gf JOIN b USING (f) GROUP BY b),
gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * ((SELECT count(*) FROM gf) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
w AS (SELECT k, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN b USING (f) JOIN gain USING (b) GROUP BY k),
x AS (SELECT doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight, CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT)::DOUBLE AS h FROM d LEFT JOIN w USING (k)),
y AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_words >= 20 AND r <= n * 25 // 100 THEN r END AS rank FROM z
"""
