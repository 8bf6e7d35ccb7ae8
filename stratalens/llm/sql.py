"""DuckDB equivalents of the queries that SQL can express."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP4 = """
WITH base AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asks AS (SELECT id, min(v) AS v FROM base WHERE id % 50 = 0 GROUP BY id),
pairs AS (
  SELECT a.id AS query_id, b.id AS vec_id,
         max(CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT)) AS score
  FROM asks a JOIN base b ON a.id <> b.id GROUP BY 1, 2
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP9 = rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce({WORDS.format("text")}, CAST([] AS VARCHAR[])) AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)
), owner AS (SELECT seq, min(doc_id) AS first_doc FROM win GROUP BY seq),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i
  FROM win JOIN owner USING (seq) WHERE doc_id > first_doc
), marked AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
flat AS (
  SELECT d.doc_id, w, list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)) AS keep
  FROM d LEFT JOIN marked USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(keep) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(keep, lambda i: w[i]), ' '), '')) AS kept_sha256
FROM flat
"""

OP2 = rf"""
WITH RECURSIVE d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id,
         coalesce({WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, CAST([] AS VARCHAR[])) AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g
  FROM d
), e AS (SELECT doc_id, unnest(g) AS x FROM s),
sizes AS (SELECT doc_id, len(g) AS n FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM inter JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, l.b FROM reach r JOIN sym l ON r.b = l.a)
SELECT sizes.doc_id, CAST(n AS BIGINT) AS n_shingles, least(sizes.doc_id, coalesce(m.low, sizes.doc_id)) AS component_id,
       sizes.doc_id = least(sizes.doc_id, coalesce(m.low, sizes.doc_id)) AS kept
FROM sizes LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = sizes.doc_id
"""
