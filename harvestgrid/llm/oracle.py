"""SQL, for DuckDB, of the registered queries of this package that can be said in it.

The others learn, hash (CRC-32), align or schedule; tests hold them against brute force, a round trip or labels kept out.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op11_source_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
        ) AS words
    FROM documents
),
used AS (SELECT row_id, lang, source, unnest(words) AS term FROM docs),
terms AS (
    SELECT lang, term, count(*) AS uses FROM used GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3
),
counts AS (
    SELECT u.lang, u.source, u.term, count(*) AS n FROM used u JOIN terms t USING (lang, term) GROUP BY ALL
),
langs AS (SELECT lang, count(*)::HUGEINT AS size, sum(uses)::HUGEINT AS total FROM terms GROUP BY lang),
grps AS (
    SELECT g.lang, g.source, coalesce(c.total, 0)::HUGEINT AS total, coalesce(l.size, 0) AS size, coalesce(l.total, 0) AS lang_total
    FROM (SELECT DISTINCT lang, source FROM docs) g
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) c USING (lang, source)
    LEFT JOIN langs l USING (lang)
),
shares AS (
    SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.size) AS p,
        1 + 1000000000::HUGEINT * (t.uses + 1) // (g.lang_total + g.size) AS q
    FROM grps g JOIN terms t USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
        GROUP BY ALL
    ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
apart AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
    (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank
FROM pairs
UNION ALL
SELECT * FROM (
    SELECT lang, source, 'term' AS part, item, value,
        (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank
    FROM apart
) WHERE rank <= 200
"""

# Sets of five-word shingles compared wherever two share one; classes by closure over the links.
SQL["op9_ngram_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END
    ) AS s
    FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT x, y FROM common c JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE c.n::DOUBLE / (p.n + q.n - c.n) >= 0.8
),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS class_id, (SELECT count(*) FROM links WHERE x = d.doc_id) AS n_links
FROM documents d
"""

SQL["op10_embedding_join"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y
    FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links, (SELECT min(y) FROM reach WHERE x = e.vec_id) AS component_id,
    e.vec_id = (SELECT min(y) FROM reach WHERE x = e.vec_id) AS kept
FROM embeddings e
"""
