"""DuckDB statements for the queries of this package that SQL can express."""

from __future__ import annotations

OP2 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
     w AS (SELECT r, unnest(ts) AS term FROM d),
     tf AS (SELECT r, term, count(*) AS tf FROM w GROUP BY r, term),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     size AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
     m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ts) * n_docs) // total AS m FROM d, size),
     items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark) AS b),
     q AS (SELECT i, item_id, unnest(ts) AS term FROM items),
     qtf AS (SELECT i, item_id, term, count(*) AS repeats FROM q GROUP BY i, item_id, term),
     scored AS (SELECT i, item_id, doc_id, r,
                       CAST(sum(repeats * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
                                * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
                FROM qtf JOIN tf USING (term) JOIN df USING (term) JOIN m USING (r), size
                GROUP BY i, item_id, doc_id, r),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM (SELECT DISTINCT * FROM embeddings) AS rows
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     pair AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                     CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
              FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
     pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score
             FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth FROM pair WHERE same) AS p
             WHERE nth <= 5),
     neg AS (SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
                    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
             FROM pos JOIN pair USING (anchor_id)
             WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op11_lexical_search": OP11, "op12_hard_negatives": OP12}
