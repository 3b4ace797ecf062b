"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH doc AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w
  FROM documents WHERE regexp_matches(text, '{_WORDS}')
), item AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w
  FROM benchmark WHERE regexp_matches(text, '{_WORDS}')
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM doc, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i)
), its AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM item, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i)
), n AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(any_value(n) AS INTEGER) AS n_shingles
FROM ds JOIN its USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n) * 75
"""

OP2 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k
  FROM d, unnest(generate_series(1, len(w) - 12)) AS t(i)
), least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM win JOIN least USING (k), unnest(generate_series(0, 12)) AS t(o)
  WHERE first < doc_id
), lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n, coalesce(len(ps), 0) AS r,
         CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END AS k
  FROM d LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""


OP13 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), part AS (SELECT vec_id, label, p, x[p] AS v FROM e, unnest(generate_series(1, len(x))) AS t(p)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(sum(a.v * b.v) AS BIGINT) AS score
  FROM part a JOIN part b USING (p) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
  GROUP BY ALL
), pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1,
        "op2_substring_dedup": OP2,
        "op6_warc": OP6,
        "op7_exact_dedup": OP7,
        "op13_hard_negatives": OP13,
    }
