"""The dealt operators that SQL can express, as DuckDB SQL."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column):
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


ORACLE = {
    "op4_block_naming": f"""
WITH d AS (SELECT doc_id, {_lower("text")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
    "op9_positional_index": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, k, k + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d
), hits AS (
  SELECT doc_id, s, n, item_id FROM
    (SELECT doc_id, s, n AS m, list_slice(w, s, s + n - 1) AS win FROM starts, (SELECT DISTINCT n FROM wins) WHERE s + n - 1 <= len(w)) x
    JOIN wins ON wins.n = x.m AND wins.win = x.win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op13_importance_resampling": rf"""
WITH RECURSIVE bytes(b, v, k) AS (
  SELECT b, b, 0 FROM range(256) r(b)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bytes WHERE k < 8
), d AS (
  SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), df AS (
  SELECT doc_id, f, count(*) AS n FROM (
    SELECT doc_id, unnest(w) AS f FROM d
    UNION ALL
    SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM d) GROUP BY ALL
), bf AS (
  SELECT f, count(*) AS n FROM (
    SELECT unnest(w) AS f FROM b
    UNION ALL
    SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM b) GROUP BY ALL
), crc(f, left_bytes, c) AS (
  SELECT f, hex(encode(f)), 4294967295 FROM (SELECT f FROM df UNION SELECT f FROM bf)
  UNION ALL
  SELECT f, substr(left_bytes, 3), xor(c // 256, v) FROM crc
  JOIN bytes ON k = 8 AND b = xor(c % 256, CAST('0x' || substr(left_bytes, 1, 2) AS BIGINT)) WHERE left_bytes <> ''
), bucket AS (
  SELECT f, xor(c, 4294967295) % 10000 AS x FROM crc WHERE left_bytes = ''
), raw AS (
  SELECT x, sum(n) AS s FROM df JOIN bucket USING (f) GROUP BY x
), target AS (
  SELECT x, sum(n) AS t FROM bf JOIN bucket USING (f) GROUP BY x
), sizes AS (
  SELECT coalesce((SELECT sum(n) FROM df), 0) AS s_all, coalesce((SELECT sum(n) FROM bf), 0) AS t_all
), gain AS (
  SELECT x, CAST(floor(1000.0 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM raw LEFT JOIN target USING (x), sizes
), mean AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight
  FROM df JOIN bucket USING (f) JOIN gain USING (x) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN mean USING (doc_id)
), placed AS (
  SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_words >= 20) * 25 // 100 AS draw
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= draw THEN place END AS rank FROM placed
""",
}
