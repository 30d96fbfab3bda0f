"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import op6
from .language_id import op9
from .line_dedup import op4
from .minhash import op2
from .packing import op7
from .quality_classifier import op10
from .substring_dedup import op1
from .suffix_dedup import op3
from .topk import op8
from .url_filter import op5


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5(table(spark, sf_dir, "pages"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_line_dedup, op5_url_filters,
        op6_benchmark_decontamination, op7_best_fit_packing, op8_exact_top_k, op9_language_id, op10_quality_classifier,
    )
}

ORACLES: dict[str, str] = {
    "op6_benchmark_decontamination": r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, i, occ.n, item_id FROM occ JOIN win USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256 FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
    "op5_url_filters": r"""
WITH p AS (
  SELECT page_id, url, make_timestamp((1704067200 + (((page_id * 7919) % 43200 + 43200) % 43200) * 60) * 1000000) AS fetched,
         nullif(rtrim(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '') AS host,
         regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
log AS (
  SELECT 'h:' || host AS key, 'spam' AS category, action, len(host) % 20 + more AS d
  FROM hosts, (VALUES ('add', 0), ('remove', 6), ('add', 9)) AS a(action, more)
  UNION ALL
  SELECT 'p:' || host || '/en', 'adult', action, len(host || '/en') % 20 + more
  FROM hosts, (VALUES ('add', 3), ('remove', 8)) AS a(action, more)
  UNION ALL
  SELECT 'd:' || x, 'malware', action, len(x) % 20 + more
  FROM (VALUES ('example.com'), ('example.net')) AS t(x), (VALUES ('add', 1), ('remove', 4)) AS a(action, more)),
held AS (
  SELECT key, category, make_timestamp((1704067200 + d * 86400) * 1000000) AS f, action,
         make_timestamp((1704067200 + lead(d) OVER (PARTITION BY key, category ORDER BY d) * 86400) * 1000000) AS t FROM log),
parts AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda s: s <> '') AS g FROM p WHERE host IS NOT NULL),
probe AS (
  SELECT page_id, fetched, 'h:' || host AS key FROM parts
  UNION SELECT page_id, fetched, 'd:' || array_to_string(l[i:], '.') FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM parts)
  UNION SELECT page_id, fetched, 'p:' || host || '/' || array_to_string(g[1:i], '/') FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM parts)),
act AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS c
  FROM (SELECT DISTINCT page_id, probe.key, category FROM probe JOIN held ON probe.key = held.key AND action = 'add' AND fetched >= f AND (t IS NULL OR fetched < t))
  GROUP BY page_id)
SELECT page_id, host, fetched, coalesce(n, 0) > 0 AS blocked, coalesce(n, 0) AS n_active, coalesce(c, '') AS categories
FROM p LEFT JOIN act USING (page_id)
""",
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
f AS (SELECT doc_id, no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k FROM l WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
w AS (
  SELECT doc_id, k, 3 AS n, s || chr(10) || lead(s) OVER o || chr(10) || lead(s, 2) OVER o AS g FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY k)
  UNION ALL SELECT doc_id, k, 1, s FROM f WHERE length(s) >= 200),
late AS (SELECT doc_id, k, n FROM (SELECT doc_id, k, n, row_number() OVER (PARTITION BY n, g ORDER BY doc_id, k) AS r FROM w WHERE g IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM late),
m AS (SELECT l.doc_id, l.no, l.line, f.k, gone.k IS NOT NULL AS out FROM l LEFT JOIN f USING (doc_id, no) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.k = f.k),
a AS (
  SELECT doc_id, count(k) AS n_lines, count(*) FILTER (WHERE out) AS n_removed, count(k) FILTER (WHERE NOT out) AS n_left,
         coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT out), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(CASE WHEN n_removed > 0 AND n_left = 0 THEN '' ELSE kept END) AS kept_sha256 FROM a
""",
}
