"""Tables: cells, column statistics, roles, cell contexts, linking, decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import lookup as K
from ..operators import rerank as R
from ..operators import resolution as A
from ..operators import tables as T
from ..operators import triggers as V
from ..scratch import unsent, written
from ..sources import text_sources as S
from .. import lexicon as L
from . import fixtures as fx
from .registry import query

CELLS = "WITH" + fx.CELLS_SQL


@query("SELECT n_name AS table_id, n_nationkey AS row_id, n_regionkey AS col_id FROM nation WHERE n_nationkey % 4 <> 0")
def src13_targets(spark, sf_dir):
    n = fx.load(spark, sf_dir, "nation")
    broken = F.when(F.col("n_nationkey") % 4 == 0, "x").otherwise(F.col("n_nationkey").cast("string"))
    return S.targets(n.select(F.col("n_name").alias("c0"), broken.alias("c1"), F.col("n_regionkey").cast("string").alias("c2")))


@query("SELECT o_orderkey AS c0, 'Q' || o_custkey || CASE WHEN o_custkey = o_orderkey THEN '' ELSE ' Q' || o_orderkey END AS qids FROM orders WHERE o_orderstatus <> 'F'")
def src14_ground_truth(spark, sf_dir):
    o = fx.load(spark, sf_dir, "orders")
    q = lambda c: F.concat(F.lit("http://x/Q"), F.col(c).cast("string"))
    text = F.when(F.col("o_orderstatus") == "F", "none").otherwise(F.concat_ws(", ", q("o_custkey"), q("o_orderkey"), q("o_custkey")))
    g = S.ground_truth(o.select(F.col("o_orderkey").alias("c0"), F.lit(0).alias("c1"), F.lit(0).alias("c2"), text.alias("c3")))
    return g.select("c0", F.array_join("qids", " ").alias("qids"))


COUNTRIES = ", ".join(f"'{c}'" for c in L.COUNTRIES)
DATE = r"regexp_matches(v, '^\d{4}([-/]\d{1,2}([-/]\d{1,2})?)?$')"
NUM = r"(regexp_matches(v, '^[0-9+.-]') AND regexp_matches(v, '[0-9]') AND len(regexp_extract_all(v, '[A-Za-z]+')) <= 4)"
WORDS = r"list_filter(string_split_regex(v, '\s+'), lambda t: regexp_matches(t, '\p{L}'))"
CAPS = r"len(list_filter(" + WORDS + r", lambda t: regexp_matches(t, '^\p{Lu}')))"
PERSON = rf"(NOT {DATE} AND NOT {NUM} AND CASE WHEN len({WORDS}) >= 2 THEN {CAPS} >= greatest(2, len({WORDS}) - 1) ELSE regexp_matches(v, '^\p{{Lu}}') AND regexp_matches(v, '^[\x00-\x7f]*$') END)"
PLACE = rf"(NOT {DATE} AND (lower(v) IN ({COUNTRIES}) OR contains(v, ',') OR contains(v, '(') OR (len({WORDS}) > 0 AND len(list_filter(({WORDS})[1:3], lambda t: NOT regexp_matches(t, '^\p{{Lu}}'))) = 0)))"
STATS = f""",
d AS (SELECT table_id, row_id, col_id, trim(value) AS v FROM cells WHERE row_id BETWEEN 1 AND 10),
n AS (SELECT table_id, count(DISTINCT row_id) AS rows FROM d GROUP BY 1),
st AS (SELECT table_id, col_id, round(count(*)::DOUBLE / any_value(rows), 4) AS non_empty_ratio, round(count(DISTINCT lower(v))::DOUBLE / count(*), 4) AS unique_ratio,
  round(avg({DATE}::INT), 4) AS date_ratio, round(avg({NUM}::INT), 4) AS numeric_ratio, round(avg({PERSON}::INT), 4) AS person_name_ratio, round(avg({PLACE}::INT), 4) AS location_like_ratio,
  round(avg((NOT {DATE} AND NOT {NUM} AND regexp_matches(v, '\\p{{L}}'))::INT), 4) AS entity_like_ratio
  FROM d JOIN n USING (table_id) WHERE v <> '' GROUP BY 1, 2)"""


@query(CELLS + STATS + " SELECT * FROM st")
def tp2_column_stats(spark, sf_dir):
    s = T.column_stats(fx.cells(spark, sf_dir))
    return s.select("table_id", F.col("col_id").cast("int").alias("col_id"), "non_empty_ratio", "unique_ratio", "date_ratio", "numeric_ratio", "person_name_ratio", "location_like_ratio", "entity_like_ratio")


FAMILIES = f""",
sm AS (SELECT table_id, col_id, list(v ORDER BY f)[1:6] AS samples FROM (SELECT table_id, col_id, v, min(row_id) AS f FROM d WHERE v <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
more AS (SELECT table_id, col_id, round(avg((length(v) >= 60 AND length(regexp_replace(v, '[^ ]', '', 'g')) >= 8)::INT), 4) AS text_blob_ratio,
  round(avg((len(list_filter(regexp_extract_all(lower(v), '[a-z]+'), lambda t: t IN ({", ".join(repr(w) for w in L.WATER_HINTS)}))) > 0)::INT), 4) AS body_of_water_ratio FROM d WHERE v <> '' GROUP BY 1, 2),
names AS (SELECT *, list_distinct(list_transform(samples, lambda x: lower(x))) AS ns FROM sm),
cs AS (SELECT *, len(list_filter(ns, lambda x: x IN ({COUNTRIES}))) >= greatest(1, least(3, len(ns) // 2)) OR (location_like_ratio >= 0.85 AND unique_ratio <= 0.8 AND person_name_ratio < 0.3) AS country_like
  FROM st JOIN more USING (table_id, col_id) JOIN names USING (table_id, col_id)),
fc AS (SELECT table_id, count(*) FILTER (WHERE date_ratio >= 0.65) AS dates, count(*) FILTER (WHERE location_like_ratio >= 0.65 AND numeric_ratio < 0.45) AS places,
  count(*) FILTER (WHERE numeric_ratio >= 0.7 AND date_ratio < 0.4) AS measures, count(*) FILTER (WHERE text_blob_ratio >= 0.4) AS blobs, bool_or(col_id = 0 AND entity_like_ratio >= 0.85 AND numeric_ratio < 0.2) AS named,
  bool_or(col_id = 0 AND person_name_ratio >= 0.45) AS people, bool_or(col_id = 0 AND body_of_water_ratio >= 0.3) AS water, min(col_id) FILTER (WHERE date_ratio >= 0.65) AS date_col FROM cs GROUP BY 1),
fam AS (SELECT table_id, date_col, CASE WHEN named AND dates > 0 AND places >= 2 THEN 'BIOGRAPHY' WHEN water AND measures >= 2 THEN 'GEOGRAPHY' WHEN measures > 0 AND blobs > 0 AND places > 0 THEN 'GEOGRAPHY' WHEN people AND dates > 0 THEN 'BIOGRAPHY' ELSE 'GENERIC_ENTITY_TABLE' END AS family,
  CASE WHEN named AND dates > 0 AND places >= 2 THEN least(0.92, 0.78 + people::INT * 0.08) WHEN water AND measures >= 2 THEN 0.84 WHEN measures > 0 AND blobs > 0 AND places > 0 THEN 0.68 WHEN people AND dates > 0 THEN 0.64 ELSE 0.45 END AS confidence FROM fc)"""


@query(CELLS + STATS + FAMILIES + " SELECT table_id, family, CAST(confidence AS DOUBLE) AS confidence FROM fam")
def tp4_families(spark, sf_dir):
    return T.families(T.column_stats(fx.cells(spark, sf_dir))).select("table_id", "family", "confidence")


ROLES = """,
lv AS (SELECT cs.*, family, confidence, date_col, CASE WHEN numeric_ratio < 0.25 AND NOT country_like THEN CASE WHEN text_blob_ratio < 0.35 THEN 2 ELSE 1 END ELSE 0 END AS level FROM cs JOIN fam USING (table_id)),
nc AS (SELECT *, coalesce(min(col_id) FILTER (WHERE numeric_ratio < 0.2 AND date_ratio < 0.2 AND entity_like_ratio >= 0.75 AND (date_col IS NULL OR col_id < date_col)) OVER (PARTITION BY table_id), 0) AS name_col, max(level) OVER (PARTITION BY table_id) AS top FROM lv),
ft AS (SELECT table_id, arg_max(col_id, [body_of_water_ratio, entity_like_ratio - numeric_ratio - text_blob_ratio, -col_id]) AS feature_col FROM nc WHERE level = top GROUP BY 1),
rl AS (SELECT *, lower(array_to_string(samples, ' ')) AS joined, len(list_filter(samples, lambda v: contains(v, ',') OR contains(v, '('))) > 0 AS comma FROM nc JOIN ft USING (table_id)),
roles AS (SELECT table_id, col_id, family, CAST(confidence AS DOUBLE) AS confidence,
  CASE family WHEN 'BIOGRAPHY' THEN CASE WHEN col_id = name_col AND entity_like_ratio >= 0.75 THEN 'PERSON_NAME_OR_ALIAS' WHEN col_id = date_col THEN 'BIRTH_DATE' WHEN country_like THEN 'COUNTRY' WHEN location_like_ratio >= 0.7 THEN CASE WHEN comma THEN 'BIRTH_REGION' ELSE 'BIRTH_CITY' END WHEN numeric_ratio >= 0.6 THEN 'NUMERIC_ATTRIBUTE' ELSE 'TEXT_ATTRIBUTE' END
  WHEN 'GEOGRAPHY' THEN CASE WHEN col_id = feature_col AND entity_like_ratio >= 0.75 AND numeric_ratio < 0.25 THEN CASE WHEN body_of_water_ratio >= 0.2 THEN 'BODY_OF_WATER_NAME' ELSE 'GEOGRAPHIC_FEATURE_NAME' END WHEN country_like THEN 'COUNTRY'
    WHEN numeric_ratio >= 0.7 THEN CASE WHEN contains(joined, 'km2') OR contains(joined, 'sq') THEN 'AREA_MEASURE' WHEN contains(joined, 'km3') OR contains(joined, 'cu') THEN 'VOLUME_MEASURE' WHEN contains(joined, 'ft') OR contains(joined, 'm') THEN 'DEPTH_MEASURE' WHEN contains(joined, 'length') THEN 'LENGTH_MEASURE' ELSE 'NUMERIC_MEASURE' END
    WHEN text_blob_ratio >= 0.4 THEN 'DESCRIPTION_TEXT' ELSE 'TEXT_ATTRIBUTE' END ELSE 'UNKNOWN' END AS role,
  CAST(CASE family WHEN 'BIOGRAPHY' THEN CASE WHEN col_id = name_col AND entity_like_ratio >= 0.75 THEN CASE WHEN person_name_ratio >= 0.5 THEN 0.9 ELSE 0.82 END WHEN col_id = date_col THEN 0.94 WHEN country_like THEN 0.86 WHEN location_like_ratio >= 0.7 THEN 0.78 WHEN numeric_ratio >= 0.6 THEN 0.6 ELSE 0.45 END
  WHEN 'GEOGRAPHY' THEN CASE WHEN col_id = feature_col AND entity_like_ratio >= 0.75 AND numeric_ratio < 0.25 THEN 0.88 WHEN country_like THEN 0.82 WHEN numeric_ratio >= 0.7 THEN 0.74 WHEN text_blob_ratio >= 0.4 THEN 0.84 ELSE 0.45 END ELSE 0.3 END AS DOUBLE) AS role_confidence FROM rl)"""


@query(CELLS + STATS + FAMILIES + ROLES + " SELECT table_id, col_id, family, confidence, role, role_confidence FROM roles")
def tp5_roles(spark, sf_dir):
    return T.roles(T.column_stats(fx.cells(spark, sf_dir))).withColumn("col_id", F.col("col_id").cast("int"))


def targets(spark, sf_dir) -> DataFrame:
    """The cells that name a row's entity: the first column of every table."""
    return unsent(fx.cells(spark, sf_dir).where("row_id > 0 and col_id = 0").select("table_id", "row_id", "col_id"))


def contexts(spark, sf_dir, *, without: str = "customer") -> DataFrame:
    """without: the table that the SQL of the schema queries (pp1 to pp15) leaves out; linking takes every table."""
    return T.cell_contexts(fx.cells(spark, sf_dir), targets(spark, sf_dir).where(F.col("table_id") != without))


@query(CELLS + """, v AS (SELECT table_id, row_id, col_id, trim(value) AS v FROM cells WHERE row_id > 0),
t AS (SELECT * FROM v WHERE col_id = 0 AND table_id <> 'customer'),
fs AS (SELECT table_id, v, min(row_id) AS first_at FROM v WHERE col_id = 0 AND v <> '' GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY first_at) AS r FROM fs),
s AS (SELECT table_id, list(v ORDER BY first_at) AS l FROM top WHERE r <= 6 GROUP BY 1), o AS (SELECT table_id, row_id, string_agg(v, '|' ORDER BY col_id) AS other FROM v WHERE col_id > 0 AND v <> '' GROUP BY 1, 2)
SELECT t.table_id, t.row_id, t.v AS mention, coalesce(other, '') AS other, array_to_string(list_filter(l, lambda x: x <> t.v)[1:5], '|') AS samples FROM t LEFT JOIN o USING (table_id, row_id) JOIN s USING (table_id)""")
def pp1_w9_cell_contexts(spark, sf_dir):
    c = contexts(spark, sf_dir)
    return c.select("table_id", "row_id", "mention", F.array_join("other_row_values", "|").alias("other"), F.array_join("column_samples", "|").alias("samples"))


@query("""WITH m AS (SELECT DISTINCT p_name AS mention FROM part UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer),
r AS (SELECT mention, len(string_split(mention, ' ')) AS w, list_filter([CASE WHEN len(string_split(mention, ' ')) <= 1 THEN 'single_token' END, CASE WHEN length(mention) <= 10 THEN 'short_surface' END,
  CASE WHEN len(string_split(mention, ' ')) = 1 AND regexp_matches(mention, '^[A-Z][A-Za-z]*$') THEN 'capitalized_common_word_shape' END], lambda x: x IS NOT NULL) AS rs FROM m)
SELECT mention, CASE WHEN len(rs) = 0 THEN 'strong' WHEN w >= 2 THEN 'medium' ELSE 'weak' END AS strength, array_to_string(rs, ',') AS reasons FROM r""")
def pp5_mention_strength(spark, sf_dir):
    t = lambda n, c: fx.load(spark, sf_dir, n).select(F.col(c).alias("mention"))
    m = t("part", "p_name").unionByName(t("nation", "n_name")).unionByName(t("customer", "c_name")).distinct()
    return m.select("mention", T.mention_strength(F.col("mention")).alias("m")).select("mention", "m.strength", F.array_join("m.reasons", ",").alias("reasons"))


#: the seed schema of every target and, from it, what the policies make of it
SEED = """,
v AS (SELECT table_id, row_id, col_id, trim(value) AS v FROM cells WHERE row_id > 0),
t AS (SELECT * FROM v WHERE col_id = 0 AND table_id <> 'customer'),
hd AS (SELECT table_id, col_id, trim(value) AS h FROM cells WHERE row_id = 0),
fs AS (SELECT table_id, v, min(row_id) AS first_at FROM v WHERE col_id = 0 AND v <> '' GROUP BY 1, 2), tp AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY first_at) AS r FROM fs),
s6 AS (SELECT table_id, list(v ORDER BY first_at) AS l FROM tp WHERE r <= 6 GROUP BY 1),
o AS (SELECT table_id, row_id, list(v ORDER BY col_id) AS other, list(h || '=' || v ORDER BY col_id) AS related FROM v JOIN hd USING (table_id, col_id) WHERE col_id > 0 AND v <> '' GROUP BY 1, 2),
c0 AS (SELECT t.table_id, t.row_id, t.v AS mention, h AS header, coalesce(other, []) AS other, coalesce(related, []) AS related, list_filter(l, lambda x: x <> t.v)[1:5] AS samples,
  trim(replace(regexp_replace(t.v, '\\[[^\\]]*\\]', '', 'g'), '*', ' '), ' .,:;!?-_') AS canonical FROM t LEFT JOIN o USING (table_id, row_id) JOIN s6 USING (table_id) JOIN hd ON hd.table_id = t.table_id AND hd.col_id = 0),
c1 AS (SELECT c0.*, family, confidence, role, role_confidence, len(string_split(canonical, ' ')) AS w FROM c0 JOIN roles ON roles.table_id = c0.table_id AND roles.col_id = 0),
c2 AS (SELECT *, CASE WHEN w > 1 AND length(canonical) > 10 THEN 'strong' WHEN w >= 2 THEN 'medium' WHEN w <= 1 OR length(canonical) <= 10 THEN 'weak' END AS strength FROM c1),
c3 AS (SELECT *, CASE WHEN family = 'BIOGRAPHY' AND role = 'PERSON_NAME_OR_ALIAS' THEN [{'c': 'PERSON', 'f': 'HUMAN', 'p': CASE WHEN strength <> 'weak' THEN 0.9 ELSE 0.84 END}, {'c': 'WORK', 'f': 'FILM', 'p': 0.28}, {'c': 'LOCATION', 'f': 'CITY', 'p': 0.24}]
  WHEN family = 'GEOGRAPHY' AND role IN ('BODY_OF_WATER_NAME', 'GEOGRAPHIC_FEATURE_NAME') THEN [{'c': 'LOCATION', 'f': 'LANDMARK', 'p': 0.9}, {'c': 'WORK', 'f': 'MUSIC_WORK', 'p': 0.18}]
  WHEN w >= 2 THEN [{'c': 'PERSON', 'f': 'HUMAN', 'p': 0.62}, {'c': 'ORGANIZATION', 'f': 'COMPANY', 'p': 0.22}] ELSE [{'c': 'MISC', 'f': 'MISC', 'p': 0.42}, {'c': 'PERSON', 'f': 'HUMAN', 'p': 0.38}, {'c': 'LOCATION', 'f': 'CITY', 'p': 0.32}] END AS hyp,
  list_filter([CASE WHEN confidence < 0.72 AND role_confidence < 0.86 THEN 'low_table_confidence' END, CASE WHEN role IN ('', 'UNKNOWN') THEN 'unknown_column_role' END, CASE WHEN role_confidence < 0.72 THEN 'low_role_confidence' END,
    CASE WHEN strength IN ('medium', 'strong') AND (confidence < 0.8 OR role_confidence < 0.8) THEN 'surface_form_resists_uncertain_schema' END], lambda x: x IS NOT NULL) AS uncertain,
  list_concat(CASE WHEN header <> '' AND NOT regexp_matches(header, '^(?i)col[0-9]+$') THEN [{'v': header, 'w': 0.75}] ELSE [] END, list_transform(other, lambda x: {'v': x, 'w': CASE WHEN regexp_matches(x, '[0-9]') THEN 0.25 ELSE 0.65 END}), list_transform(samples, lambda x: {'v': x, 'w': 0.5})) AS soft0,
  list_filter([canonical, mention, replace(canonical, '.', '')], lambda x: x <> '') AS var0 FROM c2),
c4 AS (SELECT *, role = 'BODY_OF_WATER_NAME' AS water, len(uncertain) > 0 AS unsure, (role = 'BODY_OF_WATER_NAME' AND hyp[1].f = 'LANDMARK') OR NOT ((strength = 'weak' AND confidence < 0.8) OR (hyp[1].p < 0.82 AND confidence < 0.78)) AS firm,
  list_filter(soft0, lambda x, i: list_position(list_transform(soft0, lambda y: y.v), x.v) = i) AS soft1, list_filter(var0, lambda x, i: list_position(var0, x) = i) AS var1 FROM c3),
sc AS (SELECT *, CASE WHEN water OR firm THEN 'ENTITY' ELSE '' END AS item_filters, CASE WHEN unsure THEN '' WHEN water THEN 'LOCATION' WHEN firm THEN hyp[1].c ELSE '' END AS coarse_hints, CASE WHEN unsure THEN '' WHEN water THEN 'LANDMARK' WHEN firm THEN hyp[1].f ELSE '' END AS fine_hints,
  CASE WHEN water THEN [{'c': 'LOCATION', 'f': 'LANDMARK'}] ELSE list_transform(hyp, lambda h: {'c': h.c, 'f': h.f}) END AS plan,
  list_concat(CASE WHEN water AND NOT regexp_matches(lower(canonical), '(^| )(bay|gulf|lake|ocean|river|sea|strait)( |$)') THEN [{'t': 'Lake ' || canonical, 'w': 0.96}] ELSE [] END,
    list_transform(var1, lambda x, i: {'t': x, 'w': CASE WHEN i = 1 THEN 1.0 WHEN x = mention THEN 0.7 ELSE greatest(0.45, 0.7 - (i - 1) * 0.1) END})) AS variants,
  list_concat(soft1, CASE WHEN water THEN [{'v': 'lake', 'w': 0.85}, {'v': 'body of water', 'w': 0.75}, {'v': 'freshwater lake', 'w': 0.7}] ELSE [] END) AS soft FROM c4),
pl AS (SELECT *, list_transform(list_filter(list_sort(list_transform(soft, lambda x, i: {'w': -x.w, 'i': i, 'v': x.v}))[1:12], lambda x: x.w <= -0.3), lambda x: x.v) AS terms, list_sort(list_transform(variants, lambda x, i: {'w': -x.w, 'i': i, 't': x.t}))[1].t AS lookup_mention FROM sc)"""
SCHEMA = CELLS + STATS + FAMILIES + ROLES + SEED


def schema(spark, sf_dir, *, without: str = "customer", tasks: int | None = None) -> DataFrame:
    """tasks: into how many the cells are dealt, as schemas are dearer than their bytes tell."""
    c = contexts(spark, sf_dir, without=without)
    c = c if tasks is None else c.repartition(tasks, *R.CELL)
    return T.finished(T.seed_schema(c, T.roles(T.column_stats(fx.cells(spark, sf_dir)))))


def _shown(items: str, *fields: str):
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), "|")


@query(SCHEMA + """ SELECT table_id, row_id, family, role, strength, array_to_string(uncertain, ',') AS uncertain, item_filters, coarse_hints, fine_hints, array_to_string(list_transform(CASE WHEN water THEN list_concat([{'c': 'LOCATION', 'f': 'LANDMARK', 'p': 0.92}], list_filter(hyp, lambda h: h.f <> 'LANDMARK')) ELSE hyp END, lambda h: h.f), ',') AS hypotheses,
  array_to_string(list_transform(variants, lambda x: x.t), '|') AS variants, array_to_string(related, '|') AS related, array_to_string(list_transform(plan, lambda x, i: i || ':' || x.f || ':' || CASE WHEN i = 1 AND NOT unsure THEN 'hard' ELSE 'soft' END), '|') AS plan FROM sc""")
def pp10_seed_schema(spark, sf_dir):
    """The whole seed schema of every target cell, after the policies for waters and uncertain tables."""
    s = schema(spark, sf_dir)
    related = F.array_join(F.transform("related_cells", lambda x: F.concat_ws("=", x["column_name"], x["cell_value"])), "|")
    return s.select("table_id", "row_id", "family", "role", "strength", F.array_join("uncertain", ",").alias("uncertain"), *[F.array_join(c, ",").alias(c) for c in ("item_filters", "coarse_hints", "fine_hints")], F.array_join(F.transform("hypotheses", lambda h: h["fine_type"]), ",").alias("hypotheses"), F.array_join(F.transform("variants", lambda v: v["text"]), "|").alias("variants"), related.alias("related"), _shown("plan", "rank", "fine_type", "retrieval_mode").alias("plan"))


@query(SCHEMA + " SELECT table_id, row_id, x.v AS value, CAST(x.w AS DOUBLE) AS weight FROM (SELECT table_id, row_id, unnest(soft) AS x FROM sc) UNION ALL SELECT table_id, row_id, x.t, CAST(x.w AS DOUBLE) FROM (SELECT table_id, row_id, unnest(variants) AS x FROM sc)")
def pp2_pp3_weights(spark, sf_dir):
    """Context terms and query variants with their weights."""
    s = schema(spark, sf_dir)
    soft = s.select("table_id", "row_id", F.explode("soft").alias("x")).select("table_id", "row_id", "x.value", "x.weight")
    return soft.unionByName(s.select("table_id", "row_id", F.explode("variants").alias("x")).select("table_id", "row_id", F.col("x.text").alias("value"), "x.weight"))


@query(SCHEMA + " SELECT table_id, row_id, lookup_mention, array_to_string(CASE WHEN len(terms) > 0 THEN terms ELSE list_filter(list_concat(other, samples), lambda x, i: list_position(list_concat(other, samples), x) = i) END, '|') AS lookup_context FROM pl")
def pp14_payload(spark, sf_dir):
    return T.payload(schema(spark, sf_dir)).select("table_id", "row_id", "lookup_mention", F.array_join("lookup_context", "|").alias("lookup_context"))


@query(SCHEMA + """,
st0 AS (SELECT table_id, row_id, list_concat([{'s': 'primary', 'k': item_filters || '/' || coarse_hints || '/' || fine_hints}],
  flatten(list_transform(plan, lambda h, i: [{'s': 'hypothesis_' || i, 'k': 'ENTITY/' || h.c || '/' || CASE h.f WHEN 'MISC' THEN '' ELSE h.f END}, {'s': 'hypothesis_' || i || '_relax_fine', 'k': 'ENTITY/' || h.c || '/'}])),
  CASE WHEN strength = 'weak' OR family <> 'GEOGRAPHY' THEN [{'s': 'no_type_context_only', 'k': item_filters || '//'}] ELSE [] END, CASE WHEN item_filters <> '' THEN [{'s': 'item_category_only', 'k': item_filters || '//'}] ELSE [] END) AS l FROM sc),
st1 AS (SELECT table_id, row_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: y.k), x.k) = i) AS l FROM st0)
SELECT table_id, row_id, CAST(n AS INT) AS stage_no, x.s AS stage, x.k AS filters FROM (SELECT table_id, row_id, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM st1)""")
def pp15_payload_stages(spark, sf_dir):
    """Every request of every cell, in order, with its filters."""
    s = T.payload_stages(schema(spark, sf_dir))
    return s.select("table_id", "row_id", "stage_no", "stage", F.concat_ws("/", *[F.array_join(c, ",") for c in ("item", "coarse", "fine")]).alias("filters"))


TOP_K = 25
#: features are dear by the row: tasks are cut by cells, not by bytes
CELLS_A_TASK = 2_000


def link(spark, sf_dir, cells: DataFrame, *, k: int = TOP_K) -> DataFrame:
    """Every cell linked: its requests in stages, the stages up to the first with enough hits merged, features per cell and
    candidate, reranked.  Requests of cells that ask for the same are sent once."""
    e = fx.entity_table(spark, sf_dir)
    asked = T.payload_stages(cells).join(T.payload(cells).select(*R.CELL, "mention", "lookup_mention"), R.CELL)
    filters = F.concat_ws("|", "lookup_mention", *[F.array_join(c, ",") for c in ("item", "coarse", "fine")])
    asked = written(asked.withColumn("mention_id", F.md5(filters)), "requests")
    once = asked.groupBy("mention_id").agg(*[F.first(c).alias(n) for c, n in (("lookup_mention", "mention"), ("coarse", "coarse_hints"), ("fine", "fine_hints"), ("item", "item"))])
    once = written(once, "asked")
    best = K.fuzzy_candidates(K.prepare(once), e, k=k).join(once.select("mention_id", "item"), "mention_id").join(e.select("qid", "item_category"), "qid")
    best = best.where((F.size("item") == 0) | F.array_contains("item", F.col("item_category"))).select("mention_id", "qid", (F.col("score") * 10).alias("es_score"))
    best = written(best, "best")
    hits = R.staged_requests(asked, best, enough=max(6, k), keys=[*R.CELL, "mention"])
    # what hangs on a candidate, or on it and the mention, is computed once for all cells
    ids = best.select("qid").distinct()
    near = fx.triples(spark, sf_dir, e).join(ids.select(F.col("qid").alias("subject_qid")), "subject_qid", "left_semi")
    about = e.select("qid", "label", "aliases", "coarse_type", "fine_type", "item_category", "prior", "wikipedia_url", "dbpedia_url", "description")
    known = R.entity_features(about.join(ids, "qid", "left_semi").join(G.context_strings(near, e.select("qid", "label")), "qid", "left"))
    said = asked.select("mention_id", "mention").distinct().join(best.select("mention_id", "qid"), "mention_id").select("mention", "qid").distinct()
    known = written(R.name_features(said.join(written(known, "candidates"), "qid")), "named")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4_000, cells.count() // CELLS_A_TASK))
    found = R.cell_tokens(cells).select(*R.CELL, *R.OF_CELL).repartition(n, *R.CELL).join(hits.join(known, ["mention", "qid"]), R.CELL)
    r = R.rerank(R.features(found).drop(*R.OF_CELL))
    return written(r.where(F.col("reranked_rank") <= k), "ranked")


def cells_of(spark, sf_dir) -> DataFrame:
    return written(schema(spark, sf_dir, without="", tasks=int(spark.conf.get("spark.sql.shuffle.partitions"))), "schemas")


def linked(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schemas, ranked candidates and a decision for every target, written once for the query that reads them."""
    cells = cells_of(spark, sf_dir)
    r = link(spark, sf_dir, cells)
    return cells, r, written(R.decide(r, targets=cells), "decisions")


@query()
def f1_f7_rerank_cells(spark, sf_dir):
    r = link(spark, sf_dir, cells_of(spark, sf_dir))
    return r.select(*R.CELL, "qid", "candidate_family", F.round("heuristic_score", 4).alias("heuristic_score"), F.round("final_score", 4).alias("final_score"), "reranked_rank", "raw_rank", F.array_join("stages", ",").alias("stages"))


@query()
def d1_decisions(spark, sf_dir):
    """Every target cell, those without candidates too."""
    return linked(spark, sf_dir)[2].withColumn("reason_codes", F.array_join("reason_codes", ","))


def gold(spark, sf_dir) -> DataFrame:
    """A cell's own row is its entity; rows of people and lakes have none."""
    t = targets(spark, sf_dir)
    off = F.create_map(*[F.lit(x) for p in fx.OFFSETS.items() for x in p])[F.col("table_id")]
    return t.where(off.isNotNull()).withColumn("gold_qid", F.concat(F.lit("Q"), (off + F.col("row_id") - 1).cast("string")))


def verdicts(spark, sf_dir) -> DataFrame:
    """Verdicts as a table: the gold entity, with a confidence and abstentions that depend on the row."""
    return gold(spark, sf_dir).select(*R.CELL, F.col("gold_qid").alias("verdict_qid"), F.when(F.col("row_id") % 3 == 0, 0.9).otherwise(0.75).alias("verdict_confidence"), (F.col("row_id") % 7 == 0).alias("verdict_abstain"))


def resolved(spark, sf_dir):
    cells, r, d = linked(spark, sf_dir)
    semantic, shepherd = V.semantic_trigger(r, d), V.ambiguity_trigger(r, d)
    v = verdicts(spark, sf_dir)
    return cells, r, d, semantic, shepherd, written(A.resolve(d, r, semantic, shepherd, shepherd=v, semantic=v), "resolved")


@query()
def e1_a6_evaluation(spark, sf_dir):
    _, r, _, _, _, final = resolved(spark, sf_dir)
    g = gold(spark, sf_dir)
    return R.summary(final, g, R.diagnostics(r, g), ["table_id"])


@query()
def a7_weighted_total(spark, sf_dir):
    return R.weighted_total(e1_a6_evaluation(spark, sf_dir), ["accuracy", "coverage", "recall_at_1", "recall_at_10"])


@query("WITH s AS (SELECT l_orderkey AS k, CAST(l_linenumber AS INT) AS stage_no, l_partkey AS qid, l_extendedprice AS sc FROM lineitem), n AS (SELECT k, stage_no, count(*) AS c FROM s GROUP BY 1, 2), f AS (SELECT k, min(stage_no) FILTER (WHERE c >= 2) AS stop FROM n GROUP BY 1) SELECT k, qid, max(sc) AS es_score, string_agg(DISTINCT CAST(stage_no AS VARCHAR), ',' ORDER BY CAST(stage_no AS VARCHAR)) AS stages FROM s JOIN f USING (k) WHERE stop IS NULL OR stage_no <= stop GROUP BY 1, 2")
def r9_j13_staged_retrieval(spark, sf_dir):
    """Line numbers stand for stages, parts for hits: stages up to the first with two hits count, merged by id."""
    li = fx.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("stage_no"), F.col("l_partkey").alias("qid"), F.col("l_extendedprice").alias("es_score"))
    return R.staged(li, enough=2, keys=["k"]).withColumn("stages", F.array_join("stages", ","))


@query()
def d8_hybrid_resolution(spark, sf_dir):
    """Which adjudicator judged how many cells, and what came of it."""
    final = resolved(spark, sf_dir)[5]
    return final.groupBy("table_id", "resolution_mode").agg(F.count("*").alias("cells"), F.count_if("abstain").alias("abstained"))


@query()
def d2_semantic_trigger(spark, sf_dir):
    _, r, d = linked(spark, sf_dir)
    return V.semantic_trigger(r, d).groupBy("table_id", "should_run", F.array_join("reason_codes", ",").alias("reasons")).agg(F.count("*").alias("cells"))


@query()
def d3_ambiguity_trigger(spark, sf_dir):
    _, r, d = linked(spark, sf_dir)
    return V.ambiguity_trigger(r, d).groupBy("table_id", "should_run", F.array_join("reason_codes", ",").alias("reasons")).agg(F.count("*").alias("cells"))


@query()
def d5_payloads(spark, sf_dir):
    """What the adjudicator of hard ambiguities is given: the keys of the payload and its candidates, in order."""
    cells, r, d = linked(spark, sf_dir)
    p = A.payloads(r, d, cells, V.ambiguity_trigger(r, d), kind="shepherd")
    ids = F.from_json(F.get_json_object("payload", "$.candidates[*].qid"), "array<string>")
    return p.select(*R.CELL, F.array_join(F.json_object_keys("payload"), ",").alias("parts"), F.array_join(ids, ",").alias("qids"))


@query()
def d7_widen_retrieval(spark, sf_dir):
    """Cells with three equal labels at the top are looked up again with three times the candidates."""
    cells, r, d = linked(spark, sf_dir)
    more = written(V.wants_more_candidates(r, V.semantic_trigger(r, d)).where("widen").select(*R.CELL), "widen")
    wide = link(spark, sf_dir, cells.join(more, R.CELL, "left_semi"), k=min(100, 3 * TOP_K))
    n = lambda df, name: df.groupBy(*R.CELL).agg(F.count("*").alias(name))
    return more.join(n(r, "before"), R.CELL).join(n(wide, "after"), R.CELL, "left")


@query("WITH c AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS qid FROM lineitem), r AS (SELECT l_orderkey AS k, l_partkey AS qid, CAST(l_linenumber AS INT) AS rank, l_quantity / 40 AS conf FROM lineitem UNION ALL SELECT l_orderkey, -1, 1, 0.5 FROM lineitem) SELECT k, qid, min(rank) AS rank, greatest(0, least(1, max(conf) FILTER (WHERE rank = m))) AS confidence FROM (SELECT r.*, min(rank) OVER (PARTITION BY k, qid) AS m FROM r JOIN c USING (k, qid)) GROUP BY 1, 2")
def d10_ranking_validation(spark, sf_dir):
    li = fx.load(spark, sf_dir, "lineitem")
    given = li.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("qid"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity") / 40).alias("confidence"))
    # of equal ranks the larger confidence counts, so that the result doesn't hang on row order
    given = given.groupBy("k", "qid", "rank").agg(F.max("confidence").alias("confidence"))
    unknown = li.select(F.col("l_orderkey").alias("k"), F.lit(-1).cast("long").alias("qid"), F.lit(1).alias("rank"), F.lit(0.5).alias("confidence"))
    return V.valid_rankings(given.unionByName(unknown), given, ["k"])


def results(spark, sf_dir) -> DataFrame:
    cells, r, _, semantic, shepherd, final = resolved(spark, sf_dir)
    g = gold(spark, sf_dir)
    s = cells.select(*R.CELL, F.col("strength").alias("mention_strength"), (F.size(F.concat("item_filters", "coarse_hints", "fine_hints")) > 0).alias("filtered"), F.col("confidence").alias("schema_confidence"))
    t = semantic.select(*R.CELL, F.col("reason_codes").alias("a")).join(shepherd.select(*R.CELL, F.col("reason_codes").alias("b")), R.CELL)
    fired = r.where("reranked_rank = 1").select(*R.CELL, F.col("same_type_resolver_applied").alias("resolver_applied"))
    x = final.select(*R.CELL, "selected_qid", "abstain", F.col("resolution_mode").alias("mode"), F.col("reason_codes").alias("own")).join(g, R.CELL).join(R.diagnostics(r, g), R.CELL).join(s, R.CELL)
    x = x.join(t, R.CELL, "left").join(fired, R.CELL, "left").na.fill({"resolver_applied": False})
    none = F.array().cast("array<string>")
    x = x.withColumns({"correct": F.coalesce(F.col("selected_qid") == F.col("gold_qid"), F.lit(False)), "gold_in_candidates": F.col("in_candidates"), "gold_rank": F.col("best_rank"), "resolution_mode": F.col("mode"), "trigger_codes": F.concat(F.coalesce("a", none), F.transform(F.coalesce("b", none), lambda c: F.concat(F.lit("shepherd:"), c))), "triggers": F.array_distinct(F.concat(F.coalesce("a", none), F.coalesce("b", none), F.filter("own", lambda c: c == "no_candidates")))})
    return x.withColumn("family", V.error_family(x))


@query()
def e3_a8_error_report(spark, sf_dir):
    """Failures by family, mode and trigger reason."""
    return A.error_report(results(spark, sf_dir), ["table_id"])
