"""Retrieval and reranking of a batch of mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import docs as D
from ..operators import graph as G
from ..operators import lookup as K
from . import fixtures as fx
from .registry import query

CAND = "WITH" + fx.CAND_SQL


@query(CAND + " SELECT mention_id, qid, score, rank FROM cand")
def r1_fuzzy_candidates(spark, sf_dir):
    return K.fuzzy_candidates(K.prepare(fx.mentions(spark, sf_dir)), fx.entity_table(spark, sf_dir)).select("mention_id", "qid", F.round("score", 4).alias("score"), "rank")


@query("WITH" + fx.E_SQL + ", m(mention) AS (VALUES ('sm_ll%'), ('1'), ('%%'), ('a'), ('STEEL')) SELECT mention, count(DISTINCT lower(label)) AS names FROM m JOIN e ON label ILIKE '%' || mention || '%' GROUP BY 1")
def p2_live_wildcards(spark, sf_dir):
    """% and _ of a mention stay wildcards; short mentions have no trigram."""
    m = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("sm_ll%", "1", "%%", "a", "STEEL")])).alias("mention"))
    names = fx.entities(spark, sf_dir).select(F.lower("label").alias("name")).distinct()
    return K.matching_names(m, names).groupBy("mention").agg(F.count("*").alias("names"))


@query("WITH" + fx.E_SQL + " SELECT mention, qid FROM (VALUES ('FRANCE'), ('Germany'), ('building')) t(mention) JOIN e ON lower(label) = lower(mention) OR len(list_filter(aliases, lambda a: lower(a) = lower(mention))) > 0")
def p1_case_insensitive_equality(spark, sf_dir):
    m = spark.range(1).select(F.explode(F.array(F.lit("FRANCE"), F.lit("Germany"), F.lit("building"))).alias("mention"))
    named = fx.entities(spark, sf_dir).select("qid", F.explode(F.array_distinct(F.transform(F.concat(F.array("label"), "aliases"), F.lower))).alias("name"))
    return m.join(named, F.lower("mention") == F.col("name")).select("mention", "qid").distinct()


@query("WITH" + fx.E_SQL + " SELECT qid FROM e WHERE wikipedia_url IN ('https://en.wikipedia.org/wiki/FRANCE', 'https://en.wikipedia.org/wiki/small_ring') AND coarse_type IN ('LOCATION', 'PRODUCT')")
def p3_p4_crosslink_and_types(spark, sf_dir):
    e = fx.entities(spark, sf_dir)
    hints = F.array(F.lit("https://en.wikipedia.org/wiki/FRANCE"), F.lit("https://en.wikipedia.org/wiki/small_ring"))
    return e.where(F.arrays_overlap(F.array("wikipedia_url", "dbpedia_url"), hints) & F.col("coarse_type").isin("LOCATION", "PRODUCT")).select("qid")


RERANK = """,
full_c AS (SELECT cand.*, coalesce(context_string, '') AS cs FROM cand LEFT JOIN ctx USING (qid)),
terms AS (SELECT *, list_distinct(regexp_extract_all(lower(ctx || ' brand'), '[\\p{L}\\p{N}]+')) AS ts, list_distinct(regexp_extract_all(lower(cs), '[\\p{L}\\p{N}]+')) AS ds FROM full_c),
parts AS (
  SELECT *, CASE WHEN max(score) OVER w <= min(score) OVER w THEN (max(score) OVER w > 0)::INT ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS name_score,
         CASE WHEN len(ds) = 0 THEN 0 ELSE len(list_intersect(ts, ds))::DOUBLE / len(ts) END AS context_score, 0.5 AS type_score,
         len(list_filter(list_concat([label], aliases), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(mention), '[^a-z0-9]+', ' ', 'g')))) > 0 AS exact_name_match
  FROM terms WINDOW w AS (PARTITION BY mention_id)),
final AS (SELECT *, 0.62 * name_score + 0.23 * context_score + 0.10 * type_score + 0.05 * prior AS final_score FROM parts)
SELECT mention_id, qid, round(name_score, 6) AS name_score, round(context_score, 6) AS context_score, type_score, exact_name_match, round(final_score, 6) AS final_score,
       row_number() OVER (PARTITION BY mention_id ORDER BY round(final_score, 9) DESC, exact_name_match DESC, prior DESC, qid) AS final_rank FROM final"""
CTX = ",\n" + fx.SCORED_SQL + ",\nlab AS (SELECT s, label, min(o) AS o FROM triples JOIN e ON qid = o GROUP BY 1, 2), ctx AS (SELECT s AS qid, string_agg(label, '; ' ORDER BY o) AS context_string FROM lab GROUP BY s)"


@query(CAND + CTX + RERANK)
def r5_lookup_batch(spark, sf_dir):
    """The flagship: candidates, context after the cut, weighted reranking, for a whole batch of mentions."""
    e = fx.entity_table(spark, sf_dir)
    r = K.lookup(e, fx.triples(spark, sf_dir, e), fx.mentions(spark, sf_dir))
    return r.select("mention_id", "qid", F.round("name_score", 6).alias("name_score"), F.round("context_score", 6).alias("context_score"), "type_score", "exact_name_match", F.round("final_score", 6).alias("final_score"), "final_rank")


@query(CAND + CTX + RERANK.replace("final AS (", "final0 AS (").replace("FROM final\n", "FROM final0\n").split("SELECT mention_id, qid, round(name_score")[0] + " SELECT mention_id, arg_max(qid, rk) AS qid FROM (SELECT mention_id, qid, -row_number() OVER (PARTITION BY mention_id ORDER BY round(final_score, 9) DESC, exact_name_match DESC, prior DESC, qid) AS rk FROM final0) GROUP BY 1")
def r4_top_one(spark, sf_dir):
    e = fx.entity_table(spark, sf_dir)
    return K.top_one(K.lookup(e, fx.triples(spark, sf_dir, e), fx.mentions(spark, sf_dir))).select("mention_id", "qid")


@query(CAND + CTX + " SELECT DISTINCT qid, coalesce(context_string, '') AS context_string FROM cand LEFT JOIN ctx USING (qid)")
def r3_context_attach(spark, sf_dir):
    """Context only of entities that some mention was cut to."""
    e = fx.entity_table(spark, sf_dir)
    best = K.fuzzy_candidates(K.prepare(fx.mentions(spark, sf_dir)), e).select("qid").distinct()
    near = fx.triples(spark, sf_dir, e).join(best.select(F.col("qid").alias("subject_qid")), "subject_qid", "left_semi")
    return best.join(G.context_strings(near, e.select("qid", "label")), "qid", "left").select("qid", F.coalesce("context_string", F.lit("")).alias("context_string"))


@query("SELECT event_id, round(CASE WHEN hi <= lo THEN (hi > 0)::INT ELSE (value - lo) / (hi - lo) END, 6) AS s FROM (SELECT event_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id, event_type))")
def sc6_a9_min_max(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    s = F.when(hi <= lo, F.when(hi > 0, 1.0).otherwise(0.0)).otherwise((F.col("value") - lo) / (hi - lo))
    return fx.load(spark, sf_dir, "events").select("event_id", F.round(s, 6).alias("s"))


@query("WITH" + fx.E_SQL + "," + fx.SCORED_SQL + """, lab AS (SELECT s, label, min(o) AS o FROM triples JOIN e ON qid = o GROUP BY 1, 2), ctx AS (SELECT s AS qid, left(string_agg(label, '; ' ORDER BY o), 256) AS c FROM lab GROUP BY s)
SELECT qid, label, array_to_string(list_filter(aliases, lambda a: a <> label), '|') AS aliases, coalesce(c, '') AS context_string FROM e LEFT JOIN ctx USING (qid)""")
def o9_search_documents(spark, sf_dir):
    e = fx.entities(spark, sf_dir)
    d = D.search_documents(e, G.context_strings(fx.triples(spark, sf_dir, e), e.select("qid", "label")))
    return d.select("qid", "label", F.array_join("aliases", "|").alias("aliases"), "context_string")


def index(spark, sf_dir):
    d = fx.load(spark, sf_dir, "part")
    return D.inverted_index(d, "p_partkey", {"label": X.lab_tokens("p_name"), "brand": X.lab_tokens(F.concat_ws(" ", "p_brand", "p_type"))})


IDX_SQL = """
f AS (SELECT p_partkey, 'label' AS field, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS t FROM part UNION ALL SELECT p_partkey, 'brand', regexp_extract_all(lower(p_brand || ' ' || p_type), '[a-z0-9]+') FROM part),
idx AS (SELECT field, token, p_partkey, count(*) AS tf, any_value(dl) AS doc_len FROM (SELECT field, p_partkey, len(t) AS dl, unnest(t) AS token FROM f) GROUP BY 1, 2, 3)"""


@query("WITH" + IDX_SQL + " SELECT * FROM idx")
def r8_inverted_index(spark, sf_dir):
    return index(spark, sf_dir)


@query("WITH" + IDX_SQL + """, q AS (SELECT DISTINCT p_name AS query_id, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS token FROM part),
st AS (SELECT field, count(*) AS n, avg(dl) AS al FROM (SELECT field, p_partkey, any_value(doc_len) AS dl FROM idx GROUP BY 1, 2) GROUP BY 1), dfs AS (SELECT field, token, count(*) AS df FROM idx GROUP BY 1, 2),
w AS (SELECT token, p_partkey, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / al)) * CASE field WHEN 'label' THEN 8 ELSE 4 END AS w FROM idx JOIN dfs USING (field, token) JOIN st USING (field)),
s AS (SELECT query_id, p_partkey, round(sum(w), 6) AS score FROM q JOIN w USING (token) GROUP BY 1, 2)
SELECT query_id, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_partkey) AS r FROM s) WHERE r <= 10""")
def r7_bm25_search(spark, sf_dir):
    """Our own scorer over boosted fields: the ten best parts per part name."""
    from pyspark.sql import Window

    q = fx.load(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), F.explode(X.lab_tokens("p_name")).alias("token")).distinct()
    s = D.bm25(index(spark, sf_dir), q, "p_partkey", {"label": 8.0, "brand": 4.0}).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "p_partkey")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 10").drop("r")
