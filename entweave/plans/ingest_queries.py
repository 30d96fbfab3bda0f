"""Dump parsing, record transform, edges and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import dump as P
from . import fixtures as fx
from .registry import query

E = "WITH" + fx.E_SQL
G_SQL = "WITH" + fx.SCORED_SQL


def raw(spark, sf_dir, *fields):
    return P.parse(fx.dump_text(spark, sf_dir), fields=list(fields) or None)


@query("WITH" + fx.E_SQL + "," + fx.EDGES_SQL + ", c AS (SELECT s, count(DISTINCT p) AS n FROM edges GROUP BY s) SELECT qid, coalesce(n, 0) + (kind = 'customer')::INT AS n_properties, CAST(popularity AS BIGINT) AS n_sites FROM e LEFT JOIN c ON s = qid")
def src2_dump_scan(spark, sf_dir):
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return raw(spark, sf_dir, "claims", "sitelinks").select(F.col("id").alias("qid"), size("claims").alias("n_properties"), size("sitelinks").alias("n_sites"))


@query(E + """ SELECT qid, label, label || '|' || label || ' (it)' AS labels, array_to_string(aliases, '|') AS aliases,
  CASE kind WHEN 'region' THEN 'region' WHEN 'nation' THEN 'sovereign state' WHEN 'supplier' THEN 'company' WHEN 'part' THEN 'product' END AS description,
  CASE kind WHEN 'customer' THEN 'Q5' ELSE '' END AS types, CASE kind WHEN 'part' THEN 'PRODUCT' ELSE coarse_type END AS coarse_type, fine_type, 'ENTITY' AS item_category, popularity, round(prior, 8) AS prior,
  CASE WHEN popularity > 0 THEN 'https://en.wikipedia.org/wiki/' || replace(replace(label, ' ', '_'), '#', '%23') END AS wikipedia_url FROM e""")
def t19_record_transform(spark, sf_dir):
    """Every field of the record, through JSON text and back."""
    r = P.records(raw(spark, sf_dir))
    return r.select("qid", "label", F.array_join("labels", "|").alias("labels"), F.array_join("aliases", "|").alias("aliases"), "description", F.array_join("types", "|").alias("types"), "coarse_type", "fine_type", "item_category", "popularity", F.round("prior", 8).alias("prior"), "wikipedia_url")


@query(E + " SELECT qid, label AS en, label || ' (it)' AS it FROM e")
def t2_value_map(spark, sf_dir):
    m = P.value_map(F.col("labels"))
    return raw(spark, sf_dir, "labels").select(F.col("id").alias("qid"), m["en"].alias("en"), m["it"].alias("it"))


@query(E + " SELECT qid, len(list_distinct(aliases)) AS n_en, kind = 'part' AS has_it FROM e")
def t3_alias_map(spark, sf_dir):
    """Labels of any language are no aliases; once the English label is taken away, the Italian alias that equals it stays."""
    labels = P.value_map(F.col("labels"))
    part = P.value_map(F.col("descriptions"))["en"] == "product"  # not by the id: parts from the millionth on are Q6 and more
    part = F.coalesce(part, F.lit(False))
    a = P.alias_map(F.col("aliases"), F.when(part, F.map_filter(labels, lambda k, _: k != "en")).otherwise(labels))
    return raw(spark, sf_dir, "labels", "descriptions", "aliases").select(F.col("id").alias("qid"), F.greatest(F.coalesce(F.size(a["en"]), F.lit(0)), F.lit(0)).cast("long").alias("n_en"), a["it"].isNotNull().alias("has_it"))


@query(E + " SELECT qid, label || ' (it)' AS chosen FROM e")
def t4_language_selection(spark, sf_dir):
    m = P.pick_languages(P.value_map(F.col("labels")), ["it", "de"])
    return raw(spark, sf_dir, "labels").select(F.col("id").alias("qid"), F.array_join(F.map_values(m), "|").alias("chosen"))


@query(E + "," + fx.EDGES_SQL + """, c AS (SELECT s, p, o FROM edges UNION ALL SELECT qid, 'P', 'Q5' FROM e WHERE kind = 'customer'), d AS (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY p, o) AS r FROM (SELECT s, min(p) AS p, o FROM c GROUP BY s, o)),
i AS (SELECT s, string_agg(o, ' ' ORDER BY r) AS ids FROM d WHERE r <= 32 GROUP BY s) SELECT qid, coalesce(ids, '') AS ids FROM e LEFT JOIN i ON s = qid""")
def t7_claim_object_ids(spark, sf_dir):
    none = F.array().cast("array<string>")
    return raw(spark, sf_dir, "claims").select(F.col("id").alias("qid"), F.array_join(F.coalesce(P.all_claim_ids(F.col("claims"), 32), none), " ").alias("ids"))


@query(E + " SELECT qid, CASE WHEN popularity > 0 THEN 'enwiki' END AS site, CASE WHEN popularity > 0 THEN label END AS title FROM e")
def t13_sitelink_choice(spark, sf_dir):
    s = P.wikipedia_site(F.coalesce("sitelinks", F.expr("cast(map() as map<string,struct<title:string>>)")), P.value_map(F.col("labels")))
    return raw(spark, sf_dir, "labels", "sitelinks").select(F.col("id").alias("qid"), s.alias("s")).select("qid", "s.site", "s.title")


@query(E + " SELECT qid, replace(replace(label, ' ', '_'), '#', '%23') AS ref, 'https://en.wikipedia.org/wiki/' || replace(replace(label, ' ', '_'), '#', '%23') AS url, 'it.wikipedia.org|' || replace(replace(label, ' ', '_'), '#', '%23') AS it_ref FROM e")
def t16_t17_compact_refs(spark, sf_dir):
    site = lambda s: F.struct(F.lit(s).alias("site"), F.col("label").alias("title"))
    e = fx.entities(spark, sf_dir).select("qid", P.wikipedia_url(site("enwiki")).alias("u"), P.wikipedia_url(site("itwiki")).alias("i"))
    ref = P.compact_ref(F.col("u"))
    return e.select("qid", ref.alias("ref"), P.expand_ref(ref, "wikipedia").alias("url"), P.compact_ref(F.col("i")).alias("it_ref"))


@query("WITH" + fx.EDGES_SQL + " SELECT p AS predicate_pid, rank, count(*) AS n, count(DISTINCT s) AS subjects FROM edges GROUP BY 1, 2")
def g1_explode_claims(spark, sf_dir):
    e = P.edges(raw(spark, sf_dir, "claims")).where("object_qid <> 'Q5'")
    return e.groupBy("predicate_pid", "rank").agg(F.count("*").alias("n"), F.count_distinct("subject_qid").alias("subjects"))


@query("WITH" + fx.E_SQL + " SELECT coarse_type, CASE kind WHEN 'supplier' THEN 'COMPANY,ENTITY,ORGANIZATION' WHEN 'customer' THEN 'ENTITY,HUMAN,PERSON' WHEN 'part' THEN 'ENTITY,PRODUCT,PRODUCT_GENERIC' WHEN 'nation' THEN 'COUNTRY,ENTITY,LOCATION' ELSE 'ENTITY,LOCATION,REGION' END AS profiles, count(*) AS n FROM e GROUP BY ALL")
def g2_subject_profiles(spark, sf_dir):
    e = fx.entities(spark, sf_dir)
    p = G.subject_profiles(F.col("item_category"), F.col("coarse_type"), F.col("fine_type"))
    return e.groupBy("coarse_type", F.array_join(F.array_sort(p), ",").alias("profiles")).agg(F.count("*").alias("n"))


def scored(spark, sf_dir):
    return fx.scored_edges(spark, sf_dir)


EDGE_COLS = "s AS subject_qid, p AS predicate_pid, o AS object_qid"


@query(G_SQL + f" SELECT {EDGE_COLS}, score, rank_no FROM scored")
def g3_edge_scores(spark, sf_dir):
    return scored(spark, sf_dir)


@query(G_SQL + f" SELECT {EDGE_COLS}, score, rank_no FROM best")
def g4_best_edges(spark, sf_dir):
    return G.best_edges(scored(spark, sf_dir), by_subject=True)


@query(G_SQL + f" SELECT {EDGE_COLS}, object_rank, predicate_rank FROM placed")
def g5_predicate_order(spark, sf_dir):
    return G.ordered_edges(G.best_edges(scored(spark, sf_dir), by_subject=True)).select(*G.EDGE, "object_rank", "predicate_rank")


@query(G_SQL + f" SELECT {EDGE_COLS}, pos FROM triples")
def g6_round_robin_prune(spark, sf_dir):
    return fx.triples(spark, sf_dir)


@query("WITH" + fx.EDGES_SQL + " SELECT DISTINCT o AS qid FROM edges")
def g7_related_ids(spark, sf_dir):
    return raw(spark, sf_dir, "claims").select(F.explode(P.all_claim_ids(F.col("claims"), 1_000_000)).alias("qid")).where("qid <> 'Q5'").distinct()


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), w AS (SELECT DISTINCT CAST(floor(k * n / 97) AS BIGINT) AS i FROM range(0, 97) t(k), (SELECT max(n) AS n FROM o)) SELECT o_orderkey FROM o JOIN w USING (i)")
def g8_even_sample(spark, sf_dir):
    return G.even_sample(fx.load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 97)


@query(E + "," + fx.SCORED_SQL + ", n AS (SELECT s AS qid, 'out' AS direction, p AS predicate_pid, o AS other_qid FROM triples UNION ALL SELECT o, 'in', p, s FROM triples) SELECT e.qid, direction, predicate_pid, other_qid FROM (SELECT qid FROM e UNION ALL SELECT 'Q9') e LEFT JOIN n USING (qid)")
def j3_neighbourhood(spark, sf_dir):
    """Edges of every entity in both directions; ids without edges keep a row."""
    e = fx.entity_table(spark, sf_dir)
    ids = e.select("qid").unionByName(spark.range(1).select(F.lit("Q9").alias("qid")))
    return G.neighbours(ids, fx.triples(spark, sf_dir, e))


@query(G_SQL + " SELECT s AS qid, string_agg(DISTINCT o, ' ' ORDER BY o) AS objects FROM triples GROUP BY s")
def a1_objects_per_subject(spark, sf_dir):
    """Bounded lists: a pruned subject has at most twelve edges."""
    return fx.triples(spark, sf_dir).groupBy(F.col("subject_qid").alias("qid")).agg(F.array_join(F.array_sort(F.collect_set("object_qid")), " ").alias("objects"))


CONTEXT_SQL = "WITH" + fx.E_SQL + "," + fx.SCORED_SQL + """, l AS (SELECT s, label, min(o) AS o FROM triples JOIN e ON qid = o GROUP BY 1, 2)
SELECT s AS qid, string_agg(label, '; ' ORDER BY o) AS context_string FROM l GROUP BY s"""


@query(CONTEXT_SQL)
def sc11_j2_context_strings(spark, sf_dir):
    e = fx.entities(spark, sf_dir)
    return G.context_strings(fx.triples(spark, sf_dir, e), e.select("qid", "label"), tasks=fx.edge_tasks(spark, sf_dir))


@query("WITH" + fx.E_SQL + " SELECT qid, array_to_string(list_concat([label], list_filter(aliases, lambda a: a <> label)), ' ') AS names FROM e")
def sc14_name_text(spark, sf_dir):
    from ..operators.docs import name_text

    return fx.entities(spark, sf_dir).select("qid", name_text(F.col("labels"), F.col("aliases")).alias("names"))
