"""Scans, sinks and keyed tables over events, orders and the entity fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import store as S
from ..sources import text_sources as T
from . import fixtures as fx
from .registry import query


def events(spark, sf_dir):
    return fx.load(spark, sf_dir, "events")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS coarse, CASE WHEN max(event_id) % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n FROM events GROUP BY user_id")
def src3_type_map(spark, sf_dir):
    """JSON lines of types per user, one key or the other; the last line wins."""
    e = events(spark, sf_dir)
    one = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.array("event_type").alias("coarse_types"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).alias("fine_types")))
    other = F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.array("event_type").alias("ner_coarse_types"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("A"), F.lit("B"))).alias("ner_fine_types")))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 2 == 0, one).otherwise(other).alias("value"))
    t = T.type_map(lines)
    return t.select(F.col("id").cast("long").alias("id"), F.col("coarse_types")[0].alias("coarse"), F.coalesce(F.size("fine_types"), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


@query("SELECT c_mktsegment, count(*) AS matched, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def src4_j4_label_join(spark, sf_dir):
    """Rows without a partner are dropped and counted."""
    o, c = fx.load(spark, sf_dir, "orders").select("o_custkey"), fx.load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    missing = c.join(o.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_anti").agg(F.count("*").alias("missing"))
    matched = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("matched"))
    return matched.join(F.broadcast(missing), F.lit(True))  # one row


@query("SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def src8_changed_since(spark, sf_dir):
    return T.changed_since(events(spark, sf_dir), "ts", "2024-01-20").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query("WITH" + fx.E_SQL + " SELECT qid FROM e WHERE regexp_matches(qid, '^Q[0-9]+$') ORDER BY CAST(substr(qid, 2) AS BIGINT), qid LIMIT 50")
def src10_first_ids(spark, sf_dir):
    return T.first_numeric_ids(fx.entities(spark, sf_dir), "qid", 50)


@query("WITH" + fx.E_SQL + ", ids AS (SELECT 'Q' || (2000000 + i) AS qid, 100 - i AS pos FROM range(0, 40) t(i)) SELECT pos, qid, label, label IS NOT NULL AS found FROM ids LEFT JOIN e USING (qid)")
def src11_j6_requested_order(spark, sf_dir):
    i = F.col("id")
    ids = spark.range(40).select(F.concat(F.lit("Q"), (2_000_000 + i).cast("string")).alias("qid"), (100 - i).alias("pos"))
    again = ids.withColumn("pos", F.col("pos") + 1000)  # asked for twice: the first place counts
    return T.in_requested_order(ids.unionByName(again), fx.entities(spark, sf_dir).select("qid", "label"), "qid").select("pos", "qid", "label", "found")


@query("SELECT 'lineitem' AS name, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def a11_row_counts(spark, sf_dir):
    count = lambda n: fx.load(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count("lineitem").unionByName(count("orders")).unionByName(count("documents"))


@query("SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def snk1_upsert_latest(spark, sf_dir):
    return S.keep_latest(events(spark, sf_dir).select("user_id", "event_type", "value", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).drop("event_id")


@query("WITH old AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-10'), new AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10'), b AS (SELECT user_id, event_id, value, 0 AS n FROM old UNION ALL SELECT user_id, event_id, value, 1 FROM new) SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_id DESC) AS r FROM b) WHERE r = 1")
def snk1_upsert_merge(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "value", "ts")
    cut = F.lit("2024-01-10").cast("timestamp")
    return S.upsert(e.where(F.col("ts") < cut).drop("ts"), e.where(F.col("ts") >= cut).drop("ts"), ["user_id"], "event_id").select("user_id", "event_id", "value")


@query("WITH" + fx.EDGES_SQL + " SELECT s AS subject_qid, p AS predicate_pid, o AS object_qid, max(CASE rank WHEN 'preferred' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END) AS v FROM edges GROUP BY 1, 2, 3")
def snk2_upsert_triples(spark, sf_dir):
    e = fx.raw_edges(spark, sf_dir)
    v = F.when(F.col("rank") == "preferred", 3).when(F.col("rank") == "normal", 2).otherwise(1).cast("long").alias("updated_at")
    rows = e.select("subject_qid", "predicate_pid", "object_qid", v)
    none = rows.select(F.lit("").alias("subject_qid"), "predicate_pid", "object_qid", "updated_at")
    return S.upsert_triples(rows, rows.unionByName(none)).withColumnRenamed("updated_at", "v")


@query("WITH" + fx.EDGES_SQL + ", gone AS (SELECT 'Q' || (4000000 + c_custkey) AS s FROM customer WHERE c_custkey % 3 = 0), d AS (SELECT DISTINCT s, p, o FROM edges) SELECT s AS subject_qid, p AS predicate_pid, o AS object_qid FROM d WHERE s NOT IN (SELECT s FROM gone) UNION ALL SELECT s, 'P31', 'Q5' FROM gone WHERE CAST(substr(s, 2) AS BIGINT) % 2 = 0")
def snk3_replace_triples(spark, sf_dir):
    old = fx.raw_edges(spark, sf_dir).drop("rank").distinct()
    gone = fx.load(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == 0).select(fx.qid("customer", "c_custkey").alias("subject_qid"))
    new = gone.where(F.substring("subject_qid", F.lit(2), F.length("subject_qid")).cast("bigint") % 2 == 0).select("subject_qid", F.lit("P31").alias("predicate_pid"), F.lit("Q5").alias("object_qid"))
    return S.replace_triples(old, gone, new)


@query("SELECT event_id, sha256('{\"coarse_hints\":[\"' || event_type || '\"],\"context_terms\":[],\"crosslink_terms\":[],\"fine_hints\":[],\"include_top_k\":false,\"limit\":20,\"mention_norm\":\"u' || user_id || '\"}') AS k FROM events")
def snk5_sc5_cache_key(spark, sf_dir):
    none = F.array().cast("array<string>")
    key = S.cache_key(F.concat(F.lit("u"), F.col("user_id").cast("string")), none, F.array("event_type"), none, none, F.lit(20), F.lit(False))
    return events(spark, sf_dir).select("event_id", key.alias("k"))


@query("WITH k AS (SELECT sha256(event_type) AS cache_key, max(event_id) AS v FROM events WHERE event_type <> 'view' GROUP BY 1), ask AS (SELECT DISTINCT sha256(event_type) AS cache_key FROM events) SELECT cache_key, CAST(v AS VARCHAR) AS result, v IS NOT NULL AS hit FROM ask LEFT JOIN k USING (cache_key)")
def snk5_query_cache(spark, sf_dir):
    e = events(spark, sf_dir).select(F.sha2("event_type", 256).alias("cache_key"), "event_type", F.col("event_id").cast("string").alias("result"), F.col("event_id").alias("created_at"))
    put = e.where("event_type <> 'view'").drop("event_type")
    cache = S.cache_put(put.limit(0), S.keep_latest(put, ["cache_key"], ["created_at"]))
    return S.cache_get(cache, e.select("cache_key").distinct()).select("cache_key", "result", "hit")


@query("SELECT count(*) FILTER (WHERE ts >= m - INTERVAL 864000 SECOND) AS kept, count(*) FILTER (WHERE ts < m - INTERVAL 864000 SECOND) AS deleted FROM events, (SELECT max(ts) AS m FROM events)")
def snk6_ttl_prune(spark, sf_dir):
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))  # one row; never the wall clock
    out = e.select("ts").join(F.broadcast(now), F.lit(True)).select(S.expired(e, "ts", F.col("now"), 864_000).alias("x"))
    return out.agg(F.count_if(~F.col("x")).alias("kept"), F.count_if("x").alias("deleted"))


@query("SELECT n_nationkey AS k, '{\"id\":\"N' || n_nationkey || '\",\"labels\":{\"en\":\"' || n_name || '\",\"it\":\"' || lower(n_name) || '\"}}' AS j FROM nation")
def snk8_labels_json(spark, sf_dir):
    labels = F.map_from_entries(F.array_sort(F.map_entries(F.create_map(F.lit("it"), F.lower("n_name"), F.lit("en"), F.col("n_name")))))
    return fx.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), X.canonical_json({"labels": labels, "id": F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))}).alias("j"))


@query("SELECT p_partkey, '{\"index\":{\"_id\":\"Q' || (5000000 + p_partkey) || '\"}}' || chr(10) || '{\"label\":\"' || p_name || '\"}' AS pair FROM part")
def snk11_bulk_lines(spark, sf_dir):
    p = fx.load(spark, sf_dir, "part")
    action = F.to_json(F.struct(F.struct(fx.qid("part", "p_partkey").alias("_id")).alias("index")))
    return p.select("p_partkey", F.concat_ws("\n", action, F.to_json(F.struct(F.col("p_name").alias("label")))).alias("pair"))


@query("SELECT r_name AS name, NULL::BIGINT AS region FROM region UNION ALL SELECT n_name, n_regionkey FROM nation")
def snk13_union_export(spark, sf_dir):
    a = fx.load(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    b = fx.load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT i AS copy_no, ((i * 1103515245 + 12345) % 2147483647) % 25 + 1 AS rn FROM range(0, 5000) t(i)")
def sc22_lcg_rows(spark, sf_dir):
    n = fx.load(spark, sf_dir, "nation").count()
    return spark.range(5000).select(F.col("id").alias("copy_no"), S.lcg_row(F.col("id"), n).alias("rn"))


@query(
    "WITH s AS (SELECT *, row_number() OVER (ORDER BY qid) AS rn, 'x' AS x FROM (SELECT 'Q' || (2000000 + n_nationkey) AS qid, n_name AS label FROM nation)), g AS (SELECT i, ((i * 1103515245 + 12345) % 2147483647) % 25 + 1 AS rn FROM range(0, 5000) t(i)) "
    "SELECT 'Q' || (CAST(substr(qid, 2) AS BIGINT) + (i + 1) * 10000000) AS qid, label, i AS copy_no FROM g JOIN s USING (rn)"
)
def s1_j1_sc23_replicate(spark, sf_dir):
    seed = fx.load(spark, sf_dir, "nation").select(fx.qid("nation", "n_nationkey").alias("qid"), F.col("n_name").alias("label"))
    return S.replicate(seed, 5000).select("qid", "label", "copy_no")


@query("SELECT event_type, CAST(floor(sum(length(props)) / count(*) * 100000000) AS BIGINT) AS projected FROM events GROUP BY 1")
def a10_size_projection(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(S.projected_bytes(F.sum(F.length("props")), F.count("*"), 100_000_000).alias("projected"))


@query("WITH" + fx.E_SQL + " SELECT count(*) AS n, max(CASE WHEN regexp_matches(qid, '^[QP][0-9]+$') THEN CAST(substr(qid, 2) AS BIGINT) ELSE 0 END) AS top FROM e")
def a3_max_numeric_id(spark, sf_dir):
    number = F.substring("qid", F.lit(2), F.length("qid")).try_cast("bigint")
    return fx.entities(spark, sf_dir).agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("qid").rlike("^[QP][0-9]+$"), number).otherwise(0)), F.lit(0)).alias("top"))


@query("WITH" + fx.E_SQL + " SELECT coarse_type, count(*) AS stored, count(*) FILTER (WHERE len(aliases) > 0) AS with_aliases, round(avg(popularity), 4) AS avg_popularity, max(length(label)) AS longest FROM e GROUP BY 1")
def a4_pipeline_counters(spark, sf_dir):
    return fx.entities(spark, sf_dir).groupBy("coarse_type").agg(F.count("*").alias("stored"), F.count_if(F.size("aliases") > 0).alias("with_aliases"), F.round(F.avg("popularity"), 4).alias("avg_popularity"), F.max(F.length("label")).cast("long").alias("longest"))
