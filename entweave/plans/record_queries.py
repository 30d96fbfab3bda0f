"""Records around the core: neighbourhood bags of words, exports, pages, coercions, normalised input from outside."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as X
from ..operators import docs as D
from ..operators import graph as G
from ..operators import lookup as K
from ..operators import schemas as N
from ..operators import store as S
from ..sources import dump as P
from . import fixtures as fx
from .registry import query

E = "WITH" + fx.E_SQL
PREDICATES = {"P361": "part of", "P17": "country", "P27": "country of citizenship", "P176": "manufacturer", "P495": "country of origin"}
_STOP = ", ".join(f"'{w}'" for w in L.STOPWORDS)


@query(E + "," + fx.SCORED_SQL + ", pn(p, pl) AS (VALUES " + ", ".join(f"('{p}', '{t}')" for p, t in PREDICATES.items()) + rf"""),
n AS (SELECT s AS qid, 1 AS d, p, o AS other FROM triples UNION ALL SELECT o, 2, p, s FROM triples),
tk AS (SELECT n.qid, d, n.p, other, list_filter(list_concat(regexp_extract_all(lower(pl), '[\p{{L}}\p{{N}}]+'), regexp_extract_all(lower(coalesce(label, '')), '[\p{{L}}\p{{N}}]+')), lambda x: length(x) > 1 AND x NOT IN ({_STOP})) AS t FROM n JOIN pn USING (p) LEFT JOIN e ON e.qid = other),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, p, other) AS n FROM tk WHERE len(t) > 0), b AS (SELECT qid, flatten(list(t ORDER BY n))[1:128] AS l FROM r WHERE n <= 128 GROUP BY 1)
SELECT qid, md5(coalesce(array_to_string(l, ' '), '')) AS bow, coalesce(len(l), 0) AS n FROM e LEFT JOIN b USING (qid)""")
def sc17_h9_graph_bow(spark, sf_dir):
    """Tokens of every entity's neighbourhood, outgoing before incoming; hubs are cut before their edges are gathered."""
    e = fx.entity_table(spark, sf_dir)
    names = spark.createDataFrame(list(PREDICATES.items()), "qid string, label string")
    b = D.graph_bows(e.select("qid"), fx.triples(spark, sf_dir, e), e.select("qid", "label").unionByName(names))
    return b.select("qid", F.md5(F.array_join("bow", " ")).alias("bow"), F.size("bow").cast("long").alias("n"))


@query(E + "," + fx.SCORED_SQL + """, lab AS (SELECT s, label, min(o) AS o FROM triples JOIN e ON qid = o GROUP BY 1, 2), ctx AS (SELECT s AS qid, string_agg(label, '; ' ORDER BY o) AS c FROM lab GROUP BY s)
SELECT qid, label, coarse_type, fine_type, popularity, wikipedia_url, coalesce(c, '') AS context_string FROM e LEFT JOIN ctx USING (qid)""")
def src7_entity_scan(spark, sf_dir):
    """All entities in order, compact references expanded, contexts attached."""
    e = fx.entity_table(spark, sf_dir)
    stored = e.withColumn("ref", P.compact_ref(F.col("wikipedia_url")))
    c = G.context_strings(fx.triples(spark, sf_dir, e), e.select("qid", "label"))
    out = stored.join(c, "qid", "left").select("qid", "label", "coarse_type", "fine_type", "popularity", P.expand_ref(F.col("ref"), "wikipedia").alias("wikipedia_url"), F.coalesce("context_string", F.lit("")).alias("context_string"))
    return out.orderBy("qid")


@query(E + " SELECT qid, label FROM e WHERE qid IN (SELECT 'Q' || (4000000 + o_custkey) FROM orders WHERE o_orderstatus = 'F')")
def src9_multi_key_fetch(spark, sf_dir):
    """Names of the entities that another table lists: a semi-join, whatever the number of keys."""
    ids = fx.load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(fx.qid("customer", "o_custkey").alias("qid"))
    return fx.entities(spark, sf_dir).join(ids, "qid", "left_semi").select("qid", "label")


@query("SELECT user_id, md5(array_to_string(l, ' ')[1:80]) AS text FROM (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS l FROM events GROUP BY 1)")
def sc12_context_text(spark, sf_dir):
    """Items joined by one blank while they fit; here all do."""
    e = fx.load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("l"))
    return e.select("user_id", F.md5(X.bounded_join(F.col("l"), 80, " ")).alias("text"))


@query("SELECT doc_id, md5(replace(strip_accents(lower(text)), 'ß', 'ss')) AS folded FROM documents")
def sc25_ascii_folding(spark, sf_dir):
    return fx.load(spark, sf_dir, "documents").select("doc_id", F.md5(X.ascii_fold(F.lower("text"))).alias("folded"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r > 40 AND r <= 140")
def w11_offset_limit(spark, sf_dir):
    o = fx.load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down"))
    return S.page(o, ["down", "o_orderkey"], offset=40, limit=100).drop("down")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def w12_keep_first(spark, sf_dir):
    e = fx.load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("at"))
    return S.keep_first(e, ["user_id", "event_type"], ["at"]).drop("at")


@query("SELECT o_orderkey, o_orderpriority AS raw, replace(upper(trim(split_part(o_orderpriority, '-', 1))), ' ', '') || ',A:b/c.d-e_1' AS labels FROM orders")
def p7_type_labels(spark, sf_dir):
    """Hints trimmed, each once; signs that no type has would end the job."""
    word = F.replace(F.upper(F.trim(F.split("o_orderpriority", "-")[0])), F.lit(" "), F.lit(""))
    hints = F.array(F.concat(F.lit("  "), word), F.lit("A:b/c.d-e_1 "), word, F.lit(" "))
    m = K.prepare(fx.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderpriority").alias("mention"), hints.alias("coarse_hints")))
    return m.select(F.col("mention_id").alias("o_orderkey"), F.col("mention").alias("raw"), F.array_join("coarse_hints", ",").alias("labels"))


@query(E + " SELECT qid, CASE WHEN len(aliases) > 0 THEN 'other ' || label ELSE 'other' END AS labels_text, array_to_string(list_filter(aliases, lambda a, i: list_position(aliases, a) = i), ' ') AS aliases_text FROM e")
def h1_name_texts(spark, sf_dir):
    """What a search index keeps beside the label: secondary labels, and aliases that are none of the labels."""
    e = fx.entities(spark, sf_dir)
    labels = F.when(F.size("aliases") > 0, F.concat(F.array(F.lit(" other "), F.lit("other")), F.array("label"))).otherwise(F.array(F.lit("other"), F.lit("  ")))
    t = D.name_texts(F.when(F.size("aliases") > 0, F.lit("main")).otherwise(F.col("label")), labels, F.concat("aliases", F.array(F.lit("other"))))
    return e.select("qid", t.alias("t")).select("qid", "t.*")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a=x,b=' || user_id WHEN 1 THEN '' ELSE '' END AS texts, CASE event_id % 5 WHEN 1 THEN 'x|' || user_id ELSE '' END AS items FROM events""")
def h2_json_coercions(spark, sf_dir):
    """Objects, lists, texts, numbers and broken JSON where another kind was expected."""
    u = F.col("user_id").cast("string")
    kinds = [F.concat(F.lit('{"a":"x","b":"'), u, F.lit('","c":null,"d":[1]}')), F.concat(F.lit('["x"," ","'), u, F.lit('",null]')), F.lit('"text"'), F.lit("12"), F.lit("{broken")]
    j = F.get(F.array(*kinds), (F.col("event_id") % 5).cast("int"))
    texts = F.transform(F.array_sort(F.map_entries(X.json_text_map(j))), lambda x: F.concat_ws("=", x["key"], x["value"]))
    only_lists = F.when(j.startswith("["), X.json_text_list(j)).otherwise(F.array().cast("array<string>"))
    return fx.load(spark, sf_dir, "events").select("event_id", F.array_join(texts, ",").alias("texts"), F.array_join(only_lists, "|").alias("items"))


@query("SELECT event_type AS qid, arg_max(props, event_id) AS entity_json, CAST(max(event_id) AS BIGINT) AS version FROM events GROUP BY 1")
def snk4_sample_upsert(spark, sf_dir):
    """Raw documents by id: the newer one replaces the older one whole."""
    e = fx.load(spark, sf_dir, "events").select(F.col("event_type").alias("qid"), F.col("props").alias("entity_json"), F.col("event_id").alias("version"))
    half = F.col("version") % 2 == 0
    return S.upsert(S.keep_latest(e.where(half), ["qid"], ["version"]), S.keep_latest(e, ["qid"], ["version"]), ["qid"], "version")


def schemas_from_outside(spark, sf_dir):
    """JSON schemas as a model might write them: bare texts beside objects, synonyms, unknown labels, numbers out of range."""
    k = F.col("o_orderkey")
    kind = F.get(X.words_array(["lake", "Body of water", "PERSON", "nonsense", ""]), (k % 5).cast("int"))
    text = F.concat(
        F.lit('{"cell_hypothesis":{"canonical_mention":"m'), k.cast("string"), F.lit('","mention_strength":"'), F.when(k % 3 == 0, "WEAK ").otherwise("odd"), F.lit('","entity_hypotheses":[{"coarse_type":"'), kind, F.lit('","fine_type":"'), kind, F.lit('","confidence":'), (k % 4).cast("string"),
        F.lit('},{"item_category":"type","coarse_type":"work","fine_type":"none"}]},"retrieval_plan":{"hard_filters":{"coarse_type":["'), kind, F.lit('",{"value":"event","confidence":0.5},{"value":"place"}],"entity_category":"Location"},"soft_context_terms":["a ",{"value":"b","weight":7},{"type":"c","probability":0.2},"a",{"weight":1}],'),
        F.lit('"query_variants":["v",{"text":" w ","weight":-1},"v",{"weight":2}],"hypothesis_plan":[{"coarse_type":"'), kind, F.lit('","retrieval_mode":"hard"}]}}'),
    )
    # dealt out by key: a row is 8 bytes here and a fifth of a millisecond later
    keys = fx.load(spark, sf_dir, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return keys.select("o_orderkey", text.alias("j"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS m FROM orders),
l AS (SELECT *, CASE WHEN m IN (0, 1) THEN 'LOCATION' WHEN m = 2 THEN 'PERSON' ELSE '' END AS c, CASE WHEN m IN (0, 1) THEN 'LANDMARK' WHEN m = 2 THEN 'HUMAN' ELSE 'MISC' END AS f FROM o)
SELECT k AS o_orderkey, CASE k % 3 WHEN 0 THEN 'weak' ELSE 'unknown' END AS strength, CASE WHEN c <> '' THEN 'ENTITY/' || c || '/' || f || '/' || CASE WHEN k % 4 = 0 THEN '0.0' ELSE '1.0' END || '|' ELSE '' END || 'TYPE/WORK/MISC/0.6' AS hypotheses,
  CASE WHEN m = 2 THEN 'PERSON,LOCATION' ELSE 'LOCATION' END AS coarse_hints, 'ENTITY' AS item_filters, 'a:0.7|b:1.0|c:0.2' AS soft, 'v:0.7|w:0.0' AS variants, CASE WHEN c <> '' THEN '1:MISC:hard' ELSE '' END AS plan FROM l""")
def pp11_normalised_schema(spark, sf_dir):
    s = schemas_from_outside(spark, sf_dir).select("o_orderkey", N.normalised_schema(F.col("j")).alias("s")).select("o_orderkey", "s.*")
    shown = lambda c, sep, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(sep, *[x[n].cast("string") for n in names])), "|")
    return s.select("o_orderkey", "strength", shown("hypotheses", "/", "item_category", "coarse_type", "fine_type", "confidence").alias("hypotheses"), F.array_join("coarse_hints", ",").alias("coarse_hints"), F.array_join("item_filters", ",").alias("item_filters"), shown("soft", ":", "value", "weight").alias("soft"), shown("variants", ":", "text", "weight").alias("variants"), shown("plan", ":", "rank", "fine_type", "retrieval_mode").alias("plan"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'GEOGRAPHY' ELSE 'GENERIC_ENTITY_TABLE' END AS family, CAST(least(1, o_orderkey % 4 / 2.0) AS DOUBLE) AS confidence, '0=A:0.6,B:1.0|2=C' || o_orderkey || ':0.6' AS roles, CASE o_orderkey % 2 WHEN 0 THEN 'A|B' ELSE 'X|Y' END AS template, 'T:0.25' AS hypotheses, 'n' AS notes FROM orders""")
def tp6_normalised_profile(spark, sf_dir):
    """Table profiles from outside: roles as texts, objects or lists of them, templates as list or text."""
    k = F.col("o_orderkey")
    j = F.concat(
        F.lit('{"table_semantic_family":"'), F.when(k % 3 == 0, "GEOGRAPHY").otherwise(""), F.lit('","confidence":'), (k % 4 / 2.0).cast("string"), F.lit(',"column_roles":{"0":["A ",{"role":"B","confidence":3},{"confidence":1}],"1":[""],"2":"C'), k.cast("string"),
        F.lit('"},"row_template":'), F.when(k % 2 == 0, '["A"," ","B "]').otherwise('"X | Y|"'), F.lit(',"table_hypotheses":[{"value":"T","probability":0.25}],"evidence_notes":"n"}'),
    )
    p = fx.load(spark, sf_dir, "orders").select("o_orderkey", N.normalised_profile(j).alias("p")).select("o_orderkey", "p.*")
    role = lambda c: F.array_join(F.transform(c, lambda r: F.when(r["confidence"].isNull(), r["role"]).otherwise(F.concat_ws(":", r["role"], r["confidence"].cast("string")))), ",")
    columns = F.array_join(F.transform(F.array_sort(F.map_entries("column_roles")), lambda e: F.concat_ws("=", e["key"], role(e["value"]))), "|")
    return p.select("o_orderkey", "family", "confidence", columns.alias("roles"), F.array_join("row_template", "|").alias("template"), role(F.col("table_hypotheses")).alias("hypotheses"), F.array_join("evidence_notes", "|").alias("notes"))
