"""The entity data model drawn from the star-schema tables, and the same as SQL for the checks.

qids are Q + an offset per table + the key; popularity is the number of referencing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prior
from ..operators.graph import best_edges, prune, score_edges, subject_profiles
from ..scratch import fresh_path, written

OFFSETS = {"region": 1_000_000, "nation": 2_000_000, "supplier": 3_000_000, "customer": 4_000_000, "part": 5_000_000}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qid(kind: str, key) -> F.Column:
    return F.concat(F.lit("Q"), (F.lit(OFFSETS[kind]) + F.col(key)).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: load(spark, sf_dir, n)
    count = lambda df, key: df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    by_nation = count(t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k"))), "k")
    none = F.array().cast("array<string>")
    specs = [
        ("region", t("region"), "r_regionkey", "r_name", none, "LOCATION", "REGION", count(t("nation"), "n_regionkey"), "region"),
        ("nation", t("nation"), "n_nationkey", "n_name", none, "LOCATION", "COUNTRY", by_nation, "sovereign state"),
        ("supplier", t("supplier"), "s_suppkey", "s_name", none, "ORGANIZATION", "COMPANY", count(t("lineitem"), "l_suppkey"), "company"),
        ("customer", t("customer"), "c_custkey", "c_name", F.array("c_mktsegment"), "PERSON", "HUMAN", count(t("orders"), "o_custkey"), None),
        ("part", t("part"), "p_partkey", "p_name", F.array("p_brand", "p_type"), "PRODUCT", "PRODUCT_GENERIC", count(t("lineitem"), "l_partkey"), "product"),
    ]
    out = None
    for kind, df, key, name, aliases, coarse, fine, refs, clue in specs:
        rows = df.join(refs, F.col(key) == F.col("_k"), "left").select(
            qid(kind, key).alias("qid"), F.col(name).alias("label"), F.array(name).alias("labels"), aliases.alias("aliases"), F.lit(clue).cast("string").alias("description"),
            F.lit(coarse).alias("coarse_type"), F.lit(fine).alias("fine_type"), F.lit("ENTITY").alias("item_category"), F.coalesce("_n", F.lit(0)).cast("double").alias("popularity"),
            F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.col(name), F.lit(" "), F.lit("_"))).alias("wikipedia_url"), F.lit("").alias("dbpedia_url"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("prior", prior("popularity"))


def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities as a table: a query that reads them several times builds them once."""
    return written(entities(spark, sf_dir), "entities")


E_SQL = """
refs AS (
  SELECT 'region' AS kind, n_regionkey AS k, count(*) AS n FROM nation GROUP BY 2
  UNION ALL SELECT 'nation', k, count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 2
  UNION ALL SELECT 'supplier', l_suppkey, count(*) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'customer', o_custkey, count(*) FROM orders GROUP BY 2
  UNION ALL SELECT 'part', l_partkey, count(*) FROM lineitem GROUP BY 2),
base AS (
  SELECT 'region' AS kind, r_regionkey AS k, 1000000 AS off, r_name AS label, []::VARCHAR[] AS aliases, 'LOCATION' AS coarse_type, 'REGION' AS fine_type FROM region
  UNION ALL SELECT 'nation', n_nationkey, 2000000, n_name, [], 'LOCATION', 'COUNTRY' FROM nation
  UNION ALL SELECT 'supplier', s_suppkey, 3000000, s_name, [], 'ORGANIZATION', 'COMPANY' FROM supplier
  UNION ALL SELECT 'customer', c_custkey, 4000000, c_name, [c_mktsegment], 'PERSON', 'HUMAN' FROM customer
  UNION ALL SELECT 'part', p_partkey, 5000000, p_name, [p_brand, p_type], 'PRODUCT', 'PRODUCT_GENERIC' FROM part),
e AS (
  SELECT 'Q' || (off + k) AS qid, kind, label, aliases, coarse_type, fine_type, coalesce(n, 0)::DOUBLE AS popularity,
         1 - exp(-ln(1 + coalesce(n, 0)::DOUBLE) / 6) AS prior, 'https://en.wikipedia.org/wiki/' || replace(label, ' ', '_') AS wikipedia_url
  FROM base LEFT JOIN refs USING (kind, k))"""


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: load(spark, sf_dir, n)
    rank = F.when(F.col("l_returnflag") == "R", "deprecated").when(F.col("l_returnflag") == "N", "preferred").otherwise("normal")
    # distinct first: the partial aggregation shrinks lineitem before it is joined
    made = t("lineitem").select("l_partkey", "l_suppkey", rank.alias("rank")).distinct()
    parts = made.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edge = lambda s, p, o, r=F.lit("normal"): [s.alias("subject_qid"), F.lit(p).alias("predicate_pid"), o.alias("object_qid"), r.alias("rank")]
    frames = [
        t("nation").select(*edge(qid("nation", "n_nationkey"), "P361", qid("region", "n_regionkey"))),
        t("supplier").select(*edge(qid("supplier", "s_suppkey"), "P17", qid("nation", "s_nationkey"))),
        t("customer").select(*edge(qid("customer", "c_custkey"), "P27", qid("nation", "c_nationkey"))),
        made.select(*edge(qid("part", "l_partkey"), "P176", qid("supplier", "l_suppkey"), F.col("rank"))),
        parts.select(*edge(qid("part", "l_partkey"), "P495", qid("nation", "s_nationkey"), F.col("rank"))),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


EDGES_SQL = """
made AS (SELECT DISTINCT l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'deprecated' WHEN 'N' THEN 'preferred' ELSE 'normal' END AS rank FROM lineitem),
edges AS (
  SELECT 'Q' || (2000000 + n_nationkey) AS s, 'P361' AS p, 'Q' || (1000000 + n_regionkey) AS o, 'normal' AS rank FROM nation
  UNION ALL SELECT 'Q' || (3000000 + s_suppkey), 'P17', 'Q' || (2000000 + s_nationkey), 'normal' FROM supplier
  UNION ALL SELECT 'Q' || (4000000 + c_custkey), 'P27', 'Q' || (2000000 + c_nationkey), 'normal' FROM customer
  UNION ALL SELECT 'Q' || (5000000 + l_partkey), 'P176', 'Q' || (3000000 + l_suppkey), rank FROM made
  UNION ALL SELECT 'Q' || (5000000 + l_partkey), 'P495', 'Q' || (2000000 + s_nationkey), rank FROM made JOIN supplier ON l_suppkey = s_suppkey)"""

#: base score by predicate and what the subject's profiles add, for the predicates of these edges
SCORED_SQL = (
    EDGES_SQL
    + """,
scored AS (
  SELECT s, p, o, CASE p WHEN 'P361' THEN 80 WHEN 'P17' THEN 92 WHEN 'P27' THEN 92 WHEN 'P176' THEN 88 ELSE 90 END
       + CASE rank WHEN 'preferred' THEN 8 WHEN 'deprecated' THEN -12 ELSE 0 END
       + CASE p WHEN 'P361' THEN 14 WHEN 'P17' THEN 10 WHEN 'P27' THEN 14 WHEN 'P176' THEN 18 ELSE 8 END AS score,
       CASE rank WHEN 'preferred' THEN 0 WHEN 'deprecated' THEN 2 ELSE 1 END AS rank_no FROM edges),
best AS (SELECT s, p, o, score, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY s, p, o ORDER BY score DESC, rank_no) AS rn FROM scored) WHERE rn = 1),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY score DESC, rank_no, o) AS object_rank,
         max(score) OVER (PARTITION BY s, p) AS p_best, count(*) OVER (PARTITION BY s, p) AS p_n FROM best),
placed AS (SELECT *, dense_rank() OVER (PARTITION BY s ORDER BY p_best DESC, p_n DESC, p) AS predicate_rank FROM ordered),
triples AS (
  SELECT s, p, o, pos FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY object_rank, predicate_rank) AS pos FROM placed WHERE object_rank <= 2) WHERE pos <= 12)"""
)


def profiles(ents: DataFrame) -> DataFrame:
    return ents.select("qid", subject_profiles(F.col("item_category"), F.col("coarse_type"), F.col("fine_type")).alias("profiles"))


#: edges that one task sorts
EDGES_A_TASK = 500_000


def edge_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Parts of the graph, by the rows it is made of (two edges a line item; counted from the files' footers): a task's memory stays
    the same however many there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * load(spark, sf_dir, "lineitem").count() // EDGES_A_TASK)


def scored_edges(spark: SparkSession, sf_dir: str, ents: DataFrame | None = None) -> DataFrame:
    """Scored edges that lie by subject: the join with the subjects leaves rows where they are."""
    ents = entities(spark, sf_dir) if ents is None else ents
    return score_edges(raw_edges(spark, sf_dir).repartition(edge_tasks(spark, sf_dir), "subject_qid"), profiles(ents))


def triples(spark: SparkSession, sf_dir: str, ents: DataFrame | None = None) -> DataFrame:
    return prune(best_edges(scored_edges(spark, sf_dir, ents), by_subject=True))


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities as dump lines: nested JSON with a trailing comma, brackets and a lexeme among them."""
    e = entities(spark, sf_dir)
    snak = lambda o, rank: F.struct(rank.alias("rank"), F.struct(F.lit("value").alias("snaktype"), F.struct(F.struct(F.lit("item").alias("entity-type"), F.substring(o, F.lit(2), F.length(o)).cast("bigint").alias("numeric-id")).alias("value")).alias("datavalue")).alias("mainsnak"))
    # rows move once, by subject, which serves both groupings
    per = raw_edges(spark, sf_dir).repartition("subject_qid").groupBy("subject_qid", "predicate_pid").agg(F.array_sort(F.collect_list(F.struct("object_qid", "rank"))).alias("l"))
    claims = per.groupBy(F.col("subject_qid").alias("qid")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate_pid", F.transform("l", lambda x: snak(x["object_qid"], x["rank"])).alias("s"))))).alias("claims"))
    text = lambda lang, v: F.struct(F.lit(lang).alias("language"), v.alias("value"))
    human = F.create_map(F.lit("P31"), F.array(snak(F.lit("Q5"), F.lit("normal"))))
    d = e.join(claims, "qid", "left")
    d = d.withColumn("claims", F.when(F.col("fine_type") == "HUMAN", F.map_concat(human, F.coalesce("claims", F.expr("cast(map() as map<string,array<struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:struct<`entity-type`:string,`numeric-id`:bigint>>>>>>)")))).otherwise(F.col("claims")))
    sites = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.col("popularity").cast("int")), lambda i: F.struct(F.when(i == 1, "enwiki").otherwise(F.concat(F.lit("x"), i.cast("string"), F.lit("wiki"))).alias("k"), F.struct(F.col("label").alias("title")).alias("v"))))
    body = F.struct(
        F.col("qid").alias("id"), F.lit("item").alias("type"),
        F.create_map(F.lit("en"), text("en", F.concat(F.lit("  "), F.col("label"))), F.lit("it"), text("it", F.concat(F.col("label"), F.lit(" (it) ")))).alias("labels"),
        F.when(F.col("description").isNotNull(), F.create_map(F.lit("en"), text("en", F.col("description")))).alias("descriptions"),
        F.create_map(F.lit("en"), F.transform("aliases", lambda a: text("en", a)), F.lit("it"), F.array(text("it", F.col("label")))).alias("aliases"),
        "claims", F.when(F.col("popularity") > 0, sites).alias("sitelinks"),
    )
    lines = d.select(F.concat(F.to_json(body), F.lit(",")).alias("value"))
    extra = spark.range(1).select(F.explode(F.array(F.lit("["), F.lit("]"), F.lit(""), F.lit('{"id":"L99","type":"lexeme"},'))).alias("value"))
    return lines.unionByName(extra)


def dump_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump as text files: what reads it is planned apart from what makes it.  Compressed, as JSON takes many times the
    bytes of the tables."""
    path = fresh_path(spark, "dump")
    dump_lines(spark, sf_dir).write.option("compression", "lz4").text(path)
    return spark.read.text(path)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, their first words, and nation names, each asked for once; context is the part types of that name."""
    p = load(spark, sf_dir, "part")
    named = lambda c: p.select(c.alias("mention"), "p_type", F.lit("PRODUCT").alias("hint"))
    n = load(spark, sf_dir, "nation").select(F.col("n_name").alias("mention"), F.lit("nation").alias("p_type"), F.lit("LOCATION").alias("hint"))
    rows = named(F.col("p_name")).unionByName(named(F.split("p_name", " ")[0])).unionByName(n)
    return rows.groupBy("mention").agg(F.array(F.max("p_type"), F.lit("brand")).alias("context"), F.array(F.max("hint")).alias("coarse_hints")).select(F.md5("mention").alias("mention_id"), "mention", "context", "coarse_hints")


M_SQL = """
mentions AS (
  SELECT mention, md5(mention) AS mention_id, max(t) AS ctx, max(hint) AS hint FROM (
    SELECT p_name AS mention, p_type AS t, 'PRODUCT' AS hint FROM part
    UNION ALL SELECT split_part(p_name, ' ', 1), p_type, 'PRODUCT' FROM part
    UNION ALL SELECT n_name, 'nation', 'LOCATION' FROM nation) GROUP BY mention)"""

CAND_SQL = (
    E_SQL
    + ","
    + M_SQL
    + """,
hit AS (
  SELECT mention_id, mention, ctx, qid, label, aliases, coarse_type, fine_type, prior,
         (lower(label) = lower(mention))::INT * 7.0 + (len(list_filter(aliases, lambda a: lower(a) = lower(mention))) > 0)::INT * 2.5
         + (label ILIKE '%' || mention || '%')::INT * 2.75 + (len(list_filter(aliases, lambda a: a ILIKE '%' || mention || '%')) > 0)::INT * 1.0 AS score
  FROM mentions JOIN e ON (label ILIKE '%' || mention || '%' OR len(list_filter(aliases, lambda a: a ILIKE '%' || mention || '%')) > 0) AND coarse_type = hint),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, prior DESC, qid) AS rank FROM hit) WHERE rank <= 20)"""
)


#: table -> (source, key, columns); a column is its SQL, which Spark and the checks read alike
TABLES = {
    "nation": ("nation", "n_nationkey", {"n_name": "n_name", "n_regionkey": "n_regionkey"}),
    "customer": ("customer", "c_custkey", {c: c for c in ("c_name", "c_mktsegment", "c_acctbal", "c_nationkey")}),
    "supplier": ("supplier", "s_suppkey", {c: c for c in ("s_name", "s_acctbal")}),
    "part": ("part", "p_partkey", {c: c for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")}),
    "people": ("supplier", "s_suppkey", {
        "name": "concat('Ada Byron', s_suppkey)", "born": "concat('195', s_suppkey % 10, '-0', s_nationkey % 9 + 1)", "col2": "CASE s_suppkey % 3 WHEN 0 THEN 'Oslo' WHEN 1 THEN 'Quito (old)' ELSE 'Lima' END",
        "country": "CASE s_nationkey % 3 WHEN 0 THEN 'France' WHEN 1 THEN 'Japan' ELSE 'Brazil' END",
    }),
    "lakes": ("nation", "n_nationkey", {
        "name": "CASE n_nationkey % 3 WHEN 0 THEN concat('Lake Alpha', n_nationkey) WHEN 1 THEN concat('Blue', n_nationkey, '.') ELSE concat('Sea Gamma', n_nationkey) END", "country": "CASE n_regionkey % 2 WHEN 0 THEN 'Iran' ELSE 'Canada' END",
        "area": "concat(n_nationkey + 10, ' km2')", "depth": "concat(3 * n_nationkey + 5, ' ft')", "note": "CASE n_nationkey % 2 WHEN 0 THEN '' ELSE 'x' END",
    }),
}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as long rows: table_id, row_id (0: header), col_id, value."""
    out = None
    for name, (source, key, columns) in TABLES.items():
        values = F.array(*[F.expr(f"cast({c} as string)") for c in columns.values()])
        rows = load(spark, sf_dir, source).select(F.lit(name).alias("table_id"), (F.col(key) + 1).cast("long").alias("row_id"), F.posexplode(values).alias("col_id", "value"))
        head = spark.range(1).select(F.lit(name).alias("table_id"), F.lit(0).cast("long").alias("row_id"), F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("col_id", "value"))
        both = rows.unionByName(head)
        out = both if out is None else out.unionByName(both)
    return out


def _cells_sql() -> str:
    parts = []
    for name, (source, key, columns) in TABLES.items():
        for i, (c, value) in enumerate(columns.items()):
            parts.append(f"SELECT '{name}' AS table_id, {key} + 1 AS row_id, {i} AS col_id, CAST({value} AS VARCHAR) AS value FROM {source}")
            parts.append(f"SELECT '{name}', 0, {i}, '{c}'")
    return "\ncells AS (" + "\nUNION ALL ".join(parts) + ")"


CELLS_SQL = _cells_sql()
