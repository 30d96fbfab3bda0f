"""Edges: scoring, de-duplication, two-level pruning, neighbourhoods and context strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import bounded_join, normalize
from ..scratch import written

EDGE = ("subject_qid", "predicate_pid", "object_qid")


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def subject_profiles(item_category, coarse, fine, types=None, has_parent_taxon=None) -> Column:
    """Profile names of a subject: its own types, their family, PERSON for humans."""
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    human = F.when(F.array_contains(types, "Q5"), "PERSON") if types is not None else F.lit(None).cast("string")
    taxon = (up(fine) == "BIOLOGICAL_TAXON") | (F.coalesce(has_parent_taxon, F.lit(False)) if has_parent_taxon is not None else F.lit(False))
    parts = F.array(up(item_category), up(coarse), up(fine), human, _literal_map(L.FAMILY_OF)[up(fine)], F.when(taxon, "BIOLOGICAL_TAXON"))
    return F.array_distinct(F.filter(parts, lambda p: p.isNotNull() & (p != "")))


def edge_score(predicate, obj, rank, profiles) -> Column:
    base = F.coalesce(_literal_map(L.PREDICATE_SCORES)[predicate], F.lit(L.DEFAULT_PREDICATE))
    bonus = _literal_map({f"{a} {b}": n for (a, b), n in L.PROFILE_BONUS.items()})
    extra = F.aggregate(profiles, F.lit(0), lambda acc, p: acc + F.coalesce(bonus[F.concat_ws(" ", p, predicate)], F.lit(0)))
    score = base + F.coalesce(_literal_map(L.RANK_BONUS)[rank], F.lit(0)) + extra
    score = score - F.when(obj.startswith("P"), L.PROPERTY_OBJECT_PENALTY).otherwise(0)
    return score - F.when((predicate == "P31") & (obj == "Q5"), L.HUMAN_PENALTY).otherwise(0)


def score_edges(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """edges(subject_qid, predicate_pid, object_qid, rank) with the subjects' profiles(qid, profiles) -> score, rank_no."""
    e = edges.where(F.col("predicate_pid").startswith("P") & (F.col("object_qid") != F.col("subject_qid")))
    e = e.join(subjects.select(F.col("qid").alias("subject_qid"), "profiles"), "subject_qid", "left")
    profiles = F.coalesce("profiles", F.array().cast("array<string>"))
    rank_no = F.coalesce(_literal_map(L.RANK_ORDER)[F.col("rank")], F.lit(1))
    return e.select(*EDGE, edge_score(F.col("predicate_pid"), F.col("object_qid"), F.col("rank"), profiles).alias("score"), rank_no.alias("rank_no"))


def best_edges(scored: DataFrame, *, by_subject: bool = False) -> DataFrame:
    """One row per edge: the best score, then the better rank.  Rows move once, by subject, which serves the aggregation here
    and the windows of ordered_edges; with by_subject they lie so already."""
    best = F.max(F.struct("score", (-F.col("rank_no")).alias("r")))
    return (scored if by_subject else scored.repartition("subject_qid")).groupBy(*EDGE).agg(best.alias("b")).select(*EDGE, F.col("b.score").alias("score"), (-F.col("b.r")).alias("rank_no"))


def ordered_edges(best: DataFrame) -> DataFrame:
    """With the predicate's place per subject and the object's place per predicate; both windows take rows that lie by subject as they are."""
    by_sp = Window.partitionBy("subject_qid", "predicate_pid")
    e = best.withColumns({"p_best": F.max("score").over(by_sp), "p_n": F.count("*").over(by_sp)})
    e = e.withColumn("object_rank", F.row_number().over(by_sp.orderBy(F.desc("score"), "rank_no", "object_qid")))
    return e.withColumn("predicate_rank", F.dense_rank().over(Window.partitionBy("subject_qid").orderBy(F.desc("p_best"), F.desc("p_n"), "predicate_pid")))


def prune(best: DataFrame, *, total: int = L.MAX_EDGES, per_predicate: int = L.MAX_EDGES_PER_PREDICATE) -> DataFrame:
    """Round robin over the predicates: everyone's first object, then everyone's second; 0 means no limit."""
    e = ordered_edges(best)
    if per_predicate > 0:
        e = e.where(F.col("object_rank") <= per_predicate)
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("subject_qid").orderBy("object_rank", "predicate_rank")))
    if total > 0:
        e = e.where(F.col("pos") <= total)
    return e.select(*EDGE, "pos")


def neighbours(ids: DataFrame, triples: DataFrame) -> DataFrame:
    """ids(qid) -> qid, direction, predicate_pid, other_qid; ids without edges stay, with nulls."""
    out = triples.select(F.col("subject_qid").alias("qid"), F.lit("out").alias("direction"), "predicate_pid", F.col("object_qid").alias("other_qid"))
    into = triples.select(F.col("object_qid").alias("qid"), F.lit("in").alias("direction"), "predicate_pid", F.col("subject_qid").alias("other_qid"))
    return ids.select("qid").distinct().join(out.unionByName(into), "qid", "left")


def object_labels(triples: DataFrame, labels: DataFrame, fallback: DataFrame | None = None, *, distinct: bool = False) -> DataFrame:
    """subject_qid, object_qid, label: resolved by labels(qid, label), else by the fallback.  distinct: the pairs are so already."""
    t = triples.select("subject_qid", "object_qid")
    t = t if distinct else t.distinct()
    t = t.join(labels.select(F.col("qid").alias("object_qid"), "label"), "object_qid", "left")
    if fallback is not None:
        t = t.join(fallback.select(F.col("qid").alias("object_qid"), F.col("label").alias("other")), "object_qid", "left")
        t = t.withColumn("label", F.coalesce(F.nullif(F.trim("label"), F.lit("")), "other")).drop("other")
    return t


def context_strings(triples: DataFrame, labels: DataFrame, *, max_chars: int = 512, fallback: DataFrame | None = None, sep: str = "; ", tasks: int | None = None) -> DataFrame:
    """qid, context_string: the labels of a subject's objects, in the order of the object ids.

    A subject has at most MAX_EDGES objects in a pruned graph, which bounds the gathered list.  tasks: into how many parts rows
    are dealt, where the session's number would make them too large."""
    if tasks is not None:
        triples = triples.select("subject_qid", "object_qid").distinct().repartition(tasks, "object_qid")
    t = object_labels(triples, labels, fallback, distinct=tasks is not None)
    t = t if tasks is None else t.repartition(tasks, "subject_qid")
    t = t.withColumn("label", normalize(F.col("label"))).where(F.coalesce(F.length("label"), F.lit(0)) > 0)
    lists = t.groupBy("subject_qid").agg(F.array_sort(F.collect_list(F.struct("object_qid", "label"))).alias("l"))
    return lists.select(F.col("subject_qid").alias("qid"), bounded_join(F.col("l.label"), max_chars, sep).alias("context_string"))


def even_sample(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """`limit` rows spread evenly over the given order: places floor(i * n / limit)."""
    n = df.count()
    if n <= limit:
        return df
    # numbered without a single-partition window: range partitions, then each partition's offset
    indexed = number_rows(df, order)
    wanted = df.sparkSession.range(limit).select(F.floor(F.col("id") * n / limit).cast("long").alias("idx"))
    return indexed.join(wanted, "idx", "left_semi").drop("idx")


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """idx from 0 in a global order, by range partitions: their sizes are counted, the rows don't meet in one task."""
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    # written, so that a row keeps its partition and place whatever is lost later
    parted = written(parted.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "numbered")
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row per partition, so this window is as small as the number of tasks
    starts = sizes.withColumn("_s", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_s", F.lit(0)).alias("_s"))
    return parted.join(F.broadcast(starts), "_p").withColumn("idx", (F.col("_s") + F.col("_i") - 1).cast("long")).drop("_p", "_i", "_s")
