"""Tables kept by key: upsert, replace, time to live, query cache, replication for size studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_json


def keep_latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Per key the row of the highest version; aggregated before the shuffle, so a hot key costs a row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*version))
    return df.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All non-key columns are overwritten by the newer row; a new row wins over an old one of the same version."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_latest(both, keys, ["_new", version]).drop("_new")


def upsert_triples(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (subject, predicate, object); rows with an empty part are dropped."""
    parts = ["subject_qid", "predicate_pid", "object_qid"]
    whole = new.where(" and ".join(f"coalesce({p}, '') <> ''" for p in parts))
    return old.unionByName(whole).groupBy(*parts).agg(F.max("updated_at").alias("updated_at"))


def replace_triples(old: DataFrame, subjects: DataFrame, new: DataFrame) -> DataFrame:
    """Every edge of the listed subjects goes, then the new ones come; a subject may end without edges."""
    return old.join(subjects.select("subject_qid").distinct(), "subject_qid", "left_anti").unionByName(new)


def page(df: DataFrame, order: list[str], *, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The rows from `offset` on, at most `limit`, in a total order."""
    part = df.orderBy(*order).offset(offset)
    return part if limit is None else part.limit(limit)


def keep_first(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Of each key the row that came first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def expired(df: DataFrame, created: str, now: Column, ttl_seconds: int) -> Column:
    """True for rows past their time; a time of zero or less keeps everything."""
    return F.lit(False) if ttl_seconds <= 0 else F.col(created) < now - F.expr(f"make_dt_interval(0, 0, 0, {int(ttl_seconds)})")


def prune_expired(df: DataFrame, created: str, now: Column, ttl_seconds: int) -> DataFrame:
    return df.where(~expired(df, created, now, ttl_seconds))


def cache_key(mention_norm, context_terms, coarse_hints, fine_hints, crosslinks, limit, include_top_k) -> Column:
    payload = {"mention_norm": mention_norm, "context_terms": context_terms, "coarse_hints": coarse_hints, "fine_hints": fine_hints, "crosslink_terms": crosslinks, "limit": limit, "include_top_k": include_top_k}
    return F.sha2(canonical_json(payload), 256)


def cache_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """(cache_key, result, created_at) upserted by key."""
    return upsert(cache, results, ["cache_key"], "created_at")


def cache_get(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(cache, "cache_key", "left").withColumn("hit", F.col("result").isNotNull())


def lcg_row(sample_no: Column, rows: int, *, seed: int = 0) -> Column:
    """Row number (from 1) that a linear congruential step picks for the n-th copy."""
    return F.pmod(F.pmod(sample_no * F.lit(1103515245) + F.lit(12345 + seed * 97531), F.lit(2147483647)), F.lit(rows)) + 1


def replicated_id(qid: Column, copy_no: Column, stride: int) -> Column:
    """Numeric ids move up by stride per copy, others get a suffix."""
    number = F.substring(qid, F.lit(2), F.length(qid)).try_cast("bigint")
    moved = F.concat(F.substring(qid, 1, 1), (number + (copy_no + 1) * stride).cast("string"))
    return F.when(qid.rlike("^[QP][0-9]+$"), moved).otherwise(F.concat(qid, F.lit("__r"), (copy_no + 1).cast("string")))


def replicate(seed_rows: DataFrame, target: int, *, stride: int = 10_000_000) -> DataFrame:
    """`target` rows drawn from a small seed table by row number; the seed is what is broadcast, and only if measured small."""
    numbered = seed_rows.withColumn("rn", F.row_number().over(Window.orderBy("qid")))
    n = seed_rows.count()
    picks = seed_rows.sparkSession.range(target).select(F.col("id").alias("copy_no"), lcg_row(F.col("id"), n).alias("rn"))
    side = F.broadcast(numbered) if n <= 100_000 else numbered
    return picks.join(side, "rn").withColumn("qid", replicated_id(F.col("qid"), F.col("copy_no"), stride)).drop("rn")


def projected_bytes(measured: Column, rows: Column, target: int) -> Column:
    return F.when(rows > 0, F.floor(measured / rows * target)).otherwise(F.lit(0)).cast("bigint")
