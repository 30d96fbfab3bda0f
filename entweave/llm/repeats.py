"""Which keyed places of documents repeat an earlier place: shared by the substring and line operators.

Defined results: a place that is given twice isn't its own copy; equal keys in one document count by place; without places there are no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def later_copies(places: DataFrame) -> DataFrame:
    """places(k1 long, k2 long, doc_id long, at long) -> doc_id, at of those whose key occurs earlier, by (doc_id, at).

    Keys are counted by an aggregation that starts before the shuffle, so a hot key sends one row per task; only places
    whose key is seen twice are moved, in a join where adaptive execution splits a hot key's partition; the first place
    of each key is again found by partial aggregation."""
    repeated = places.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    among = written(places.join(repeated, ["k1", "k2"]), "repeats")
    first = among.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "at")).alias("f"))
    joined = among.join(first, ["k1", "k2"])
    return joined.where((F.col("doc_id") != F.col("f.doc_id")) | (F.col("at") != F.col("f.at"))).select("doc_id", "at")
