"""Writers: JSON lines, dump arrays, evaluation exports, a cache by content, and emptied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import canonical_json

CODECS = {".gz": "gzip", ".bz2": "bzip2"}


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object to a line; the path's suffix names the codec, as for reading."""
    codec = next((c for end, c in CODECS.items() if path.endswith(end)), None)
    w = df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite")
    (w.option("compression", codec) if codec else w).text(path)


def array_lines(docs: DataFrame, json: str, order: list[str]) -> DataFrame:
    """docs as the lines of a dump array, in order: an opening bracket, a document to a line with a comma after all but the
    last, a closing bracket.  Columns part, order columns, value.  The last document is found by one aggregation."""
    last = docs.agg(F.max(F.struct(*order)).alias("_last"))
    body = docs.join(F.broadcast(last), F.lit(True)).select(F.lit(1).alias("part"), *order, F.concat(json, F.when(F.struct(*order) == F.col("_last"), "").otherwise(",")).alias("value"))
    ends = docs.sparkSession.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("[").alias("value")), F.struct(F.lit(2).alias("part"), F.lit("]").alias("value")))).alias("e")).select("e.*")
    return body.unionByName(ends, allowMissingColumns=True)


def write_dump_array(docs: DataFrame, json: str, order: list[str], path: str) -> None:
    """Part files that, put together by name, are one JSON array: sorted by range, so no task holds them all."""
    array_lines(docs, json, order).orderBy("part", *order).select("value").write.mode("overwrite").text(path)


def evaluation_export(frames: list[DataFrame], maps: list[str]) -> DataFrame:
    """Reports of different columns in one table: columns in the order in which they are first met, maps as JSON with sorted
    keys, everything else as it is."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    text = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,bigint>"))))))
    return out.select(*[text(F.col(c)).alias(c) if c in maps else F.col(c) for c in out.columns])


def write_evaluation(frames: list[DataFrame], maps: list[str], path: str, order: list[str]) -> None:
    evaluation_export(frames, maps).orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def content_key(namespace: str, payload: dict[str, Column]) -> Column:
    """Where a result is kept: its namespace and the hash of the canonical JSON of what it was asked with."""
    return F.concat(F.lit(namespace + "/"), F.sha2(canonical_json(payload), 256))


def emptied(spark: SparkSession, path: str) -> int:
    """The table at path without its rows; its schema stays.  Returns how many there were."""
    old = spark.read.parquet(path)
    n = old.count()
    old.limit(0).write.mode("overwrite").parquet(path)
    return n


def readable_bytes(n: Column) -> Column:
    """B without decimals, KB to PB with two."""
    v = F.greatest(F.coalesce(n.cast("double"), F.lit(0.0)), F.lit(0.0))
    out = F.format_string("%.2f PB", v / 1024.0**5)
    for k, unit in reversed(list(enumerate("B KB MB GB TB".split()))):
        shown = F.concat(F.floor(v).cast("string"), F.lit(" B")) if k == 0 else F.format_string(f"%.2f {unit}", v / 1024.0**k)
        out = F.when(v < 1024.0 ** (k + 1), shown).otherwise(out)
    return out
