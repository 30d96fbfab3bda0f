"""Incremental forms of the keyed tables on Structured Streaming.

A table lies in buckets of its keys.  A micro-batch rewrites only the buckets that its keys fall into, as a new version; a manifest then
names the version of every bucket.  Readers take the newest finished manifest, so they never see half a batch, and a batch
that is repeated after a failure overwrites its own version.  Versions that neither the newest manifest nor the one before names are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import upsert

BUCKETS = 64


def changed_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return hadoop, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose manifest is complete, ascending."""
    hadoop, root, fs = _files(spark, f"{path}/manifest")
    if not fs.exists(root):
        return []
    paths = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName()[2:]) for p in paths if p.getName().startswith("v=") and fs.exists(hadoop.Path(p, "_SUCCESS")))


def _manifest(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    """bucket -> version; at most BUCKETS rows."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/v={batch:012d}").collect()}


def _read(spark: SparkSession, path: str, state: dict[int, int], buckets) -> DataFrame | None:
    paths = [f"{path}/data/v={state[b]:012d}/bucket={b}" for b in buckets if b in state]
    return spark.read.parquet(*paths) if paths else None


def keep_upserted(stream: DataFrame, path: str, keys: list[str], version: str, checkpoint: str, *, buckets: int = BUCKETS):
    """Each micro-batch is merged into the buckets it touches."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = [b for b in _finished(spark, path) if b < batch_id]
        state = _manifest(spark, path, done[-1]) if done else {}
        own = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r["b"] for r in batch.select(own.alias("b")).distinct().collect()]  # at most `buckets` numbers
        if touched:
            old = _read(spark, path, state, touched)
            new = upsert(batch.limit(0) if old is None else old.select(*batch.columns), batch, keys, version)
            new.withColumn("bucket", own).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={batch_id:012d}")
        after = {**state, **dict.fromkeys(touched, batch_id)}
        spark.createDataFrame(list(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={batch_id:012d}")
        _tidy(spark, path, {*state.values(), *after.values()}, {batch_id, *done[-1:]})

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _tidy(spark: SparkSession, path: str, versions: set[int], manifests: set[int]) -> None:
    for part, keep in (("data", versions), ("manifest", manifests)):
        _, root, fs = _files(spark, f"{path}/{part}")
        for s in fs.listStatus(root) if fs.exists(root) else ():
            name = s.getPath().getName()
            if name.startswith("v=") and int(name[2:]) not in keep:
                fs.delete(s.getPath(), True)


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of the newest finished batch."""
    done = _finished(spark, path)
    if not done:
        return None
    state = _manifest(spark, path, done[-1])
    return _read(spark, path, state, state)


def recent_only(stream: DataFrame, time: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Repeats of a key within the delay are dropped; the state is bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
