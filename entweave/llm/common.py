"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WRITTEN: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that is unset and one machine does all the
    work, a folder of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if re.fullmatch(r"local(\[.*\])?", sc.master) is None:
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        folder = tempfile.mkdtemp(prefix="entweave-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir() or folder
    return folder.rstrip("/")


def _clean() -> None:
    for jvm_path, _ in _WRITTEN:
        try:
            jvm_path()
        except Exception:  # the session may be gone already
            pass


atexit.register(_clean)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it again.

    A lost executor costs nothing that was written.  The table is removed when the driver's interpreter ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/entweave-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _WRITTEN.append((lambda: fs.delete(target, True), path))
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's decimal text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def free_name(name: str, *taken: str) -> str:
    """name, or the first of name_1, name_2, ... that no column has (Spark tells columns apart without regard to case)."""
    lower = {t.lower() for t in taken}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(lower) + 2))) if n.lower() not in lower)


def with_cuts(docs: DataFrame, cuts: DataFrame) -> tuple[DataFrame, str]:
    """docs with the array column of cuts(doc_id, cut) of its doc_id, and the name that column has beside docs' own."""
    at = free_name("_at", *docs.columns)
    cut = free_name("_cut", *docs.columns, at)
    named = cuts.select(F.col("doc_id").alias(at), F.col("cut").alias(cut))
    return docs.join(named, docs["doc_id"] == named[at], "left").drop(named[at]), cut


def widened(schema: T.StructType, **extra: T.DataType) -> T.StructType:
    """A copy of schema with more fields."""
    return T.StructType([*schema.fields, *(T.StructField(name, kind) for name, kind in extra.items())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
