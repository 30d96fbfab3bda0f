"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or, only where that is unset and one machine does all the work, a folder of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if re.fullmatch(r"local(\[.*\])?", sc.master) is None:
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="entweave-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def _clean() -> None:
    for remove in _MADE:
        try:
            remove()
        except Exception:  # the session may be gone already
            pass


atexit.register(_clean)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of no file yet; what is written there is removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/entweave-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _MADE.append(lambda: fs.delete(target, True))
    return path


#: rows from which a table is no longer offered for broadcast
MANY_ROWS = 20_000


def unsent(df: DataFrame) -> DataFrame:
    """df with the hint that its next join is a merge join: Spark takes the size of a compressed file, or of a list before it is
    exploded, for that of the rows, and would collect many times as much in the driver."""
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: its plan is run once, however often it is read, and a lost executor costs nothing of it.  From
    MANY_ROWS rows on (counted from the files' footers) it isn't broadcast."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return unsent(table) if table.count() > MANY_ROWS else table
