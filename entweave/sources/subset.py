"""Parts of dumps and folders: numbered lines, subsets by count or by id, sizes by sample, tables of a benchmark folder, catalog."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..arguments import first_existing
from .dump import cleaned_line


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), value of text files, plain or compressed, without bringing a file into one task: lines are
    counted per split, and a split's first number is the sum of those before it in its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_i"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("_i").alias("_lo"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "_lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return lines.join(splits, ["file", "block"]).select("file", (F.col("_before") + F.col("_i") - F.col("_lo") + 1).alias("line_no"), "value")


def _supported(lines: DataFrame) -> DataFrame:
    """lines(file, line_no, value) -> with json and id, of documents with an id that begins with Q or P."""
    body = lines.select("file", "line_no", cleaned_line(F.col("value")).alias("json"))
    return body.select("*", F.get_json_object("json", "$.id").alias("id")).where(F.col("id").rlike("^[QP]"))


def subset_by_count(lines: DataFrame, n: int) -> DataFrame:
    """The first n entities of a dump: file, line_no, json, id.  A limit over an order: every task keeps n rows at most."""
    return _supported(lines).orderBy("file", "line_no").limit(n)


def subset_by_ids(lines: DataFrame, ids: list[str]) -> DataFrame:
    """The asked-for entities, in the order of ids: pos, id, json (null where missing); of repeated ids the first line counts."""
    spark = lines.sparkSession
    asked = spark.createDataFrame(list(enumerate(dict.fromkeys(i for i in ids if i[:1] in "QP"))), "pos long, id string")
    found = _supported(lines).join(F.broadcast(asked.select("id")), "id", "left_semi").groupBy("id").agg(F.min_by("json", F.struct("file", "line_no")).alias("json"))
    return asked.join(found, "id", "left").select("pos", "id", "json").orderBy("pos")


def subset_of_cache(cache: DataFrame, *, ids: list[str] | None = None, count: int | None = None, allow_missing: bool = False) -> DataFrame:
    """cache(qid, entity_json) -> pos, qid, entity_json of the asked-for ids, or of the first `count` by number."""
    if (ids is None) == (count is None):
        raise ValueError("exactly one of ids and count is needed")
    spark = cache.sparkSession
    if count is not None:
        from .text_sources import first_numeric_ids

        ids = [r["qid"] for r in first_numeric_ids(cache, "qid", count).collect()]  # `count` ids, the caller's number
        if len(ids) < count:
            raise ValueError(f"{count} asked for, {len(ids)} there")
    asked = spark.createDataFrame(list(enumerate(dict.fromkeys(ids))), "pos long, qid string")
    out = asked.join(cache.select("qid", "entity_json"), "qid", "left").select("pos", "qid", "entity_json")
    if not allow_missing and (missing := out.where("entity_json is null").count()):
        raise ValueError(f"{missing} of the ids aren't in the cache")
    return out.where("entity_json is not null").orderBy("pos")


SAMPLE_RECORDS, SAMPLE_BYTES = 20_000, 64 << 20


def estimated_records(spark: SparkSession, path: str, *, json_lines: bool = False, limit: int | None = None, sample: int | None = SAMPLE_RECORDS) -> int | None:
    """How many records a text file holds, from the mean size of its first `sample`; exact if that is all of it, or without one.

    Compressed files are counted, as their lines tell nothing of their size on disk."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or limit is not None and limit <= 0:
        return None
    size = fs.getContentSummary(hadoop).getLength()
    record = F.trim("value") if json_lines else F.coalesce(cleaned_line(F.col("value")), F.lit(""))
    lines = spark.read.text(path).select((F.octet_length("value") + 1).alias("bytes"), (record != "").alias("is_record"))
    totals = lambda df: df.agg(F.count_if("is_record").alias("n"), F.sum("bytes").alias("bytes")).first()
    counted = sample is None or path.endswith((".gz", ".bz2"))
    seen = totals(lines if counted else lines.limit(sample))
    if not seen["n"]:
        return None
    whole = counted or seen["bytes"] >= size
    found = seen["n"] if whole else max(seen["n"], int(size / (seen["bytes"] / seen["n"])))
    return found if limit is None else min(found, limit)


def dataset_ids(root: str) -> list[str]:
    """Names of the folders in a benchmark's root, sorted."""
    base = Path(root)
    if not base.exists():
        raise FileNotFoundError(f"no such folder: {root}")
    return sorted(p.name for p in base.iterdir() if p.is_dir())


def dataset_files(root: str, dataset_id: str) -> dict[str, str]:
    """Where a benchmark keeps its tables and its target list; either of two names is known."""
    base = Path(root) / dataset_id
    if not base.is_dir():
        raise FileNotFoundError(f"no such dataset: {base}")
    cta = first_existing([base / "target" / "cta_target.csv", base / "targets" / "CTA_2T_WD_targets.csv"])
    return {"tables": str(base / "tables"), "cta_targets": str(cta)}


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, position, column_name, data_type of the given tables: what an inspection of the catalog lists."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows: the row-count board, one aggregation a table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def ordered_ids(df: DataFrame, key: str) -> DataFrame:
    """All ids by their text: a range-partitioned sort, to be read in batches by toLocalIterator."""
    return df.select(key).orderBy(key)
