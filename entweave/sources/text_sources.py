"""Other sources: type maps as JSON lines, benchmark tables as CSV, target and ground-truth lists, ids in a wanted order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def type_map(lines: DataFrame) -> DataFrame:
    """lines(line_no, value) -> id, coarse_types, fine_types; the last line of an id wins, alternative keys are accepted."""
    schema = "id string, coarse_types array<string>, ner_coarse_types array<string>, fine_types array<string>, ner_fine_types array<string>"
    rows = lines.where(F.trim("value") != "").select("line_no", F.from_json("value", schema).alias("r"))
    checked = rows.select("line_no", F.when(F.col("r.id").isNull(), F.raise_error(F.concat(F.lit("no type record in line "), F.col("line_no").cast("string"))).cast("string")).otherwise(F.col("r.id")).alias("id"), F.coalesce("r.coarse_types", "r.ner_coarse_types").alias("coarse_types"), F.coalesce("r.fine_types", "r.ner_fine_types").alias("fine_types"))
    best = checked.groupBy("id").agg(F.max_by(F.struct("coarse_types", "fine_types"), "line_no").alias("b"))
    return best.select("id", "b.coarse_types", "b.fine_types")


def csv_cells(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Quoted CSV tables, header as row 0, ragged rows: table_id, row_id, col_id, value."""
    text = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("table_id"), "value")
    # one row per record: line ends inside quotes don't end it
    records = text.select("table_id", F.posexplode(F.regexp_extract_all(F.regexp_replace("value", "\r\n?", "\n"), F.lit(r'((?:"(?:[^"]|"")*"|[^"\n])+)(?:\n|$)'), F.lit(1))).alias("row_id", "record"))
    fields = F.regexp_extract_all("record", F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    out = records.select("table_id", F.col("row_id").cast("long").alias("row_id"), F.posexplode(fields).alias("col_id", "value"))
    bare = F.when(F.col("value").startswith('"'), F.replace(F.substring("value", F.lit(2), F.length("value") - 2), F.lit('""'), F.lit('"'))).otherwise(F.col("value"))
    return out.withColumn("value", bare)


def targets(rows: DataFrame) -> DataFrame:
    """rows(c0, c1, c2) -> table_id, row_id, col_id; rows without whole numbers are skipped."""
    return rows.select(F.col("c0").alias("table_id"), F.col("c1").try_cast("int").alias("row_id"), F.col("c2").try_cast("int").alias("col_id")).where("table_id is not null and row_id is not null and col_id is not null")


def ground_truth(rows: DataFrame) -> DataFrame:
    """rows(c0, c1, c2, c3): the distinct ids in c3, in order; rows without any are dropped."""
    ids = F.array_distinct(F.regexp_extract_all("c3", F.lit(r"Q\d+"), F.lit(0)))
    return rows.select("c0", "c1", "c2", ids.alias("qids")).where(F.size("qids") > 0)


def in_requested_order(ids: DataFrame, found: DataFrame, key: str, *, allow_missing: bool = True) -> DataFrame:
    """ids(pos, key) once each at its first place, with what was found; without allow_missing a miss ends the job."""
    first = ids.groupBy(key).agg(F.min("pos").alias("pos"))
    out = first.join(found.withColumn("_found", F.lit(True)), key, "left")
    if not allow_missing:
        out = out.withColumn("_found", F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("missing: "), F.col(key))).cast("boolean")).otherwise(F.col("_found")))
    return out.withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def first_numeric_ids(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n smallest Q ids by number, then by text."""
    number = F.substring(key, F.lit(2), F.length(key)).try_cast("bigint")
    return df.where(F.col(key).rlike("^Q[0-9]+$")).select(key).orderBy(number, key).limit(n)


def changed_since(df: DataFrame, column: str, since: str) -> DataFrame:
    """Incremental scan: the bound reaches the Parquet reader."""
    return df.where(F.col(column) >= F.lit(since).cast("timestamp"))
