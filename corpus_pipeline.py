"""A corpus pipeline over `documents`: five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of documents.  Between stages the rows are written to the shared folder, so each stage starts from a table.

Defined results: columns beyond doc_id, text and n_chars are carried through whatever their names; a null or empty text is scored
as such, has no lines, shingles or words, and is packed as its end id; rows with a null doc_id are never copies nor leaking; rows that share a
doc_id stay or go together in stages 3 and 4; empty tables give no rows.

1. quality classifier: a document that is predicted to be of label 0 goes.
2. line dedup: later repeated runs of lines are cut from the texts; a document of which no line is left, a copy of
   earlier ones, goes, all others stay.
3. MinHash near-dedup (five words, similarity 0.8): the smallest doc_id of each group stays.
4. benchmark decontamination: a document goes in which a window of any benchmark item occurs.
5. best-fit packing of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from entweave.llm import decontaminate as leaks
from entweave.llm import line_dedup, minhash, packing
from entweave.llm import quality_classifier as quality
from entweave.llm.common import table, written


OWN = ("doc_id", "text", "n_chars")


def shielded(docs: DataFrame) -> DataFrame:
    """docs with its further columns under names that no operator uses, in the same order."""
    return docs.toDF(*(c if c in OWN else f"_carried_{n}" for n, c in enumerate(docs.columns)))


def restored(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that shielded(docs) has in result, as docs names them."""
    return result.select(*shielded(docs).columns).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, predicts to be of label 1."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return restored(quality.score(shielded(docs), model).where("quality_predicted = 1"), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; n_chars follows the text; a document without a line left goes."""
    cut = line_dedup.dedup_lines(shielded(docs))
    return restored(cut.where("n_removed = 0 or n_removed < n_lines"), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the smallest of their component."""
    copies = minhash.near_duplicates(docs, words=5).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    leaking = leaks.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaking, "doc_id", "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("decontamination", leak_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier or the tokenizer; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
