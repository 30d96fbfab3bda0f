"""Language identification by rank-order profiles.

Each language's profile is the list of its most frequent character n-grams (1 to 3 letters, words framed by blanks),
a document's profile likewise, over its whole text; the distance is the sum of how far each of the document's n-grams
is out of place in the language's list, with the list's length for an absent one.  The nearest language wins, ties
go to the smaller name.  ``score`` is 1 - distance / largest possible distance.

Profiles are learned from at most ``max_train_docs`` documents per language (the documented bound; those with the
smallest hash of doc_id) that are not held out.  Documents are judged in one streaming pass.

Defined results: `und` and score 0 for a null text or one without letters, and for every text if nothing could be
learned; null doc_ids are not learned from but are judged; repeated rows are judged alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, small_batches, widened, written

PROFILE = 400
DOC_PROFILE = 300
MAX_TRAIN_DOCS = 1000
BROADCAST_IDS = 1 << 18
BLOCK = 1 << 19  # characters counted at once


def _codes(text: str) -> np.ndarray:
    """Code points in lower case; every run of other than letters becomes one 0, at both ends too."""
    lowered = text.lower()
    cp = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    distinct, inverse = np.unique(cp, return_inverse=True)
    letters = np.fromiter((chr(c).isalpha() for c in distinct.tolist()), bool, len(distinct))
    cp = np.where(letters[inverse], cp, 0)
    cp = np.concatenate(([0], cp, [0]))
    return cp[np.concatenate(([True], (cp[1:] != 0) | (cp[:-1] != 0)))]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed 21 bits to a character, and their counts over the whole text."""
    codes = _codes(text or "")
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, counts = [], []
    for at in range(0, len(codes), BLOCK):
        c = codes[at : at + BLOCK + 2] + 1  # no sign is 0, so an n-gram that begins with a blank differs from the shorter one
        own = min(BLOCK, len(codes) - at)
        pair = (c[:-1] << 21) | c[1:]
        triple = (pair[:-1] << 21) | c[2:]
        parts = [c[:own], pair[:own], triple[:own]]
        parts[0] = parts[0][parts[0] != 1]
        parts[2] = parts[2][(parts[2] >> 21) & 0x1FFFFF != 1]  # no blank in the middle
        g, n = np.unique(np.concatenate(parts), return_counts=True)
        grams.append(g)
        counts.append(n)
    if len(grams) == 1:
        return grams[0], counts[0]
    g, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams first; ties by the n-gram."""
    if len(grams) > 4 * size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:size]]


class Judge:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            p = np.array(profiles[lang], np.int64)
            self.rank[i, np.searchsorted(self.grams, p)] = np.arange(len(p))

    def __call__(self, text: str | None) -> tuple[str, float]:
        g, n = gram_counts(text)
        if not len(g) or not self.langs:
            return "und", 0.0
        top = ranked(g, n, DOC_PROFILE)
        at = np.searchsorted(self.grams, top)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        known = self.rank[:, at]
        away = np.where(known < 0, self.size, np.minimum(np.abs(known - np.arange(len(top))), self.size)).sum(1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.size * len(top)))


def learn(docs: DataFrame, *, max_train_docs: int = MAX_TRAIN_DOCS, size: int = PROFILE) -> dict[str, list[int]]:
    spark = docs.sparkSession
    small_batches(spark)
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("_h")).distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_train_docs).select("doc_id", "lang")
    ids = written(ids, "train-ids")
    # at most max_train_docs ids a language: while they are few they go to the texts; with very many languages the texts move
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    chosen = docs.select("doc_id", "lang", "text").join(side, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches):
        for b in batches:
            parts = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                g, n = gram_counts(text)
                parts.append(pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"]))
            if parts:
                yield from pa.Table.from_batches(parts).group_by(["lang", "gram"]).aggregate([("n", "sum")]).select(["lang", "gram", "n_sum"]).rename_columns(["lang", "gram", "n"]).cast(pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])).to_batches()

    totals = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = totals.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "r").collect():  # `size` rows per language
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """docs with its own columns plus lang_pred and lang_score."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c in ("lang_pred", "lang_score")])

    def run(batches):
        judge = Judge(profiles)
        for b in batches:
            found = [judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*b.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, widened(docs.schema, lang_pred=T.StringType(), lang_score=T.DoubleType()))


def op9(docs: DataFrame) -> DataFrame:
    judged = identify(docs.select("doc_id", "text"), learn(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
