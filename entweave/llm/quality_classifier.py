"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of it is hashed to a row of an embedding matrix; a document is the mean of its
rows, a softmax layer gives the class.  The model is trained with numpy stochastic gradient descent on a bounded
sample of labelled rows (``max_train_docs`` rows, none of more than ``max_train_bytes``: the documented bounds).  As the layer is linear in the mean, scoring needs
one number per embedding row, so every document is scored on its whole text in one streaming pass without a shuffle.

Defined results: a null or empty text has no features and gets the softmax of the bias; a null label or doc_id is
not learned from; repeated rows are scored alike; an empty table gives an empty result; extra columns are ignored.
Without labels of both classes nothing can be learned, and every score is the share of label 1 (1.0 without labels).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, small_batches, widened

BUCKETS = 1 << 17
DIM = 12
MAX_TRAIN_DOCS = 3000
MAX_TRAIN_BYTES = 1 << 16  # so that at most 196 MB of texts reach the driver
EPOCHS = 8
THRESHOLD = 0.3
BLOCK = 1 << 18  # characters looked at at once


def _table() -> np.ndarray:
    """Class of each code point: 0 blank, 1 capital, 2 other letter, 3 digit, 4 to 19 other signs."""
    global _CLASSES
    if _CLASSES is None:
        kinds = np.empty(0x110000, np.uint8)
        for c in range(0x110000):
            x = chr(c)
            kinds[c] = 0 if x.isspace() or c < 32 else 1 if x.isupper() else 2 if x.isalpha() else 3 if x.isdigit() else 4 + c % 16
        _CLASSES = kinds
    return _CLASSES


_CLASSES: np.ndarray | None = None
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def feature_rows(text: str, buckets: int = BUCKETS):
    """Embedding rows of a whole text, a block at a time: words, character 3- and 4-grams with word ends, 3-grams of
    character classes, and for each pair of neighbouring words whether they are equal (a word bigram by its form)."""
    if not _POWERS:
        n = BLOCK + 1
        _POWERS.append(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _ODD)))))
        _POWERS.append(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _INVERSE)))))
    classes = _table()
    at = 0
    while at < len(text):
        part = text[at : at + BLOCK]
        if at + BLOCK < len(text) and (cut := part.rfind(" ")) > 0:
            part = part[:cut]
        at += len(part)
        cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.concatenate(([0], classes[cp], [0])).astype(np.uint8)
        c = np.where(kind == 0, 32, np.concatenate(([32], cp, [32]))).astype(np.uint64)
        inside = kind != 0
        c3 = c[:-2] | (c[1:-1] << np.uint64(21)) | (c[2:] << np.uint64(42))
        grams = [_mix(c3[inside[1:-1]])]
        if len(c) > 3:
            c4 = c3[:-1] * _ODD + c[3:]
            grams.append(_mix(c4[inside[1:-2] & inside[2:-1]] ^ np.uint64(4)))
        k = kind.astype(np.uint64)
        k3 = k[:-2] | (k[1:-1] << np.uint64(8)) | (k[2:] << np.uint64(16))
        grams.append(_mix(k3[inside[1:-1]] | np.uint64(1 << 60)))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        if not len(edge):
            continue
        first, last = edge[::2] + 1, edge[1::2] + 1
        prefix = np.concatenate(([np.uint64(0)], np.cumsum(c * _POWERS[0][: len(c)] if len(c) <= len(_POWERS[0]) else c)))
        words = (prefix[last] - prefix[first]) * _POWERS[1][np.minimum(first, BLOCK)]
        grams.append(_mix(words ^ np.uint64(1 << 61)))
        grams.append(_mix((words[1:] == words[:-1]).astype(np.uint64) | np.uint64(1 << 62)))
        yield (np.concatenate(grams) % np.uint64(buckets)).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    row_logit: np.ndarray  # what each embedding row adds to the logit of label 1
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for rows in feature_rows(text or "", len(self.row_logit)):
            total += float(self.row_logit[rows].sum(dtype=np.float64))
            n += len(rows)
        logit = self.bias + (total / n if n else 0.0)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, logit))))


def train_numpy(texts: list[str], labels: list[int], *, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, seed: int = 11) -> QualityModel:
    """Stochastic gradient descent over mean embeddings and a two-class softmax, in mini-batches."""
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        share = min(max(share, 1e-9), 1 - 1e-9)
        return QualityModel(np.zeros(buckets, np.float32), math.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    docs = []
    for text in texts:
        rows = list(feature_rows(text or "", buckets))
        if rows:
            ids, counts = np.unique(np.concatenate(rows), return_counts=True)
            docs.append((ids, (counts / counts.sum()).astype(np.float32)))
        else:
            docs.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    batch, steps = 16, 0
    total_steps = max(1, epochs * math.ceil(len(docs) / batch))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            rate = 2.0 * (1 - steps / total_steps)
            steps += 1
            chosen = order[at : at + batch]
            hidden = np.stack([w @ emb[i] if len(i) else np.zeros(dim, np.float32) for i, w in (docs[k] for k in chosen)])
            z = hidden @ out.T + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1  # the gradient of the loss by the logits
            back = p @ out
            out -= rate / batch * (p.T @ hidden)
            bias -= rate / batch * p.sum(0)
            for k, g in zip(chosen, back):
                ids, w = docs[k]
                emb[ids] -= (rate * w)[:, None] * g
    return QualityModel((emb @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_train_docs: int = MAX_TRAIN_DOCS, max_train_bytes: int = MAX_TRAIN_BYTES) -> QualityModel:
    """Learn from labelled rows that are not held out: of the max_train_docs ones with the smallest hash of the id those whose
    texts have at most max_train_bytes (a longer text isn't cut, it isn't learned from)."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_y"))
    # the ids are chosen before any text is moved; the texts that reach the driver are bounded in number and in bytes
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    texts = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_train_bytes)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_y").alias("_y")).orderBy("doc_id").toArrow()
    return train_numpy(rows["text"].to_pylist(), rows["_y"].to_pylist())


def score(docs: DataFrame, model: QualityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """docs with its own columns plus quality_score (double) and quality_predicted (int), one row per input row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS float32 numbers, whatever the input

    def run(batches):
        one = shared.value.score
        for b in batches:
            scores = [one(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], schema=pa.schema([*b.schema, pa.field("quality_score", pa.float64()), pa.field("quality_predicted", pa.int32())]))

    clash = [c for c in docs.columns if c in ("quality_score", "quality_predicted")]
    docs = docs.drop(*clash)
    return docs.mapInArrow(run, widened(docs.schema, quality_score=T.DoubleType(), quality_predicted=T.IntegerType()))


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
