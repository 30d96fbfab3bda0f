"""Exact top-k search by tiled matrix products.

Vectors become integers floor(1024 * x), x as double.  Queries (vec_id divisible by 100) are gathered in blocks, all
vectors in shards, as many as tasks, more where a shard would pass `SHARD_BYTES`; within a shard each block of queries and
each `TILE` vectors make one tile: a matrix product, of which only every query's best k survive (partial
selection).  The tiles' lists are merged per query in two levels.  A block, a tile and a shard hold a bounded number of
rows, so a task's memory doesn't grow with the table; only the queries are copied, once to each shard.

Scores are exact: products are summed in float64 only while every partial sum stays below 2**53, in int64 below 2**63,
and in Python's integers beyond, in a tile of the vectors that need it.  A score that no long holds still takes its exact
rank; the column shows the nearest long.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite component take no part, nor do null
vec_ids; a query is compared with vectors of its own length only, and with all rows but its own: of the rows that share
its vec_id the smallest vector is the query (a repeated query counts once), the others are its candidates; repeated
candidates each take a rank; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

SCALE = 1024
K = 10
BLOCK = 512
TILE = 4096
SHARD_BYTES = 32 << 20
_LONG = 2**63 - 1


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, x array<double>: what takes part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles as int64, or as Python's integers where one doesn't fit.  scale is a power of two."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if np.abs(v).max(initial=0) < 2.0**62:
        return v.astype(np.int64)
    # doubles this large are whole numbers already
    return np.array([[int(np.floor(c * scale)) if abs(c) < 2.0**52 else int(c) * scale for c in row] for row in x.tolist()], object).reshape(x.shape)


def _largest(v: np.ndarray) -> int:
    return max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; of Python's integers where a long may not hold one."""
    bound = _largest(q) * _largest(c) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    return q.astype(object) @ c.astype(object).T


def exact_key(score: int) -> bytes | None:
    """Bytes that order scores of one saturated value as the scores themselves; null for a score that a long holds."""
    if -_LONG < score < _LONG:
        return None
    size = abs(score).bit_length() // 8 + 1
    if score > 0:
        return size.to_bytes(4, "big") + score.to_bytes(size, "big")
    return (2**32 - 1 - size).to_bytes(4, "big") + (256**size - 1 + score).to_bytes(size, "big")


def _best(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, higher scores first, ties to the smaller id."""
    if row.dtype == object:
        return np.array(sorted(range(len(row)), key=lambda j: (-row[j], ids[j]))[:k], np.int64)
    at = np.arange(len(row))
    if len(row) > k:
        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
    return at[np.lexsort((ids[at], -row[at]))[:k]]


def _split(ids: np.ndarray, x: np.ndarray):
    """(ids, vectors as doubles, integers), apart for rows whose integers are small and for those that are large."""
    large = np.abs(x).max(1, initial=0) >= 2.0**20
    for part in (~large, large):
        if part.any():
            yield ids[part], x[part], quantised(x[part])


def top_k(vectors: DataFrame, *, every: int = 100, k: int = K, block: int = BLOCK, tile: int = TILE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    spark = vectors.sparkSession
    small_batches(spark)
    all_rows = finite(vectors).withColumn("dim", F.size("x"))
    counts = all_rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.sum("dim").alias("numbers")).first()
    tasks = min(-(-counts["n"] // tile), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards, blocks = max(1, tasks, -(-8 * (counts["numbers"] or 0) // shard_bytes)), max(1, -(-counts["q"] // block))
    queries = all_rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    queries = queries.withColumn("dim", F.size("x")).withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    # the queries go to every shard; the vectors themselves move once
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", "blk", "vec_id", "x", F.lit(True).alias("is_query"))
    rows = all_rows.select(F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int").alias("shard"), "dim", F.lit(-1).cast("long").alias("blk"), "vec_id", "x", F.lit(False).alias("is_query"))
    both = rows.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "is_query", "blk")

    def tiles(batches):
        key = None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the shard's vectors, a tile each
        waiting: list[tuple[np.ndarray, np.ndarray]] = []  # vectors on their way into a tile, or queries into a block

        def gather(into_tiles: bool):
            ids, x = (np.concatenate(p) for p in zip(*waiting))
            waiting.clear()
            if into_tiles:
                held.extend(_split(ids, x))
            else:
                for part in _split(ids, x):
                    yield from solved(*part)

        def solved(q_ids, q_x, q):
            """One tile per held slice of the shard.  A query's own row is passed over once: equal rows are in one shard."""
            own = [True] * len(q_ids)
            for ids, x, m in held:
                s = scores(q, m)
                for at in range(len(q_ids)):
                    row, row_ids = s[at], ids
                    if own[at] and len(same := np.flatnonzero(ids == q_ids[at])):
                        same = same[(x[same] == q_x[at]).all(1)]
                        if len(same):
                            own[at] = False
                            row, row_ids = np.delete(row, same[0]), np.delete(ids, same[0])
                    best = _best(row, row_ids, k)
                    exact = [int(v) for v in row[best].tolist()]
                    yield q_ids[at], row_ids[best].tolist(), exact

        def out(parts):
            a, b, c, d = [], [], [], []
            for query, ids, exact in parts:
                a += [query] * len(ids)
                b += ids
                c += [max(-_LONG, min(_LONG, v)) for v in exact]
                d += map(exact_key, exact)
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary()), pa.array([key[0]] * len(a), pa.int32())], names=["query_id", "vec_id", "score", "exact", "shard"])

        for b in batches:
            if not b.num_rows:
                continue
            group = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("shard", "dim", "is_query")])
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                now = tuple(group[:, lo].tolist())
                if key != now:
                    if waiting:
                        yield from out(gather(not key[2]))
                    if key is None or key[:2] != now[:2]:
                        held.clear()
                    key = now
                part = b.slice(lo, hi - lo)
                waiting.append((part.column("vec_id").to_numpy(), part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, now[1])))
                if sum(len(i) for i, _ in waiting) >= (block if now[2] else tile):
                    yield from out(gather(not now[2]))
        if waiting:
            yield from out(gather(not key[2]))

    lists = both.select("shard", "dim", "vec_id", "x", "is_query").mapInArrow(tiles, "query_id long, vec_id long, score long, exact binary, shard int")
    best = (F.desc("score"), F.desc("exact"), F.asc("vec_id"))
    if shards > 64:
        group = F.floor(F.col("shard") / 64)
        lists = lists.withColumn("g", group).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "g").orderBy(*best))).where(F.col("r") <= k)
    merged = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)
