"""Line dedup by winnowing.

A document is the sequence of its lines that aren't blank, each hashed with its white space collapsed.  In every
window of `window` consecutive line hashes the smallest (the rightmost of equals) is selected: any two equal runs of
`window` lines select the same line, so every such repeat is guaranteed to share a fingerprint.  Lines of at least `long_line` characters
are fingerprints of runs of one line.  Fingerprints seen twice are joined by position; each is extended both ways to
all runs of `window` lines through it, a run that occurs earlier (smaller doc_id, or earlier in its document) is a
repeat, and the union of repeats, the maximal repeated run, is deleted from the later document.

With `min_words`, shorter runs count by their size too: one or two consecutive lines that have that many words.  Such a line is a
fingerprint of its own, and the smaller hash of such a pair is one, so that equal pairs share it.

Defined results: null and empty texts have no lines and stay; blank lines are kept unless the text becomes empty of
others; a document with a null doc_id is neither compared nor changed; rows that share a doc_id are compared as one
document (an identical row isn't its own copy) and lose the same line numbers; an empty table gives an empty result;
other columns pass through, n_chars is brought up to date where there is one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, widened, with_cuts, written
from .repeats import later_copies

WINDOW = 3
LONG_LINE = 200
MIN_WORDS = 20


def line_hashes(text: str | None) -> tuple[list[int], list[bytes], list[bool], list[int], list[str]]:
    """Number, 128-bit hash, length test and word count of every line that isn't blank; all lines."""
    lines = text.split("\n") if text else []
    digest = xxhash.xxh3_128_digest
    at, keys, long, sizes = [], [], [], []
    for i, line in enumerate(lines):
        words = line.split()
        if words:
            s = " ".join(words)
            at.append(i)
            keys.append(digest(s))
            long.append(len(s) >= LONG_LINE)
            sizes.append(len(words))
    return at, keys, long, sizes, lines


def selected(keys: list[bytes], window: int) -> list[int]:
    """Places that are the minimum of some window; none if there are fewer lines than a window."""
    out: list[int] = []
    for i in range(len(keys) - window + 1):
        least = min(range(i, i + window), key=lambda j: (keys[j], -j))
        if not out or out[-1] != least:
            out.append(least)
    return sorted(set(out))


def _pack(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1]))


def fingerprints(docs: DataFrame, window: int, min_words: int | None = None) -> DataFrame:
    """k1, k2, doc_id, at, around: the selected lines, with the hashes of the lines up to window - 1 before and after,
    and a byte that tells whether the line itself (1), the pair that ends (2) and that begins (4) with it are runs."""

    def run(batches):
        for b in batches:
            ids, at, keys, lo, around = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                _, hashes, long, sizes, _ = line_hashes(text)
                pairs: set[int] = set()
                if min_words is not None:
                    long = [x or n >= min_words for x, n in zip(long, sizes)]
                    pairs = {j for j in range(len(hashes) - 1) if sizes[j] + sizes[j + 1] >= min_words}
                chosen = set(selected(hashes, window)) | {j for j, x in enumerate(long) if x}
                chosen |= {j if hashes[j] < hashes[j + 1] else j + 1 for j in pairs}
                for j in sorted(chosen):
                    first = max(0, j - window + 1)
                    ids.append(doc_id)
                    at.append(j)
                    keys.append(hashes[j])
                    lo.append(first)
                    around.append(b"".join(hashes[first : j + window]) + bytes([long[j] | (j - 1 in pairs) << 1 | (j in pairs) << 2]))
            k1, k2 = _pack(keys)
            yield pa.record_batch([k1, k2, pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(lo, pa.int32()), pa.array(around, pa.binary())], names=["k1", "k2", "doc_id", "at", "lo", "around"])

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "k1 long, k2 long, doc_id long, at int, lo int, around binary")


def _extended(found: DataFrame, window: int) -> DataFrame:
    """Every run of window lines through a repeated fingerprint, and the line and pairs that are runs by size: k1, k2, doc_id, at."""

    def run(batches):
        for b in batches:
            ids, at, keys = [], [], []
            digest = xxhash.xxh3_128_digest
            for doc_id, j, lo, around in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "lo", "around"))):
                n = len(around) // 16
                for i in range(n - window + 1):
                    ids.append(doc_id)
                    at.append((lo + i) * 256 + window)
                    keys.append(digest(around[16 * i : 16 * (i + window)]))
                for bit, first, size in ((1, j, 1), (2, j - 1, 2), (4, j, 2)):
                    if around[-1] & bit:
                        ids.append(doc_id)
                        at.append(first * 256 + size)
                        keys.append(digest(around[16 * (first - lo) : 16 * (first - lo + size)]))
            k1, k2 = _pack(keys)
            yield pa.record_batch([k1, k2, pa.array(ids, pa.int64()), pa.array(at, pa.int64())], names=["k1", "k2", "doc_id", "at"])

    return found.mapInArrow(run, "k1 long, k2 long, doc_id long, at long")


def dedup_lines(docs: DataFrame, *, window: int = WINDOW, min_words: int | None = None) -> DataFrame:
    """docs with later repeated runs of lines cut from text, plus n_lines and n_removed.  min_words needs a window of at least 2."""
    small_batches(docs.sparkSession)
    marks = fingerprints(docs, window, min_words)
    repeated = marks.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    found = marks.join(repeated, ["k1", "k2"]).select("doc_id", "at", "lo", "around")
    runs = written(_extended(found, window), "runs")
    cuts = later_copies(runs).groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("cut"))
    base = docs.drop("n_lines", "n_removed")
    joined, cut_name = with_cuts(base, cuts)
    schema = widened(base.schema, n_lines=T.LongType(), n_removed=T.LongType())
    names = base.columns
    counted = "n_chars" in names and base.schema["n_chars"].dataType == T.LongType()

    def run(batches):
        for b in batches:
            texts, total, removed = [], [], []
            for text, cut in zip(b.column("text").to_pylist(), b.column(cut_name).to_pylist()):
                at, _, _, _, lines = line_hashes(text)
                gone = {at[j] for c in cut or () for j in range(c // 256, c // 256 + c % 256) if j < len(at)}
                if gone:
                    kept = [x for i, x in enumerate(lines) if i not in gone]
                    text = "\n".join(kept) if any(x.strip() for x in kept) else ""
                texts.append(text)
                total.append(len(at))
                removed.append(len(gone))
            cols = {c: b.column(c) for c in names}
            cols["text"] = pa.array(texts, pa.string())
            if counted:
                old = b.column("n_chars").to_pylist()
                cols["n_chars"] = pa.array([len(t) if n and t is not None else o for t, n, o in zip(texts, removed, old)], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)


def op4(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
