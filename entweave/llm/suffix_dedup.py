"""Suffix-array dedup: removes each byte covered by a string of `length` bytes that also starts earlier.

A position's longest previous factor (LPF) is the longest string that starts there and also earlier.  In suffix order it is what the
position shares with the nearest suffix before it, or with the nearest after it, of those that start earlier: its
previous and next smaller positions.  A byte goes if a position with LPF >= length reaches over it, so LPF values are capped there.

1. In every window of `length` bytes the k-byte string of the smallest hash, its minimizer, is found.  Equal windows
   have equal minimizers, so windows whose minimizer occurs once in the corpus can't repeat and are done with.
2. Neighbouring windows with one minimizer form a segment.  Segments meet by the minimizer's hash, as 128-bit hashes and places.
   Those of equal bytes are collapsed there: all but the earliest repeat entirely.  Only segments whose minimizer occurs
   in a distinct one too, or twice in their text, are cut from the texts and brought together as bytes.
3. Each task orders the suffixes of its distinct segments (prefix doubling by numpy, as deep as `length` bytes), finds
   the previous and next smaller position of each and computes its LPF (see longest_previous).
4. Where one minimizer gathers more than a task should order, its segments are cut by longer minimizers, in the task beyond
   `SORT_BYTES` and before the shuffle beyond `HOT_BYTES`, at last by whole windows: places of one and the same
   window need no order, the earliest of them stays (before the shuffle it is found by partial aggregation).
5. The repeated starts come back to their documents, which are cut; matches never cross documents.

Defined results: a null text is empty; null doc_ids are neither compared nor cut; identical rows of one doc_id count as one
document, rows of one doc_id with other texts are compared as one document and lose the same places; an empty table gives an empty
result; extra columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches
from .common import written as kept_table
from .repeats import later_copies

LENGTH = 100
GRAM = 32
HOT_BYTES = 16 << 20  # of distinct segments of one minimizer
SORT_BYTES = 4 << 20
TEXT_BLOCK = 1 << 20  # bytes looked at at once
TASK_BYTES = 1 << 17  # segment bytes sorted at once, as fit a core's cache; a minimizer's segments always stay together
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, p)))) for p in (_P, _P_INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Mixed rolling hash of every string of `gram` bytes."""
    power, inverse = _powers(len(raw))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    inner = prefix[1:]
    np.add(raw, np.uint64(1), out=inner)
    inner *= power
    np.cumsum(inner, out=inner)
    h = prefix[gram:] - prefix[:-gram]
    h *= inverse[: len(h)]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    return h


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM):
    """(minimizer hash, first window, end of windows, whether the hash occurs twice in the block) arrays: runs of
    windows with one minimizer."""
    heads, firsts, ends, twice = [], [], [], []
    for at in range(0, max(0, len(raw) - length + 1), TEXT_BLOCK):
        part = np.frombuffer(raw[at : at + TEXT_BLOCK + length - 1], np.uint8)
        n = len(part) - length + 1
        h = _gram_hashes(part, gram)
        least, span, want = h, 1, length - gram + 1
        while span < want:  # sliding minimum by doubling
            step = min(span, want - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        cut = np.flatnonzero(least[1:n] != least[: n - 1]) + 1
        first = np.concatenate(([0], cut))
        heads.append(least[first])
        ordered = np.sort(h[h <= heads[-1].max()])  # minimizers are small: a few of all hashes
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        twice.append(np.isin(heads[-1], again) if len(again) else np.zeros(len(first), bool))
        firsts.append(first + at)
        ends.append(np.concatenate((cut, [n])) + at)
    if not heads:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(heads).view(np.int64), np.concatenate(firsts), np.concatenate(ends), np.concatenate(twice)


def previous_smaller(p: np.ndarray) -> np.ndarray:
    """Index of the nearest entry before each that is smaller, or -1; all entries advance together by pointer jumping.

    What lies between an entry and its pointer is never smaller than it, so the pointer of a pointer is a valid one."""
    at = np.arange(-1, len(p) - 1)
    todo = np.flatnonzero(at >= 0)
    todo = todo[p[at[todo]] >= p[todo]]
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
        todo = todo[p[at[todo]] >= p[todo]]
    return at


_BYTES = np.uint64(256) ** np.arange(1, 8, dtype=np.uint64)


def _common_prefix(word: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes the strings at a and b share, up to `length`; word: the eight bytes at each place as a number."""
    out = np.full(len(a), length, np.int64)
    live = np.arange(len(a))
    for k in range(0, length, 8):
        differ = word[a + k] ^ word[b + k]
        ends = np.flatnonzero(differ)
        out[live[ends]] = k + 7 - np.searchsorted(_BYTES, differ[ends], side="right")
        keep = np.flatnonzero(differ == 0)
        live, a, b = live[keep], a[keep], b[keep]
        if not len(live):
            break
    return np.minimum(out, length)


def longest_previous(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Over the windows of all parts, part by part: the LPF, capped at `length`, among these windows; earlier is by
    (doc, start).  A place that two parts bring isn't earlier than itself."""
    sizes = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts) + bytes(length + 8), np.uint8).astype(np.uint64)
    total = int(sizes.sum())
    word = np.zeros(total + length, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | raw[i : i + total + length]
    windows = sizes - length + 1
    off = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.repeat(np.cumsum(sizes) - sizes, windows) + off
    when = (np.repeat(np.unique(doc, return_inverse=True)[1], windows) << 40) | (np.repeat(start, windows) + off)
    key, have = word, 8
    while have < length:  # ranks by 8, 16, 32, ... bytes; the last step only orders the windows
        step = min(have, length - have)
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = (rank[: total + length - have - step] << np.uint64(32)) | rank[step : total + length - have]
        have += step
    order = np.argsort(key[place], kind="stable")
    when, place = when[order], place[order]
    before = previous_smaller(when)
    after = len(when) - 1 - previous_smaller(when[::-1])[::-1]
    lpf = np.zeros(len(when), np.int64)
    for other, there in ((before, before >= 0), (after, after < len(when))):
        i = np.flatnonzero(there)
        lpf[i] = np.maximum(lpf[i], _common_prefix(word, place[i], place[other[i]], length))
    out = np.empty(len(lpf), np.int64)
    out[order] = lpf
    return out


def matched(parts: list[bytes], doc: list[int], start: list[int], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(doc, lo, hi): runs of windows of the parts whose LPF is `length`.  Parts of more than SORT_BYTES are cut by longer
    minimizers, windows that share `length` bytes stay together."""
    out: list[tuple[int, int, int]] = []
    if sum(map(len, parts)) <= SORT_BYTES:
        if not parts:
            return out
        hit = longest_previous(parts, np.array(doc), np.array(start), length) >= length
        at = 0
        for p, d, s in zip(parts, doc, start):
            n = len(p) - length + 1
            if hit[at : at + n].any():
                out.extend((d, s + lo, s + hi) for lo, hi in _ranges(hit[at : at + n]))
            at += n
        return out
    if gram >= length:  # the segments of a group are places of one window
        first: dict[bytes, tuple[int, int]] = {}
        for p, d, s in zip(parts, doc, start):
            w = p[:length]
            first[w] = min(first.get(w, (d, s)), (d, s))
        for p, d, s in zip(parts, doc, start):
            lo = s + (first[p[:length]] == (d, s))
            if lo < (hi := s + len(p) - length + 1):
                out.append((d, lo, hi))
        return out
    gram = _longer(gram, length)
    cut = [segments(p, length, gram) for p in parts]
    head, lo, hi, twice = (np.concatenate(x) for x in zip(*cut))
    of = np.repeat(np.arange(len(parts)), [len(c[0]) for c in cut])
    order = np.argsort(head, kind="stable")
    edge = np.flatnonzero(np.diff(head[order])) + 1
    group: tuple[list[bytes], list[int], list[int]] = ([], [], [])
    size = 0
    for members in np.split(order, edge):
        if len(members) == 1 and not twice[members[0]]:
            continue
        for i in members.tolist():
            piece = parts[of[i]][lo[i] : hi[i] + length - 1]
            for column, value in zip(group, (piece, doc[of[i]], start[of[i]] + int(lo[i]))):
                column.append(value)
            size += len(piece)
        if gram >= length or size >= TASK_BYTES:  # a group of its own, or several small ones
            out += matched(*group, length, gram)
            group, size = ([], [], []), 0
    return out + matched(*group, length, gram)


def _longer(gram: int, length: int) -> int:
    return min(length, 2 * gram)


def _ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table; the shuffle files that writing it took go at once, not when the driver collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return kept_table(df, name)
    finally:
        conf.set(key, before)


def repeated_starts(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_BYTES) -> DataFrame:
    """doc_id, lo, hi: runs of positions (hi excluded) at which a string of `length` bytes starts that starts earlier too."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def mark(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            ids, heads, keys, places, flags = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                h, f, e, t = segments(raw, length, gram)
                ids.append(np.full(len(h), doc_id, np.int64))
                heads.append(h)
                keys += [digest(raw[lo:hi]) for lo, hi in zip(f.tolist(), (e + (length - 1)).tolist())]
                places.append((f << 21) | (e - f))  # place (31 bits) and windows (up to TEXT_BLOCK: 21 bits) in one number
                flags.append(t)
            if ids:
                k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                cols = (np.concatenate(heads), np.ascontiguousarray(k[:, 0]), np.ascontiguousarray(k[:, 1]), np.concatenate(ids), np.concatenate(places).astype(np.int64), np.concatenate(flags))
                yield pa.record_batch([pa.array(c) for c in cols], names=["h", "k1", "k2", "doc_id", "at", "twice"])

    one, key = Window.partitionBy("h"), Window.partitionBy("h", "k1", "k2").orderBy("doc_id", "at")
    size = F.col("at").bitwiseAND((1 << 21) - 1)
    marks = source.mapInArrow(mark, "h long, k1 long, k2 long, doc_id long, at long, twice boolean")
    marks = marks.repartition("h").sortWithinPartitions("h", "k1", "k2", "doc_id", "at")  # one shuffle and sort for all windows
    marks = marks.withColumn("c", F.sum(F.col("twice").cast("int") + 1).over(one)).where("c > 1")
    marks = marks.withColumn("first", F.rank().over(key) == 1)
    several = (F.min("k1").over(one) != F.max("k1").over(one)) | (F.min("k2").over(one) != F.max("k2").over(one)) | F.max("twice").over(one)
    distinct_bytes = F.sum(F.when(F.col("first"), size + (length - 1))).over(one)
    marks = marks.withColumns({"several": several, "hot": distinct_bytes > hot}).where("several or not first")
    marks = written(marks.select("doc_id", "at", "first", F.when(F.col("first"), F.col("h")).alias("h"), (F.col("first") & F.col("hot")).alias("hot"), "twice"), "marks")
    copies = marks.where("not first").select("doc_id", F.shiftright("at", 21).cast("int").alias("lo"), (F.shiftright("at", 21) + size).cast("int").alias("hi"))
    by_doc = marks.where("first").groupBy("doc_id").agg(F.collect_list(F.struct("h", "at", "hot", "twice")).alias("s"))
    placed = source.join(by_doc, "doc_id")

    def cut(batches):
        for b in batches:
            rows = []
            for doc_id, text, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "s"))):
                raw = text.encode("utf-8", "surrogatepass")
                for s in found:
                    lo, n = s["at"] >> 21, s["at"] & ((1 << 21) - 1)
                    piece = raw[lo : lo + n + length - 1]
                    if len(piece) >= length:  # else the row is another text of this doc_id
                        rows.append((s["h"], doc_id, lo, piece, s["hot"], s["twice"]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            for at in range(0, max(1, len(rows)), 5000):
                yield pa.record_batch([pa.array(c[at : at + 5000], t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_()))], names=["h", "doc_id", "lo", "piece", "hot", "twice"])

    pieces = written(placed.mapInArrow(cut, PIECES), "segments")
    found = copies.unionByName(_met(pieces.where("not hot"), length, gram))
    crowded = pieces.where("hot").drop("hot")
    if not crowded.isEmpty():
        found = found.unionByName(_crowded(crowded, length, gram, hot))
    return found


PIECES = "h long, doc_id long, lo int, piece binary, hot boolean, twice boolean"


def _met(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, lo, hi of the repeats among pieces(h, doc_id, lo, piece, twice), which meet by h."""
    met = pieces.select("h", "doc_id", "lo", "piece", "twice").repartition("h").sortWithinPartitions("h", "piece", "doc_id", "lo")

    def match(batches):
        parts: list[bytes] = []
        docs_, starts = [], []
        size, last_h, last_piece, last_place, within = 0, None, None, None, False
        group = 0  # where the current minimizer's segments begin in parts
        out: list[tuple[int, int, int]] = []

        def solve():
            nonlocal size, group
            out.extend(matched(parts, docs_, starts, length, gram))
            parts.clear()
            docs_.clear()
            starts.clear()
            size = group = 0

        def give():
            cols = list(zip(*out)) if out else [[]] * 3
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "lo", "hi"])
            out.clear()
            return batch

        for b in batches:
            for h, doc_id, lo, piece, again in zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "lo", "piece", "twice"))):
                if h != last_h:
                    if len(parts) - group == 1 and not within:  # one distinct segment that holds no repeat
                        size -= len(parts.pop())
                        docs_.pop()
                        starts.pop()
                    if size >= TASK_BYTES:
                        solve()
                    group, within = len(parts), False
                elif piece == last_piece:
                    if (doc_id, lo) != last_place:
                        out.append((doc_id, lo, lo + len(piece) - length + 1))
                    continue
                within = within or again
                last_h, last_piece, last_place = h, piece, (doc_id, lo)
                parts.append(piece)
                docs_.append(doc_id)
                starts.append(lo)
                size += len(piece)
            if out:
                yield give()
        solve()
        yield give()

    return met.mapInArrow(match, "doc_id long, lo int, hi int")


def _crowded(pieces: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """The same for pieces of hot minimizers, which don't meet in one task: equal ones collapse by partial aggregation, what
    is left is cut by longer minimizers, hot ones of these by whole windows."""
    keyed = written(pieces.withColumns({"k1": F.xxhash64("piece"), "k2": F.xxhash64(F.lit(1), "piece")}), "hot")
    first = keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "lo")).alias("f"))
    judged = keyed.join(first, ["k1", "k2"]).withColumn("is_first", (F.col("doc_id") == F.col("f.doc_id")) & (F.col("lo") == F.col("f.lo")))
    copies = judged.where(~F.col("is_first")).select("doc_id", "lo", (F.col("lo") + F.length("piece") - length + 1).cast("int").alias("hi"))
    longer = _longer(gram, length)

    def recut(batches):
        for b in batches:
            rows = []
            for doc_id, lo, piece in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lo", "piece"))):
                for h, f, e, t in zip(*(x.tolist() for x in segments(piece, length, longer))):
                    rows.append((h, doc_id, lo + f, piece[f : e + length - 1], False, t))
            cols = list(zip(*rows)) if rows else [[]] * 6
            for at in range(0, max(1, len(rows)), 5000):
                yield pa.record_batch([pa.array(c[at : at + 5000], t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_()))], names=["h", "doc_id", "lo", "piece", "hot", "twice"])

    small_batches(pieces.sparkSession, 200)
    cut = written(judged.where("is_first").select("doc_id", "lo", "piece").mapInArrow(recut, PIECES), "longer")
    small_batches(pieces.sparkSession)
    counts = cut.groupBy("h").agg(F.count("*").alias("c"), F.max("twice").alias("again"), F.sum(F.length("piece")).alias("n")).where("c > 1 or again").select("h", (F.col("n") > hot).alias("still"))
    cut = written(cut.join(counts, "h"), "longer-met")
    found = copies.unionByName(_met(cut.where("not still"), length, longer))
    still = cut.where("still")
    if still.isEmpty():
        return found

    def explode(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for doc_id, lo, piece in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lo", "piece"))):
                n = len(piece) - length + 1
                k = np.frombuffer(b"".join([digest(piece[i : i + length]) for i in range(n)]), np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(np.full(n, doc_id)), pa.array(np.arange(lo, lo + n))], names=["k1", "k2", "doc_id", "at"])

    windows = still.select("doc_id", "lo", "piece").mapInArrow(explode, "k1 long, k2 long, doc_id long, at long")
    return found.unionByName(later_copies(windows).select("doc_id", F.col("at").cast("int").alias("lo"), (F.col("at") + 1).cast("int").alias("hi")))


def dedup_suffixes(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes), one row per input row."""
    found = repeated_starts(docs, length=length, gram=gram, hot=hot)
    cuts = found.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(cuts, "doc_id", "left")

    def cut(batches):
        for b in batches:
            rows = []
            for doc_id, text, cuts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "cuts"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, removed, spans, at, end = [], 0, 0, 0, -1
                for lo, hi in sorted((c["lo"], c["hi"]) for c in cuts or ()):
                    hi = min(hi + length - 1, len(raw))
                    if lo >= hi or hi <= end:
                        continue
                    if lo > end:
                        spans += 1
                        kept.append(raw[at:lo])
                        removed += hi - lo
                    else:
                        removed += hi - end
                    at = end = hi
                kept.append(raw[at:])
                rows.append((doc_id, len(raw), removed, spans, b"".join(kept)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3(docs: DataFrame) -> DataFrame:
    return dedup_suffixes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
