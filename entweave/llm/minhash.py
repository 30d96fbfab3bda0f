"""MinHash near-duplicate detection.

One-permutation hashing: one hash per shingle fills one of `K` bins; empty bins are filled by optimal densification
(each probes its own hash sequence for a filled bin), so that two sets agree in a bin with the probability of their
Jaccard similarity, whatever their sizes.  `BANDS` bands of `ROWS` bins are bucket keys: a pair at similarity 0.8
shares no band with a probability of 1.3e-7 (0.672 ** 40).

1. Documents with equal shingle sets collapse to their smallest doc_id; only these representatives go on.
2. In each bucket every member is linked to the smallest one (a star), which bounds the pairs by the bucket's size.
   The candidates are confirmed on the full sets, and components are found.
3. A star can miss links between two members whose centre is like neither.  Buckets that still hold several components
   are therefore looked at again: inside them, members of different components whose signatures agree about as much as
   a link needs (six standard deviations below 0.8, see least_agreement) belong to one family.  What a bucket puts out is a
   forest of such pairs, never all of them: fewer edges than it has members.  Buckets with the same members are looked
   at once, large ones in blocks of `BLOCK` members, so no task holds a whole hot bucket.
4. The texts of each family meet, in blocks, and are compared in full where they meet; what leaves the task is a forest of
   links between components, again fewer than there are members.  Then the components are joined.

Defined results: null or blank texts have no shingles, are linked with nothing and kept; a null doc_id is linked with
nothing, its component is null and it is kept; rows that share a doc_id stand for one document with the union of their
links and each is returned; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .components import connected_components

K = 200
BANDS, ROWS = 40, 5
PERCENT = 80
BLOCK = 2048  # signatures of a bucket that meet at once
TEXT_BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # texts of a family that meet at once
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_word = xxhash.xxh64_intdigest


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; A-Z lower-cased, words split at ASCII white space."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    out = _mix(h[: len(h) - n + 1] + np.uint64(n))
    for i in range(1, n):
        out = _mix(out * _M1 + h[i : len(h) - n + 1 + i])
    return np.unique(out)


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_PROBES: list[np.ndarray] = []


def signature(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """One permutation in k bins, with optimal densification."""
    h = _mix(shingles ^ _M1)
    bins = (((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
    value = _mix(h)
    sig = np.full(k, _EMPTY)
    order = np.argsort(bins, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], bins[order][1:] != bins[order][:-1])))
    sig[bins[order][starts]] = np.minimum.reduceat(value[order], starts)
    filled = np.zeros(k, bool)
    filled[bins] = True
    own, attempt = sig.copy(), 0
    while not filled.all():
        while len(_PROBES) <= attempt:
            _PROBES.append((_mix(np.arange(k, dtype=np.uint64) * _M1 + np.uint64((len(_PROBES) + 1) * int(_M3) % (1 << 64))) % np.uint64(k)).astype(np.int64))
        todo = np.flatnonzero(~filled)
        source = _PROBES[attempt][todo]
        good = own[source] != _EMPTY
        sig[todo[good]] = own[source[good]]
        filled[todo[good]] = True
        attempt += 1
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig[: bands * rows].reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _M3
    for r in range(rows):
        key = _mix(key * _M1 + parts[:, r])
    return key.view(np.int64)


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two halves of the set's digest, band keys and one byte of each signature value."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                s = shingle_set(text, words)
                if len(s):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
                    sig = signature(s)
                    rows.append((doc_id, len(s), digest[0], digest[1], band_keys(sig).tolist(), sig.astype(np.uint8).tobytes()))
                else:
                    rows.append((doc_id, 0, 0, 0, None, None))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_shingles", "d1", "d2", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary")


def least_agreement(n_a, n_b, percent: int, k: int = K):
    """How many of k signature values must agree: six standard deviations below what the limit makes us expect.

    A set of fewer than k shingles tells no more than its size does.  Sizes too far apart can't be alike at all."""
    p = percent / 100
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    least = k * (p - 6 * np.sqrt(p * (1 - p) / np.minimum(k, np.maximum(small, 1))))
    return np.where(100 * small >= percent * large, least, k + 1)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def _any_alike(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> bool:
    """Whether any two sets of two documents are alike: rows that share a doc_id bring a set each."""
    return any(_alike(x, y, percent) for x in a for y in b)


def _confirm_stars(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs(a: centre, b), those whose full shingle sets are alike.  A centre goes once to every 256 of its partners,
    so a hot centre is split."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("salts"))
    partners = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("g"))
    sent = partners.select("a", "g", F.col("b").alias("doc_id"), F.lit(1).alias("role")).unionByName(partners.select("a", "g", F.col("a").alias("doc_id"), F.lit(0).alias("role")).distinct())
    rows = sent.join(texts, "doc_id").repartition("a", "g").sortWithinPartitions("a", "g", "role")

    def run(batches):
        key, centre = None, []
        for b in batches:
            out_a, out_b = [], []
            for a, g, doc_id, role, text in zip(*(b.column(c).to_pylist() for c in ("a", "g", "doc_id", "role", "text"))):
                if role == 0:
                    if key != (a, g):
                        key, centre = (a, g), []
                    centre.append(shingle_set(text, words))
                elif _any_alike(centre, [shingle_set(text, words)], percent):
                    out_a.append(a)
                    out_b.append(doc_id)
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.select("a", "g", "doc_id", "role", "text").mapInArrow(run, "a long, b long")


def agreeing_forest(a: tuple, b: tuple, same: bool, percent: int) -> list[tuple[int, int]]:
    """Of two blocks of (ids, signatures, components, sizes), or of one block with itself: a forest that connects what a
    chain of agreeing pairs of different components connects.  It has fewer edges than the blocks have members."""
    (ids_a, sig_a, comp_a, n_a), (ids_b, sig_b, comp_b, n_b) = a, b
    label_b = np.arange(len(ids_b))
    label_a = label_b if same else np.arange(len(ids_a)) + len(ids_b)
    out = []
    for i in range(len(ids_a)):
        lo = i + 1 if same else 0
        other = lo + np.flatnonzero((comp_b[lo:] != comp_a[i]) & (label_b[lo:] != label_a[i]))
        agree = (sig_b[other] == sig_a[i]).sum(1, dtype=np.int32)
        found = other[agree >= least_agreement(n_a[i], n_b[other], percent)]
        labels, first = np.unique(label_b[found], return_index=True)
        out += [(min(ids_a[i], ids_b[j]), max(ids_a[i], ids_b[j])) for j in found[first].tolist()]
        for label in (label_b,) if same else (label_a, label_b):
            label[np.isin(label, labels)] = label_a[i]
    return out


def linking_forest(ids: list[int], comps: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Alike pairs of sets that connect all components which alike pairs of these sets connect, compared in full.

    The sets are held as what they differ by from the shingles that most of them have, so pages of one template are
    compared by their own parts; |x & y| = (|x| + |y| - |x ^ y|) / 2."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    distinct, token = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(token) * 2 > n
    # the differences: own shingles that aren't common, and common ones that a set lacks
    rare = ~common[token]
    which = np.flatnonzero(common)
    holds = np.zeros((n, len(which)), bool)
    holds[owner[~rare], np.searchsorted(which, token[~rare])] = True
    lacks = np.nonzero(~holds)
    owner, token = np.concatenate((owner[rare], lacks[0])), np.concatenate((token[rare], which[lacks[1]]))
    differ = np.bincount(owner, minlength=n)
    shared = np.bincount(token, minlength=len(distinct))[token] > 1
    owner, token = owner[shared], token[shared]
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    begin = np.searchsorted(token[order], np.arange(len(distinct) + 1))
    order = np.argsort(owner, kind="stable")
    mine, start = token[order], np.searchsorted(owner[order], np.arange(n + 1))
    label = np.unique(np.array(comps, np.int64), return_inverse=True)[1]
    out = []
    for i in range(n - 1):
        lists = [posting[begin[t] : begin[t + 1]] for t in mine[start[i] : start[i + 1]].tolist()]
        both = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
        inside = (size[i] + size - (differ[i] + differ - 2 * both)) // 2
        alike = (100 * inside >= percent * (size[i] + size - inside)) & (label != label[i])
        alike[: i + 1] = False
        found = np.flatnonzero(alike)
        labels, first = np.unique(label[found], return_index=True)
        out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in found[first].tolist()]
        label[np.isin(label, labels)] = label[i]
    return out


def _confirm_families(edges: DataFrame, members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links between components(doc_id, component, n) that lie inside families, which edges(a, b) connect.

    The texts of a family, or of two blocks of a large one, meet in one task; no pair that isn't a link leaves it."""
    family = written(connected_components(edges).toDF("doc_id", "family").join(members, "doc_id"), "families")
    blocks = family.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / TEXT_BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    place = family.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = place.select("doc_id", "component", "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    rows = place.join(texts, "doc_id").repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "doc_id")

    def run(batches):
        key, ids, comps, sets = None, [], [], []

        def solved():
            pairs = linking_forest(ids, comps, sets, percent) if len(set(comps)) > 1 else []
            for held in (ids, comps, sets):
                held.clear()
            return pa.record_batch([pa.array([p for p, _ in pairs], pa.int64()), pa.array([q for _, q in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            for f, x, y, doc_id, component, text in zip(*(batch.column(c).to_pylist() for c in ("family", "x", "y", "doc_id", "component", "text"))):
                if key != (f, x, y):
                    yield solved()
                    key = (f, x, y)
                s = shingle_set(text, words)
                if len(s):
                    ids.append(doc_id)
                    comps.append(component)
                    sets.append(s)
        yield solved()

    return rows.select("family", "x", "y", "doc_id", "component", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    feats = written(features(docs, words), "minhash")
    # 1. equal sets
    usable = feats.where("n_shingles > 0 and doc_id is not null")
    sets = usable.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    classes = written(usable.select("doc_id", "n_shingles", "d1", "d2").join(sets, ["n_shingles", "d1", "d2"]).select("doc_id", "rep").distinct(), "classes")
    reps = usable.join(classes.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    keys = reps.select("doc_id", F.posexplode("bands").alias("band", "key")).select("doc_id", F.col("key"))
    # 2. buckets of two and more, one of each membership
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("doc_id"), 20)).alias("who")).where("n > 1")
    once = buckets.groupBy("centre", "n", "who").agg(F.min("key").alias("key"))
    members = written(keys.join(once.select("key", "centre", "n"), "key"), "buckets")
    stars = members.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    wanted = members.select("doc_id").distinct()
    # merge: what is wanted grows with the documents, so it is never broadcast, whatever its size is now
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id", "text"]), "candidates")
    sigs = reps.select("doc_id", "sig", F.col("n_shingles").alias("n"))

    def likely(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("sa", "sb"))
            keep = pa.array((sa == sb).sum(1) >= least_agreement(b.column("na").to_numpy(), b.column("nb").to_numpy(), percent))
            yield b.select(["a", "b"]).filter(keep)

    def likely_pairs(pairs):
        near = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
        return near.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(likely, "a long, b long").distinct()

    links = written(_confirm_stars(likely_pairs(stars), texts, words, percent), "links")
    comps = connected_components(links.unionByName(classes.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    comps = written(comps, "components")
    # 3. buckets that still hold several components
    placed = members.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = placed.select("key", "doc_id", "component").join(open_keys, "key").join(sigs, "doc_id")
    own = F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int")
    # each pair of blocks of a bucket meets in one task; a bucket of up to BLOCK members is one block
    tiles = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "component", "sig", "n")

    def cross(key, t):
        x, y = key[1].as_py(), key[2].as_py()
        t = t.sort_by("doc_id")
        ids, comp, blk, n = (t.column(c).to_numpy() for c in ("doc_id", "component", "own", "n"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, K)
        one, two = ((ids[m], sig[m], comp[m], n[m]) for m in (blk == x, blk == y))
        pairs = agreeing_forest(one, two, x == y, percent)
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})

    edges = written(tiles.groupBy("key", "x", "y").applyInArrow(cross, "a long, b long").distinct(), "edges")
    open_members = rest.groupBy("doc_id").agg(F.min("component").alias("component"), F.max("n").alias("n"))
    found = written(_confirm_families(edges, open_members, texts, words, percent), "links")
    # 4. join the components that new links connect
    c = comps.withColumnRenamed("component", "c")
    lifted = found.join(c.withColumnRenamed("node", "a").withColumnRenamed("c", "ca"), "a", "left").join(c.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(lifted).toDF("component", "joined")
    final = comps.toDF("doc_id", "component").unionByName(joined.select(F.col("component").alias("doc_id"), "component")).distinct().join(joined, "component", "left").groupBy("doc_id").agg(F.min(F.coalesce("joined", "component")).alias("component"))
    out = feats.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=2)
