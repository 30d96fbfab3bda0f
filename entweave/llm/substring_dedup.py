"""Substring dedup by sliding sentence spans.

Texts are cut into sentences (after . ! ? or an ellipsis followed by white space, after full-width stops, and at line ends; a
"sentence" without such an end for more than ``MAX_WORDS`` words, as in tables and lists, is cut after words that their
own hash selects, so that a passage inside it is cut alike wherever it stands).  Every run of ``SPAN`` consecutive
sentences is hashed to 128 bits; where these have fewer or more words than `min_words`, so are the shortest runs from each
sentence on, and up to each sentence, that have that many, be it one sentence or several.  (Longer runs consist of these.)
The hashes are joined globally; all but the first occurrence of a run, by (doc_id, place), are repeats, and every sentence that a repeat
covers is removed.  Any repeated run of `SPAN` sentences or of `min_words` words goes whole: each of its sentences begins
or ends, or lies inside, a hashed run that the repeat contains.

Words are separated by white space; in scripts written without spaces (Han, kana, Thai, Lao, Khmer, Burmese) two
characters count as a word.

Sentences are compared with white space collapsed.  What remains keeps its own white space.

Defined results: null and empty texts have no sentences and stay as they are; a document with a null doc_id is
neither compared nor changed; rows that share a doc_id are compared as one document: an identical row isn't its own copy, and
the sentences numbered as repeated are removed from each row; an empty table gives an empty result; other columns pass
through, except that columns named like the results are replaced."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, widened, with_cuts
from .repeats import later_copies

SPAN = 3
SPAN_WORDS = 12  # what the query asks of a run of SPAN sentences; less is a stock phrase rather than a copied passage
MIN_WORDS = 20
MAX_WORDS = 40
CUT_WORDS = 16  # of a sentence without ends: words between two cuts, on average
_BARE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_END = re.compile(r"[.!?…]+\s+|[。！？｡．]+[」』”’）]*\s*|\n\s*")
_UNSPACED = re.compile(f"[{_BARE}]")
_WORD = re.compile(rf"(?:[{_BARE}]{{1,2}}|[^\s{_BARE}]+)\s*")
_PART = re.compile(rf"(?:[{_BARE}]|[^\s{_BARE}]+)\s*")


def n_words(s: str) -> int:
    return len(s.split()) if s.isascii() or not _UNSPACED.search(s) else len(_WORD.findall(s))


def _chunks(s: str, max_words: int) -> list[str]:
    """Pieces of at most max_words words, cut after words (of bare scripts: pairs of characters) that their hash selects."""
    words = _PART.findall(s)
    out, now, size, last = [], [s[: len(s) - sum(map(len, words))]], 0, ""
    for w in words:
        bare = w.strip()
        half = len(bare) == 1 and _UNSPACED.match(bare) is not None
        now.append(w)
        size += 1 if half else 2
        mark = zlib.crc32((last + bare if half else bare).encode("utf-8", "surrogatepass"))
        last = bare if half else ""
        if size >= 2 * max_words or mark % (2 * CUT_WORDS if half else CUT_WORDS) == 0:
            out.append("".join(now))
            now, size = [], 0
    return [*out, "".join(now)] if now else out


def sentences(text: str | None, max_words: int = MAX_WORDS) -> list[str]:
    """Pieces that join to the text again."""
    text = text or ""
    ends = [m.end() for m in _END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    out, at = [], 0
    for end in ends:
        s, at = text[at:end], end
        if s.count(" ") >= max_words or len(s) > max_words and not s.isascii() and _UNSPACED.search(s):
            if n_words(s) > max_words:
                out += _chunks(s, max_words)
                continue
        out.append(s)
    return out


def runs(parts: list[str], min_words: int = MIN_WORDS, span_words: int = 0) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, 128-bit hash) of every run that is hashed; sentences are numbered without blank ones."""
    joined = [" ".join(w) for w in (p.split() for p in parts) if w]
    before = [0]
    for s in joined:
        before.append(before[-1] + n_words(s))
    n = len(joined)
    found = {(i, SPAN) for i in range(n - SPAN + 1) if span_words <= before[i + SPAN] - before[i] < min_words}
    end = 0
    for i in range(n):  # the shortest run from each sentence on
        end = max(end, i + 1)
        while end <= n and before[end] - before[i] < min_words:
            end += 1
        if end > n:
            break
        found.add((i, end - i))
    start = n
    for j in range(n, 0, -1):  # and up to each sentence
        start = min(start, j - 1)
        while start >= 0 and before[j] - before[start] < min_words:
            start -= 1
        if start < 0:
            break
        found.add((start, j - start))
    digest = xxhash.xxh3_128_digest
    return [(i, k, digest("\n".join(joined[i : i + k]))) for i, k in sorted(found)]


def _spans(docs: DataFrame, min_words: int, span_words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, at, keys = [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = runs(sentences(text), min_words, span_words)
                ids += [doc_id] * len(found)
                at += [i * 256 + n for i, n, _ in found]
                keys += [k for _, _, k in found]
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(ids, pa.int64()), pa.array(at, pa.int64())], names=["k1", "k2", "doc_id", "at"])

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "k1 long, k2 long, doc_id long, at long")


def dedup_substrings(docs: DataFrame, *, min_words: int = MIN_WORDS, span_words: int = 0) -> DataFrame:
    """docs with the repeated sentences cut from text, plus n_sentences and n_removed.  With span_words, runs of SPAN sentences
    count from that many words on; as it is, all do."""
    small_batches(docs.sparkSession)
    spans = _spans(docs, min_words, span_words)
    repeats = later_copies(spans).groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("cut"))
    base = docs.drop("n_sentences", "n_removed")
    joined, cut_name = with_cuts(base, repeats)
    schema = widened(base.schema, n_sentences=T.LongType(), n_removed=T.LongType())
    names = base.columns

    def run(batches):
        for b in batches:
            texts, total, removed = [], [], []
            for text, cut in zip(b.column("text").to_pylist(), b.column(cut_name).to_pylist()):
                parts = sentences(text)
                full = [i for i, p in enumerate(parts) if p.split()]
                gone = {full[i] for c in cut or () for i in range(c // 256, c // 256 + c % 256) if i < len(full)}
                texts.append("".join(p for i, p in enumerate(parts) if i not in gone) if gone else text)
                total.append(len(full))
                removed.append(len(gone))
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_sentences", "n_removed"])

    return joined.mapInArrow(run, schema)


def op1(docs: DataFrame) -> DataFrame:
    done = dedup_substrings(docs.select("doc_id", "text"), span_words=SPAN_WORDS)
    return done.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
