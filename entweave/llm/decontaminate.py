"""Benchmark decontamination: a distributed positional inverted index, in DataFrame functions only.

A test item's windows are its runs of `window` consecutive words (a shorter item is one window).  The occurrences of
all test terms in the training documents are counted; each window is then anchored at its two rarest terms.  Postings
(term, document, position) of the anchor terms are kept together with the words around them.  A window's candidates
are where the list of its rarest term and the list of its second rarest, each moved back by the term's offset in the
window, meet; as a posting carries its neighbourhood the intersection needs no second pass over the texts.  A phrase match needs all words of the
window in order; a proximity match needs them in any order in the same span.

The windows are broadcast only while they measure at most `BROADCAST_BYTES`; beyond that the postings are joined to
them by term, in shuffles that adaptive execution splits where a term is hot.

Defined results: null or wordless texts have no words and no hits; null item_ids take no part; items of the same id
count as one; documents with a null doc_id are returned unhit; rows that share a doc_id are indexed together, each row
returned with the hits of all, limited by its own length; empty tables give no hits or no rows; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 8
BROADCAST_BYTES = 16 << 20
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c):
    # lower() leaves most words as they are; only the others need the slower character table
    return F.when(F.lower(c) == c, c).otherwise(F.translate(c, _UPPER, _LOWER))


def words_of(text):
    """Words of letters, digits and non-ASCII characters, A-Z not yet lower-cased; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), lambda w: w != "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win array<string>: every window of every item, each once."""
    w = F.transform(words_of(F.col("text")), _ascii_lower)
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("win")).distinct()


def worded(docs: DataFrame) -> DataFrame:
    """doc_id, words: the lower-cased words of every text, split once and kept as a table."""
    return written(docs.select("doc_id", F.transform(words_of(F.col("text")), _ascii_lower).alias("words")), "words")


def matches(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, proximity: bool = False) -> DataFrame:
    """item_id, doc_id, at (from 0), len: where a window occurs; with proximity=True in any word order."""
    return word_matches(worded(docs), items, window=window, proximity=proximity)


def word_matches(words: DataFrame, items: DataFrame, *, window: int = WINDOW, proximity: bool = False) -> DataFrame:
    """matches() of what worded() gives."""
    wins = written(windows_of(items, window).groupBy("win").agg(F.collect_set("item_id").alias("item_ids")).withColumn("win_id", F.xxhash64("win")), "windows")
    terms = wins.select(F.explode("win").alias("term")).distinct()
    measured = wins.agg(F.sum(F.length(F.concat_ws(" ", "win")) * 2 + 160 + F.size("item_ids") * 24)).first()[0] or 0
    small = measured * window <= BROADCAST_BYTES
    side = F.broadcast if small else (lambda df: df)
    texts = words.where(F.col("doc_id").isNotNull()).select("doc_id", "words")
    # how often each test term occurs: counted over all documents, summed per task before the shuffle
    tokens = texts.select(F.explode("words").alias("term"))
    counts = tokens.join(side(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    counts = written(terms.join(counts, "term", "left").na.fill(0, ["df"]), "terms")
    ranked = wins.select("win_id", F.posexplode("win").alias("off", "term")).join(side(counts), "term")
    order = Window.partitionBy("win_id").orderBy("df", "term", "off")
    ranked = ranked.withColumn("r", F.row_number().over(order)).groupBy("win_id").agg(
        F.max(F.when(F.col("r") == 1, F.struct("term", "off"))).alias("first"),
        F.max(F.when(F.col("r") == 2, F.struct("term", "off"))).alias("second"),
        F.min("df").alias("least"),
    )
    # a window with a term that never occurs has no match anywhere
    anchors = wins.join(ranked.where(F.col("least") > 0), "win_id").select(F.col("first.term").alias("term"), F.col("first.off").alias("off"), "second", "win", "item_ids")
    anchors = written(anchors, "anchors")
    # a posting carries the words around it, and only these: no document's words are moved
    near = F.slice("words", F.greatest(F.col("pos") - window + 2, F.lit(1)), 2 * window - 1)
    base = F.greatest(F.col("pos") - window + 1, F.lit(0))
    wanted = anchors.select("term").distinct()
    postings = texts.select("doc_id", "words", F.posexplode("words").alias("pos", "term"))
    if small:
        # in the pass over the texts, so the words around are cut out only where a term is wanted
        found = postings.join(F.broadcast(wanted), "term", "left_semi").select("term", "doc_id", "pos", base.alias("base"), near.alias("near"))
    else:
        found = postings.select("term", "doc_id", "pos", base.alias("base"), near.alias("near")).join(wanted.hint("merge"), "term")  # not a semi join: the optimizer would move that below the slices
    # the stored index: postings of the anchor terms with their neighbourhood
    index = written(found, "postings")
    hit = index.join(side(anchors), "term")
    if proximity:
        size = F.size("win")
        spans = hit.select("item_ids", "doc_id", "base", "near", "win", size.alias("len"), F.explode(F.sequence(F.greatest(F.col("pos") - size + 1, F.col("base")), F.col("pos"))).alias("at"))
        hit = spans.where(F.sort_array(F.slice("near", F.col("at") - F.col("base") + 1, F.col("len"))) == F.sort_array("win"))
    else:
        at = F.col("pos") - F.col("off")
        local = at - F.col("base")
        hit = hit.withColumn("at", at).withColumn("len", F.size("win")).where(local >= 0)
        second = F.col("second.off")
        hit = hit.where(F.col("second").isNull() | (F.get("near", local + second) == F.col("second.term")))
        # greatest: filters may be evaluated in any order, and slice has no place 0
        hit = hit.where(F.slice("near", F.greatest(local, F.lit(0)) + 1, F.col("len")) == F.col("win"))
    return hit.select(F.explode("item_ids").alias("item_id"), "doc_id", "at", "len").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, least_items: int = 2) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    words = worded(docs)
    found = written(word_matches(words, items, window=window), "matches")
    hits = found.select("doc_id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("p")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    per_item = found.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    sized = words.select("doc_id", F.size("words").cast("long").alias("n_words"))
    out = sized.join(hits, "doc_id", "left").join(per_item, "doc_id", "left")
    n_items = F.coalesce("n_items", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", F.least(F.coalesce("n_hit", F.lit(0).cast("long")), F.col("n_words")).alias("n_hit"), n_items.alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))


def op6(docs: DataFrame, items: DataFrame) -> DataFrame:
    return decontaminate(docs, items)
