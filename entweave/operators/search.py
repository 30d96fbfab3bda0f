"""Boolean search over an inverted index with positions: must and should clauses by kind, ANDed filters, BM25 sums.

A request's variants are the must part (one of their clauses has to match), its context terms only add to the score; all its
filters have to hold, so two different types of one field exclude everything.  Clauses are rows, so a batch of requests is
one join of clause tokens with the index, which a hot token's skew is left to adaptive splitting for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

K1, B = 1.2, 0.75


def positional_index(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """field, token, key, tf, doc_len, places: fields are arrays of tokens."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), tokens.alias("tokens")) for name, tokens in fields.items()])
    rows = docs.select(key, F.explode(each).alias("f")).select(key, "f.field", F.size("f.tokens").alias("doc_len"), F.posexplode("f.tokens").alias("place", "token"))
    return rows.groupBy("field", "token", key).agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"), F.array_sort(F.collect_list("place")).alias("places"))


def weighted(index: DataFrame, key: str) -> DataFrame:
    """The index with the BM25 weight of each posting."""
    stats = index.select("field", key, "doc_len").distinct().groupBy("field").agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))
    df = index.groupBy("field", "token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return index.join(df, ["field", "token"]).join(stats, "field").select("field", "token", key, "places", (idf * tf).alias("w"))


#: (kind, fields with their boosts, boost as a function of the weight, only up to so many tokens)
def _best(label: float, others: float) -> dict[str, float]:
    return {"label": label, "labels": others, "aliases": others}


VARIANT = [("term", {"keyword": 1.0}, lambda w: 8.0 * (1 + 4 * w), None), ("phrase", {"label": 1.0}, lambda w: 5.0 * (1 + 4 * w), None), ("match", _best(8.0, 4.0), lambda w: 2.0 * (1 + 4 * w), None)]
CONTEXT = [("match", {"context": 1.0}, lambda w: 1.5 + 4 * w, None), ("phrase", {"label": 1.0}, lambda w: 1.5 + 5 * w, 5), ("match", _best(6.0, 3.0), lambda w: F.greatest(F.lit(1.5), 0.5 + 5 * w), 5)]


def clauses(requests: DataFrame, key: str, *, max_variants: int = 6, max_context: int = 6) -> DataFrame:
    """requests(key, variants and context: array<struct<text, weight>>, heaviest first) -> one row per clause, field and token:
    key, clause, must, kind, field, boost, token, place, n_tokens."""
    out = None
    for part, (name, specs, most) in enumerate((("variants", VARIANT, max_variants), ("context", CONTEXT, max_context))):
        terms = requests.select(key, F.posexplode(F.slice(name, 1, most)).alias("i", "t")).select(key, "i", F.lower("t.text").alias("text"), X.clamp("t.weight").alias("w"), X.lab_tokens("t.text").alias("tokens"))
        for j, (kind, fields, boost, at_most) in enumerate(specs):
            rows = terms.where(F.size("tokens") > 0)
            if at_most is not None:
                rows = rows.where(F.size("tokens") <= at_most)
            tokens = F.array("text") if kind == "term" else F.col("tokens")
            parts = F.array(*[F.struct(F.lit(f).alias("field"), (boost(F.col("w")) * b).alias("boost")) for f, b in fields.items()])
            rows = rows.select(key, F.concat(F.lit(f"{part}."), F.col("i").cast("string"), F.lit(f".{j}")).alias("clause"), F.lit(part == 0).alias("must"), F.lit(kind).alias("kind"), F.explode(parts).alias("p"), tokens.alias("ts"))
            rows = rows.select(key, "clause", "must", "kind", "p.field", "p.boost", F.size("ts").alias("n_tokens"), F.posexplode("ts").alias("place", "token"))
            out = rows if out is None else out.unionByName(rows)
    return out


def search(index: DataFrame, docs: DataFrame, requests: DataFrame, doc_key: str, key: str) -> DataFrame:
    """index: weighted(positional_index); docs(doc_key, coarse_type, fine_type, item_category); requests(key, variants, context,
    coarse_hints, fine_hints, item_filters, size) -> key, doc_key, score, rank up to the request's size (1 to 100)."""
    hits = clauses(requests, key).join(index, ["field", "token"])
    plain = hits.where("kind <> 'phrase'").groupBy(key, "clause", "must", "field", "boost", doc_key).agg((F.sum("w") * F.first("boost")).alias("s"))
    # a phrase: all its tokens at consecutive places; the starts that each token allows are counted
    starts = hits.where("kind = 'phrase'").select(key, "clause", "must", "field", "boost", "n_tokens", doc_key, "place", "w", F.explode("places").alias("at"))
    runs = starts.groupBy(key, "clause", "must", "field", "boost", "n_tokens", doc_key, (F.col("at") - F.col("place")).alias("start")).agg(F.count_distinct("place").alias("c"), F.sum("w").alias("w"))
    phrase = runs.where("c = n_tokens").groupBy(key, "clause", "must", "field", "boost", doc_key).agg((F.max("w") * F.first("boost")).alias("s"))
    # best field of each clause, clauses summed
    best = plain.unionByName(phrase).groupBy(key, "clause", "must", doc_key).agg(F.max("s").alias("s"))
    total = best.groupBy(key, doc_key).agg(F.sum("s").alias("score"), F.bool_or("must").alias("found")).where("found")
    asked = requests.select(key, "coarse_hints", "fine_hints", "item_filters", F.greatest(F.lit(1), F.least(F.lit(100), F.col("size"))).alias("size"))
    holds = lambda hints, field: F.forall(hints, lambda h: F.lower(h) == F.lower(F.coalesce(F.col(field), F.lit(""))))
    kept = total.join(asked, key).join(docs.select(doc_key, "coarse_type", "fine_type", "item_category"), doc_key)
    kept = kept.where(holds("coarse_hints", "coarse_type") & holds("fine_hints", "fine_type") & holds("item_filters", "item_category"))
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", 6)), doc_key)
    return kept.withColumn("rank", F.row_number().over(order)).where("rank <= size").select(key, doc_key, F.round("score", 6).alias("score"), "rank")
