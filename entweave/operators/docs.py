"""Text documents per entity: names, bags of words, search documents, inverted index with BM25."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, tokenize, without_stopwords
from .graph import neighbours


def name_text(labels: Column, aliases: Column) -> Column:
    """Distinct names, labels first, joined by blanks."""
    return F.array_join(F.filter(F.array_distinct(F.transform(F.concat(labels, aliases), normalize)), lambda x: x != ""), " ")


def entity_bow(parts: list[Column], cap: int = 128) -> Column:
    """Distinct tokens of label, aliases, description and types in this order, without stop words and single letters."""
    tokens = F.flatten(F.transform(F.array_compact(F.concat(*parts)), tokenize))
    return F.slice(F.array_distinct(without_stopwords(tokens)), 1, cap)


def description_bow(description: Column) -> Column:
    return F.array_join(without_stopwords(tokenize(description)), " ")


def graph_bow(neighbour_labels: Column, cap: int = 128) -> Column:
    """Tokens of the ordered labels of a neighbourhood; repeats are kept."""
    return F.slice(without_stopwords(F.flatten(F.transform(neighbour_labels, tokenize))), 1, cap)


def graph_bows(ids: DataFrame, triples: DataFrame, labels: DataFrame, *, cap: int = 128) -> DataFrame:
    """qid, bow: the tokens of a neighbourhood's labels, of predicate and neighbour, outgoing edges before incoming ones; repeats
    are kept.  A hub's edges are cut to `cap` before they are gathered: every edge that is left brings a token."""
    name = lambda key: labels.select(F.col("qid").alias(key), F.col("label").alias(f"{key}_label"))
    edges = neighbours(ids, triples).where("direction is not null")
    e = edges.join(name("predicate_pid"), "predicate_pid", "left").join(name("other_qid"), "other_qid", "left")
    none = F.array().cast("array<string>")
    tokens = lambda c: F.coalesce(without_stopwords(tokenize(c)), none)
    e = e.withColumn("tokens", F.concat(tokens(F.col("predicate_pid_label")), tokens(F.col("other_qid_label")))).where(F.size("tokens") > 0)
    order = [F.desc("direction"), F.col("predicate_pid"), F.col("other_qid")]
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("n") <= cap)
    bows = e.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "tokens"))).alias("l")).select("qid", F.slice(F.flatten("l.tokens"), 1, cap).alias("bow"))
    return ids.select("qid").distinct().join(bows, "qid", "left").withColumn("bow", F.coalesce("bow", none))


def name_texts(label: Column, labels: Column, aliases: Column) -> Column:
    """struct(labels_text, aliases_text): the secondary labels, and the aliases that are no label, each once."""
    tidy = lambda a: F.filter(F.array_distinct(F.transform(a, normalize)), lambda x: x != "")
    second = F.array_except(tidy(labels), F.array(normalize(label)))
    return F.struct(F.array_join(second, " ").alias("labels_text"), F.array_join(F.array_except(tidy(aliases), F.concat(tidy(labels), F.array(normalize(label)))), " ").alias("aliases_text"))


def clean_terms(terms: Column, exclude: Column, cap: int) -> Column:
    return F.slice(F.array_except(F.filter(F.array_distinct(F.transform(terms, lambda x: F.trim(x))), lambda x: x != ""), exclude), 1, cap)


def edge_ngrams(token: Column, low: int = 2, high: int = 20) -> Column:
    n = F.least(F.lit(high), F.length(token))
    return F.when(n < low, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(low), F.greatest(n, F.lit(low))), lambda i: F.substring(token, F.lit(1), i)))


def _trim(doc: str, cap: int) -> str | None:
    d = json.loads(doc)
    size = lambda: len(json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode())
    while size() > cap:
        field = next((f for f in ("context", "bow") if d.get(f)), None)
        if field:
            words = d[field].split()
            d[field] = " ".join(words[: len(words) * 3 // 4]) if len(words) > 1 else ""
            continue
        lists = [(len(v), k) for k, v in (d.get("aliases") or {}).items() if v]
        if not lists:
            raise ValueError(f"document {d.get('id')} doesn't fit {cap} bytes")
        d["aliases"][max(lists)[1]].pop()
    return json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def trim_to_bytes(doc: Column, cap: int = 4096) -> Column:
    """JSON documents cut to a byte budget.  Only those over it reach Python."""

    @F.pandas_udf("string")
    def cut(docs: pd.Series) -> pd.Series:
        return docs.map(lambda x: None if x is None else _trim(x, cap))

    over = F.octet_length(doc) > cap
    return F.when(over, cut(F.when(over, doc))).otherwise(doc)


def search_documents(entities: DataFrame, context: DataFrame, *, labels_cap: int = 12, aliases_cap: int = 24) -> DataFrame:
    e = entities.join(context, "qid", "left")
    none = F.array().cast("array<string>")
    labels = clean_terms(F.coalesce("labels", none), F.array("label"), labels_cap)
    aliases = clean_terms(F.coalesce("aliases", none), F.array_append(F.coalesce("labels", none), F.col("label")), aliases_cap)
    return e.select("qid", "label", labels.alias("labels"), aliases.alias("aliases"), "coarse_type", "fine_type", "item_category", "popularity", "prior", "wikipedia_url", "dbpedia_url", "description", F.substring(F.coalesce("context_string", F.lit("")), 1, 256).alias("context_string"))


def inverted_index(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """field, token, key, tf, doc_len."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), tokens.alias("tokens")) for name, tokens in fields.items()])
    rows = docs.select(key, F.explode(each).alias("f")).select(key, "f.field", F.size("f.tokens").alias("doc_len"), F.explode("f.tokens").alias("token"))
    return rows.groupBy("field", "token", key).agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def bm25(index: DataFrame, queries: DataFrame, key: str, boosts: dict[str, float], *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """queries(query_id, token) x index -> query_id, key, score: Okapi BM25 summed over boosted fields."""
    per_doc = index.select("field", key, "doc_len").distinct()
    stats = per_doc.groupBy("field").agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))
    df = index.groupBy("field", "token").agg(F.count("*").alias("df"))
    wanted = index.join(queries.select("token").distinct(), "token", "left_semi").join(df, ["field", "token"]).join(stats, "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    boost = F.create_map(*[F.lit(x) for p in boosts.items() for x in p])[F.col("field")]
    weighted = wanted.select("token", key, (idf * tf * F.coalesce(boost, F.lit(0.0))).alias("w"))
    return queries.join(weighted, "token").groupBy("query_id", key).agg(F.sum("w").alias("score"))
