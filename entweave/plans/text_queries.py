"""Scalar functions over the whole texts of documents, pages and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import docs as D
from ..operators.typing import lexical_types
from .. import lexicon as L
from . import fixtures as fx
from .registry import query

NORM = r"trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))"
FOLD = f"replace(lower({NORM}), 'ß', 'ss')"
TOKENS = f"regexp_extract_all({FOLD}, '[\\p{{L}}\\p{{N}}]+')"
LAB = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-z0-9]+')"
join = lambda tokens: f"coalesce(array_to_string({tokens}, ' '), '')"


def docs(spark, sf_dir):
    return fx.load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"SELECT doc_id, length({NORM}) AS n, md5({NORM}) AS h FROM documents")
def sc1_normalize_text(spark, sf_dir):
    n = X.normalize("text")
    return docs(spark, sf_dir).select("doc_id", F.length(n).cast("long").alias("n"), F.md5(n).alias("h"))


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, md5({join(TOKENS)}) AS h FROM documents")
def sc2_tokenize(spark, sf_dir):
    t = X.tokenize("text")
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("h"))


@query("SELECT doc_id, md5(trim(regexp_replace(strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss')), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS h FROM documents")
def sc3_normalize_exact(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.exact_name(F.col("text"))).alias("h"))


@query(
    f"SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(map_entries(m), lambda e: struct_pack(p := e.value, k := e.key))), lambda s: s.k), ' ') AS terms FROM ("
    f"SELECT conv_id, map_from_entries(list((tok, p))) AS m FROM (SELECT conv_id, tok, min(turn * 100000000 + i) AS p FROM ("
    f"SELECT conv_id, turn, unnest({TOKENS}) AS tok, generate_subscripts({TOKENS}, 1) AS i FROM conversations) GROUP BY conv_id, tok) GROUP BY conv_id)"
)
def sc4_context_terms(spark, sf_dir):
    """The distinct tokens of a conversation in order: one list per conversation, ordered by turn."""
    c = fx.load(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(X.tokenize(F.coalesce("text", F.lit("")))).alias("i", "tok"))
    first = c.groupBy("conv_id", "tok").agg(F.min(F.struct("turn", "i")).alias("p"))
    lists = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("p", "tok"))).alias("l"))
    return lists.select("conv_id", F.array_join(F.col("l.tok"), " ").alias("terms"))


STOPS = "[" + ", ".join(f"'{s}'" for s in L.STOPWORDS) + "]"


@query(f"SELECT doc_id, md5({join(f'list_filter({TOKENS}, lambda t: length(t) > 1 AND NOT list_contains({STOPS}, t))')}) AS h FROM documents")
def sc16_description_bow(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(D.description_bow(F.col("text"))).alias("h"))


@query(
    f"SELECT doc_id, md5(string_agg(tok, ' ' ORDER BY i)) AS h, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM ("
    f"SELECT doc_id, tok, min(i) AS i FROM (SELECT doc_id, unnest({TOKENS}) AS tok, generate_subscripts({TOKENS}, 1) AS i FROM documents) WHERE length(tok) > 1 AND NOT list_contains({STOPS}, tok) GROUP BY 1, 2)) WHERE r <= 128 GROUP BY doc_id"
)
def sc15_entity_bow(spark, sf_dir):
    b = D.entity_bow([F.array("text")])
    return docs(spark, sf_dir).select("doc_id", b.alias("b")).where(F.size("b") > 0).select("doc_id", F.md5(F.array_join("b", " ")).alias("h"), F.size("b").cast("long").alias("n"))


@query(
    "SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), "
    "'[\\s\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'))) AS h FROM pages"
)
def sc20_html_strip(spark, sf_dir):
    p = fx.load(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(X.strip_html(F.coalesce("html", F.lit("")))).alias("h"))


@query("SELECT page_id, TRY_CAST(nullif(regexp_replace(regexp_extract(url, '/([0-9.,]+)(?:$|[?#/])', 1), '[,.]', '', 'g'), '') AS BIGINT) AS n FROM pages")
def sc21_int_group(spark, sf_dir):
    return fx.load(spark, sf_dir, "pages").select("page_id", X.int_group("url", "/([0-9.,]+)(?:$|[?#/])").alias("n"))


@query(
    f"SELECT tok, count(*) AS n FROM (SELECT left(tok, i) AS tok FROM (SELECT tok, unnest(range(2, least(20, length(tok)) + 1)) AS i FROM (SELECT unnest({LAB}) AS tok FROM documents) WHERE length(tok) >= 2)) GROUP BY tok"
)
def sc25_edge_ngrams(spark, sf_dir):
    t = docs(spark, sf_dir).select(F.explode(X.lab_tokens("text")).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    # grams of distinct tokens, weighted, instead of grams of every token
    return t.select(F.explode(D.edge_ngrams(F.col("tok"))).alias("tok"), "n").groupBy("tok").agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id, md5({join(LAB)}) AS h FROM documents")
def sc27_lab_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.lab_normalize("text")).alias("h"))


PAIRS_SQL = "p AS (SELECT DISTINCT p_name AS x FROM part), pairs AS (SELECT a.x AS a, b.x AS b FROM p a JOIN p b ON split_part(a.x, ' ', 1) = split_part(b.x, ' ', 1))"
GRAMS = lambda c: f"CASE WHEN length(replace({c}, ' ', '')) <= 3 THEN list_distinct([replace({c}, ' ', '')]) ELSE list_distinct(list_transform(range(1, length(replace({c}, ' ', '')) - 1), lambda i: substr(replace({c}, ' ', ''), i, 3))) END"
DICE_SQL = f"2.0 * len(list_intersect({GRAMS('a')}, {GRAMS('b')})) / (len({GRAMS('a')}) + len({GRAMS('b')}))"


def name_pairs(spark, sf_dir):
    """Part names that share their first word."""
    n = fx.load(spark, sf_dir, "part").select(F.col("p_name").alias("x")).distinct().withColumn("w", F.split("x", " ")[0])
    return n.select(F.col("x").alias("a"), "w").join(n.select(F.col("x").alias("b"), "w"), "w").select("a", "b")


@query(f"WITH {PAIRS_SQL} SELECT a, b, levenshtein(a, b) AS d FROM pairs")
def sc28_levenshtein(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("a", "b", F.levenshtein("a", "b").cast("long").alias("d"))


@query(f"WITH {PAIRS_SQL} SELECT a, array_to_string(list_sort({GRAMS('a')}), '|') AS g FROM (SELECT DISTINCT a FROM pairs)")
def sc29_char_ngrams(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("a").distinct().select("a", F.array_join(F.array_sort(X.char_ngrams("a")), "|").alias("g"))


@query(f"WITH {PAIRS_SQL} SELECT a, b, round({DICE_SQL}, 6) AS s FROM pairs")
def sc30_dice(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("a", "b", F.round(X.dice("a", "b"), 6).alias("s"))


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(CASE WHEN a = b THEN 1 ELSE greatest(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), {DICE_SQL}) END, 6) AS s FROM pairs")
def sc31_name_similarity(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("a", "b", F.round(X.name_similarity("a", "b"), 6).alias("s"))


@query("SELECT doc_id, md5(trim(regexp_replace(trim(trim(regexp_replace(replace(regexp_replace(coalesce(text, ''), '\\[[^\\]]*\\]', '', 'g'), '*', ' '), '[\\s\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')), ' .,:;!?-_'), '[\\s\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'))) AS h FROM documents")
def sc32_mention_surface(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.mention_surface("text")).alias("h"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS h FROM documents")
def sc33_label_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.label_normalize("text")).alias("h"))


@query("SELECT event_id, least(1.0, greatest(0.0, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50, 0.5))) AS v FROM events")
def sc34_clamp(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("double") / 50
    return fx.load(spark, sf_dir, "events").select("event_id", X.clamp(k, default=0.5).alias("v"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def sc36_json_fragment(spark, sf_dir):
    """The outermost braces of a fenced answer, then a field of it."""
    fenced = F.concat(F.lit("```json\nresult: "), F.col("props"), F.lit("\n```"))
    body = F.regexp_extract(fenced, r"(?s)\{.*\}", 0)
    return fx.load(spark, sf_dir, "events").select("event_id", F.get_json_object(body, "$.k").alias("k"))


@query("SELECT p_partkey, '{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"size\":' || p_size || '}' AS j FROM part")
def sc37_canonical_json(spark, sf_dir):
    return fx.load(spark, sf_dir, "part").select("p_partkey", X.canonical_json({"size": "p_size", "name": "p_name", "brand": "p_brand"}).alias("j"))


def _typing_sql() -> str:
    """The rules once more, as a table of clues."""
    rules = ", ".join(f"('{c}', '{f}', {n}, [{', '.join(repr(t) for t in toks)}], [{', '.join(repr(p) for p in phr)}]::VARCHAR[])" for c, f, n, toks, phr in L.TYPING_RULES)
    return f"""
WITH rules(coarse, fine, least_score, toks, phrases) AS (VALUES {rules}),
d AS (SELECT doc_id, {FOLD} AS low, list_distinct({TOKENS}) AS toks FROM documents),
s AS (SELECT doc_id, coarse, fine, least_score, len(list_intersect(d.toks, rules.toks)) + 2 * len(list_filter(phrases, lambda p: contains(low, p))) AS sc FROM d, rules),
r AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY sc DESC) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, fine) AS n FROM s WHERE sc >= least_score),
k AS (SELECT doc_id, string_agg(DISTINCT coarse, ',' ORDER BY coarse) AS coarse, string_agg(fine, ',' ORDER BY n) AS fine FROM r WHERE top = 1 AND n <= 2 GROUP BY doc_id)
SELECT doc_id, coalesce(coarse, 'MISC') AS coarse, coalesce(fine, 'MISC') AS fine FROM d LEFT JOIN k USING (doc_id)"""


@query(_typing_sql())
def n1_lexical_typing(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", lexical_types(F.col("text")).alias("t")).select("doc_id", F.array_join("t.coarse", ",").alias("coarse"), F.array_join("t.fine", ",").alias("fine"))
