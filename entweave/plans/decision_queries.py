"""The rules that judge candidates, over candidates drawn from line items by arithmetic: every rule meets cases on both of its
sides, and each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rerank as R
from ..operators import resolution as A
from ..operators import search as S
from ..operators import triggers as V
from ..scratch import written
from . import fixtures as fx
from .registry import query

KEYS = ["t", "k"]

QID = "concat('Q', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(l_quantity AS BIGINT))"

#: candidate column -> SQL over lineitem, which Spark and the checks read alike
CANDIDATE = {
    "t": "l_orderkey % 5", "k": "l_orderkey", "qid": QID, "label": "concat('part ', l_partkey % 3, CASE l_suppkey % 4 WHEN 0 THEN ' old' WHEN 1 THEN ' old red blue' ELSE '' END)",
    "final_score": "CAST(l_quantity AS BIGINT) / 3.0e0 + l_suppkey % 4 / 4.0e0", "es_score": "CAST(l_quantity AS BIGINT) * 1.5e0", "prior": "l_partkey % 100 / 100.0e0",
    "family_group": "CASE l_partkey % 4 WHEN 0 THEN concat('g', l_partkey % 8) END", "item_category": "'ENTITY'", "coarse_type": "CASE l_suppkey % 3 WHEN 0 THEN 'PERSON' ELSE 'WORK' END", "fine_type": "CASE l_suppkey % 2 WHEN 0 THEN 'FILM' ELSE 'BOOK' END",
    "same_type_resolver_score": "CAST(l_quantity AS BIGINT) / 3.0e0 + l_partkey % 7 - 3.0e0", "best_name_similarity": "l_suppkey % 50 / 50.0e0", "label_exact": "l_partkey % 11 = 0", "alias_exact": "l_partkey % 7 = 0", "label_prefix": "l_partkey % 5 = 0", "label_contains": "l_partkey % 3 = 0",
    "coarse_match": "l_partkey % 2 = 0", "fine_match": "l_partkey % 4 = 0", "item_category_match": "l_suppkey % 9 > 0", "weighted_context_overlap": "CAST(l_quantity AS BIGINT) % 7 / 2.0e0", "expected_descriptor_overlap": "l_partkey % 3",
    "schema_family_match": "l_suppkey % 2 = 0", "column_role_match": "l_suppkey % 3 = 0", "row_template_alignment": "l_suppkey % 10 / 10.0e0", "has_wikipedia": "l_partkey % 2 = 1",
    "candidate_family": "CASE l_partkey % 6 WHEN 5 THEN 'CREATIVE_WORK' WHEN 4 THEN 'DERIVATIVE_TOPIC' ELSE 'PRIMARY' END", "primary_entity_score": "l_partkey % 9 / 9.0e0", "derivative_penalty": "l_suppkey % 4 * 1.0e0",
    "description": "CASE l_partkey % 13 WHEN 0 THEN 'A list of things' ELSE 'a thing' END", "context_string": "''", "wikipedia_url": "''", "unsupported_qualifier_count": "CASE l_partkey % 17 WHEN 0 THEN 1 ELSE 0 END", "label_has_parenthetical_qualifier": "l_partkey % 19 = 0",
    "mention_token_coverage": "l_partkey % 10 / 10.0e0", "label_context_support_score": "l_suppkey % 20 / 20.0e0",
}
NUMBERS = ("final_score", "es_score", "prior", "same_type_resolver_score", "best_name_similarity", "weighted_context_overlap", "row_template_alignment", "primary_entity_score", "derivative_penalty", "mention_token_coverage", "label_context_support_score")


def _column(name: str) -> str:
    return f"CAST({CANDIDATE[name]} AS DOUBLE)" if name in NUMBERS else CANDIDATE[name]


F_SQL = "WITH f AS (SELECT DISTINCT " + ", ".join(f"{_column(c)} AS {c}" for c in CANDIDATE) + " FROM lineitem)"


def candidates(spark, sf_dir) -> DataFrame:
    """All columns follow from five numbers, which qid spells out: these move, once, by the cell, and are made distinct, not what is
    made of them."""
    numbers = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("l_quantity")]
    rows = fx.load(spark, sf_dir, "lineitem").select(*numbers).repartition("l_orderkey").distinct()
    return rows.select(*[F.expr(_column(c)).alias(c) for c in CANDIDATE])


RANK = F_SQL + """,
raw AS (SELECT *, row_number() OVER (PARTITION BY t, k ORDER BY es_score DESC, qid) AS raw_rank FROM f),
o1 AS (SELECT *, row_number() OVER (PARTITION BY t, k ORDER BY final_score DESC, es_score DESC, prior DESC, qid DESC) AS o FROM raw),
gr AS (SELECT *, row_number() OVER (PARTITION BY t, k, family_group ORDER BY o) AS gn FROM o1),
o2 AS (SELECT *, row_number() OVER (PARTITION BY t, k ORDER BY o) AS n, item_category || coarse_type || fine_type AS kind FROM gr WHERE family_group IS NULL OR gn = 1),
tops AS (SELECT *, first_value(kind) OVER w AS tk, first_value(same_type_resolver_score) OVER w AS tr, first_value(final_score) OVER w AS tf, first_value(best_name_similarity) OVER w AS tn FROM o2 WINDOW w AS (PARTITION BY t, k ORDER BY n)),
riv AS (SELECT *, first_value(n) OVER (PARTITION BY t, k ORDER BY (n <= 12 AND kind = tk)::INT DESC, same_type_resolver_score DESC, n) AS bn FROM tops),
ap AS (SELECT *, n = bn AND bn > 1 AND same_type_resolver_score - tr >= 1 AND tf - final_score <= 3.5 AND best_name_similarity >= greatest(0.74, tn - 0.2) AS applied FROM riv),
fin AS (SELECT * REPLACE (final_score + CASE WHEN applied THEN round(least(3.0, same_type_resolver_score - tr), 4) ELSE 0 END AS final_score) FROM ap),
rk AS (SELECT *, CASE WHEN max(applied::INT) OVER (PARTITION BY t, k) = 1 THEN row_number() OVER (PARTITION BY t, k ORDER BY final_score DESC, same_type_resolver_score DESC, es_score DESC, qid DESC) ELSE n END AS reranked_rank FROM fin)"""


def ranked(spark, sf_dir) -> DataFrame:
    return R.rerank(candidates(spark, sf_dir), KEYS)


@query(RANK + " SELECT k, qid, round(final_score, 4) AS final_score, raw_rank, reranked_rank, applied FROM rk")
def f7_w4_w7_rerank(spark, sf_dir):
    """Order, one candidate a family, the same-type resolver, both ranks."""
    return ranked(spark, sf_dir).select("k", "qid", F.round("final_score", 4).alias("final_score"), "raw_rank", "reranked_rank", F.col("same_type_resolver_applied").alias("applied"))


DECIDE = RANK + """,
nx AS (SELECT *, lead(final_score, 1, 0.0) OVER w AS second, lead(qid) OVER w AS runner_up_qid, lead(label) OVER w AS runner_up_label FROM rk WINDOW w AS (PARTITION BY t, k ORDER BY reranked_rank)),
sg AS (SELECT *, final_score - second AS margin, CASE WHEN label_exact THEN 1.0 WHEN alias_exact THEN 0.9 WHEN label_prefix THEN 0.7 WHEN label_contains THEN 0.45 WHEN best_name_similarity >= 0.95 THEN 0.92 WHEN best_name_similarity >= 0.9 THEN 0.84 WHEN best_name_similarity >= 0.84 THEN 0.74 WHEN best_name_similarity >= 0.76 THEN 0.58 ELSE 0 END::DOUBLE AS lexical,
  least(1.0, coarse_match::INT * 0.4::DOUBLE + fine_match::INT * 0.4::DOUBLE + item_category_match::INT * 0.2::DOUBLE) AS tkind, least(1.0, weighted_context_overlap / 2.5 + expected_descriptor_overlap / 4.0) AS context,
  least(1.0, schema_family_match::INT * 0.5::DOUBLE + column_role_match::INT * 0.35::DOUBLE + row_template_alignment * 0.3::DOUBLE) AS schem, least(1.0, prior * 1.4::DOUBLE + has_wikipedia::INT * 0.2::DOUBLE) AS authority, CASE candidate_family WHEN 'PRIMARY' THEN 1.0 ELSE 0.45 END::DOUBLE AS fam,
  greatest(0, least(1, primary_entity_score - least(0.45, derivative_penalty * 0.05::DOUBLE))) AS identity, greatest(0, least(1, (final_score - 6.0) / 10.0)) AS strength, greatest(0, least(1, (final_score - second) / 4.0)) AS clear FROM nx WHERE reranked_rank = 1),
cf AS (SELECT *, greatest(0, least(1, lexical * 0.24::DOUBLE + tkind * 0.17::DOUBLE + context * 0.12::DOUBLE + schem * 0.08::DOUBLE + authority * 0.13::DOUBLE + fam * 0.11::DOUBLE + identity * 0.06::DOUBLE + strength * 0.08::DOUBLE + clear * 0.07::DOUBLE)) AS conf FROM sg),
de AS (SELECT t, k, qid AS selected_qid, label AS selected_label, round(CAST(CAST(conf AS VARCHAR) AS DECIMAL(30, 20)), 4)::DOUBLE AS confidence, round(margin, 4) AS margin,
  conf < 0.58 OR final_score < 7.5 OR candidate_family NOT IN ('PRIMARY', 'DERIVATIVE_TOPIC') OR (margin < 1.0 AND (lexical < 0.72 OR coalesce(label = runner_up_label, false))) AS abstain, candidate_family, round(final_score, 4) AS top_final_score, runner_up_qid, runner_up_label,
  list_filter([CASE WHEN lexical >= 0.9 THEN 'strong_lexical_match' WHEN lexical >= 0.58 THEN 'fuzzy_lexical_match' END, CASE WHEN tkind >= 0.8 THEN 'type_alignment' END, CASE WHEN context >= 0.5 THEN 'context_alignment' END, CASE WHEN schem >= 0.45 THEN 'schema_alignment' END, CASE WHEN authority >= 0.45 THEN 'authority_signal' END,
    CASE WHEN fam >= 0.9 THEN 'primary_family' END, CASE WHEN identity >= 0.55 THEN 'primary_identity_signal' END, CASE WHEN applied THEN 'same_type_resolver' END, CASE WHEN clear >= 0.35 THEN 'clear_margin' END], lambda x: x IS NOT NULL) AS codes FROM cf),
tg AS (SELECT DISTINCT o_orderkey % 5 AS t, o_orderkey AS k FROM orders)"""


def targets(spark, sf_dir) -> DataFrame:
    """Orders; those without line items have no candidates."""
    return fx.load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("t"), F.col("o_orderkey").alias("k")).distinct()


@query(DECIDE + " SELECT k, selected_qid, coalesce(confidence, 0) AS confidence, coalesce(margin, 0) AS margin, coalesce(abstain, true) AS abstain, top_final_score, runner_up_qid, CASE WHEN abstain IS NULL THEN 'no_candidates' WHEN len(codes) = 0 THEN 'weak_evidence' ELSE array_to_string(codes, ',') END AS reasons FROM tg LEFT JOIN de USING (t, k)")
def d1_w8_decision_rules(spark, sf_dir):
    """Nine signals, reasons, abstention; orders without a candidate get a row too."""
    d = R.decide(ranked(spark, sf_dir), KEYS, targets=targets(spark, sf_dir))
    return d.select("k", "selected_qid", "confidence", "margin", "abstain", "top_final_score", "runner_up_qid", F.array_join("reason_codes", ",").alias("reasons"))


def judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = written(ranked(spark, sf_dir), "ranked")
    return r, written(R.decide(r, KEYS), "decided")


def gold(spark, sf_dir) -> DataFrame:
    return fx.load(spark, sf_dir, "lineitem").where("l_linenumber in (1, 3)").select((F.col("l_orderkey") % 5).alias("t"), F.col("l_orderkey").alias("k"), F.expr(QID).alias("gold_qid")).distinct()


EVAL = DECIDE + """,
go AS (SELECT DISTINCT l_orderkey % 5 AS t, l_orderkey AS k, """ + QID + """ AS gold_qid FROM lineitem WHERE l_linenumber IN (1, 3)),
dg AS (SELECT go.t, go.k, min(reranked_rank) AS best_rank, min(raw_rank) AS best_raw FROM go LEFT JOIN rk ON rk.t = go.t AND rk.k = go.k AND rk.qid = gold_qid GROUP BY 1, 2),
ok AS (SELECT go.t, go.k, coalesce(bool_or(selected_qid = gold_qid), false) AS ok FROM go LEFT JOIN de USING (t, k) GROUP BY 1, 2),
ev AS (SELECT t, count(*) AS cells, round(avg(ok::INT), 4) AS accuracy, round(avg((NOT abstain)::INT), 4) AS coverage, round(count(*) FILTER (WHERE ok AND NOT abstain) / nullif(count(*) FILTER (WHERE NOT abstain), 0), 4) AS answered_accuracy,
  round(avg(best_rank), 4) AS mean_rank, round(avg(best_raw), 4) AS mean_raw_rank, round(avg(coalesce(best_rank <= 1, false)::INT), 4) AS recall_at_1, round(avg(coalesce(best_rank <= 3, false)::INT), 4) AS recall_at_3 FROM ok JOIN dg USING (t, k) JOIN de USING (t, k) GROUP BY 1)"""


def evaluated(spark, sf_dir) -> DataFrame:
    r, d = judged(spark, sf_dir)
    g = gold(spark, sf_dir)
    return R.summary(d, g, R.diagnostics(r, g, KEYS, cuts=(1, 3)), ["t"], KEYS)


@query(EVAL + " SELECT * FROM ev")
def e1_a6_j11_summary(spark, sf_dir):
    """Accuracy, coverage, ranks and recalls per group of orders, with two gold ids a cell."""
    return evaluated(spark, sf_dir).drop("invoked", "overridden", "confirmed")


@query(EVAL + " SELECT CAST(sum(cells) AS BIGINT) AS cells, round(sum(accuracy * cells) / sum(cells), 4) AS accuracy, round(sum(coverage * cells) / sum(cells), 4) AS coverage, round(sum(recall_at_3 * cells) / sum(cells), 4) AS recall_at_3 FROM ev")
def a7_weighted_rates(spark, sf_dir):
    return R.weighted_total(evaluated(spark, sf_dir), ["accuracy", "coverage", "recall_at_3"])


VERDICTS = DECIDE + """,
ve AS (SELECT t, k, CASE k % 6 WHEN 0 THEN selected_qid WHEN 5 THEN 'Q1' ELSE coalesce(runner_up_qid, selected_qid) END AS q, CAST(k % 50 / 50.0 AS DOUBLE) AS c, k % 9 = 0 AS a FROM de WHERE k % 4 > 0),
jo AS (SELECT de.*, q, coalesce(c, 0) AS c, coalesce(a, false) AS a, ve.k IS NOT NULL AS there, coalesce(q IN (selected_qid, runner_up_qid), false) AS known, coalesce(q = selected_qid, false) AS same, k % 3 = 0 AS hard FROM de LEFT JOIN ve USING (t, k)),
us AS (SELECT *, there AND NOT a AND known AS useful FROM jo)"""


def verdicts(decided: DataFrame) -> DataFrame:
    k = F.col("k")
    q = F.when(k % 6 == 0, F.col("selected_qid")).when(k % 6 == 5, "Q1").otherwise(F.coalesce("runner_up_qid", "selected_qid"))
    return decided.where(k % 4 > 0).select(*KEYS, q.alias("verdict_qid"), (k % 50 / 50.0).cast("double").alias("verdict_confidence"), (k % 9 == 0).alias("verdict_abstain"))


def _outcome(df: DataFrame) -> DataFrame:
    return df.select("k", "selected_qid", F.round("confidence", 4).alias("confidence"), "abstain", "resolution_mode")


SEMANTIC_MODE = "CASE WHEN NOT there THEN 'deterministic_only' WHEN useful AND same THEN 'semantic_confirmed' WHEN useful AND abstain AND c >= 0.72 THEN 'semantic_override_after_abstain' WHEN useful AND margin < 1.5 AND confidence < 0.82 AND c >= 0.82 THEN 'semantic_override_low_margin' ELSE 'deterministic_kept' END"


@query(VERDICTS + f", m AS (SELECT *, {SEMANTIC_MODE} AS mode FROM us) SELECT k, CASE WHEN mode LIKE '%override%' THEN q ELSE selected_qid END AS selected_qid, round(CASE WHEN mode LIKE '%override%' THEN c WHEN mode = 'semantic_confirmed' THEN greatest(confidence, c) ELSE confidence END, 4) AS confidence, abstain AND mode NOT LIKE 'semantic%' AS abstain, mode AS resolution_mode FROM m")
def d6_merge_semantic(spark, sf_dir):
    r, d = judged(spark, sf_dir)
    return _outcome(A.merge_semantic(d, verdicts(d), r, KEYS))


@query(VERDICTS + ", m AS (SELECT *, CASE WHEN NOT there THEN 'ranker_unavailable' WHEN NOT useful THEN 'ranker_abstained' WHEN same THEN 'ranker_confirmed' ELSE 'ranker_override' END AS mode FROM us) SELECT k, CASE WHEN NOT there THEN selected_qid WHEN useful THEN q END AS selected_qid, round(CASE WHEN there THEN c ELSE confidence END, 4) AS confidence, CASE WHEN there THEN NOT useful ELSE abstain END AS abstain, mode AS resolution_mode FROM m")
def d6_merge_ranker(spark, sf_dir):
    r, d = judged(spark, sf_dir)
    return _outcome(A.merge_ranker(d, verdicts(d), r, KEYS))


SHEPHERD_MODE = """CASE WHEN NOT there THEN 'deterministic_only' WHEN NOT useful THEN CASE WHEN abstain OR (a AND c >= 0.72 AND confidence < 0.78) THEN 'shepherd_abstained' ELSE 'shepherd_kept_deterministic' END WHEN same THEN 'shepherd_confirmed'
  WHEN abstain AND c >= 0.7 THEN 'shepherd_override_after_abstain' WHEN hard AND c >= 0.78 THEN 'shepherd_override_ambiguity' WHEN margin < 1.5 AND c >= 0.82 THEN 'shepherd_override_low_margin' ELSE 'shepherd_kept_deterministic' END"""
SHEPHERD_OUT = """CASE WHEN mode LIKE '%override%' THEN q ELSE selected_qid END AS selected_qid, round(CASE mode WHEN 'shepherd_confirmed' THEN greatest(confidence, c) WHEN 'shepherd_override_ambiguity' THEN greatest(c, least(0.94, confidence + 0.02)) WHEN 'shepherd_override_after_abstain' THEN c WHEN 'shepherd_override_low_margin' THEN c ELSE confidence END, 4) AS confidence,
  CASE WHEN mode = 'shepherd_abstained' THEN true WHEN mode LIKE '%override%' THEN false WHEN mode = 'shepherd_confirmed' AND ((NOT abstain AND c >= 0.7 AND confidence >= 0.68) OR (abstain AND c >= 0.78)) THEN false ELSE abstain END AS abstain, mode AS resolution_mode"""


def hard_cases(decided: DataFrame) -> DataFrame:
    hard = F.col("k") % 3 == 0
    return decided.select(*KEYS, hard.alias("should_run"), F.when(hard, F.array(F.lit("close_competitor"))).otherwise(F.array(F.lit("low_confidence"))).alias("reason_codes"))


@query(VERDICTS + f", m AS (SELECT *, {SHEPHERD_MODE} AS mode FROM us) SELECT k, {SHEPHERD_OUT} FROM m")
def d6_merge_shepherd(spark, sf_dir):
    r, d = judged(spark, sf_dir)
    return _outcome(A.merge_shepherd(d, verdicts(d), r, hard_cases(d), KEYS))


@query(VERDICTS + f""", w AS (SELECT *, CASE WHEN hard THEN {SHEPHERD_MODE} WHEN k % 5 < 3 THEN {SEMANTIC_MODE} ELSE 'deterministic_only' END AS mode FROM us)
SELECT mode AS resolution_mode, count(*) AS cells FROM w GROUP BY 1""")
def d8_precedence(spark, sf_dir):
    """The shepherd where its trigger asks for it, else the semantic fallback where that is asked for."""
    r, d = judged(spark, sf_dir)
    asked = d.select(*KEYS, (F.col("k") % 5 < 3).alias("should_run"), F.array(F.lit("low_margin")).alias("reason_codes"))
    v = verdicts(d)
    return A.resolve(d, r, asked, hard_cases(d), KEYS, shepherd=v, semantic=v).groupBy("resolution_mode").agg(F.count("*").alias("cells"))


@query(DECIDE + """, c AS (SELECT rk.*, coalesce(selected_label, '') AS anchor FROM rk JOIN de USING (t, k) WHERE reranked_rank <= 30),
a AS (SELECT t, k, list(qid ORDER BY reranked_rank) FILTER (WHERE reranked_rank <= 3) AS f3, count(*) FILTER (WHERE reranked_rank <= 3 AND label = anchor) AS n3, coalesce(list(qid ORDER BY prior DESC, weighted_context_overlap DESC, reranked_rank) FILTER (WHERE label = anchor), []) AS tw,
  coalesce(list(qid ORDER BY mention_token_coverage DESC, label_context_support_score DESC, prior DESC, weighted_context_overlap DESC, reranked_rank) FILTER (WHERE mention_token_coverage >= 0.6 AND (label_context_support_score >= 0.45 OR prior >= 0.35)), []) AS su, coalesce(list(qid ORDER BY reranked_rank) FILTER (WHERE reranked_rank <= 5), []) AS f5, list(qid ORDER BY prior DESC, weighted_context_overlap DESC, reranked_rank) AS hp FROM c GROUP BY 1, 2),
b AS (SELECT *, list_concat(f3, list_filter(tw, lambda x: NOT list_contains(f3, x))[1:greatest(0, 5 - n3)]) AS st FROM a),
e AS (SELECT *, list_concat(list_concat(st, su), list_concat(f5, hp)) AS al FROM b)
SELECT k, array_to_string(list_filter(al, lambda x, i: list_position(al, x) = i)[1:greatest(len(st), 8)], ',') AS shortlist FROM e""")
def d4_shortlist(spark, sf_dir):
    """Diverse candidates for an adjudicator, each group after the other."""
    r, d = judged(spark, sf_dir)
    return A.shortlist(r, d, KEYS).select("k", F.array_join("shortlist", ",").alias("shortlist"))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS correct, o_orderkey % 2 = 0 AS abstain, CASE o_orderkey % 3 WHEN 0 THEN 'weak' ELSE 'strong' END AS st, o_orderkey % 7 < 4 AS filtered, o_orderkey % 4 > 0 AS gin, o_orderkey % 6 AS gr, o_orderkey % 8 = 1 AS ra, o_orderkey % 11 AS x,
  CASE o_custkey % 4 WHEN 0 THEN 'semantic_confirmed' WHEN 1 THEN 'shepherd_abstained' ELSE 'deterministic_only' END AS mode, o_custkey % 10 / 10.0 AS sc FROM orders),
y AS (SELECT *, CASE x WHEN 0 THEN 'no_candidates' WHEN 1 THEN 'same_label_cluster' WHEN 2 THEN 'same_type_cluster' WHEN 3 THEN 'authority_conflict' WHEN 4 THEN 'low_authority_top_candidate' WHEN 5 THEN 'derivative_or_unsupported_candidate' WHEN 6 THEN 'list_or_disambiguation_candidate' ELSE 'low_margin' END AS tr, mode LIKE 'semantic%' OR mode LIKE 'shepherd%' AS asked FROM r)
SELECT k, CASE WHEN st = 'weak' AND filtered AND (abstain OR tr = 'no_candidates') THEN 'overcommitted_hard_filter' WHEN NOT gin THEN 'gold_missing_from_candidates' WHEN gr > 1 AND ra THEN 'same_type_resolver_misfire' WHEN tr = 'no_candidates' THEN 'retrieval_no_candidates'
  WHEN st = 'weak' AND (abstain OR asked) AND NOT (abstain AND NOT asked AND mode LIKE 'shepherd%') THEN 'weak_mention_type_error' WHEN sc >= 0.75 AND asked THEN 'wrong_schema_induction' WHEN tr = 'same_label_cluster' THEN 'same_label_ambiguity' WHEN tr = 'same_type_cluster' THEN 'same_type_ambiguity'
  WHEN tr IN ('authority_conflict', 'low_authority_top_candidate') THEN 'authority_duplicate_ambiguity' WHEN tr IN ('derivative_or_unsupported_candidate', 'list_or_disambiguation_candidate') THEN 'derivative_candidate_ambiguity'
  ELSE CASE WHEN mode LIKE 'semantic%' THEN 'semantic' WHEN mode LIKE 'shepherd%' THEN 'shepherd' ELSE 'deterministic' END || CASE WHEN abstain THEN '_abstention' ELSE '_misresolution' END END AS family FROM y WHERE NOT correct""")
def e3_error_families(spark, sf_dir):
    """Every class of error, over results drawn from orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    codes = X.words_array(["no_candidates", "same_label_cluster", "same_type_cluster", "authority_conflict", "low_authority_top_candidate", "derivative_or_unsupported_candidate", "list_or_disambiguation_candidate", "low_margin", "low_margin", "low_margin", "low_margin"])
    r = fx.load(spark, sf_dir, "orders").select(
        k.alias("k"), (k % 5 == 0).alias("correct"), (k % 2 == 0).alias("abstain"), F.when(k % 3 == 0, "weak").otherwise("strong").alias("mention_strength"), (k % 7 < 4).alias("filtered"), (k % 4 > 0).alias("gold_in_candidates"), (k % 6).alias("gold_rank"),
        (k % 8 == 1).alias("resolver_applied"), F.array(F.get(codes, (k % 11).cast("int"))).alias("triggers"), F.when(c % 4 == 0, "semantic_confirmed").when(c % 4 == 1, "shepherd_abstained").otherwise("deterministic_only").alias("mode"), (c % 10 / 10.0).alias("schema_confidence"),
    )
    return r.select("k", "correct", V.error_family(r).alias("family")).where("not correct").select("k", "family")


TOPS = DECIDE + """,
tp AS (SELECT t, k, list({'label': label, 'norm': label, 'item_category': item_category, 'coarse_type': coarse_type, 'fine_type': fine_type, 'family': candidate_family, 'final': final_score, 'prior': prior, 'sim': best_name_similarity, 'align': row_template_alignment, 'fam_ok': schema_family_match, 'role_ok': column_role_match,
  'wco': weighted_context_overlap, 'descr': expected_descriptor_overlap, 'cov': mention_token_coverage, 'sup': label_context_support_score, 'unsup': unsupported_qualifier_count, 'pen': derivative_penalty, 'paren': label_has_parenthetical_qualifier, 'stub': description LIKE '%list of%',
  'extra': CASE WHEN label LIKE '%blue' THEN 3 WHEN label LIKE '%old' THEN 1 ELSE 0 END} ORDER BY reranked_rank) AS c FROM rk WHERE reranked_rank <= 25 GROUP BY 1, 2),
j AS (SELECT de.* EXCLUDE (codes), c, c[1] AS top, c[2] AS sec, c[1:5] AS c5 FROM de JOIN tp USING (t, k))"""


def with_tokens(ranked_: DataFrame) -> DataFrame:
    return ranked_.withColumns({"label_tokens": X.lab_tokens("label"), "mention_tokens": F.array(F.lit("part"))})


def _trigger(df: DataFrame) -> DataFrame:
    return df.select("k", "should_run", F.array_join("reason_codes", ",").alias("reasons"))


@query(TOPS + """,
a AS (SELECT *, NOT abstain AND confidence >= 0.84 AND margin >= 2.5 AS sure, NOT abstain AND top.family = 'PRIMARY' AND NOT coalesce(top.norm = sec.norm, false) AS alone, (abstain OR margin < 1.5 OR confidence < 0.78) AND len(c5) > 1 AS several FROM j),
b AS (SELECT *, CASE WHEN sure THEN 'strong_deterministic_decision' WHEN alone AND ((top.sim >= 0.84 AND confidence >= 0.7) OR (top.sim >= 0.76 AND confidence >= 0.66 AND margin >= 1.5) OR (top.fam_ok AND top.role_ok AND top.align >= 0.35 AND confidence >= 0.74)) THEN 'strong_fuzzy_deterministic_decision'
  WHEN alone AND top.sim >= 0.9 AND confidence >= 0.8 THEN 'confident_non_clustered_deterministic_decision' END AS stop,
  list_filter([CASE WHEN abstain THEN 'deterministic_abstain' END, CASE WHEN margin < 2 THEN 'low_margin' END, CASE WHEN confidence < 0.78 THEN 'low_confidence' END, CASE WHEN several AND len(list_distinct(list_transform(c5, lambda x: x.label))) = 1 THEN 'same_label_cluster' END,
    CASE WHEN several AND len(list_distinct(list_transform(c5, lambda x: x.coarse_type || x.fine_type))) = 1 THEN 'same_type_cluster' END, CASE WHEN several AND len(list_filter(c5, lambda x: x.family <> 'PRIMARY')) = 0 THEN 'primary_family_competition' END], lambda x: x IS NOT NULL) AS codes FROM a)
SELECT k, stop IS NULL AND len(codes) > 0 AS should_run, coalesce(stop, array_to_string(codes, ',')) AS reasons FROM b""")
def d2_semantic_rules(spark, sf_dir):
    """When the semantic fallback is asked for, and why (not)."""
    r, d = judged(spark, sf_dir)
    return _trigger(V.semantic_trigger(with_tokens(r), d, KEYS))


@query(TOPS + """,
s AS (SELECT *, c[2:25] AS rest, c[1:12] AS near FROM j),
m AS (SELECT *, list_filter(rest, lambda x: x.norm = top.norm) AS twins, len(list_filter(near, lambda x: x.coarse_type = top.coarse_type AND x.fine_type = top.fine_type)) AS alike, len(list_filter(near[2:12], lambda x: top.final - x.final < 2.5)) > 0 AS close,
  list_filter(rest, lambda x: x.coarse_type = top.coarse_type AND x.fine_type = top.fine_type AND x.cov >= greatest(0.6, top.cov - 0.05::DOUBLE) AND top.final - x.final < 4.5) AS labels,
  top.prior < 0.2 AND len(list_filter(rest, lambda x: x.prior >= 0.35 AND ((x.coarse_type = top.coarse_type AND x.fine_type = top.fine_type) OR x.sim >= 0.75 OR ends_with(x.norm, top.norm)))) > 0 AS modest, top.unsup > 0 OR top.pen >= 1 OR top.paren OR top.stub AS odd FROM s),
n AS (SELECT *, len(twins) > 0 AS twin, len(list_filter(twins, lambda x: x.prior >= top.prior + 0.18::DOUBLE OR x.wco > top.wco + 0.5)) > 0 AS conflict,
  len(list_filter(labels, lambda x: top.extra >= 2 AND x.extra < top.extra AND (x.prior >= top.prior + 0.12::DOUBLE OR x.sup >= top.sup + 0.08::DOUBLE OR x.descr > top.descr))) > 0 AS cleaner,
  len(list_filter(labels, lambda x: top.extra = 0 AND top.cov >= 0.95 AND x.extra <= 3 AND x.descr > top.descr AND (x.prior >= top.prior + 0.12::DOUBLE OR x.sup >= top.sup + 0.08::DOUBLE OR x.wco >= top.wco + 0.35::DOUBLE))) > 0 AS thin, margin < 2 AS narrow FROM m),
o AS (SELECT *, list_filter([CASE WHEN abstain THEN 'deterministic_abstain' END, CASE WHEN narrow AND (abstain OR twin OR odd OR modest OR confidence < 0.78) THEN 'low_margin' END, CASE WHEN confidence < 0.75 AND (narrow OR abstain OR close) THEN 'low_confidence' END,
  CASE WHEN twin AND (narrow OR conflict OR modest OR abstain) THEN 'same_label_cluster' END, CASE WHEN alike > 2 AND close AND (abstain OR confidence < 0.75 OR odd OR modest OR cleaner OR thin) THEN 'same_type_cluster' END, CASE WHEN cleaner THEN 'cleaner_label_competitor' END, CASE WHEN thin THEN 'underspecified_label_competitor' END,
  CASE WHEN conflict THEN 'authority_conflict' END, CASE WHEN modest AND (twin OR close OR narrow OR odd) THEN 'low_authority_top_candidate' END, CASE WHEN odd THEN 'derivative_or_unsupported_candidate' END, CASE WHEN top.stub THEN 'list_or_disambiguation_candidate' END,
  CASE WHEN close AND (twin OR modest OR odd OR abstain OR cleaner OR thin) THEN 'close_competitor' END], lambda x: x IS NOT NULL) AS codes FROM n)
SELECT k, len(codes) > 0 AS should_run, CASE WHEN len(codes) = 0 AND confidence >= 0.9 AND margin >= 3 THEN 'strong_unambiguous_deterministic_decision' ELSE array_to_string(codes, ',') END AS reasons FROM o""")
def d3_ambiguity_rules(spark, sf_dir):
    """When the adjudicator of hard ambiguities is asked for: twelve reasons in their order."""
    r, d = judged(spark, sf_dir)
    return _trigger(V.ambiguity_trigger(with_tokens(r), d, KEYS))


SEARCH = """WITH d AS (SELECT p_partkey, p_brand AS coarse_type, CASE p_partkey % 2 WHEN 0 THEN 'EVEN' ELSE 'ODD' END AS fine_type, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS l, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') AS ls, regexp_extract_all(lower(p_brand), '[a-z0-9]+') AS al, regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]+') AS cx, [lower(p_name)] AS kw FROM part),
fl AS (SELECT p_partkey, 'label' AS f, l AS ts FROM d UNION ALL SELECT p_partkey, 'labels', ls FROM d UNION ALL SELECT p_partkey, 'aliases', al FROM d UNION ALL SELECT p_partkey, 'context', cx FROM d UNION ALL SELECT p_partkey, 'keyword', kw FROM d),
po AS (SELECT f, p_partkey, len(ts) AS dl, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pl FROM fl),
ix AS (SELECT f, tok, p_partkey, count(*) AS tf, any_value(dl) AS dl FROM po GROUP BY 1, 2, 3),
st AS (SELECT f, count(*) AS n, avg(len(ts)) AS av FROM fl WHERE len(ts) > 0 GROUP BY 1), df AS (SELECT f, tok, count(*) AS df FROM ix GROUP BY 1, 2),
w AS (SELECT f, tok, p_partkey, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)) AS w FROM ix JOIN df USING (f, tok) JOIN st USING (f)),
rq AS (SELECT p_name AS r, p_name AS v1, split_part(p_name, ' ', 1) AS v2, max(p_type) AS cx, min(p_brand) AS br, count(*) AS c FROM part GROUP BY 1),
tx AS (SELECT r, 'v1' AS i, true AS must, v1 AS t, 1.0 AS wt FROM rq UNION ALL SELECT r, 'v2', true, v2, 0.7 FROM rq UNION ALL SELECT r, 'c1', false, cx, 0.65 FROM rq),
cl AS (SELECT r, i || 'k' AS i, must, 'term' AS kind, 'keyword' AS f, 8 * (1 + 4 * wt) AS b, [lower(t)] AS ts FROM tx WHERE must UNION ALL SELECT r, i || 'p', must, 'phrase', 'label', CASE WHEN must THEN 5 * (1 + 4 * wt) ELSE 1.5 + 5 * wt END, regexp_extract_all(lower(t), '[a-z0-9]+') FROM tx
  UNION ALL SELECT r, i || 'm', must, 'match', x.f, CASE WHEN must THEN 2 * (1 + 4 * wt) * x.m ELSE greatest(1.5, 0.5 + 5 * wt) * x.c END, regexp_extract_all(lower(t), '[a-z0-9]+') FROM tx, (VALUES ('label', 8, 6), ('labels', 4, 3), ('aliases', 4, 3)) x(f, m, c) UNION ALL SELECT r, i || 'c', must, 'match', 'context', 1.5 + 4 * wt, regexp_extract_all(lower(t), '[a-z0-9]+') FROM tx WHERE NOT must),
ct AS (SELECT r, i, must, kind, f, b, len(ts) AS n, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pl FROM cl),
pn AS (SELECT r, i, must, f, p_partkey, sum(w.w) * any_value(b) AS s FROM ct JOIN w USING (f, tok) WHERE kind <> 'phrase' GROUP BY 1, 2, 3, 4, 5),
ph AS (SELECT r, i, must, f, p_partkey, max(s) * any_value(b) AS s FROM (SELECT r, i, must, ct.f, ct.n, b, po.p_partkey, po.pl - ct.pl AS st, count(DISTINCT ct.pl) AS c, sum(w.w) AS s FROM ct JOIN po ON po.f = ct.f AND po.tok = ct.tok JOIN w ON w.f = ct.f AND w.tok = ct.tok AND w.p_partkey = po.p_partkey WHERE kind = 'phrase' GROUP BY ALL) WHERE c = n GROUP BY 1, 2, 3, 4, 5),
be AS (SELECT r, i, must, p_partkey, max(s) AS s FROM (SELECT * FROM pn UNION ALL SELECT * FROM ph) GROUP BY 1, 2, 3, 4),
to_ AS (SELECT r, p_partkey, round(sum(s), 6) AS score FROM be GROUP BY 1, 2 HAVING bool_or(must)),
ra AS (SELECT r, to_.p_partkey, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, to_.p_partkey) AS rank FROM to_ JOIN rq USING (r) JOIN d ON d.p_partkey = to_.p_partkey WHERE (c % 3 > 0 OR coarse_type = br) AND (c % 5 > 0 OR false))"""


@query(SEARCH + " SELECT r AS request, p_partkey, score, rank FROM ra WHERE rank <= 10")
def r7_p10_boolean_search(spark, sf_dir):
    """Variants as term, phrase and best-field clauses, context clauses, ANDed filters; two different types exclude everything."""
    p = fx.load(spark, sf_dir, "part")
    docs = p.select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_brand").alias("coarse_type"), F.when(F.col("p_partkey") % 2 == 0, "EVEN").otherwise("ODD").alias("fine_type"), F.lit("ENTITY").alias("item_category"))
    fields = {"label": X.lab_tokens("p_name"), "labels": X.lab_tokens(F.concat_ws(" ", "p_name", "p_type")), "aliases": X.lab_tokens("p_brand"), "context": X.lab_tokens(F.concat_ws(" ", "p_type", "p_name")), "keyword": F.array(F.lower("p_name"))}
    index = written(S.weighted(S.positional_index(docs, "p_partkey", fields), "p_partkey"), "index")
    q = p.groupBy(F.col("p_name").alias("request")).agg(F.max("p_type").alias("cx"), F.min("p_brand").alias("br"), F.count("*").alias("c"))
    term = lambda t, w: F.struct(t.alias("text"), F.lit(w).alias("weight"))
    none = F.array().cast("array<string>")
    requests = q.select("request", F.array(term(F.col("request"), 1.0), term(F.split("request", " ")[0], 0.7)).alias("variants"), F.array(term(F.col("cx"), 0.65)).alias("context"), F.when(F.col("c") % 3 == 0, F.array("br")).otherwise(none).alias("coarse_hints"), F.when(F.col("c") % 5 == 0, X.words_array(["EVEN", "ODD"])).otherwise(none).alias("fine_hints"), none.alias("item_filters"), F.lit(10).alias("size"))
    return S.search(index, docs, requests, "p_partkey", "request")
