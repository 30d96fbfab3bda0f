"""Feature reranking of table-cell candidates, the decision with confidence and abstention, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .. import lexicon as L

CELL = ["table_id", "row_id", "col_id"]


def _none() -> Column:
    return F.array().cast("array<string>")


def cell_tokens(schema: DataFrame) -> DataFrame:
    """Expected tokens, computed once per cell and not per candidate."""
    texts = F.concat(F.array("mention", "canonical"), "row_values", "other_row_values", "column_samples", "mention_context", F.transform("soft", lambda s: s["value"]))
    all_tokens = F.array_distinct(F.flatten(F.transform(F.array_compact(texts), X.lab_tokens)))
    hints = F.flatten(F.transform(F.concat("coarse_hints", "fine_hints"), X.lab_tokens))
    found = F.array_intersect(F.concat(hints, F.col("expected_context")), X.words_array(L.DESCRIPTOR))
    water = F.when(F.col("role") == "BODY_OF_WATER_NAME", X.words_array(["lake", "water", "freshwater"])).otherwise(_none())
    c = schema.withColumn("expected_context", all_tokens).withColumn("expected_descriptor", F.array_union(found, water))
    usable = F.filter("soft", lambda s: (s["weight"] > 0) & s["value"].rlike("[A-Za-z]"))
    terms = F.transform(usable, lambda s: F.struct(X.lab_tokens(s["value"]).alias("tokens"), s["weight"].alias("weight")))
    # what supports a candidate's words: everything expected, and for names of waters the words of waters
    every = F.array_union("expected_descriptor", "expected_context")
    return c.withColumns({"terms": terms, "expected_all": every, "supported_by": F.array_union(every, F.when(F.col("role") == "BODY_OF_WATER_NAME", X.words_array(L.WATER)).otherwise(_none()))})


#: the columns of a cell that features reads, beside the keys and the mention
OF_CELL = ["role", "family", "coarse_hints", "fine_hints", "item_filters", "terms", "expected_context", "expected_descriptor", "expected_all", "supported_by"]


def _content(tokens: Column) -> Column:
    return F.filter(F.array_distinct(tokens), lambda t: ~t.isin(L.SUPPORT_STOP) & ~t.rlike("^[0-9]+$"))


def _minus(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def entity_features(e: DataFrame) -> DataFrame:
    """What hangs on the candidate alone (label, aliases, prior, wikipedia_url, context_string, description): computed once for an
    entity, however many cells it is a candidate of."""
    e = e.withColumns({
        "label_norm": X.lab_normalize(F.coalesce("label", F.lit(""))), "alias_norms": F.transform(F.coalesce("aliases", _none()), X.lab_normalize),
        "label_tokens": F.array_distinct(X.lab_tokens(F.coalesce("label", F.lit("")))), "context_tokens": F.array_distinct(X.lab_tokens(F.coalesce("context_string", F.lit("")))),
        "description_tokens": F.array_distinct(X.lab_tokens(F.coalesce("description", F.lit("")))), "prior": F.coalesce("prior", F.lit(0.0)),
        "has_wikipedia": F.coalesce(F.col("wikipedia_url") != "", F.lit(False)),
    })
    e = e.withColumns({"candidate_tokens": F.array_union(F.array_union("context_tokens", "description_tokens"), "label_tokens"), "label_words": F.array_union("label_tokens", "description_tokens"), "label_content": _content(F.col("label_tokens"))})
    count = lambda a, words: X.overlap(F.col(a), words)
    e = e.withColumns({
        "meta_token_overlap": count("candidate_tokens", L.META), "off_domain_token_overlap": count("candidate_tokens", L.OFF_DOMAIN), "water_overlap": count("candidate_tokens", L.WATER), "label_water_overlap": count("label_tokens", L.WATER),
        "scholarly": count("label_words", L.SCHOLARLY) > 0, "creative": count("label_words", L.CREATIVE) > 0, "derivative": count("label_words", L.DERIVATIVE) > 0,
        "label_has_parenthetical_qualifier": F.coalesce("label", F.lit("")).rlike(r"(?s)\(.*\)"),
    })
    return e.drop("description_tokens")


def name_features(p: DataFrame) -> DataFrame:
    """What hangs on the mention and the candidate (with entity_features) alone: computed once for all cells that say the same."""
    p = p.withColumns({"mention_norm": X.lab_normalize(F.coalesce("mention", F.lit(""))), "mention_tokens": F.array_distinct(X.lab_tokens(F.coalesce("mention", F.lit(""))))})
    n, l = F.col("mention_norm"), F.col("label_norm")
    p = p.withColumns({
        "label_exact": (l == n) & (l != ""), "alias_exact": F.array_contains("alias_norms", n), "label_prefix": (l != "") & (n != "") & l.startswith(n), "label_contains": (l != "") & (n != "") & l.contains(n),
        "label_similarity": X.name_similarity(n, l), "alias_similarity": F.coalesce(F.array_max(F.transform("alias_norms", lambda a: X.name_similarity(F.col("mention_norm"), a))), F.lit(0.0)),
        "extra": _minus(F.col("label_tokens"), F.col("mention_tokens")), "mention_content": _content(F.col("mention_tokens")),
    })
    content = F.col("mention_content")
    p = p.withColumns({
        "best_name_similarity": F.greatest("label_similarity", "alias_similarity"), "mention_token_coverage": F.when(F.size(content) > 0, F.size(F.array_intersect(content, F.col("label_content"))) / F.size(content)).otherwise(0.0),
        "extra_content": _minus(F.col("label_content"), content), "qualifiers": F.filter("extra", lambda t: ~t.isin(L.QUALIFIER_STOP) & ~t.rlike("^[0-9]+$")),
        "extra_label_meta_overlap": X.overlap(F.col("extra"), L.META), "extra_label_off_domain_overlap": X.overlap(F.col("extra"), L.OFF_DOMAIN),
    })
    return p.drop("mention_content", "label_content", "alias_norms")


def features(pairs: DataFrame) -> DataFrame:
    """Cells (with cell_tokens) joined to candidates (qid, label, aliases, coarse_type, fine_type, item_category, prior,
    wikipedia_url, context_string, description, es_score) -> all features.  Staged, so that no generated method gets too long.
    Those of name_features are taken as they are, if they are there."""
    p = pairs if "label_similarity" in pairs.columns else name_features(entity_features(pairs))
    p = p.withColumns({
        "es_score": F.coalesce("es_score", F.lit(0.0)),
        "coarse_match": F.array_contains("coarse_hints", F.coalesce("coarse_type", F.lit(""))), "fine_match": F.array_contains("fine_hints", F.coalesce("fine_type", F.lit(""))), "item_category_match": F.array_contains("item_filters", F.coalesce("item_category", F.lit(""))),
        "hit_terms": F.filter("terms", lambda t: (F.size(t["tokens"]) > 0) & F.forall(t["tokens"], lambda x: F.array_contains(F.col("context_tokens"), x))),
    })
    count = lambda a, words: X.overlap(a, words)
    desc = F.col("expected_descriptor")
    p = p.withColumns({
        "context_overlap_count": F.size("hit_terms"), "weighted_context_overlap": F.aggregate("hit_terms", F.lit(0.0), lambda a, t: a + t["weight"]),
        "expected_descriptor_overlap": F.size(F.array_intersect(desc, F.col("candidate_tokens"))),
    })
    low, words, expected = F.lower("label"), F.col("label_words"), F.col("expected_context")
    protected = (F.col("item_category") == "ENTITY") & F.col("coarse_type").isin("PERSON", "LOCATION", "ORGANIZATION")
    f = lambda name, penalty: F.struct(F.lit(name).alias("name"), (F.lit(penalty) if isinstance(penalty, float) else penalty).alias("penalty"))
    known = lambda words_, a, b: F.when(count(expected, words_) > 0, a).otherwise(b)
    family = (
        F.when(low.startswith("category:") | (F.array_contains(words, "wikimedia") & F.array_contains(words, "category")), f("META_CATEGORY", 4.5))
        .when(low.startswith("module:") | F.array_contains(words, "module") | F.array_contains(words, "template"), f("META_MODULE", 4.0))
        .when(protected, f("PRIMARY", 0.0))
        .when(F.col("scholarly"), f("SCHOLARLY_ARTICLE", known(L.SCHOLARLY, 0.75, 3.5)))
        .when(F.col("creative"), f("CREATIVE_WORK", known(L.CREATIVE, 0.75, 3.25)))
        .when(F.col("derivative"), f("DERIVATIVE_TOPIC", known(L.DERIVATIVE, 0.5, 2.5)))
        .otherwise(f("PRIMARY", 0.0))
    )
    saved = family["name"].isin("DERIVATIVE_TOPIC", "SCHOLARLY_ARTICLE", "CREATIVE_WORK") & F.col("label_exact") & (F.col("expected_descriptor_overlap") > 0) & ((F.col("prior") >= 0.2) | F.col("has_wikipedia"))
    qualifiers, supported_by = F.col("qualifiers"), F.col("supported_by")
    bio, geo = F.col("family") == "BIOGRAPHY", F.col("family") == "GEOGRAPHY"
    person_col, place_col = bio & (F.col("role") == "PERSON_NAME_OR_ALIAS"), geo & F.col("role").isin("BODY_OF_WATER_NAME", "GEOGRAPHIC_FEATURE_NAME")
    wco, edo = F.col("weighted_context_overlap"), F.col("expected_descriptor_overlap")
    p = p.withColumns({
        "fam": F.when(saved, f("PRIMARY", 0.0)).otherwise(family), "unsupported": _minus(qualifiers, supported_by), "supported_qualifier_count": F.size(F.array_intersect(qualifiers, supported_by)),
        "extra_label_descriptor_overlap": F.size(F.array_intersect(F.col("expected_descriptor"), F.col("extra"))),
        "schema_family_match": F.coalesce((bio & (F.col("coarse_type") == "PERSON")) | (geo & (F.col("coarse_type") == "LOCATION")), F.lit(False)),
        "column_role_match": F.coalesce((person_col & (F.col("coarse_type") == "PERSON") & (F.col("fine_type") == "HUMAN")) | (place_col & (F.col("coarse_type") == "LOCATION") & (F.col("fine_type") == "LANDMARK")), F.lit(False)),
        "row_template_alignment": F.when(person_col, F.least(F.lit(1.0), wco / 1.5)).when(place_col, F.least(F.lit(1.0), edo / 3.0 + wco / 3.0)).otherwise(0.0),
        "context_supported_extra": F.size(F.array_intersect("extra_content", "expected_all")), "context_unsupported": _minus(F.col("extra_content"), F.col("expected_all")),
    })
    p = p.withColumns({"candidate_family": F.col("fam.name"), "family_penalty": F.col("fam.penalty"), "unsupported_qualifier_count": F.size("unsupported"), "context_unsupported_extra": F.size("context_unsupported")})
    c = F.col
    yes = lambda cond, v: F.when(cond, v).otherwise(0.0)
    cap = lambda v, top: F.least(F.lit(float(top)), v)
    rest = F.when(c("label").contains(":"), F.substring(c("label"), F.locate(":", F.col("label")) + 1, F.length("label"))).otherwise(c("label"))
    group = F.when(c("candidate_family") != "PRIMARY", F.concat_ws(":", c("candidate_family"), F.nullif(X.lab_normalize(rest), F.lit(""))))
    primary = yes(c("candidate_family") == "PRIMARY", 0.24) + yes(c("label_exact") | c("alias_exact"), 0.16) + yes(c("has_wikipedia"), 0.12) + cap(F.greatest(F.lit(0.0), c("prior")) * 0.18, 0.14) + yes(c("schema_family_match"), 0.11) + yes(c("column_role_match"), 0.13)
    primary = primary + cap(c("row_template_alignment") * 0.14, 0.14) - cap(c("unsupported_qualifier_count") * 0.08, 0.22) - cap(c("meta_token_overlap") * 0.05, 0.16) - cap(c("off_domain_token_overlap") * 0.06, 0.16) - cap(c("family_penalty") * 0.03, 0.2)
    support = c("mention_token_coverage") * 0.45 + cap(c("context_supported_extra") / 2.0, 1) * 0.25 + cap(edo / 3.0, 1) * 0.2 + cap(wco / 2.5, 1) * 0.1 - cap(c("context_unsupported_extra") / 3.0, 1) * 0.2
    odd = c("label_has_parenthetical_qualifier") & (c("unsupported_qualifier_count") > 0)
    derivative = c("family_penalty") + cap(c("unsupported_qualifier_count") * 1.2, 4) + yes(odd, 1.25) + yes((c("candidate_family") != "PRIMARY") & (c("meta_token_overlap") + c("off_domain_token_overlap") > 0), 0.75)
    p = p.withColumns({"family_group": group, "primary_entity_score": F.round(X.clamp(primary), 4), "label_context_support_score": F.round(X.clamp(support), 4), "derivative_penalty": derivative})
    h = yes(c("label_exact"), 8.0) + yes(c("alias_exact"), 5.0) + yes(c("label_prefix"), 2.0) + yes(c("label_contains"), 1.0) + F.greatest(F.lit(0.0), (c("label_similarity") - 0.62) * 8.0) + F.greatest(F.lit(0.0), (c("alias_similarity") - 0.72) * 6.0)
    h = h + yes(c("coarse_match"), 1.5) + yes(c("fine_match"), 1.5) + yes(c("item_category_match"), 1.0) + cap(wco * 2.0, 3) + cap(c("prior") * 2.0, 1.5) + yes(c("has_wikipedia"), 0.75) + cap(c("es_score") / 100.0, 2) + cap(edo * 1.25, 3.5)
    h = h + yes(c("schema_family_match"), 1.2) + yes(c("column_role_match"), 1.8) + cap(c("row_template_alignment") * 1.5, 1.5)
    water = cap(c("water_overlap") * 1.4, 4) + cap(c("label_water_overlap") * 2.0, 3) + yes((c("label_water_overlap") > 0) & c("has_wikipedia"), 1.0) - yes(c("label_exact") & (c("water_overlap") == 0), 6.0) - yes(c("fine_type") == "COUNTRY", 7.0)
    h = h + F.when(c("role") == "BODY_OF_WATER_NAME", water).otherwise(0.0) + cap(c("extra_label_descriptor_overlap") * 2.0, 2.5) + cap(c("supported_qualifier_count") * 0.55, 1.25)
    p = p.withColumn("h1", h)
    h = c("h1") - cap(c("meta_token_overlap") * 1.25, 4) - cap(c("off_domain_token_overlap") * 1.75, 4) - cap(c("extra_label_meta_overlap") * 1.5, 3) - cap(c("extra_label_off_domain_overlap") * 2.0, 3.5) - cap(c("unsupported_qualifier_count") * 1.1, 4.5) - yes(odd, 1.2) + c("primary_entity_score") * 2.0
    lone = c("label_exact") & (edo == 0)
    h = h - yes(lone & (c("off_domain_token_overlap") > 0), 3.0) - yes(lone & (c("meta_token_overlap") > 0), 2.0) - yes((c("candidate_family") != "PRIMARY") & c("label_exact"), cap(c("family_penalty") * 0.5, 1.5))
    p = p.withColumn("heuristic_score", h).withColumn("final_score", c("heuristic_score") - c("family_penalty"))
    resolver = c("final_score") + c("primary_entity_score") * 3.0 + cap(c("row_template_alignment") * 2.0, 2) + cap(wco, 2) + cap(edo * 0.45, 1.5) - cap(c("derivative_penalty") * 0.75, 4)
    return p.withColumn("same_type_resolver_score", F.round(resolver, 4)).drop("fam", "h1", "hit_terms", "label_words", "candidate_tokens", "context_tokens", "extra", "extra_content", "qualifiers")


def rerank(feats: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Order by score, one candidate per family group, then the same-type resolver; reranked_rank from 1."""
    per = Window.partitionBy(*keys)
    order = [F.desc("final_score"), F.desc("es_score"), F.desc("prior"), F.desc("qid")]
    feats = feats.withColumn("raw_rank", F.row_number().over(per.orderBy(F.desc("es_score"), "qid")))
    r = feats.withColumn("_o", F.row_number().over(per.orderBy(*order)))
    r = r.withColumn("_g", F.row_number().over(Window.partitionBy(*keys, "family_group").orderBy("_o"))).where(F.col("family_group").isNull() | (F.col("_g") == 1))
    r = r.withColumn("_o", F.row_number().over(per.orderBy("_o")))
    kind = F.struct(*[F.coalesce(x, F.lit("")).alias(x) for x in ("item_category", "coarse_type", "fine_type")])
    top = lambda col: F.first(col).over(per.orderBy("_o"))
    r = r.withColumn("_k", kind).withColumns({"_tk": top("_k"), "_tr": top("same_type_resolver_score"), "_tf": top("final_score"), "_tn": top("best_name_similarity")})
    rival = (F.col("_o") <= 12) & (F.col("_k") == F.col("_tk")) & (F.concat("_tk.item_category", "_tk.coarse_type", "_tk.fine_type") != "")
    best = F.max(F.when(rival, F.struct("same_type_resolver_score", (-F.col("_o")).alias("o")))).over(per)
    r = r.withColumn("_b", -best["o"])
    delta = F.col("same_type_resolver_score") - F.col("_tr")
    wins = (F.col("_o") == F.col("_b")) & (F.col("_b") > 1) & (delta >= 1.0) & (F.col("_tf") - F.col("final_score") <= 3.5) & (F.col("best_name_similarity") >= F.greatest(F.lit(0.74), F.col("_tn") - 0.2))
    r = r.withColumn("same_type_resolver_applied", F.coalesce(wins, F.lit(False))).withColumn("same_type_resolver_adjustment", F.when(F.col("same_type_resolver_applied"), F.round(F.least(F.lit(3.0), delta), 4)).otherwise(0.0))
    r = r.withColumn("final_score", F.col("final_score") + F.col("same_type_resolver_adjustment")).withColumn("_any", F.max("same_type_resolver_applied").over(per))
    again = F.row_number().over(per.orderBy(F.desc("final_score"), F.desc("same_type_resolver_score"), F.desc("es_score"), F.desc("qid")))
    return r.withColumn("reranked_rank", F.when(F.col("_any"), again).otherwise(F.col("_o"))).drop("_o", "_g", "_k", "_tk", "_tr", "_tf", "_tn", "_b", "_any")


def decide(ranked: DataFrame, keys: list[str] = CELL, *, targets: DataFrame | None = None) -> DataFrame:
    """One row per cell: the selected candidate, confidence, margin, abstention and reasons.  With targets(keys), cells without
    any candidate get a row too: left open, with the reason no_candidates."""
    decided = _decided(ranked, keys)
    if targets is None:
        return decided
    out = targets.select(*keys).distinct().join(decided, keys, "left")
    none = F.col("abstain").isNull()
    fill = {"confidence": F.lit(0.0), "margin": F.lit(0.0), "abstain": F.lit(True), "reason_codes": F.array(F.lit("no_candidates"))}
    return out.withColumns({c: F.when(none, v).otherwise(F.col(c)) for c, v in fill.items()})


def _decided(ranked: DataFrame, keys: list[str]) -> DataFrame:
    # ranks are 1, 2 and so on: a decision compares the first two, the others needn't move
    w = Window.partitionBy(*keys).orderBy("reranked_rank")
    r = ranked.where(F.col("reranked_rank") <= 2).withColumns({"second": F.lead("final_score", 1, 0.0).over(w), "runner_up_qid": F.lead("qid").over(w), "runner_up_label": F.lead("label").over(w)}).where("reranked_rank = 1")
    c = F.col
    sim = c("best_name_similarity")
    lexical = F.when(c("label_exact"), 1.0).when(c("alias_exact"), 0.9).when(c("label_prefix"), 0.7).when(c("label_contains"), 0.45).when(sim >= 0.95, 0.92).when(sim >= 0.9, 0.84).when(sim >= 0.84, 0.74).when(sim >= 0.76, 0.58).otherwise(0.0)
    yes = lambda cond, v: F.when(cond, v).otherwise(0.0)
    unit = lambda v: F.least(F.lit(1.0), v)
    r = r.withColumns({
        "margin": c("final_score") - c("second"), "lexical": lexical, "kind": unit(yes(c("coarse_match"), 0.4) + yes(c("fine_match"), 0.4) + yes(c("item_category_match"), 0.2)),
        "context": unit(c("weighted_context_overlap") / 2.5 + c("expected_descriptor_overlap") / 4.0), "schema": unit(yes(c("schema_family_match"), 0.5) + yes(c("column_role_match"), 0.35) + c("row_template_alignment") * 0.3),
        "authority": unit(c("prior") * 1.4 + yes(c("has_wikipedia"), 0.2)), "fam": F.when(c("candidate_family") == "PRIMARY", 1.0).otherwise(0.45),
        "identity": X.clamp(c("primary_entity_score") - F.least(F.lit(0.45), c("derivative_penalty") * 0.05)), "strength": X.clamp((c("final_score") - 6.0) / 10.0),
    }).withColumn("clear", X.clamp(c("margin") / 4.0))
    weights = {"lexical": 0.24, "kind": 0.17, "context": 0.12, "schema": 0.08, "authority": 0.13, "fam": 0.11, "identity": 0.06, "strength": 0.08, "clear": 0.07}
    confidence = X.clamp(sum((c(n) * v for n, v in weights.items()), F.lit(0.0)))
    reasons = F.array_compact(F.array(
        F.when(c("lexical") >= 0.9, "strong_lexical_match").when(c("lexical") >= 0.58, "fuzzy_lexical_match"), F.when(c("kind") >= 0.8, "type_alignment"), F.when(c("context") >= 0.5, "context_alignment"),
        F.when(c("schema") >= 0.45, "schema_alignment"), F.when(c("authority") >= 0.45, "authority_signal"), F.when(c("fam") >= 0.9, "primary_family"), F.when(c("identity") >= 0.55, "primary_identity_signal"),
        F.when(c("same_type_resolver_applied"), "same_type_resolver"), F.when(c("clear") >= 0.35, "clear_margin"),
    ))
    rival = F.coalesce(X.lab_normalize("label") == X.lab_normalize("runner_up_label"), F.lit(False))
    abstain = (confidence < 0.58) | (c("final_score") < 7.5) | ~c("candidate_family").isin("PRIMARY", "DERIVATIVE_TOPIC") | ((c("margin") < 1.0) & ((c("lexical") < 0.72) | rival))
    return r.select(*keys, c("qid").alias("selected_qid"), c("label").alias("selected_label"), F.round(confidence, 4).alias("confidence"), F.round("margin", 4).alias("margin"), abstain.alias("abstain"), "candidate_family", F.round("final_score", 4).alias("top_final_score"), "runner_up_qid", "runner_up_label", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("weak_evidence"))).alias("reason_codes"))


def staged(hits: DataFrame, *, enough: int, keys: list[str] = CELL) -> DataFrame:
    """hits(keys, stage_no, qid, es_score) of all stages -> those up to the first stage with enough hits, merged by qid."""
    per_stage = hits.groupBy(*keys, "stage_no").agg(F.count("*").alias("n"))
    stop = per_stage.groupBy(*keys).agg(F.min(F.when(F.col("n") >= enough, F.col("stage_no"))).alias("stop"))
    used = hits.join(stop, keys).where(F.col("stop").isNull() | (F.col("stage_no") <= F.col("stop")))
    return used.groupBy(*keys, "qid").agg(F.max("es_score").alias("es_score"), F.array_sort(F.collect_set("stage_no")).alias("stages"))


def staged_requests(requests: DataFrame, found: DataFrame, *, enough: int, keys: list[str] = CELL) -> DataFrame:
    """staged() of requests(keys, stage_no, mention_id), unique in mention_id and stage, with what was found(mention_id, qid, es_score)
    for each: counts tell where a cell stops, so hits of later stages are never made."""
    counts = found.groupBy("mention_id").agg(F.count("*").alias("n"))
    r = requests.select(*keys, "stage_no", "mention_id").join(counts, "mention_id")
    r = r.groupBy(*keys).agg(F.collect_list(F.struct("stage_no", "mention_id", "n")).alias("l"))
    stop = F.array_min(F.transform(F.filter("l", lambda x: x["n"] >= enough), lambda x: x["stage_no"]))
    used = F.filter("l", lambda x: F.col("stop").isNull() | (x["stage_no"] <= F.col("stop")))
    u = r.withColumn("stop", stop).select(*keys, F.explode(used).alias("x")).select(*keys, "x.stage_no", "x.mention_id")
    return u.join(found, "mention_id").groupBy(*keys, "qid").agg(F.max("es_score").alias("es_score"), F.array_sort(F.collect_set("stage_no")).alias("stages"))


def diagnostics(ranked: DataFrame, gold: DataFrame, keys: list[str] = CELL, cuts=(1, 10, 25, 50, 100)) -> DataFrame:
    """gold(keys, gold_qid) -> best rank of a gold candidate per cell, recall flags."""
    there = ranked.select(*keys, F.col("qid").alias("gold_qid"), "reranked_rank", "raw_rank")
    g = gold.join(there, [*keys, "gold_qid"], "left").groupBy(*keys).agg(F.min("reranked_rank").alias("best_rank"), F.min("raw_rank").alias("best_raw_rank"))
    return g.withColumns({"in_candidates": F.col("best_rank").isNotNull(), **{f"recall_at_{k}": F.coalesce(F.col("best_rank") <= k, F.lit(False)) for k in cuts}})


MODES = {"invoked": r"^(semantic|shepherd|ranker)_", "overridden": r"_override", "confirmed": r"_confirmed$"}


def summary(decisions: DataFrame, gold: DataFrame, diag: DataFrame, by: list[str], keys: list[str] = CELL) -> DataFrame:
    """Accuracy, answered accuracy, coverage, recalls, mean ranks per group, and how often an adjudicator was asked, overrode
    and confirmed (where decisions have a resolution_mode); one aggregation."""
    right = gold.join(decisions.select(*keys, F.col("selected_qid").alias("gold_qid"), F.lit(True).alias("ok")), [*keys, "gold_qid"], "left").groupBy(*keys).agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"))
    mode = F.col("resolution_mode") if "resolution_mode" in decisions.columns else F.lit("")
    d = right.join(diag, keys).join(decisions.select(*keys, "abstain", mode.alias("mode")), keys, "left")
    answered = ~F.coalesce("abstain", F.lit(True))
    cuts = [c for c in diag.columns if c.startswith("recall_at_")]
    rate = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)
    counts = [F.count_if(F.coalesce(F.col("mode"), F.lit("")).rlike(pattern)).alias(name) for name, pattern in MODES.items()]
    ranks = [F.round(F.avg("best_rank"), 4).alias("mean_rank"), *([F.round(F.avg("best_raw_rank"), 4).alias("mean_raw_rank")] if "best_raw_rank" in diag.columns else [])]
    return d.groupBy(*by).agg(F.count("*").alias("cells"), rate(F.col("ok")).alias("accuracy"), rate(answered).alias("coverage"), F.round(F.count_if(F.col("ok") & answered) / F.nullif(F.count_if(answered), F.lit(0)), 4).alias("answered_accuracy"), *ranks, *counts, *[rate(F.col(c)).alias(c) for c in cuts])


def weighted_total(per_table: DataFrame, measures: list[str]) -> DataFrame:
    """Over tables, weighted by their cells, from values already rounded per table."""
    return per_table.agg(F.sum("cells").alias("cells"), *[F.round(F.sum(F.coalesce(m, F.lit(0.0)) * F.greatest("cells", F.lit(1))) / F.sum(F.greatest("cells", F.lit(1))), 4).alias(m) for m in measures])
