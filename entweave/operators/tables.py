"""Table understanding: column statistics, family and roles, cell contexts, seed schemas and lookup payloads.

Tables are long: cells(table_id, row_id, col_id, value), row 0 is the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .. import lexicon as L

SAMPLE_ROWS, SAMPLES = 10, 6
GENERIC = r"^(?i)col\d+$"


def looks_date(v: Column) -> Column:
    return F.trim(v).rlike(r"^\d{4}([-/]\d{1,2}([-/]\d{1,2})?)?$")


def looks_numeric(v: Column) -> Column:
    s = F.trim(v)
    return s.rlike(r"^[0-9+\-.]") & s.rlike(r"\d") & (F.size(F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0))) <= 4)


def looks_text_blob(v: Column) -> Column:
    return (F.length(F.trim(v)) >= 60) & (F.length(F.regexp_replace(v, "[^ ]", "")) >= 8)


def _alpha_words(v: Column) -> Column:
    return F.filter(F.split(F.trim(v), r"\s+"), lambda t: t.rlike(r"\p{L}"))


def looks_entity(v: Column) -> Column:
    return ~looks_date(v) & ~looks_numeric(v) & v.rlike(r"\p{L}")


def looks_person(v: Column) -> Column:
    words = _alpha_words(v)
    capital = F.size(F.filter(words, lambda t: t.rlike(r"^\p{Lu}")))
    several = capital >= F.greatest(F.lit(2), F.size(words) - 1)
    one = F.trim(v).rlike(r"^\p{Lu}") & v.rlike(r"^[\x00-\x7f]*$")
    return ~looks_date(v) & ~looks_numeric(v) & F.when(F.size(words) >= 2, several).otherwise(one)


def looks_location(v: Column) -> Column:
    words = _alpha_words(v)
    capital = (F.size(words) > 0) & F.forall(F.slice(words, 1, 3), lambda t: t.rlike(r"^\p{Lu}"))
    return ~looks_date(v) & (X.casefold(X.normalize(v)).isin(L.COUNTRIES) | v.contains(",") | v.contains("(") | capital)


def hints_water(v: Column) -> Column:
    return X.overlap(X.alpha_tokens(v), L.WATER_HINTS) > 0


RATIOS = {"date": looks_date, "numeric": looks_numeric, "person_name": looks_person, "location_like": looks_location, "text_blob": looks_text_blob, "entity_like": looks_entity, "body_of_water": hints_water}


def column_stats(cells: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Ratios over the first rows of every column.  The row filter comes first, so what is grouped is bounded by tables."""
    head = cells.where("row_id = 0").select("table_id", "col_id", F.trim("value").alias("header"))
    data = cells.where((F.col("row_id") >= 1) & (F.col("row_id") <= sample_rows)).withColumn("v", F.trim(F.coalesce("value", F.lit(""))))
    rows = data.groupBy("table_id").agg(F.count_distinct("row_id").alias("rows"))
    full = F.col("v") != ""
    ratio = lambda flag: F.coalesce(F.round(F.count_if(full & flag) / F.nullif(F.count_if(full), F.lit(0)), 4), F.lit(0.0))
    stats = data.groupBy("table_id", "col_id").agg(
        F.count_if(full).alias("filled"),
        F.count_distinct(F.when(full, X.casefold(X.normalize("v")))).alias("distinct"),
        *[ratio(f(F.col("v"))).alias(f"{name}_ratio") for name, f in RATIOS.items()],
        F.array_sort(F.collect_list(F.when(full, F.struct("row_id", "v")))).alias("s"),
    )
    stats = stats.join(rows, "table_id").join(head, ["table_id", "col_id"], "left")
    out = stats.withColumns({
        "non_empty_ratio": F.round(F.col("filled") / F.col("rows"), 4), "unique_ratio": F.coalesce(F.round(F.col("distinct") / F.nullif("filled", F.lit(0)), 4), F.lit(0.0)),
        "samples": F.slice(F.array_distinct(F.col("s.v")), 1, SAMPLES), "column_name": F.coalesce(F.nullif("header", F.lit("")), F.concat(F.lit("col"), F.col("col_id").cast("string"))),
    })
    return out.select("table_id", "col_id", "column_name", "non_empty_ratio", "unique_ratio", *[f"{n}_ratio" for n in RATIOS], "samples").withColumn("country_like", country_like())


def country_like() -> Column:
    names = F.array_distinct(F.transform("samples", lambda v: X.casefold(X.normalize(v))))
    hits = F.size(F.filter(names, lambda v: v.isin(L.COUNTRIES)))
    enough = hits >= F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.size(names) / 2)))
    return enough | ((F.col("location_like_ratio") >= 0.85) & (F.col("unique_ratio") <= 0.8) & (F.col("person_name_ratio") < 0.3))


def families(stats: DataFrame) -> DataFrame:
    """table_id, family, confidence, and the columns that role rules ask for; one row per table."""
    n = lambda cond: F.count_if(cond)
    first = F.col("col_id") == 0
    t = stats.groupBy("table_id").agg(
        n(F.col("date_ratio") >= 0.65).alias("dates"),
        n((F.col("location_like_ratio") >= 0.65) & (F.col("numeric_ratio") < 0.45)).alias("places"),
        n((F.col("numeric_ratio") >= 0.7) & (F.col("date_ratio") < 0.4)).alias("measures"),
        n(F.col("text_blob_ratio") >= 0.4).alias("blobs"),
        F.bool_or(first & (F.col("entity_like_ratio") >= 0.85) & (F.col("numeric_ratio") < 0.2)).alias("named"),
        F.bool_or(first & (F.col("person_name_ratio") >= 0.45)).alias("people"),
        F.bool_or(first & (F.col("body_of_water_ratio") >= 0.3)).alias("water"),
        F.min(F.when(F.col("date_ratio") >= 0.65, F.col("col_id"))).alias("date_col"),
    )
    rules = [
        (F.expr("named and dates > 0 and places >= 2"), "BIOGRAPHY", F.least(F.lit(0.92), 0.78 + F.when(F.col("people"), 0.08).otherwise(0.0))),
        (F.expr("water and measures >= 2"), "GEOGRAPHY", F.lit(0.84)),
        (F.expr("measures > 0 and blobs > 0 and places > 0"), "GEOGRAPHY", F.lit(0.68)),
        (F.expr("people and dates > 0"), "BIOGRAPHY", F.lit(0.64)),
    ]
    family, confidence = F.lit("GENERIC_ENTITY_TABLE"), F.lit(0.45)
    for cond, name, value in reversed(rules):
        family, confidence = F.when(cond, name).otherwise(family), F.when(cond, value).otherwise(confidence)
    return t.select("table_id", "date_col", family.alias("family"), F.round(confidence, 4).alias("confidence"))


#: unit -> measure, in the order of the tests; a bare m is in nearly every text
_UNITS = [("km2", "AREA_MEASURE"), ("sq", "AREA_MEASURE"), ("km3", "VOLUME_MEASURE"), ("cu", "VOLUME_MEASURE"), ("ft", "DEPTH_MEASURE"), ("m", "DEPTH_MEASURE"), ("length", "LENGTH_MEASURE")]


def roles(stats: DataFrame) -> DataFrame:
    """table_id, col_id, family, confidence, role, role_confidence: the best role of every column."""
    s = stats.join(families(stats), "table_id")
    per = Window.partitionBy("table_id")
    plain = (F.col("numeric_ratio") < 0.25) & ~F.col("country_like")
    name_rule = (F.col("numeric_ratio") < 0.2) & (F.col("date_ratio") < 0.2) & (F.col("entity_like_ratio") >= 0.75) & (F.col("date_col").isNull() | (F.col("col_id") < F.col("date_col")))
    level = F.when(plain & (F.col("text_blob_ratio") < 0.35), 2).when(plain, 1).otherwise(0)
    s = s.withColumns({"name_col": F.coalesce(F.min(F.when(name_rule, F.col("col_id"))).over(per), F.lit(0)), "level": level})
    s = s.withColumn("top", F.max("level").over(per))
    key = F.struct(F.col("body_of_water_ratio"), (F.col("entity_like_ratio") - F.col("numeric_ratio") - F.col("text_blob_ratio")), -F.col("col_id"))
    s = s.withColumn("feature_col", F.max_by("col_id", F.when(F.col("level") == F.col("top"), key)).over(per))
    r = lambda role, conf: F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), (F.lit(conf) if isinstance(conf, float) else conf).alias("role_confidence"))
    number, text = r("NUMERIC_ATTRIBUTE", 0.6), r("TEXT_ATTRIBUTE", 0.45)
    comma = F.exists("samples", lambda v: v.contains(",") | v.contains("("))
    biography = (
        F.when((F.col("col_id") == F.col("name_col")) & (F.col("entity_like_ratio") >= 0.75), r("PERSON_NAME_OR_ALIAS", F.when(F.col("person_name_ratio") >= 0.5, 0.9).otherwise(0.82)))
        .when(F.col("col_id") == F.col("date_col"), r("BIRTH_DATE", 0.94))
        .when(F.col("country_like"), r("COUNTRY", 0.86))
        .when(F.col("location_like_ratio") >= 0.7, r(F.when(comma, "BIRTH_REGION").otherwise("BIRTH_CITY"), 0.78))
        .when(F.col("numeric_ratio") >= 0.6, number).otherwise(text)
    )
    joined = X.casefold(F.array_join("samples", " "))
    measure = F.lit("NUMERIC_MEASURE")
    for unit, name in reversed(_UNITS):
        measure = F.when(joined.contains(unit), name).otherwise(measure)
    water = (F.col("body_of_water_ratio") >= 0.2) | F.exists("samples", hints_water)
    geography = (
        F.when((F.col("col_id") == F.col("feature_col")) & (F.col("entity_like_ratio") >= 0.75) & (F.col("numeric_ratio") < 0.25), r(F.when(water, "BODY_OF_WATER_NAME").otherwise("GEOGRAPHIC_FEATURE_NAME"), 0.88))
        .when(F.col("country_like"), r("COUNTRY", 0.82))
        .when(F.col("numeric_ratio") >= 0.7, r(measure, 0.74))
        .when(F.col("text_blob_ratio") >= 0.4, r("DESCRIPTION_TEXT", 0.84)).otherwise(text)
    )
    generic = r("UNKNOWN", 0.3)
    s = s.withColumn("r", F.when(F.col("family") == "BIOGRAPHY", biography).when(F.col("family") == "GEOGRAPHY", geography).otherwise(generic))
    return s.select("table_id", "col_id", "family", "confidence", "r.role", "r.role_confidence")


def cell_contexts(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(table_id, row_id, col_id) -> mention, column_name, row_values, other_row_values, column_samples, mention_context.

    A row's cells are few; of a column only its first distinct values are kept, so no list grows with the table."""
    v = cells.where("row_id > 0").select("table_id", "row_id", "col_id", F.trim(F.coalesce("value", F.lit(""))).alias("v"))
    wanted = targets.select("table_id", "row_id", "col_id").distinct()
    rows = v.join(wanted.select("table_id", "row_id").distinct(), ["table_id", "row_id"], "left_semi")
    rows = rows.groupBy("table_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "v"))).alias("row"))
    first = v.where("v <> ''").groupBy("table_id", "col_id", "v").agg(F.min("row_id").alias("at"))
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("table_id", "col_id").orderBy("at"))).where("r <= 6")
    samples = top.groupBy("table_id", "col_id").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s"))
    head = cells.where("row_id = 0").select("table_id", "col_id", F.trim("value").alias("column_name"))
    heads = head.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", F.coalesce("column_name", F.lit(""))))).alias("header"))
    c = wanted.join(heads, "table_id", "left").join(rows, ["table_id", "row_id"]).join(samples, ["table_id", "col_id"], "left").join(head, ["table_id", "col_id"], "left")
    col = F.col("col_id")
    mention = F.get(F.transform(F.filter("row", lambda x: x["col_id"] == col), lambda x: x["v"]), F.lit(0))
    c = c.withColumn("mention", mention)
    others = F.transform(F.filter("row", lambda x: (x["col_id"] != col) & (x["v"] != "")), lambda x: x["v"])
    near = F.slice(F.filter(F.coalesce(F.col("s.v"), F.array().cast("array<string>")), lambda x: x != F.col("mention")), 1, 5)
    c = c.withColumns({"row_values": F.col("row.v"), "other_row_values": others, "column_samples": near})
    c = c.withColumn("related_cells", related_cells())
    return c.select("table_id", "row_id", "col_id", "column_name", "mention", "related_cells", "row_values", "other_row_values", "column_samples", F.array_distinct(F.concat("other_row_values", "column_samples")).alias("mention_context"))


def related_cells() -> Column:
    """The other cells of the row that aren't blank, with the names of their columns."""
    others = F.filter("row", lambda x: (x["col_id"] != F.col("col_id")) & (x["v"] != ""))
    name = lambda i: F.coalesce(F.col("header")[i], F.concat(F.lit("col"), i.cast("string")))
    return F.transform(others, lambda x: F.struct(name(x["col_id"]).alias("column_name"), x["v"].alias("cell_value"), F.lit("same_row_context").alias("relation"), F.lit(0.6).alias("confidence")))


def mention_strength(mention: Column) -> Column:
    """struct(strength, reasons)."""
    n = X.mention_surface(mention)
    words = F.size(F.filter(F.split(n, " "), lambda t: t != ""))
    reasons = F.array_compact(F.array(
        F.when(words <= 1, "single_token"), F.when(F.length(n) <= 10, "short_surface"),
        F.when((words == 1) & n.rlike(r"^\p{Lu}\p{L}*$"), "capitalized_common_word_shape"), F.when(X.casefold(n).isin(L.POLYSEMOUS), "known_polysemous_surface"),
    ))
    strength = F.when(F.size(reasons) == 0, "strong").when((words >= 2) & ~F.array_contains(reasons, "known_polysemous_surface"), "medium").otherwise("weak")
    return F.struct(strength.alias("strength"), reasons.alias("reasons"))


def soft_terms() -> Column:
    """Context terms with weights, the first of equal texts counts: real header, other cells of the row, column samples."""
    t = lambda v, c, w, s: F.struct(F.trim(v).alias("value"), c.alias("confidence"), w.alias("weight"), F.lit(s).alias("source"))
    number = lambda v: v.rlike(r"\d")
    row = F.transform("other_row_values", lambda v: t(v, F.when(number(v), 0.45).otherwise(0.7), F.when(number(v), 0.25).otherwise(0.65), "row"))
    column = F.transform("column_samples", lambda v: t(v, F.lit(0.6), F.lit(0.5), "column"))
    real = (F.coalesce("column_name", F.lit("")) != "") & ~F.coalesce("column_name", F.lit("")).rlike(GENERIC)
    header = F.when(real, F.array(t(F.col("column_name"), F.lit(0.9), F.lit(0.75), "column")))
    both = F.concat(F.coalesce(header, F.slice(column, 1, 0)), row, column)
    values = F.transform(both, lambda x: x["value"])
    return F.filter(both, lambda x, i: (x["value"] != "") & (F.array_position(values, x["value"]) == i + 1))


def hypotheses(family: Column, role: Column, strength: Column, mention: Column) -> Column:
    h = lambda coarse, fine, conf, source: F.struct(F.lit("ENTITY").alias("item_category"), F.lit(coarse).alias("coarse_type"), F.lit(fine).alias("fine_type"), (F.lit(conf) if isinstance(conf, float) else conf).alias("confidence"), F.lit(source).alias("source"))
    person = F.array(h("PERSON", "HUMAN", F.when(strength != "weak", 0.9).otherwise(0.84), "table_profile"), h("WORK", "FILM", 0.28, "fallback"), h("LOCATION", "CITY", 0.24, "fallback"))
    place = F.array(h("LOCATION", "LANDMARK", 0.9, "table_profile"), h("WORK", "MUSIC_WORK", 0.18, "fallback"))
    several = F.array(h("PERSON", "HUMAN", 0.62, "surface"), h("ORGANIZATION", "COMPANY", 0.22, "fallback"))
    single = F.array(h("MISC", "MISC", 0.42, "surface"), h("PERSON", "HUMAN", 0.38, "fallback"), h("LOCATION", "CITY", 0.32, "fallback"))
    words = F.size(F.filter(F.split(X.mention_surface(mention), " "), lambda t: t != ""))
    return F.when((family == "BIOGRAPHY") & (role == "PERSON_NAME_OR_ALIAS"), person).when((family == "GEOGRAPHY") & role.isin("BODY_OF_WATER_NAME", "GEOGRAPHIC_FEATURE_NAME"), place).when(words >= 2, several).otherwise(single)


def uncertainty(confidence: Column, role: Column, role_confidence: Column, strength: Column) -> Column:
    return F.array_compact(F.array(
        F.when((confidence < 0.72) & (role_confidence < 0.86), "low_table_confidence"), F.when(role.isin("", "UNKNOWN"), "unknown_column_role"), F.when(role_confidence < 0.72, "low_role_confidence"),
        F.when((role == "PERSON_NAME_OR_ALIAS") & (role_confidence - 0.35 < 0.15), "ambiguous_column_role"),
        F.when(strength.isin("medium", "strong") & ((confidence < 0.8) | (role_confidence < 0.8)), "surface_form_resists_uncertain_schema"),
    ))


def _variant(text: Column, confidence, weight, source: str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, float) else v
    return F.struct(text.alias("text"), lit(confidence).alias("confidence"), lit(weight).alias("weight"), F.lit(source).alias("source"))


def query_variants() -> Column:
    """The cleaned mention, the mention as it is, the cleaned one without dots; each text once, later ones weigh less."""
    surface, mention = X.mention_surface("mention"), F.trim("mention")
    texts = F.array_distinct(F.filter(F.transform(F.array(surface, mention, F.replace(surface, F.lit("."), F.lit(""))), lambda t: F.trim(t)), lambda t: t != ""))

    def one(t, i):
        own = t == mention
        return _variant(t, F.when(i == 0, 1.0).when(own, 0.8).otherwise(0.7), F.when(i == 0, 1.0).when(own, 0.7).otherwise(F.round(F.greatest(F.lit(0.45), 0.7 - i * 0.1), 4)), "seed")

    return F.transform(texts, one)


def hypothesis_plan(hypotheses: Column) -> Column:
    """Hypotheses in their order: the first filters, the others only guide."""
    return F.transform(hypotheses, lambda h, i: F.struct((i + 1).cast("int").alias("rank"), h["item_category"].alias("item_category"), h["coarse_type"].alias("coarse_type"), h["fine_type"].alias("fine_type"), h["confidence"].alias("confidence"), F.when(i == 0, "hard").otherwise("soft").alias("retrieval_mode"), h["source"].alias("source")))


BACKOFF = ["primary", "relax_fine_type", "alternate_hypothesis", "no_type_context_only", "item_category_only"]


def seed_schema(contexts: DataFrame, roles_: DataFrame) -> DataFrame:
    """One schema per cell: hypotheses, uncertainty, hard filters, weighted context terms, query variants, plans."""
    c = contexts.join(roles_, ["table_id", "col_id"], "left").na.fill({"family": "GENERIC_ENTITY_TABLE", "confidence": 0.0, "role": "UNKNOWN", "role_confidence": 0.0})
    c = c.withColumn("m", mention_strength(F.col("mention"))).withColumns({"strength": F.col("m.strength"), "weakness": F.col("m.reasons"), "canonical": F.coalesce(F.nullif(X.mention_surface("mention"), F.lit("")), F.trim("mention"))})
    c = c.withColumns({"hypotheses": hypotheses(F.col("family"), F.col("role"), F.col("strength"), F.col("mention")), "uncertain": uncertainty(F.col("confidence"), F.col("role"), F.col("role_confidence"), F.col("strength")), "soft": soft_terms()})
    top = F.col("hypotheses")[0]
    forced = (F.col("role") == "BODY_OF_WATER_NAME") & (top["coarse_type"] == "LOCATION") & (top["fine_type"] == "LANDMARK")
    skipped = ((F.col("strength") == "weak") & (F.col("confidence") < 0.8)) | ((top["confidence"] < 0.82) & (F.col("confidence") < 0.78))
    some = forced | ~skipped
    typed = some & (F.size("uncertain") == 0)
    none = F.array().cast("array<string>")
    c = c.withColumns({
        "item_filters": F.when(some, F.array(top["item_category"])).otherwise(none),
        "coarse_hints": F.when(typed, F.array(top["coarse_type"])).otherwise(none),
        "fine_hints": F.when(typed, F.array(top["fine_type"])).otherwise(none),
        "variants": query_variants(), "plan": hypothesis_plan(F.col("hypotheses")), "backoff": X.words_array(BACKOFF),
        "numeric_hints": F.array_distinct(F.filter("other_row_values", lambda v: v.rlike(r"\d"))),
        "temporal_hints": F.array_distinct(F.filter("other_row_values", lambda v: v.rlike(r"\b\d{4}([-/]\d{1,2}([-/]\d{1,2})?)?\b"))),
    })
    return c.drop("m")


_WATERS = ["bay", "gulf", "lake", "ocean", "river", "sea", "strait"]


def water_policy(schema: DataFrame) -> DataFrame:
    """Names of waters: forced to landmarks, asked for as a lake first, with three more context terms."""
    water = F.col("role") == "BODY_OF_WATER_NAME"
    landmark = lambda h: (h["coarse_type"] == "LOCATION") & (h["fine_type"] == "LANDMARK")
    first = F.struct(F.lit("ENTITY").alias("item_category"), F.lit("LOCATION").alias("coarse_type"), F.lit("LANDMARK").alias("fine_type"), F.lit(0.92).alias("confidence"), F.lit("table_profile_policy").alias("source"))
    hypotheses_ = F.slice(F.concat(F.array(first), F.filter("hypotheses", lambda h: ~landmark(h))), 1, 3)
    canonical = F.col("canonical")
    lake = F.concat(F.lit("Lake "), canonical)
    named = F.arrays_overlap(F.split(F.lower(canonical), r"\s+"), X.words_array(_WATERS)) | (canonical == "")
    known = F.exists("variants", lambda v: X.casefold(v["text"]) == X.casefold(lake))
    variants = F.when(named | known, F.col("variants")).otherwise(F.concat(F.array(_variant(lake, 0.92, 0.96, "table_profile_policy")), F.col("variants")))
    said = F.transform("soft", lambda s: X.casefold(s["value"]))
    terms = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(0.9).alias("confidence"), F.lit(w).alias("weight"), F.lit("table_profile_policy").alias("source")) for v, w in {"lake": 0.85, "body of water": 0.75, "freshwater lake": 0.7}.items()])
    soft = F.concat("soft", F.filter(terms, lambda t: ~F.array_contains(said, t["value"])))
    forced = {"item_filters": ["ENTITY"], "coarse_hints": ["LOCATION"], "fine_hints": ["LANDMARK"]}
    changed = {"hypotheses": hypotheses_, "variants": variants, "soft": soft, "plan": hypothesis_plan(F.array(first)), **{k: X.words_array(v) for k, v in forced.items()}}
    return schema.withColumns({k: F.when(water, v).otherwise(F.col(k)) for k, v in changed.items()})


def uncertainty_policy(schema: DataFrame) -> DataFrame:
    """Where the schema is uncertain types guide and don't filter; the item category stays if there was any filter."""
    unsure = F.size("uncertain") > 0
    none = F.array().cast("array<string>")
    any_filter = F.size(F.concat("item_filters", "coarse_hints", "fine_hints")) > 0
    item = F.when(any_filter & (F.size("item_filters") == 0), X.words_array(["ENTITY"])).otherwise(F.col("item_filters"))
    soft_plan = F.transform("plan", lambda h: h.withField("retrieval_mode", F.lit("soft")))
    changed = {"item_filters": item, "coarse_hints": none, "fine_hints": none, "plan": soft_plan}
    return schema.withColumns({k: F.when(unsure, v).otherwise(F.col(k)) for k, v in changed.items()})


def finished(schema: DataFrame) -> DataFrame:
    return uncertainty_policy(water_policy(schema))


def payload(schema: DataFrame, *, max_terms: int = 12) -> DataFrame:
    """The heaviest variant (the first of equals) as the mention, the heaviest context terms (at least 0.3, twelve at most)."""
    best = F.array_max(F.transform("variants", lambda v, i: F.struct(v["weight"].alias("w"), (-i).alias("i"), v["text"].alias("t"))))["t"]
    order = F.slice(F.array_sort(F.transform("soft", lambda x, i: F.struct((-x["weight"]).alias("w"), i.alias("i"), x["value"].alias("v")))), 1, max_terms)
    terms = F.array_distinct(F.transform(F.filter(order, lambda x: x["w"] <= -0.3), lambda x: x["v"]))
    return schema.withColumns({"lookup_mention": F.coalesce(best, F.col("canonical")), "lookup_context": F.when(F.size(terms) > 0, terms).otherwise(F.col("mention_context"))})


def payload_stages(schema: DataFrame, *, max_variants: int = 5) -> DataFrame:
    """The requests of every cell, one row each, in the order in which they are tried: primary, each hypothesis with and
    without its fine type, without types, by item category.  A request whose filters an earlier one had is dropped."""
    none = F.array().cast("array<string>")
    stage = lambda name, rank, relaxed, item, coarse, fine: F.struct(name.alias("stage"), rank.cast("int").alias("hypothesis_rank"), relaxed.alias("relaxed"), item.alias("item"), coarse.alias("coarse"), fine.alias("fine"))
    own = F.col("item_filters")
    primary = F.array(stage(F.lit("primary"), F.lit(1), F.lit(False), own, F.col("coarse_hints"), F.col("fine_hints")))

    def both(h):
        name = F.concat(F.lit("hypothesis_"), h["rank"].cast("string"))
        fine = F.when(h["fine_type"].isin("", "MISC"), none).otherwise(F.array(h["fine_type"]))
        item, coarse = F.array(h["item_category"]), F.array(h["coarse_type"])
        return F.array(stage(name, h["rank"], h["retrieval_mode"] != "hard", item, coarse, fine), stage(F.concat(name, F.lit("_relax_fine")), h["rank"], F.lit(True), item, coarse, none))

    null = F.lit(None)
    open_ = F.when((F.col("strength") == "weak") | F.col("family").isin("BIOGRAPHY", "GENERIC_ENTITY_TABLE"), F.array(stage(F.lit("no_type_context_only"), null, F.lit(True), own, none, none)))
    by_item = F.when(F.size("item_filters") > 0, F.array(stage(F.lit("item_category_only"), null, F.lit(True), own, none, none)))
    parts = F.concat(primary, F.flatten(F.transform(F.slice("plan", 1, max_variants), both)), F.coalesce(open_, F.slice(primary, 1, 0)), F.coalesce(by_item, F.slice(primary, 1, 0)))
    s = schema.withColumn("_s", parts)
    s = s.withColumn("_g", F.transform("_s", lambda x: F.concat_ws("|", F.concat_ws(",", x["item"]), F.concat_ws(",", x["coarse"]), F.concat_ws(",", x["fine"]))))
    kept = F.filter("_s", lambda x, i: F.array_position(F.col("_g"), F.get("_g", i)) == i + 1)
    return s.select("table_id", "row_id", "col_id", F.posexplode(kept).alias("stage_no", "s")).select("table_id", "row_id", "col_id", (F.col("stage_no") + 1).alias("stage_no"), "s.*")
