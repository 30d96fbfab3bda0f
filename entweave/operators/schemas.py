"""Schemas and table profiles that come from outside as JSON: known labels only, numbers in their range, each text once.

Items of lists may be bare strings or objects; both are read inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as X
from .typing import let

_ITEM = "struct<value:string,type:string,role:string,text:string,confidence:string,probability:string,weight:string,source:string>"


def _list(json: Column, path: str) -> Column:
    """The elements at a path as JSON text: a list's, or the single one; null counts as none."""
    none = F.array().cast("array<string>")
    elements = lambda raw: F.when(raw.isNull(), none).when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), none)).otherwise(F.array(raw))
    return let(F.get_json_object(json, path), elements)


def _parsed(x: Column) -> Column:
    """An element as the item struct; of a bare string only the value is set."""
    none = F.lit(None).cast("string")
    bare = F.struct(x.alias("value"), *[none.alias(n) for n in ("type", "role", "text", "confidence", "probability", "weight", "source")])
    return F.when(x.startswith("{"), F.from_json(x, _ITEM)).otherwise(bare)


def label(value: Column, valid: list[str], synonyms: dict[str, str]) -> Column:
    """The known label that a text stands for, else ''."""
    key = F.replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), F.lit(" "), F.lit("_"))
    known = F.coalesce(F.create_map(*[F.lit(x) for p in synonyms.items() for x in p])[key], key)
    return F.when(known.isin(valid), known).otherwise("")


def item_category(c: Column) -> Column:
    return label(c, L.ITEM_CATEGORIES, L.ITEM_SYNONYMS)


def coarse_type(c: Column) -> Column:
    return label(c, L.COARSE_TYPES, L.COARSE_SYNONYMS)


def fine_type(c: Column) -> Column:
    return label(c, L.FINE_TYPES, L.FINE_SYNONYMS)


def _first_of_each(items: Column, key: str) -> Column:
    # bound: as plain columns both would be made again for every item
    first = lambda xs, keys: F.filter(xs, lambda x, i: F.array_position(keys, x[key]) == i + 1)
    return let(items, lambda xs: let(F.transform(xs, lambda x: x[key]), lambda keys: first(xs, keys)))


def signals(json: Column, path: str, *, confidence: float = 0.7, weight: float | None = None, normal=None) -> Column:
    """array<struct<value, confidence, weight, source>> of a list of terms; an item without a value is passed over.
    normal: what turns a value into a known label, values without one go."""
    parsed = F.transform(_list(json, path), lambda x: _parsed(x))

    def one(p):
        value = F.trim(F.coalesce(F.when(F.trim(p["value"]) != "", p["value"]), p["type"], F.lit("")))
        conf = X.clamp(F.coalesce(p["confidence"], p["probability"]), default=confidence)
        heavy = X.clamp(F.coalesce(p["weight"], conf.cast("string")), default=confidence if weight is None else weight)
        if weight is not None:
            heavy = F.when(p["weight"].isNull() & p["confidence"].isNull() & p["probability"].isNull(), F.lit(weight)).otherwise(heavy)
        return F.struct(value.alias("value"), conf.alias("confidence"), heavy.alias("weight"), F.coalesce(F.when(F.trim(p["source"]) != "", p["source"]), F.lit("llm")).alias("source"))

    found = _first_of_each(F.filter(F.transform(parsed, one), lambda s: s["value"] != ""), "value")
    if normal is None:
        return found
    return F.filter(F.transform(found, lambda s: s.withField("value", normal(s["value"]))), lambda s: s["value"] != "")


def hard_filter(json: Column, fields: list[str], normal=None) -> Column:
    """Distinct values of filters with a confidence of 0.8 or more; the last of the fields that has any counts."""
    none = F.array().cast("array<string>")
    out = none
    for field in fields:
        s = F.filter(signals(json, f"$.retrieval_plan.hard_filters.{field}", confidence=1.0, weight=1.0), lambda x: x["confidence"] >= 0.8)
        values = F.array_distinct(F.filter(F.transform(s, lambda x: normal(x["value"]) if normal else F.trim(x["value"])), lambda v: v != ""))
        out = let(values, lambda v, before=out: F.when(F.size(v) > 0, v).otherwise(before))
    return out


_HYPOTHESES = "array<struct<rank:string,item_category:string,coarse_type:string,fine_type:string,confidence:string,retrieval_mode:string,source:string>>"


def hypotheses(json: Column, path: str) -> Column:
    """Hypotheses with a known coarse type; unknown item categories count as ENTITY, unknown fine types as MISC."""
    raw = F.coalesce(F.from_json(F.get_json_object(json, path), _HYPOTHESES), F.array().cast(_HYPOTHESES))
    fill = lambda c, default: F.when(c == "", default).otherwise(c)

    def one(h, i):
        return F.struct(
            F.coalesce(h["rank"].try_cast("int"), i + 1).alias("rank"), fill(item_category(h["item_category"]), "ENTITY").alias("item_category"), coarse_type(h["coarse_type"]).alias("coarse_type"), fill(fine_type(h["fine_type"]), "MISC").alias("fine_type"),
            X.clamp(h["confidence"], default=0.6).alias("confidence"), F.coalesce(F.nullif(h["retrieval_mode"], F.lit("")), F.lit("soft")).alias("retrieval_mode"), F.coalesce(h["source"], F.lit("llm")).alias("source"),
        )

    return F.filter(F.transform(raw, one), lambda h: h["coarse_type"] != "")


def variants(json: Column, path: str = "$.retrieval_plan.query_variants") -> Column:
    parsed = F.transform(_list(json, path), lambda x: _parsed(x))
    one = lambda p: F.struct(F.trim(F.coalesce(p["text"], F.when(p["type"].isNull() & p["role"].isNull(), p["value"]), F.lit(""))).alias("text"), X.clamp(p["confidence"], default=0.7).alias("confidence"), X.clamp(p["weight"], default=0.7).alias("weight"), F.coalesce(p["source"], F.lit("llm")).alias("source"))
    return _first_of_each(F.filter(F.transform(parsed, one), lambda v: v["text"] != ""), "text")


def normalised_schema(json: Column) -> Column:
    """The parts of a schema that retrieval uses, as a struct with the field names of seed_schema."""
    strength = F.lower(F.trim(F.get_json_object(json, "$.cell_hypothesis.mention_strength")))
    own = hypotheses(json, "$.cell_hypothesis.entity_hypotheses")
    own = F.transform(own, lambda h: F.struct(*[h[n].alias(n) for n in ("item_category", "coarse_type", "fine_type", "confidence", "source")]))
    unit = lambda path: X.clamp(F.get_json_object(json, path))
    return F.struct(
        F.coalesce(F.get_json_object(json, "$.cell_hypothesis.canonical_mention"), F.lit("")).alias("canonical"), own.alias("hypotheses"), F.when(strength.isin("weak", "medium", "strong"), strength).otherwise("unknown").alias("strength"),
        signals(json, "$.column_profile.coarse_type_distribution", normal=coarse_type).alias("coarse_distribution"), signals(json, "$.column_profile.fine_type_distribution", normal=fine_type).alias("fine_distribution"),
        unit("$.column_profile.confidence").alias("column_confidence"), unit("$.row_constraints.confidence").alias("row_confidence"), signals(json, "$.row_constraints.context_terms").alias("context_terms"),
        hard_filter(json, ["entity_category", "item_category"], item_category).alias("item_filters"), hard_filter(json, ["coarse_type"], coarse_type).alias("coarse_hints"), hard_filter(json, ["fine_type"], fine_type).alias("fine_hints"),
        hard_filter(json, ["crosslink_hints"]).alias("crosslinks"), signals(json, "$.retrieval_plan.soft_context_terms").alias("soft"), variants(json).alias("variants"), hypotheses(json, "$.retrieval_plan.hypothesis_plan").alias("plan"),
    )


def _roles(items: Column) -> Column:
    """array<struct<role, confidence, source>>; bare texts count 0.6, so do confidences that are no numbers."""
    one = lambda p: F.struct(F.trim(F.coalesce(F.when(F.trim(p["role"]) != "", p["role"]), p["value"], F.lit(""))).alias("role"), X.clamp(F.coalesce(p["confidence"], p["probability"]), default=0.6).alias("confidence"), F.coalesce(p["source"], F.lit("llm")).alias("source"))
    return F.filter(F.transform(F.transform(items, lambda x: _parsed(x)), one), lambda r: r["role"] != "")


def normalised_profile(json: Column) -> Column:
    """family, confidence, column_roles (column -> roles), row_template, table_hypotheses, evidence_notes, induction_mode."""
    raw_roles = F.coalesce(F.from_json(F.get_json_object(json, "$.column_roles"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    listed = lambda raw: F.when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(raw))
    by_column = F.map_filter(F.transform_values(raw_roles, lambda _, v: _roles(listed(v))), lambda _, v: F.size(v) > 0)
    template = F.get_json_object(json, "$.row_template")
    parts = F.when(template.startswith("["), F.from_json(template, "array<string>")).otherwise(F.split(template, r"\|"))
    tidy = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    notes = _list(json, "$.evidence_notes")
    text = lambda path, default: F.coalesce(F.nullif(F.get_json_object(json, path), F.lit("")), F.lit(default))
    return F.struct(
        text("$.table_semantic_family", "GENERIC_ENTITY_TABLE").alias("family"), X.clamp(F.get_json_object(json, "$.confidence")).alias("confidence"), by_column.alias("column_roles"), tidy(parts).alias("row_template"),
        _roles(_list(json, "$.table_hypotheses")).alias("table_hypotheses"), F.filter(notes, lambda n: F.trim(n) != "").alias("evidence_notes"), text("$.induction_mode", "hybrid").alias("induction_mode"),
    )
