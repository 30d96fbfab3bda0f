"""Entity dumps: JSON documents one to a line, into typed entity rows and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import normalize, prior
from ..operators.typing import let, typed

RAW = {
    "id": "string", "type": "string", "labels": "map<string,struct<value:string>>", "descriptions": "map<string,struct<value:string>>",
    "aliases": "map<string,array<struct<value:string>>>", "claims": "map<string,array<struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:string>>>>>",
    "sitelinks": "map<string,struct<title:string>>",
}
NO_TEXT = "map<string,string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plain, gzip or bzip2 by suffix."""
    return spark.read.text(path)


def cleaned_line(value) -> Column:
    """A dump line without its trailing comma; null for blank lines and array brackets."""

    def body(t):
        # the pattern looks at every comma of a line, so it is kept for lines that end otherwise
        bare = F.when(t.endswith(","), F.left(t, F.length(t) - 1)).when(F.right(t, F.lit(1)).rlike("[\r\x85\u2028\u2029]"), F.regexp_replace(t, r",$", "")).otherwise(t)
        return let(F.trim(bare), lambda v: F.when(~t.isin("", "[", "]") & (v != ""), v))

    return let(F.trim(value), body)


def _not_json(numbered: bool) -> Column:
    where = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file"), F.lit(": ")) if numbered else F.lit("")
    return F.raise_error(F.concat(F.lit("no JSON: "), where, F.substring("v", 1, 200)))


def parse(lines: DataFrame, *, strict: bool = True, limit: int | None = None, fields: list[str] | None = None) -> DataFrame:
    """lines(value, and file and line_no if numbered) -> raw entities.  Blank lines and array brackets are passed over, trailing
    commas cut, non-objects skipped; with strict, a line that is no JSON ends the job with its number and text in the
    message.  limit counts objects in the order of numbered lines.  fields: those of RAW that are wanted beside the id."""
    numbered = {"file", "line_no"} <= set(lines.columns)
    order = ["file", "line_no"] if numbered else []
    names = [n for n in RAW if fields is None or n == "id" or n in fields]
    body = lines.select(*order, cleaned_line(F.col("value")).alias("v"))
    is_object, broken = F.col("v").startswith("{"), F.expr("try_parse_json(v)").isNull()
    if limit is not None:
        if strict:
            body = body.where("v is not null").select(*order, F.when(broken, _not_json(numbered).cast("string")).otherwise(F.col("v")).alias("v"))
        body = body.where(is_object).orderBy(*order).limit(limit)
    # a line is read once: a filter would be pushed below a plain column and read it again, below a generated one it isn't.
    # What is no JSON leaves its text in _bad, as do objects of other types, so only such lines are parsed to tell
    schema = ", ".join(f"{n} {RAW[n]}" for n in names) + ", _bad string"
    raw = body.select(*order, "v", F.inline(F.array(F.from_json("v", schema, {"columnNameOfCorruptRecord": "_bad"}))))
    wanted = F.coalesce(is_object & F.col("id").rlike("^[QP]"), F.lit(False))
    if strict and limit is None:
        suspect = F.col("v").isNotNull() & (~is_object | F.col("_bad").isNotNull())
        wanted = F.when(suspect, F.when(broken, _not_json(numbered).cast("boolean")).otherwise(wanted)).otherwise(wanted)
    return raw.where(wanted).select(*order, *names)


def value_map(c) -> Column:
    """language -> normalised text, empty ones dropped."""
    values = F.transform_values(F.coalesce(c, F.create_map().cast("map<string,struct<value:string>>")), lambda _, v: F.coalesce(normalize(v["value"]), F.lit("")))
    return F.map_filter(values, lambda _, v: v != "")


def alias_map(aliases, labels: Column) -> Column:
    """language -> distinct aliases in order that are no label of any language."""
    given = F.coalesce(aliases, F.create_map().cast("map<string,array<struct<value:string>>>"))
    tidy = lambda v: F.filter(F.transform(v, lambda x: F.coalesce(normalize(x["value"]), F.lit(""))), lambda x: x != "")
    cleaned = let(F.map_values(labels), lambda texts: F.transform_values(given, lambda _, v: F.array_except(tidy(v), texts)))
    return F.map_filter(cleaned, lambda _, v: F.size(v) > 0)


def pick_languages(m: Column, languages: list[str], *, fallback: bool = True) -> Column:
    """The allow-listed languages; if there are none, the alphabetically first."""
    chosen = lambda x: F.map_filter(x, lambda k, _: k.isin(languages))
    if not fallback:
        return chosen(m)
    first = lambda x: let(F.array_min(F.map_keys(x)), lambda name: F.map_filter(x, lambda k, _: k == name))
    return let(m, lambda x: let(chosen(x), lambda some: F.when(F.size(some) > 0, some).otherwise(first(x))))


def pick_alias_languages(m: Column, languages: list[str], cap: int, *, fallback: bool = False) -> Column:
    """Of the allow-listed languages the first `cap` distinct aliases each; if there are none, with fallback, those of the
    alphabetically first language that has any."""
    if cap <= 0:
        return F.map_filter(m, lambda k, v: F.lit(False))
    tidy = F.transform_values(m, lambda _, v: F.slice(F.array_distinct(F.filter(F.transform(v, lambda x: F.coalesce(normalize(x), F.lit(""))), lambda x: x != "")), 1, cap))
    return pick_languages(F.map_filter(tidy, lambda _, v: F.size(v) > 0), languages, fallback=fallback)


def primary_label(labels: Column) -> Column:
    return let(labels, lambda m: F.coalesce(m["en"], m["mul"], F.element_at(m, F.array_min(F.map_keys(m)))))


def label_in(labels: Column, language: str) -> Column:
    """The label in a language, else the primary one."""
    return let(labels, lambda m: F.coalesce(m[language], primary_label(m)))


def _by_language(m: Column) -> Column:
    """Entries in the order en, mul, then by name."""
    order = lambda k: F.when(k == "en", 0).when(k == "mul", 1).otherwise(2)
    return F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(order(e["key"]).alias("o"), e["key"].alias("k"), e["value"].alias("v")))), lambda e: e["v"])


def flat_labels(labels: Column, cap: int = 64) -> Column:
    return F.slice(F.array_distinct(_by_language(labels)), 1, cap)


def flat_aliases(aliases: Column, labels: Column, cap: int = 128) -> Column:
    return F.slice(F.array_except(F.flatten(_by_language(aliases)), F.map_values(labels)), 1, cap)


def statement_object(s: Column) -> Column:
    """Id of a statement's entity value; null for other values."""
    v = s["mainsnak"]["datavalue"]["value"]

    def by_number(x):
        return F.when(x["n"] > 0, F.when(x["kind"] == "item", F.concat(F.lit("Q"), x["n"].cast("string"))).when(x["kind"] == "property", F.concat(F.lit("P"), x["n"].cast("string"))))

    numbered = let(F.struct(F.get_json_object(v, "$.numeric-id").try_cast("bigint").alias("n"), F.get_json_object(v, "$.entity-type").alias("kind")), by_number)
    direct = let(F.trim(F.get_json_object(v, "$.id")), lambda x: F.when(x.rlike("^[QP]"), x))
    return F.when(s["mainsnak"]["snaktype"] == "value", F.coalesce(direct, numbered))


def claim_ids(claims: Column, prop: str, limit: int) -> Column:
    ids = F.transform(F.coalesce(claims[prop], F.array()), statement_object)
    return F.slice(F.array_distinct(F.array_compact(ids)), 1, limit)


def all_claim_ids(claims: Column, limit: int = 32) -> Column:
    """Object ids of all claims in document order, each once."""
    ids = F.flatten(F.transform(F.map_entries(claims), lambda e: F.transform(e["value"], statement_object)))
    return F.slice(F.array_distinct(F.array_compact(ids)), 1, limit)


def item_category(entity_id: Column, kind: Column, claims: Column) -> Column:
    p31 = claim_ids(claims, "P31", 32)
    some = lambda ids: F.arrays_overlap(p31, F.array(*[F.lit(x) for x in ids]))
    return (
        F.when(F.coalesce(entity_id, F.lit("")) == "", "OTHER")
        .when(entity_id.startswith("P") | (kind == "property"), "PREDICATE")
        .when(kind.isin("lexeme", "form", "sense", "mediainfo"), F.upper(kind))
        .when(~entity_id.startswith("Q"), "OTHER")
        .when(some(L.DISAMBIGUATION_TYPES), "DISAMBIGUATION")
        .when(F.size(F.coalesce(claims["P279"], F.array())) > 0, "TYPE")
        .when(some(L.CLASS_TYPES), "TYPE")
        .otherwise("ENTITY")
    )


def wikipedia_site(sitelinks: Column, labels: Column) -> Column:
    """struct(site, title): English, else the label's language, else the first by name."""
    usable = F.map_filter(sitelinks, lambda k, v: k.endswith("wiki") & ~k.isin(L.NO_ARTICLE_SITES) & (F.trim(F.coalesce(v["title"], F.lit(""))) != ""))
    language = F.when(labels["en"].isNotNull(), "en").otherwise(F.array_min(F.map_keys(F.map_filter(labels, lambda k, _: k != "mul"))))
    own = F.concat(F.replace(language, F.lit("-"), F.lit("_")), F.lit("wiki"))
    has = lambda names, k: F.when(F.array_contains(names, k), k)
    site = lambda names: F.coalesce(has(names, F.lit("enwiki")), has(names, own), F.array_min(names))
    chosen = lambda m: let(site(F.map_keys(m)), lambda x: F.struct(x.alias("site"), F.trim(m[x]["title"]).alias("title")))
    return let(usable, chosen)


def _quoted(title: Column, keep: dict[str, str]) -> Column:
    """Percent-encoding of a path from Spark's form encoding."""
    s = F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    s = F.replace(s, F.lit("%7E"), F.lit("~"))
    for code, sign in keep.items():
        s = F.replace(s, F.lit(code), F.lit(sign))
    return s


def wikipedia_url(site: Column) -> Column:
    host = F.replace(F.regexp_replace(site["site"], "wiki$", ""), F.lit("_"), F.lit("-"))
    path = _quoted(site["title"], {"%28": "(", "%29": ")", "%27": "'", "%21": "!", "%2C": ","})
    return F.when(site["site"].isNotNull(), F.concat(F.lit("https://"), host, F.lit(".wikipedia.org/wiki/"), path))


def dbpedia_url(site: Column) -> Column:
    lang = F.lower(F.replace(F.regexp_replace(site["site"], "wiki$", ""), F.lit("_"), F.lit("-")))
    host = F.when(lang == "en", "http://dbpedia.org").otherwise(F.concat(F.lit("http://"), lang, F.lit(".dbpedia.org")))
    path = F.replace(_quoted(site["title"], {"%2F": "/"}), F.lit("*"), F.lit("%2A"))
    return F.when(site["site"].isNotNull(), F.concat(host, F.lit("/resource/"), path))


def compact_ref(url: Column) -> Column:
    """The usual prefixes dropped, other hosts as host|title, anything else as it is."""
    title = F.regexp_extract(F.parse_url(url, F.lit("PATH")), "^/(?:wiki|resource)/(.+)$", 1)
    host = F.parse_url(url, F.lit("HOST"))
    known = host.rlike(r"\.wikipedia\.org$|(^|\.)dbpedia\.org$") & (title != "")
    prefix = "https://en.wikipedia.org/wiki/"
    db = "http://dbpedia.org/resource/"
    return F.when(url.startswith(prefix), F.substring(url, F.lit(len(prefix) + 1), F.length(url))).when(url.startswith(db), F.substring(url, F.lit(len(db) + 1), F.length(url))).when(known, F.concat(host, F.lit("|"), title)).otherwise(url)


def expand_ref(ref: Column, kind: str) -> Column:
    """The inverse, for kind wikipedia or dbpedia."""
    scheme, path, default = ("https://", "/wiki/", "https://en.wikipedia.org/wiki/") if kind == "wikipedia" else ("http://", "/resource/", "http://dbpedia.org/resource/")
    parts = F.split(ref, r"\|", 2)
    return (
        F.when(F.coalesce(ref, F.lit("")) == "", F.lit(""))
        .when(ref.rlike("^https?://"), ref)
        .when(ref.contains("|"), F.concat(F.lit(scheme), parts[0], F.lit(path), parts[1]))
        .when(ref.startswith("/wiki/"), F.concat(F.lit("https://en.wikipedia.org"), ref))
        .otherwise(F.concat(F.lit(default), ref))
    )


def records(raw: DataFrame) -> DataFrame:
    """Entity rows; entities without a label are skipped."""
    labels = value_map(F.col("labels"))
    base = raw.select("id", "type", labels.alias("l"), value_map(F.col("descriptions")).alias("d"), alias_map(F.col("aliases"), labels).alias("a"), F.coalesce("claims", F.create_map().cast("map<string,array<struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:string>>>>>")).alias("claims"), F.coalesce("sitelinks", F.create_map().cast("map<string,struct<title:string>>")).alias("sitelinks"))
    l, d, a, claims = (F.col(c) for c in ("l", "d", "a", "claims"))
    p31 = claim_ids(claims, "P31", 32)
    english = l["en"].isNotNull() | d["en"].isNotNull() | a["en"].isNotNull()
    texts = F.when(english, F.concat(F.array(d["en"], l["en"]), F.coalesce(a["en"], F.array().cast("array<string>")))).otherwise(F.concat(_sorted_values(d), _sorted_values(l), F.flatten(_sorted_values(a))))
    base = base.withColumns({"p31": p31, "t": typed(F.col("id"), p31, F.array_compact(texts)), "site": wikipedia_site(F.col("sitelinks"), l), "popularity": F.size("sitelinks").cast("double")})
    types = F.when(F.array_contains("p31", "Q5"), F.array_distinct(F.concat("p31", claim_ids(claims, "P106", 32)))).otherwise(F.col("p31"))
    out = base.select(
        F.col("id").alias("qid"), primary_label(l).alias("label"), flat_labels(l).alias("labels"), flat_aliases(a, l).alias("aliases"), d["en"].alias("description"), types.alias("types"),
        F.col("t.coarse")[0].alias("coarse_type"), F.col("t.fine")[0].alias("fine_type"), item_category(F.col("id"), F.col("type"), claims).alias("item_category"), "popularity", prior("popularity").alias("prior"),
        wikipedia_url(F.col("site")).alias("wikipedia_url"), dbpedia_url(F.col("site")).alias("dbpedia_url"),
    )
    return out.where(F.coalesce("label", F.lit("")) != "")


def _sorted_values(m: Column) -> Column:
    return F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))), lambda e: e["v"])


def override_types(entities: DataFrame, types: DataFrame) -> DataFrame:
    """Coarse and fine type from a type map(id, coarse_types, fine_types), where it names one that isn't blank."""
    first = lambda c: F.nullif(F.trim(normalize(F.get(c, F.lit(0)))), F.lit(""))
    t = types.select(F.col("id").alias("qid"), first(F.col("coarse_types")).alias("_coarse"), first(F.col("fine_types")).alias("_fine"))
    j = entities.join(t, "qid", "left")
    return j.withColumns({"coarse_type": F.coalesce("_coarse", "coarse_type"), "fine_type": F.coalesce("_fine", "fine_type")}).drop("_coarse", "_fine")


def typing_report(raw: DataFrame, languages: list[str], alias_cap: int) -> DataFrame:
    """qid, labels, aliases, descriptions, item_category, coarse_types, fine_types, ner_type_source of entities, judged by the
    chosen languages."""
    labels = value_map(F.col("labels"))
    chosen = raw.select("id", "type", pick_languages(labels, languages).alias("l"), pick_alias_languages(alias_map(F.col("aliases"), labels), languages, alias_cap).alias("a"), pick_languages(value_map(F.col("descriptions")), languages).alias("d"), F.coalesce("claims", F.create_map().cast("map<string,array<struct<rank:string,mainsnak:struct<snaktype:string,datavalue:struct<value:string>>>>>")).alias("claims"))
    p31 = claim_ids(F.col("claims"), "P31", 32)
    english = F.col("l")["en"].isNotNull() | F.col("d")["en"].isNotNull() | F.col("a")["en"].isNotNull()
    one = F.concat(F.array(F.col("d")["en"], F.col("l")["en"]), F.coalesce(F.col("a")["en"], F.array().cast("array<string>")))
    every = F.concat(_sorted_values(F.col("d")), _sorted_values(F.col("l")), F.flatten(_sorted_values(F.col("a"))))
    t = typed(F.col("id"), p31, F.array_compact(F.when(english, one).otherwise(every)))
    out = chosen.withColumn("t", t)
    return out.select(F.col("id").alias("qid"), F.col("l").alias("labels"), F.col("a").alias("aliases"), F.col("d").alias("descriptions"), item_category(F.col("id"), F.col("type"), F.col("claims")).alias("item_category"), F.col("t.coarse").alias("coarse_types"), F.col("t.fine").alias("fine_types"), F.col("t.source").alias("ner_type_source"))


def edges(raw: DataFrame) -> DataFrame:
    """subject_qid, predicate_pid, object_qid, rank of every entity-valued statement."""
    per = raw.select(F.col("id").alias("subject_qid"), F.explode("claims").alias("predicate_pid", "s")).where(F.col("predicate_pid").startswith("P"))
    # made inside the generator: a filter on the object would otherwise make it once more
    made = F.transform("s", lambda x: F.struct(statement_object(x).alias("object_qid"), F.coalesce(x["rank"], F.lit("normal")).alias("rank")))
    return per.select("subject_qid", "predicate_pid", F.inline(made)).where("object_qid is not null and object_qid <> subject_qid")
