"""Lookup of a batch of mentions: fuzzy candidates, context, reranking.

A mention is matched against the distinct names, not against the entities, and found by one trigram (its rarest among
the names) before the full test; only matching names are joined back to what bears them.  Context is attached after the cut to the best
candidates, so it is never built for entities that nobody asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import unsent, written
from .graph import context_strings

WEIGHTS = {"name": 0.62, "context": 0.23, "type": 0.10, "prior": 0.05}
TOP_K = 20


def prepare(mentions: DataFrame) -> DataFrame:
    """mentions(mention_id, mention, context array, coarse_hints array, fine_hints array, crosslinks array) with nulls filled and terms tokenised."""
    none = F.array().cast("array<string>")
    names = set(mentions.columns)
    get = lambda c: F.coalesce(F.col(c), none) if c in names else none
    terms = F.array_distinct(F.flatten(F.transform(get("context"), X.tokenize)))
    valid = lambda c: F.array_distinct(F.filter(F.transform(get(c), lambda x: F.trim(x)), lambda x: x != ""))
    checked = lambda c: F.when(F.exists(valid(c), lambda x: ~x.rlike("^[A-Za-z0-9_.:/-]+$")), F.raise_error(F.lit("a type hint has characters that no type has")).cast("array<string>")).otherwise(valid(c))
    return mentions.select("mention_id", "mention", terms.alias("context_terms"), checked("coarse_hints").alias("coarse_hints"), checked("fine_hints").alias("fine_hints"), get("crosslinks").alias("crosslinks"))


def _short_grams(c: Column) -> Column:
    """The empty string, every character and every pair of neighbouring ones."""
    ones = F.filter(F.split(c, ""), lambda x: x != "")
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))), lambda x: F.length(x) == 2)
    return F.array_distinct(F.concat(F.array(F.lit("")), ones, pairs))


#: lengths of the substrings by which mentions are looked for, and how many names may hold one before a longer one is tried
GRAM_LENGTHS, COMMON = (3, 6, 12, 24), 64
#: mentions up to which their substrings are sent to the names
FEW_MENTIONS = 2_000


def _asked(m: DataFrame, n: int) -> DataFrame:
    """mention, live, gram of n characters of what the mention says literally."""
    return m.select("mention", "live", F.explode(F.array_distinct(F.flatten(F.transform("said", lambda x: X.substrings(x, n))))).alias("gram"))


def matching_names(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mentions(mention) x names(name, both lower-cased) -> pairs where the name contains the mention, as ILIKE '%m%' has it.

    A mention probes the rarest trigram of what it says literally, between its wildcards if it has any; where more than COMMON
    names hold it, the rarest substring of 6, 12 or 24 characters, so that numbered names don't meet all their like.  One of
    under three literal characters in a row probes one or two characters.  Every pair is then tested in full; nothing is joined
    by predicate alone."""
    live = F.col("mention").rlike(r"[%_\\]")
    said = F.when(live, F.split(F.lower("mention"), r"[%_\\]")).otherwise(F.array(F.lower("mention")))
    m = written(mentions.select("mention").distinct().select("mention", live.alias("live"), said.alias("said")), "mentions")
    names = written(names.select("name"), "names")
    fits = F.when(F.col("live"), F.expr("name ilike concat('%', mention, '%')")).otherwise(F.col("name").contains(F.lower("mention")))
    longest = F.array_max(F.transform("said", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    sent, apart = (F.broadcast, lambda df: df) if m.count() <= FEW_MENTIONS else (lambda df: df, unsent)
    out, left = None, m.where(F.length(longest) >= GRAM_LENGTHS[0])
    top = names.agg(F.max(F.length("name"))).first()[0] or 0  # longer mentions match nothing
    for i, n in enumerate(GRAM_LENGTHS):
        grams = apart(names.select("name", F.explode(X.substrings(F.col("name"), n)).alias("gram")))
        asked = apart(_asked(left, n))
        # only grams that are asked for are counted
        frequency = grams.join(sent(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
        rarest = asked.join(frequency, "gram").groupBy("mention", "live").agg(F.min(F.struct("df", "gram")).alias("r"))
        more = GRAM_LENGTHS[i + 1] if i + 1 < len(GRAM_LENGTHS) and GRAM_LENGTHS[i + 1] <= top else None
        if more:
            # those whose rarest gram is common and who say enough literally go on to longer ones
            rarest = written(rarest.join(m.select("mention", F.length(longest).alias("n")), "mention"), "rarest")
            goes_on = (F.col("r.df") > COMMON) & (F.col("n") >= more)
            left, rarest = m.join(rarest.where(goes_on).select("mention"), "mention", "left_semi"), rarest.where(~goes_on)
        pairs = sent(rarest.select("mention", "live", F.col("r.gram").alias("gram"))).join(grams, "gram").where(fits).select("mention", "name")
        out = pairs if out is None else out.unionByName(pairs)
        if not more:
            break
    short = m.where(F.length(longest) < GRAM_LENGTHS[0]).select("mention", "live", F.substring(longest, 1, 2).alias("gram"))
    if not short.isEmpty():
        few = apart(names.select("name", F.explode(_short_grams(F.col("name"))).alias("gram")))
        out = out.unionByName(sent(short).join(few, "gram").where(fits).select("mention", "name"))
    return out


def _named_as(kind: str):
    # a function of one argument: transform would fill a second one with the index
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x).alias("name"))


def fuzzy_candidates(mentions: DataFrame, entities: DataFrame, *, k: int = TOP_K) -> DataFrame:
    """mention_id, qid, score, rank: additive match score, the best k by (score, prior, qid).

    Types and prior travel with the names, so hints filter in the join and no entity is fetched again."""
    none = F.array().cast("array<string>")
    facts = ["coarse_type", "fine_type", "prior"]
    kinds = [("label", F.array("label")), ("labels", F.coalesce("labels", none)), ("aliases", F.coalesce("aliases", none))]
    parts = [F.transform(a, _named_as(kind)) for kind, a in kinds]
    named = entities.select("qid", *facts, F.explode(F.array_distinct(F.concat(*parts))).alias("n")).select("qid", *facts, "n.kind", "n.name").where("name is not null")
    pairs = matching_names(mentions, named.select("name").distinct())
    equal = F.lower("mention") == F.col("name")
    allowed = lambda hints, c: (F.size(hints) == 0) | F.array_contains(hints, F.col(c))
    fits = allowed("coarse_hints", "coarse_type") & allowed("fine_hints", "fine_type")
    flags = [f"{kind}_{how}" for kind, _ in kinds for how in ("eq", "in")]
    asked = mentions.select("mention_id", "mention", "coarse_hints", "fine_hints")
    hit = named.join(pairs, "name").join(asked, "mention").where(fits).groupBy("mention_id", "qid").agg(
        *[F.max(F.when((F.col("kind") == kind) & equal, 1).otherwise(0)).alias(f"{kind}_eq") for kind, _ in kinds],
        *[F.max(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(f"{kind}_in") for kind, _ in kinds],
        F.first("prior").alias("prior"), F.lit(0).alias("linked"),
    )
    links = entities.select("qid", *facts, F.explode(F.array_distinct(F.filter(F.array("wikipedia_url", "dbpedia_url"), lambda u: u.isNotNull() & (u != "")))).alias("link"))
    by_link = mentions.select("mention_id", "coarse_hints", "fine_hints", F.explode("crosslinks").alias("link")).join(links, "link").where(fits)
    linked = by_link.groupBy("mention_id", "qid").agg(*[F.lit(0).alias(f) for f in flags], F.first("prior").alias("prior"), F.lit(1).alias("linked"))
    both = hit.unionByName(linked).groupBy("mention_id", "qid").agg(*[F.max(f).alias(f) for f in [*flags, "linked"]], F.first("prior").alias("prior"))
    weights = {"label_eq": 4.0, "labels_eq": 3.0, "aliases_eq": 2.5, "label_in": 1.5, "labels_in": 1.25, "aliases_in": 1.0, "linked": 1.5}
    score = sum((F.col(f) * F.lit(w) for f, w in weights.items()), F.lit(0.0))
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), F.desc("prior"), "qid")
    return both.select("mention_id", "qid", score.alias("score"), "prior").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("mention_id", "qid", "score", "rank")


def rerank(candidates: DataFrame, *, k: int = TOP_K, weights: dict | None = None, exact_mode: bool = False) -> DataFrame:
    """candidates(mention_id, mention, qid, score, label, labels, aliases, context_string, coarse_type, fine_type, prior,
    popularity, context_terms, coarse_hints, fine_hints), one row per (mention_id, qid), with the scores and final rank."""
    w = weights or WEIGHTS
    per = Window.partitionBy("mention_id")
    c = candidates.withColumns({"_lo": F.min("score").over(per), "_hi": F.max("score").over(per)})
    spread = F.when(F.col("_hi") <= F.col("_lo"), F.when(F.col("_hi") > 0, 1.0).otherwise(0.0)).otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    terms, doc = F.col("context_terms"), F.array_distinct(X.tokenize(F.coalesce("context_string", F.lit(""))))
    context = F.when((F.size(terms) == 0) | (F.size(doc) == 0), 0.0).otherwise(F.size(F.array_intersect(doc, terms)) / F.size(terms))
    kind = F.when((F.size("fine_hints") > 0) & F.array_contains("fine_hints", F.col("fine_type")), 1.0).when((F.size("coarse_hints") > 0) & F.array_contains("coarse_hints", F.col("coarse_type")), 0.5).otherwise(0.0)
    none = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.array("label"), F.coalesce("labels", none), F.coalesce("aliases", none)))
    c = c.withColumn("exact_name_match", F.coalesce(F.array_contains(X.exact_names(names), X.exact_name(F.col("mention"))), F.lit(False)))
    name = F.when(F.col("exact_name_match"), 1.0).otherwise(spread) if exact_mode else spread
    prior = F.coalesce("prior", X.prior(F.coalesce("popularity", F.lit(0.0))))
    c = c.withColumns({"name_score": name, "context_score": context, "type_score": kind, "prior_score": prior})
    final = w["name"] * F.col("name_score") + w["context"] * F.col("context_score") + w["type"] * F.col("type_score") + w["prior"] * F.col("prior_score")
    if exact_mode:
        final = final + F.when(F.col("exact_name_match"), 0.05).otherwise(0.0)
    c = c.withColumn("final_score", final)
    order = per.orderBy(F.desc("final_score"), F.desc("exact_name_match"), F.desc("prior_score"), "qid")
    return c.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k).drop("_lo", "_hi")


def lookup(entities: DataFrame, triples: DataFrame, mentions: DataFrame, *, k: int = TOP_K) -> DataFrame:
    """A batch of requests: the reranked candidates of every mention."""
    k = max(1, min(100, k))
    m = prepare(mentions)
    best = fuzzy_candidates(m, entities, k=k)
    # late: context only for the entities that were cut to
    wanted = best.select(F.col("qid").alias("subject_qid")).distinct()
    near = triples.join(wanted, "subject_qid", "left_semi")
    context = context_strings(near, entities.select("qid", "label"))
    full = best.join(entities, "qid").join(context, "qid", "left").join(m.drop("crosslinks"), "mention_id")
    return rerank(full, k=k)


def top_one(reranked: DataFrame) -> DataFrame:
    return reranked.where("final_rank = 1")
