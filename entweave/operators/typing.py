"""Lexical typing of entities by clue words: 29 literal expressions over one token array, no join and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import casefold, normalize, tokenize, words_array
from ..lexicon import TYPING_RULES


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's variable is never inlined, a column expression is."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _ranked(lowered: Column, tokens: Column) -> Column:
    # of a long text few tokens are clues: these are found in one pass, the rules then look at them only
    return let(F.array_intersect(words_array(ALL_CLUES), tokens), lambda found: _scored(lowered, found))


ALL_CLUES = sorted({w for _, _, _, clues, _ in TYPING_RULES for w in clues})


def _scored(lowered: Column, tokens: Column) -> Column:
    rules = []
    for coarse, fine, least, clues, phrases in TYPING_RULES:
        score = F.size(F.array_intersect(tokens, words_array(clues)))
        for p in phrases:
            score = score + F.when(lowered.contains(p), 2).otherwise(0)
        rules.append(F.struct(F.when(score >= least, -score).alias("s"), F.lit(fine).alias("fine"), F.lit(coarse).alias("coarse")))
    return F.array_sort(F.filter(F.array(*rules), lambda r: r["s"].isNotNull()))


def rule_scores(text: Column) -> Column:
    """Array of (-score, fine, coarse) of the rules that reach their least score, best first."""
    bound = F.struct(casefold(text).alias("low"), F.array_distinct(tokenize(text)).alias("tokens"))
    return let(bound, lambda b: _ranked(b["low"], b["tokens"]))


def _types(top: Column) -> Column:
    misc = F.array(F.lit("MISC"))
    # equal scores: the coarse types sort by name, two of one coarse type count as one
    coarse = F.array_sort(F.array_distinct(F.transform(top, lambda r: r["coarse"])))
    return F.struct(F.when(F.size(top) > 0, coarse).otherwise(misc).alias("coarse"), F.when(F.size(top) > 0, F.transform(top, lambda r: r["fine"])).otherwise(misc).alias("fine"))


def lexical_types(text: Column) -> Column:
    """struct(coarse array, fine array): the two best rules at the top score; coarse and fine are ordered by themselves."""
    best = lambda ranked: F.slice(F.filter(ranked, lambda r: r["s"] == F.get(ranked, F.lit(0))["s"]), 1, 2)
    return let(rule_scores(text), lambda ranked: let(best(ranked), _types))


def typed(entity_id: Column, p31: Column, texts: Column) -> Column:
    """Types of an entity: properties, humans by claim, else by the words of its texts; with the source's name."""
    words = lexical_types(F.array_join(F.array_distinct(F.filter(F.transform(texts, normalize), lambda t: t != "")), "\n"))
    one = lambda a, b: F.struct(F.array(F.lit(a)).alias("coarse"), F.array(F.lit(b)).alias("fine"))
    kind = F.when(entity_id.startswith("P"), one("RELATION", "PROPERTY")).when(F.array_contains(p31, "Q5"), one("PERSON", "HUMAN")).otherwise(words)
    source = F.when(~entity_id.startswith("P") & F.array_contains(p31, "Q5"), "claims_p31_human_v1").otherwise("lexical_v1")
    return let(kind, lambda k: F.struct(k["coarse"].alias("coarse"), k["fine"].alias("fine"), source.alias("source")))
