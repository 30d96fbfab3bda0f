"""String functions as Column -> Column.  Everything but exact_name stays inside the JVM."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lexicon import STOPWORDS

SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c) -> Column:
    """White space of any script collapsed to one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), SPACES, " "))


def casefold(c) -> Column:
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def tokenize(c) -> Column:
    """Runs of letters and digits, in folded case."""
    return F.regexp_extract_all(casefold(normalize(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lab_tokens(c) -> Column:
    """ASCII letters and digits only."""
    return F.regexp_extract_all(casefold(c), F.lit("[a-z0-9]+"), F.lit(0))


def lab_normalize(c) -> Column:
    return F.array_join(lab_tokens(c), " ")


def alpha_tokens(c) -> Column:
    """ASCII letters only."""
    return F.regexp_extract_all(casefold(c), F.lit("[a-z]+"), F.lit(0))


def label_normalize(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]+", " "))


def _exact(text: str) -> str:
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFC", text).casefold().strip())
    kept = "".join(ch if ch.isalnum() else " " for ch in folded if not unicodedata.combining(ch))
    return " ".join(kept.split(" ")).strip() if "  " not in kept else " ".join(x for x in kept.split(" ") if x)


@F.pandas_udf(T.StringType())
def _exact_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _exact(t))


def exact_name(c) -> Column:
    """Accents, case and punctuation removed.  ASCII goes by built-ins; Arrow batches serve the rest only."""
    c = _col(c)
    ascii_only = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), ascii_only).otherwise(_exact_udf(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _exact_list_udf(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: None if xs is None else [None if x is None else _exact(x) for x in xs])


def exact_names(c) -> Column:
    """exact_name of every element; lists that are all ASCII don't leave the JVM."""
    c = _col(c)
    ascii_only = ~F.exists(c, lambda x: ~x.rlike(r"^[\x00-\x7F]*$"))
    plain = F.transform(c, lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")))
    return F.when(F.coalesce(ascii_only, F.lit(True)), plain).otherwise(_exact_list_udf(F.when(~F.coalesce(ascii_only, F.lit(True)), c)))


def _folding() -> tuple[str, str]:
    """Letters whose decomposition is one base letter and combining marks, and these bases."""
    pairs = []
    for code in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(code))
        base = [x for x in d if unicodedata.category(x) != "Mn"]
        if len(d) > 1 and len(base) == 1:
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BARE = _folding()


def ascii_fold(c) -> Column:
    """Accents dropped, ligatures spelled out, as a search index folds its terms."""
    s = F.translate(_col(c), _ACCENTED, _BARE)
    for sign, text in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d")):
        s = F.replace(s, F.lit(sign), F.lit(text))
    return s


def char_ngrams(c, n: int = 3) -> Column:
    """Distinct n-grams without blanks; a text of up to n characters is its own."""
    s = F.replace(_col(c), F.lit(" "), F.lit(""))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n))))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(grams)


def dice(a, b) -> Column:
    x, y = char_ngrams(a), char_ngrams(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def name_similarity(a, b) -> Column:
    """The better of edit similarity and trigram dice; 1 for equals, 0 if either is empty."""
    a, b = _col(a), _col(b)
    edit = 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(edit, dice(a, b)))))


def mention_surface(c) -> Column:
    """Bracketed notes dropped, asterisks to blanks, outer punctuation stripped."""
    s = F.replace(F.regexp_replace(_col(c), r"\[[^\]]*\]", ""), F.lit("*"), F.lit(" "))
    return normalize(F.btrim(normalize(s), F.lit(" .,:;!?-_")))


def clamp(c, low: float = 0.0, high: float = 1.0, default: float = 0.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(_col(c).try_cast("double"), F.lit(default))))


def without_stopwords(tokens: Column, stop=STOPWORDS) -> Column:
    stops = F.array(*[F.lit(s) for s in stop])
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~F.array_contains(stops, t))


def words_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def overlap(tokens: Column, words) -> Column:
    return F.size(F.array_intersect(tokens, words if isinstance(words, Column) else words_array(words)))


def strip_html(c) -> Column:
    """Tags to blanks, the five predefined entities and no-break blanks resolved, white space collapsed."""
    s = F.regexp_replace(_col(c), "<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(sign))
    return normalize(s)


@F.pandas_udf(T.StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    """Every named and numeric entity."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def int_group(c, pattern: str) -> Column:
    """The first group as a number, thousands marks removed; null unless it is all digits."""
    digits = F.regexp_replace(F.regexp_extract(_col(c), pattern, 1), "[,.]", "")
    return F.when(digits.rlike("^[0-9]+$"), digits.try_cast("bigint"))


def bounded_join(items: Column, max_chars: int, sep: str = "; ") -> Column:
    """Items joined while they fit; stops at the first that doesn't; a first one that is too long is cut."""
    if max_chars <= 0:
        return F.lit("")
    k = len(sep)
    start = F.struct(F.lit(False).alias("done"), F.lit("").alias("text"))

    def step(acc, x):
        grown = F.when(acc["text"] == "", F.substring(x, 1, max_chars)).otherwise(F.concat(acc["text"], F.lit(sep), x))
        fits = (acc["text"] == "") | (F.length(acc["text"]) + k + F.length(x) <= max_chars)
        stop = acc["done"] | ~fits
        return F.struct(stop.alias("done"), F.when(stop, acc["text"]).otherwise(grown).alias("text"))

    cleaned = F.filter(F.array_distinct(items), lambda x: x != "")
    return F.aggregate(cleaned, start, step, lambda acc: acc["text"])


def canonical_json(entries) -> Column:
    """Compact JSON of name -> Column with sorted keys."""
    return F.to_json(F.struct(*[_col(v).alias(k) for k, v in sorted(entries.items())]), {"ignoreNullFields": "false"})


def prior(popularity) -> Column:
    return 1.0 - F.exp(-F.log1p(F.greatest(F.lit(0.0), _col(popularity).cast("double"))) / 6.0)


def substrings(c: Column, n: int) -> Column:
    """Distinct substrings of n characters, blanks among them; none for shorter texts."""
    return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))))


def json_text_map(c) -> Column:
    """A JSON object's texts by name; anything else, and any other value, counts as none."""
    m = F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_filter(m, lambda _, v: v.isNotNull() & ~v.rlike(r"^[\[{]"))


def json_text_list(c) -> Column:
    """The texts of a JSON list without blank ones; anything else counts as none."""
    return F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
