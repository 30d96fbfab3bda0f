"""URL filters as a temporal list join, in DataFrame functions only.

A list is a log of dated entries: at `since` a pattern of a kind (host, domain, prefix) is added or removed under a
category.  For each pattern and category the log becomes validity intervals [from, to).  Every capture yields its keys
(its host, each parent domain, its host with each leading path segment) and is as-of joined to the intervals of equal
key that hold its fetch time.

The join is an equi-join on (key, time slot): intervals are cut at slot borders, so a host with a third of all
captures is spread over the slots of its fetch times, and what adaptive execution finds still skewed it splits.  Keys that
no entry has, such as the domain `com` of most captures, are left out before anything moves where the listed keys
measure at most `BROADCAST_BYTES`.  What moves is a row's identity (ids, time and a 128-bit hash of the URL), not its URL.  The
intervals are joined by shuffle unless Spark itself measures them to be under its broadcast limit.

Hosts are compared in lower case, paths as they are written, in captures and in entries.

Defined results: a null or unparsable URL has no keys and is never blocked, nor is one with a null fetch time; entries
with a null kind, pattern, date or action take no part; at equal dates a removal wins, repeated entries count once; a removal without
an addition means nothing; an empty list blocks nothing; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLOT_DAYS = 7
BROADCAST_BYTES = 8 << 20


def host_of(url):
    """Host in lower case, without user, port and trailing dot; null if there is none."""
    rest = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.rtrim(F.lower(rest), F.lit(".")), F.lit(""))


def path_of(url):
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url):
    """Distinct keys of a URL: h:<host>, d:<each domain of it>, p:<host>/<leading segments>."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    none = F.array().cast("array<string>")
    prefixes = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))).otherwise(none)
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(F.concat(F.lit("h:"), host)), domains, prefixes))).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """entries(kind, pattern, category, action, since) -> key, category, valid_from, valid_to (null: still valid)."""
    letter = F.create_map(*[F.lit(x) for x in ("host", "h:", "domain", "d:", "prefix", "p:")])
    e = entries.where("kind in ('host', 'domain', 'prefix') and pattern is not null and action in ('add', 'remove') and since is not null")
    host = F.regexp_extract("pattern", r"^[^/]*", 0)
    pattern = F.when(F.col("kind") == "prefix", F.concat(F.lower(host), F.substring("pattern", F.length(host) + 1, F.length("pattern")))).otherwise(F.lower("pattern"))
    e = e.select(F.concat(letter[F.col("kind")], pattern).alias("key"), F.coalesce("category", F.lit("")).alias("category"), "since", "action")
    # one state for each key, category and date: a removal wins
    e = e.groupBy("key", "category", "since").agg((F.max("action") == "add").alias("on"))
    order = Window.partitionBy("key", "category").orderBy("since")
    e = e.withColumn("was", F.lag("on", 1, False).over(order)).where(F.col("on") != F.col("was"))
    return e.withColumn("valid_to", F.lead("since").over(order)).where("on").select("key", "category", F.col("since").alias("valid_from"), "valid_to")


def _slot(ts, days: int):
    return F.floor(F.unix_timestamp(ts) / (days * 86400))


def evaluate(captures: DataFrame, entries: DataFrame, *, slot_days: int = SLOT_DAYS) -> DataFrame:
    """captures(page_id, url, fetched) -> page_id, host, fetched, blocked, n_active, categories; one row per capture."""
    held = written(intervals(entries), "intervals")
    # intervals are cut at the slots that captures have at all
    ends = captures.agg(F.min(_slot(F.col("fetched"), slot_days)).alias("lo"), F.max(_slot(F.col("fetched"), slot_days)).alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    first = F.greatest(_slot(F.col("valid_from"), slot_days), F.lit(lo))
    last = F.least(F.coalesce(_slot(F.col("valid_to"), slot_days), F.lit(hi)), F.lit(hi))
    whole, held = held, held.withColumn("slot", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    row = ["page_id", "fetched", "u1", "u2"]
    c = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"), F.xxhash64("url").alias("u1"), F.xxhash64(F.lit(1), "url").alias("u2"))
    probes = c.where("fetched is not null and page_id is not null").select(*row, F.explode(keys_of(F.col("url"))).alias("key"))
    listed = whole.select("key").distinct()
    if (listed.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        probes = probes.join(F.broadcast(listed), "key", "left_semi")
    probes = probes.withColumn("slot", _slot(F.col("fetched"), slot_days))
    active = probes.join(held, ["key", "slot"]).where((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    per = active.select(*row, "key", "category").distinct().groupBy(*row).agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    out = c.drop("url").join(per, row, "left")
    n = F.coalesce("n_active", F.lit(0).cast("long"))
    return out.select("page_id", "host", "fetched", (n > 0).alias("blocked"), n.alias("n_active"), F.coalesce("categories", F.lit("")).alias("categories"))


def demo_captures(pages: DataFrame) -> DataFrame:
    """pages has no fetch time: page_id is spread over 30 days from 2024-01-01, one capture each hour and some minutes."""
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(30 * 24 * 60)) * 60)
    return pages.select("page_id", "url", fetched.alias("fetched"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the table itself, so that it grows with it: every host is listed from day (length mod 20)
    for 6 days and again from 9 days later; two domains and the prefixes of one language section come and go too."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern is not null").distinct()
    domains = F.explode(F.array(F.lit("example.com"), F.lit("example.net")))
    patterns = hosts.select("pattern", F.expr("inline(array(('host', 'spam', 'add', 0), ('host', 'spam', 'remove', 6), ('host', 'spam', 'add', 9), ('prefix', 'adult', 'add', 3), ('prefix', 'adult', 'remove', 8))) as (kind, category, action, more)"))
    patterns = patterns.withColumn("pattern", F.when(F.col("kind") == "prefix", F.concat("pattern", F.lit("/en"))).otherwise(F.col("pattern")))
    fixed = pages.sparkSession.range(1).select(domains.alias("pattern")).select("pattern", F.expr("inline(array(('domain', 'malware', 'add', 1), ('domain', 'malware', 'remove', 4))) as (kind, category, action, more)"))
    day = F.pmod(F.length("pattern"), F.lit(20)) + F.col("more")
    return patterns.unionByName(fixed).select("kind", "pattern", "category", "action", F.timestamp_seconds(F.lit(1704067200) + day * 86400).alias("since"))


def op5(pages: DataFrame) -> DataFrame:
    return evaluate(demo_captures(pages), demo_entries(pages))
