"""URL filters whose lists change over time.

Dated list events become validity intervals per key, and every capture is held
against the entries that were active when it was fetched. Keys are hosts (with
all their subdomains) and URL prefixes; a capture has a key for each of its
host's suffixes and each of its path's prefixes, so the as-of join is an equal
join on the key with a test of the interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def keys_of(url: Column) -> Column:
    """Every list key that would cover the URL, the least specific first: host
    suffixes of two labels or more, then the host with one, two, ... path parts."""
    host = host_of(url)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    labels = F.split(host, r"\.")
    parts = F.array_remove(F.split(path, "/"), "")
    domains = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(2), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))).otherwise(F.array(host))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, prefixes)).otherwise(F.array().cast("array<string>"))


def validity_intervals(events: DataFrame) -> DataFrame:
    """``key, valid_from, valid_to`` (null: still valid) from ``events(key, action,
    effective)``: each ``add`` holds until the key's next event.

    Of several events of a key at one time, one ``remove`` makes it a removal.
    Events with a null in any of the three are passed over.
    """
    at = events.where("key is not null and action is not null and effective is not null").groupBy("key", "effective").agg(F.max(F.col("action") == "remove").alias("removed"))
    then = F.lead("effective").over(Window.partitionBy("key").orderBy("effective"))
    return at.withColumn("valid_to", then).where("not removed").select("key", F.col("effective").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``captures(url, fetched, ...)`` with ``host``, ``blocked`` and, of the active
    entries, the most specific ``matched_key`` and its ``listed_since``.

    URLs are judged once for each time they were fetched, before the join, so a
    page captured many times does not weigh on it. Null or unparsable URLs have
    no keys and a null ``fetched`` lies in no interval; both are not blocked.
    Repeated rows stay. Columns of ``captures`` with one of these four names are
    replaced. An empty table gives an empty result, and without events nothing
    is blocked.
    """
    once = captures.select(F.col("url").alias("u"), F.col("fetched").alias("f")).where("u is not null and f is not null").distinct()
    keyed = once.select("u", "f", F.posexplode(keys_of(F.col("u"))).alias("rank", "key"))
    active = keyed.join(validity_intervals(events), "key").where((F.col("f") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("f") < F.col("valid_to"))))
    verdict = active.groupBy("u", "f").agg(F.max_by(F.struct("key", "valid_from"), "rank").alias("hit"))
    joined = captures.alias("c").join(verdict.alias("v"), (F.col("c.url") == F.col("v.u")) & (F.col("c.fetched") == F.col("v.f")), "left")
    others = [F.col(f"c.`{c}`") for c in captures.columns if c.lower() not in ("host", "blocked", "matched_key", "listed_since")]
    return joined.select(*others, host_of(F.col("c.url")).alias("host"), F.col("v.hit").isNotNull().alias("blocked"), F.col("v.hit.key").alias("matched_key"), F.col("v.hit.valid_from").alias("listed_since"))
