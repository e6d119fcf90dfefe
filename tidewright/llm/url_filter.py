"""URL filters over time.

A dated list says when a key was added to or removed from it.  Successive entries of a key become validity intervals,
and every capture is looked up as of its fetch time.  The keys of a capture are its host, each parent domain of two or
more labels, and the host with the first path segment; of the entries active at fetch time the longest key decides.

Intervals are cut by month, so that a key with a long history joins only the months it is needed in, and the captures of
a key are dealt over ``salts`` parts, so that a host or domain with most of the captures is spread.  Spark broadcasts
the intervals only if it finds them small.  More parts are a parameter, for lists whose largest key has more captures
than a task should take; beyond that Spark splits what it finds skewed.

Defined results: a null or malformed URL, or a null fetch time, has no keys and is not blocked; entries with a null key,
time or action are no entries; of entries of a key at the same time a removal is first, then "allow", then "deny"; rows
with the same id, URL and time are one capture, also if the id is null; of keys of equal length that are active "allow" counts
before "deny" and the greater key before the smaller; very long URLs have all their keys; further columns, also of the same
names, are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)"
NEVER = "9999-12-31 00:00:00"


def host(url: Column) -> Column:
    """The lower-case host without a leading ``www.``, empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"^www\.|\.$", "")


def keys(url: Column) -> Column:
    """All keys under which a list can name a URL."""
    h, segment = host(url), F.regexp_extract(url, SEGMENT, 1)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    parents = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array(h))
    return F.when(h != "", F.concat(F.array_distinct(parents), F.when(segment != "", F.array(F.concat(h, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, kind, valid_from, valid_to) from dated entries (key, at, action add/remove, kind allow/deny); the end is exclusive."""
    e = entries.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "action", "kind").dropna(subset=["key", "at", "action", "kind"])
    # What holds from a time on, one row for each key, kind and time: so a key's window is as long as its history has dates.
    e = e.groupBy("key", "kind", "at").agg(F.max(F.when(F.col("action") == "add", 1).otherwise(0)).alias("listed"))
    until = F.lead("at", 1, None).over(Window.partitionBy("key", "kind").orderBy("at"))
    e = e.select("key", "kind", "listed", F.col("at").alias("valid_from"), F.coalesce(until, F.lit(NEVER).cast("timestamp_ntz")).alias("valid_to"))
    return e.where("listed = 1").drop("listed")


def month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at", salts: int = 8) -> DataFrame:
    """(id, url, fetched_at, n_active, deciding_key, deciding_kind, blocked) of each capture."""
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).cast("timestamp_ntz").alias("at"))
    looked_up = c.withColumn("key", F.explode_outer(keys(F.col("url")))).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
    # Intervals are cut by the months that captures have, so a capture of a far time costs one month and not all before it.
    months = sorted(r.m for r in c.where("at is not null").select(month(F.col("at")).alias("m")).distinct().collect())
    within = F.filter(F.lit(months).cast("array<int>"), lambda m: (m >= month(F.col("valid_from"))) & (m <= month(F.col("valid_to")))) if months else F.array().cast("array<int>")
    active = intervals(entries).withColumn("m", F.explode(within))
    active = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = looked_up.withColumn("m", month(F.col("at"))).join(active, ["key", "m", "salt"], "left_outer").select(
        "id", "url", "at", F.when((F.col("at") >= F.col("valid_from")) & (F.col("at") < F.col("valid_to")), F.struct(F.length("key").alias("n"), (F.col("kind") == "allow").cast("int").alias("a"), "key", "kind")).alias("hit")
    )
    out = hit.groupBy("id", "url", "at").agg(F.size(F.collect_set("hit")).cast("long").alias("n_active"), F.max("hit").alias("best"))
    return out.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(at_col), "n_active",
        F.col("best.key").alias("deciding_key"), F.col("best.kind").alias("deciding_kind"), F.coalesce(F.col("best.kind") == "deny", F.lit(False)).alias("blocked"),
    )
