"""URL filters by a temporal join.

List entries are dated: from its date on, a pattern is blocked, allowed, or off
the list. Entries become validity intervals, and every capture is judged by the
entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Copies of each interval, so that captures of one host are dealt to as many tasks.
SALTS = 16
ACTIONS = ("block", "allow")


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without user, port and closing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path, without scheme, query and fragment: the form of exact entries."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest))


def patterns(url: Column) -> Column:
    """What an entry may name to match a URL: its host, every parent domain, and its host and path; most specific last."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    return F.when(host_of(url).isNotNull(), F.concat(domains, F.array(canonical(url))))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) from `entries` (pattern, action, listed_at).

    An entry holds until the pattern's next one (valid_to, exclusive; null if
    none follows). Of entries of one pattern and time, `block` wins over `allow`
    over anything else. Entries with a null pattern or time are ignored, actions
    other than block and allow take the pattern off the list.
    """
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    states = (
        entries.where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull())
        .groupBy(F.lower("pattern").alias("pattern"), "listed_at")
        .agg(F.max(rank).alias("state"))
    )
    following = Window.partitionBy("pattern").orderBy("listed_at")
    return (
        states.withColumn("valid_to", F.lead("listed_at").over(following))
        .where("state > 0")
        .select("pattern", F.element_at(F.array(F.lit("allow"), F.lit("block")), F.col("state")).alias("action"),
                F.col("listed_at").alias("valid_from"), "valid_to")
    )


def judge(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """(page_id, url, fetched_at, verdict, pattern) for every row of `captures` (page_id, url, fetched_at).

    The most specific active pattern decides: host and path before the host,
    longer domains before shorter. Without one, or without a host or time, the
    verdict is `none` and the pattern null. Captures that are equal are judged
    once and returned as often as they occur.
    """
    # Equal captures collapse before any join; null times and URLs keep their rows.
    rows = captures.select("page_id", "url", "fetched_at").groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("copies"))
    salt = F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(salts)).cast("int")
    asked = rows.withColumn("salt", salt).select(
        "*", F.posexplode_outer(F.transform(patterns(F.col("url")), lambda p: F.lower(p))).alias("depth", "pattern")
    )
    active = intervals(entries).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    ).withColumnRenamed("pattern", "listed").withColumnRenamed("salt", "listed_salt")
    matched = asked.join(
        active,
        (F.col("pattern") == F.col("listed"))
        & (F.col("salt") == F.col("listed_salt"))
        & (F.col("fetched_at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))),
        "left",
    )
    decided = matched.groupBy("page_id", "url", "fetched_at", "copies").agg(
        F.max(F.when(F.col("listed").isNotNull(), F.struct("depth", "action", "listed"))).alias("best")
    )
    return decided.select(
        "page_id",
        "url",
        "fetched_at",
        F.coalesce(F.col("best.action"), F.lit("none")).alias("verdict"),
        F.col("best.listed").alias("pattern"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
