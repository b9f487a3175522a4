"""URL filters over time: a temporal join of captures with dated list entries.

An entry names a domain (all its hosts), a path prefix or one URL, an action and the day from which it holds. The entries of
one name become validity intervals - each holds until the day of the next - and every capture is judged by the intervals
that hold on the day it was fetched. A capture has as many keys as its host has suffixes and its path has segments; keys meet
intervals in one equi-join with a range condition, of which at most one interval per key can match. The most specific
key decides. Captures with the same URL and day are judged once, and the hot side of a join is split by
adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, others

KINDS = ("domain", "prefix", "url")  # from the least to the most specific
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and closing dot; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"\.+$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, at least ``/``."""
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def whole_of(url: Column) -> Column:
    """Host, path and query, without scheme and fragment."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), path_of(url), query)


def keys_of(url: Column) -> Column:
    """All keys under which a list may name ``url``: an array of (kind, name)."""
    host, path = host_of(url), path_of(url)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    # "/a/b" has the prefixes "/", "/a/"; the last part is no folder
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: pair("prefix", F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    )
    return F.when(host != "", F.concat(domains, prefixes, F.array(pair("url", whole_of(url)))))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``kind``, ``name``, ``action``, ``since``, ``until`` (exclusive) from entries (kind, name, action, since).

    Of several entries for one name and day, the alphabetically last action counts. Entries without a name, day or action, or
    of an unknown kind, hold never.
    """
    daily = (
        entries.where(F.col("kind").isin(*KINDS) & F.col("name").isNotNull() & F.col("since").isNotNull())
        .where(F.col("action").isNotNull())
        .groupBy("kind", "name", F.col("since").cast("date").alias("since"))
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("since").over(Window.partitionBy("kind", "name").orderBy("since"))
    return daily.withColumn("until", F.coalesce(following, F.lit(FOREVER).cast("date")))


def judge(
    captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", default: str = "allow"
) -> DataFrame:
    """``captures`` with ``action``, ``rule_kind`` and ``rule`` of the most specific entry that held at ``time_col``.

    Among prefixes and domains the longest name is the most specific. Without such an entry the action is ``default`` and
    the rule null; so it is for captures with a null or unusable URL or without a time. Every row of ``captures``
    gives one row, repeated ones too; other columns pass, but for columns named like the three outputs.
    """
    outputs = ("action", "rule_kind", "rule")
    rows = captures.select(*[f"`{c}`" for c in others(captures, outputs)])
    url, day = F.col(f"`{url_col}`"), F.col(f"`{time_col}`").cast("date")
    cases = captures.select(url.alias("_url"), day.alias("_day")).where("_url is not null and _day is not null").distinct()
    keyed = cases.select("_url", "_day", F.explode(keys_of(F.col("_url"))).alias("_key"))
    keyed = keyed.select("_url", "_day", F.col("_key.kind").alias("kind"), F.col("_key.name").alias("name"))
    held = keyed.join(validity(entries), ["kind", "name"]).where("since <= _day and _day < until")
    order = F.struct(F.array_position(F.lit(list(KINDS)), F.col("kind")), F.length("name"), F.col("name"))
    best = held.groupBy("_url", "_day").agg(F.max_by(F.struct("action", "kind", "name"), order).alias("_best"))
    names = {c: fresh(rows, c) for c in ("_url", "_day", "_best")}
    best = best.select(*[F.col(c).alias(n) for c, n in names.items()])
    found = rows.join(best, (url == F.col(names["_url"])) & (day == F.col(names["_day"])), "left")
    return found.select(
        *[f"`{c}`" for c in rows.columns],
        F.coalesce(F.col(names["_best"])["action"], F.lit(default)).alias("action"),
        F.col(names["_best"])["kind"].alias("rule_kind"),
        F.col(names["_best"])["name"].alias("rule"),
    )


def drop_blocked(
    captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", blocked: str = "block"
) -> DataFrame:
    """``captures`` without those that were blocked when they were fetched."""
    judged = judge(captures, entries, url_col, time_col)
    return judged.where(F.col("action") != blocked).select(*[f"`{c}`" for c in captures.columns])
