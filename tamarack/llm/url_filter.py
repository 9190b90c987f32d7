"""URL filters: dated list entries become validity intervals, and captures are judged as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.llm.common import materialize

HOST = "^\\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:\\s]+)"
#: Hosts that are addresses: they have no parents.
ADDRESS = "^(?:\\[.*\\]|[0-9]{1,3}(?:\\.[0-9]{1,3}){3})$"


def host(url: Column) -> Column:
    """The lower-case host of a URL; null where there is none. White space before the URL and dots at the host's end go."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), "\\.+$", "")), F.lit(""))


def domains(name: Column) -> Column:
    """A host and its parents, longest first, down to two labels (a single label, and an IP address, stands for itself)."""
    parts = F.split(name, "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(name.rlike(ADDRESS), F.array(name)).otherwise(parents)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, since, until) from dated entries (key, category, action add or remove, at).

    An `add` holds from its date to the next entry of the same key and category, exclusive; the last one holds for ever
    (until is null). Keys are compared in lower case, without blanks around them and dots at their end. Of entries at the same time `remove` comes last. Repeated entries change nothing; entries without key or
    date, and unknown actions, are left out.
    """
    rows = entries.select(F.nullif(F.lower(F.regexp_replace(F.trim("key"), "\\.+$", "")), F.lit("")).alias("key"), F.coalesce("category", F.lit("")).alias("category"), "action", "at").filter("key is not null and at is not null and action in ('add', 'remove')").distinct()
    w = Window.partitionBy("key", "category").orderBy("at", "action")  # a key's own history in the list
    return rows.withColumn("until", F.lead("at").over(w)).filter("action = 'add' and (until is null or until > at)").select("key", "category", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, capture_id: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row per capture: capture id, host, fetched, blocked, matched_key, category, listed_since, n_active.

    A capture is blocked if its host or a parent domain has an entry active at its fetch time. The most specific key wins,
    then the latest date, then the category first in order; n_active counts all. A null or malformed URL has no host and,
    like a null fetch time, is never blocked. Repeated rows are judged each by itself.

    Captures are first reduced to their distinct (host, time), so a hot host meets the list once a time stamp; the verdicts
    are a written table, so the join back is between two plain exchanges and a hot host's captures are split. Captures or
    entries may be empty tables: then there is no row, or nothing is blocked.
    """
    valid = materialize(intervals(entries), "intervals")
    rows = captures.select(F.col(capture_id).alias("id"), host(F.col(url)).alias("host"), F.col(fetched).alias("t"))
    asked = rows.filter("host is not null and t is not null").select("host", "t").distinct()
    keys = asked.select("host", "t", F.posexplode(domains(F.col("host"))).alias("depth", "key"))
    hits = keys.join(valid, "key").filter("since <= t and (until is null or t < until)")
    best = F.min(F.struct("depth", (-F.unix_micros(F.col("since").cast("timestamp"))).alias("late"), "category", "key", "since"))
    verdicts = materialize(hits.groupBy("host", "t").agg(best.alias("b"), F.count(F.lit(1)).alias("n_active")), "verdicts")
    out = rows.join(verdicts, ["host", "t"], "left")
    return out.select(
        F.col("id").alias(capture_id),
        "host",
        F.col("t").alias(fetched),
        F.col("b").isNotNull().alias("blocked"),
        F.col("b.key").alias("matched_key"),
        F.col("b.category").alias("category"),
        F.col("b.since").alias("listed_since"),
        F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
    )
