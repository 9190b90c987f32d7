"""Counts, shares, histograms and their tops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions import normalise, urls


def share(n: str, by: Sequence[str] = ()) -> Column:
    """A count's part of its group's sum. Meant for aggregated tables: the window sees one row per value."""
    return F.col(n) / F.sum(n).over(Window.partitionBy(*by))


def counts(rows: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= least) if least > 1 else out


def top(rows: DataFrame, n: str, k: int, *ties: str) -> DataFrame:
    """The k largest, equal ones in order of `ties`: a bounded heap per task, never a global sort."""
    return rows.orderBy(F.desc(n), *ties).limit(k)


def frequency_of_frequencies(rows: DataFrame, key: str) -> DataFrame:
    """How many keys occur n times, and the median n over keys."""
    per = counts(rows, key)
    out = per.groupBy(F.col("n").alias("times")).agg(F.count(F.lit(1)).alias("n_keys"))
    return out.crossJoin(F.broadcast(per.agg(F.median("n").alias("median_times"))))  # one row


def maxima(rows: DataFrame, key: str, value: str, at: int) -> DataFrame:
    """Distribution of each key's maximum: keys, share of all, cumulated share, and whether it is at most `at`."""
    per = rows.groupBy(key).agg(F.max(F.col(value).cast("int")).alias("maximum")).groupBy("maximum").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy().orderBy("maximum").rangeBetween(Window.unboundedPreceding, 0))  # a row per distinct maximum
    return per.withColumn("share", share("n")).withColumn("cum_share", running / F.sum("n").over(Window.partitionBy())).withColumn("within", F.col("maximum") <= at)


def rollup_shares(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, level, n, share): counts per pair, per a and in all, with each pair's share of its a."""
    out = rows.rollup(a, b).agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.when(F.col("level") == 0, F.col("n") / F.sum(F.when(F.col("level") == 0, F.col("n"))).over(Window.partitionBy(a, "level"))))


def overridden(rows: DataFrame, key: str, fixed: Mapping[str, int]) -> DataFrame:
    """Counts per key, some replaced by known figures."""
    out = counts(rows, key)
    table = F.create_map(*(F.lit(x) for kv in fixed.items() for x in kv)).cast("map<string,bigint>") if fixed else None
    return out.withColumn("n", F.coalesce(F.try_element_at(table, F.col(key).cast("string")), F.col("n"))) if fixed else out


def sizes(rows: DataFrame, values: str) -> DataFrame:
    """How many rows have lists of each size, and their percent of all rows."""
    out = rows.groupBy(F.size(values).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("percent", share("n") * 100)


def two_way(rows: DataFrame, value: str, by: str, columns: Sequence[str]) -> DataFrame:
    """Counts of each value under each of `columns`, zero where there is none, with the total."""
    out = rows.groupBy(value).pivot(by, list(columns)).agg(F.count(F.lit(1))).fillna(0, list(columns))
    total = F.lit(0).cast("long")
    for c in columns:
        total = total + F.col(c)
    return out.withColumn("total", total)


def grouped_domains(rows: DataFrame, manager: str, domain: str) -> DataFrame:
    """Counts per (manager, domain) and per domain in one pass over the data (grouping sets)."""
    return rows.groupingSets([[F.col(manager), F.col(domain)], [F.col(domain)]], manager, domain).agg(F.grouping(manager).cast("long").alias("overall"), F.count(F.lit(1)).alias("n"))


def as_map_text(key: str, n: str) -> Column:
    """key=n pairs of a group as sorted text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, n))), lambda s: F.concat_ws("=", s[key], s[n].cast("string"))), ",")


def first_available(rows: DataFrame, key: str, option: str, priority: str, available: Column) -> DataFrame:
    """For each key the available option that comes first."""
    return rows.filter(available).groupBy(key).agg(F.min_by(option, priority).alias(option))


def advisory_domains(rows: DataFrame, manager: str, first: str, second: str, ignored: Sequence[str] = urls.IGNORE_ENDS) -> DataFrame:
    """(manager, domain, n): domains of advisories' first links and of the links found behind them.

    `second` is the text of a list of links. Of these, links with an ignored start or end, those to the first link's own
    domain, and those without a domain or with the domain "." don't count; a text that is no list leaves the first link
    alone. A null or malformed first link has no domain and isn't counted either.
    """
    of = lambda c: F.nullif(urls.registered_domain(c), F.lit(""))
    links = F.transform(F.coalesce(normalise.literal_list(F.col(second)), F.array().cast("array<string>")), lambda x: F.trim(x))
    wanted = F.transform(F.filter(links, lambda x: ~urls.at_either_end(x, ignored)), of)
    own = rows.select(F.col(manager).alias("manager"), of(F.col(first)).alias("_own"), wanted.alias("_more"))
    found = F.filter("_more", lambda d: d.isNotNull() & (d != ".") & ~d.eqNullSafe(F.col("_own")))
    each = own.select("manager", F.explode(F.concat(F.filter(F.array("_own"), lambda d: d.isNotNull()), found)).alias("domain"))
    return each.groupBy("manager", "domain").agg(F.count(F.lit(1)).alias("n"))
