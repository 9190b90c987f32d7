"""Package records end to end: extraction outputs and feeds to one schema, resolved packages, tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions import dates, nested, normalise
from tamarack.operators import stats
from tamarack.operators.resolve import resolve
from tamarack.schema import RECORD_FIELDS

LISTS = [c for c in RECORD_FIELDS if c not in ("package_name", "package_manager")]
VOTED = ["discovery_date", "repository_url", "attack_method", "discoverer", "impacted_systems"]
MERGED = [c for c in LISTS if c not in VOTED]
PROVENANCE = ["source", "model", "prompt", "file_timestamp", "post_date", "source_link"]
# Further keys under which a field is found (fixed values); the first present counts.
OTHER_KEYS = {"version": normalise.VERSION_KEYS, "discovery_date": ["Discovery Date"], "attack_method": ["Attack Method", "Method Attack"]}


def _facts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Date and link of each row's page by file timestamp, '' where the page isn't known."""
    facts = links.select(F.col("timestamp").alias("file_timestamp"), F.col("date").alias("post_date"), F.col("link").alias("source_link"))
    out = rows.join(facts, "file_timestamp", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("post_date", "source_link")})


def from_outputs(outputs: DataFrame, links: DataFrame) -> DataFrame:
    """Package records of extraction outputs ((source, model, prompt, file, file_timestamp, text)).

    Bad and empty outputs give none (see nested.triage for their count); a record becomes a row per name and manager.
    ingest_seq orders rows as their files and records are read: what was seen first breaks ties later.
    """
    good = nested.triage(outputs, "text").filter("state = 'good'").select("source", "model", "prompt", "file", "file_timestamp", "doc")
    rows = nested.split_records(good, normalise.NAME_KEYS, normalise.MANAGER_KEYS)
    keys = {c: [k, *OTHER_KEYS.get(c, [])] for c, k in RECORD_FIELDS.items() if c in LISTS}
    rows = rows.select("source", "model", "prompt", "file", "file_timestamp", "package_name", "package_manager", *(nested.first_present(F.col("record"), ks).alias(c) for c, ks in keys.items()))
    order = F.pmod(F.xxhash64("file", "package_name", "package_manager", "version", "attack_method"), F.lit(1 << 20))
    seq = F.coalesce(F.try_to_number(F.regexp_replace("file_timestamp", "_", "").substr(3, 12), F.lit("9" * 12)).cast("long"), F.lit(0).cast("long")) * (1 << 20) + order
    return _facts(rows.withColumn("ingest_seq", seq).drop("file"), links)


def from_feed(feed: DataFrame, links: DataFrame, source: str = "github") -> DataFrame:
    """Package records of an advisory feed ((package_name, package_manager, timestamp, affected_version, update_date, overview)).

    The date is the page's, else the feed's own brought to yyyy-MM-dd; the link is '' where there is no page.
    """
    many = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.array(c))
    rows = feed.select(
        F.lit(source).alias("source"), F.lit("").alias("model"), F.lit("").alias("prompt"), F.col("timestamp").alias("file_timestamp"), "package_name", normalise.manager_record(F.col("package_manager")).alias("package_manager"),
        *((many("affected_version") if c == "version" else many("overview") if c == "attack_method" else F.lit(None).cast("array<string>")).alias(c) for c in LISTS),
        F.pmod(F.xxhash64("timestamp", "package_name"), F.lit(1 << 40)).alias("ingest_seq"), dates.day_of(F.col("update_date")).alias("_own"),
    )
    out = _facts(rows, links)
    return out.withColumn("post_date", normalise.or_else(F.col("post_date"), F.coalesce("_own", F.lit("")))).drop("_own")


def aggregate(records: DataFrame, mode: str = "reference") -> DataFrame:
    """One row per (manager, name): five fields by vote, the rest of the latest record (or united), sources and links united."""
    return resolve(records, ["package_manager", "package_name"], VOTED, MERGED, ["source", "source_link"], "post_date", "ingest_seq", mode)


def flat(records: DataFrame) -> DataFrame:
    """The twelve-column table: lists joined by a comma and a space, the day of the file."""
    texts = {c: nested.comma_text(F.col(c)) for c in LISTS}
    return records.select("package_name", "package_manager", *(texts[c].alias(c) for c in LISTS), dates.file_day(F.col("file_timestamp")).alias("day"), "source")


def front_end(table: DataFrame) -> DataFrame:
    """The flat table in the front end's names; rows without a package name go, dates and list literals are cleaned."""
    clean = lambda c: normalise.list_text(F.col(c))
    names = {"packageName": "package_name", "packageManager": "package_manager", "version": "version", "repositoryUrl": "repository_url", "attackMethod": "attack_method", "discoverer": "discoverer", "impactedSystems": "impacted_systems", "attackVector": "attack_vector", "iocs": "iocs", "source": "source"}
    out = table.select(*(clean(c).alias(n) for n, c in names.items()), dates.free(F.col("discovery_date")).alias("discoveryDate"), dates.free(F.col("day")).alias("timestamp"))
    return out.filter("packageName <> ''")


def report(table: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    """(measure, value, n): totals, managers, sources and recent rows of a flat table, in long form."""
    totals = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("measure"), F.lit("").alias("value"), "n")
    recent = table.filter(dates.recent(F.try_to_timestamp("day"), as_of)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("recent").alias("measure"), F.lit("").alias("value"), "n")
    tops = [stats.top(stats.counts(table.filter(F.col(c).isNotNull()), c), "n", k, c).select(F.lit(c).alias("measure"), F.col(c).alias("value"), "n") for c in ("package_manager", "source")]
    out = totals.unionByName(recent)
    for t in tops:
        out = out.unionByName(t)
    return out


def packages_per_manager(records: DataFrame) -> DataFrame:
    """Distinct packages of each manager, most first."""
    return records.groupBy("package_manager").agg(F.count_distinct("package_name").alias("n")).orderBy(F.desc("n"), "package_manager")


def lookups(table: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Rows of a registry table for the wanted names: the point look-ups of many packages as one semi join."""
    return table.join(names.select(name).distinct(), name, "left_semi")


def downloads(table: DataFrame, names: DataFrame, ts: str, first: Column, days: int = 3, name: str = "name") -> DataFrame:
    """(name, n): downloads of the wanted names in the days from `first` (both ends included)."""
    day = F.to_date(ts)
    return lookups(table, names, name).filter(day.between(first, F.date_add(first, days - 1))).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def multi_source(records: DataFrame, keys: Sequence[str] = ("package_manager", "package_name")) -> DataFrame:
    """Packages that more than one source names, with how many do."""
    return records.groupBy(*keys).agg(F.count_distinct("source").alias("n_sources")).filter("n_sources > 1")
