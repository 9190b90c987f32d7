"""Names, managers and field values brought to one form (column expressions only)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of package managers.
ALIASES_SHORT = {"python": "pypi", "pip": "pypi"}
ALIASES_TWO = {"js": "npm", "javascript": "npm", "node": "npm", "nodejs": "npm", "python": "pypi", "pip": "pypi", "pypl": "pypi"}
ALIASES_ALL = ALIASES_TWO | {
    ".net": "nuget",
    "dotnet": "nuget",
    "java": "maven",
    "ruby": "rubygems",
    "gem": "rubygems",
    "php": "composer",
    "rust": "cargo",
}

# Accepted spellings of a record's fields; the first that is present counts.
NAME_KEYS = [
    "Package Name", "package name", "PackageName", "packagename", "package_name", "Package_Name", "PACKAGE_NAME", "PACKAGENAME",
    "Package Names", "package names", "PackageNames", "packagenames", "package_names", "Package_Names", "PACKAGE_NAMES", "PACKAGENAMES",
]
MANAGER_KEYS = [
    "Package Manager", "package manager", "PackageManager", "packagemanager", "package_manager", "Package_Manager", "PACKAGE_MANAGER", "PACKAGEMANAGER",
    "Package Managers", "package managers", "PackageManagers", "packagemanagers", "package_managers", "Package_Managers", "PACKAGE_MANAGERS", "PACKAGEMANAGERS",
]
VERSION_KEYS = ["Version", "version", "VERSION", "Package Version", "package version", "PackageVersion", "package_version", "Package_Version", "PACKAGE_VERSION"]


def alias(value: Column, table: Mapping[str, str]) -> Column:
    """The alias table's value, or the value itself; a literal map, so no join."""
    pairs = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))
    return F.coalesce(F.try_element_at(pairs, value), value)


def manager_record(value: Column) -> Column:
    """Null, '', unknown and n/a are `other`; pip and python are pypi; else lower case."""
    low = F.lower(value)
    return F.when(value.isNull() | low.isin("", "unknown", "n/a"), "other").otherwise(alias(low, ALIASES_SHORT))


def manager_first(values: Column) -> Column:
    """The first of a list of managers, lower case with pip and python as pypi; nothing there is `other`."""
    first = F.get(values, F.lit(0))
    return F.when(first.isNull() | (first == ""), "other").otherwise(alias(F.lower(first), ALIASES_SHORT))


def manager_ecosystem(value: Column, table: Mapping[str, str] = ALIASES_ALL) -> Column:
    """Trimmed lower case with ecosystem aliases; nothing there is `unknown`."""
    return F.when(value.isNull() | (value == ""), "unknown").otherwise(alias(F.trim(F.lower(value)), table))


def manager_two(value: Column) -> Column:
    """As manager_ecosystem, with the aliases of npm and pypi only."""
    return manager_ecosystem(value, ALIASES_TWO)


def without_names(rows: DataFrame, name: str, never: tuple[str, ...] = ("pip", "cctx")) -> DataFrame:
    """Rows whose name isn't one of the literal names that are no packages."""
    return rows.filter(F.coalesce(~F.col(name).isin(*never), F.lit(True)))


def of_type(rows: DataFrame, column: str, kind: str = "Malicious Package") -> DataFrame:
    return rows.filter(F.col(column) == kind)


def filled(values: Column) -> Column:
    """The elements that hold something: not null, '' or the word null."""
    return F.filter(values, lambda x: x.isNotNull() & ~x.isin("", "null"))


def lowered(values: Column) -> Column:
    return F.transform(values, lambda x: F.lower(x))


def vote_key(values: Column) -> Column:
    """What makes two values the same vote: a list's elements sorted and joined by commas (a scalar is a list of one)."""
    return F.array_join(F.array_sort(values), ",")


def or_else(value: Column, other: Column) -> Column:
    """The value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), other)


def without(values: Column, banned: Sequence[str]) -> Column:
    """The elements outside a list, repeats kept (array_except would drop them)."""
    return F.filter(values, lambda x: ~x.isin(*banned))


def within(values: Column, wanted: Sequence[str]) -> Column:
    return F.filter(values, lambda x: x.isin(*wanted))


def plausible_name(name: Column, stop: Sequence[str], bad: Sequence[str]) -> Column:
    """More than two characters, word characters and hyphens only, no stop word, no bad part."""
    clean = F.lit(True)
    for part in bad:
        clean = clean & ~name.contains(part)
    return (F.length(name) > 2) & name.rlike("^[a-zA-Z0-9_-]+$") & ~name.isin(*stop) & clean


def list_text(value: Column) -> Column:
    """A list literal such as ['a', 'b'] as comma text, anything else trimmed; null is ''. Nothing is evaluated."""
    body = F.regexp_replace(F.regexp_replace(value, "^\\['?|'?\\]$", ""), "'\\s*,\\s*'", ", ")
    return F.when(value.isNull(), "").when(value.rlike("^\\[.*\\]$"), body).otherwise(F.trim(value))


def literal_list(value: Column) -> Column:
    """A list literal as array<string>; anything that isn't one is null."""
    quoted = F.regexp_replace(value, "'", '"')
    return F.when(value.rlike("^\\s*\\[.*\\]\\s*$"), F.from_json(quoted, "array<string>"))
