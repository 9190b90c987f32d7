"""Knowledge triples written as [SUBJECT:a, RELATION:b, OBJECT:c], and package names found in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of triples whose subject or object is a package, and words that never are one.
PACKAGE_PATTERNS = [
    r"\[SUBJECT:([^,\]]+), RELATION:is, OBJECT:malicious (?:npm|pypi|python) package\]",
    r"\[SUBJECT:([^,\]]+), RELATION:(?:is|contains), OBJECT:malicious (?:npm|pypi|python) package\]",
    r"\[SUBJECT:malicious (?:npm|pypi|python) package, RELATION:masquerades, OBJECT:([^,\]]+)\]",
    r"\[SUBJECT:malicious package, RELATION:masquerades, OBJECT:([^,\]]+)\]",
    r"\[SUBJECT:([^,\]]+), RELATION:(?:designed to|steals|contains), OBJECT:[^,\]]+\]",
    r"\[SUBJECT:([^,\]]+), RELATION:(?:published|hosted|available), OBJECT:[^,\]]+\]",
    r"\[SUBJECT:([^,\]]+), RELATION:(?:claimed to provide|downloaded), OBJECT:[^,\]]+\]",
    r"\[SUBJECT:([^,\]]+), RELATION:version, OBJECT:[^,\]]+\]",
    r"\[SUBJECT:([^,\]]+), RELATION:published, OBJECT:[^,\]]+\]",
    r"masquerades, OBJECT:([^,\]]+)",
    r"\[SUBJECT:([a-zA-Z0-9_-]+), RELATION:(?:is|contains|steals), OBJECT:(?:malicious|sensitive)",
]
NOT_PACKAGES = [
    "the", "a", "an", "this", "that", "these", "those", "it", "they", "them", "malicious", "vulnerable", "package", "packages",
    "module", "modules", "library", "libraries", "dependency", "dependencies", "code", "software",
]


def parts(text: Column) -> Column:
    """array<struct<sub, rel, obj>> of a text of bracketed triples, labels off; brackets with other than three parts are left out."""
    inner = F.regexp_extract_all(text, F.lit("\\[([^\\[\\],]*,[^\\[\\],]*,[^\\[\\],]*)\\]"), F.lit(1))

    def one(x: Column) -> Column:
        bare = F.transform(F.split(x, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), "^(?:SUBJECT|RELATION|OBJECT)\\s*:", "")))
        return F.struct(bare[0].alias("sub"), bare[1].alias("rel"), bare[2].alias("obj"))

    return F.transform(inner, one)


def sentence(sub: Column, rel: Column, obj: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(" ", sub, rel, obj), " +", " "))


def packages(text: Column, patterns: Sequence[str] = PACKAGE_PATTERNS, never: Sequence[str] = NOT_PACKAGES) -> Column:
    """Distinct lower-case names by the patterns; where none fits, any subject or object not starting with `the `."""
    hits = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns)))
    loose = F.concat(F.regexp_extract_all(text, F.lit("SUBJECT:([^,]+)"), F.lit(1)), F.regexp_extract_all(text, F.lit("OBJECT:([^,\\]]+)"), F.lit(1)))
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    any_entity = F.filter(clean(loose), lambda x: (F.length(x) > 1) & ~x.startswith("the "))
    found = F.when(F.size(clean(hits)) > 0, clean(hits)).otherwise(any_entity)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.isin(*never) & (F.length(x) > 1))))


def manager_guess(text: Column) -> Column:
    low = F.lower(text)
    npm = low.contains("npm") | low.contains("node package") | low.contains("javascript")
    return F.when(npm, "npm").when(low.contains("pypi") | low.contains("python"), "pypi").otherwise("other")


# How a name stands in prose: in quotes, before a version, after `library` or `package`. Case is ignored.
NAME_PATTERNS = [
    r'"([a-zA-Z0-9_-]+)"',
    r"'([a-zA-Z0-9_-]+)'",
    r"`([a-zA-Z0-9_-]+)`",
    r"([a-zA-Z0-9_-]+)\s+\(version\s+([0-9.]+)\)",
    r"([a-zA-Z0-9_-]+)-([0-9.]+)",
    r"([a-zA-Z0-9_-]+)\s+version\s+([0-9.]+)",
    r"([a-zA-Z0-9_-]+)\s+v([0-9.]+)",
    r'library\s+"([a-zA-Z0-9_-]+)"',
    r'package\s+"([a-zA-Z0-9_-]+)"',
    r"library\s+'([a-zA-Z0-9_-]+)'",
    r"package\s+'([a-zA-Z0-9_-]+)'",
    r"library\s+([a-zA-Z0-9_-]+)",
    r"package\s+([a-zA-Z0-9_-]+)",
]


def named_in_text(text: Column, never: Sequence[str] = (), known: Sequence[str] = (), patterns: Sequence[str] = NAME_PATTERNS) -> Column:
    """Distinct lower-case names of three or more characters by the patterns; `known` names wherever they occur."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1)) for p in patterns)))
    found = F.filter(F.transform(found, lambda x: F.lower(x)), lambda x: (F.length(x) > 2) & (~x.isin(*never) if never else F.lit(True)))
    listed = F.filter(F.array(*(F.lit(k) for k in known)).cast("array<string>"), lambda k: F.lower(text).contains(k))
    return F.array_sort(F.array_distinct(F.concat(found, listed)))
