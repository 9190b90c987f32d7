"""URLs: hosts, domains, origins and link filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens at either end that make a link worthless, and file endings that aren't pages.
IGNORE_ENDS = [".", "@", "/", "#", ".py", "wsr.", "mailto:", ".pdf", "javascript:", ".sh", "?", "**"]
IGNORE_ENDS_ADVISORY = [x for x in IGNORE_ENDS if x != ".pdf"]
FILE_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".pdf", ".zip", ".rar", ".py", ".java", ".cpp", ".js", ".ts", ".cs", ".php"]
INTEL_DOMAINS = [
    "phylum.io", "github.com", "reddit.com", "sonatype.com", "fortinet.com", "datadoghq.com", "medium.com", "checkmarx.com", "bleepingcomputer.com", "checkpoint.com", "cybersecuritynews.com", "jfrog.com",
    "qianxin.com", "reversinglabs.com", "rhisac.org", "securityaffairs.com", "snyk.io", "socket.io", "tuxcare.com", "twitter.com", "ycombinator.com",
]
# Two-label public suffixes under which a registered domain has three labels (a small offline table).
DOUBLE_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.cn", "com.au", "co.jp", "co.in", "com.br", "co.kr", "com.tr"]


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def last_labels(url: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def registered_domain(url: Column, double: Sequence[str] = DOUBLE_SUFFIXES) -> Column:
    """The domain under its public suffix; '' for what isn't a URL."""
    h = host(url)
    two, three = F.substring_index(h, ".", -2), F.substring_index(h, ".", -3)
    return F.coalesce(F.when(two.isin(*double), three).otherwise(two), F.lit(""))


def under_suffixes(rows: DataFrame, url: str, suffixes: DataFrame, column: str = "domain") -> DataFrame:
    """`rows` with the registered domain by a table of public suffixes ((word); see readers.word_list).

    The longest suffix that the host has counts, and the domain is one label more; without one, the last two labels.
    Hosts are met by equality on each of their endings, not by a pattern a suffix.
    """
    h, labels = host(F.col(url)), F.split(F.col("_host"), "\\.")
    hosts = rows.select(h.alias("_host")).filter("_host is not null").distinct()
    each = hosts.select("_host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_at", "_end"))
    known = each.join(suffixes.select(F.col("word").alias("_end")), "_end", "left_semi").groupBy("_host").agg(F.min("_at").alias("_at"))
    found = hosts.join(known, "_host", "left").select(F.col("_host").alias("_h"), F.coalesce(F.when(F.col("_at") > 0, F.array_join(F.slice(labels, F.col("_at"), F.size(labels)), ".")), F.substring_index("_host", ".", -2)).alias(column))
    return rows.join(found, host(F.col(url)) == F.col("_h"), "left").drop("_h").withColumn(column, F.coalesce(column, F.lit("")))


def origin(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))


def before(url: Column, marker: str) -> Column:
    return F.substring_index(url, marker, 1)


def in_text(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("https?://\\S+"), F.lit(0))


def at_either_end(text: Column, tokens: Sequence[str]) -> Column:
    """Whether the text starts or ends with one of the tokens."""
    hit = F.lit(False)
    for t in tokens:
        hit = hit | text.startswith(t) | text.endswith(t)
    return hit


def file_link(href: Column, endings: Sequence[str] = FILE_ENDINGS) -> Column:
    hit = F.lit(False)
    for e in endings:
        hit = hit | href.endswith(e)
    return hit
