"""HTML: links, headings, text and paragraphs by expressions; nested structure by a parser over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tamarack.functions import pagetree


def hrefs(html: Column) -> Column:
    """Targets of links, in order; attributes in double, single or no quotes, tags in any case."""
    found = F.regexp_extract_all(html, F.lit("(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def headings(html: Column) -> Column:
    """Texts of h1 to h3, in order, inner tags off."""
    found = F.regexp_extract_all(html, F.lit("(?s)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1))
    return F.transform(found, lambda x: squeezed(F.regexp_replace(x, "(?s)<[^>]*>", " ")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def headers(pages: pd.Series) -> pd.Series:
    """Texts of h1 to h3, then of other elements whose class has `header`."""
    return pages.map(lambda p: pagetree.header_titles(pagetree.Tree(p or "")))


@F.pandas_udf(T.StringType())
def summary(pages: pd.Series) -> pd.Series:
    """The article's body, a line a block (see pagetree.article)."""
    return pages.map(lambda p: "\n".join(pagetree.article(pagetree.Tree(p or ""))[2]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def code_blocks(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: pagetree.code_texts(pagetree.Tree(p or "")))


def paragraphs(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit("(?s)<p(?:\\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.transform(found, lambda x: squeezed(F.regexp_replace(x, "(?s)<[^>]*>", " ")))


def visible_text(html: Column) -> Column:
    """The text without scripts, styles, comments and tags, white space squeezed."""
    bare = F.regexp_replace(html, "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return squeezed(F.regexp_replace(bare, "(?s)<[^>]*>", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))


def top_titles(html: Column, low: int = 4, high: int = 50, n: int = 3) -> Column:
    """The n longest headings of low to high words, longest first, earlier first among equals."""
    return fit_titles(headings(html), low, high, n)


def fit_titles(titles: Column, low: int = 4, high: int = 50, n: int = 3) -> Column:
    scored = F.transform(titles, lambda x, i: F.struct((-word_count(x)).alias("k"), i.alias("i"), x.alias("t")))
    fit = F.filter(scored, lambda s: (-s["k"] >= low) & (-s["k"] <= high))
    return F.transform(F.slice(F.array_sort(fit), 1, n), lambda s: s["t"])


def context_paragraphs(pages: DataFrame, key: str, html: str = "html", window: int = 3, least: int = 10) -> DataFrame:
    """(key, pos, paragraph): paragraphs over `least` words with another such one within `window` before and after.

    A frame per page: a page's paragraphs are its own, so no partition grows with the table.
    """
    rows = pages.select(key, F.posexplode(paragraphs(F.col(html))).alias("pos", "paragraph")).withColumn("n", word_count(F.col("paragraph")))
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("_b", F.max("n").over(w.rowsBetween(-window, -1))).withColumn("_a", F.max("n").over(w.rowsBetween(1, window)))
    return rows.filter((F.col("n") >= least) & (F.col("_b") > least) & (F.col("_a") > least)).select(key, "pos", "paragraph")


def blocks_of(html: str | None) -> list[dict[str, str]]:
    """Ordered text blocks of one page (see pagetree.kept_blocks)."""
    return [{"kind": k, "text": t} for k, t in pagetree.kept_blocks(pagetree.Tree(html or ""))]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
def blocks(pages: pd.Series) -> pd.Series:
    return pages.map(blocks_of)
