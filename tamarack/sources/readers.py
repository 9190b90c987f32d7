"""Readers: every input as a DataFrame with a declared schema; paths go to Spark alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack import schema
from tamarack.functions.dates import file_timestamp
from tamarack.operators.dedupe import override


def links(spark: SparkSession, path: str) -> DataFrame:
    """A link queue: headerless tab-separated timestamp, source, date, link; every field trimmed."""
    rows = spark.read.schema(schema.LINKS).option("sep", "\t").option("quote", "").csv(path)
    return rows.select(*(F.trim(c).alias(c) for c in rows.columns)).filter("link is not null")


def collected_links(spark: SparkSession, path: str) -> DataFrame:
    """(source, link) of collected links, in rows of three or four fields: counted from the end."""
    parts = F.split("value", "\t")
    return spark.read.text(path).select(F.trim(F.try_element_at(parts, F.lit(-3))).alias("source"), F.trim(F.try_element_at(parts, F.lit(-1))).alias("link")).filter("source is not null")


def link_facts(spark: SparkSession, waiting: str, collected: str) -> DataFrame:
    """(timestamp, date, link) of both queues, one row a timestamp; the collected one and later lines override."""
    tables = []
    for p in (waiting, collected):
        rows = spark.read.text(p).withColumn("line", F.monotonically_increasing_id()).withColumn("_p", F.split(F.trim("value"), "\t"))
        rows = rows.filter(F.size("_p") >= 4).select(F.trim(F.col("_p")[0]).alias("timestamp"), F.trim(F.col("_p")[2]).alias("date"), F.trim(F.col("_p")[3]).alias("link"), "line")
        tables.append(rows)
    return override(tables, "timestamp", "line").drop("line")


def indexed_links(rows: DataFrame, line: str = "timestamp") -> DataFrame:
    """Links with a running number per source. A source's queue is its own partition: it is a list of links, not of pages."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("source").orderBy(line)))


def _segment(back: int) -> Column:
    """The path segment so many places from the end (1 is the file name)."""
    return F.try_element_at(F.split(F.col("_metadata.file_path"), "/"), F.lit(-back))


def documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, source, file_timestamp, size, modified, text): a row per text file below the folder."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.regexp_replace(_segment(1), "\\.[^.]*$", "")
    return raw.select(name.alias("file"), _segment(2).alias("source"), file_timestamp(name).alias("file_timestamp"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def model_outputs(spark: SparkSession, path: str, step: str = "verify", depth: Sequence[str] = ("source", "model", "prompt")) -> DataFrame:
    """(*depth, file, file_timestamp, text): extraction outputs of one step; folders above the file become columns."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{step}*.json").text(path, wholetext=True)
    levels = [_segment(len(depth) + 1 - i).alias(c) for i, c in enumerate(depth)]
    return raw.select(*levels, _segment(1).alias("file"), file_timestamp(_segment(1)).alias("file_timestamp"), F.col("value").alias("text"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """A row per element of JSON array files, as VARIANT, so that types may drift."""
    raw = spark.read.text(path, wholetext=True).withColumn("_v", F.try_parse_json("value"))
    return raw.select(F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("seq", "record"))


def json_lines(spark: SparkSession, path: str, columns: str = schema.REGISTRY) -> DataFrame:
    return spark.read.schema(columns).option("mode", "PERMISSIVE").json(path)


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """(manager, name, published) of a tree manager/package/*.json; a row per affected package."""
    raw = spark.read.schema(schema.OSV).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    rows = raw.select(_segment(3).alias("manager"), F.split_part("published", F.lit("T"), F.lit(1)).alias("published"), F.explode("affected").alias("a"))
    return rows.select("manager", F.coalesce("a.package.name", F.lit("NA")).alias("name"), "published")


def registry_pages(spark: SparkSession, path: str) -> DataFrame:
    """(name, created) of registry answers: JSON, or HTML with the JSON in a paragraph."""
    raw = spark.read.text(path, wholetext=True)
    body = F.coalesce(F.nullif(F.regexp_extract("value", "(?s)<p[^>]*>(.*)</p>", 1), F.lit("")), F.col("value"))
    v = F.try_parse_json(body)
    return raw.select(F.try_variant_get(v, "$.name", "string").alias("name"), F.coalesce(F.try_variant_get(v, "$.time.created", "string"), F.lit("NA")).alias("created"))


def csv_table(spark: SparkSession, path: str, columns: str | None = None, header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, or a positional one with a declared schema; short and long rows are tolerated."""
    reader = spark.read.option("header", str(header).lower()).option("encoding", encoding).option("multiLine", "true").option("escape", '"')
    return (reader.schema(columns) if columns else reader).csv(path)


def search_results(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, schema.SEARCH_RESULTS, header=False)


def advisory_links(spark: SparkSession, path: str) -> DataFrame:
    return csv_table(spark, path, schema.ADVISORY_LINKS, header=False, encoding="ISO-8859-1")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): a list of stop words or public suffixes, one a line, lower-case; blank lines and comments are left out."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).select(word.alias("word")).filter((F.col("word") != "") & ~F.col("word").startswith("#") & ~F.col("word").startswith("//")).distinct()


def article_id(html: Column) -> Column:
    """The first article id in a page's scripts: a newsList entry, else any id field."""
    first = F.regexp_extract(html, '(?s)newsList.*?"id"\\s*:\\s*"?(\\d+)', 1)
    other = F.regexp_extract(html, '"id"\\s*:\\s*"?(\\d+)', 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(other, F.lit("")))


def status(files: DataFrame, by: str = "source") -> DataFrame:
    """Files, bytes and the latest change per source."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.max("modified").alias("last_modified"))
