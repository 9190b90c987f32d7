"""Writers, each a thin form of DataFrameWriter with the layout readers expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Append rows as CSV with a header in every file."""
    (rows.select(*columns) if columns else rows).write.mode("append").option("header", "true").option("escape", '"').csv(path)


def tagged_csv(rows: DataFrame, path: str, key: str, tag: str) -> None:
    """CSV whose ids are texts (`tag:id`), so that no reader rounds long numbers."""
    append_csv(rows.select(*(F.concat(F.lit(f"{tag}:"), F.col(c).cast("string")).alias(c) if c == key else F.col(c) for c in rows.columns)), path)


def tee(rows: DataFrame, path: str, show=print) -> None:
    """A report, whose size is its own bound, shown line by line and kept as text in the same order."""
    lines = ["\t".join(rows.columns), *("\t".join("" if v is None else str(v) for v in r) for r in rows.collect())]
    for line in lines:
        show(line)
    spark = rows.sparkSession
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def overwrite_json(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").json(path)


def outputs(rows: DataFrame, path: str, by: Sequence[str] = ("source", "model", "prompt", "step")) -> None:
    """Text results in folders by their keys, so that later reads prune."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def json_document(rows: DataFrame, order: str, most: int = 1_000_000) -> DataFrame:
    """One row with a JSON array of all rows in order: for reports. Over `most` rows it is an error, found before any is gathered."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a document of more than {most} rows: write JSON lines")
    whole = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rows.columns).alias("r"))))
    return rows.agg(F.to_json(F.transform(whole, lambda s: s["r"])).alias("json"))


def bucketed(rows: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """A table bucketed and sorted by its join keys, and read back: joins and groups on them need no exchange.

    Tables that are joined need the same number of buckets. With `path` the files lie there, not in the warehouse.
    """
    out = rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (out.option("path", path) if path else out).saveAsTable(name)
    return rows.sparkSession.table(name)
