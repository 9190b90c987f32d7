"""Duplicates: one row per key with a defined survivor; nothing is ever deleted at the source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(rows: DataFrame, keys: Sequence[Column], order: Column, keep: str = "first") -> DataFrame:
    """One row per key: the least (first) or greatest (last) by `order`, all columns.

    An aggregation with map-side combining, not a window: a key with a third of the rows sends one row per task.
    """
    pick = F.min_by if keep == "first" else F.max_by
    whole = F.struct(*rows.columns)
    out = rows.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(pick(whole, order).alias("_r"))
    return out.select("_r.*")


def by_md5(rows: DataFrame, text: str, order: Column) -> DataFrame:
    return survivors(rows, [F.md5(F.col(text))], order)


def by_time(rows: DataFrame, time: str, order: Column) -> DataFrame:
    """One row per change, creation or access time, as file listings have them."""
    return survivors(rows, [F.col(time)], order)


def newest(rows: DataFrame, key: str, order: Column, most: int) -> DataFrame:
    """One row an id, and of these the `most` newest, in order (a feed read until it has so many rows)."""
    return survivors(rows, [F.col(key)], order, "last").orderBy(order.desc(), key).limit(most)


def by_size(rows: DataFrame, text: str, order: Column) -> DataFrame:
    return survivors(rows, [F.octet_length(F.col(text))], order)


def by_md5_and_size(rows: DataFrame, text: str, order: Column) -> DataFrame:
    return survivors(rows, [F.md5(F.col(text)), F.octet_length(F.col(text))], order)


def repeated(rows: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """Keys that occur at least so often, with their counts."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def override(tables: Sequence[DataFrame], key: str, line: str) -> DataFrame:
    """The union of tables in order: for each key the last line of the last table that has it."""
    ranked = [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t)
    return survivors(out, [F.col(key)], F.struct("_rank", line), "last").drop("_rank")
