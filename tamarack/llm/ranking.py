"""Places of rows within their group, however large a group is: a range sort, counts per sorted piece, and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.llm.common import materialize


def ranked(df: DataFrame, group: str, order: list[str], tag: str = "ranked") -> DataFrame:
    """The rows with key, index and n: a number of the row, its place in its group (from 0, by `order`), the group's size.

    Rows are range-partitioned by group and order, so a group with a third of all rows lies in many partitions, and rows
    alike in all of these are told apart by their place in the scan. Only (group, partition) counts are accumulated, one
    row a piece. Nulls come first, also as a group. The names key, index and n must be free. An empty table stays empty.
    """
    by = [F.col(group), *(F.col(c) for c in order)]
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*by, F.col("_tie")).sortWithinPartitions(*by, F.col("_tie")).drop("_tie")
    rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), tag)
    part = F.shiftright("key", 33)  # the partition's number is in the upper bits
    pieces = rows.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.min("key").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    out = rows.join(pieces, rows[group].eqNullSafe(pieces["_g"]) & (part == pieces["_part"]))
    return out.select(*(rows[c] for c in df.columns), "key", (F.col("key") + F.col("_shift")).alias("index"), "n")
