"""Extractors by source as a table function: pages go in as a table, partitioned by their source, and records come out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: What an extractor makes of a page: (kind, text) records in order.
Extractor = Callable[[str], Iterable[tuple[str, str]]]


def extract_by_source(pages: DataFrame, extractors: dict[str, Extractor], key: str, source: str = "source", html: str = "html", shares: int = 16) -> DataFrame:
    """(key, source, pos, kind, text, error): the records that each page's own extractor finds, in order from 0.

    A page of a source without an extractor, or with a null source, is one row with the error `no extractor`; a page on
    which its extractor fails is one row with the failure, and none of the records before it. A page without records has
    no row. The function's `analyze` takes the key's type from its input and asks for partitions by source and share, so
    an extractor is looked up once a partition, and a source with a third of all pages lies in `shares` partitions.
    """
    table = dict(extractors)

    class Extract:
        @staticmethod
        def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in pages.dataType}
            out = StructType().add("key", kinds["key"]).add("source", StringType()).add("pos", IntegerType()).add("kind", StringType()).add("text", StringType()).add("error", StringType())
            return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("source"), PartitioningColumn("share")], orderBy=[OrderingColumn("key")])

        def __init__(self) -> None:
            self.source, self.find = None, None

        def eval(self, row: object) -> Iterator[tuple]:
            if self.find is None or row["source"] != self.source:
                self.source, self.find = row["source"], table.get(row["source"])
            if self.find is None:
                yield row["key"], row["source"], None, None, None, "no extractor"
                return
            try:
                found = list(self.find(row["html"] or ""))
            except Exception as e:  # noqa: BLE001
                yield row["key"], row["source"], None, None, None, f"{type(e).__name__}: {e}"
                return
            for i, (kind, text) in enumerate(found):
                yield row["key"], row["source"], i, kind, text, None

    share = F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("share")
    rows = pages.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(html).alias("html"), share)
    return udtf(Extract)(rows.asTable()).withColumnRenamed("key", key)
