"""Sharding by sampled splitters: quantiles of a size-weighted sample of keys cut ranges, overfull ranges are cut again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tamarack.llm.common import materialize
from tamarack.llm.ranking import ranked

#: Ranges a shard, sampled keys a range, and the share of a shard's bytes beyond which a range is overfull.
RANGES, DRAWS, OVERFULL = 256, 16, 1 / 128
#: The least second key: a splitter with it lies before all rows of its first key.
LEAST = -(1 << 63)


@dataclass
class Splitters:
    """Ascending (first, second) keys; a row's range is the number of splitters that aren't above its own keys.

    shards: the shard of each range."""

    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    second: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shards: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))

    def ranges(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """By the first key, then by bisection among the splitters that share it (several only where a key is cut)."""
        low, high = np.searchsorted(self.first, first, "left"), np.searchsorted(self.first, first, "right")
        while (open_ := low < high).any():
            mid = (low + high) // 2
            above = np.zeros(len(first), bool)
            above[open_] = self.second[mid[open_]] > second[open_]
            high = np.where(open_ & above, mid, high)
            low = np.where(open_ & ~above, mid + 1, low)
        return low

    def with_more(self, keys: set[tuple[int, int]]) -> Splitters:
        every = np.array(sorted({*zip(self.first.tolist(), self.second.tolist()), *keys}), np.int64).reshape(-1, 2)
        return Splitters(every[:, 0].copy(), every[:, 1].copy())

    def __len__(self) -> int:
        return len(self.first)

    def column(self, first: Column, second: Column, shard: bool = False) -> Column:
        """The range, or the shard, of a row as a column; only two numbers a row go to Python."""

        @F.pandas_udf(IntegerType())
        def find(a: pd.Series, b: pd.Series) -> pd.Series:
            at = self.ranges(a.to_numpy(), b.to_numpy())
            return pd.Series((self.shards[at] if shard else at).astype(np.int32))

        return find(first, second)


def _cut(sample: np.ndarray, pieces: int) -> set[tuple[int, int]]:
    """About `pieces` - 1 splitters at the quantiles of a sorted sample of (first, second), each before a first key, so
    rows that share one stay together."""
    return {(int(a), LEAST) for a in sample[np.arange(1, pieces) * len(sample) // pieces, 0]} if len(sample) else set()


def _cut_again(sample: np.ndarray, size: int, limit: float) -> set[tuple[int, int]]:
    """Splitters within an overfull range, from a sorted sample of its keys.

    A first key with more than half of the limit (by its share of the sample) gets a range of its own, and one that is
    over the limit, or alone in the sample, is cut within its rows.
    """
    if not len(sample):
        return set()
    out = _cut(sample, int(2 * size / limit) + 2)
    firsts, at, counts = np.unique(sample[:, 0], return_index=True, return_counts=True)
    for a, i, n in zip(firsts.tolist(), at, counts):
        share = size * n / len(sample)
        if share > limit / 2 or len(firsts) == 1:
            out |= {(a, LEAST), (a + 1, LEAST)} if a < (1 << 63) - 1 else {(a, LEAST)}
        if share > limit or len(firsts) == 1:
            pieces = int(2 * share / limit) + 2
            out |= {(a, int(b)) for b in sample[i + np.arange(1, pieces) * n // pieces, 1]}
    out.add((int(firsts[-1]), LEAST))  # not the least of several keys, so the range is cut in any case
    return out


def splitters(rows: DataFrame, shards: int, ranges: int = RANGES, draws: int = DRAWS, overfull: float = OVERFULL) -> Splitters:
    """Splitters and their shards for rows (first, second, size).

    `ranges` times `shards` quantile ranges come from a sample of about `draws` keys a range, drawn without replacement with
    odds in proportion to the size (exponential variates over sizes that are under a common bound, seeded by the keys: the
    same at any partitioning). The bound is set by the bytes in all, so tasks send the sample and nothing else, however many
    they are. All ranges are then measured. Those with more than `overfull` of a shard's bytes are sampled by
    themselves and cut again, between keys and within keys that are too large alone, until none is left that has two rows
    with other keys. The driver holds about shards * ranges * draws sampled keys (or 32 * shards / overfull, if that is
    more), 16 bytes each, and the ranges' sizes.
    """
    most = shards * ranges * draws
    # a draw in (0, 1) of 52 bits from the keys; heavier rows come earlier
    u = (F.pmod(F.xxhash64(F.lit("splitters"), "first", "second"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    race = rows.select("first", "second", (-F.log(u) / F.col("size")).alias("turn"))

    def drawn(of: DataFrame, size: int, most: float) -> np.ndarray:
        """At most `most` keys on average, and about as many where no row is large."""
        got = of.filter(F.col("turn") < most / max(1, size)).select("first", "second").toPandas()
        return np.array(sorted(set(zip(got["first"].tolist(), got["second"].tolist()))), np.int64).reshape(-1, 2)

    total = int(rows.agg(F.sum("size")).first()[0] or 0)
    cuts = Splitters().with_more(_cut(drawn(race, total, most), shards * ranges))
    while True:
        at = cuts.column(F.col("first"), F.col("second"))
        measured = rows.groupBy(at.alias("range")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).toPandas()
        sizes = np.zeros(len(cuts) + 1, np.int64)
        sizes[measured["range"].to_numpy(np.int64)] = measured["size"].to_numpy(np.int64)
        counts = np.zeros(len(cuts) + 1, np.int64)
        counts[measured["range"].to_numpy(np.int64)] = measured["rows"].to_numpy(np.int64)
        limit = sizes.sum() / shards * overfull
        full = np.flatnonzero((sizes > limit) & (counts > 1))
        more: set[tuple[int, int]] = set()
        if len(full):
            inside = race.withColumn("range", at).filter(F.col("range").isin(full.tolist()))
            held = int(sizes[full].sum())
            sample = drawn(inside, held, max(most, 32 * held / limit))  # 32 keys or more a range, but where a row is large
            place = cuts.ranges(sample[:, 0], sample[:, 1])
            for r in full:
                more |= _cut_again(sample[place == r], int(sizes[r]), limit)
        grown = cuts.with_more(more)
        if len(grown) == len(cuts):
            break
        cuts = grown
    # a range goes to the shard that holds the middle of it
    middle = np.cumsum(sizes) - sizes / 2
    cuts.shards = np.minimum((middle * shards / max(1, sizes.sum())).astype(np.int64), shards - 1).astype(np.int32)
    return cuts


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, size, text_crc32, first, second): copies of a text share the first key, the second tells rows apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("first"), F.monotonically_increasing_id().alias("_row"))
    return rows.select("id", "size", "text_crc32", "first", F.xxhash64("id", "_row").alias("second"))


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """A row per document: id, size, text_crc32, shard, slot (its place in the shard, without gaps).

    The size is the text's UTF-8 bytes plus one, a null text counts as empty. Keys are hashes of the text, so copies of a
    text are in one range and one shard, unless their range is overfull and cut within. Shards are runs of ranges, equal
    in bytes up to half a range at each end (and a single document's size, as documents aren't split): `overfull` (1/128)
    of a shard. Rows with equal ids, repeated rows and null ids are rows by themselves. Fewer rows than shards leave shards
    empty, and an empty table has no rows. Other columns play no part. Shards of any size are ranked by a range sort.
    """
    rows = materialize(_keyed(docs, doc_id, text), "keyed")
    cuts = splitters(rows, shards, **how)
    placed = rows.withColumn("shard", cuts.column(F.col("first"), F.col("second"), True))
    out = ranked(placed, "shard", ["first", "second"], "placed")
    return out.select("id", "size", "text_crc32", "shard", F.col("index").alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 8, doc_id: str = "doc_id", text: str = "text", **how: float) -> None:
    """The documents as Parquet below `path`, a folder shard=<number> for each shard, in order of their keys within it.

    Large shards are several files. Rows are numbered in a stored copy, so that a task that runs again sees the same keys.
    """
    mark = f"_{uuid.uuid4().hex}"
    names = [f"{mark}_{i}" for i in range(len(docs.columns))]
    own = materialize(docs.toDF(*names).withColumn(mark, F.monotonically_increasing_id()), "numbered")
    at = dict(zip(docs.columns, names))
    body = F.coalesce(F.col(at[text]).cast("string"), F.lit(""))
    own = own.withColumn("first", F.xxhash64(body)).withColumn("second", F.xxhash64(at[doc_id], mark))
    cuts = splitters(materialize(own.select("first", "second", (F.octet_length(body) + 1).cast("long").alias("size")), "keyed"), shards, **how)
    placed = own.withColumn(f"{mark}_shard", cuts.column(F.col("first"), F.col("second"), True))
    placed = placed.repartitionByRange(f"{mark}_shard", "first", "second").sortWithinPartitions(f"{mark}_shard", "first", "second")
    kept = [c for c in docs.columns if c != "shard"]
    placed.select(*(F.col(at[c]).alias(c) for c in kept), F.col(f"{mark}_shard").alias("shard")).write.partitionBy("shard").parquet(path)
