"""Nearest vectors by locality: signed random projections in several tables, near buckets probed, candidates compared exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.operators import blocks
from tamarack.session import stored


def projections(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """(tables, dims, bits) normal deviates: a bit of a code is the sign of a product with one of them."""
    return np.random.default_rng(seed).standard_normal((tables, dims, bits))


def probes(margins: np.ndarray, most: int) -> np.ndarray:
    """(rows, most): sets of bits to flip, likeliest first, for (rows, bits) margins of one table.

    A neighbour differs most likely in the bits whose products are nearest to zero, so a set costs the sum of its squared
    margins. Sets are made of the bits in order of cost: only the best `most` sets are kept after each bit, which is exact,
    as a set with a bit is never cheaper than the set without it.
    """
    cost, order = np.sort(margins**2, 1), np.argsort(margins**2, 1, kind="stable")
    best, flips = np.zeros((len(margins), 1)), np.zeros((len(margins), 1), np.int64)
    for j in range(margins.shape[1]):
        best = np.concatenate([best, best + cost[:, j : j + 1]], 1)
        flips = np.concatenate([flips, flips | (np.int64(1) << order[:, j : j + 1])], 1)
        keep = np.argsort(best, 1, kind="stable")[:, :most]
        best, flips = np.take_along_axis(best, keep, 1), np.take_along_axis(flips, keep, 1)
    return flips


class Shared:
    """Which rows share a bucket with which queries: the queries that look into a bucket are bits, a byte for eight."""

    def __init__(self, q: np.ndarray, planes: np.ndarray, most: int) -> None:
        self.planes = planes
        self.bits = planes.shape[2]
        self.looks = np.zeros((len(planes), 1 << self.bits, -(-len(q) // blocks.QUERIES) * blocks.QUERIES // 8), np.uint8)
        for t, plane in enumerate(planes):
            products = q @ plane
            codes = self._codes(products)[:, None] ^ (probes(products, most) if most > 1 and len(q) else np.zeros((len(q), 1), np.int64))
            for j in range(codes.shape[1]):
                i = np.arange(len(q))
                np.bitwise_or.at(self.looks[t], (codes[:, j], i // 8), (128 >> (i % 8)).astype(np.uint8))

    def _codes(self, products: np.ndarray) -> np.ndarray:
        return (products > 0) @ (np.int64(1) << np.arange(self.bits))

    def __call__(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """(queries first to last, rows)."""
        found = np.zeros((len(x), -(-(last - first) // 8)), np.uint8)
        for looks, plane in zip(self.looks, self.planes):
            found |= looks[self._codes(x @ plane), first // 8 : first // 8 + found.shape[1]]
        return np.unpackbits(found, axis=1)[:, : last - first].T.astype(bool)


def close_neighbours(queries: DataFrame, table: DataFrame, key: str, vector: str, k: int = 5, dims: int = 64, tables: int = 24, bits: int = 8, most: int = 16, digits: int = 6, seed: int = 17, block: int = 1 << 16) -> DataFrame:
    """(query, match, similarity, rank): the k most similar rows for each query, by cosine, among those it shares a bucket with.

    Queries look into their own bucket of every table and `most` - 1 near ones; what they meet is compared exactly, so a
    result's similarity is right and only a neighbour that no bucket holds is missed. More tables or probes raise recall,
    more bits (about the logarithm of the rows) lower the work. Rows of other than `dims` components, with a null or
    non-finite one, or of length zero have no direction and are in no result. No pair counts but through equal buckets,
    and none is a row: a task holds a block of queries' buckets as bits and passes on the k + 1 best entries of each query.

    Equal vectors are one entry in the tables, so a group of copies with a third of all rows is one candidate; its k + 1
    smallest keys stand for it, as no more can be among k results (one may be the query itself).
    """
    sound = (F.size(vector) == dims) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = table.filter(sound & F.col(key).isNotNull()).select(F.col(key).alias("match"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    few = Window.partitionBy("v").orderBy("match")
    same = rows.withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= k + 1)  # a group limit: each task passes on k + 1
    entries = same.groupBy("v").agg(F.array_sort(F.collect_list("match")).alias("members"))
    entries = stored(entries.withColumn("entry", F.col("members")[0]).repartition(table.sparkSession.sparkContext.defaultParallelism), "entries")
    asked = stored(queries.filter(sound & F.col(key).isNotNull()).select(F.col(key).alias("query"), F.transform(vector, lambda v: v.cast("double")).alias("q")), "asked")
    n, found = -(-asked.count() // block), None
    for i in range(max(n, 1)):
        some = asked.filter(F.pmod(F.xxhash64("query"), F.lit(max(n, 1))) == i)
        one = blocks.best(entries.select(F.col("entry").alias("match"), "v"), some, dims, k + 1, digits, lambda q: Shared(q, projections(dims, tables, bits, seed), most), True)
        one = stored(one, "near") if n > 1 else one  # a block's queries leave the driver with it
        found = one if found is None else found.unionByName(one)
    near = Window.partitionBy("query").orderBy(F.desc("similarity"), "match")
    few = found.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k + 1).select("query", F.col("match").alias("entry"), "similarity")
    scored = few.join(entries.select("entry", "members"), "entry")
    each = scored.select("query", "similarity", F.explode("members").alias("match")).filter("query <> match")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "match")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "match", "similarity", "rank")
