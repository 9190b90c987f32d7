"""Triples as a graph: edges, vertices, neighbours by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions.vectors import cosine
from tamarack.operators import blocks
from tamarack.session import stored


def edges(triples: DataFrame, sub: str, obj: str, seq: str) -> DataFrame:
    """One row per (sub, obj): the last written."""
    return triples.groupBy(F.col(sub).alias("_s"), F.col(obj).alias("_o")).agg(F.max_by(F.struct(*triples.columns), seq).alias("_r")).select("_r.*")


def vertices(triples: DataFrame, sub: str, obj: str, sub_kind: str, obj_kind: str, seq: str) -> DataFrame:
    """(name, kind): every subject and object with the kind it had last."""
    both = triples.select(F.col(sub).alias("name"), F.col(sub_kind).alias("kind"), F.col(seq).alias("_q"), F.lit(0).alias("_e")).unionByName(triples.select(F.col(obj).alias("name"), F.col(obj_kind).alias("kind"), F.col(seq).alias("_q"), F.lit(1).alias("_e")))
    return both.filter("name is not null").groupBy("name").agg(F.max_by("kind", F.struct("_q", "_e")).alias("kind"))


def typed(triples: DataFrame, kinds: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """sub_kind and obj_kind from a dictionary of entities; names with cve are `cve`, unknown ones null."""
    out = triples
    for end in ("sub", "obj"):
        side = kinds.select(F.col(name).alias(end), F.col(kind).alias("_k"))
        out = out.join(side, end, "left").withColumn(f"{end}_kind", F.when(F.lower(end).contains("cve"), "cve").otherwise(F.col("_k"))).drop("_k")
    return out


def neighbours(queries: DataFrame, table: DataFrame, key: str, vector: str, k: int = 5, digits: int = 6, block: int = 1 << 16) -> DataFrame:
    """(query, match, similarity, rank): the k most similar rows of `table` for each query, by cosine; exact.

    The queries (a stated set, or every row) are compared with all rows, a block of about `block` queries at a time, by products in
    numpy (operators/blocks.py): a task passes on k candidates a query, not all pairs. Vectors of another size than the largest,
    with a null or non-finite component, or without a length meet the others through a plain join; there are few of them.
    """
    unit = lambda v: F.transform(v, lambda x: x.cast("double"))
    q = queries.select(F.col(key).alias("query"), unit(F.col(vector)).alias("q"))
    t = table.select(F.col(key).alias("match"), unit(F.col(vector)).alias("v"))
    dims = t.agg(F.max(F.size("v"))).first()[0] or 0
    good_q, good_t = blocks.sound("q", dims) & F.col("query").isNotNull(), blocks.sound("v", dims) & F.col("match").isNotNull()
    n = -(-q.filter(good_q).count() // block)
    found, whole = None, t.filter(good_t).repartition(table.sparkSession.sparkContext.defaultParallelism)  # few files are few tasks
    whole = stored(whole, "vectors") if n > 1 else whole
    for i in range(n):
        some = q.filter(good_q & (F.pmod(F.xxhash64("query"), F.lit(n)) == i))
        one = blocks.best(whole, some, dims, k, digits)
        one = stored(one, "near") if n > 1 else one  # a block's queries leave the driver with it
        found = one if found is None else found.unionByName(one)
    rest = [(q, t.filter(~good_t)), (q.filter(~good_q), t.filter(good_t))]
    for a, b in rest:
        if a.take(1) and b.take(1):
            pairs = b.crossJoin(a).filter("query <> match").select("query", "match", F.round(cosine(F.col("q"), F.col("v")), digits).alias("similarity"))
            found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = q.join(t, F.lit(False)).select("query", "match", F.lit(None).cast("double").alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "match")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def capped(links: DataFrame, name: str, order: Column, k: int = 5) -> DataFrame:
    """At most k links per name, chosen by a stated order (a hash for a seeded shuffle)."""
    return links.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy(order))).filter(F.col("rank") <= k)
