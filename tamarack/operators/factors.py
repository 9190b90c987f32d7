"""Non-negative matrix factors with both factors as tables: only topics x topics numbers come to the driver."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.session import delete, scratch, stored

LEAST = 1e-12
#: Columns of a block (see blocks_of()).
BLOCK = "block long, docs array<{kind}>, sizes binary, codes binary, w binary, terms array<string>"


@dataclass
class Factors:
    """docs: (doc, f0, f1, ...), terms: (term, f0, f1, ...), stored; losses: after each round, squared distance of all cells."""

    docs: DataFrame
    terms: DataFrame
    losses: list[float] = field(default_factory=list)


def _draw(key: Column, j: int, seed: int) -> Column:
    return F.lit(0.1) + F.pmod(F.xxhash64(F.lit(seed), F.lit(j), key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def start(keys: DataFrame, key: str, topics: int, seed: int) -> DataFrame:
    """(key, f0, ...): draws from 0.1 to 1.1 by a hash of the key, the same at any partitioning."""
    return keys.select(key, *(_draw(F.col(key), j, seed).alias(f"f{j}") for j in range(topics)))


def _gram(rows: DataFrame, topics: int) -> np.ndarray:
    """F'F of a factor: one row of numbers."""
    pairs = [(i, j) for i in range(topics) for j in range(i, topics)]
    got = rows.agg(*(F.sum(F.col(f"f{i}") * F.col(f"f{j}")) for i, j in pairs)).first()
    out = np.zeros((topics, topics))
    for (i, j), v in zip(pairs, got):
        out[i, j] = out[j, i] = v or 0.0
    return out


def blocks_of(weights: DataFrame, doc: str, term: str, w: str) -> DataFrame:
    """(block, docs, sizes, codes, w, terms) of (doc, term, w): documents in blocks with a word list of their own, a document's cells
    (places in the list, weights) one behind the other. Cells that come more than once are added up; those that are null, zero
    or negative, or have no document or term, are left out."""
    cells = weights.filter(F.col(doc).isNotNull() & F.col(term).isNotNull() & (F.col(w) > 0)).select(F.col(doc).alias("doc"), F.col(term).alias("term"), F.col(w).cast("double").alias("w"))
    rows = cells.repartition("doc").groupBy("doc", "term").agg(F.sum("w").alias("w")).groupBy("doc").agg(F.collect_list(F.struct("term", "w")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            coded = batch.column(2).flatten().dictionary_encode()
            codes, cuts = coded.indices.to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(batch.column(1).to_numpy())]
            yield a_block(block, batch.column(0), cuts, codes, batch.column(3).flatten().to_numpy(), coded.dictionary)
            block += 1

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", F.size("cells").alias("n"), "cells.term", "cells.w").mapInArrow(run, BLOCK.format(kind=kind))


def a_block(block: int, docs: pa.Array, cuts: np.ndarray, codes: np.ndarray, w: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    """The row of a block: the cells of document i lie between cuts[i] and cuts[i + 1], every document has some."""
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    raw = lambda x: pa.array([x.tobytes()], pa.binary())
    kind = np.uint16 if len(terms) <= 1 << 16 else np.int32
    return pa.RecordBatch.from_arrays([pa.array([block]), whole(docs), raw(np.diff(cuts).astype(np.int32)), raw(codes.astype(kind)), raw(w.astype(np.float64)), whole(terms)], ["block", "docs", "sizes", "codes", "w", "terms"])


class _Bucketed:
    """Tables written in buckets, by block or by term: those of one kind join each other without an exchange, so what is in them stays
    where it is."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.names, self.buckets = spark, {}, 4 * spark.sparkContext.defaultParallelism

    def stored(self, df: DataFrame, by: str = "block") -> DataFrame:
        name, path = f"factors_{uuid.uuid4().hex}", scratch(self.spark, "factors")
        df.write.bucketBy(self.buckets, by).option("path", path).saveAsTable(name)
        self.names[name] = path
        return self.spark.table(name)

    def last(self) -> str:
        return next(reversed(self.names))

    def dropped(self, name: str) -> None:
        """A table that nothing reads any more, with its files."""
        self.spark.sql(f"drop table {name}")
        delete(self.spark, self.names.pop(name))

    def forget(self) -> None:
        """The names go; the files stay until discard()."""
        for name in self.names:
            self.spark.sql(f"drop table {name}")


def _pass(rows: DataFrame, topics: int, gram: np.ndarray | None) -> DataFrame:
    """(block, f0, ..., n0, ..., own) of blocks with their documents' factors f0, ... and, but for the first pass, those of their terms
    (places `at`, factors h0, ...): documents after their multiplicative update, the sums that terms get from them, and what is
    added up over blocks: products of the documents' factors, and the cells' with both factors (first pass: their squares)."""
    fs, ns, hs = ([f"{c}{j}" for j in range(topics)] for c in "fnh")
    upper = np.triu_indices(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                of = lambda c: batch.column(at[c])[i]
                w, n_terms = np.frombuffer(of("w").as_buffer(), np.float64), of("n_terms").as_py()
                sizes, codes = np.frombuffer(of("sizes").as_buffer(), np.int32), of("codes").as_buffer()
                codes = np.frombuffer(codes, np.uint16 if codes.size == 2 * len(w) else np.int32).astype(np.intp)
                cuts = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
                f = np.array([of(c).values.to_numpy(zero_copy_only=False) for c in fs])
                more = float(w @ w)
                if gram is not None:
                    place, n = of("at").values.to_numpy(zero_copy_only=False), np.empty_like(f)
                    for j in range(topics):
                        h = np.zeros(n_terms)
                        h[place] = of(hs[j]).values.to_numpy(zero_copy_only=False)
                        n[j] = np.add.reduceat(w * h[codes], cuts[:-1])
                    f = f * n / np.maximum(gram @ f, LEAST)
                    more = float((f * n).sum())
                sums = [np.bincount(codes, w * np.repeat(f[j], sizes), n_terms) for j in range(topics)]
                yield pa.RecordBatch.from_arrays([batch.column(at["block"])[i : i + 1], *(pa.array([x], pa.list_(pa.float64())) for x in (*f, *sums, np.r_[(f @ f.T)[upper], more]))], ["block", *fs, *ns, "own"])

    return rows.mapInArrow(run, "block long, " + ", ".join(f"{c} array<double>" for c in (*fs, *ns, "own")))


def _own(state: DataFrame, topics: int) -> tuple[np.ndarray, float | None]:
    """F'F of the documents' factor, and the last number of `own`, over all blocks: one row of numbers."""
    upper = np.triu_indices(topics)
    got = state.agg(*(F.sum(F.col("own")[i]) for i in range(len(upper[0]) + 1))).first()
    out = np.zeros((topics, topics))
    out[upper] = [v or 0.0 for v in got[:-1]]
    return np.maximum(out, out.T), got[-1]


def factorise(weights: DataFrame, doc: str = "doc_id", term: str = "term", w: str = "w", topics: int = 5, rounds: int = 10, seed: int = 17) -> Factors:
    """Factors of a sparse non-negative matrix (doc, term, w) by alternating multiplicative updates, every term kept.

    The squared distance never rises. Cells of a (doc, term) that comes more than once are added up; cells that are null,
    zero or negative, or have no document or term, are left out, and so documents and terms without another cell. An empty
    matrix has empty factors.
    """
    return factorise_blocks(blocks_of(weights, doc, term, w), topics, rounds, seed)


def factorise_blocks(blocks: DataFrame, topics: int = 5, rounds: int = 10, seed: int = 17) -> Factors:
    """As factorise(), of blocks (see blocks_of(); a document is in one block only).

    Cells are written once, in buckets, and never sent again. In a round a block sends a sum for each of its terms and is sent the
    new factor of each, whatever the number of its documents that have it: these are all that is exchanged, as terms and the blocks that
    have them lie in buckets by term. Each round's factors are written tables; those before go once they are read.
    """
    spark = blocks.sparkSession
    tables = _Bucketed(spark)
    held = tables.stored(blocks)
    asks = tables.stored(held.select("block", F.posexplode("terms").alias("at", "term")).repartition(tables.buckets, "term"), "term")
    terms = tables.stored(start(asks.select("term").distinct(), "term", topics, seed + 1), "term")
    terms_name = tables.last()
    cells = held.select("block", "sizes", "codes", "w", F.size("terms").alias("n_terms"))
    fs, ns = ([f"{c}{j}" for j in range(topics)] for c in "fn")
    drawn = lambda j: F.transform("docs", lambda d: _draw(d, j, seed)).alias(f"f{j}")
    first = held.select("block", "sizes", "codes", "w", F.size("terms").alias("n_terms"), *map(drawn, range(topics)))
    state = tables.stored(_pass(first, topics, None))
    state_name = tables.last()
    gram, total = _own(state, topics)
    losses = []
    for _ in range(rounds if total is not None else 0):
        told = held.select("block", "terms").join(state.select("block", *ns), "block").select(F.explode(F.arrays_zip("terms", *ns)).alias("t"))
        sums = told.select(F.col("t.terms").alias("term"), *(F.col(f"t.{n}").alias(n) for n in ns)).repartition(tables.buckets, "term")
        sums = sums.groupBy("term").agg(*(F.sum(n).alias(n) for n in ns))
        below = lambda j: sum((F.col(f"f{i}") * F.lit(float(gram[i, j])) for i in range(topics)), F.lit(0.0))  # noqa: E731, B023
        moved = terms.join(sums, "term").select("term", *((F.col(f"f{j}") * F.col(f"n{j}") / F.greatest(below(j), F.lit(LEAST))).alias(f"f{j}") for j in range(topics)))
        terms, old = tables.stored(moved, "term"), terms_name
        tables.dropped(old)
        terms_name = tables.last()
        other = _gram(terms, topics)
        answers = asks.join(terms, "term").select("block", F.struct("at", *fs).alias("a")).repartition(tables.buckets, "block").groupBy("block").agg(F.collect_list("a").alias("a"))
        answers = answers.select("block", "a.at", *(F.col(f"a.f{j}").alias(f"h{j}") for j in range(topics)))
        state, old = tables.stored(_pass(cells.join(state.select("block", *fs), "block").join(answers, "block"), topics, other)), state_name
        tables.dropped(old)
        state_name = tables.last()
        gram, cross = _own(state, topics)
        losses.append(float(total - 2 * cross + (gram * other).sum()))
    terms = stored(terms, "terms")  # the bucketed tables' names go
    out = Factors(terms, terms, losses)
    each = held.select("block", "docs").join(state.select("block", *fs), "block").select(F.explode(F.arrays_zip("docs", *fs)).alias("t"))
    out.docs = stored(each.select(F.col("t.docs").alias("doc"), *(F.col(f"t.{f}").alias(f) for f in fs)), "docs")
    tables.forget()
    return out


def top_terms(factors: Factors, topics: int, k: int = 10) -> DataFrame:
    """(topic, rank, term, weight): the k heaviest terms of each topic; equal weights in order of the term."""
    tops = None
    for j in range(topics):
        one = factors.terms.select(F.lit(j).alias("topic"), "term", F.col(f"f{j}").alias("weight")).orderBy(F.desc("weight"), "term").limit(k)
        tops = one if tops is None else tops.unionByName(one)
    held = tops.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("_w"), "term", "weight"))).alias("t"))  # k a topic
    return held.select("topic", F.posexplode("t").alias("at", "t")).select("topic", (F.col("at") + 1).alias("rank"), "t.term", "t.weight")
