"""Documents packed in blocks with a word list of their own: a block asks once for what it must know about each word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import stored

#: Words of a block (a longer document is a block of its own).
WORDS = 1 << 20


def one_row_each(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """(id, w): the words of every document in order. Rows that repeat an id (null too) are one document, with the words of all
    of them by their places. Only such rows are shuffled, and the ids."""
    rows = docs.select(F.col(doc_id).alias("id"), tokens.alias("w"))
    again = stored(docs.groupBy(F.col(doc_id).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id"), "repeated")
    if again.isEmpty():
        return rows
    same = F.col("id").eqNullSafe(F.col("_id"))
    places = rows.join(again, same, "left_semi").select("id", F.posexplode("w").alias("at", "term"))
    merged = places.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda s: s["term"]).alias("w"))
    return rows.join(again, same, "left_anti").unionByName(merged)


def packed(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(block, ids, sizes, codes, terms, n, known), stored, of (id, w): a block's documents that have a word, with their words
    as places in the block's list; n and known count its documents with a word, known without a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.array(batch.column(1).value_lengths().fill_null(0), np.int64)
            batch = batch.take(pa.array(np.flatnonzero(size)))
            size = size[size > 0]
            cuts, first = np.r_[0, np.cumsum(size)], 0
            while first < len(size):
                last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + words, side="right")) - 1)
                ids = batch.column(0).slice(first, last - first)
                coded = batch.column(1).slice(first, last - first).flatten().dictionary_encode()
                codes, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                owner = np.repeat(np.arange(last - first), size[first:last])
                cells = np.unique(owner * len(terms) + codes)
                named = np.logical_not(ids.is_null().to_numpy(zero_copy_only=False))
                n = np.bincount(cells % len(terms), minlength=len(terms))
                known = np.bincount((cells % len(terms))[named[cells // len(terms)]], minlength=len(terms))
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                raw = lambda x: pa.array([x.tobytes()], pa.binary())
                short = codes.astype(np.uint16 if len(terms) <= 1 << 16 else np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([block]), whole(ids), raw(size[first:last].astype(np.int32)), raw(short), whole(terms), whole(pa.array(n)), whole(pa.array(known))], ["block", "ids", "sizes", "codes", "terms", "n", "known"])
                block, first = block + 1, last

    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"block long, ids array<{kind}>, sizes binary, codes binary, terms array<string>, n array<long>, known array<long>"), "blocks")


def frequencies(blocks: DataFrame, count: str = "n") -> DataFrame:
    """(term, df), stored: how many documents have a word."""
    each = blocks.select(F.explode(F.arrays_zip("terms", F.col(count).alias("n"))).alias("t"))
    return stored(each.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.n").alias("df")), "df")


def told(blocks: DataFrame, df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """What run(ids, cuts, codes, terms, df) gives of each block: its documents' words codes[cuts[i] : cuts[i + 1]], its list and
    the frequencies of the words in it.

    A block asks for a word once, whatever the number of its documents that have it; answers are numbers.
    """
    asked = blocks.select("block", F.posexplode("terms").alias("at", "term"))
    answers = asked.join(df, "term").groupBy("block").agg(F.collect_list(F.struct("at", "df")).alias("df"))
    rows = blocks.select("block", "ids", "sizes", "codes", "terms").join(answers, "block").select("ids", "sizes", "codes", "terms", "df.at", "df.df")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, codes, terms, at, n = (batch.column(c)[i] for c in range(6))
                cuts = np.r_[0, np.cumsum(np.frombuffer(sizes.as_buffer(), np.int32), dtype=np.int64)]
                kind = np.uint16 if codes.as_buffer().size == 2 * cuts[-1] else np.int32
                df = np.zeros(len(terms.values), np.int64)
                df[at.values.to_numpy(zero_copy_only=False)] = n.values.to_numpy(zero_copy_only=False)
                out = run(ids.values, cuts, np.frombuffer(codes.as_buffer(), kind).astype(np.int64), terms.values, df)
                for a in range(0, out.num_rows, 1 << 16):
                    yield out.slice(a, 1 << 16)

    return rows.mapInArrow(each, schema)
