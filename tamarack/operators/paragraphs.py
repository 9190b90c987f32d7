"""Paragraph vectors: a vector per document that tells its words from drawn ones, word tables averaged over partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import stored

#: Words of a step: gradients of so many are added up before vectors move.
STEP = 32
#: Documents that are inferred together.
LOT = 16


@dataclass
class ParagraphModel:
    """words: (rows, dims) output vectors of hashed words; odds: cumulated draws of negatives; how it was trained."""

    words: np.ndarray
    odds: np.ndarray
    negative: int
    rate: float
    seed: int

    @property
    def rows(self) -> int:
        return len(self.words)


def _hashed(tokens: Column, rows: int) -> Column:
    return F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(rows)).cast("int"))


class Draws:
    """np.searchsorted(odds, u, "right") of many draws: where each 2**-16 of the range begins is looked up, the rest is stepped."""

    def __init__(self, odds: np.ndarray) -> None:
        self.odds = np.r_[odds[:-1], np.inf]
        self.begins = np.searchsorted(self.odds, np.arange(1 << 16) / (1 << 16), "right")

    def __call__(self, u: np.ndarray) -> np.ndarray:
        out = self.begins.take((u * (1 << 16)).astype(np.intp))
        low = np.flatnonzero(self.odds.take(out) <= u)
        for _ in range(3):
            if not len(low):
                return out
            out[low] += 1
            low = low[self.odds.take(out[low]) <= u[low]]
        out[low] = np.searchsorted(self.odds, u[low], "right")  # many rare words in one part
        return out


def _begun(ids: np.ndarray, dims: int, seed: int) -> tuple[np.random.Generator, np.ndarray]:
    rng = np.random.default_rng([seed, len(ids), int(ids.astype(np.int64).sum())])
    return rng, (rng.random(dims, dtype=np.float32) - 0.5) / dims


def _mixed(ids: np.ndarray, rng: np.random.Generator, draws: Draws, negative: int) -> np.ndarray:
    """A row a word, in a drawn order: the word itself, then those drawn for it."""
    out = np.empty((len(ids), 1 + negative), np.intp)
    out[:, 0] = ids[rng.permutation(len(ids))]
    out[:, 1:] = draws(rng.random(len(ids) * negative)).reshape(-1, negative)
    return out


def _push(z: np.ndarray, pace: float) -> np.ndarray:
    """How far each row (the last axis: 1 + negative a word) pulls a vector: label less logistic, times the pace."""
    np.maximum(z, -20, out=z)
    np.minimum(z, 20, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z) * np.float32(-pace)


def _moved(words: np.ndarray, rows: np.ndarray, near: np.ndarray, push: np.ndarray, d: np.ndarray, room: np.ndarray) -> None:
    """words[row] += push * d for each of `rows`, `near` being words[rows]; a row that comes again moves by the sum. `room` holds a
    number a row of the table."""
    room[rows] = 0
    np.add.at(room, rows, push.astype(room.dtype))
    new = np.dot(room.take(rows).astype(np.float32)[:, None], d[None])
    new += near  # a row that comes again gets one value again
    whole = f"V{words.shape[1] * words.itemsize}"
    words.view(whole).ravel()[rows] = new.view(whole).ravel()


def learn(ids: np.ndarray, words: np.ndarray, draws: Draws, negative: int, rate: float, passes: int, seed: int, room: np.ndarray) -> np.ndarray:
    """The vector of a document with these words; the word table learns along. `room` holds a number a row of it.

    Every word is told from `negative` drawn ones by a logistic of the product with the document's vector. Draws depend on
    the words and the seed alone.
    """
    rng, d = _begun(ids, words.shape[1], seed)
    for p in range(passes):
        pace = rate * (1 - p / passes)
        mixed = _mixed(ids, rng, draws, negative)
        for at in range(0, len(ids), STEP):
            rows = mixed[at : at + STEP].ravel()
            near = words.take(rows, 0)
            push = _push(near @ d, pace)
            push[:: 1 + negative] += np.float32(pace)
            _moved(words, rows, near, push, d, room)
            d = d + push @ near
    return d


def vectors(docs: list[np.ndarray], words: np.ndarray, draws: Draws, negative: int, rate: float, passes: int, seed: int) -> np.ndarray:
    """(documents, dims): as learn() under a fixed table, of documents that have words; LOT of them take their steps together.

    A step has the same shape for every document (rows past its end count nothing), so equal texts have equal vectors."""
    width, dims = 1 + negative, words.shape[1]
    out = np.empty((len(docs), dims), np.float32)
    order = np.argsort([len(x) for x in docs], kind="stable")
    for first in range(0, len(docs), LOT):
        lot = order[first : first + LOT]
        begun = [_begun(docs[i], dims, seed) for i in lot]
        d = np.array([x[1] for x in begun])
        most = -(-len(docs[lot[-1]]) // STEP) * STEP
        inside = np.zeros((len(lot), most * width), np.float32)
        for k, i in enumerate(lot):
            inside[k, : len(docs[i]) * width] = 1
        for p in range(passes):
            pace, mixed = rate * (1 - p / passes), np.zeros((len(lot), most * width), np.intp)
            for k, i in enumerate(lot):
                mixed[k, : len(docs[i]) * width] = _mixed(docs[i], begun[k][0], draws, negative).ravel()
            for at in range(0, most * width, STEP * width):
                near = words.take(mixed[:, at : at + STEP * width], 0)  # documents, rows, dims
                push = _push(np.matmul(near, d[:, :, None])[:, :, 0], pace)
                push[:, ::width] += np.float32(pace)
                push *= inside[:, at : at + STEP * width]
                d = d + np.matmul(push[:, None, :], near)[:, 0]
        out[lot] = d
    return out


def fit(docs: DataFrame, tokens: Column, dims: int = 50, epochs: int = 4, passes: int = 3, negative: int = 5, rate: float = 0.05, rows: int = 1 << 15, seed: int = 17, tasks: int | None = None) -> ParagraphModel:
    """Word tables learnt from all documents: in an epoch each task learns on its documents from the common table, and the
    rows that tasks have changed are averaged into the next one. Documents are dealt to `tasks` tasks (default: as many as
    run at once), so no more tables than that are sent.

    Words share `rows` hashed vectors, so the table (rows * dims floats, 6.5 MB by default, on the driver and in each task)
    doesn't grow with the vocabulary; of a vocabulary as large as the table about 37 % of the words have a row to themselves.
    Documents without a word, null ones too, teach nothing; repeated rows count as often as they come.
    """
    tasks = tasks or docs.sparkSession.sparkContext.defaultParallelism
    held = stored(docs.select(_hashed(tokens, rows).alias("ids")).filter(F.size("ids") > 0).repartition(tasks), "ids")
    counts = np.zeros(rows)
    for r in held.select(F.explode("ids").alias("i")).groupBy("i").count().toLocalIterator():  # `rows` at most
        counts[r["i"]] = r["count"]
    odds = np.cumsum(counts**0.75)
    odds = odds / odds[-1] if odds[-1] else np.arange(1, rows + 1) / rows
    model = ParagraphModel(np.zeros((rows, dims), np.float32), odds, negative, rate, seed)
    for epoch in range(epochs):
        table = model.words

        def run(batches: Iterator[pa.RecordBatch], table: np.ndarray = table, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            words, draws, room = table.copy(), Draws(odds), np.empty(rows)
            for b in batches:
                for ids in b.column(0):
                    learn(ids.values.to_numpy(zero_copy_only=False), words, draws, negative, rate, passes, seed + epoch, room)
            changed = np.flatnonzero((words != table).any(1)).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(changed) + 1, dtype=np.int32) * dims), pa.array(words[changed].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(changed), values], ["i", "v"])

        parts = held.mapInArrow(run, "i int, v array<float>")
        means = parts.groupBy("i").agg(*(F.avg(F.col("v")[j]).alias(f"v{j}") for j in range(dims))).toPandas()
        model.words = table.copy()
        model.words[means["i"].to_numpy(np.int64)] = means[[f"v{j}" for j in range(dims)]].to_numpy(np.float32)
    return model


def infer(docs: DataFrame, key: str, tokens: Column, model: ParagraphModel, passes: int = 12) -> DataFrame:
    """(key, vector): vectors of any documents, seen in training or not, under the fixed word table. A document without a
    word has a null vector. Equal texts have equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = Draws(model.odds)
        for b in batches:
            docs = [ids.values.to_numpy(zero_copy_only=False) for ids in b.column(1)]
            at = np.cumsum([0] + [len(x) > 0 for x in docs])
            got = vectors([x for x in docs if len(x)], model.words, draws, model.negative, model.rate, passes, model.seed)
            none = np.r_[np.diff(at) == 0, False]
            out = pa.ListArray.from_arrays(pa.array((at * got.shape[1]).astype(np.int32), mask=none), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), out], [key, "vector"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, _hashed(tokens, model.rows).alias("ids"))
    return rows.mapInArrow(run, f"`{key}` {kind}, vector array<float>")
