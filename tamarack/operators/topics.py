"""Latent topics by online variational inference: counts as plain rows, documents of a task inferred together in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import stored

#: Steps of the learning rate (OFFSET + round) ** -DECAY, and when a document's inference ends.
OFFSET, DECAY, CLOSE, MOST = 1024, 0.51, 1e-3, 100
#: Cells (padding included) that are inferred together.
CELLS = 1 << 17
#: Columns of a piece of a task's sums.
PIECE = 1024


def digamma(x: np.ndarray) -> np.ndarray:
    """By its recurrence up to 6, then its asymptotic series: errors are under 1e-9 for positive x."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        if not low.any():
            break
        out[low] -= 1 / x[low]
        x[low] += 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    """As digamma()."""
    x, out = np.array(x, np.float64), 0.0
    for _ in range(8):
        out, x = out + 1 / (x * x), x + 1
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def likely(x: np.ndarray, axis: int) -> np.ndarray:
    """exp(E[log p]) of Dirichlet distributions along an axis."""
    return np.exp(digamma(x) - digamma(x.sum(axis, keepdims=True)))


def grown(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)) of positive x, without a branch: six steps of the recurrence in one, then its own series (errors under 1e-8 of it)."""
    u, z = x * (x + 5), x + 5.5
    r = 1 / (z * z)
    return z * (1 + r * (1 / 24 - r * (37 / 5760 - r * (10313 / 2903040)))) * np.exp(-(2 * x + 5) * (1 / u + 1 / (u + 4) + 1 / (u + 6)))


def starts(at: np.ndarray, n: np.ndarray, cuts: np.ndarray, topics: int, seed: int) -> np.ndarray:
    """(documents, topics): deviates around 1 with a deviation of 0.1, by a hash of the document's cells and the seed."""
    total = np.r_[np.uint64(0), np.cumsum((at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * n.astype(np.uint64), dtype=np.uint64)]
    x = (total[cuts[1:]] - total[cuts[:-1]])[:, None] + np.arange(2 * topics, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.maximum(1 + 0.1 * np.sqrt(-2 * np.log(u[:, :topics])) * np.cos(2 * np.pi * u[:, topics:]), 0.2)


def infer(at: np.ndarray, n: np.ndarray, cuts: np.ndarray, words: np.ndarray, alpha: np.ndarray, seed: int, sums: np.ndarray | None = None) -> np.ndarray:
    """(documents, topics): Dirichlet weights of documents whose cells (column `at`, count `n`) lie between `cuts`.

    `words` (columns, topics) is exp(E[log p(word)]). Every document starts from starts() and is inferred until its
    mean change is under CLOSE, at most MOST times. Documents are taken in order of length, padded to the longest of
    their lot (cells of count zero add nothing), so one product serves a lot. A lot's words are held by topic, a document's cells
    in a row, and theta is not divided by its sum, which shares don't depend on. `sums` (topics, columns) gets their expected counts.
    """
    k, lengths = words.shape[1], np.diff(cuts)
    out, first_gamma = np.tile(alpha, (len(lengths), 1)), starts(at, n, cuts, k, seed)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    first = 0

    def shares(theta: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        share = (theta[:, None, :] @ b)[:, 0]
        np.maximum(share, 1e-30, out=share)
        return np.divide(c, share, out=share)

    while first < len(order):
        shortest, last = lengths[order[first]], first + 1
        while last < len(order) and lengths[order[last]] <= 1.25 * shortest + 8 and lengths[order[last]] * (last + 1 - first) <= CELLS:
            last += 1
        docs, first = order[first:last], last
        inside = np.arange(lengths[docs[-1]]) < lengths[docs][:, None]
        where = np.where(inside, cuts[docs][:, None] + np.arange(inside.shape[1]), 0)
        column, count = at[where], np.where(inside, n[where], 0).astype(np.float32)
        beta = np.ascontiguousarray(words[column].transpose(0, 2, 1))  # documents, topics, cells
        gamma = first_gamma[docs]
        open_ = np.arange(len(docs))
        b, c = beta, count
        for step in range(MOST):
            theta = grown(gamma[open_]).astype(np.float32)
            new = alpha + theta * (b @ shares(theta, b, c)[:, :, None])[:, :, 0]
            moved = np.abs(new - gamma[open_]).mean(1) >= CLOSE
            gamma[open_] = new
            if not moved.any():
                break
            if moved.sum() < 0.8 * len(open_):  # those that are done are left out
                open_ = open_[moved]
                b, c = beta[open_], count[open_]
        out[docs] = gamma
        if sums is not None:
            theta = grown(gamma).astype(np.float32)
            share, flat = shares(theta, beta, count), column.ravel()
            for j in range(k):
                sums[j] += np.bincount(flat, (share * beta[:, j] * theta[:, j : j + 1]).ravel(), sums.shape[1])
    return out


def cells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, counts, cuts) of lists of column numbers that may repeat; a null list has none."""
    ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.array(column.value_lengths().fill_null(0))
    key, n = np.unique((np.repeat(np.arange(len(lengths)), lengths) << 32) | ids, return_counts=True)
    return key & 0xFFFFFFFF, n, np.searchsorted(key, np.arange(len(lengths) + 1, dtype=np.int64) << 32)


def counted(docs: DataFrame, doc_id: str, ids: Column) -> DataFrame:
    """(doc_id, at, n), stored: each document's distinct columns and their counts, four bytes each (lists would be written number by
    number to every task of every round)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, cuts = cells_of(b.column(1))
            offsets = pa.py_buffer((4 * cuts).astype(np.int32).tobytes())
            raw = (pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offsets, pa.py_buffer(x.astype(np.int32).tobytes())]) for x in (at, n))
            yield pa.RecordBatch.from_arrays([b.column(0), *raw], [doc_id, "at", "n"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return stored(docs.select(doc_id, ids.alias("_i")).mapInArrow(run, f"`{doc_id}` {kind}, at binary, n binary"), "counts")


def _cells(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, n = (b.column(j).to_pylist() for j in (i, i + 1))
    return *(np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (at, n)), np.r_[0, np.cumsum([len(x) // 4 for x in at], dtype=np.int64)]


def fit(counts: DataFrame, columns: int, topics: int, rounds: int, seed: int, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(topics, columns) and (topics): Dirichlet weights of words, and the documents' prior, after `rounds` rounds.

    A round infers documents under the weights so far (all of them with a share of 1 or more, else those that a draw of their
    row takes), sums their expected counts as tables, scales them up to the corpus and moves the weights by (1024 + round)
    to the -0.51. Priors start as 1 / topics; that of documents follows their shares by a Newton step a round. The driver
    holds topics x columns numbers, and a task sends as many once a round.
    """
    spark, prior = counts.sparkSession, 1 / topics
    rng = np.random.default_rng([seed, 1])  # chosen: most streams that were tried leave two disjoint vocabularies in one topic
    weights, alpha = rng.gamma(100.0, 0.01, (columns, topics)).T, np.full(topics, prior)
    total = counts.filter(F.octet_length("at") > 0).count()
    for r in range(rounds if total else 0):
        words = spark.sparkContext.broadcast(np.ascontiguousarray(likely(weights, 1).T.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], words=words, alpha=alpha, salt=seed + 1000 * r) -> Iterator[pa.RecordBatch]:
            sums, logs, seen = np.zeros((topics, columns)), np.zeros(topics), 0
            for b in batches:
                at, n, cuts = _cells(b, 0)
                gamma = infer(at, n, cuts, words.value, alpha, salt, sums)[np.diff(cuts) > 0]
                logs += (digamma(gamma) - digamma(gamma.sum(1, keepdims=True))).sum(0)
                seen += len(gamma)
            first = [i for i in range(0, columns, PIECE) if sums[:, i : i + PIECE].any()]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *first], pa.int32()), pa.array([seen, *[0] * len(first)], pa.int64()), pa.array([logs.tobytes(), *(sums[:, i : i + PIECE].tobytes() for i in first)], pa.binary())], ["first", "seen", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One task's pieces of a stretch of columns, added up: a few megabytes in all, whatever the corpus."""
            held: dict[int, list] = {}
            for b in batches:
                for first, seen, piece in zip(*(c.to_pylist() for c in b.columns)):
                    now = np.frombuffer(piece, np.float64)
                    if first in held:
                        held[first] = [held[first][0] + seen, held[first][1] + now]
                    else:
                        held[first] = [seen, now]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tobytes() for v in held.values()], pa.binary())], ["first", "seen", "sums"])

        kind = "first int, seen long, sums binary"
        rows = counts.select("at", "n") if share >= 1 else counts.filter(F.rand(seed + r) < share).select("at", "n")
        got = rows.mapInArrow(run, kind).repartition("first").mapInArrow(add, kind).toArrow()
        words.destroy()
        seen, sums, logs = 0, np.zeros((topics, columns)), np.zeros(topics)
        for first, n, piece in zip(*(c.to_pylist() for c in got.columns)):
            seen += n
            if first < 0:
                logs = np.frombuffer(piece, np.float64)
            else:
                sums[:, first : first + PIECE] = np.frombuffer(piece, np.float64).reshape(topics, -1)
        if seen:
            rate = (OFFSET + r + 1) ** -DECAY
            weights = (1 - rate) * weights + rate * (sums * (total / seen) + prior)
            slope = seen * (logs / seen - digamma(alpha) + digamma(alpha.sum()))
            bend, whole = -seen * trigamma(alpha), seen * trigamma(alpha.sum())
            step = -(slope - (slope / bend).sum() / (1 / whole + (1 / bend).sum())) / bend
            if (alpha + rate * step > 0).all():
                alpha = alpha + rate * step
    return weights, alpha


def mixtures(counts: DataFrame, doc_id: str, weights: np.ndarray, alpha: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, topics: array<double>): shares of topics in every document; all zero in one without a word."""
    k = len(weights)
    words = counts.sparkSession.sparkContext.broadcast(np.ascontiguousarray(likely(weights, 1).T.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, cuts = _cells(b, 1)
            gamma = infer(at, n, cuts, words.value, alpha, seed)
            gamma = np.where((np.diff(cuts) > 0)[:, None], gamma / gamma.sum(1, keepdims=True), 0.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(gamma) + 1, dtype=np.int32) * k), pa.array(gamma.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], [doc_id, "topics"])

    kind = counts.schema[doc_id].dataType.simpleString()
    return counts.select(doc_id, "at", "n").mapInArrow(run, f"`{doc_id}` {kind}, topics array<double>")
