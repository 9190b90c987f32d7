"""Vectors against a stated set of queries, in blocks: products in numpy, the best k a task and query go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and queries of one product.
ROWS, QUERIES = 2048, 2048


def sound(vector: str, dims: int) -> Column:
    """Whether a vector has `dims` finite components and a length that isn't zero."""
    whole = F.size(vector) == dims
    fine = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # squares of very large or small components leave the range of a double
    return F.coalesce(whole & fine & F.exists(vector, lambda v: F.abs(v) > 1e-100) & ~F.exists(vector, lambda v: F.abs(v) > 1e100), F.lit(False))


def unit_rows(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def best(table: DataFrame, queries: DataFrame, dims: int, k: int, digits: int, allowed: Callable | None = None, itself: bool = False) -> DataFrame:
    """(query, match, similarity): of (match, v) rows, at least the k most similar of every task to each of the (query, q) rows.

    Similarities are rounded to `digits`; of equal ones the smaller match stays. The queries are brought to the tasks, so their number is
    the caller's to bound. `allowed` makes of the queries' unit vectors what says which pairs count; a row with the query's key
    counts only with `itself`.
    """
    held = queries.select("query", "q").toArrow()
    ids = held.column("query").combine_chunks() if held.num_rows else pa.array([], held.schema.field("query").type)
    units = unit_rows(held.column("q").combine_chunks(), dims) if held.num_rows else np.zeros((0, dims))
    sent = table.sparkSession.sparkContext.broadcast((ids.to_numpy(zero_copy_only=False), units, allowed(units) if allowed else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, mask = sent.value
        keep: tuple | None = None
        for b in batches:
            for at in range(0, b.num_rows if len(names) else 0, ROWS):
                part = b.slice(at, ROWS)
                match, x = part.column(0).to_numpy(zero_copy_only=False), unit_rows(part.column(1), dims)
                order = np.argsort(match, kind="stable")
                match, x = match[order], x[order]
                fresh = keep is None
                if fresh:
                    keep = np.full((len(q), k), -np.inf), np.full((len(q), k), match[0], match.dtype)
                for first in range(0, len(q), QUERIES):
                    last = min(first + QUERIES, len(q))
                    s, held, names_ = q[first:last] @ x.T, (keep[0][first:last], keep[1][first:last]), names[first:last]
                    if mask is not None:
                        s[~mask(x, first, last)] = -np.inf
                    if fresh:
                        s = np.round(s, digits)
                        if not itself:
                            s[names_[:, None] == match[None, :]] = -np.inf
                        top = _top(s, np.broadcast_to(match, s.shape), k)
                        held[0][:, : top[0].shape[1]], held[1][:, : top[0].shape[1]] = top
                    else:  # what is under a query's k-th best even when rounded is passed over; no cosine is under -2
                        row, col = np.divmod(np.flatnonzero(s >= np.maximum(held[0][:, -1:] - 10.0**-digits, -2)), len(x))
                        if not itself:
                            other = names_[row] != match[col]
                            row, col = row[other], col[other]
                        _merge(*held, row, match[col], np.round(s[row, col], digits))
        if keep is not None:
            i, j = np.nonzero(np.isfinite(keep[0]))
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(keep[1][i, j]), pa.array(keep[0][i, j])], ["query", "match", "similarity"])

    kind = {c: f.schema[c].dataType.simpleString() for c, f in (("query", queries), ("match", table))}
    return table.select("match", "v").mapInArrow(run, f"query {kind['query']}, match {kind['match']}, similarity double")


def _merge(best: np.ndarray, match: np.ndarray, row: np.ndarray, found: np.ndarray, s: np.ndarray) -> None:
    """Put what was `found` for some rows (in order of the row, a row's by match) among their k best, in place."""
    if not len(row):
        return
    n = np.bincount(row, minlength=len(best))
    some, place = np.flatnonzero(n), np.arange(len(row)) - (np.cumsum(n) - n)[row]
    at = (np.cumsum(n > 0) - 1)[row], place
    more, other = np.full((len(some), n.max()), -np.inf), np.full((len(some), n.max()), found[0], found.dtype)
    more[at], other[at] = s, found
    if n.max() > 4 * best.shape[1]:
        more, other = _top(more, other, best.shape[1])
    best[some], match[some] = _top(np.c_[best[some], more], np.c_[match[some], other], best.shape[1])


def _top(s: np.ndarray, match: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of every row; of equal ones those with the smaller match."""
    if s.shape[1] > 4 * k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        # at most k above the k-th largest; of those equal to it the first, as columns ascend by match
        over, same = s > least[:, None], s == least[:, None]
        same &= np.cumsum(same, axis=1) <= (k - over.sum(1))[:, None]
        at = np.nonzero(over | same)[1].reshape(len(s), k)
        s, match = np.take_along_axis(s, at, 1), np.take_along_axis(match, at, 1)
    order = np.lexsort((match, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(match, order, 1)
