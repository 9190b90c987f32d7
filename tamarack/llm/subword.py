"""Averaged embeddings of hashed words and character n-grams with a linear softmax, in numpy.

A document is the sum, over the kinds of feature, of the average vector of its features of that kind (words, word
pairs, byte n-grams of words with their borders), each hashed to one of 2**bits rows. Averaging each kind by itself
keeps a few words from being drowned by many n-grams. Vectors and softmax weights are trained together by stochastic gradient
descent. The score is linear in the average, so for use the two matrices are multiplied once into one weight per row
and class: the same numbers, at one table look-up a feature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tamarack.llm.common import slices

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Features:
    """What is hashed into 2**bits rows: byte n-grams of these sizes, whole words, pairs of neighbouring words.

    A pair of equal words, and a pair that the document has had before, each have a row of their own, so that
    repetition is seen whatever is repeated.
    """

    bits: int = 17
    ngrams: tuple[int, ...] = (3, 4)
    words: bool = True
    pairs: bool = False

    def _rows(self, h: np.ndarray, salt: int) -> np.ndarray:
        return (((h + np.uint64(salt)) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int32)

    def streams(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(rows, place) of each kind of feature in padded bytes; place is the byte position it starts at, ascending.

        `data` has at least one space before, between and after documents [start, end).
        """
        space = data <= 32
        wide = data.astype(np.uint64)
        n = len(data)
        for size in self.ngrams:
            if n < size:
                continue
            h = wide[: n - size + 1].copy()
            inner = np.zeros(n - size + 1, bool)
            for k in range(1, size):
                h = h * np.uint64(257) + wide[k : n - size + 1 + k]
                if k < size - 1:
                    inner |= space[k : n - size + 1 + k]
            # white space may be the border of a word only
            ok = np.flatnonzero(~inner & ~(space[: n - size + 1] & space[size - 1 :]))
            # an n-gram that starts on the border before a word belongs to the word's document
            yield self._rows(h[ok], size), ok + space[ok]
        if self.words or self.pairs:
            edge = np.flatnonzero(space[1:] != space[:-1]) + 1
            a, b = edge[::2], edge[1::2]
            if len(b) < len(a):
                a = a[: len(b)]
            if not len(a):
                return
            power = np.full(n, _BASE)
            power[0] = 1
            power = np.multiply.accumulate(power)
            total = np.cumsum((wide + np.uint64(1)) * power, dtype=np.uint64)
            # differences of prefix sums start at power[a]: scaled to the last power, then by its inverse modulo 2**64
            h = (total[b - 1] - total[a] + (wide[a] + np.uint64(1)) * power[a]) * power[n - 1 - a]
            h *= np.uint64(pow(int(power[n - 1]), -1, 1 << 64))
            h ^= h >> np.uint64(29)
            if self.words:
                yield self._rows(h, 101), a
            if self.pairs and len(a) > 1:
                owner = np.searchsorted(ends, a)
                same = np.flatnonzero(owner[1:] == owner[:-1])
                pair = h[same] * _BASE + h[same + 1]
                rows = self._rows(pair, 202)
                order = np.lexsort((same, pair, owner[same]))
                again = (pair[order][1:] == pair[order][:-1]) & (owner[same][order][1:] == owner[same][order][:-1])
                rows[order[1:][again]] = 1
                rows[h[same] == h[same + 1]] = 0
                yield rows, a[same]

    def documents(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20):
        """(first row, padded bytes, starts, ends) of runs of documents of about `most` bytes."""
        for i, j in slices(offsets, most):
            lengths = np.diff(offsets[i : j + 1])
            starts = np.cumsum(np.r_[1, lengths[:-1] + 1])
            padded = np.full(int(lengths.sum()) + len(lengths) + 1, 32, np.uint8)
            for k in range(j - i):
                padded[starts[k] : starts[k] + lengths[k]] = data[offsets[i + k] : offsets[i + k + 1]]
            yield i, padded, starts, starts + lengths

    def packed(self, data: np.ndarray, offsets: np.ndarray):
        """(sizes, rows, shares) of runs of documents: each document's ascending distinct rows and the sums of their shares
        of each kind's features, one document behind the other."""
        for _, padded, starts, ends in self.documents(data, offsets):
            kinds = [((np.searchsorted(ends, place, side="right")).astype(np.int64), r) for r, place in self.streams(padded, starts, ends)]
            if len(kinds) == 1:  # one share a document: counting sorted keys will do
                owner, r = kinds[0]
                found = np.sort((owner << self.bits) | r)
                first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                key = found[first]
                total = np.diff(np.r_[first, len(found)]) * (1.0 / np.maximum(np.bincount(owner, minlength=len(starts)), 1))[key >> self.bits]
            else:
                rows, share = [np.zeros(0, np.int64)], [np.zeros(0)]
                for owner, r in kinds:
                    rows.append((owner << self.bits) | r)
                    share.append(1.0 / np.bincount(owner, minlength=len(starts))[owner])
                key, where = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.bincount(where, np.concatenate(share), len(key))
            cut = np.searchsorted(key, np.arange(len(starts) + 1, dtype=np.int64) << self.bits)
            yield np.diff(cut), (key & ((1 << self.bits) - 1)).astype(np.int32), total.astype(np.float32)

    def bags(self, data: np.ndarray, offsets: np.ndarray):
        """Per document: ascending distinct rows and the sums of their shares of each kind's features."""
        for sizes, rows, total in self.packed(data, offsets):
            cut = np.r_[0, np.cumsum(sizes)]
            for k in range(len(sizes)):
                yield rows[cut[k] : cut[k + 1]], total[cut[k] : cut[k + 1]]


@dataclass
class Model:
    """Weights per hashed row and class, a bias per class, a temperature; `classes` names the columns."""

    features: Features
    classes: list
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    extra: dict = field(default_factory=dict)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of logits per document; a document without features has the bias alone."""
        out = np.zeros((len(offsets) - 1, len(self.classes)))
        tables = [np.ascontiguousarray(self.weights[:, c]) for c in range(len(self.classes))]
        for i, padded, starts, ends in self.features.documents(data, offsets):
            for rows, place in self.features.streams(padded, starts, ends):
                cut = np.searchsorted(place, np.r_[starts, len(padded)])
                count = np.maximum(np.diff(cut), 1)
                for c, t in enumerate(tables):
                    total = np.r_[0.0, np.cumsum(t[rows], dtype=np.float64)]
                    out[i : i + len(starts), c] += (total[cut[1:]] - total[cut[:-1]]) / count
        return out + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, offsets) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    if not z.shape[-1]:
        return z
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, classes: list, features: Features, dim: int = 8, epochs: int = 6, rate: float = 1.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, with rates scaled per row by past gradients (Adagrad).

    An empty class list or no bags gives a model that answers uniformly.
    """
    rng = np.random.default_rng(seed)
    n, k = len(bags), len(classes)
    if not n:
        return Model(features, list(classes), np.zeros((1 << features.bits, k), np.float32), np.zeros(k))
    table = rng.uniform(-1 / dim, 1 / dim, (1 << features.bits, dim)).astype(np.float32)
    out = rng.normal(0, 0.3, (dim, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    seen_rows = np.full(1 << features.bits, 1e-6, np.float32)
    seen_out = np.full(out.shape, 1e-3, np.float32)
    seen_bias = np.full(k, 1e-1, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for d in rng.permutation(n):
            rows, share = bags[d]
            vectors = table[rows]
            hidden = share @ vectors if len(rows) else np.zeros(dim, np.float32)
            p = softmax(hidden @ out + bias)
            p[targets[d]] -= 1
            back = out @ p
            g = np.outer(hidden, p)
            seen_out += g * g
            seen_bias += p * p
            if len(rows):
                scale = share * share * float(back @ back)
                seen_rows[rows] += scale
                table[rows] = vectors - (0.3 * step * share / np.sqrt(seen_rows[rows]))[:, None] * back
            out -= 0.1 * step * g / np.sqrt(seen_out)
            bias -= 0.1 * step * p / np.sqrt(seen_bias)
    return Model(features, list(classes), (table.astype(np.float64) @ out.astype(np.float64)).astype(np.float32), bias.astype(np.float64))


def scores_of_bags(model: Model, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logits of documents given as bags."""
    if not bags:
        return np.zeros((0, len(model.classes)))
    return np.array([share.astype(np.float64) @ model.weights[rows] if len(rows) else np.zeros(len(model.classes)) for rows, share in bags]) + model.bias


def fit_temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature with the least log loss on documents that weren't trained on (1 if there are none)."""
    if not len(logits):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(targets)), targets], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])
