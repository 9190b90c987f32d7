"""SentencePiece encoding and decoding, with sampled segmentations drawn without replacement.

A text's lattice has a node per code point and an edge per vocabulary piece that matches there; a segmentation is a
path. No piece crosses a place where it has none of the two neighbouring characters side by side, so the lattice is cut
there into units; equal units share their lattice, and the law of a text's paths is the product of its units' laws. Pieces carry log-probabilities, so each path has a probability; conditional edge probabilities come from a
backward pass. Gumbel top-k without replacement is a search over prefixes of paths: the space is kept as regions
("this prefix, then any edge but those taken"), each with the maximum of its Gumbel-perturbed log-probabilities, drawn
top-down as a truncated Gumbel. The region with the largest maximum is opened next, as in A-star search with an exact
bound, so paths come in descending perturbed order and are distinct. The next maximum is the threshold of the
inclusion scores.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import splitmix, tidied, uniform

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, LITERAL = "\u2581", "\ud800"  # of a space; of a mark in the text itself (no valid text has a lone surrogate)
MASK = (1 << 64) - 1
MOST_LETTERS = 31  # an edge's key is node * 32 + length
_BASE = np.uint64(0x100000001B3)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces with log-probabilities, ready for matching.

    The model's scores are ranks, not probabilities, so pieces get a prior by rank: proportional to
    1 / (rank + offset) ** power, normalised over the pieces used, and flattened by `alpha` (the exponent of subword
    regularisation: 1 keeps the prior, 0 makes every piece equal). Pieces of several white-space marks, control and
    unused pieces never take part. A character without a piece of its own is spelt in byte pieces, one edge.
    """

    pieces: list[str]
    ids: np.ndarray
    log_p: np.ndarray
    byte_ids: np.ndarray
    byte_log_p: float
    longest: int
    per_char: float = 0.0  # about what a character of text costs: keeps sums of probabilities near 1
    tables: dict = field(default_factory=dict)
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0x110000, np.int16))  # the number of each character of a piece
    power: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))
    beside: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), bool))  # whether a piece has two characters side by side

    @classmethod
    def load(cls, path: str = MODEL, power: float = 1.0, offset: float = 50.0, alpha: float = 0.25) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        used = [i for i, p in enumerate(pieces) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)) and p and "▁" not in p[1:]]
        rank = np.argsort(np.argsort([-m.get_score(i) for i in used], kind="stable"), kind="stable")
        p = (rank + offset) ** -power
        byte_ids = np.full(256, -1, np.int32)
        for i in range(len(pieces)):
            if m.is_byte(i):
                byte_ids[int(pieces[i][1:-1], 16)] = i
        log_p = alpha * np.log(p / p.sum())
        out = cls(pieces, np.array(used, np.int32), log_p.astype(np.float32), byte_ids, float(log_p.min()), max(len(pieces[i]) for i in used))
        if out.longest > MOST_LETTERS:
            raise ValueError(f"pieces of over {MOST_LETTERS} characters don't fit an edge's key")
        out._index()
        out.per_char = -float(np.mean(log_p)) / 4
        return out

    def _index(self) -> None:
        """Per length: sorted hashes of the pieces with their places, and two bit tables, of these hashes and of all
        beginnings of pieces so long, which turn most misses away before they are looked up."""
        whole: dict[int, list] = {}
        begun: dict[int, set] = {}
        for k, i in enumerate(self.ids.tolist()):
            h = 0
            for n, c in enumerate(self.pieces[i], 1):
                h = (h * int(_BASE) + ord(c) + 1) & MASK
                begun.setdefault(n, set()).add(h)
            whole.setdefault(n, []).append((h, k))
        self.tables = {}
        for n, hashes in begun.items():
            rows = sorted(whole.get(n, []))
            keys = np.array([r[0] for r in rows], np.uint64)
            near, start = np.zeros(1 << 17, bool), np.zeros(1 << 17, bool)
            near[_slot(keys)] = True
            start[_slot(np.array(sorted(hashes), np.uint64))] = True
            self.tables[n] = (keys, np.array([r[1] for r in rows], np.int64), near, start)
        used = [self.pieces[i] for i in self.ids.tolist()]
        for k, c in enumerate(sorted({c for p in used for c in p}), 1):
            self.kinds[ord(c)] = k
        self.beside = np.zeros((int(self.kinds.max()) + 1,) * 2, bool)
        for p in used:
            k = self.kinds[[ord(c) for c in p]]
            self.beside[k[:-1], k[1:]] = True

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of texts (spaces, and the one before a text, as marks), the number of every unit among
        these in order of the texts, and how many units each text has."""
        whole = [MARK + t.replace(MARK, LITERAL).replace(" ", MARK) if t else "" for t in texts]
        line = "".join(whole)
        ends = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
        raw = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[raw]
        cut = np.zeros(len(line) + 1, bool)
        cut[1:-1] = ~self.beside[kind[:-1], kind[1:]]
        cut[ends] = cut[0] = True
        at = np.flatnonzero(cut)
        count = np.diff(np.searchsorted(at, np.r_[0, ends]))
        if not len(line):
            return [], np.zeros(0, np.int64), count
        if len(self.power) < len(raw):
            self.power = np.full(len(raw) + 1, _ODD)
            self.power[0] = 1
            self.power = np.multiply.accumulate(self.power)
        a, b = at[:-1], at[1:]
        total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], dtype=np.uint64)]
        _, lead, same = np.unique((total[b] - total[a]) * self.power[len(raw) - 1 - a], return_index=True, return_inverse=True)
        size = b - a
        like = lead[same]
        twin = raw[np.arange(len(raw)) + np.repeat((a[like] - a), size).clip(-len(raw), len(raw))] if (size == size[like]).all() else raw + np.uint32(1)
        if not (twin == raw).all():  # two different units with one hash: compare them as text
            places = {}
            same = np.array([places.setdefault(line[x:y], len(places)) for x, y in zip(a.tolist(), b.tolist())])
            return list(places), same, count
        return [line[x:y] for x, y in zip(a[lead].tolist(), b[lead].tolist())], same, count


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * _ODD) >> np.uint64(47)).astype(np.int64)


class Lattices:
    """The lattices of distinct units ("words" below) laid end to end, one node per code point, edges in order of (node, length).

    Per node: `start`, its first edge (the next node's is the end). Per edge: `length`, `place` (of the piece;
    -2 for a byte spelling), `ends` (whether it ends the word), `log_q` (log of its conditional probability), `log_r` (of
    the node's other edges together) and `upto` (the sum of conditional probabilities up to it). Words stay for later
    runs; `most_nodes` bounds what is held.
    """

    def __init__(self, vocab: Vocabulary, most_nodes: int = 1_000_000):
        self.vocab, self.most_nodes = vocab, most_nodes
        self.clear()

    KINDS = {"first": np.int64, "size": np.int64, "points": np.uint32, "start": np.int32, "place": np.int32, "length": np.int8, "ends": bool, "log_q": np.float32, "log_r": np.float32, "upto": np.float32}

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.room = {name: np.zeros(1 << 12, kind) for name, kind in self.KINDS.items()}
        for name in self.KINDS:
            setattr(self, name, self.room[name][: int(name == "start")])

    def _append(self, **more: np.ndarray) -> None:
        """Add to the arrays, which grow by a third when they are full."""
        for name, values in more.items():
            held = len(getattr(self, name))
            if held + len(values) > len(self.room[name]):
                bigger = np.empty(4 * (held + len(values)) // 3, self.KINDS[name])
                bigger[:held] = self.room[name][:held]
                self.room[name] = bigger
            self.room[name][held : held + len(values)] = values
            setattr(self, name, self.room[name][: held + len(values)])

    def source(self, edges: np.ndarray) -> np.ndarray:
        """The nodes that edges leave."""
        return np.searchsorted(self.start, edges, side="right") - 1

    def places(self, words: list[str]) -> np.ndarray:
        """The numbers of distinct words; new ones are added."""
        if len(self.points) > self.most_nodes:
            self.clear()
        new = [w for w in words if w not in self.index]
        if new:
            held = len(self.index)
            self.index.update(zip(new, range(held, held + len(new))))
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _add(self, words: list[str]) -> None:
        """Match every piece at every node, then pass backwards from the words' ends (log-sum-exp over outgoing edges)."""
        vocab = self.vocab
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        points, n = raw.astype(np.uint64) + np.uint64(1), len(raw)
        left = (np.repeat(first + size, size) - np.arange(n)).astype(np.int32)  # nodes up to the word's end
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live, h = np.arange(n, dtype=np.int32), np.zeros(n, np.uint64)
        for length in range(1, vocab.longest + 1):
            keys, place, near, start = vocab.tables[length]
            keep = left[live] >= length
            live, h = live[keep], h[keep]
            h = h * _BASE + points[live + (length - 1)]
            slot = _slot(h)
            keep = start[slot]  # nodes where no piece begins like this are done
            live, h, slot = live[keep], h[keep], slot[keep]
            if not len(live):
                break
            hit = np.flatnonzero(near[slot])
            if len(hit):
                at = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
                ok = keys[at] == h[hit]
                found.append((live[hit[ok]].astype(np.int64) * 32 + length, place[at[ok]]))
        single = np.zeros(n, bool)
        if found:
            key = np.concatenate([f[0] for f in found])
            single[key[(key & 31) == 1] >> 5] = True
        bare = np.flatnonzero(~single)
        found.append((bare * 32 + 1, np.full(len(bare), -2, np.int64)))
        key, place = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(key.astype(np.int32) if n < 1 << 26 else key, kind="stable")
        key, place = key[order], place[order]
        source, length = key >> 5, key & 31
        weight = vocab.log_p[place].astype(np.float64)
        lone = np.flatnonzero(place < 0)
        c = raw[source[lone]]  # a mark in the text itself is spelt in bytes too, so that decoding gives it back
        weight[lone] = vocab.byte_log_p * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        ends = left[source] == length
        far = left[source]
        by = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        cut = np.searchsorted(far[by], np.arange(1, int(left.max(initial=0)) + 2))
        target = np.where(ends, n, source + length)  # the node after the edge; n stands for the word's end
        log_q = self._backward(n, weight + vocab.per_char * length, source, target, by, cut)
        if log_q is None:
            log_q = self._backward_log(n, weight, source, target, by, cut)
        heads = np.searchsorted(source, np.arange(n + 1))
        q = np.exp(log_q)
        run = np.cumsum(q)
        upto = (run - (run - q)[heads[:-1]][source]).astype(np.float32)
        upto[heads[1:] - 1] = 2.0  # rounding must not leave the last edge out of reach
        # 1 - q, but for a node's likeliest edge the sum of the others, which stays exact where q is almost 1
        top = np.maximum.reduceat(q, heads[:-1])[source] == q
        rest = np.add.reduceat(np.where(top, 0, q), heads[:-1])[source]
        tied = np.add.reduceat(top.astype(np.int64), heads[:-1])[source] > 1
        with np.errstate(divide="ignore"):
            log_r = np.log(np.where(top & ~tied, rest, 1 - q))
        base, edges = len(self.points), len(self.place)
        self._append(first=first + base, size=size, points=raw, start=heads[1:] + edges, place=place, length=length, ends=ends, log_q=np.minimum(log_q, 0), log_r=np.minimum(log_r, 0), upto=upto)

    @staticmethod
    def _backward(n: int, weight: np.ndarray, source: np.ndarray, target: np.ndarray, by: np.ndarray, cut: np.ndarray) -> np.ndarray | None:
        """log conditional probabilities by sums of probabilities, scaled per character; None if a word is too long for it."""
        beta = np.zeros(n + 1)
        beta[n] = 1.0
        w, src, dst = np.exp(weight)[by], source[by], target[by]
        q = np.empty(len(by))
        head = np.r_[True, src[1:] != src[:-1]] if len(by) else np.zeros(0, bool)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if a < b:
                v = w[a:b] * beta[dst[a:b]]
                heads = np.flatnonzero(head[a:b])
                total = np.add.reduceat(v, heads)
                beta[src[a:b][heads]] = total
                q[a:b] = v
        if not (np.isfinite(beta).all() and (beta > 1e-280).all()):
            return None
        out = np.empty(len(by))
        out[by] = np.log(q / beta[src])
        return out

    @staticmethod
    def _backward_log(n: int, weight: np.ndarray, source: np.ndarray, target: np.ndarray, by: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The same in logarithms, for words of any length."""
        beta, log_q = np.zeros(n + 1), weight.copy()
        for a, b in zip(cut[:-1], cut[1:]):
            e = by[a:b]
            if not len(e):
                continue
            v = log_q[e] + beta[target[e]]
            heads = np.flatnonzero(np.r_[True, source[e[1:]] != source[e[:-1]]])
            top = np.maximum.reduceat(v, heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(e)]))
            total = top + np.log(np.add.reduceat(np.exp(v - top[group]), heads))
            beta[source[e[heads]]] = total
            log_q[e] = v - total[group]
        return log_q


def _truncated(u: np.ndarray, log_mass: np.ndarray, bound: float | np.ndarray) -> np.ndarray:
    """The maximum of Gumbels with this mass, given that it is under the bound."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, -np.logaddexp(-bound, np.log(-np.log(u)) - log_mass))


class Sampler:
    """Gumbel top-k segmentations of runs of texts, seeded by row key.

    Regions that leave a path within its first `near` edges are held one by one; all later ones together, as one region
    of their common mass, which is taken apart exactly if it is ever the best (deep regions have almost no mass).
    """

    def __init__(self, vocab: Vocabulary, k: int = 3, seed: int = 11, near: int = 24, most_nodes: int = 1_000_000):
        self.vocab, self.k, self.seed, self.near = vocab, k, np.uint64(seed), near
        self.lattice = Lattices(vocab, most_nodes)

    def _walk(self, word: np.ndarray, node: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample a path from `node` to the end of each word: how many edges each has, and the edges, words end to end."""
        lat = self.lattice
        upto, start, size = lat.upto, lat.start, lat.length
        end = lat.first[word] + lat.size[word]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        count = np.zeros(len(word), np.int64)
        lone = lat.size[word] == 1  # one node, one edge: nothing to draw
        only = np.flatnonzero(lone & (node < end))
        if len(only):
            steps.append((only, start[node[only]]))
            count[only] = 1
        active = np.flatnonzero(~lone & (node < end))
        at = node[active]
        bits, step = None, 0
        while len(active):
            # 24 bits a draw, two draws of each 64 bits; what is likelier than that to go unseen is reached over its region
            bits = splitmix(state[active] + np.uint64(step * int(_ODD) & MASK)) if bits is None else bits << np.uint64(24)
            u = (bits >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            step += 1
            edge = start[at]
            more = np.flatnonzero(u > upto[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] > upto[edge[more]]]
            steps.append((active, edge))
            count[active] += 1
            at = at + size[edge]
            keep = at < end[active]
            active, at = active[keep], at[keep]
            bits = bits[keep] if step % 2 else None
        begin = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), np.int32)
        for s, (who, edge) in enumerate(steps, -1 if len(only) else 0):
            edges[begin[who] + max(s, 0)] = edge
        return count, edges

    def run(self, keys: np.ndarray, texts: list[str]) -> list[list[dict]]:
        """For each text its samples in descending perturbed order: edges of the path, log_p, perturbed, inclusion.

        Fewer than k where the text has fewer segmentations.
        """
        lat, docs = self.lattice, len(texts)
        units, which, n_words = self.vocab.units(texts)
        base = np.cumsum(n_words) - n_words
        words = lat.places(units)[which]
        key = splitmix(keys.astype(np.uint64) ^ splitmix(np.array([self.seed], np.uint64)))
        root = -np.log(-np.log(uniform(key + np.uint64(1))))
        heaps: list[list] = [[] for _ in range(docs)]
        paths: list[list[dict]] = [[] for _ in range(docs)]
        threshold = np.full(docs, -np.inf)
        # (document, perturbed, prefix of edges, word and node where the walk goes on)
        todo = [(d, float(root[d]), None, 0, -1) for d in range(docs)]
        for r in range(self.k):
            if not todo:
                break
            who = np.array([t[0] for t in todo])
            begin = np.array([t[3] for t in todo])
            sizes = n_words[who] - begin
            heads = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(todo)), sizes)
            nth = np.arange(int(sizes.sum())) - heads[row] + begin[row]
            word = words[base[who][row] + nth]
            node = lat.first[word]
            for x, t in enumerate(todo):
                if t[4] >= 0:
                    node[heads[x]] = t[4]
            state = splitmix(key[who][row] + np.uint64(r + 2)) + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
            count, edges = self._walk(word, node, state)
            total = np.r_[0, np.cumsum(count)]
            cut = np.r_[total[heads], total[-1]].tolist()
            u = uniform(key[who][:, None] + (np.arange(self.near + 1, dtype=np.uint64) + np.uint64(1000 * (r + 1)))[None, :])
            log_q, log_r = lat.log_q[edges].astype(np.float64), lat.log_r[edges]
            sums = np.r_[0.0, np.cumsum(log_q)]
            cuts = np.array(cut)
            done = np.array([0 if t[2] is None else len(t[2]) for t in todo])
            held = np.array([0.0 if t[2] is None else float(lat.log_q[t[2]].sum(dtype=np.float64)) for t in todo])
            own = np.diff(cuts)
            spot = np.minimum(cuts[:-1, None] + np.arange(self.near), max(0, len(edges) - 1))
            inside = np.arange(self.near) < own[:, None]
            mass = np.full((len(todo), self.near + 1), -np.inf)
            if len(edges):
                mass[:, :-1] = np.where(inside, held[:, None] + sums[spot] - sums[cuts[:-1], None] + log_r[spot], -np.inf)
            whole = held + sums[cuts[1:]] - sums[cuts[:-1]]
            far = np.flatnonzero(own > self.near)
            deep = held[far] + sums[cuts[far] + self.near] - sums[cuts[far]]
            left = np.minimum(whole[far] - deep, 0)
            with np.errstate(divide="ignore"):
                mass[far, -1] = deep + np.log(-np.expm1(left))
            for x in np.flatnonzero(left > -1e-3).tolist():  # all but certain: the sum over its edges is exact
                a, b = cuts[far[x]] + self.near, cuts[far[x] + 1]
                mass[far[x], -1] = deep[x] + np.logaddexp.reduce(sums[a:b] - sums[a] + log_r[a:b])
            bound = np.array([t[1] for t in todo])
            gumbel = _truncated(u, mass, bound[:, None])
            # no more regions of one path than are still to be opened, and the one that gives the threshold, can matter
            many = min(self.k - r, self.near + 1)
            best = np.argpartition(-gumbel, many - 1, axis=1)[:, :many]
            for x, (d, g, prefix, _, _) in enumerate(todo):
                a, b = cut[x], cut[x + 1]
                path = edges[a:b] if prefix is None else np.concatenate((prefix, edges[a:b]))
                paths[d].append({"edges": path, "log_p": float(whole[x]), "perturbed": g})
                m = min(self.near, b - a)
                for t in best[x].tolist():
                    v = float(gumbel[x, t])
                    if v > -np.inf:
                        heapq.heappush(heaps[d], (-v, len(paths[d]), int(done[x]) + min(t, m), (int(edges[a + t]),) if t < m else ()))
            todo = [t for t in (self._open(heaps[d], paths[d], d, key[d], r, threshold) for d in who.tolist()) if t]
        for d in range(docs):
            for p in paths[d]:
                x = p["log_p"] - threshold[d]
                p["inclusion"] = 1.0 if x > 50 else float(-np.expm1(-np.exp(x)))
                p["log_inclusion"] = 0.0 if x > 50 else float(np.log(p["inclusion"])) if x > -30 else float(x)
        return paths

    def _open(self, heap: list, paths: list[dict], d: int, key: np.uint64, r: int, threshold: np.ndarray):
        """Take the best region: split it by an edge at its node; the rest of it goes back under the same bound."""
        threshold[d] = -heap[0][0] if heap else -np.inf
        if not heap or r == self.k - 1:
            return None
        lat = self.lattice
        g, nth, t, taken = heapq.heappop(heap)
        g, path = -g, paths[nth - 1]["edges"]
        draws = uniform(key + np.arange(4, dtype=np.uint64) + np.uint64(500_000 + 10 * r))
        if not taken:  # the regions from t on together: which one has the maximum, and the others under it
            log_q = lat.log_q[path].astype(np.float64)
            mass = (np.cumsum(log_q) - log_q)[t:] + lat.log_r[path[t:]]
            p = np.exp(mass - mass.max())
            here = int(min(np.searchsorted(np.cumsum(p), draws[2] * p.sum()), len(p) - 1))
            others = _truncated(uniform(key + np.arange(len(mass), dtype=np.uint64) + np.uint64(1_000_000 * (r + 1))), mass, g)
            others[here] = -np.inf
            for j in np.argsort(-others)[: self.k + 1].tolist():
                if others[j] > -np.inf:
                    heapq.heappush(heap, (-float(others[j]), nth, t + j, (int(path[t + j]),)))
            t, taken = t + here, (int(path[t + here]),)
        node = int(lat.source(path[t]))
        first, last = int(lat.start[node]), int(lat.start[node + 1])
        row = lat.log_q[first:last].astype(np.float64)
        row[[e - first for e in taken]] = -np.inf
        top = row.max()
        p = np.exp(row - top)
        pick = int(min(np.searchsorted(np.cumsum(p), draws[0] * p.sum(), side="right"), len(p) - 1))
        before = float(lat.log_q[path[:t]].sum(dtype=np.float64))
        p[pick] = 0
        rest = float(p.sum())
        if len(taken) + 1 < last - first and rest > 0:
            again = float(_truncated(draws[1:2], np.array([before + top + np.log(rest)]), g)[0])
            heapq.heappush(heap, (-again, nth, t, (*taken, first + pick)))
        edge = first + pick
        prefix = np.append(path[:t], np.int32(edge))
        return d, g, prefix, int(lat.ends[path[:t]].sum()), node + int(lat.length[edge])

    def token_ids(self, path: dict) -> np.ndarray:
        """The ids of one path; byte spellings take one id a byte."""
        return self.ids_of([path])[0]

    def ids_of(self, paths: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of paths end to end, and where each path's begin (and the last ends)."""
        lat = self.lattice
        edges = np.concatenate([p["edges"] for p in paths]) if paths else np.zeros(0, np.int32)
        cuts = np.cumsum([0, *(len(p["edges"]) for p in paths)])
        place = lat.place[edges]
        ids = self.vocab.ids[place]
        bare = np.flatnonzero(place < 0)
        if not len(bare):
            return ids, cuts
        c = lat.points[lat.source(edges[bare])]
        ids[bare] = self.vocab.byte_ids[np.minimum(c, 255)]
        wide = np.flatnonzero(c > 0x7F)
        if not len(wide):
            return ids, cuts
        spelt = [self.vocab.byte_ids[list((MARK if x == ord(LITERAL) else chr(x)).encode())] for x in c[wide].tolist()]
        n = np.ones(len(ids), np.int64)
        n[bare[wide]] = [len(x) for x in spelt]
        ends = np.r_[0, np.cumsum(n)]
        out = np.repeat(ids, n)
        out[np.concatenate([ends[k] + np.arange(len(x)) for k, x in zip(bare[wide].tolist(), spelt)])] = np.concatenate(spelt)
        return out, ends[cuts]


class Decoder:
    """ids -> text: pieces joined, marks as spaces, the first space (the dummy prefix) taken off."""

    def __init__(self, pieces: list[str], byte_ids: np.ndarray):
        raw = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids.tolist()):
            if i >= 0:
                raw[i] = bytes([b])
        self.size = np.array([len(r) for r in raw], np.int32)
        self.first = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def joined(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids between two cuts, without the dummy prefix."""
        n = self.size[ids]
        ends = np.r_[0, np.cumsum(n, dtype=np.int64)]
        whole = self.bytes[np.arange(ends[-1]) + np.repeat(self.first[ids] - ends[:-1], n)].tobytes()
        edges = ends[cuts].tolist()
        return [whole[a + (whole[a : a + 1] == b" " and b > a) : b] for a, b in zip(edges, edges[1:])]

    def __call__(self, ids: np.ndarray) -> str:
        return self.joined(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")


def decoder(pieces: list[str], byte_ids: np.ndarray) -> Decoder:
    return Decoder(pieces, byte_ids)


SAMPLES = "ids array<array<int>>, log_p array<double>, perturbed array<double>, inclusion array<double>, log_inclusion array<double>, round_trip boolean"
NUMBERS = ("log_p", "perturbed", "inclusion", "log_inclusion")


def sample_encode(docs: DataFrame, vocab: Vocabulary, k: int = 3, seed: int = 11, doc_id: str = "doc_id", text: str = "text", run_chars: int = 150_000, most_nodes: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, and k distinct sampled segmentations in descending perturbed order.

    ids, log_p (of the segmentation given the text), perturbed, inclusion (the probability of being among the k, given
    the next value; its logarithm too, as it underflows for long texts), and round_trip (every sample decodes to the text exactly). Draws depend on the seed, the row's key
    (doc_id; null has a key of its own) and the place in the text, so they are the same at any partitioning; rows that
    repeat key and text get the same samples. The empty text has the empty segmentation alone; a null text gives null in
    every column but doc_id. Whole texts are read, in runs of about `run_chars` characters (a longer text is a run of its
    own, and its lattice is held whole); other columns aren't. Words' lattices are
    kept for later runs until they have `most_nodes` nodes, which bounds a worker's memory and changes no result. An empty table gives an empty result.
    """
    sampler, decode = Sampler(vocab, k, seed, most_nodes=most_nodes), decoder(vocab.pieces, vocab.byte_ids)

    def run(batches):
        for batch in batches:
            letters = np.array([x or 0 for x in pc.utf8_length(batch.column(2)).to_pylist()], np.int64)
            before = np.r_[0, np.cumsum(letters)]
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(before, before[a] + run_chars, side="right")) - 1)
                texts = batch.column(2).slice(a, b - a).to_pylist()
                found = sampler.run(keys[a:b], [t or "" for t in texts])
                known = [t is not None for t in texts]
                paths = [p for samples, yes in zip(found, known) if yes for p in samples]
                flat, cuts = sampler.ids_of(paths)
                spelt, at, trips = decode.joined(flat, cuts), 0, []
                for t, samples in zip(texts, found):
                    raw = None if t is None else t.encode()
                    trips.append(None if t is None else all(x == raw for x in spelt[at : at + len(samples)]))
                    at += len(samples) * (t is not None)
                outer = pa.array(np.cumsum([0, *(len(x) if yes else 0 for x, yes in zip(found, known))]).astype(np.int32))
                void = pa.array(np.logical_not(known))
                numbers = [[p[name] for p in paths] for name in NUMBERS]
                ids = pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat, pa.int32())), mask=void)
                lists = [pa.ListArray.from_arrays(outer, pa.array(x, pa.float64()), mask=void) for x in numbers]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, *lists, pa.array(trips, pa.bool_())], ["doc_id", "ids", *NUMBERS, "round_trip"])
                a = b

    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.lit("row"), F.col(doc_id)).alias("_key"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, {SAMPLES}")


def encode(docs: DataFrame, path: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the library's deterministic encoding of each whole text; null gives null, the empty text no ids.

    Repeated rows are encoded each by itself; other columns aren't read. An empty table gives an empty result.
    """
    from sentencepiece import SentencePieceProcessor

    proto = SentencePieceProcessor(model_file=path).serialized_model_proto()

    def run(batches):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_proto=proto)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [None if t is None else m.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocab: Vocabulary, ids: str = "ids") -> DataFrame:
    """The input with `text` decoded from the column of ids; null gives null, no ids the empty text.

    Other columns stay (but one named `text` is replaced); repeated rows are decoded each by itself. An empty table gives an
    empty result.
    """
    turn = decoder(vocab.pieces, vocab.byte_ids)
    keep = [c for c in encoded.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts = [None if x is None else turn(np.array(x, np.int64)) for x in batch.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return encoded.select(*keep).mapInArrow(run, f"{fields}, text string")
