"""Centroid clustering by dual-tree Lloyd: cover trees over blocks of vectors against a cover tree over the centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialize, tidied

#: Vectors of a block (one tree), points of a leaf, and the largest component (its squared distances fit a long).
BLOCK, LEAF, LARGEST = 2048, 8, 1 << 26
#: Distances are computed in doubles: node pairs are only pruned by more than this share of them.
SLACK = 1e-9


@dataclass
class CoverTree:
    """A cover tree over integer points; leaves hold up to LEAF points (any number of equal ones).

    `order` puts the points of each subtree together: node i covers order[begin[i]:end[i]], the point order[begin[i]] is
    its centre, and no covered point is farther from it than radius[i]. Children of a node come one after another,
    from child[i] up to child[i] + children[i]; the first has the same centre (nesting). At a node of scale s the
    children's centres are more than s apart (separation) and every point is within s of its child's centre (covering).
    """

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        n = len(points)
        x, order = points.astype(np.float64), np.arange(n)
        begin, end, radius, child, children = [0], [n], [0.0], [0], [0]
        at = 0
        while at < len(begin):  # nodes are listed level by level
            b, e = begin[at], end[at]
            own = order[b:e]
            if e > b:
                gap = _distances(x[own], x[own[0]])
                radius[at] = float(gap.max())
                if e - b > leaf and radius[at] > 0:
                    scale = 2.0 ** (np.ceil(np.log2(radius[at])) - 1)
                    nearest, which, centres = gap, np.zeros(e - b, np.int64), [0]
                    while nearest.max() > scale:
                        far = int(nearest.argmax())  # farther than the scale from every centre so far
                        gap = _distances(x[own], x[own[far]])
                        closer = gap < nearest
                        which[closer], nearest = len(centres), np.where(closer, gap, nearest)
                        centres.append(far)
                    which[centres] = np.arange(len(centres))
                    rank = np.ones(e - b, np.int64)
                    rank[centres] = 0  # a child's centre comes first among its points
                    into = np.lexsort((rank, which))
                    order[b:e] = own[into]
                    counts = np.bincount(which, minlength=len(centres))
                    stops = b + np.cumsum(counts)
                    child[at], children[at] = len(begin), len(centres)
                    begin += (stops - counts).tolist()
                    end += stops.tolist()
                    radius += [0.0] * len(centres)
                    child += [0] * len(centres)
                    children += [0] * len(centres)
            at += 1
        return cls(order, np.array(begin), np.array(end), np.array(radius), np.array(child), np.array(children))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(a - b).sum(-1))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).sum(-1)  # int64: exact


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs first .. first + count - 1: the run of each entry, and the entry."""
    run = np.repeat(np.arange(len(first)), count)
    return run, first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


def assign(tree: CoverTree, points: np.ndarray, centroids: np.ndarray, over: CoverTree, whole: bool = False) -> tuple[np.ndarray, np.ndarray, dict]:
    """(nearest centroid, squared distance) of every point, ties to the smaller number, and how much was compared.

    Pairs of a node of the points and a node of the centroids are walked level by level. A pair goes if the least distance
    that it allows is above the most that some centroid allows for the whole node. Pairs of leaves are compared exactly, in
    integers. With `whole`, a node left with a single centroid gives it to all its points, whose distances stay -1.
    """
    x, c = points[tree.order].astype(np.float64), centroids[over.order].astype(np.float64)
    xi, ci = points[tree.order].astype(np.int64), centroids.astype(np.int64)
    least, at = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(centroids))
    bound = np.full(len(tree.begin), np.inf)
    q, r = np.zeros(min(1, len(points)), np.int64), np.zeros(min(1, len(points)), np.int64)
    seen, settled = {"node_pairs": 0, "point_pairs": 0}, []
    while len(q):
        seen["node_pairs"] += len(q)
        gap = _distances(x[tree.begin[q]], c[over.begin[r]])
        np.minimum.at(bound, q, gap + tree.radius[q])  # the centre of r is a centroid
        keep = gap - tree.radius[q] - over.radius[r] <= bound[q] + SLACK * (1 + gap + tree.radius[q])
        q, r = q[keep], r[keep]
        leaf_q, leaf_r = tree.children[q] == 0, over.children[r] == 0
        alone = np.zeros(len(q), bool)
        if whole:
            alone = (np.bincount(q, minlength=len(bound))[q] == 1) & leaf_r & (over.end[r] - over.begin[r] == 1)
            for node, of in zip(q[alone], over.order[over.begin[r[alone]]]):
                settled.append((tree.begin[node], tree.end[node], of))
        ends = leaf_q & leaf_r & ~alone
        for some in np.array_split(np.flatnonzero(ends), max(1, int(ends.sum()) * LEAF // 4096)):
            run, p = _spread(tree.begin[q[some]], tree.end[q[some]] - tree.begin[q[some]])
            again, o = _spread(over.begin[r[some]][run], (over.end[r[some]] - over.begin[r[some]])[run])
            p, k = p[again], over.order[o]
            for a in range(0, len(p), 1 << 16):
                pa_, ka = p[a : a + (1 << 16)], k[a : a + (1 << 16)]
                d = _squared(xi[pa_], ci[ka])
                seen["point_pairs"] += len(d)
                first = np.lexsort((ka, d, pa_))
                pa_, ka, d = pa_[first], ka[first], d[first]
                head = np.r_[True, pa_[1:] != pa_[:-1]]
                pa_, ka, d = pa_[head], ka[head], d[head]
                better = (d < least[pa_]) | ((d == least[pa_]) & (ka < at[pa_]))
                least[pa_[better]], at[pa_[better]] = d[better], ka[better]
        left = ~ends & ~alone
        q, r, leaf_q, leaf_r = q[left], r[left], leaf_q[left], leaf_r[left]
        # the wider node of a pair is opened, a leaf never
        open_r = ~leaf_r & (leaf_q | (over.radius[r] > tree.radius[q]))
        run, nodes = _spread(over.child[r[open_r]], over.children[r[open_r]])
        below, kids = _spread(tree.child[q[~open_r]], tree.children[q[~open_r]])
        np.minimum.at(bound, kids, bound[q[~open_r]][below])  # what holds for a node holds below it
        q, r = np.r_[q[open_r][run], kids], np.r_[nodes, r[~open_r][below]]
    for b, e, of in settled:
        at[b:e], least[b:e] = of, -1
    back = np.empty(len(points), np.int64)
    back[tree.order] = np.arange(len(points))
    return at[back], least[back], seen


_BLOCK_FIELDS = {"ids": pa.list_(pa.int64()), "points": pa.binary(), **{f: pa.binary() for f in ("order", "begin", "end", "radius", "child", "children")}}
_BLOCK_SCHEMA = "ids array<long>, points binary, order binary, begin binary, end binary, radius binary, child binary, children binary"


def kept(vectors: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors with exactly `dims` components, none null or non-finite, in integers floor(scale * x)."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = (F.size(x) == dims) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), sound.alias("sound")).filter("sound")
    whole = lambda c: F.when(F.abs(c * scale) < LARGEST, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large: its squared distances may not fit a long")).cast("long"))
    return rows.select("vec_id", F.transform("x", whole).alias("v"))


def blocks(points: DataFrame, dims: int, size: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Rows of up to `size` vectors with the cover tree over them, written once: every round reads them again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], np.zeros((0, dims), np.int32)

        def block(ids: list, x: np.ndarray) -> pa.RecordBatch:
            t = CoverTree.of(x, leaf)
            parts = [x.tobytes(), *(a.astype(kind).tobytes() for a, kind in ((t.order, np.int32), (t.begin, np.int32), (t.end, np.int32), (t.radius, np.float64), (t.child, np.int32), (t.children, np.int32)))]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([p], pa.binary()) for p in parts)], list(_BLOCK_FIELDS))

        for batch in batches:
            ids += batch.column(0).to_pylist()
            held = np.concatenate([held, batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dims)])
            while len(held) >= size:
                yield block(ids[:size], held[:size])
                ids, held = ids[size:], held[size:]
        if len(held):
            yield block(ids, held)

    return materialize(points.mapInArrow(tidied(build), _BLOCK_SCHEMA), "blocks")


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, CoverTree]]:
    for i in range(batch.num_rows):
        raw = [batch.column(j)[i].as_buffer() for j in range(1, 8)]
        parts = [np.frombuffer(b, np.float64 if j == 4 else np.int32) for j, b in enumerate(raw)]
        points, order, begin, end, radius, child, children = parts
        yield batch.column(0)[i].values, points.reshape(-1, dims), CoverTree(*(a.astype(np.int64) for a in (order, begin, end)), radius, child.astype(np.int64), children.astype(np.int64))


def _sums(trees: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """(count, sums) of each centroid's vectors: a task sends one row a centroid."""
    over, k = CoverTree.of(centroids, 1), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for _, points, tree in _opened(batch, dims):
                at, _, _ = assign(tree, points, centroids, over, whole=True)
                np.add.at(total[:, 1:], at, points.astype(np.int64))
                total[:, 0] += np.bincount(at, minlength=k)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, j]) for j in range(dims + 1))], ["cluster", "n", *(f"s{j}" for j in range(dims))])

    rows = trees.mapInArrow(tidied(run), "cluster int, n long, " + ", ".join(f"s{j} long" for j in range(dims)))
    found = rows.groupBy("cluster").agg(F.sum("n"), *(F.sum(f"s{j}") for j in range(dims))).toPandas().to_numpy()  # a row a centroid
    out = np.zeros((k, dims + 1), np.int64)
    if len(found):
        out[found[:, 0].astype(np.int64)] = found[:, 1:]
    return out


@dataclass
class Clusters:
    """centroids: (k, dims) integers; points: (vec_id, cluster, distance), stored; inertias: of each cluster."""

    centroids: np.ndarray
    points: DataFrame
    inertias: list[int]

    @property
    def inertia(self) -> int:
        return sum(self.inertias)


def lloyd(vectors: DataFrame, k: int, rounds: int, dims: int = 64, scale: int = 256, seed: str = "2:", vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> Clusters:
    """Lloyd's rounds over all vectors, in exact integers; the same centroids as by comparing every pair.

    Vectors with other than `dims` components, or a null or non-finite one, are left out, as is a null vector. The k kept
    vectors whose SHA-256 of `seed` and id is least start (equal ids: by their components; a null id: after all others);
    fewer vectors make fewer centroids, and an empty table has none and no rows. Every round assigns each vector to the
    nearest centroid (squared Euclidean distance, ties to the smaller number) and replaces every non-empty centroid by the
    floor of its vectors' mean; then vectors are assigned once more. Repeated vectors and ids are rows by themselves. A
    component of 2**26 or more after scaling is an error, as distances may not fit a long. Other columns play no part.

    Blocks of `block` vectors and their trees are written once and never shuffled; a round moves a row a task and
    centroid. The driver holds k * dims numbers, so k is a parameter of known size.
    """
    points = kept(vectors, dims, scale, vec_id, vector)
    first = points.select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("turn"), "v").orderBy(F.col("turn").asc_nulls_last(), "v").limit(k).collect()
    trees = blocks(points, dims, block)
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    if not first:
        return Clusters(centroids, trees.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), [])
    for _ in range(rounds):
        total = _sums(trees, centroids, dims)
        some = total[:, 0] > 0
        centroids = centroids.copy()
        centroids[some] = total[some, 1:] // total[some, :1]
    over = CoverTree.of(centroids, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, tree in _opened(batch, dims):
                at, distance, _ = assign(tree, x, centroids, over)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = materialize(trees.mapInArrow(tidied(run), "vec_id long, cluster int, distance long"), "assigned")
    each = {r["cluster"]: r["inertia"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows at most
    return Clusters(centroids, out, [int(each.get(i, 0)) for i in range(len(centroids))])


def digests(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 (of the components, joined by commas)."""
    spark = found.points.sparkSession
    facts = [(i, found.inertias[i], found.inertia, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.points.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
