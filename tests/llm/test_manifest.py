"""The Merkle manifest, centroid clustering and sharding against plain loops, on awkward tables."""

import collections
import glob
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import clustering, merkle, queries, sharding
from tamarack.llm.ranking import ranked
from tests.llm.helpers import awkward, key, prose, table


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """Levels from the leaves to the top."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def others(levels, at):
    """(left siblings, right siblings) of each level on the way up."""
    out = []
    for row in levels[:-1]:
        start = at - at % 3
        out.append((row[start:at], row[at + 1 : start + 3]))
        at //= 3
    return out


def manifest_of(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row, by plain loops."""
    groups = collections.defaultdict(list)
    for r in rows:
        hurt = r["text"]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and hurt is not None:
            hurt = hurt.replace("\n", "")
        fields = [r[c] for c in ("doc_id", "source", "lang", "n_chars")]
        groups[r["source"]].append((r["doc_id"], leaf_of([*fields, r["text"]]), leaf_of([*fields, hurt])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(tree([r[1] for r in groups[s]]))
    top, out = tree([t[-1][0] for t in trees]), []
    for g, s in enumerate(order):
        for i, (doc_id, leaf, claim) in enumerate(groups[s]):
            sibs, folded = others(trees[g], i) + others(top, g), claim
            for left, right in sibs:
                folded = sha("".join([*left, folded, *right]))
            proof = sha("".join("".join([*left, *right]) for left, right in sibs))
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def same(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in NAMES) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    order = lambda r: (key(r[0]), r[1:])
    assert sorted(got, key=order) == sorted(manifest_of([r.asDict() for r in df.collect()]), key=order)
    return got


@pytest.mark.parametrize("extra", [False, True])
def test_manifest_of_awkward_rows(spark, tmp_path, extra):
    """Null ids, sources and texts, repeated rows, empty and long texts, clashing columns."""
    df = table(spark, extra=extra)
    if extra:
        for c in ("key", "index", "n", "digest", "claim", "group", "id", "leaf"):
            df = df.withColumn(c, F.lit("x"))
    same(spark, df, tmp_path)


def test_manifest_with_a_hot_source_and_every_level(spark, tmp_path, monkeypatch):
    """Sources of 1 to 800 rows; node table joined (HELD small) and broadcast alike."""
    rows = [(i, prose(i, 5) + ("\n" if i % 3 else ""), None, "hot" if i < 800 else f"s{i % 17}", i) for i in range(900)]
    rows += [(5000 + i, "x\ny", "en", f"own{i}", None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = same(spark, df, tmp_path)
    assert {r[-1] for r in found} == {True, False}
    monkeypatch.setattr(merkle, "HELD", 20)
    again = [tuple(r[c] for c in NAMES) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(again) == sorted(found)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_small_manifests(spark, tmp_path, n):
    rows = [(i, f"{i}\n", "en", "s", 2) for i in range(n)]
    found = same(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), tmp_path)
    assert len(found) == n


def test_a_proof_needs_nothing_else(spark):
    """The siblings alone lead from a leaf to the root, and a changed record does not verify."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(40)], "doc_id long, source string, text string")
    leaf = merkle.digest_of([F.col("doc_id"), F.col("text")])
    claim = F.when(F.col("doc_id") == 7, merkle.digest_of([F.col("doc_id"), F.lit("other")])).otherwise(leaf)
    proofs = merkle.prove(merkle.build(docs, leaf, claim=claim))
    for r in merkle.verify(proofs).collect():
        d, at = r["claim"], {}
        for part, index in ((r["siblings"], r["index"]), (r["top_siblings"], r["tree"])):
            levels = r["depth"] if part is r["siblings"] else r["levels"]
            for level in range(levels):
                run = {s["index"]: s["digest"].hex() for s in part if s["level"] == level} | {index // 3**level: d}
                d = sha("".join(run[i] for i in sorted(run)))
        assert d == r["folded_root"] and r["verified"] == (r["id"] != 7)
    assert merkle.verify(proofs.withColumn("claim", F.lit(None).cast("string"))).filter("verified").count() == 0


def test_ranks_within_groups(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 40}", None if i % 7 == 0 else i % 90) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(13)
    got = collections.defaultdict(list)
    for r in ranked(df, "g", ["v"]).collect():
        got[r["g"]].append((r["index"], r["v"], r["n"]))
    for g, found in got.items():
        own = sorted((v for k, v in rows if k == g), key=key)
        assert [v for _, v, _ in sorted(found, key=lambda x: x[0])] == own
        assert [i for i, _, _ in sorted(found, key=lambda x: x[0])] == list(range(len(own))) and {n for _, _, n in found} == {len(own)}


def lloyd_of(rows, k, rounds, scale=256, dims=64):
    """Every pair compared, in Python integers."""
    own = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted(own, key=lambda r: (r[0] is None, sha(f"2:{r[0]}"), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        sums = collections.defaultdict(list)
        for _, v in own:
            sums[near(v)[1]].append(v)
        c = [[sum(x) // len(sums[j]) for x in zip(*sums[j])] if sums[j] else w for j, w in enumerate(c)]
    return c, [(i, near(v)[1], near(v)[0]) for i, v in own]


def vectors(n, dims, seed=0):
    """Loose groups, copies, ties, nulls, odd lengths and non-finite components."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in centres[i % 5]]) for i in range(n)]
    rows += [(n + i, centres[0]) for i in range(n // 3)] + [(n, centres[1]), (n, centres[1])]
    rows += [(-1, None), (-2, []), (-3, [0.5] * (dims - 1)), (-4, [0.5] * (dims - 1) + [None]), (-5, [float("nan")] * dims), (-6, [float("inf")] + [0.0] * (dims - 1)), (None, centres[2])]
    return rows


@pytest.mark.parametrize("n,k,block", [(150, 12, 32), (40, 200, 2048), (3, 4, 8)])
def test_dual_tree_rounds_equal_all_pairs(spark, n, k, block):
    rows = vectors(n, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1)).repartition(5)
    data = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    found = clustering.lloyd(df, k=k, rounds=4, dims=8, block=block)
    c, want = lloyd_of(data, k, 4, dims=8)
    assert found.centroids.tolist() == c
    order = lambda r: (key(r[0]), r[1:])
    assert sorted(map(tuple, found.points.collect()), key=order) == sorted(want, key=order)
    for r in clustering.digests(found).collect():
        assert r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"]) and r["inertia"] == sum(d for _, _, d in want)
        assert r["centroid_sha256"] == sha(",".join(map(str, c[r["cluster"]])))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clustering.digests(clustering.lloyd(df, k=4, rounds=2)).count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.lloyd(spark.createDataFrame([(1, [1e9, 1.0])], "vec_id long, embedding array<float>"), k=1, rounds=1, dims=2)


@pytest.mark.parametrize("leaf", [1, 8])
def test_cover_tree_invariants(leaf):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-500, 500, (300, 6)), np.repeat(rng.integers(-500, 500, (1, 6)), 50, 0), rng.integers(0, 3, (60, 6))])
    t = clustering.CoverTree.of(x, leaf)
    assert sorted(t.order.tolist()) == list(range(len(x)))
    for i in range(len(t.begin)):
        own = x[t.order[t.begin[i] : t.end[i]]]
        gap = np.sqrt(np.square(own - own[0]).sum(-1))
        assert t.radius[i] == gap.max()
        if not t.children[i]:
            assert len(own) <= leaf or gap.max() == 0
            continue
        kids = range(t.child[i], t.child[i] + t.children[i])
        heads = np.array([x[t.order[t.begin[j]]] for j in kids])
        scale = 2.0 ** (np.ceil(np.log2(gap.max())) - 1)
        apart = np.sqrt(np.square(heads[:, None] - heads[None]).sum(-1)) + np.eye(len(heads)) * 1e9
        assert (heads[0] == own[0]).all() and apart.min() > scale
        assert t.begin[kids[0]] == t.begin[i] and t.end[kids[-1]] == t.end[i] and all(t.end[j] == t.begin[j + 1] for j in kids[:-1])
        for j in kids:
            below = x[t.order[t.begin[j] : t.end[j]]]
            assert np.sqrt(np.square(below - below[0]).sum(-1)).max() <= scale


def test_bounds_prune_without_loss():
    """Grouped points need a small share of all pairs; ties go to the smaller number in any case."""
    rng = np.random.default_rng(1)
    groups = rng.integers(-4000, 4000, (30, 8))
    x = groups[rng.integers(0, 30, 2000)] + rng.integers(-40, 40, (2000, 8))
    c = np.concatenate([groups + rng.integers(-40, 40, groups.shape), groups[:3], groups[:3]])
    t, over = clustering.CoverTree.of(x), clustering.CoverTree.of(c, 1)
    at, d, seen = clustering.assign(t, x, c, over)
    every = np.square(x[:, None] - c[None]).sum(-1)
    assert (d == every.min(1)).all() and (at == every.argmin(1)).all()
    whole, _, _ = clustering.assign(t, x, c, over, whole=True)
    assert (whole == at).all() and seen["node_pairs"] + seen["point_pairs"] < 0.25 * every.size
    same = np.zeros((50, 4), np.int64)
    assert clustering.assign(clustering.CoverTree.of(same), same, same[:7], clustering.CoverTree.of(same[:7], 1))[0].tolist() == [0] * 50


def sharded(spark, df, **how):
    return [tuple(r) for r in sharding.shard(df, **how).select("id", "size", "text_crc32", "shard", "slot").collect()]


def laws(rows, got, shards=8):
    """Every row once with its size and checksum, slots without gaps; the bytes of each shard."""
    facts = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=lambda r: (key(r[0]), r[1:]))
    assert sorted((r[:3] for r in got), key=lambda r: (key(r[0]), r[1:])) == facts
    held, slots = collections.Counter(), collections.defaultdict(list)
    for _, size, _, s, slot in got:
        assert 0 <= s < shards
        held[s] += size
        slots[s].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return [held[s] for s in range(shards)]


def test_shards_are_near_equal_with_a_hot_copy(spark):
    """A text with 40 % of all bytes is cut within; other copies stay in one shard; empty texts are many."""
    rows = [(i, prose(i, 3 + i % 40)) for i in range(3000)] + [(10_000 + i, prose(77, 60)) for i in range(1200)] + [(20_000 + i, None if i % 2 else "") for i in range(2500)] + [(30_000 + i, prose(i % 20 + 5000, 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("first", F.lit(1)).repartition(7)
    got = sharded(spark, df)
    held = laws(rows, got)
    largest = max(len((t or "").encode()) for _, t in rows) + 1
    assert max(held) - min(held) <= sum(held) / 8 / 50 + 2 * largest
    at = collections.defaultdict(set)
    texts = dict(rows)
    for i, _, _, s, _ in got:
        at[texts[i]].add(s)
    assert len(at[prose(77, 60)]) >= 3 and all(len(at[prose(i + 5000, 30)]) == 1 for i in range(20))
    laws(rows, sharded(spark, df.coalesce(2), ranges=4, draws=2))


def test_shards_of_awkward_rows(spark):
    rows = awkward()
    laws(rows, sharded(spark, table(spark, extra=True)))
    assert sharded(spark, table(spark, [])) == []
    assert laws([(1, "x")], sharded(spark, table(spark, [(1, "x")]))).count(2) == 1
    same = [(4, "copy")] * 900  # rows alike in everything are still dealt out
    held = laws(same, sharded(spark, spark.createDataFrame(same, "doc_id long, text string")))
    assert max(held) <= 1.1 * min(held)
    long_ = [(i, "y" * (200_000 if i == 5 else 50)) for i in range(400)]
    laws(long_, sharded(spark, spark.createDataFrame(long_, "doc_id long, text string")))


def test_ranges_are_found_by_bisection():
    rng = np.random.default_rng(2)
    cuts = sharding.Splitters().with_more({(int(a), int(b)) for a, b in zip(rng.integers(-5, 5, 60), rng.integers(-9, 9, 60))} | {(3, sharding.LEAST)})
    a, b = rng.integers(-6, 7, 500), rng.integers(-10, 10, 500)
    pairs = list(zip(cuts.first.tolist(), cuts.second.tolist()))
    assert pairs == sorted(pairs)
    assert cuts.ranges(a, b).tolist() == [sum(p <= (x, y) for p in pairs) for x, y in zip(a.tolist(), b.tolist())]


def test_written_shards(spark, tmp_path):
    rows = [(i, prose(i, 20), f"u{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string")
    sharding.write(df, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "first").collect()) == sorted(rows)
    sizes = [r[0] for r in back.groupBy("shard").agg(F.sum(F.octet_length("text"))).select("sum(octet_length(text))").collect()]
    assert len(glob.glob(f"{tmp_path}/out/shard=*")) == 4 and max(sizes) < 1.1 * min(sizes)
