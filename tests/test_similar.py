"""Neighbours through buckets: recall against the exact join, copies, and vectors without a direction."""

import itertools

import numpy as np
import pytest

from tamarack import plans
from tamarack.operators import blocks, graph, similar


def test_recall_against_the_exact_join(spark, sf_dir):
    got = plans.QUERIES["cosine_top5_lsh"](spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    found = {(r["query"], r["match"]): r["similarity"] for r in got.collect()}
    exact = {(r["query"], r["match"]): r["similarity"] for r in plans.QUERIES["cosine_top5"](spark, sf_dir).collect()}
    assert len(found) == len(exact)
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(found[p] == exact[p] for p in found.keys() & exact.keys())


def test_recall_on_grouped_vectors_with_few_candidates(spark):
    rng = np.random.default_rng(3)
    groups = rng.standard_normal((40, 16))
    x = groups[rng.integers(0, 40, 1500)] + 0.4 * rng.standard_normal((1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    q = df.filter("i % 30 = 0")
    got = {(r["query"], r["match"]) for r in similar.close_neighbours(q, df, "i", "v", dims=16, tables=12, bits=8, most=10).collect()}
    want = {(r["query"], r["match"]) for r in graph.neighbours(q, df, "i", "v").collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_copies_and_vectors_without_direction(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(300)] + [(1000, [1.0, 2.0, 0.6]), (1001, [-1.0, 0.0, 1.0])]
    rows += [(2000, None), (2001, [0.0, 0.0, 0.0]), (2002, [1.0, float("nan"), 0.0]), (2003, [1.0, None, 0.0]), (2004, [1.0]), (None, [1.0, 2.0, 0.5]), (7, [1.0, 2.0, 0.5])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    got = similar.close_neighbours(df.filter("i in (3, 1000, 2000, 2001)"), df, "i", "v", dims=3, tables=8, bits=4, most=8).collect()
    by = {q: [(r["match"], r["rank"]) for r in sorted(g, key=lambda r: r["rank"])] for q, g in itertools.groupby(sorted(got, key=lambda r: r["query"]), key=lambda r: r["query"])}
    assert by == {3: [(0, 1), (1, 2), (2, 3), (4, 4), (5, 5)], 1000: [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]}
    assert similar.close_neighbours(df, df.limit(0), "i", "v", dims=3).count() == 0


@pytest.mark.parametrize("bits,most", [(5, 32), (8, 20), (3, 100)])
def test_probes_are_the_cheapest_sets(bits, most):
    m = np.random.default_rng(bits).standard_normal((7, bits))
    got = similar.probes(m, most)
    for row, sets in zip(m, got):
        cost = lambda s: sum(row[j] ** 2 for j in range(bits) if s >> j & 1)
        want = sorted(cost(s) for s in range(1 << bits))[:most]
        assert len(set(sets.tolist())) == len(sets) and sorted(map(cost, sets.tolist())) == pytest.approx(want)


def test_exact_neighbours_go_through_products(spark):
    """No pair is a row before the best k of a task; odd vectors, copies and ties are as in plain loops."""
    rng = np.random.default_rng(8)
    x = [rng.standard_normal(6).tolist() for _ in range(80)] + [[1.0, 2.0, 0.5, 0.0, 0.0, 1.0]] * 40
    rows = list(enumerate(x)) + [(500, None), (501, [0.0] * 6), (502, [1.0]), (503, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>").repartition(4)
    plan = graph.neighbours(df.filter("i < 100"), df.filter("i < 120"), "i", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    for block in (1 << 16, 30):
        got = {(r["query"], r["rank"]): (r["match"], r["similarity"]) for r in graph.neighbours(df.filter("i % 9 = 0"), df, "i", "v", block=block).collect()}
        for q in range(0, 120, 9):
            a = np.array(x[q])
            want = sorted((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), m) for m, b in ((m, np.array(b)) for m, b in enumerate(x)) if m != q)[:5]
            assert [got[q, r] for r in range(1, 6)] == [(m, pytest.approx(-s, abs=1e-9)) for s, m in want]


def test_no_pair_of_a_bucket_is_a_row(spark):
    """Buckets are held as bits: what counts is what shares one in plain loops, and the plan has no exchange of pairs."""
    rng = np.random.default_rng(6)
    q, x = rng.standard_normal((21, 8)), rng.standard_normal((50, 8))
    planes = similar.projections(8, 3, 4, 1)
    got = similar.Shared(q, planes, 5)(x, 0, 21)
    code = lambda v, p: sum(int(z > 0) << j for j, z in enumerate(v @ p))
    want = [[any(code(b, p) in {code(a, p) ^ int(f) for f in similar.probes((a @ p)[None], 5)[0]} for p in planes) for b in x] for a in q]
    assert got.tolist() == want
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    plan = similar.close_neighbours(df.filter("i < 9"), df, "i", "v", dims=8)._jdf.queryExecution().executedPlan().toString()
    assert "code" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_later_rows_of_a_task_are_passed_over_by_bounds(spark, monkeypatch, kind):
    """Every row of a table is asked for; a task that meets its rows in many parts keeps the best of plain loops, ties by the smaller key."""
    monkeypatch.setattr(blocks, "ROWS", 7)
    monkeypatch.setattr(blocks, "QUERIES", 16)
    rng = np.random.default_rng(5)
    x = np.r_[np.round(rng.standard_normal((90, 3))), np.tile([[1.0, 2.0, 0.0]], (12, 1))]
    x = x[np.abs(x).sum(1) > 0][rng.permutation(int((np.abs(x).sum(1) > 0).sum()))]
    name = (lambda i: i) if kind == "long" else (lambda i: "n" * (i % 9) + str(i))
    df = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(x)], f"i {kind}, v array<double>").coalesce(2)
    run = blocks.best(df.selectExpr("i as match", "v"), df.selectExpr("i as query", "v as q"), 3, 4, 6).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(unit @ unit.T, 6)
    for i in range(len(x)):
        got = sorted({(-r["similarity"], r["match"]) for r in run if r["query"] == name(i)})[:4]
        want = sorted((-s[i, j], name(j)) for j in range(len(x)) if j != i)[:4]
        assert [m for _, m in got] == [m for _, m in want] and [v for v, _ in got] == pytest.approx([v for v, _ in want])


def test_every_vector_is_a_query(spark, sf_dir):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    for name in ("cosine_top5", "cosine_top5_lsh"):
        assert {r["query"] for r in plans.QUERIES[name](spark, sf_dir).collect()} == ids
