"""Non-negative factors against numpy, and paragraph vectors by the neighbours of near copies."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.functions import text
from tamarack.operators import factors, paragraphs

CELLS = [(d, f"t{t}", 1.0 + (d * t) % 5) for d in range(12) for t in range(9) if (d + t) % 3 or d == 4]


def test_factors_match_numpy_and_losses_fall(spark):
    rows = CELLS + [(3, "t1", 0.5), (1, None, 1.0), (None, "t1", 1.0), (5, "t2", None), (6, "gone", 0.0), (6, "gone", -1.0)]
    df = spark.createDataFrame(rows, "doc_id long, term string, w double").repartition(5)
    k, rounds = 3, 6
    got = factors.factorise(df, topics=k, rounds=rounds, seed=5)
    docs, terms = sorted({r[0] for r in CELLS}), sorted({r[1] for r in CELLS})
    v = np.zeros((len(docs), len(terms)))
    for d, t, w in CELLS + [(3, "t1", 0.5)]:
        v[docs.index(d), terms.index(t)] += w
    first = lambda keys, kind, seed: np.array([list(r)[1:] for r in factors.start(spark.createDataFrame([(x,) for x in keys], f"x {kind}"), "x", k, seed).orderBy("x").collect()])
    w, h = first(docs, "long", 5), first(terms, "string", 6)
    losses = []
    for _ in range(rounds):
        h = h * (v.T @ w) / (h @ (w.T @ w))
        w = w * (v @ h) / (w @ (h.T @ h))
        losses.append(((v - w @ h.T) ** 2).sum())
    assert got.losses == pytest.approx(losses) and all(a > b for a, b in zip(got.losses, got.losses[1:]))
    assert np.array([list(r)[1:] for r in got.terms.orderBy("term").collect()]) == pytest.approx(h)
    assert np.array([list(r)[1:] for r in got.docs.orderBy("doc").collect()]) == pytest.approx(w)
    top = factors.top_terms(got, k, 4).collect()
    for j in range(k):
        own = sorted((r for r in top if r["topic"] == j), key=lambda r: r["rank"])
        assert [r["term"] for r in own] == [t for _, t in sorted(zip(-h[:, j], terms))[:4]]


def test_no_cells(spark):
    got = factors.factorise(spark.createDataFrame([], "doc_id long, term string, w double"))
    assert got.losses == [] and got.docs.count() == got.terms.count() == 0 and factors.top_terms(got, 2).count() == 0


def corpus(n=240):
    """Documents of ten subjects with words of their own, and near copies of every fourth with a few words changed."""
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(900)]
    docs = []
    for i in range(n):
        own = vocabulary[(i % 10) * 60 : (i % 10) * 60 + 120]
        docs.append((i, [rng.choice(own if rng.random() < 0.6 else vocabulary) for _ in range(60)]))
    for i, w in docs[::4]:
        copy = list(w)
        for _ in range(4):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        docs.append((1000 + i, copy))
    return docs


def test_near_copies_are_nearest(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(5000, None), (5001, "!"), (5002, " ".join(docs[0][1]))], "id long, text string").repartition(3)
    w = text.words(F.col("text"))
    known = df.filter("id < 1000")  # copies are seen in inference alone
    model = paragraphs.fit(known, w, dims=32, epochs=6, rows=1 << 12)
    got = {r["id"]: r["vector"] for r in paragraphs.infer(df, "id", w, model).collect()}
    assert got[5000] is None and got[5001] is None and got[5002] == got[0]
    ids = [i for i in got if i < 1000]
    x = np.array([got[i] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    copies = [i for i in got if 1000 <= i < 5000]
    for c in copies:
        near = [ids[j] for j in np.argsort(-(x @ np.array(got[c])))[:3]]
        hits += c - 1000 in near
    assert hits >= 0.9 * len(copies)
    subject = lambda i: ids[np.argsort(-(x @ x[ids.index(i)]))[1]] % 10 == i % 10
    assert sum(map(subject, ids)) >= 0.6 * len(ids)  # by chance a tenth


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    w = text.words(F.col("text"))
    assert [r["vector"] for r in paragraphs.infer(df, "id", w, paragraphs.fit(df, w, dims=4, epochs=1, rows=16)).collect()] == [None, None]


def test_blocks_have_the_factors_of_rows(spark):
    """Blocks of tf-idf have the factors of its rows, words without an id left out; no bucketed table stays in the catalogue."""
    from tamarack.operators import terms

    rng = random.Random(2)
    rows = [(i, [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 40))]) for i in range(60)] + [(60, []), (61, None), (None, ["w1", "only"]), (5, ["w2", "w2"])]
    docs = spark.createDataFrame(rows, "doc_id long, t array<string>").repartition(3)
    plain = factors.factorise(terms.tfidf(docs, "doc_id", F.col("t")), topics=3, rounds=4)
    got = factors.factorise_blocks(terms.tfidf_blocks(docs, "doc_id", F.col("t")), topics=3, rounds=4)
    assert got.losses == pytest.approx(plain.losses) and len(got.losses) == 4
    for a, b, key in ((got.docs, plain.docs, "doc"), (got.terms, plain.terms, "term")):
        x, y = (sorted(tuple(r) for r in f.collect()) for f in (a, b))
        assert [r[0] for r in x] == [r[0] for r in y] and np.array([r[1:] for r in x]) == pytest.approx(np.array([r[1:] for r in y])), key
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("factors_")]


def test_vectors_that_step_together_are_those_of_single_documents():
    """Lots of documents have the vectors that a plain loop gives them, words of a step that come again move by the sum, and draws are
    those of a search."""
    rng = np.random.default_rng(3)
    odds = np.cumsum(np.r_[rng.random(50), np.full(20_000, 1e-9), rng.random(14)])
    odds /= odds[-1]
    u = np.r_[rng.random(20_000), odds[:-1], 0.0]
    assert (paragraphs.Draws(odds)(u) == np.searchsorted(odds, u, "right").clip(0, len(odds) - 1)).all()
    odds = np.linspace(1 / 64, 1, 64)
    docs = [rng.integers(0, 64, n) for n in (1, 5, 32, 33, 70, 3, 200) + (40,) * 20]
    words = rng.random((64, 6), dtype=np.float32) - 0.5

    def plain(ids, table, moving, passes=3, negative=2, rate=0.1):
        g, d = paragraphs._begun(ids, 6, 9)
        for p in range(passes):
            pace = rate * (1 - p / passes)
            order = ids[g.permutation(len(ids))]
            drawn = np.searchsorted(odds, g.random((len(ids), negative)), "right").clip(0, 63)
            for at in range(0, len(ids), paragraphs.STEP):
                rows = np.c_[order, drawn][at : at + paragraphs.STEP].ravel()
                label = np.tile([1.0] + [0.0] * negative, len(rows) // (1 + negative))
                push = (label - 1 / (1 + np.exp(-table[rows] @ d))) * pace
                near = table[rows].copy()
                if moving:
                    for r, x in zip(rows, push):
                        table[r] += x * d
                d = d + push @ near
        return d

    draws = paragraphs.Draws(odds)
    got = paragraphs.vectors(docs + docs[3:4], words, draws, 2, 0.1, 3, 9)
    assert got == pytest.approx(np.array([plain(x, words.astype(float), False) for x in docs + docs[3:4]]), abs=1e-5)
    assert (got[-1] == got[3]).all()
    own, table = words.copy(), words.astype(float)
    for x in docs:
        assert paragraphs.learn(x, own, draws, 2, 0.1, 3, 9, np.empty(64)) == pytest.approx(plain(x, table, True), abs=1e-4)
    assert own == pytest.approx(table, abs=1e-4)


def test_rounds_leave_no_tables_behind(spark):
    """Factors of rounds before are gone once read: as many tables are left after five rounds as after one."""
    from tamarack import session

    df = spark.createDataFrame(CELLS, "doc_id long, term string, w double").repartition(3)
    left = []
    for rounds in (1, 5):
        mark = session.written()
        factors.factorise(df, topics=2, rounds=rounds)
        paths = [p.removeprefix("file:") for p in session._written[mark:]]
        left.append(sum(os.path.exists(p) for p in paths))
        assert len(paths) >= left[-1] + 2 * rounds
    assert left[0] == left[1]
    tables = factors._Bucketed(spark)
    a = tables.stored(df.withColumnRenamed("w", "x").repartition(tables.buckets, "term"), "term")
    b = tables.stored(df.select("term", "w").distinct().repartition(tables.buckets, "term"), "term")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in a.join(b, "term")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        tables.forget()
