"""Searches in pages, mirror probes, hashed LDA and the list of intermediate tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack import session
from tamarack.operators import models
from tamarack.sources import external, sinks


class Found:
    def __init__(self, counts):
        self.counts = counts

    def results(self, phrase, start):
        n = next((n for p, n in self.counts.items() if f'"{p}"' in phrase), 0)
        if n == "down" and start == 1:
            raise OSError("down")
        n = 13 if n == "down" else n
        return [{"title": f"{phrase}", "link": f"http://{i}", "snippet": "s"} for i in range(start, min(start + 10, n + 1))]


def test_searches_go_on_until_a_short_page(spark):
    df = spark.createDataFrame([("npm", p) for p in ("none", "few", "ten", "many", "broken")], "manager string, package string")
    got = external.searched(df, Found({"few": 4, "ten": 10, "many": 250, "broken": "down"}), attempts=2, sleep=lambda s: None).collect()
    by = {}
    for r in got:
        by.setdefault(r["package"], []).append((r["result_index"], r["error"]))
    assert {p: len(v) for p, v in by.items()} == {"few": 4, "ten": 10, "many": 100, "broken": 4}
    assert by["many"] == [(i, None) for i in range(1, 101)] and by["broken"][0] == (1, "OSError: down") and [i for i, _ in by["broken"][1:]] == [11, 12, 13]
    assert {r["title"] for r in got if r["package"] == "few"} == {'"few" "malicious" "npm"'} and {r["display_link"] for r in got} == {None}


class Pages:
    def get(self, url):
        if "down" in url:
            raise OSError("timeout")
        if url.endswith("/list/gone"):
            return 200, "", ["../../files/missing", "http://down"]
        if "/list/" in url:
            return 200, "", ["http://down", "../../files/x"]
        return (404, "", []) if "missing" in url else (200, "Oops 404 Not Found" if "soft" in url else "fine", [])


def test_mirrors_are_probed(spark):
    df = spark.createDataFrame([("a",), ("gone",), ("soft",)], "package string")
    got = external.mirrored(df, Pages(), {"m": "http://m/{}", "l": "http://l/list/{}", "d": "http://down/{}"}, {"l": "http://l/"}).collect()
    assert {(r["package"], r["mirror"]): r["available"] for r in got if r["mirror"] != "d"} == {("a", "m"): True, ("a", "l"): True, ("gone", "m"): True, ("gone", "l"): False, ("soft", "m"): False, ("soft", "l"): True}
    assert {(r["available"], r["error"]) for r in got if r["mirror"] == "d"} == {(False, "OSError: timeout")}


def test_hashed_topics_have_their_words(spark):
    docs = [(i, [f"{'xy'[i % 2]}{(i * 7 + j * 3) % 31}" for j in range(40)]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, w array<string>")
    mixed, terms = models.lda_topics(df, "doc_id", "w", topics=2, iterations=30, share=1.0, columns=1 << 12)
    got = {r["doc_id"]: r["topics"] for r in mixed.collect()}
    assert len({got[i].index(max(got[i])) for i in range(0, 60, 2)}) == 1 and got[0].index(max(got[0])) != got[1].index(max(got[1]))
    words = terms.groupBy("topic").agg(F.collect_set(F.substring("term", 1, 1)).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert all(len(r["s"]) == 1 and r["n"] == 10 for r in words)


def test_intermediate_tables_are_on_one_list(spark):
    mark = session.written()
    held = session.stored(spark.range(3).toDF("i"), "x")
    path = session.scratch(spark, "y")
    spark.range(2).write.parquet(path)
    assert held.count() == 3 and session.written() == mark + 2
    session.discard(spark, mark)
    assert session.written() == mark and not os.path.exists(path.removeprefix("file:"))


class Moody:
    def embed(self, texts):
        if "bad" in texts:
            raise OSError("down")
        return [[float(len(t))] for t in texts]


def test_failing_models_are_rows(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None)], "k int, text string").coalesce(1)
    got = [(r["vector"], r["vector_error"]) for r in external.embeddings(df, Moody(), attempts=2, sleep=lambda s: None).orderBy("k").collect()]
    assert got == [([3.0], None), (None, "OSError: down"), (None, None)]


def test_documents_are_bounded(spark):
    df = spark.range(5)
    assert sinks.json_document(df, "id").first()["json"] == '[{"id":0},{"id":1},{"id":2},{"id":3},{"id":4}]'
    with pytest.raises(ValueError, match="more than 4"):
        sinks.json_document(df, "id", most=4)


def test_counts_are_bytes_and_lots_hold_words_by_topic(spark):
    """No cell is an element of a list that goes to a task; exp(digamma) without branches is that of digamma()."""
    from tamarack.operators import topics

    docs = spark.createDataFrame([(1, [5, 3, 5]), (2, []), (3, None), (4, [70_000])], "d long, w array<int>").coalesce(1)
    counts = topics.counted(docs, "d", F.col("w"))
    assert dict(counts.dtypes) == {"d": "bigint", "at": "binary", "n": "binary"}
    at, n, cuts = topics._cells(counts.orderBy("d").toArrow().combine_chunks().to_batches()[0], 1)
    assert (at.tolist(), n.tolist(), cuts.tolist()) == ([3, 5, 70_000], [1, 2, 1], [0, 2, 2, 2, 3])
    x = np.geomspace(0.02, 1e7, 5000)
    assert topics.grown(x) == pytest.approx(np.exp(topics.digamma(x)), rel=1e-7)
