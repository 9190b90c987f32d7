from pyspark.sql import functions as F

from tamarack.operators import compare, graph, stats, terms


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_prf1(spark):
    t, g = frame(spark, [("a",), ("b",)], "n string"), frame(spark, [("b",), ("c",)], "n string")
    r = compare.prf1(t, g, "n").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)
    empty = frame(spark, [], "n string")
    r = compare.prf1(empty, empty, "n").first()
    assert (r["tp"], r["precision"], r["recall"], r["f1"]) == (0, 0.0, 0.0, 0.0)


def test_overlap_adds_up(spark):
    a, b = frame(spark, [(i,) for i in range(10)], "k int"), frame(spark, [(i,) for i in range(7, 15)], "k int")
    r = compare.overlap(a, b, ["k"]).first()
    assert (r["common"], r["only_a"], r["only_b"]) == (3, 7, 5)


def test_mark_never_multiplies(spark):
    left, right = frame(spark, [("a",), ("a",), ("b",)], "k string"), frame(spark, [("a",), ("a",)], "k string")
    assert sorted((r["k"], r["found"]) for r in compare.mark(left, right, ["k"]).collect()) == [("a", True), ("a", True), ("b", False)]


def test_either_in_keeps_each_row_once(spark):
    rows, keys = frame(spark, [(1, 2), (3, 4), (2, 1), (5, 1)], "a int, b int"), frame(spark, [(1,), (2,)], "k int")
    assert sorted(tuple(r) for r in compare.either_in(rows, "a", "b", keys, "k").collect()) == [(1, 2), (2, 1), (5, 1)]


def test_neighbours_in_blocks_equal_one_block(spark):
    rows = frame(spark, [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, v array<float>")
    q = rows.filter("id < 9")
    one = sorted(map(tuple, graph.neighbours(q, rows, "id", "v", 3).collect()))
    assert one == sorted(map(tuple, graph.neighbours(q, rows, "id", "v", 3, block=2).collect())) and len(one) == 27


def test_tfidf_has_unit_length(spark):
    docs = frame(spark, [(1, "a b b"), (2, "b c"), (3, "c c d")], "doc_id long, text string")
    w = terms.tfidf(docs, "doc_id", F.split("text", " "))
    assert all(abs(r["s"] - 1) < 1e-9 for r in w.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect())


def test_first_available_and_overrides(spark):
    rows = frame(spark, [("p", "m2", 2, True), ("p", "m1", 1, False), ("p", "m3", 3, True)], "k string, o string, pr int, ok boolean")
    assert stats.first_available(rows, "k", "o", "pr", F.col("ok")).first()["o"] == "m2"
    assert stats.overridden(rows, "k", {"p": 99}).first()["n"] == 99


def test_complete_is_division(spark):
    done = frame(spark, [("f", "a"), ("f", "b"), ("g", "a")], "file string, model string")
    assert [r["file"] for r in compare.complete(done, "file", "model", 2).collect()] == ["f"]
