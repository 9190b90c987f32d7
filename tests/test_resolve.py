from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarack.operators import dedupe
from tamarack.operators.resolve import conflict_profile, conflict_summary, resolve, vote

RECORD = "name string, manager string, method array<string>, version array<string>, post_date string, seq long"


def winner(spark, rows, key=None):
    df = spark.createDataFrame([("p", v, d, i) for i, (v, d) in enumerate(rows)], "name string, v string, d string, seq long")
    out = vote(df, ["name"], "v", "d", "seq", key).collect()
    return out[0]["winner"] if out else None


def test_majority(spark):
    assert winner(spark, [("x", None), ("x", None), ("y", "2024-09-09")]) == "x"


def test_tie_goes_to_the_latest_date(spark):
    assert winner(spark, [("x", "2024-01-01"), ("y", "2024-02-01")]) == "y"


def test_tie_without_dates_goes_to_the_first(spark):
    assert winner(spark, [("b", None), ("a", None)]) == "b"
    assert winner(spark, [("b", "2024-01-01"), ("a", "2024-01-01")]) == "b"


def test_null_values_do_not_vote(spark):
    assert winner(spark, [(None, "2024-01-01"), ("a", None)]) == "a"
    assert winner(spark, [(None, None)]) is None


def test_list_permutations_are_one_vote(spark):
    df = spark.createDataFrame([("p", ["b", "a"], "1", 0), ("p", ["a", "b"], "2", 1), ("p", ["c"], "3", 2)], "name string, v array<string>, d string, seq long")
    out = vote(df, ["name"], "v", "d", "seq", F.array_join(F.array_sort("v"), ",")).first()
    assert out["winner"] == ["b", "a"] and out["votes"] == 2


def test_rows_without_a_key_are_dropped(spark):
    df = spark.createDataFrame([(None, "x", "1", 0), ("", "x", "1", 1)], "name string, v string, d string, seq long")
    assert vote(df, ["name"], "v", "d", "seq").count() == 0


def records(spark):
    return spark.createDataFrame(
        [("p", "npm", ["m1"], ["1"], "2024-01-01", 0), ("p", "npm", ["m1"], ["2"], "2024-03-01", 1), ("p", "npm", ["m2"], None, "2024-05-01", 2), ("q", "pypi", ["m3"], ["9"], None, 3)],
        RECORD,
    )


def test_reference_merge_keeps_the_latest_null(spark):
    out = {r["name"]: r for r in resolve(records(spark), ["name", "manager"], ["method"], ["version"], [], "post_date", "seq").collect()}
    assert out["p"]["method"] == ["m1"] and out["p"]["version"] is None and out["p"]["n_records"] == 3
    assert out["q"]["version"] == ["9"]


def test_union_merge_unites(spark):
    out = {r["name"]: r for r in resolve(records(spark), ["name", "manager"], ["method"], ["version"], [], "post_date", "seq", mode="union").collect()}
    assert out["p"]["version"] == ["1", "2"]


def test_profile_counts_an_empty_field_as_direct(spark):
    df = spark.createDataFrame([("p", "a", None), ("p", "b", None), ("solo", "x", "y")], "name string, f string, g string")
    out = {r["field"]: r for r in conflict_profile(df, "name", ["f", "g"]).collect()}
    assert out["f"]["needs_vote"] and not out["g"]["needs_vote"] and len(out) == 2
    total = {r["field"]: r for r in conflict_summary(conflict_profile(df, "name", ["f", "g"])).collect()}
    assert (total["f"]["voting"], total["g"]["direct"]) == (1, 1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["2024-01-01", "2024-02-01", None])), min_size=1, max_size=8), st.randoms())
def test_vote_ignores_row_order(spark, rows, rng):
    keyed = [("p", v, d, i) for i, (v, d) in enumerate(rows)]
    shuffled = keyed[:]
    rng.shuffle(shuffled)
    make = lambda r: vote(spark.createDataFrame(r, "name string, v string, d string, seq long"), ["name"], "v", "d", "seq").first()["winner"]
    assert make(keyed) == make(shuffled)


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string")
    once = dedupe.by_md5(df, "text", F.col("id"))
    assert sorted(r["id"] for r in once.collect()) == [1, 3]
    assert dedupe.by_md5(once, "text", F.col("id")).count() == 2
    assert sorted(r["id"] for r in dedupe.survivors(df, [F.col("text")], F.col("id"), "last").collect()) == [2, 3]
