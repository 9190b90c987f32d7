"""Entities over overlapping parts, agents in rounds, and the bucketed cache."""

import re

import pytest
from pyspark.sql import functions as F

from tamarack import plans
from tamarack.sources import agents


class Rules:
    def __init__(self, patterns):
        self.patterns = patterns

    def entities(self, part):
        if "BOOM" in part:
            raise OSError("down")
        return [(m.start(), m.end(), k) for k, p in self.patterns.items() for m in re.finditer(p, part)]


TEXTS = ["", None, "x1 " * 400, "word " * 100 + "AAA" * 150 + " end " * 50, "12345 " * 300, "no space" * 200, "AB12 ABAB 77 " * 90, "1" * 5000, "a" * 99 + "123" + "b" * 99 + "45 " * 70]


@pytest.mark.parametrize("most,overlap", [(100, 20), (64, 33), (200, 50), (5000, 100)])
def test_parts_find_what_the_whole_text_has(spark, most, overlap):
    rules = Rules({"number": "[0-9]+", "caps": "[A-Z]+"})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, text string").withColumn("kind", F.lit("clash"))
    got = agents.entity_spans(docs, rules, "k", most=most, overlap=overlap, sleep=lambda s: None).collect()
    want = {(i, a, z, k, t[a:z]) for i, t in enumerate(TEXTS) for a, z, k in rules.entities(t or "")}
    assert {(r["k"], r["start"], r["end"], r["kind"], r["entity"]) for r in got} == want and len(got) == len(want)


def test_a_failing_part_is_a_row(spark):
    docs = spark.createDataFrame([(1, "11 " * 60 + "BOOM " + "22 " * 60)], "k int, text string")
    got = agents.entity_spans(docs, Rules({"n": "[0-9]+"}), "k", most=60, overlap=10, attempts=2, sleep=lambda s: None).collect()
    bad = [r for r in got if r["error"]]
    assert bad and all("OSError" in r["error"] and r["start"] <= 180 < r["end"] for r in bad)
    assert {r["entity"] for r in got if not r["error"]} == {"11", "22"}


def test_parts_overlap():
    for text in ("word " * 90, "x" * 450):
        parts = list(agents.overlapping(text, 100, 30))
        assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(z - a <= 100 for a, z in parts)
        assert all(a2 <= z - 29 and a2 > a for (a, z), (a2, _) in zip(parts, parts[1:]))
    with pytest.raises(ValueError):
        list(agents.overlapping("abc", 5, 5))


class Crew:
    """Workers agree on some texts, need the integrator on others; the checker refuses by the text."""

    def ask(self, role, text, temperature):
        if text.startswith("down"):
            raise OSError("down")
        if role == "worker":
            return f"[{text}]" if "split" not in text else f"[{text} {temperature}]"
        if role == "integrator":
            return f"[joined {text.splitlines()[0]}]"
        return "no" if "never" in text else "OK"


def test_rounds_are_bounded_and_every_part_has_a_row(spark):
    rows = [(1, "good"), (2, "split"), (3, "never"), (4, "down"), (5, None), (5, "good"), (None, "open ["), (7, "good")]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("answer", F.lit("clash"))
    got = agents.agreed(df, Crew(), "k", rounds=3, attempts=2, sleep=lambda s: None).collect()
    by = sorted(((r["k"], r["round"], r["answer"], r["votes"], r["state"]) for r in got), key=str)
    assert by == sorted([(1, 1, "[good]", 3, "done"), (2, 1, "[joined split]", 0, "done"), (3, 3, "[never]", 3, "refused"), (4, 1, None, None, "failed"), (5, 1, "[]", 3, "done"), (5, 1, "[good]", 3, "done"), (None, 3, "[open []", 3, "refused"), (7, 1, "[good]", 3, "done")], key=str)
    assert [r["error"] for r in got if r["state"] == "failed"] == ["OSError: down"]
    assert agents.agreed(df.limit(0), Crew(), "k").count() == 0


class Slow:
    """The checker accepts a text in the round its number says; calls are counted by the rows that come back."""

    def ask(self, role, text, temperature):
        return "OK" if role == "checker" and text == "[1]" else "no" if role == "checker" else f"[{text}]"


def test_only_refused_parts_go_on(spark):
    df = spark.createDataFrame([(i, str(i % 4)) for i in range(40)], "k int, text string")
    got = agents.agreed(df, Slow(), "k", rounds=2).groupBy("state", "round").count().collect()
    assert {(r["state"], r["round"], r["count"]) for r in got} == {("done", 1, 10), ("refused", 2, 30)}


def test_the_cache_joins_without_an_exchange(spark, sf_dir):
    df = plans.QUERIES["cached_join"](spark, sf_dir)
    assert df.count() > 0
    plan = plans.QUERIES["cached_join"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
