"""The command line, reports, and small rules that files and pages bring."""

import json

from pyspark.sql import functions as F

from tamarack import __main__ as command
from tamarack.functions import html, normalise
from tamarack.operators import compare, dedupe, resolve
from tamarack.sources import sinks


def test_command_line(spark, sf_dir, tmp_path):
    said = []
    (tmp_path / "c.json").write_text(json.dumps({"data": sf_dir, "out": str(tmp_path / "out"), "type": "json"}))
    assert command.main(["--list"], spark, said.append) == 0 and "vote_event_type" in said
    assert command.main(["nothing"], spark, said.append) == 2
    assert command.main(["region_revenue", "--config", str(tmp_path / "c.json")], spark, said.append) == 0
    assert spark.read.json(str(tmp_path / "out/region_revenue")).count() > 0
    (tmp_path / "docs/a").mkdir(parents=True)
    (tmp_path / "docs/a/20240101_1_1.txt").write_text("text")
    said.clear()
    command.main(["--status", str(tmp_path / "docs"), "--sources", "a", "--out", str(tmp_path / "out")], spark, said.append)
    assert said[1].startswith("a\t1\t4") and spark.read.text(str(tmp_path / "out/status")).count() == 2


def test_tee_shows_and_keeps_a_report(spark, tmp_path):
    said = []
    sinks.tee(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), str(tmp_path / "r"), said.append)
    assert said == ["a\tb", "1\t", "2\tx"] == [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]


def test_facts_with_a_repeated_key_count_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    facts = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1)], "k int, f string, at int")
    assert sorted(tuple(r) for r in compare.enrich(rows, facts, ["k"], {"f": "none"}, order="at").select("k", "f").collect()) == [(1, "x"), (2, "none")]
    assert compare.update_where(rows, facts, ["k"], "v", "f", F.lit(True)).count() == 2
    assert compare.latest_facts(facts.select("k"), ["k"]).count() == 2


def test_first_conflicts(spark):
    records = spark.createDataFrame([(k, v) for k in "abcd" for v in ("1", "1" if k == "b" else "2")], "k string, v string")
    assert [tuple(r) for r in resolve.first_conflicts(resolve.conflict_profile(records, "k", ["v"]), "k").collect()] == [("a", "v"), ("c", "v"), ("d", "v")]


def test_names_that_are_no_packages(spark):
    rows = spark.createDataFrame([("pip", "x"), ("cctx", "x"), (None, "x"), ("ok", "Malicious Package")], "n string, t string")
    assert sorted(str(r["n"]) for r in normalise.without_names(rows, "n").collect()) == ["None", "ok"]
    assert normalise.of_type(rows, "t").count() == 1 and [r["l"] for r in rows.select(normalise.lowered(F.array(F.upper("n"))).alias("l")).collect()][3] == ["ok"]


def test_files_of_one_time(spark):
    rows = spark.createDataFrame([(2, "t"), (1, "t"), (3, "u")], "id int, changed string")
    assert sorted(r["id"] for r in dedupe.by_time(rows, "changed", F.col("id")).collect()) == [1, 3]


def test_pages(spark):
    page = "<body><A class=x HREF='one'>1</a><a href=\"two\">2</a><a href=three>3</a><div class='page-header big'>Top <b>line</b></div><h2>Head</h2><article>The <i>story</i></article><p>rest</p><code>x = 1</code></body>"
    r = spark.createDataFrame([(page,)], "h string").select(html.hrefs(F.col("h")).alias("a"), html.headers(F.col("h")).alias("t"), html.summary(F.col("h")).alias("s"), html.code_blocks(F.col("h")).alias("c")).first()
    assert (r["a"], r["t"], r["s"], r["c"]) == (["one", "two", "three"], ["Head", "Top line"], "The story", ["x = 1"])
    blocks = html.blocks_of("<table><tr><td>1</td></tr><tr><td>1</td></tr></table><ul><li>a</li><li>a</li></ul><p>p</p><p>p</p><iframe srcdoc='<p>inside</p>'></iframe><iframe src='http://e'></iframe>")
    assert [(b["kind"], b["text"]) for b in blocks] == [("row", "1"), ("row", "1"), ("li", "a"), ("li", "a"), ("p", "p"), ("p", "inside"), ("iframe", "http://e")]
