"""From extraction files to resolved packages and the front end's table."""

import datetime

import pytest
from pyspark.sql import functions as F

from tamarack.functions.nested import triage
from tamarack.operators import records
from tamarack.sources import readers

FILES = {
    "blog/m1/cot/20240101_000000_000001_verify.json": '[{"Package Name": ["evil", "bad"], "Package Manager": "PyPI", "Version": "1.0", "Method of Attack": ["typosquatting"], "Discoverer": "A"}]',
    "news/m1/cot/20240201_000000_000001_verify.json": '```json\n[{"package_name": "evil", "package_manager": "pip", "Version": ["1.0", "2.0"], "Attack Method": "typosquatting", "Discoverer": "B"}]\n```',
    "wire/m2/cot/20240301_000000_000001_verify.json": 'Sure: [{"Package Name": "evil", "Package Manager": "python", "Method of Attack": "hijack", "Discoverer": "C"}]',
    "wire/m2/cot/20240302_000000_000001_verify.json": "[]",
    "wire/m2/cot/20240303_000000_000001_verify.json": '[{"Package Name": "cut"',
    "wire/m2/cot/20240303_000000_000001_extract.json": '[{"Package Name": "other step"}]',
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("outputs")
    for name, body in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(body)
    links = spark.createDataFrame([("20240101_000000_000001", "2024-01-01", "http://a"), ("20240201_000000_000001", "2024-02-01", "http://b"), ("20240301_000000_000001", "2024-03-01", "http://c")], "timestamp string, date string, link string")
    outputs = readers.model_outputs(spark, str(top))
    return outputs, links, records.from_outputs(outputs, links).cache()


def test_bad_outputs_are_counted(rows):
    assert {r["state"]: r["count"] for r in triage(rows[0]).groupBy("state").count().collect()} == {"good": 3, "empty": 1, "bad": 1}


def test_records(rows):
    got = sorted((r["package_name"], r["package_manager"], r["source"], r["post_date"]) for r in rows[2].collect())
    assert got == [("bad", "pypi", "blog", "2024-01-01"), ("evil", "pypi", "blog", "2024-01-01"), ("evil", "pypi", "news", "2024-02-01"), ("evil", "pypi", "wire", "2024-03-01")]


def test_resolved_package(rows):
    got = {r["package_name"]: r for r in records.aggregate(rows[2]).collect()}
    evil = got["evil"]
    assert evil["attack_method"] == ["typosquatting"] and evil["discoverer"] == ["C"] and evil["n_records"] == 3
    assert evil["version"] is None and evil["source"] == ["blog", "news", "wire"] and evil["source_link"] == ["http://a", "http://b", "http://c"]
    united = {r["package_name"]: r for r in records.aggregate(rows[2], "union").collect()}
    assert united["evil"]["version"] == ["1.0", "2.0"]


def test_tables_and_reports(rows):
    flat = records.flat(rows[2])
    assert len(flat.columns) == 12
    shown = {(r["packageName"], r["source"]): r for r in records.front_end(flat).collect()}
    assert shown["evil", "news"]["version"] == "1.0, 2.0" and shown["evil", "news"]["timestamp"] == "2024-02-01"
    got = {(r["measure"], r["value"]): r["n"] for r in records.report(flat, F.lit(datetime.datetime(2024, 3, 2))).collect()}
    assert got["total", ""] == 4 and got["recent", ""] == 1 and got["package_manager", "pypi"] == 4 and got["source", "blog"] == 2
    assert [tuple(r) for r in records.packages_per_manager(rows[2]).collect()] == [("pypi", 2)]
    assert [r["package_name"] for r in records.multi_source(rows[2]).collect()] == ["evil"]


def test_feed(spark, rows):
    feed = spark.createDataFrame([("p", "npm", "t1", "<1.0", "2024-05-01T10:00:00Z", "steals"), ("q", None, "20240101_000000_000001", None, "later", None)], "package_name string, package_manager string, timestamp string, affected_version string, update_date string, overview string")
    got = {r["package_name"]: r for r in records.from_feed(feed, rows[1]).collect()}
    assert (got["p"]["post_date"], got["p"]["source_link"], got["p"]["version"]) == ("2024-05-01", "", ["<1.0"])
    assert (got["q"]["post_date"], got["q"]["source_link"], got["q"]["package_manager"]) == ("2024-01-01", "http://a", "other")
    both = rows[2].unionByName(records.from_feed(feed, rows[1]))
    assert records.aggregate(both).count() == 4


def test_registry_lookups(spark):
    table = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-03 10:00:00"), ("a", "2024-01-04 00:00:00"), ("b", "2024-01-01 00:00:00")], "name string, ts string")
    names = spark.createDataFrame([("a",), ("a",)], "name string")
    assert [tuple(r) for r in records.downloads(table, names, "ts", F.lit("2024-01-01").cast("date")).collect()] == [("a", 2)]
