import datetime

import pytest
from pyspark.sql import functions as F

from tamarack.functions import dates, html, nested, normalise, text, triples, urls, vectors


def value(spark, column, **row):
    fields = ", ".join(f"{k} {v[1]}" for k, v in row.items()) or "x int"
    df = spark.createDataFrame([tuple(v[0] for v in row.values()) or (1,)], fields)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [("", "other"), (None, "other"), ("N/A", "other"), ("pip", "pypi"), ("Python", "pypi"), ("Cargo", "cargo")])
def test_manager_record(spark, raw, want):
    assert value(spark, normalise.manager_record(F.col("m")), m=(raw, "string")) == want


@pytest.mark.parametrize("raw, want", [("pypl", "pypi"), (" NodeJS ", "npm"), ("dotnet", "nuget"), ("gem", "rubygems"), ("", "unknown"), ("odd", "odd")])
def test_manager_ecosystem(spark, raw, want):
    assert value(spark, normalise.manager_ecosystem(F.col("m")), m=(raw, "string")) == want


def test_candidates(spark):
    got = value(spark, text.candidates(F.col("t")), t=("@scope/pkg-name. and npm,", "string"))
    assert sorted(got) == ["@scope/pkg-name", "and", "npm"]
    assert value(spark, text.candidates(F.col("t"), common=["and"], stop=["npm"]), t=("And npm NPM", "string")) == ["NPM"]


def test_keyword_score(spark):
    assert value(spark, text.keyword_score(F.col("t")), t=("attack supply chain Gemfile", "string")) == 5
    assert value(spark, text.keyword_score(F.col("t")), t=(None, "string")) is None


@pytest.mark.parametrize("raw, want", [("Jan 5, 2024", "2024-01-05"), ("january 5, 2024", "2024-01-05"), ("soon", "None"), (None, "None")])
def test_month_dates(spark, raw, want):
    assert value(spark, dates.long_or_short_month(F.col("d")), d=(raw, "string")) == want


def test_relative_dates(spark):
    day = F.lit(datetime.date(2024, 3, 10))
    assert value(spark, dates.relative(F.col("d"), day), d=("3 days ago", "string")) == datetime.date(2024, 3, 7)
    assert value(spark, dates.relative(F.col("d"), day), d=("3 d ago", "string")) == datetime.date(2024, 3, 7)
    assert value(spark, dates.relative(F.col("d"), day), d=("3d ago", "string")) is None
    assert value(spark, dates.relative(F.col("d"), day), d=("Feb 2", "string")) == datetime.date(2024, 2, 2)


def test_file_names(spark):
    assert value(spark, dates.file_timestamp(F.col("f")), f=("20240417_164152_282860_gpt.json", "string")) == "20240417_164152_282860"
    assert value(spark, dates.file_timestamp(F.col("f")), f=("a_b", "string")) is None
    assert value(spark, dates.file_day(F.col("f")), f=("20240417_1", "string")) == "2024-04-17"
    assert value(spark, dates.day_of(F.col("f")), f=("2024-01-05T10:00:00Z", "string")) == "2024-01-05"


@pytest.mark.parametrize("raw, want", [("", True), (None, True), ("[]", True), ("[{}]", True), ('[{"a": 1, "b": []}]', True), ('[{"a": 1}, {}]', False), ('{"a": {"b": ""}}', True), ('[{"a": "x"}]', False), ("{oops", False)])
def test_empty_records(raw, want):
    assert nested.is_empty_record(raw) is want


def test_triage_and_split(spark):
    rows = [
        (1, '[{"Package Name": ["a", "b"], "Package Manager": ["PyPI", "npm"]}]'),
        (2, "[]"),
        (3, '```json\n{"package_name": "c"}\n```'),
        (4, '[{"Package Name": "cut"'),
        (5, 'It is [{"Package Name": "d", "Package Manager": ""}] as asked'),
        (6, None),
    ]
    df = nested.triage(spark.createDataFrame(rows, "id long, text string"))
    assert {r["id"]: r["state"] for r in df.collect()} == {1: "good", 2: "empty", 3: "good", 4: "bad", 5: "good", 6: "empty"}
    out = nested.split_records(df.filter("state = 'good'").select("id", "doc"), normalise.NAME_KEYS, normalise.MANAGER_KEYS)
    got = sorted((r["id"], r["package_name"], r["package_manager"]) for r in out.collect())
    assert got == [(1, "a", "npm"), (1, "a", "pypi"), (1, "b", "npm"), (1, "b", "pypi"), (3, "c", "other"), (5, "d", "other")]


def test_values_at_any_depth(spark):
    df = spark.createDataFrame([('{"a": [{"k": "u"}, {"b": {"k": ["v", "w"]}}]}',), ("{bad",), (None,)], "t string")
    assert [r[0] for r in df.select(nested.values_of_key("t", F.lit("k"))).collect()] == [["u", "v", "w"], [], []]


def test_chunks(spark):
    assert value(spark, text.chunk(F.split("t", ","), 5), t=("aa,bb,cccccccc,d", "string")) == ["aa bb", "cccccccc", "d"]


def test_url_functions(spark):
    u = F.col("u")
    assert value(spark, urls.registered_domain(u), u=("https://a.b.co.uk/x", "string")) == "b.co.uk"
    assert value(spark, urls.registered_domain(u), u=("not a url %%", "string")) == ""
    assert value(spark, urls.last_labels(u), u=("https://x.y.example.com:8080/", "string")) == "example.com"
    assert value(spark, urls.at_either_end(u, urls.IGNORE_ENDS), u=("mailto:x", "string")) is True
    assert value(spark, urls.at_either_end(u, urls.IGNORE_ENDS_ADVISORY), u=("http://a/b.pdf", "string")) is False


def test_html(spark):
    page = "<h1>One two <b>three</b> four</h1><nav>skip</nav><p>Body &amp; more</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><script>x()</script><p>Body &amp; more</p>"
    assert html.blocks_of(page) == [{"kind": "h1", "text": "One two three four"}, {"kind": "p", "text": "Body & more"}, {"kind": "row", "text": "a\tb"}, {"kind": "row", "text": "1\t2"}]
    assert html.blocks_of(None) == []
    assert value(spark, html.headings(F.col("h")), h=(page, "string")) == ["One two three four"]
    assert value(spark, html.hrefs(F.col("h")), h=('<a class="x" href="/y">z</a>', "string")) == ["/y"]


def test_triples(spark):
    t = "[SUBJECT:evil-pkg, RELATION:is, OBJECT:malicious npm package], [SUBJECT:the actor, RELATION:used, OBJECT:x]"
    assert value(spark, triples.packages(F.col("t")), t=(t, "string")) == ["evil-pkg"]
    parts = value(spark, triples.parts(F.col("t")), t=(t, "string"))
    assert [tuple(p) for p in parts] == [("evil-pkg", "is", "malicious npm package"), ("the actor", "used", "x")]
    assert value(spark, triples.packages(F.col("t")), t=("[SUBJECT:the actor, RELATION:likes, OBJECT:tea]", "string")) == ["tea"]
    got = value(spark, triples.named_in_text(F.col("t"), never=["library"]), t=('Use "color-x" and library left-pad version 1.2 here', "string"))
    assert got == ["color-x", "left-pad"]
    said = "Package 'abc' and LIBRARY \"de_f\" then ghi (version 1.0), jkl-2.1, mno v3, `pq` and colorama."
    assert value(spark, triples.named_in_text(F.col("t"), known=["colorama", "absent"]), t=(said, "string")) == ["abc", "colorama", "de_f", "ghi", "jkl", "mno"]
    assert value(spark, triples.named_in_text(F.col("t")), t=("", "string")) == [] and value(spark, triples.named_in_text(F.col("t")), t=(None, "string")) is None


def test_vectors(spark):
    assert value(spark, vectors.cosine(F.col("a"), F.col("b")), a=([1.0, 0.0], "array<float>"), b=([1.0, 1.0], "array<float>")) == pytest.approx(0.7071067811865475)
    assert value(spark, vectors.cosine(F.col("a"), F.col("b")), a=([0.0], "array<float>"), b=([1.0], "array<float>")) is None


def test_list_literals(spark):
    assert value(spark, normalise.list_text(F.col("v")), v=("['a', 'b']", "string")) == "a, b"
    assert value(spark, normalise.list_text(F.col("v")), v=(None, "string")) == ""
    assert value(spark, normalise.literal_list(F.col("v")), v=("__import__('os')", "string")) is None


def test_advisories_and_versions(spark):
    t = F.col("t")
    assert value(spark, text.advisory_name(t), t=("Malicious code in left-pad (npm)", "string")) == "left-pad"
    assert value(spark, text.advisory_name(t), t=("Something else", "string")) is None
    assert tuple(value(spark, text.name_and_version(t), t=(" left-pad   1.0 more", "string"))) == ("left-pad", "1.0")
    assert value(spark, text.sentence_runs(t, 2), t=("A b. C d! E?", "string")) == ["A b. C d!", "C d! E?"]
    assert value(spark, text.sentence_runs(t, 2), t=("", "string")) == []


def test_followed_counts_pairs_a_batch_at_a_time(spark):
    """Pairs never run over a document's end, nor into null, empty or one-word documents; each comes once a batch, not once a place."""
    rows = [(["a", "b", "a", "b"],), (None,), ([],), (["b"],), (["a", None, "b"],), (["a", "b"],), (["ü", "ü", "ü"],)]
    got = text.followed(spark.createDataFrame(rows, "w array<string>").coalesce(1), "w").collect()
    assert sorted(tuple(r) for r in got if r["a"] and r["b"]) == [("a", "b", 3), ("b", "a", 1), ("ü", "ü", 2)]
    assert sorted((r["a"] or "", r["n"]) for r in got if not r["b"]) == [("a", 1), ("b", 4), ("ü", 1)]
    assert [r["n"] for r in got if r["a"] is None] == [1] and len(got) == 7
    assert text.followed(spark.createDataFrame([], "w array<string>"), "w").count() == 0
