import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tamarack.sources import external, readers, sinks
from tamarack.streaming import incremental as inc

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the fakes below go to the workers


def test_link_queues(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("t1\tblog \t2024-01-01\thttp://a\nt2\tblog\t2024-01-02\thttp://b\n")
    (tmp_path / "c.tsv").write_text("t2\tblog\t2024-02-02\thttp://b2\nblog\t2024-01-01\thttp://old\n")
    rows = readers.links(spark, str(tmp_path / "w.tsv"))
    assert [(r["source"], r["link"]) for r in rows.orderBy("timestamp").collect()] == [("blog", "http://a"), ("blog", "http://b")]
    assert sorted(r["link"] for r in readers.collected_links(spark, str(tmp_path / "c.tsv")).collect()) == ["http://b2", "http://old"]
    facts = {r["timestamp"]: r["link"] for r in readers.link_facts(spark, str(tmp_path / "w.tsv"), str(tmp_path / "c.tsv")).collect()}
    assert facts == {"t1": "http://a", "t2": "http://b2"}
    assert [r["index"] for r in readers.indexed_links(rows).orderBy("timestamp").collect()] == [1, 2]


def test_documents_and_outputs(spark, tmp_path):
    d = tmp_path / "socket"
    d.mkdir()
    (d / "20240417_164152_282860.txt").write_text("hello\nworld")
    r = readers.documents(spark, str(tmp_path)).first()
    assert (r["source"], r["file_timestamp"], r["text"], r["size"]) == ("socket", "20240417_164152_282860", "hello\nworld", 11)
    o = tmp_path / "out" / "socket" / "m1" / "cot"
    o.mkdir(parents=True)
    (o / "a_b_c_verify.json").write_text("[]")
    (o / "a_b_c_extract.json").write_text("[]")
    got = readers.model_outputs(spark, str(tmp_path / "out")).collect()
    assert [(r["source"], r["model"], r["prompt"], r["file_timestamp"]) for r in got] == [("socket", "m1", "cot", "a_b_c")]


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": [2]}]')
    assert readers.json_array(spark, str(tmp_path / "a.json")).count() == 2
    p = tmp_path / "npm" / "pkg"
    p.mkdir(parents=True)
    (p / "o.json").write_text('{"published": "2024-01-01T00:00:00Z", "affected": [{"package": {"name": "evil"}}, {}]}')
    got = sorted((r["manager"], r["name"], r["published"]) for r in readers.advisories(spark, str(tmp_path / "npm")).collect())
    assert got == [("npm", "NA", "2024-01-01"), ("npm", "evil", "2024-01-01")]
    (tmp_path / "r.html").write_text('<html><p>{"name": "x", "time": {"created": "2020-01-01"}}</p></html>')
    assert tuple(readers.registry_pages(spark, str(tmp_path / "r.html")).first()) == ("x", "2020-01-01")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    for _ in range(2):
        sinks.append_csv(rows, str(tmp_path / "csv"), ["k", "n"])
    assert readers.csv_table(spark, str(tmp_path / "csv")).count() == 4
    assert sinks.json_document(rows, "k").first()["json"] == '[{"k":"a","n":1},{"k":"b","n":2}]'
    sinks.overwrite_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_article_id(spark):
    df = spark.createDataFrame([('<script>{"newsList": [{"id": "77"}]}</script>',), ('{"id": 5}',), ("none",)], "h string")
    assert [r[0] for r in df.select(readers.article_id(F.col("h"))).collect()] == ["77", "5", None]


class Pages:
    def fetch(self, source, url):
        if "bad" in url:
            raise OSError("gone")
        return f"<p>{url}</p>"


class Model:
    def ask(self, model, prompt, text):
        return f"{model}:{prompt.splitlines()[0]}"


def test_fetch_failures_are_rows(spark):
    q = spark.createDataFrame([("1", "a", "u"), ("2", "a", "bad"), ("3", "zz", "u")], "timestamp string, source string, link string")
    out = {r["timestamp"]: r for r in external.fetch_pages(q, Pages(), {"a": lambda h: h[3:-4]}).collect()}
    assert out["1"]["text"] == "u" and out["2"]["error"] == "OSError: gone" and out["3"]["error"] == "no extractor"


def test_model_chain(spark):
    docs = spark.createDataFrame([("f", "left-pad is here")], "file string, text string")
    prompts = {("cot", s): s for s in external.STEPS}
    got = external.model_chain(docs, Model(), ["m1", "m2"], prompts).collect()
    assert len(got) == 6 and {r["answer"] for r in got if r["model"] == "m1"} == {"m1:extract", "m1:relation", "m1:verify"}


def test_model_chain_shows_whole_texts(spark):
    """A tail behind 120,000 characters is seen at every step; over 110,000 tokens the first 30,000 are shown."""

    class Tail:
        def ask(self, model, prompt, text):
            return f"{len(text)} {text[-4:]}"

    docs = spark.createDataFrame([("f", "word " * 40_000 + "tail"), ("g", None)], "file string, text string")
    prompts = {("cot", s): s for s in external.STEPS}
    bytewise = {bytes([b]): b for b in range(256)}
    for vocabulary, want in (({}, "200004 tail"), ({"ranks": bytewise, "pattern": r"\s?\S+"}, "30000 ord ")):
        got = external.model_chain(docs, Tail(), ["m"], prompts, **vocabulary).collect()
        assert len(got) == 6 and {r["answer"] for r in got if r["file"] == "f"} == {want}
    got = external.model_chain(docs.limit(1).withColumn("text", F.substring("text", 79_997, 130_000)), Tail(), ["m"], prompts).collect()
    assert {r["answer"] for r in got} == {"120008 tail"}


def test_retries_are_bounded():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise ValueError

    assert external.retried(fail, sleep=waits.append) == "" and len(calls) == 5 and waits == [10, 15, 20, 25]


def test_listed_source(spark):
    spark.dataSource.register(external.ListedSource)
    assert spark.read.format("listed").option("pages", "p1,p2").option("source", "s").load().count() == 2


def test_link_stream_reads_each_file_once(spark, tmp_path):
    src, sink, ck = tmp_path / "q", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    for i in range(2):
        (src / f"{i}.tsv").write_text(f"t{i}\tblog\t2024\thttp://{i}\n")
        inc.process(inc.link_stream(spark, str(src)), lambda d: d, sink, ck).awaitTermination()
    assert sorted(r["link"] for r in spark.read.parquet(sink).collect()) == ["http://0", "http://1"]


def test_marks(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, o long")
    marks = spark.createDataFrame([("a", 3)], "k string, mark long")
    assert sorted(tuple(r) for r in inc.above_mark(rows, marks, "k", "o").collect()) == [("a", 5), ("b", 2)]
    assert sorted(tuple(r) for r in inc.new_marks(rows, marks, "k", "o").collect()) == [("a", 5), ("b", 2)]


def test_high_water_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, o long").write.parquet(str(tmp_path / "in"))
    q = inc.high_water(inc.parquet_stream(spark, str(tmp_path / "in"), "k string, o long"), "k", "o").writeStream.format("memory").queryName("hw").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("hw").groupBy("k").agg(F.max("mark"), F.sum("n_new")).collect()) == [("a", 5, 2), ("b", 2, 1)]


def test_fold_keeps_the_tail(spark):
    rows = spark.createDataFrame([("x", 1, "aaaa"), ("x", 2, "bbbb"), ("x", 3, "c")], "k string, o long, t string")
    assert [r["memory"] for r in inc.fold(rows, "k", "o", "t", 6).orderBy("part").collect()] == ["", "aaaa", "a bbbb"]


def test_token_slices(spark):
    import base64

    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    docs = spark.createDataFrame([(" hello" * 9,), (" hello" * 3,), (None,)], "text string")
    got = [r["first_part"] for r in external.token_slices(docs, "text", ranks, P.PATTERN, 5, 2).collect()]
    assert got == [" hello hello", " hello" * 3, None]


@pytest.mark.parametrize("n", [0, 3])
def test_token_counts(spark, n):
    import base64

    P = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    docs = spark.createDataFrame([(" hello" * n,)], "text string")
    assert external.token_counts(docs, "text", ranks, P.PATTERN).first()["tokens"] == n
