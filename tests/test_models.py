"""Models against brute force, and the boundaries to outside models with fakes."""

import math

import numpy as np
import pytest

from tamarack import plans
from tamarack.operators import models, terms
from tamarack.sources import external


def test_pca_equals_numpy(spark, sf_dir):
    got = {r["vec_id"]: r["components"] for r in plans.QUERIES["pca_embed"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    v = v[:8] * np.sign(v[:8][np.arange(8), np.abs(v[:8]).argmax(1)])[:, None]
    assert np.allclose([got[r["vec_id"]] for r in rows], x @ v.T, atol=2e-3)


def test_lda_is_fixed_by_its_seed(spark):
    docs = spark.createDataFrame([(i, (["sea", "ship", "sail"] if i % 2 else ["bread", "oven", "flour"]) * 8) for i in range(40)], "doc_id int, w array<string>").coalesce(1)
    runs = [{r["doc_id"]: r["topics"] for r in models.lda_topics(docs, "doc_id", "w", topics=2, iterations=40, share=1.0)[0].collect()} for _ in range(2)]
    assert all(np.allclose(runs[0][i], runs[1][i]) for i in runs[0])
    lead = [int(np.argmax(runs[0][i])) for i in range(40)]
    assert len(set(lead[0::2])) == len(set(lead[1::2])) == 1 and lead[0] != lead[1]


def test_nmf_parts_two_vocabularies(spark):
    docs = spark.createDataFrame([(i, (["sea", "ship", "sail"] if i % 2 else ["bread", "oven", "flour"])) for i in range(30)], "doc_id int, w array<string>")
    weights = terms.tfidf(docs, "doc_id", docs["w"])
    rows = models.nmf(weights, "doc_id", topics=2, rounds=80).collect()
    tops = [{r["term"] for r in sorted((r for r in rows if r["topic"] == k), key=lambda r: -r["weight"])[:3]} for k in (0, 1)]
    assert sorted(map(sorted, tops)) == [["bread", "flour", "oven"], ["sail", "sea", "ship"]]


def test_document_vectors_of_alike_texts_are_near(spark):
    docs = spark.createDataFrame([(i, (["sea", "ship", "sail"] if i % 2 else ["bread", "oven", "flour"]) * 10) for i in range(40)], "doc_id int, w array<string>")
    v = {r["doc_id"]: np.array(r["vector"]) for r in models.document_vectors(docs, "doc_id", "w", dims=10).collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert cos(v[0], v[2]) > 0.99 and cos(v[0], v[2]) > cos(v[0], v[1])


def test_one_class_leaves_out_what_is_far(spark):
    """A ring: its middle is empty, so a sphere around the mean would call it inside; the machine doesn't."""
    rng = np.random.default_rng(3)
    angle = rng.uniform(0, 2 * np.pi, 600)
    ring = np.c_[np.cos(angle), np.sin(angle)] * 3 + rng.normal(0, 0.1, (600, 2))
    rows = [(i, p.tolist()) for i, p in enumerate(ring)] + [(1000, [9.0, 9.0]), (1001, [0.0, 0.0]), (1002, None)]
    got = {r["id"]: r for r in models.one_class(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", reject=0.1, gamma=1.0).collect()}
    assert len(got) == 603 and not got[1000]["inside"] and not got[1001]["inside"] and not got[1002]["inside"] and got[1002]["score"] is None
    assert np.mean([got[i]["inside"] for i in range(600)]) == pytest.approx(0.9, abs=0.03)
    none = spark.createDataFrame([], "id int, v array<double>")
    assert models.one_class(none, "id", "v").count() == 0


class Fake:
    def embed(self, texts):
        return [[float(len(t))] for t in texts]

    def label(self, texts):
        return [["long"] if len(t) > 3 else [] for t in texts]

    def entities(self, text):
        return [(i, i + 3, "X") for i in range(len(text)) if text[i : i + 3] == "bad"]


def test_boundaries_of_models(spark):
    docs = spark.createDataFrame([(1, "abcd"), (2, None), (3, "x")], "k int, text string")
    assert [r["vector"] for r in external.embeddings(docs, Fake()).orderBy("k").collect()] == [[4.0], None, [1.0]]
    assert [r["labels"] for r in external.labelled(docs, Fake()).orderBy("k").collect()] == [["long"], None, []]
    text = "a bad word " * 30
    got = external.entities(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string"), Fake(), "k", most=40).collect()
    assert len(got) == 30 and all(text[r["start"] : r["end"]] == "bad" == r["entity"] for r in got)
    assert "".join(p for _, p in external.windows_of(text, 40)) == text and max(len(p) for _, p in external.windows_of("x" * 90, 40)) == 40


def test_scrolling_ends():
    pages = [[{"id": i} for i in range(n)] for n in (3, 3, 8, 8)]
    calls = iter(pages)
    assert [r["id"] for r in external.scrolled(lambda: next(calls, pages[-1]), most=6)] == [0, 1, 2, 3, 4, 5]
    renewed = []
    assert len(external.scrolled(lambda: pages[0], most=6, refresh=lambda: renewed.append(1))) == 3 and len(renewed) == 3


class Flaky:
    def __init__(self, fails):
        self.fails, self.calls = fails, {}

    def fetch(self, source, url):
        self.calls[url] = self.calls.get(url, 0) + 1
        if self.calls[url] <= self.fails:
            raise OSError("down")
        return url.upper()


@pytest.mark.parametrize("fails", [2, 9])
def test_fetching_tries_again(spark, fails):
    queue = spark.createDataFrame([("1", "s", "u"), ("2", "other", "v")], "timestamp string, source string, link string")
    rows = external.fetch_pages(queue, Flaky(fails), {"s": lambda page: page + "!"}, attempts=5, sleep=lambda s: None).orderBy("timestamp").collect()
    assert (rows[0]["text"], rows[0]["error"]) == (("U!", None) if fails == 2 else (None, "OSError: down")) and rows[1]["error"] == "no extractor"


def test_inference_in_lots_equals_plain_loops(spark):
    """Documents of very different lengths, inferred together, have the weights and sums of one inferred by itself."""
    from tamarack.operators import topics

    x = np.array([0.2, 1.0, 7.5])
    assert np.allclose(topics.digamma(x), [(math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5 for v in x], atol=1e-6)
    assert np.allclose(topics.trigamma(x), (topics.digamma(x + 1e-4) - topics.digamma(x - 1e-4)) / 2e-4, rtol=1e-5)
    rng = np.random.default_rng(2)
    k, columns = 3, 50
    words = topics.likely(rng.gamma(1.0, 1.0, (k, columns)), 1).T
    docs = [np.sort(rng.choice(columns, m, replace=False)) for m in (0, 1, 3, 40, 7, 0, 25, 2)]
    counts = [rng.integers(1, 6, len(d)) for d in docs]
    sums = np.zeros((k, columns))
    at, n, cuts = np.concatenate(docs), np.concatenate(counts), np.r_[0, np.cumsum([len(d) for d in docs])]
    got = topics.infer(at, n, cuts, words.astype(np.float32), np.full(k, 1 / k), 5, sums)
    want = np.zeros((k, columns))
    for d, c, g, gamma in zip(docs, counts, got, topics.starts(at, n, cuts, k, 5)):
        if not len(d):
            assert g.tolist() == [1 / k] * k
            continue
        for _ in range(topics.MOST):
            theta = topics.likely(gamma[None], 1)[0]
            new = 1 / k + theta * ((c / (words[d] @ theta)) @ words[d])
            done, gamma = np.abs(new - gamma).mean() < topics.CLOSE, new
            if done:
                break
        assert g == pytest.approx(gamma, abs=5e-3)
        theta = topics.likely(gamma[None], 1)[0]
        want[:, d] += ((c / (words[d] @ theta))[:, None] * words[d] * theta).T
    assert np.allclose(sums, want, atol=2e-2) and sums.sum() == pytest.approx(sum(c.sum() for c in counts), rel=1e-5)


def test_hashed_topics_read_every_document_a_round(spark):
    """No draw with replacement: one round's sums hold every word of every document once."""
    from pyspark.sql import functions as F

    from tamarack.operators import topics

    docs = spark.createDataFrame([(i, [f"w{i}", f"v{i}"]) for i in range(200)] + [(200, None)], "doc_id long, w array<string>").repartition(5)
    counts = topics.counted(docs, "doc_id", F.transform(F.coalesce("w", F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(4096)).cast("int")))
    rng = np.random.default_rng([7, 1])
    start, rate = rng.gamma(100.0, 0.01, (4096, 2)).T, 1025**-0.51
    sums = (topics.fit(counts, 4096, 2, 1, 7)[0] - (1 - rate) * start) / rate - 0.5
    assert sums.sum() == pytest.approx(400, rel=1e-4)
