import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import language_id, quality_classifier, quality_rules
from tamarack.llm.common import crc_bucket
from tamarack.llm.subword import Features, fit_temperature, softmax, train
from tests.llm.helpers import awkward, key, prose, table

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, cover = collections.Counter(wins), set()
    for i, w in enumerate(wins):
        if n[w] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("extra", [False, True])
def test_base_counts(spark, extra):
    rows = awkward() + [(20, "a b c d e a b c d e a b c d e"), (21, "x\ny\nx\n \nx"), (22, "a b\x85c #*$%&|<> d\x1ce"), (23, "w " * 3000)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(table(spark, rows, extra), labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted(((r["doc_id"], *(r[n] for n in names), r["base_failed"]) for r in out), key=lambda r: (key(r[0]), r[1:]))
    want = []
    for i, t in rows:
        c = brute_counts(t)
        want.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(want, key=lambda r: (key(r[0]), r[1:]))
    assert all(not r["kept"] for r in out if r["base_failed"]) and quality_rules.judge(table(spark, []), labels).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 500), (3, 1000), (9, 1000), (40, 9000), (0, 1), (5, 5)]
    df = spark.createDataFrame(cases, "k long, n long")
    for p in (0.005, 0.1, 0.5):
        for r in df.select("k", "n", quality_rules.binomial_cdf("k", "n", p).alias("v")).collect():
            want = sum(math.comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"] + 1)) if r["n"] < 2000 else None
            if r["k"] >= r["n"] * p:
                assert r["v"] == 1.0
            elif want is not None:
                assert r["v"] == pytest.approx(want, rel=1e-9)


def test_binomial_tail_of_many_labels(spark):
    """Counts far over an int: against sums of densities by lgamma, whose own rounding grows with n."""
    density = lambda i, n, p: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    cases = [(4_900, 10**6, 0.005, 1e-6), (499_000, 10**8, 0.005, 1e-5), (40, 9000, 0.005, 1e-8), (16, 5000, 0.005, 1e-8)]
    for k, n, p, off in cases:
        want = sum(density(i, n, p) for i in range(k, max(-1, k - 20_000), -1))
        assert spark.createDataFrame([(k, n)], "k long, n long").select(quality_rules.binomial_cdf("k", "n", p)).first()[0] == pytest.approx(want, rel=off)
    got = spark.createDataFrame([(24_999_900_000, 5 * 10**12)], "k long, n long").select(quality_rules.binomial_cdf("k", "n", 0.005)).first()[0]
    assert got == pytest.approx(0.5 * math.erfc(100_000 / math.sqrt(2 * 5e12 * 0.005 * 0.995)), rel=1e-2)


def test_cutoffs_are_certified(spark):
    rule = quality_rules.Rule("m", "m", (3.0, 2.0, 1.0))
    # stratum a: 4,000 good documents of which few are over 2 and many over 1; stratum b: too few to certify anything
    rows = [("a", 1.5)] * 400 + [("a", 2.5)] * 4 + [("a", 0.5)] * 3596 + [("b", 0.5)] * 20
    out = quality_rules.thresholds(spark.createDataFrame(rows, "stratum string, m double"), [rule], risk=0.01, delta=0.05)
    assert [tuple(r) for r in out.collect()] == [("a", "m", 2.0)]


def test_certified_risk_holds_in_simulation(spark):
    """Over many draws the true false rejection rate of the chosen cutoff is over the risk in about delta of them at most."""
    rng, bad, rule = np.random.default_rng(5), 0, quality_rules.Rule("m", "m", tuple(float(x) for x in np.linspace(3, 0.5, 6)))
    true = lambda c: math.exp(-c)  # noqa: E731  values are exponential
    rows = [(f"s{d}", float(v)) for d in range(60) for v in rng.exponential(1, 300)]
    for r in quality_rules.thresholds(spark.createDataFrame(rows, "stratum string, m double"), [rule], risk=0.2, delta=0.2).collect():
        bad += true(r["cutoff"]) > 0.2
    assert bad <= 60 * 0.2


def training_tables(spark):
    good = [(i, prose(i, 60)) for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}### |" for w in prose(i, 40).split())) for i in range(150)] + [(2000 + i, (prose(i, 1) + " ") * 50) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int")
    return good + junk, labels


def test_quality_classifier(spark):
    rows, labels = training_tables(spark)
    docs = table(spark, rows)
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.score(docs, model).collect()
    assert all(r["held_out"] == (crc_bucket(r["doc_id"]) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([(r["doc_id"] < 1000) == bool(r["predicted"]) for r in held]) > 0.95
    odd = quality_classifier.score(table(spark, extra=True), model).collect()
    assert len(odd) == len(awkward()) and all(0 <= r["score"] <= 1 for r in odd)
    kept = quality_classifier.keep_good(table(spark, rows, extra=True), model)
    assert kept.columns == table(spark, rows, extra=True).columns and kept.count() == sum(r["predicted"] for r in out)
    assert quality_classifier.score(table(spark, []), model).count() == 0


def test_scores_do_not_depend_on_other_columns_or_partitioning(spark):
    rows, labels = training_tables(spark)
    docs = table(spark, rows)
    model = quality_classifier.fit(docs.repartition(7), labels)
    again = quality_classifier.fit(docs.repartition(2), labels)
    a = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    b = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs.withColumn("lang", F.lit("zz")).repartition(3), again).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_no_labels_give_a_prior(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_classifier.score(table(spark), quality_classifier.fit(table(spark), none)).collect()
    assert {r["score"] for r in out} == {0.5}


def test_bags_equal_model_scores():
    """The collapsed table gives what averaging the vectors gives, in whatever run a document comes."""
    from tamarack.llm.subword import scores_of_bags

    f = Features(bits=12, ngrams=(2, 3), words=True, pairs=True)
    texts = [prose(i, 30 + i) for i in range(20)] + ["", " ", "é", "a a a a"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    bags = list(f.bags(data, offsets))
    model = train(bags, np.arange(len(bags)) % 2, [0, 1], f, epochs=2)
    whole = model.logits(data, offsets)
    assert np.allclose(whole, scores_of_bags(model, bags), atol=1e-5)
    for i, r in enumerate(raw):
        assert np.allclose(whole[i], model.logits(np.frombuffer(r, np.uint8) if r else np.zeros(0, np.uint8), np.array([0, len(r)])), atol=1e-9)


def test_temperature():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    logits = np.zeros((2000, 2))
    logits[np.arange(2000), np.where(rng.random(2000) < 0.8, y, 1 - y)] = 6.0
    t = fit_temperature(logits, y)
    assert softmax(np.array([[6.0, 0.0]]) / t)[0, 0] == pytest.approx(0.8, abs=0.03) and fit_temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = language_id.predict(docs, model).collect()
    held = [r for r in out if r["held_out"]]
    assert held and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9
    assert np.mean([r["rejected"] for r in out]) < 0.1
    odd = {r["doc_id"]: r for r in language_id.predict(table(spark, extra=True), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["rejected"] and odd[i]["score"] == 0 for i in (3, 4, 7, 11)) and odd[6]["lang_pred"] in model.classes
    assert language_id.predict(table(spark, []), model).count() == 0


def test_language_id_with_nothing_to_learn(spark):
    docs = table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs)).collect()} == {"und"}
