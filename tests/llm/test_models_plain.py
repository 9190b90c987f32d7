"""The two trained classifiers against plain loops over explicit features, with the score never collapsed into one table."""

import math

import numpy as np
import pytest

from tamarack.llm import language_id, quality_classifier, queries
from tamarack.llm.common import crc_bucket
from tests.llm.helpers import prose

ODD, BASE, ALL = 0x9E3779B97F4A7C15, 0x100000001B3, (1 << 64) - 1


def kinds_of(text, f):
    """The rows of each kind of feature of a text: n-grams by size, words, pairs."""
    row = lambda h, salt: ((h + salt) & ALL) * ODD % (1 << 64) >> (64 - f.bits)
    padded = b" " + (text or "").encode() + b" "
    out = []
    for size in f.ngrams:
        own = []
        for i in range(len(padded) - size + 1):
            g = padded[i : i + size]
            if any(c <= 32 for c in g[1:-1]) or (g[0] <= 32 and g[-1] <= 32):
                continue
            h = 0
            for c in g:
                h = (h * 257 + c) & ALL
            own.append(row(h, size))
        out.append(own)
    words = "".join(chr(c) if c > 32 else " " for c in padded).split(" ")
    hashes = []
    for w in filter(None, words):
        h = sum((ord(c) + 1) * pow(BASE, j, 1 << 64) for j, c in enumerate(w)) & ALL
        hashes.append(h ^ h >> 29)
    if f.words:
        out.append([row(h, 101) for h in hashes])
    if f.pairs:
        own, seen = [], set()
        for a, b in zip(hashes, hashes[1:]):
            pair = (a * BASE + b) & ALL
            own.append(0 if a == b else 1 if pair in seen else row(pair, 202))
            seen.add(pair)
        out.append(own)
    return out


def averaged(text, f):
    """{row: share}: every kind's features have a share of one between them."""
    out = {}
    for own in kinds_of(text, f):
        for r in own:
            out[r] = out.get(r, 0.0) + 1 / len(own)
    return out


class Plain:
    """The model by loops: a vector a feature, averaged, a softmax; one document a step."""

    def __init__(self, docs, targets, k, f, dim=8, epochs=6, rate=1.0, seed=7):
        rng = np.random.default_rng(seed)
        self.table = rng.uniform(-1 / dim, 1 / dim, (1 << f.bits, dim))
        self.out, self.bias, self.dim, self.k = rng.normal(0, 0.3, (dim, k)), [0.0] * k, dim, k
        self.table, self.out = self.table.astype(np.float32).astype(float), self.out.astype(np.float32).astype(float).tolist()
        rows_seen, out_seen, bias_seen = {}, [[1e-3] * k for _ in range(dim)], [0.1] * k
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for n in rng.permutation(len(docs)):
                hidden, p = self.hidden(docs[n]), self.chances(docs[n], 1.0)
                p[targets[n]] -= 1
                back = [sum(self.out[i][c] * p[c] for c in range(k)) for i in range(dim)]
                size = sum(b * b for b in back)
                for r, share in docs[n].items():
                    rows_seen[r] = rows_seen.get(r, 1e-6) + share * share * size
                    pace = 0.3 * step * share / math.sqrt(rows_seen[r])
                    self.table[r] -= [pace * b for b in back]
                for c in range(k):
                    for i in range(dim):
                        g = hidden[i] * p[c]
                        out_seen[i][c] += g * g
                        self.out[i][c] -= 0.1 * step * g / math.sqrt(out_seen[i][c])
                    bias_seen[c] += p[c] * p[c]
                    self.bias[c] -= 0.1 * step * p[c] / math.sqrt(bias_seen[c])

    def hidden(self, doc):
        return [sum(share * self.table[r][i] for r, share in doc.items()) for i in range(self.dim)]

    def chances(self, doc, temperature):
        h = self.hidden(doc)
        z = [(sum(h[i] * self.out[i][c] for i in range(self.dim)) + self.bias[c]) / temperature for c in range(self.k)]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]


def fitted(rows, classes, f):
    """(model, temperature) from (id, text, target) in order of the ids' texts, every fifth kept out."""
    rows = sorted(rows, key=lambda r: str(r[0]))
    docs, y = [averaged(t, f) for _, t, _ in rows], [classes.index(c) for _, _, c in rows]
    model = Plain([d for i, d in enumerate(docs) if i % 5], [c for i, c in enumerate(y) if i % 5], len(classes), f)
    held = [(d, c) for i, (d, c) in enumerate(zip(docs, y)) if i % 5 == 0]
    grid = [math.exp(math.log(0.05) + i * (math.log(20) - math.log(0.05)) / 120) for i in range(121)]
    loss = lambda t: -sum(math.log(max(model.chances(d, t)[c], 1e-12)) for d, c in held)
    return model, min(grid, key=loss)


JUNK = "buy now !!! click $$$ free free free win win 99 "


def written(spark, tmp_path):
    """Documents with labels: prose and junk in two languages, awkward texts, two labels for one id."""
    rows, labels = [], []
    for i in range(60):
        good = i % 3 > 0
        text = prose(i, 12 + i % 9) if i % 2 else " ".join(w[::-1] + "ñ" for w in prose(i, 9 + i % 7).split())
        rows.append((i, text if good else JUNK * (1 + i % 3) + text[:20], "en" if i % 2 else "xx", "s", 1))
        labels.append((i, int(good), 0))
    rows += [(100, None, "en", "s", 0), (101, "", None, "s", 0), (102, "  \n", "xx", "s", 0), (103, "same same same", None, "s", 0), (104, prose(9, 6000), None, None, 0), (105, "1 2 3", "en", "s", 0)]
    labels += [(1, 0, 0), (101, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, labels


def test_quality_scores_equal_plain_loops(spark, tmp_path):
    rows, labels = written(spark, tmp_path)
    best = {}
    for i, q, _ in labels:  # of labels that contradict each other the larger counts
        if q is not None and crc_bucket(i):
            best[i] = max(q, best.get(i, 0))
    f = quality_classifier.FEATURES
    model, t = fitted([(i, x, best[i]) for i, x, *_ in rows if i in best], [0, 1], f)
    got = {r["doc_id"]: r for r in queries.op7_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, x, *_ in rows:
        want = model.chances(averaged(x, f), t)[1]
        assert got[i]["score"] == pytest.approx(want, abs=2e-3) and got[i]["held_out"] == (crc_bucket(i) == 0)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3)


def test_languages_equal_plain_loops(spark, tmp_path):
    rows, _ = written(spark, tmp_path)
    f = language_id.FEATURES
    known = [(i, x, lang) for i, x, lang, *_ in rows if lang and x is not None and crc_bucket(i)]
    model, t = fitted(known, ["en", "xx"], f)
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, str(tmp_path)).collect()}
    for i, x, *_ in rows:
        p = model.chances(averaged(x, f), t)
        if not any(c.isalpha() for c in x or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        assert got[i]["score"] == pytest.approx(max(p), abs=2e-3)
        if abs(p[0] - p[1]) > 0.01:
            assert got[i]["lang_pred"] == ("en" if p[0] > p[1] else "xx")


def test_ties_of_probability_go_to_the_first_language(spark):
    """A text of features that no model row has moved from zero: equal weights, equal chances."""
    from tamarack.llm.subword import Model

    f = language_id.FEATURES
    model = Model(f, ["aa", "bb", "cc"], np.zeros((1 << f.bits, 3), np.float32), np.zeros(3))
    df = spark.createDataFrame([(1, "any words"), (2, "x" * 300_000)], "doc_id long, text string")
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(df, model).orderBy("doc_id").collect()] == [("aa", pytest.approx(1 / 3))] * 2
