"""Statistical models over documents and vectors, on pyspark.ml where it has them and in numpy where it hasn't."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, CountVectorizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators import topics as latent
from tamarack.session import stored


def lda_topics(docs: DataFrame, doc_id: str, tokens: str, topics: int = 5, iterations: int = 10, vocabulary: int | None = 5000, seed: int = 17, share: float | None = None, columns: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, topics: array<double>), (topic, term, weight)): online variational LDA with a fixed seed.

    With `columns` every word is kept, hashed into so many columns, and documents are inferred in numpy (operators/topics.py):
    topics x columns numbers are all that the driver holds and sends in a round, whatever the vocabulary. Of v words, about 1 - exp(-v / columns) share a column with another one
    (a fifth of 30,000 words in 2**17 columns); such a column goes by its most frequent word. Otherwise the `vocabulary`
    most frequent words are kept (None: all of them, held by the driver).
    An iteration draws a `share` of the documents (with a vocabulary: Spark's own choice where there is none, with
    replacement; with columns all of them, each once, where it is 1 or not given). Texts are read once, for their counts, which are a written table that every iteration
    reads (and once before that for a vocabulary).
    """
    if columns:
        return _hashed_topics(docs, doc_id, tokens, topics, iterations, seed, 1.0 if share is None else share, columns)
    lda = LDA(k=topics, maxIter=iterations, seed=seed, featuresCol="_tf", optimizer="online")
    counter = CountVectorizer(inputCol=tokens, outputCol="_tf", vocabSize=vocabulary or (1 << 31) - 1).fit(docs)
    tf = stored(counter.transform(docs).select(doc_id, "_tf"), "counts")
    model = (lda if share is None else lda.setSubsamplingRate(share)).fit(tf)
    mixed = model.transform(tf).select(doc_id, vector_to_array("topicDistribution").alias("topics"))
    top = model.describeTopics(10).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
    used = sorted({i for r in model.describeTopics(10).select("termIndices").collect() for i in r[0]})  # ten for each topic
    table = docs.sparkSession.createDataFrame([(i, counter.vocabulary[i]) for i in used], "i int, term string")
    terms = top.select("topic", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight")).join(table, "i").select("topic", "term", "weight")
    return mixed, terms


def _hashed_topics(docs: DataFrame, doc_id: str, tokens: str, topics: int, rounds: int, seed: int, share: float, columns: int) -> tuple[DataFrame, DataFrame]:
    """lda_topics() over hashed columns: the rounds of operators/topics.py."""
    column = lambda t: F.pmod(F.xxhash64(t), F.lit(columns)).cast("int")
    counts = latent.counted(docs, doc_id, F.transform(F.coalesce(tokens, F.array().cast("array<string>")), column))
    weights, alpha = latent.fit(counts, columns, topics, rounds, seed, share)
    likely = weights / weights.sum(1, keepdims=True)
    top = [(k, int(i), float(likely[k, i])) for k in range(topics) for i in np.argsort(-likely[k], kind="stable")[:10]]
    words = docs.select(F.explode(tokens).alias("term")).withColumn("i", column(F.col("term"))).filter(F.col("i").isin(sorted({i for _, i, _ in top})))
    table = words.groupBy("i", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.max_by("term", F.struct("n", "term")).alias("term"))
    terms = docs.sparkSession.createDataFrame(top, "topic int, i int, weight double").join(table, "i").select("topic", "term", "weight")
    return latent.mixtures(counts, doc_id, weights, alpha, seed), terms


def pca(rows: DataFrame, key: str, vector: str, dims: int = 8) -> DataFrame:
    """(key, components: array<double>), signs fixed so that each direction's largest loading is positive."""
    v = rows.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(v)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(dims)])
    flip = F.array(*(F.lit(float(s)) for s in signs))
    return model.transform(v).select(key, F.zip_with(vector_to_array("_p"), flip, lambda x, s: x * s).alias("components"))


def document_vectors(docs: DataFrame, doc_id: str, tokens: str, dims: int = 100, window: int = 2, epochs: int = 5, seed: int = 17) -> DataFrame:
    """(doc_id, vector): the average of word vectors, the nearest to paragraph vectors that pyspark.ml has."""
    model = Word2Vec(vectorSize=dims, windowSize=window, maxIter=epochs, minCount=1, seed=seed, inputCol=tokens, outputCol="_v").fit(docs)
    return model.transform(docs).select(doc_id, vector_to_array("_v").alias("vector"))


def nmf(weights: DataFrame, doc_id: str, topics: int = 5, rounds: int = 30, vocabulary: int = 2000, seed: int = 17) -> DataFrame:
    """(topic, term, weight): non-negative factors of a (doc_id, term, w) matrix, for its most frequent terms.

    Multiplicative updates on the terms' Gram matrix: documents are summed out by Spark (terms x terms, at most
    `vocabulary` squared), so the driver's size doesn't grow with the corpus. The factors are those of the Gram matrix.
    """
    top = weights.groupBy("term").agg(F.sum("w").alias("s")).orderBy(F.desc("s"), "term").limit(vocabulary)
    held = weights.join(F.broadcast(top.select("term")), "term")  # at most `vocabulary` rows
    pairs = held.alias("a").join(held.alias("b"), doc_id).groupBy(F.col("a.term").alias("t"), F.col("b.term").alias("u")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("g"))
    got = pairs.toPandas()
    names = sorted(set(got["t"]))
    at = {t: i for i, t in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    gram[got["t"].map(at), got["u"].map(at)] = got["g"]
    rng = np.random.default_rng(seed)
    h = rng.uniform(0.1, 1, (len(names), min(topics, max(1, len(names)))))
    for _ in range(rounds):
        h *= np.sqrt(np.maximum(gram @ h, 1e-12) / np.maximum(h @ (h.T @ h), 1e-12))
    rows = [(k, names[i], float(h[i, k])) for k in range(h.shape[1]) for i in np.argsort(-h[:, k], kind="stable")[:25].tolist()]
    return weights.sparkSession.createDataFrame(rows, "topic int, term string, weight double")


#: Most rows a one-class machine is fitted on; every row is scored.
ONE_CLASS_SAMPLE = 20_000


def one_class(rows: DataFrame, key: str, vector: str, reject: float = 0.1, features: int = 256, epochs: int = 20, limit: int = ONE_CLASS_SAMPLE, gamma: float | None = None, seed: int = 17) -> DataFrame:
    """(key, score, inside): a one-class support vector machine with a Gaussian kernel; inside where the score is 0 or more.

    The kernel is approximated by random Fourier features (`gamma`: by default 1 / (dimensions * variance)), and the hinge of
    w . f(x) - rho, with `reject` as the share left outside, is descended stochastically in numpy over at most `limit` rows
    chosen by a hash of the key; the steps' average is the model, and rho its `reject` quantile. Vectors of null are outside.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    known = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), v.alias("_v"))
    sample = known.orderBy(F.xxhash64(F.lit("one"), "_k"), "_k").limit(limit).toPandas()
    kind = rows.schema[key].dataType.simpleString()
    if not len(sample):
        return rows.select(key, F.lit(None).cast("double").alias("score"), F.lit(False).alias("inside"))
    x = np.array(sample["_v"].tolist())
    rng = np.random.default_rng(seed)
    gamma = gamma or 1 / (x.shape[1] * max(float(x.var()), 1e-12))
    turn, shift = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], features)), rng.uniform(0, 2 * np.pi, features)
    lift = lambda z: np.sqrt(2 / features) * np.cos(z @ turn + shift)
    f = lift(x)
    w, mean, rho, steps = f.mean(0), np.zeros(features), 0.0, 0
    for epoch in range(epochs):
        for i in range(0, len(f), 64):
            part = f[rng.integers(0, len(f), 64)]
            rate = 1 / (10 + steps)
            under = part @ w < rho
            w = w - rate * (w - part[under].sum(0) / (reject * len(part)))
            rho -= rate * (under.mean() / reject - 1)
            steps += 1
            if epoch >= epochs // 2:
                mean += w
    w = mean / max(np.linalg.norm(mean), 1e-12)
    rho = float(np.quantile(f @ w, reject))

    def run(batches):
        for b in batches:
            z = b.column(1).to_pylist()
            score = lift(np.array([r or [0.0] * x.shape[1] for r in z])) @ w - rho if len(z) else np.zeros(0)
            none = np.array([r is None for r in z], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, mask=none), pa.array((score >= 0) & ~none)], [key, "score", "inside"])

    return rows.select(key, v.alias("_v")).mapInArrow(run, f"`{key}` {kind}, score double, inside boolean")
