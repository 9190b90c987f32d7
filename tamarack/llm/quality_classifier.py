"""Quality classifier: supervised subword embeddings averaged per document, trained by numpy gradient descent."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import training_row
from tamarack.llm.learning import sample_bags, score_texts
from tamarack.llm.subword import Features, Model, fit_temperature, scores_of_bags, train

#: Most labelled rows a model is fitted on (a bound on the driver's memory; scoring reads every row).
SAMPLE = 3000
FEATURES = Features(bits=17, ngrams=(3, 4), words=True, pairs=True)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, features: Features = FEATURES, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model of labels.quality, learnt from labelled rows whose crc32(doc_id) mod 5 is not 0.

    One training row in five (by a hash of its place) is kept out to fit the temperature, so scores are calibrated.
    Without labels of both kinds the model answers with the prior. Of labels that contradict each other the larger counts; null
    labels and ids teach nothing, and null texts are learnt from as empty ones.
    """
    known = labels.filter(F.col("quality").isNotNull() & training_row()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    # ids of the sample come from the labels alone: only its texts are shuffled or sent
    chosen = known.join(docs.select(F.col(doc_id).alias("doc_id")).distinct(), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit("rows"), F.col("doc_id")), "doc_id").limit(limit)
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("_id", "_text", "_quality")
    bags, targets = sample_bags(joined, "_quality", limit, features, "_id", "_text")
    y = np.array([int(t) for t in targets], np.int64)
    classes = [0, 1]
    fold = np.arange(len(bags)) % 5 == 0
    model = train([b for b, f in zip(bags, fold) if not f], y[~fold], classes, features)
    model.temperature = fit_temperature(scores_of_bags(model, [b for b, f in zip(bags, fold) if f]), y[fold])
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Null and empty texts have no features and get the model's prior; repeated rows are scored each by itself; a null
    doc_id is not held out. No column but doc_id and text is read.
    """
    out = score_texts(docs, [F.col(doc_id).alias("doc_id")], model, text)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob")[1]))
    return out.select("doc_id", F.coalesce(~training_row(), F.lit(False)).alias("held_out"), p.alias("score"), (p >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of `docs` that the model doesn't reject, all columns unchanged, whatever their names. Null and empty texts have
    the model's prior for a score; repeated rows are judged each by itself. An empty table gives an empty result."""
    keep = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]
    out = score_texts(docs, keep, model, text).filter(F.col("prob")[1] >= threshold)
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
