"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import training_row
from tamarack.llm.learning import sample_bags, score_texts
from tamarack.llm.subword import Features, Model, fit_temperature, scores_of_bags, softmax, train

#: Most rows a model is fitted on (a bound on the driver's memory; prediction reads every row).
SAMPLE = 2500
FEATURES = Features(bits=16, ngrams=(2, 3), words=True)


def fit(docs: DataFrame, limit: int = SAMPLE, features: Features = FEATURES, miss: float = 0.01, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of `lang`, learnt from rows with a language and a text whose crc32(doc_id) mod 5 is not 0.

    A fifth of the sample is kept out of training: it fits the temperature, and its `miss` quantile of the probability
    given to the true language becomes the rejection cutoff (split conformal: at most about `miss` of documents in a
    known language are rejected).
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & training_row(doc_id)).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    bags, targets = sample_bags(known, "_lang", limit, features, "_id", "_text")
    classes = sorted(set(targets))
    y = np.array([classes.index(t) for t in targets], np.int64)
    fold = np.arange(len(bags)) % 5 == 0
    model = train([b for b, f in zip(bags, fold) if not f], y[~fold], classes, features)
    held = scores_of_bags(model, [b for b, f in zip(bags, fold) if f])
    model.temperature = fit_temperature(held, y[fold])
    true = np.sort(softmax(held / model.temperature)[np.arange(len(held)), y[fold]]) if len(held) else np.zeros(0)
    rank = int(np.floor(miss * (len(true) + 1))) - 1
    model.extra["cutoff"] = float(true[rank]) if rank >= 0 else 0.0
    return model


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is the likeliest learned language, score its calibrated probability; `und` with score 0 where the text is
    null or has no letter, and where nothing was learnt. rejected marks scores under the calibrated cutoff, and `und`.
    Ties go to the language first in alphabetical order. Repeated rows are predicted each by itself.
    """
    letters = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    if not model.classes:
        letters = F.lit(False)
    out = score_texts(docs, [F.col(doc_id).alias("doc_id"), letters.alias("_letters")], model, text)
    best = F.array_max("prob")
    names = F.array(*(F.lit(str(c)) for c in model.classes)) if model.classes else F.array(F.lit("und"))
    lang = F.when(F.col("_letters"), F.get(names, (F.array_position("prob", best) - 1).cast("int"))).otherwise(F.lit("und"))
    score = F.when(F.col("_letters"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), best))).otherwise(F.lit(0.0))
    rejected = ~F.col("_letters") | (score < model.extra.get("cutoff", 0.0))
    return out.select("doc_id", F.coalesce(~training_row(), F.lit(False)).alias("held_out"), lang.alias("lang_pred"), score.alias("score"), rejected.alias("rejected"))
