"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import topics
from tamarack.llm.common import materialize, small_batches

#: The most cells (combinations of the marginals' values) that are held in numpy: 2**17 rows of a few numbers. More are
#: raked as tables, by the same steps and the same stopping rule.
MAX_DRIVER_CELLS = 1 << 17
ROUNDS, TOLERANCE = 200, 1e-9
NONE = "(none)"
NAMES = ("_source", "_lang", "_topic")


def rake(keys: Sequence[np.ndarray], tokens: np.ndarray, targets: Sequence[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Factors per cell that bring every marginal of factor * tokens to its target share, and the largest error left.

    Each step scales the cells of one marginal's value by target / present. Targets of values without tokens are
    spread over the others. Starting from the tokens, the limit is the closest table (in relative entropy) that has
    the marginals; if they contradict the empty cells, the rounds end with the error reported. The error of a round is
    the largest gap between a marginal's share and its target, each looked at just before its step.
    """
    weight = tokens.astype(float) / max(tokens.sum(), 1)
    error = 0.0
    for _ in range(rounds):
        error = 0.0
        for key, target in zip(keys, targets):
            now = np.bincount(key, weight, len(target))
            goal = np.where(now > 0, target, 0)
            goal = goal / goal.sum() if goal.sum() else now
            error = max(error, float(np.abs(now - goal).max(initial=0)))
            weight = weight * np.where(now > 0, goal / np.where(now > 0, now, 1), 0)[key]
        if error < tolerance:
            break
    return weight / np.maximum(tokens / max(tokens.sum(), 1), 1e-300), error


def rake_tables(cells: DataFrame, goals: Mapping[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """rake() where the cells are a table of any size: `cells` with `weight` added, and the error left.

    A step is one aggregation and one join with a marginal; a round ends in a written table.
    """
    total = max(cells.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0], 1)
    held = cells.withColumn("_w", F.col("_tokens") / F.lit(float(total)))
    error = 0.0
    for _ in range(rounds):
        error = 0.0
        for name in NAMES:
            now = materialize(held.groupBy(name).agg(F.sum("_w").alias("_now")).filter("_now > 0").join(goals[name], name), "marginal")
            goal = now.agg(F.coalesce(F.sum("_goal"), F.lit(0.0))).first()[0]
            step = now.select(name, "_now", (F.col("_goal") / F.lit(goal) if goal else F.col("_now")).alias("_goal"))
            error = max(error, step.agg(F.coalesce(F.max(F.abs(F.col("_now") - F.col("_goal"))), F.lit(0.0))).first()[0])
            held = held.join(step.select(name, (F.col("_goal") / F.col("_now")).alias("_scale")), name, "left").withColumn("_w", F.col("_w") * F.coalesce("_scale", F.lit(0.0))).drop("_scale")
        held = materialize(held, "raked")
        if error < tolerance:
            break
    return held.select(*NAMES, "_tokens", (F.col("_w") / F.greatest(F.col("_tokens") / F.lit(float(total)), F.lit(1e-300))).alias("weight")), error


def calibrate(factor: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """min(1, s * factor) per cell, with s such that the expected tokens are the budget (all, where it can't be reached).

    s is found by filling up: cells that reach 1 are taken whole, and the rest of the budget is spread over the others,
    until no more reach 1. Each round takes at least one cell more, so it ends, and in practice after a few.
    """
    def left(s: float) -> tuple[float, float]:
        full = (s * factor >= 1) & (factor > 0)
        return float(tokens[full].sum()), float((factor * tokens)[~full].sum())

    s = _filled(left, budget)
    return np.minimum(1.0, s * factor) if np.isfinite(s) else np.where(factor > 0, 1.0, 0.0)


def _filled(left, budget: float) -> float:
    """The scale of calibrate(): left(s) gives the tokens of cells taken whole under s, and factor * tokens of the others."""
    s = 0.0
    while True:
        whole, rest = left(s)
        if rest <= 0:
            return np.inf
        now = (budget - whole) / rest
        if now <= s * (1 + 1e-12):
            return max(s, now) if s else max(now, 0.0)
        s = now


def features(docs: DataFrame, keep: Sequence[Column], model: topics.Model | None, text: str = "text", source: str = "source", lang: str = "lang", topic_column: str | None = None) -> DataFrame:
    """`keep`, the three categories and the tokens of every row; null categories are a value of their own."""
    category = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(name)
    given = [category(source, "_source"), category(lang, "_lang"), *([category(topic_column, "_given")] if topic_column else [])]
    rows = topics.topics_and_tokens(docs, [*keep, *given], None if topic_column else model, text)
    return rows.withColumn("_topic", F.col("_given")).drop("_given") if topic_column else rows


def tempered(now: DataFrame, name: str, power: float) -> DataFrame:
    """Targets proportional to size ** power: small values are lifted, large ones held down."""
    return now.select(name, F.pow(F.col("_now").cast("double"), F.lit(power)).alias("_goal"))


def _marginals(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, power: float) -> dict[str, DataFrame]:
    """(value, target share) of each marginal: as given, or tempered from its present tokens."""
    out = {}
    for name in NAMES:
        given = (targets or {}).get(name.lstrip("_"))
        now = cells.groupBy(name).agg(F.sum("_tokens").alias("_now"))
        if given:
            table = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"`{name}` string, _goal double")
            out[name] = now.join(table, name, "left").select(name, F.coalesce("_goal", F.lit(0.0)).alias("_goal"))
        else:
            out[name] = tempered(now, name, power)
    return out


def cell_probabilities(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = 0.8, power: float = 0.7, max_driver_cells: int = MAX_DRIVER_CELLS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(_source, _lang, _topic, weight, prob, marginal_error) for every cell of (_source, _lang, _topic, _tokens).

    weight is the raked token weight relative to the present one, prob the chance of a document of the cell to be
    taken, calibrated so that the expected tokens are `budget` of all. marginal_error is the largest gap left between a
    raked share and its target: under `tolerance` unless the targets contradict each other or the empty cells, and the
    rounds ran out. Up to `max_driver_cells` cells the table (its size is checked first) is held in numpy; a larger one
    stays a table. Both take the same steps, rounds and calibration.
    """
    spark = cells.sparkSession
    goals = _marginals(cells, targets, power)
    if cells.limit(max_driver_cells + 1).count() <= max_driver_cells:
        held = cells.orderBy(*NAMES).toPandas()
        keys, aims = [], []
        for name in NAMES:
            values, key = np.unique(held[name].to_numpy(dtype=str), return_inverse=True)
            table = {r[0]: r[1] for r in goals[name].collect()}  # no more values than cells
            aim = np.array([table[v] for v in values])
            keys.append(key)
            aims.append(aim / aim.sum() if aim.sum() else aim)
        tokens = held["_tokens"].to_numpy(dtype=float)
        factor, error = rake(keys, tokens, aims, rounds, tolerance)
        prob = calibrate(factor, tokens, budget * tokens.sum())
        rows = [(str(a), str(b), str(c), float(w), float(p), error) for a, b, c, w, p in zip(*(held[x] for x in NAMES), factor, prob)]
        return spark.createDataFrame(rows, T.StructType([*(T.StructField(x, T.StringType()) for x in NAMES), *(T.StructField(x, T.DoubleType()) for x in ("weight", "prob", "marginal_error"))]))
    factor, error = rake_tables(cells, goals, rounds, tolerance)
    total = factor.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0]

    def left(s: float) -> tuple[float, float]:
        full = (F.col("weight") * F.lit(s) >= 1) & (F.col("weight") > 0)
        got = factor.agg(F.sum(F.when(full, F.col("_tokens"))), F.sum(F.when(~full, F.col("weight") * F.col("_tokens")))).first()
        return float(got[0] or 0), float(got[1] or 0)

    s = _filled(left, budget * total)
    prob = F.least(F.lit(1.0), F.col("weight") * F.lit(s)) if np.isfinite(s) else (F.col("weight") > 0).cast("double")
    return factor.select(*NAMES, "weight", prob.alias("prob"), F.lit(error).alias("marginal_error"))


def taken(doc_id: Column, prob: Column, seed: int) -> Column:
    """Whether a uniform draw from the row's key is under its probability; a null key has a draw of its own."""
    draw = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return draw < prob


def _weighed(rows: DataFrame, targets, budget: float, power: float) -> DataFrame:
    """The cells' probabilities. A cell without a token has no weight to rake: it takes the share of tokens that is kept
    in its source and language, where there are none the share of all, and `budget` in a table without a token."""
    cells = materialize(rows.groupBy(*NAMES).agg(F.sum("_tokens").alias("_tokens")), "cells")
    probs = materialize(cell_probabilities(cells, targets, budget, power), "probs").join(cells, list(NAMES))
    share = lambda c: F.try_divide(F.sum(F.col("prob") * F.col("_tokens")), F.sum("_tokens")).alias(c)
    near = probs.groupBy("_source", "_lang").agg(share("_near"))
    probs = probs.join(near, ["_source", "_lang"]).crossJoin(F.broadcast(probs.agg(share("_all"))))  # one row
    prob = F.when(F.col("_tokens") > 0, F.col("prob")).otherwise(F.coalesce("_near", "_all", F.lit(float(budget))))
    return materialize(probs.select(*NAMES, "weight", prob.alias("prob"), "marginal_error"), "weighed")


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = 0.8, power: float = 0.7, seed: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic_column: str | None = None, model: topics.Model | None = None) -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, weight, prob, kept, marginal_error.

    Token weights are raked to the source, language and topic marginals (`targets`: shares by value; those not given are
    tempered by `power`), and each document is kept with its cell's calibrated probability. The topic is `topic_column`,
    or else the class that `model` (by default topics.fit over `docs`) gives the whole text. Null categories count as
    "(none)"; documents without a token (null, empty and blank texts) carry no weight, and are kept with the probability of
    their cell if it has tokens (under a `topic_column`), else with the share of tokens that is kept in their source and
    language. Draws depend on seed and doc_id only: repeated rows share their fate, and so do all rows with a null
    doc_id of one cell. Other columns aren't read. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        model = None if topic_column else model or topics.fit(docs, doc_id=doc_id, text=text)
        rows = materialize(features(docs, [F.col(doc_id).alias("doc_id")], model, text, source, lang, topic_column), "mixed")
    out = rows.join(_weighed(rows, targets, budget, power), list(NAMES))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "weight", "prob", taken(F.col("doc_id"), F.col("prob"), seed).alias("kept"), "marginal_error")


def mixed_rows(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = 0.8, power: float = 0.7, seed: int = 3, doc_id: str = "doc_id", text: str = "text", model: topics.Model | None = None) -> DataFrame:
    """The rows that mix() keeps, all columns unchanged, whatever their names.

    The rows with their topics and tokens are a written table, so every text is classed once.
    """
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = dict(zip(docs.columns, own.columns))
    with small_batches(docs.sparkSession):
        model = model or topics.fit(docs, doc_id=doc_id, text=text)
        rows = materialize(features(own, [F.col(c) for c in own.columns], model, at[text], at["source"], at["lang"]), "mixed")
    out = rows.join(_weighed(rows, targets, budget, power), list(NAMES)).filter(taken(F.col(at[doc_id]), F.col("prob"), seed))
    return out.select(*own.columns).toDF(*docs.columns)
