"""Quality rules with risk-controlled thresholds; DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialize, text_or_empty

# Fixed values of the contract: the white space between words and the symbols counted.
SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Reject rows whose `measure` (SQL over the base columns) exceeds a cutoff chosen from `grid`."""

    name: str
    measure: str
    grid: tuple[float, ...]


# Each grid runs from the mildest cutoff to the most aggressive.
RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.25, 0.1)),
    Rule("dup_lines", "n_dup_lines / greatest(n_words, 1)", (0.5, 0.25, 0.1, 0.05, 0.02, 0.01)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", (0.18, 0.15, 0.12, 0.09, 0.06, 0.03)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0)),
)


def base_columns(text: Column) -> dict[str, Column]:
    """The words, lines and character counts of one text."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "_words": words,
        "_lines": lines,
        "word_chars": F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def base_counts(docs: DataFrame, keep: Sequence[Column], text: str = "text", window: int = 5) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text.

    All in the row: no explode, no shuffle. Positions covered by repeated windows: window hashes are sorted with their
    positions, equal neighbours mark repeats, and the union of the marked intervals is summed over sorted starts, so long
    texts cost n log n.
    """
    body = docs.select(*keep, text_or_empty(text).alias("_text"))
    cols = base_columns(F.col("_text"))
    names = [c for c in body.columns if c != "_text"]
    a = body.select(*names, *(v.alias(k) for k, v in cols.items()))
    a = a.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    parts = ", ".join(f"_h[i + {j}]" for j in range(window))
    a = a.withColumn("_w", F.expr(f"case when size(_h) >= {window} then transform(sequence(0, size(_h) - {window}), i -> xxhash64({parts})) else array() end")).drop("_h")
    # only texts that repeat a window are sorted
    a = a.withColumn("_s", F.expr("case when size(array_distinct(_w)) < size(_w) then array_sort(transform(_w, (h, i) -> struct(h as h, i as i))) end")).drop("_w")
    a = a.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, j) -> x.h <=> get(_s, j - 1).h or x.h <=> get(_s, j + 1).h), x -> x.i))")).drop("_s")
    covered = f"aggregate(transform(_p, (p, j) -> cast(least({window}, coalesce(get(_p, j + 1) - p, {window})) as long)), 0L, (s, x) -> s + x)"
    return a.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0).cast("long"))).drop("_p")


def _stirling_error(n: str) -> str:
    """SQL of ln n! less Stirling's (n + 1/2) ln n - n + ln sqrt(2 pi): a sum up to 15, its series beyond."""
    x = f"cast({n} as double)"
    series = f"(1D / 12 - (1D / 360 - (1D / 1260 - (1D / 1680 - 1D / 1188 / ({x} * {x})) / ({x} * {x})) / ({x} * {x})) / ({x} * {x})) / {x}"
    plain = f"aggregate(sequence(1L, cast({n} as bigint)), 0D, (s, i) -> s + ln(cast(i as double))) - (({x} + 0.5D) * ln({x}) - {x} + 0.5D * ln(2 * pi()))"
    return f"(case when {n} > 15 then {series} else {plain} end)"


def binomial_cdf(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding; 1 where k >= n p, whose bound could never pass.

    The largest term (k) comes from the saddle point (Stirling errors and deviances, nothing cancels or underflows at any
    n); the others follow downwards by their ratio. Terms more than ten deviations below are under rounding, so a tail
    takes about ten times the square root of n p steps at most, however many labels there are.
    """
    odds, q = p / (1 - p), 1 - p
    x, m = f"cast({k} as double)", f"cast({n} as double)"
    deviance = f"({x} * ln({x} / ({m} * {p}D)) + {m} * {p}D - {x} + ({m} - {x}) * ln(({m} - {x}) / ({m} * {q}D)) + {m} * {q}D - ({m} - {x}))"
    log_term = f"{_stirling_error(n)} - {_stirling_error(k)} - {_stirling_error(f'({n} - {k})')} - {deviance} + 0.5D * ln({m} / (2 * pi() * {x} * ({m} - {x})))"
    head = f"case when {k} = 0 then {m} * ln({q}D) else {log_term} end"
    steps = f"cast(least({k}, ceil(10 * sqrt({m} * {p * q}D)) + 50) as bigint)"
    ratio = f"({x} - j) / (({m} - {x} + j + 1) * {odds}D)"
    tail = f"case when {k} = 0 then 1D else aggregate(sequence(0L, {steps} - 1), named_struct('t', 1D, 's', 1D), (a, j) -> named_struct('t', a.t * {ratio}, 's', a.s + a.t * {ratio}), a -> a.s) end"
    return F.expr(f"case when {k} >= {n} * {p}D then 1D else least(1D, exp({head}) * {tail}) end")


def thresholds(scored: DataFrame, rules: Sequence[Rule] = RULES, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff): the most aggressive cutoffs whose false rejections are certified.

    `scored` has a row per labelled good document with `stratum` and one column per rule. For each stratum, rule and
    cutoff the null hypothesis is that the chance of rejecting a good document exceeds risk / number of rules; its
    p-value is the exact binomial tail of the observed rejections. Cutoffs are walked from mild to aggressive and the
    walk ends at the first that isn't rejected (fixed sequence), at the level delta / (strata x rules) (Bonferroni).
    So with probability 1 - delta, in every stratum at most `risk` of good documents fall to all rules together.
    A stratum without enough good documents gets no cutoff and rejects nothing; an empty table gives no row.
    """
    share = risk / len(rules)
    grid = [F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(r.name).alias("value")) for r in rules for i, c in enumerate(r.grid)]
    cells = scored.select("stratum", F.explode(F.array(*grid)).alias("g")).groupBy("stratum", "g.rule", "g.step", "g.cutoff")
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g.value") > F.col("g.cutoff")).alias("k"))
    strata = cells.agg(F.greatest(F.count_distinct("stratum"), F.lit(1)).alias("strata"))
    tested = cells.crossJoin(F.broadcast(strata)).withColumn("p_value", binomial_cdf("k", "n", share))  # one row
    tested = tested.withColumn("passed", F.col("p_value") <= F.lit(delta) / (F.col("strata") * len(rules)))
    walk = tested.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("passed"), F.col("step"))).alias("stop"), F.collect_list(F.struct("step", "cutoff")).alias("steps"))
    last = "array_max(filter(steps, s -> stop is null or s.step < stop)).cutoff"
    return walk.select("stratum", "rule", F.expr(last).alias("cutoff")).filter("cutoff is not null")


def measures(docs: DataFrame, keep: Sequence[Column], text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """`keep`, the base counts, base_failed and a column per rule of every row, as a written table."""
    base = materialize(base_counts(docs, keep, text).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")), "base")
    return base.select("*", *(F.expr(r.measure).cast("double").alias(r.name) for r in rules))


def holdout(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """The measured rows that labels call good and the base rules pass."""
    good = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("doc_id")).distinct()
    return measured.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", rules: Sequence[Rule] = RULES, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept, rule_failed, stratum.

    base_failed: n_words < 10, or repeated words over a fifth. kept is false for these; for the others it is the
    verdict of the certified cutoffs. Null texts count as empty (no words, so base_failed); a null stratum is one of its
    own; rows that repeat a doc_id are judged each by itself; without labels nothing but the base rules rejects. A
    labelled document is a holdout for the thresholds if its label is quality 1 (of labels that contradict each other, if any
    one is) and it passes the base rules. Only
    doc_id, text and stratum are read, so other columns may have any name.
    """
    keep = [F.col(doc_id).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("(none)")).alias("stratum")]
    measured = measures(docs, keep, text, rules)
    cut = thresholds(holdout(measured, labels), rules, risk, delta)
    wide = cut.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in rules))
    wide = materialize(wide, "cutoffs")
    out = measured.join(wide, "stratum", "left")
    over = F.array_compact(F.array(*(F.when(F.col(r.name) > F.col(f"cut_{r.name}"), F.lit(r.name)) for r in rules)))
    out = out.withColumn("rule_failed", F.array_join(over, ","))
    kept = ~F.col("base_failed") & (F.col("rule_failed") == "")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule_failed", "stratum")
