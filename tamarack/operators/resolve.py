"""Conflicts between sources: voting, merging, and how much there is to resolve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL_PACKAGES = 34313  # fixed value: the denominator of published shares


def with_group_key(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have every key, not null and not empty."""
    keep = F.lit(True)
    for k in keys:
        keep = keep & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return records.filter(keep)


def vote(records: DataFrame, keys: Sequence[str], field: str, date: str, seq: str, value_key: Column | None = None, out: str = "winner") -> DataFrame:
    """Per group: the winning value, its votes and the number of distinct values.

    Most votes win, then the latest date (missing is earliest), then the value seen first by `seq`. Values with the
    same `value_key` are one vote, and the first original value with that key is returned. Two aggregations on nested
    keys: the first combines map-side, so a group of any size sends one row per value and task.
    """
    key = F.col(field) if value_key is None else value_key
    rows = with_group_key(records, keys).filter(F.col(field).isNotNull()).withColumn("_k", key)
    per = rows.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("_n"), F.max(date).alias("_d"), F.min(F.struct(seq, field)).alias("_f"))
    best = F.max_by(F.col(f"_f.{field}"), F.struct("_n", "_d", (-F.col(f"_f.{seq}")).alias("_s")))
    return per.groupBy(*keys).agg(best.alias(out), F.max("_n").alias("votes"), F.count(F.lit(1)).alias("n_values"))


def latest_value(field: str, date: str, seq: str) -> Column:
    """The field of the record with the latest date (first by `seq` among equals), null if that record has none."""
    return F.max_by(field, F.struct(F.coalesce(F.col(date).cast("string"), F.lit("")), -F.col(seq)))


def union_values(field: str) -> Column:
    """All distinct values as a sorted array; array fields are flattened."""
    return F.array_sort(F.collect_set(field))


def resolve(records: DataFrame, keys: Sequence[str], voted: Sequence[str], merged: Sequence[str], unioned: Sequence[str], date: str, seq: str, mode: str = "reference") -> DataFrame:
    """One row per group: every voted field by majority, every merged field of the latest record, unions of the rest.

    Fields of type array vote by their sorted text. mode `union` unites the merged (array) fields of all records instead
    of taking the latest. All voted fields are melted and voted in one pass, then pivoted back to columns.
    """
    rows = with_group_key(records, keys)
    types = {f.name: f.dataType for f in records.schema.fields}
    many = lambda c: types[c].typeName() == "array"
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    vk = lambda c: F.array_join(F.array_sort(F.col(c)), ",") if many(c) else F.col(c).cast("string")
    melted = rows.select(*keys, F.col(date).alias("_date"), F.col(seq).alias("_seq"), F.explode(F.array(*(F.struct(F.lit(c).alias("f"), vk(c).alias("k"), text(c).alias("v"), F.col(c).isNotNull().alias("has")) for c in voted))).alias("m"))
    melted = melted.filter("m.has").select(*keys, "_date", "_seq", F.col("m.f").alias("_field"), F.col("m.k").alias("_k"), F.col("m.v").alias("_v"))
    won = vote(melted, [*keys, "_field"], "_v", "_date", "_seq", F.col("_k"))
    wide = won.groupBy(*keys).pivot("_field", list(voted)).agg(F.first("winner"))
    for c in voted:
        wide = wide.withColumn(c, F.from_json(c, f"v {types[c].simpleString()}")["v"])
    aggs = [F.count(F.lit(1)).alias("n_records")]
    for c in merged:
        flat = F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) if many(c) else union_values(c)
        aggs.append((flat if mode == "union" else latest_value(c, date, seq)).alias(c))
    aggs += [(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) if many(c) else union_values(c)).alias(c) for c in unioned]
    return rows.groupBy(*keys).agg(*aggs).join(wide, list(keys), "left")


def conflict_profile(records: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, n_sources, n_distinct, needs_vote) in long form, for groups of more than one record.

    A field with no value at all needs no vote.
    """
    melted = records.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(f).cast("string")), F.lit("")).alias("value")) for f in fields))).alias("m"))
    per = melted.groupBy(key, F.col("m.field").alias("field")).agg(F.count(F.lit(1)).alias("n_sources"), F.count_distinct("m.value").alias("n_distinct"))
    return per.filter("n_sources > 1").withColumn("needs_vote", F.col("n_distinct") > 1)


def first_conflicts(profile: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The first k groups, in order of their keys, that have a field that needs a vote, with these fields."""
    return profile.filter("needs_vote").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("fields")).orderBy(key).limit(k)


def conflict_summary(profile: DataFrame, total: int = TOTAL_PACKAGES) -> DataFrame:
    """Per field: groups that need a vote, groups that merge directly, and their shares of a fixed total in percent."""
    out = profile.groupBy("field").agg(F.count_if("needs_vote").alias("voting"), F.count_if(~F.col("needs_vote")).alias("direct"))
    return out.withColumn("voting_pct", F.round(F.col("voting") * 100.0 / total, 4)).withColumn("direct_pct", F.round(F.col("direct") * 100.0 / total, 4))


def field_stats(records: DataFrame, fields: Sequence[str], samples: int = 5) -> DataFrame:
    """(field, total, distinct, samples): counts over scalar or list fields, empty values left out; smallest samples first."""
    types = {f.name: f.dataType.typeName() for f in records.schema.fields}
    as_list = lambda c: F.col(c).cast("array<string>") if types[c] == "array" else F.array(F.col(c).cast("string"))
    melted = records.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), as_list(c).alias("vs")) for c in fields))).alias("m")).select("m.field", F.explode("m.vs").alias("v")).filter("v is not null and v not in ('', 'null')")
    per = melted.groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("field").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.array_join(F.slice(F.array_sort(F.collect_set("v")), 1, samples), ",").alias("samples"))


def latex_table(summary: DataFrame) -> DataFrame:
    """One row: a LaTeX table of the summary, a line per field in order."""
    line = F.format_string("%s & %d & %.2f\\%% & %d & %.2f\\%% \\\\", F.replace("field", F.lit("_"), F.lit("\\_")), "voting", "voting_pct", "direct", "direct_pct")
    body = summary.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))), lambda s: s["line"]), "\n").alias("rows"))
    return body.select(F.concat(F.lit("\\begin{tabular}{lrrrr}\n"), "rows", F.lit("\n\\end{tabular}")).alias("latex"))
