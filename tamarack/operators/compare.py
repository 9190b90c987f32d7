"""Tables against each other: marks, pending work, overlaps, precision and recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark(left: DataFrame, right: DataFrame, on: Sequence[str], flag: str = "found") -> DataFrame:
    """`left` with a boolean column: whether the key occurs in `right`. Rows are never multiplied."""
    keys = right.select(*on).distinct().withColumn("_hit", F.lit(True))
    return left.join(keys, list(on), "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")


def flag_text(value: Column) -> Column:
    return F.when(value, "TRUE").otherwise("FALSE")


def pending(work: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """What isn't done yet."""
    return work.join(done.select(*on), list(on), "left_anti")


def complete(done: DataFrame, item: str, part: str, parts: int | DataFrame) -> DataFrame:
    """Items that have every one of `parts` parts (relational division); a table of parts is counted in the plan."""
    have = done.groupBy(item).agg(F.count_distinct(part).alias("_n"))
    if isinstance(parts, int):
        return have.filter(F.col("_n") >= parts).select(item)
    wanted = parts.agg(F.count_distinct(part).alias("_wanted"))
    return have.crossJoin(F.broadcast(wanted)).filter(F.col("_n") >= F.col("_wanted")).select(item)  # one row


def latest_facts(facts: DataFrame, on: Sequence[str], order: str | None = None) -> DataFrame:
    """One fact a key, as a look-up table would hold: the last by `order`, or, without one, the greatest in order of its columns."""
    rest = [c for c in facts.columns if c not in on]
    if not rest:
        return facts.distinct()
    whole = F.struct(*rest)
    pick = F.max(whole) if order is None else F.max_by(whole, F.struct(order, *(c for c in rest if c != order)))
    return facts.groupBy(*on).agg(pick.alias("_fact")).select(*on, "_fact.*")


def enrich(rows: DataFrame, facts: DataFrame, on: Sequence[str], defaults: dict[str, object], order: str | None = None) -> DataFrame:
    """A left join whose missing values become defaults; rows are never multiplied (see latest_facts)."""
    out = rows.join(latest_facts(facts, on, order), list(on), "left")
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def update_where(rows: DataFrame, facts: DataFrame, on: Sequence[str], column: str, new: str, where: Column) -> DataFrame:
    """`column` takes the facts' value in rows that fit `where` and have one; rows are never multiplied (see latest_facts)."""
    out = rows.join(latest_facts(facts.select(*on, F.col(new).alias("_new")), on), list(on), "left")
    return out.withColumn(column, F.when(where & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(column))).drop("_new")


def overlap(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: common, only_a, only_b, and the common share of each, from one full join of distinct keys."""
    x, y = a.select(*on).distinct().withColumn("_a", F.lit(1)), b.select(*on).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, list(on), "full")
    out = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
    share = lambda n: F.coalesce(F.try_divide(F.col("common"), F.col("common") + F.col(n)), F.lit(0.0))
    return out.withColumn("share_a", share("only_a")).withColumn("share_b", share("only_b"))


def prf1(truth: DataFrame, guess: DataFrame, on: str, by: Sequence[str] = (), total: int | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of distinct names, per group of `by`; 0 where a denominator is.

    `total` fixes the number of true names instead of counting them (tp is then held under it).
    """
    keys = [*by, on]
    t = truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    g = guess.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = t.join(g, keys, "full")
    tp = F.count_if(F.col("_t").isNotNull() & F.col("_g").isNotNull())
    fp = F.count_if(F.col("_t").isNull())
    fn = F.count_if(F.col("_g").isNull())
    grouped = both.groupBy(*by) if by else both.groupBy()
    out = grouped.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    if total is not None:
        out = out.withColumn("tp", F.least("tp", F.lit(total).cast("long"))).withColumn("fn", F.greatest(F.lit(total) - F.col("tp"), F.lit(0)).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumn("precision", zero(F.try_divide("tp", F.col("tp") + F.col("fp")))).withColumn("recall", zero(F.try_divide("tp", F.col("tp") + F.col("fn"))))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def mark_by_name(left: DataFrame, right: DataFrame, remap: dict[str, str] | None = None, flag: str = "found") -> DataFrame:
    """mark() on (manager, lower-case trimmed name); `remap` renames the right side's managers first."""
    manager = F.col("manager")
    for old, new in (remap or {}).items():
        manager = F.when(F.col("manager") == old, new).otherwise(manager)
    keys = right.select(manager.alias("_m"), name_key(F.col("name")).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    rows = left.join(keys, (F.col("manager") == F.col("_m")) & (name_key(F.col("name")) == F.col("_k")), "left")
    return rows.withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_m", "_k", "_hit")


def mentioned(packages: DataFrame, entities: DataFrame, name: str, file: str, found: str) -> DataFrame:
    """Packages that occur among their file's entities: the lists are exploded and met by equality, not a pattern a package."""
    each = entities.select(F.col(file).alias("_f"), F.explode(found).alias("_e")).select("_f", name_key(F.col("_e")).alias("_e")).distinct()
    return packages.join(each, (F.col(file) == F.col("_f")) & (name_key(F.col(name)) == F.col("_e")), "left_semi")


def by_file(truth: DataFrame, tools: DataFrame, file: str) -> DataFrame:
    """The ground truth of every file beside the tool's output; a file without output has an empty one."""
    return truth.join(tools, file, "left").withColumn("missing", F.col("found").isNull()).withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def either_in(rows: DataFrame, a: str, b: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose column a or b is among the keys: two equi semi joins united, as an OR join would compare all pairs."""
    ka, kb = keys.select(F.col(key).alias(a)), keys.select(F.col(key).alias(b))
    return rows.join(ka, a, "left_semi").unionByName(rows.join(kb, b, "left_semi").join(ka, a, "left_anti")).select(*rows.columns)
