"""Semi-structured records: VARIANT access, scalar-or-list fields, salvage and quarantine."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.normalise import manager_record
from tamarack.functions.text import bracketed, without_fence

EMPTY_TEXTS = ("", "[]", "{}", "[{}]")


def path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def scalar_or_list(value: Column, key: str) -> Column:
    """A field that is sometimes text and sometimes a list, as array<string>; absent or null is null."""
    many = F.try_variant_get(value, path(key), "array<string>")
    one = F.try_variant_get(value, path(key), "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def first_present(value: Column, keys: Sequence[str]) -> Column:
    """The field under the first key that is present with a value, as array<string>."""
    return F.coalesce(*(scalar_or_list(value, k) for k in keys))


def items(value: Column, wrappers: Sequence[str] = ("packages", "data", "results")) -> Column:
    """The records of a document as array<variant>: a list, a list under a wrapper key, or the object itself."""
    listed = [F.try_variant_get(value, "$", "array<variant>"), *(F.try_variant_get(value, path(k), "array<variant>") for k in wrappers)]
    return F.coalesce(*listed, F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(value)))


def parsed(text: Column, salvage: bool = True) -> Column:
    """A text as VARIANT: fences off, then as it is, then (salvage) from the first [ to the last ]; null if neither parses."""
    clean = without_fence(text)
    tries = [F.try_parse_json(clean)] + ([F.try_parse_json(bracketed(clean))] if salvage else [])
    return F.coalesce(*tries)


def triage(docs: DataFrame, text: str = "text", salvage: bool = True) -> DataFrame:
    """The input with `state` (empty, bad or good) and `doc` (VARIANT, null unless good): errors are rows, not failures."""
    clean = without_fence(F.col(text))
    out = docs.withColumn("_doc", parsed(F.col(text), salvage))
    state = F.when(F.col(text).isNull() | clean.isin(*EMPTY_TEXTS) | clean.contains("[{}]"), "empty").when(F.col("_doc").isNull(), "bad").otherwise("good")
    return out.withColumn("state", state).withColumn("doc", F.when(F.col("state") == "good", F.col("_doc"))).drop("_doc")


def is_empty_record(text: str | None) -> bool:
    """Whether a JSON text says nothing: an object with any empty value, a list of only empty ones, or {} in a list.

    The asymmetry (any for objects, all for lists) is the defined behaviour. Text that doesn't parse is not empty.
    """

    def empty(x: object) -> bool:
        if x is None or x == "" or x == [] or x == {}:
            return True
        if isinstance(x, dict):
            return any(empty(v) for v in x.values())
        return isinstance(x, list) and all(empty(v) for v in x)

    if text is None or not text.strip() or "[{}]" in text.replace(" ", ""):
        return True
    try:
        return empty(json.loads(text))
    except ValueError:
        return False


@F.pandas_udf(T.BooleanType())
def empty_record(texts: pd.Series) -> pd.Series:
    """is_empty_record() over Arrow batches: the recursion has no built-in form."""
    return texts.map(is_empty_record)


@F.pandas_udf(T.ArrayType(T.StringType()))
def values_of_key(texts: pd.Series, keys: pd.Series) -> pd.Series:
    """All values under a key at any depth of a JSON text, in document order (lists flattened one level)."""

    def walk(x: object, key: str) -> list[str]:
        out: list[str] = []
        if isinstance(x, dict):
            for k, v in x.items():
                if k == key:
                    out += [str(i) for i in v] if isinstance(v, list) else [str(v)]
                else:
                    out += walk(v, key)
        elif isinstance(x, list):
            for v in x:
                out += walk(v, key)
        return out

    def one(text: str | None, key: str) -> list[str]:
        try:
            return walk(json.loads(text), key) if text else []
        except ValueError:
            return []

    return pd.Series([one(t, k) for t, k in zip(texts, keys)])


def split_records(docs: DataFrame, name_keys: Sequence[str], manager_keys: Sequence[str], doc: str = "doc") -> DataFrame:
    """A row per record, name and manager: lists exploded both ways, `unknown` and `other` where there is none."""
    rows = docs.select(*(c for c in docs.columns if c != doc), F.explode(items(F.col(doc))).alias("record")).filter(~F.is_variant_null("record"))
    names = F.coalesce(first_present(F.col("record"), name_keys), F.array())
    managers = F.coalesce(first_present(F.col("record"), manager_keys), F.array())
    rows = rows.withColumn("_names", F.when(F.size(names) == 0, F.array(F.lit("unknown"))).otherwise(names))
    rows = rows.withColumn("_managers", F.when(F.size(managers) == 0, F.array(F.lit("other"))).otherwise(managers))
    rows = rows.withColumn("package_name", F.explode("_names")).withColumn("package_manager", F.explode("_managers"))
    return rows.withColumn("package_manager", manager_record(F.col("package_manager"))).drop("_names", "_managers")


def record_columns(record: Column, fields: dict[str, str]) -> list[Column]:
    """Fields of a record as array<string> columns, by {column: key}."""
    return [scalar_or_list(record, key).alias(column) for column, key in fields.items()]


def comma_text(values: Column) -> Column:
    return F.coalesce(F.array_join(values, ", "), F.lit(""))
