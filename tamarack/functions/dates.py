"""Dates in the shapes that sources use; nothing raises, and relative dates take the day they are relative to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def parse(text: Column, formats: Sequence[str]) -> Column:
    """A date by the first format that fits, else null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))


def long_or_short_month(text: Column) -> Column:
    """`Jan 5, 2024` or `January 5, 2024` as yyyy-MM-dd, else the word None."""
    return F.coalesce(F.date_format(parse(text, ("MMM d, yyyy", "MMMM d, yyyy")), "yyyy-MM-dd"), F.lit("None"))


def found_in(text: Column) -> Column:
    """The first `Mon d, yyyy` inside a text as yyyy/MM/dd, else null."""
    hit = F.regexp_extract(text, f"\\b((?:{MONTHS})\\s+\\d{{1,2}},\\s+\\d{{4}})\\b", 1)
    return F.date_format(parse(F.regexp_replace(F.nullif(hit, F.lit("")), "\\s+", " "), ("MMM d, yyyy",)), "yyyy/MM/dd")


def relative(text: Column, as_of: Column) -> Column:
    """`3 days ago` and `3 d ago` counted back from `as_of`; a bare `Jan 5` is of its year; else null."""
    n = F.regexp_extract(text, "^(\\d+) d(?:ays?)? ago$", 1)
    ago = F.date_sub(as_of, F.nullif(n, F.lit("")).cast("int"))
    return F.coalesce(ago, parse(F.concat_ws(", ", text, F.year(as_of).cast("string")), ("MMM d, yyyy",)))


def day_of(text: Column) -> Column:
    """`2024-01-05T10:00:00Z` or `2024-01-05` as a day in text; anything else as it is."""
    return F.coalesce(F.date_format(F.try_to_date(F.split_part(text, F.lit("T"), F.lit(1)), "yyyy-MM-dd"), "yyyy-MM-dd"), text)


def file_day(name: Column) -> Column:
    """The day in a file name's first eight digits, as yyyy-MM-dd."""
    return F.date_format(F.try_to_date(F.substring(name, 1, 8), "yyyyMMdd"), "yyyy-MM-dd")


def file_timestamp(name: Column) -> Column:
    """The first three parts of a_b_c_..., else null."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "_"))


def free(text: Column) -> Column:
    """Common shapes as yyyy-MM-dd, else the trimmed text; null is ''."""
    formats = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(text.isNull(), "").otherwise(F.coalesce(F.date_format(parse(text, formats), "yyyy-MM-dd"), F.trim(text)))


def gap_days(later: Column, earlier: Column, fmt: str = "dd/MM/yy") -> Column:
    """Days between two dates in text; null if either doesn't parse."""
    return F.datediff(F.try_to_date(later, fmt), F.try_to_date(earlier, fmt))


def recent(ts: Column, as_of: Column, days: int = 30) -> Column:
    """Strictly later than `days` before `as_of`, with no upper bound."""
    return ts > as_of - F.make_dt_interval(F.lit(days))


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")
