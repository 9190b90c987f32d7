"""Dates in the shapes of the sources."""

from pyspark.sql import functions as F

from tamarack.functions import dates as d
from tamarack.plans.registry import plan
from tamarack.session import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")


@plan("select o_orderkey, case when o_orderkey % 3 = 2 then 'None' else strftime(o_orderdate, '%Y-%m-%d') end as day from orders")
def parse_dates_multi(spark, sf_dir):
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.lower(F.date_format("o_orderdate", "MMMM d, yyyy"))).otherwise("soon")
    return _orders(spark, sf_dir).select("o_orderkey", d.long_or_short_month(shown).alias("day"))


@plan("select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as day from orders")
def find_date(spark, sf_dir):
    shown = F.concat(F.lit("seen on "), F.date_format("o_orderdate", "MMM d, yyyy"), F.lit(" at noon"))
    return _orders(spark, sf_dir).select("o_orderkey", d.found_in(shown).alias("day"))


@plan("select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then null else datediff('day', o_orderdate, l_shipdate) end::int as gap from lineitem join orders on o_orderkey = l_orderkey")
def day_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(_orders(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
    ship = F.when(F.col("l_linenumber") % 2 != 0, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise("unknown")
    return rows.select("l_orderkey", "l_linenumber", d.gap_days(ship, F.date_format("o_orderdate", "dd/MM/yyyy"), "dd/MM/yyyy").alias("gap"))


@plan("select o_orderkey, strftime(o_orderdate, '%Y%m%d') || '_101112_' || o_orderkey::varchar as stamp, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def file_ts_prefix(spark, sf_dir):
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_101112_"), F.col("o_orderkey").cast("string"), F.lit("_verify_cot"))
    return _orders(spark, sf_dir).select("o_orderkey", d.file_timestamp(name).alias("stamp"), d.file_day(name).alias("day"))


@plan("select o_orderkey, case when o_orderkey % 3 = 0 then (o_orderdate::date - ((o_orderkey % 9)::int)) when o_orderkey % 3 = 1 then make_date(year(o_orderdate), 1, 5) end::date as day from orders")
def relative_days(spark, sf_dir):
    n = (F.col("o_orderkey") % 9).cast("string")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(n, F.lit(" days ago"))).when(F.col("o_orderkey") % 3 == 1, "Jan 5").otherwise("3d ago")
    return _orders(spark, sf_dir).select("o_orderkey", d.relative(shown, F.to_date("o_orderdate")).alias("day"))


@plan("select o_orderkey, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') else 'later' end as day, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') else 'x' end as freely from orders")
def day_of_iso(spark, sf_dir):
    even = F.col("o_orderkey") % 2 == 0
    iso = F.when(even, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("later")
    loose = F.when(even, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(" x ")
    return _orders(spark, sf_dir).select("o_orderkey", d.day_of(iso).alias("day"), d.free(loose).alias("freely"))


@plan("select event_id, strftime(to_timestamp(event_id * 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as shown from events")
def epoch_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", d.epoch_text(F.col("event_id") * 3600).alias("shown"))
