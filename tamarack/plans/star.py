"""Star-schema joins and aggregations: the engine's sanity queries and its bench."""

from pyspark.sql import functions as F

from tamarack.plans.registry import plan
from tamarack.session import table

_PRICE = "l_extendedprice * (1 - l_discount)"


@plan("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*)::bigint as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr(_PRICE)), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@plan("""select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, strftime(o_orderdate, '%Y-%m-%d') as day from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""")
def top_orders(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(c, "o_custkey", "left_semi")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice", "l_discount").join(o, "o_orderkey")
    out = rows.groupBy(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate").agg(F.round(F.sum(F.expr(_PRICE)), 2).alias("revenue"))
    return out.select("l_orderkey", "revenue", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@plan("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' group by 1""")
def region_revenue(spark, sf_dir):
    r = table(spark, sf_dir, "region").filter("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    s = table(spark, sf_dir, "nation").join(r, "n_regionkey").select("n_name", F.col("n_nationkey").alias("s_nationkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_extendedprice", "l_discount").join(s, "s_suppkey")
    return rows.groupBy("n_name").agg(F.round(F.sum(F.expr(_PRICE)), 2).alias("revenue"))


@plan("select p_brand, count(distinct l_orderkey)::bigint as n_orders, round(sum(l_quantity), 2) as qty from lineitem join part on p_partkey = l_partkey where p_size between 5 and 15 group by 1")
def brand_orders(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size between 5 and 15").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity").join(p, "l_partkey")
    return rows.groupBy("p_brand").agg(F.count_distinct("l_orderkey").alias("n_orders"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@plan("select c_custkey, (select count(*) from orders where o_custkey = c_custkey)::bigint as n_orders from customer")
def customer_orders(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"))
