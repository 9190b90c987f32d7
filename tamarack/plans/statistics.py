"""Counts, shares, rollups, distributions and tops."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.functions import dates, normalise
from tamarack.operators import stats
from tamarack.plans.registry import plan
from tamarack.session import table


@plan("select lang, count(*)::bigint as n from documents where lang is not null group by lang order by n desc, lang limit 3")
def export_top_items(spark, sf_dir):
    return stats.top(stats.counts(table(spark, sf_dir, "documents").filter("lang is not null"), "lang"), "n", 3, "lang")


@plan("""select count(*)::bigint as n_rows, count(distinct lang)::bigint as n_langs, count(distinct source)::bigint as n_sources, count(*) filter (where n_chars > 1000)::bigint as n_long from documents""")
def export_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lang").alias("n_langs"), F.count_distinct("source").alias("n_sources"), F.count_if(F.col("n_chars") > 1000).alias("n_long"))


@plan("select event_type, count(*)::bigint as n from events where ts > (select max(ts) from events) - interval 30 days group by 1")
def recent_30d(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    as_of = e.agg(F.max("ts").alias("as_of"))
    return e.crossJoin(F.broadcast(as_of)).filter(dates.recent(F.col("ts"), F.col("as_of"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))  # one row


@plan("select o_custkey, array_to_string(list_transform(list_sort(list(distinct l_linenumber)), lambda x: x::varchar), ',') as versions, min(strftime(l_shipdate, '%Y-%m-%d')) as first_date from orders join lineitem on l_orderkey = o_orderkey group by 1")
def sorted_versions_first_date(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate"), "o_orderkey")
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda x: x.cast("string")), ",").alias("versions"), F.min(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("first_date"))


@plan("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as idx from orders")
def running_index(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("idx"))


@plan("""with per as (select user_id, count(*)::bigint as n from events group by 1)
select n as times, count(*)::bigint as n_keys, (select median(n) from per)::double as median_times from per group by n""")
def freq_of_freq_median(spark, sf_dir):
    return stats.frequency_of_frequencies(table(spark, sf_dir, "events"), "user_id")


@plan("""with per as (select l_orderkey, max(l_linenumber) as maximum from lineitem group by 1), c as (select maximum, count(*)::bigint as n from per group by 1)
select maximum, n, n / sum(n) over () as share, sum(n) over (order by maximum) / sum(n) over () as cum_share, maximum <= 5 as within from c""")
def max_index_share(spark, sf_dir):
    return stats.maxima(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 5)


@plan("""with r as (select lang, source, grouping(lang, source)::bigint as level, count(*)::bigint as n from documents group by rollup (lang, source))
select *, case when level = 0 then n / sum(case when level = 0 then n end) over (partition by lang, level) end as share from r""")
def source_share_rollup(spark, sf_dir):
    return stats.rollup_shares(table(spark, sf_dir, "documents"), "lang", "source")


@plan("""select event_type, (user_id % 7)::bigint as grp, grouping(event_type, user_id % 7)::bigint as level, count(*)::bigint as n, round(sum(value), 2) as total from events group by cube (event_type, user_id % 7)""")
def type_cube(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 7)
    return e.cube("event_type", "grp").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@plan("select source, case source when 'src1' then 3609 when 'src2' then 7513 else count(*) end::bigint as n from documents group by source")
def override_counts(spark, sf_dir):
    return stats.overridden(table(spark, sf_dir, "documents"), "source", {"src1": 3609, "src2": 7513})


@plan("""with u as (select user_id, list(distinct event_type) as types from events group by 1), c as (select len(types)::int as size, count(*)::bigint as n from u group by 1)
select size, n, n / sum(n) over () * 100 as percent from c""")
def array_size_distribution(spark, sf_dir):
    return stats.sizes(table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types")), "types")


@plan("""with u as (select user_id, count(distinct event_type)::int as n_types from events group by 1 having count(distinct event_type) >= 2)
select user_id, n_types, (select count(*) from u)::bigint as n_all from u order by n_types desc, user_id limit 20""")
def multi_valued_top20(spark, sf_dir):
    many = table(spark, sf_dir, "events").groupBy("user_id").agg(F.size(F.collect_set("event_type")).alias("n_types")).filter("n_types >= 2")
    return stats.top(many, "n_types", 20, "user_id").crossJoin(F.broadcast(many.agg(F.count(F.lit(1)).alias("n_all"))))  # one row


@plan("""with c as (select props, count(*) filter (where event_type = 'click')::bigint as click, count(*) filter (where event_type = 'view')::bigint as view from events where event_type in ('click', 'view') group by 1)
select *, click + view as total from c order by total desc, props limit 15""")
def pivot_zero_fill_top15(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return stats.top(stats.two_way(e, "props", "event_type", ["click", "view"]), "total", 15, "props")


@plan("""with u as (select user_id, list(event_type order by event_id) as t from events group by 1)
select user_id, array_to_string(list_filter(t, lambda x: x not in ('click', 'view')), ',') as kept, len(list_filter(t, lambda x: x in ('click', 'view')))::int as n_banned from u""")
def filter_disallowed_values(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("t"))
    banned = ["click", "view"]
    return u.select("user_id", F.array_join(normalise.without(F.col("t"), banned), ",").alias("kept"), F.size(normalise.within(F.col("t"), banned)).alias("n_banned"))


_SPELT = "case event_id % 9 when 0 then null when 1 then '' when 2 then 'PIP' when 3 then 'Python' when 4 then 'N/A' when 5 then 'NodeJS' when 6 then 'pypl' when 7 then ' Ruby ' else event_type end"


def _spelt(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr(_SPELT).alias("m"))


@plan(f"select event_id, case when m is null or lower(m) in ('', 'unknown', 'n/a') then 'other' when lower(m) in ('pypi', 'python', 'pip') then 'pypi' else lower(m) end as m from (select event_id, {_SPELT} as m from events)")
def normalise_alias_a(spark, sf_dir):
    return _spelt(spark, sf_dir).select("event_id", normalise.manager_record(F.col("m")).alias("m"))


@plan(f"select event_id, case when m is null or m = '' then 'other' when lower(m) in ('python', 'pip') then 'pypi' else lower(m) end as m from (select event_id, {_SPELT} as m from events)")
def normalise_alias_b(spark, sf_dir):
    return _spelt(spark, sf_dir).select("event_id", normalise.manager_first(F.array("m", F.lit("npm"))).alias("m"))


_ECO = "case when m is null or m = '' then 'unknown' when trim(lower(m)) in ('npm', 'js', 'javascript', 'node', 'nodejs') then 'npm' when trim(lower(m)) in ('pypi', 'python', 'pip', 'pypl') then 'pypi' {more} else trim(lower(m)) end"


@plan(f"select event_id, {_ECO.format(more="when trim(lower(m)) in ('ruby', 'gem', 'rubygems') then 'rubygems'")} as m from (select event_id, {_SPELT} as m from events)")
def normalise_alias_c(spark, sf_dir):
    return _spelt(spark, sf_dir).select("event_id", normalise.manager_ecosystem(F.col("m")).alias("m"))


@plan(f"select event_id, {_ECO.format(more='')} as m from (select event_id, {_SPELT} as m from events)")
def normalise_alias_d(spark, sf_dir):
    return _spelt(spark, sf_dir).select("event_id", normalise.manager_two(F.col("m")).alias("m"))


@plan("""select n_nationkey, case when n_nationkey % 3 = 0 then n_name else 'fallback' end as label, case when n_nationkey % 3 = 0 then 1 when n_nationkey % 3 = 1 then 2 else 0 end::int as n_filled from nation""")
def filled_and_fallback(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("v", F.expr("case n_nationkey % 3 when 0 then n_name when 1 then '' end")).withColumn("vs", F.expr("case n_nationkey % 3 when 0 then array(n_name, '') when 1 then array('x', 'null', 'y') else array(cast(null as string)) end"))
    return n.select("n_nationkey", normalise.or_else(F.col("v"), F.lit("fallback")).alias("label"), F.size(normalise.filled(F.col("vs"))).alias("n_filled"))


@plan("select s_nationkey, arg_min(s_name, s_suppkey) as s_name from supplier where s_acctbal > 0 group by 1")
def mirror_first_match(spark, sf_dir):
    return stats.first_available(table(spark, sf_dir, "supplier"), "s_nationkey", "s_name", "s_suppkey", F.col("s_acctbal") > 0)


@plan("select source, count(*)::bigint as n_files, sum(n_chars)::bigint as bytes, max(doc_id) as last_id from documents group by 1")
def latest_file_per_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_chars").alias("bytes"), F.max("doc_id").alias("last_id"))


@plan("""select conv_id, (sum(n + 4) + 2)::bigint as n_tokens from (select conv_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n from conversations) group by 1""")
def token_budget(spark, sf_dir):
    from tamarack.sources.external import token_budget as budget

    c = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.filter(F.split("text", "\\s+"), lambda x: x != "")))
    return budget(c, "conv_id", "n")


@plan("""with c as (select n_nationkey, count(*)::bigint as n from customer join nation on n_nationkey = c_nationkey group by 1) select n_nationkey, n, n >= 50 as large from c where n > 10""")
def having_threshold(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return stats.counts(c, "n_nationkey", least=11).withColumn("large", F.col("n") >= 50)
