"""Package records: feeds and flat tables in their target shapes, and what is counted over them."""

from pyspark.sql import functions as F

from tamarack.functions import normalise, urls
from tamarack.operators import records, resolve, stats
from tamarack.plans.registry import plan
from tamarack.plans.resolving import _PROFILE, _events_profile
from tamarack.session import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@plan("""select 'p' || user_id as package_name, case event_id % 4 when 0 then 'npm' when 1 then 'pypi' else 'other' end as package_manager, case when event_id % 3 > 0 then '<' || (event_id % 3) end as version,
  event_type as attack_method, case when event_id % 2 = 0 then '2024-02-01' when event_id % 5 = 0 then 'soon' else strftime(ts, '%Y-%m-%d') end as post_date, case when event_id % 2 = 0 then 'http://' || event_id else '' end as source_link, 'github' as source from events""")
def feed_records(spark, sf_dir):
    """An advisory feed in the schema of package records; the page's date, else the feed's own, as a day where it is one."""
    e, k = _events(spark, sf_dir), F.col("event_id")
    manager = F.when(k % 4 == 0, "NPM").when(k % 4 == 1, "pip").when(k % 4 == 2, "n/a")
    feed = e.select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("package_name"), manager.alias("package_manager"), k.cast("string").alias("timestamp"),
        F.when(k % 3 > 0, F.concat(F.lit("<"), (k % 3).cast("string"))).otherwise("").alias("affected_version"), F.when(k % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("update_date"), F.col("event_type").alias("overview"),
    )
    links = e.filter("event_id % 2 = 0").select(k.cast("string").alias("timestamp"), F.lit("2024-02-01").alias("date"), F.concat(F.lit("http://"), k.cast("string")).alias("link"))
    out = records.from_feed(feed, links)
    return out.select("package_name", "package_manager", F.array_join("version", ",").alias("version"), F.array_join("attack_method", ",").alias("attack_method"), "post_date", "source_link", "source")


@plan("""select 'pkg' || user_id as "packageName", event_type as "packageManager", case when event_id % 3 = 0 then 'a, b' when event_id % 3 = 1 then '1.0' else '' end as version, strftime(ts, '%Y-%m-%d') as "discoveryDate", '2024-03-01' as "timestamp", 'x' as source
from events where event_id % 7 > 0""")
def front_end_rows(spark, sf_dir):
    """The flat table in the front end's names: no row without a name, list literals as texts, dates as days."""
    e, k = _events(spark, sf_dir), F.col("event_id")
    blank = {c: F.lit(None).cast("string").alias(c) for c in ("repository_url", "attack_method", "discoverer", "impacted_systems", "attack_vector", "iocs")}
    flat = e.select(
        F.when(k % 7 == 0, F.when(k % 2 == 0, " ")).otherwise(F.concat(F.lit(" pkg"), F.col("user_id").cast("string"))).alias("package_name"), F.col("event_type").alias("package_manager"),
        F.when(k % 3 == 0, "['a', 'b']").when(k % 3 == 1, " 1.0 ").alias("version"), F.date_format("ts", "MM/dd/yyyy").alias("discovery_date"), F.lit("2024-03-01").alias("day"), F.lit("x").alias("source"), *blank.values(),
    )
    return records.front_end(flat).select("packageName", "packageManager", "version", "discoveryDate", "timestamp", "source")


@plan("select event_type as package_manager, count(distinct user_id)::bigint as n from events group by 1")
def packages_per_manager(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("package_manager"), F.col("user_id").cast("string").alias("package_name"))
    return records.packages_per_manager(rows)


@plan(_PROFILE + ", q as (select user_id, string_agg(field, ',' order by field) as fields from p where n_distinct > 1 group by 1) select user_id, fields from q order by user_id limit 3")
def first_conflicts(spark, sf_dir):
    """The first three packages with a field that needs a vote."""
    return resolve.first_conflicts(_events_profile(spark, sf_dir), "user_id")


@plan("select c_custkey, lower(c_name) || ',' || lower(c_mktsegment) as names from customer")
def lowered_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(normalise.lowered(F.array("c_name", "c_mktsegment", F.lit(None).cast("string"))), ",").alias("names"))


_DOMAIN = "array_to_string(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '.')[-2:], '.')"
_IGN = " or ".join(f"starts_with(x, '{x}') or suffix(x, '{x}')" for x in urls.IGNORE_ENDS)


@plan(f"""with p as (select case when page_id % 2 = 0 then 'npm' else 'pypi' end as manager, page_id, url, {_DOMAIN} as own from pages),
more as (select manager, own, unnest([url, 'https://a.other' || (page_id % 5) || '.org/x', 'http://./x', 'no link']) as x from p where page_id % 7 > 0),
d as (select manager, own, x, case when x = url2 then own else coalesce(regexp_extract(x, '(other[0-9].org)', 1), '') end as domain from (select *, case when x not like 'https://a.other%' and x <> 'http://./x' and x <> 'no link' then x end as url2 from more)),
every as (select manager, own as domain from p union all select manager, domain from d where not ({_IGN}) and domain not in ('', '.') and domain <> own)
select manager, domain, count(*)::bigint as n from every group by all""")
def advisory_domains(spark, sf_dir):
    """Domains of first links and of those behind them, read from list texts of which some are no lists."""
    k = F.col("page_id")
    second = F.when(k % 7 == 0, "[oops").otherwise(F.concat(F.lit("['"), "url", F.lit("', 'https://a.other"), (k % 5).cast("string"), F.lit(".org/x', 'http://./x', 'no link']")))
    rows = table(spark, sf_dir, "pages").select(F.when(k % 2 == 0, "npm").otherwise("pypi").alias("manager"), "url", second.alias("second"))
    return stats.advisory_domains(rows, "manager", "url", "second")
