"""Votes, merges, conflicts and duplicates."""

from pyspark.sql import functions as F

from tamarack.operators import dedupe, resolve
from tamarack.plans.registry import plan
from tamarack.session import table


@plan("""
with per as (select user_id, event_type, count(*) as n, max(ts) as d, min(event_id) as f from events where event_type is not null and user_id is not null group by all)
select user_id, arg_max(event_type, (n, d, -f)) as winner, max(n)::bigint as votes, count(*)::bigint as n_values from per group by user_id""")
def vote_event_type(spark, sf_dir):
    return resolve.vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", "event_id")


@plan("""
with per as (select source, lang, count(*) as n, max(doc_id) as d, min(doc_id) as f from documents where lang is not null and source <> '' group by all)
select source, arg_max(lang, (n, d, -f)) as winner, max(n)::bigint as votes, count(*)::bigint as n_values from per group by source""")
def vote_doc_lang_by_source(spark, sf_dir):
    return resolve.vote(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id", "doc_id")


@plan("""
with r as (select o_custkey, o_orderkey, list_sort([o_orderpriority, o_orderstatus]) as v from orders),
per as (select o_custkey, array_to_string(v, ',') as k, count(*) as n, max(o_orderkey) as d, min(o_orderkey) as f from r group by all)
select o_custkey, arg_max(k, (n, d, -f)) as winner, max(n)::bigint as votes from per group by o_custkey""")
def vote_list_values(spark, sf_dir):
    """A list and its permutations are one vote."""
    rows = table(spark, sf_dir, "orders").withColumn("vals", F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array("o_orderpriority", "o_orderstatus")))
    out = resolve.vote(rows, ["o_custkey"], "vals", "o_orderkey", "o_orderkey", F.array_join(F.array_sort("vals"), ","))
    return out.select("o_custkey", F.array_join(F.array_sort("winner"), ",").alias("winner"), "votes")


@plan("select user_id, arg_max(props, (ts, -event_id)) as props from events group by user_id")
def merge_latest_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(resolve.latest_value("props", "ts", "event_id").alias("props"))


@plan("select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as types from events group by user_id")
def merge_union_types(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(resolve.union_values("event_type"), ",").alias("types"))


@plan("""
with ev as (select *, (event_id % 24)::int as h, case when event_id % 5 = 0 then null else [event_type, 'p' || (event_id % 3)::varchar] end as tags from events),
vt as (select user_id, event_type as v, count(*) as n, max(ts) as d, min(event_id) as f from ev group by all),
vh as (select user_id, h as v, count(*) as n, max(ts) as d, min(event_id) as f from ev group by all),
a as (select user_id, arg_max(v, (n, d, -f)) as event_type from vt group by 1), b as (select user_id, arg_max(v, (n, d, -f)) as h from vh group by 1),
lt as (select user_id, tags from ev qualify row_number() over (partition by user_id order by strftime(ts, '%Y-%m-%d %H:%M:%S.%f') desc, event_id) = 1),
m as (select user_id, count(*)::bigint as n_records, array_to_string(list_sort(list(distinct source)), ',') as sources from (select *, 's' || (event_id % 4)::varchar as source from ev) group by 1)
select m.user_id, n_records, a.event_type, b.h, array_to_string(lt.tags, ',') as tags, m.sources from m join a using (user_id) join b using (user_id) join lt using (user_id)""")
def resolve_records(spark, sf_dir):
    """The whole resolution of a record: two voted fields, one merged list (latest record, null stays), one union."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), (F.col("event_id") % 24).cast("int").alias("h"))
    rows = rows.withColumn("tags", F.when(F.col("event_id") % 5 != 0, F.array("event_type", F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string"))))).withColumn("source", F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")))
    out = resolve.resolve(rows, ["user_id"], ["event_type", "h"], ["tags"], ["source"], "ts", "event_id")
    return out.select("user_id", "n_records", "event_type", "h", F.array_join("tags", ",").alias("tags"), F.array_join("source", ",").alias("sources"))


_PROFILE = """
m as (unpivot (select user_id, event_type::varchar as event_type, props::varchar as props, (event_id % 3)::varchar as third, null::varchar as nothing from events) on event_type, props, third, nothing into name field value value),
a as (select user_id, 'event_type' as field, trim(event_type) as value from events union all select user_id, 'props', trim(props) from events union all select user_id, 'third', (event_id % 3)::varchar from events union all select user_id, 'nothing', null from events),
p as (select user_id, field, count(*)::bigint as n_sources, count(distinct nullif(value, ''))::bigint as n_distinct from a group by all having count(*) > 1)"""
_PROFILE = "with " + _PROFILE[_PROFILE.index("a as (") :]


def _events_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "props", (F.col("event_id") % 3).alias("third"), F.lit(None).cast("string").alias("nothing"))
    return resolve.conflict_profile(rows, "user_id", ["event_type", "props", "third", "nothing"])


@plan(_PROFILE + " select user_id, field, n_sources, n_distinct, n_distinct > 1 as needs_vote from p")
def conflict_profile(spark, sf_dir):
    return _events_profile(spark, sf_dir)


@plan(_PROFILE + ", s as (select field, (count(*) filter (where n_distinct > 1))::bigint as voting, (count(*) filter (where n_distinct <= 1))::bigint as direct from p group by 1) select field, voting, direct, round(voting * 100.0 / 34313, 4)::double as voting_pct, round(direct * 100.0 / 34313, 4)::double as direct_pct from s")
def conflict_summary(spark, sf_dir):
    return resolve.conflict_summary(_events_profile(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in ("voting_pct", "direct_pct")})


@plan(_PROFILE + r""", s as (select field, (count(*) filter (where n_distinct > 1))::bigint as v, (count(*) filter (where n_distinct <= 1))::bigint as d from p group by 1)
select '\begin{tabular}{lrrrr}' || chr(10) || string_agg(format('{} & {} & {:.2f}\% & {} & {:.2f}\% \\', replace(field, '_', '\_'), v, round(v * 100.0 / 34313, 4)::double, d, round(d * 100.0 / 34313, 4)::double), chr(10) order by field) || chr(10) || '\end{tabular}' as latex from s""")
def conflict_latex(spark, sf_dir):
    return resolve.latex_table(conflict_summary(spark, sf_dir))


@plan("""
with v as (select 'o_orderpriority' as field, o_orderpriority as v from orders union all select 'o_orderstatus', o_orderstatus from orders),
p as (select field, v, count(*) as n from v where v is not null and v not in ('', 'null') group by all)
select field, sum(n)::bigint as total, count(*)::bigint as "distinct", array_to_string(list_sort(list(v))[1:5], ',') as samples from p group by field""")
def field_stats(spark, sf_dir):
    return resolve.field_stats(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@plan("select doc_id, md5(text) as digest from documents qualify row_number() over (partition by md5(text) order by doc_id) = 1")
def dedupe_md5(spark, sf_dir):
    return dedupe.by_md5(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", F.col("doc_id")).select("doc_id", F.md5("text").alias("digest"))


@plan("select doc_id from documents qualify row_number() over (partition by md5(text), strlen(text) order by doc_id) = 1")
def dedupe_md5_size(spark, sf_dir):
    return dedupe.by_md5_and_size(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", F.col("doc_id")).select("doc_id")


@plan("select doc_id, strlen(text)::int as size from documents qualify row_number() over (partition by strlen(text) order by doc_id) = 1")
def dedupe_size(spark, sf_dir):
    return dedupe.by_size(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", F.col("doc_id")).select("doc_id", F.octet_length("text").alias("size"))


@plan("select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1")
def keep_last(spark, sf_dir):
    return dedupe.survivors(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), [F.col("o_custkey")], F.col("o_orderkey"), "last")


@plan("select user_id, event_type, count(*)::bigint as n from events group by all having count(*) >= 2")
def repeated_keys(spark, sf_dir):
    return dedupe.repeated(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@plan("""
with u as (select 0 as rank, o_custkey, o_orderkey, o_totalprice from orders where o_orderkey % 2 = 0 union all select 1, o_custkey, o_orderkey, o_totalprice from orders where o_orderkey % 3 = 0)
select o_custkey, o_orderkey, o_totalprice from u qualify row_number() over (partition by o_custkey order by rank desc, o_orderkey desc) = 1""")
def latest_override_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedupe.override([o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0")], "o_custkey", "o_orderkey")
