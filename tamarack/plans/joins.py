"""Joins and set operations against other tables."""

from pyspark.sql import functions as F

from tamarack.functions import normalise
from tamarack.functions.vectors import cosine
from tamarack.operators import compare, dedupe, graph, similar
from tamarack.plans.registry import plan
from tamarack.session import table


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return docs, table(spark, sf_dir, "labels")


@plan("select doc_id, doc_id in (select doc_id from labels) as found, case when doc_id in (select doc_id from labels) then 'TRUE' else 'FALSE' end as flag from documents")
def mark_join_labels(spark, sf_dir):
    docs, labels = _labelled(spark, sf_dir)
    out = compare.mark(docs.select("doc_id"), labels, ["doc_id"])
    return out.withColumn("flag", compare.flag_text(F.col("found")))


@plan("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def anti_pending(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return compare.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@plan("select user_id from events group by user_id having count(distinct event_type) >= (select count(distinct event_type) from events)")
def complete_all_models(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return compare.complete(e, "user_id", "event_type", e)


@plan("select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_in_list(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@plan("select string_agg('name = ''' || n_name || '''', ' OR ' order by n_name) as query from nation")
def name_query_string(spark, sf_dir):
    clause = F.concat(F.lit("name = '"), F.col("n_name"), F.lit("'"))
    return table(spark, sf_dir, "nation").agg(F.array_join(F.array_sort(F.collect_list(clause)), " OR ").alias("query"))


@plan("""select event_id, n as name, m as manager from (select event_id, unnest(['a' || (event_id % 10)::varchar, 'b']) as n, event_type from events), unnest([event_type, 'npm']) as t(m)""")
def cross_explode(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.array(F.concat(F.lit("a"), (F.col("event_id") % 10).cast("string")), F.lit("b")).alias("names"))
    return e.select("event_id", "event_type", F.explode("names").alias("name")).select("event_id", "name", F.explode(F.array("event_type", F.lit("npm"))).alias("manager"))


@plan("select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size = 10) or l_suppkey in (select p_partkey from part where p_size = 10)")
def or_join_union(spark, sf_dir):
    keys = table(spark, sf_dir, "part").filter("p_size = 10").select("p_partkey")
    return compare.either_in(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", keys, "p_partkey").select("l_orderkey", "l_linenumber")


@plan("""with a as (select distinct lang, source from documents where doc_id % 2 = 0), b as (select distinct lang, source from documents where doc_id % 3 = 0),
c as (select (select count(*) from (select * from a intersect select * from b)) as common, (select count(*) from (select * from a except select * from b)) as only_a, (select count(*) from (select * from b except select * from a)) as only_b)
select common::bigint as common, only_a::bigint as only_a, only_b::bigint as only_b, common / (common + only_a) as share_a, common / (common + only_b) as share_b from c""")
def set_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return compare.overlap(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0"), ["lang", "source"])


_PRF = """with t as (select distinct {by} doc_id from labels join documents using (doc_id) where quality = 1), g as (select distinct {by} doc_id from documents join labels using (doc_id) where n_chars >= 500),
c as (select {by} count(*) filter (where t.doc_id is not null and g.doc_id is not null)::bigint as tp, count(*) filter (where t.doc_id is null)::bigint as fp, count(*) filter (where g.doc_id is null)::bigint as fn from t full join g using ({by} doc_id) {group}),
s as (select *, coalesce(tp / nullif(tp + fp, 0), 0)::double as precision, coalesce(tp / nullif(tp + fn, 0), 0)::double as recall from c)
select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::double as f1 from s"""


@plan(_PRF.format(by="", group=""))
def prf1_labels(spark, sf_dir):
    docs, labels = _labelled(spark, sf_dir)
    both = docs.join(labels, "doc_id")
    return compare.prf1(both.filter("quality = 1"), both.filter("n_chars >= 500"), "doc_id")


@plan(_PRF.format(by="lang,", group="group by lang"))
def prf1_by_state(spark, sf_dir):
    docs, labels = _labelled(spark, sf_dir)
    both = docs.join(labels, "doc_id")
    return compare.prf1(both.filter("quality = 1"), both.filter("n_chars >= 500"), "doc_id", ["lang"])


@plan("""with t as (select least(count(*), 675)::bigint as tp from labels join documents using (doc_id) where quality = 1 and n_chars >= 500), f as (select count(*)::bigint as fp from labels join documents using (doc_id) where quality <> 1 and n_chars >= 500),
c as (select tp, fp, greatest(675 - tp, 0)::bigint as fn from t, f), s as (select *, coalesce(tp / nullif(tp + fp, 0), 0)::double as precision, coalesce(tp / nullif(tp + fn, 0), 0)::double as recall from c)
select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::double as f1 from s""")
def prf1_fixed_total(spark, sf_dir):
    docs, labels = _labelled(spark, sf_dir)
    both = docs.join(labels, "doc_id")
    return compare.prf1(both.filter("quality = 1"), both.filter("n_chars >= 500"), "doc_id", total=675)


@plan("select c_custkey, coalesce(n, 0)::bigint as n_orders, coalesce(last, 'None') as last_date from customer left join (select o_custkey, count(*) as n, max(strftime(o_orderdate, '%Y-%m-%d')) as last from orders group by 1) on o_custkey = c_custkey")
def enrich_defaults(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("last_date"))
    return compare.enrich(table(spark, sf_dir, "customer").select("c_custkey"), facts, ["c_custkey"], {"n_orders": 0, "last_date": "None"})


@plan("select s_suppkey, case when s_suppkey % 2 = 0 and n_name is not null then n_name else 'None' end as label from supplier left join nation on n_nationkey = s_nationkey")
def conditional_update(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.lit("None").alias("label"))
    facts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return compare.update_where(s, facts, ["s_nationkey"], "label", "n_name", F.col("s_suppkey") % 2 == 0).select("s_suppkey", "label")


@plan("select event_id, user_id, null::varchar as lang from events union all select doc_id, null, lang from documents")
def union_missing_columns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id").unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "lang"), allowMissingColumns=True)


_UNIT = "list_transform(embedding, lambda x: x::double)"


@plan(f"""with e as (select vec_id, {_UNIT} as v from embeddings), s as (select q.vec_id as query, t.vec_id as match, round(list_cosine_similarity(q.v, t.v), 6) as similarity from e q join e t on q.vec_id <> t.vec_id),
r as (select *, row_number() over (partition by query order by similarity desc, match)::int as rank from s) select * from r where rank <= 5""")
def cosine_top5(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return graph.neighbours(e, e, "vec_id", "embedding")


@plan()
def cosine_top5_lsh(spark, sf_dir):
    """The same queries (every vector) through buckets of signed random projections; recall against cosine_top5 is measured in the tests."""
    e = table(spark, sf_dir, "embeddings")
    return similar.close_neighbours(e, e, "vec_id", "embedding")


@plan(f"with e as (select label, {_UNIT} as v, vec_id from embeddings) select a.vec_id, round(list_cosine_similarity(a.v, b.v), 5) as similarity from e a join e b on b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 5).alias("similarity"))


@plan("select label, vec_id, rank from (select label, vec_id, row_number() over (partition by label order by md5(vec_id::varchar), vec_id)::int as rank from embeddings) where rank <= 5")
def capped_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    return graph.capped(e, "label", F.struct(F.md5(F.col("vec_id").cast("string")), "vec_id"))


@plan("select user_id, event_type, arg_max(props, event_id) as props, max(event_id) as event_id from events group by all")
def edges_last_write(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "props", "event_id")
    return graph.edges(e, "user_id", "event_type", "event_id")


@plan("""with b as (select 'u' || user_id::varchar as name, 'user' as kind, event_id as q, 0 as e from events union all select event_type, 'type' || (event_id % 3)::varchar, event_id, 1 from events)
select name, arg_max(kind, (q, e)) as kind from b group by name""")
def vertices(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sub"), "event_type", F.lit("user").alias("sk"), F.concat(F.lit("type"), (F.col("event_id") % 3).cast("string")).alias("ok"), "event_id")
    return graph.vertices(e, "sub", "event_type", "sk", "ok", "event_id")


@plan("""select event_id, sub, obj, case when sub like '%cve%' then 'cve' when sub = 'click' then 'action' end as sub_kind, case when obj = 'u1' then 'user' end as obj_kind
from (select event_id, case when event_id % 4 = 0 then 'cve-1' else event_type end as sub, 'u' || (user_id % 3)::varchar as obj from events)""")
def typed_triples(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "cve-1").otherwise(F.col("event_type")).alias("sub"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("obj"))
    kinds = spark.createDataFrame([("click", "action"), ("u1", "user")], "name string, kind string")
    return graph.typed(e, kinds).select("event_id", "sub", "obj", "sub_kind", "obj_kind")


_KEYED = "select event_id, case when event_id % 2 = 0 then 'npm' else 'pypi' end as manager, 'pkg' || (user_id % 40) as name from events"


def _named(spark, sf_dir):
    manager = F.when(F.col("event_id") % 2 == 0, "npm").otherwise("pypi")
    return table(spark, sf_dir, "events").select("event_id", manager.alias("manager"), F.concat(F.lit("pkg"), (F.col("user_id") % 40).cast("string")).alias("name"))


@plan(f"with e as ({_KEYED}) select event_id, manager = 'npm' and event_id % 2 = 0 and exists(select 1 from part where p_size % 2 = 0 and name = 'pkg' || p_size) as found from e")
def mark_by_name(spark, sf_dir):
    """(manager, trimmed lower-case name) against a feed that writes names its own way."""
    feed = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.lit("npm").alias("manager"), F.concat(F.lit("  PKG"), F.col("p_size").cast("string"), F.lit(" ")).alias("name"))
    return compare.mark_by_name(_named(spark, sf_dir), feed).select("event_id", "found")


@plan(f"with e as ({_KEYED}) select event_id, manager = 'pypi' and exists(select 1 from part where name = 'pkg' || p_size) as found from e")
def mark_remapped(spark, sf_dir):
    """A feed that calls pypi pip."""
    feed = table(spark, sf_dir, "part").select(F.lit("pip").alias("manager"), F.concat(F.lit("pkg"), F.col("p_size").cast("string")).alias("name"))
    return compare.mark_by_name(_named(spark, sf_dir), feed, {"pip": "pypi"}).select("event_id", "found")


@plan("select n_nationkey, r_name as name from nation join region on r_regionkey = n_regionkey where lower(r_name) in (lower(n_name), 'asia')")
def mentioned_packages(spark, sf_dir):
    """Names among the entities of their own file: lists exploded and met by equality."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.upper("n_name"), F.lit(" Asia ")).alias("found"), "n_regionkey")
    packages = n.join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_nationkey", F.col("r_name").alias("name"))
    return compare.mentioned(packages, n.select("n_nationkey", "found"), "name", "n_nationkey", "found")


@plan("select doc_id, doc_id not in (select doc_id from labels) as missing, case when doc_id in (select doc_id from labels) then 1 else 0 end as n_found from documents")
def tool_outputs_by_file(spark, sf_dir):
    tools = table(spark, sf_dir, "labels").select("doc_id", F.array(F.col("quality").cast("string")).alias("found"))
    return compare.by_file(table(spark, sf_dir, "documents").select("doc_id"), tools, "doc_id").select("doc_id", "missing", F.size("found").alias("n_found"))


@plan("select page_id from pages where url not in (select url from pages where page_id % 3 = 0)")
def pages_not_listed(spark, sf_dir):
    """Pages whose link another list has are skipped."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return compare.pending(p, p.filter("page_id % 3 = 0"), ["url"]).select("page_id")


@plan("select event_id, name from (select event_id, case event_id % 5 when 0 then 'pip' when 1 then 'cctx' else 'pkg' || user_id end as name, event_type from events) where name not in ('pip', 'cctx') and event_type = 'click'")
def literal_names_and_type(spark, sf_dir):
    k = F.col("event_id") % 5
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(k == 0, "pip").when(k == 1, "cctx").otherwise(F.concat(F.lit("pkg"), F.col("user_id").cast("string"))).alias("name"))
    return normalise.of_type(normalise.without_names(e, "name"), "event_type", "click").select("event_id", "name")


@plan("select user_id, max(event_id) as event_id from events group by 1 order by 2 desc limit 40")
def newest_by_id(spark, sf_dir):
    """A feed of at most 40 rows, one an id, the newest first (the limit is the feature)."""
    return dedupe.newest(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", F.col("event_id"), 40)


@plan("select min(event_id) as event_id, ts from events group by ts")
def dedupe_time(spark, sf_dir):
    return dedupe.by_time(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.col("event_id"))
