"""Semi-structured records and dates in text are built from the driver's tables."""

from pyspark.sql import functions as F

from tamarack.functions import nested as n
from tamarack.functions import normalise, text
from tamarack.plans.registry import plan
from tamarack.session import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "props")


@plan("select event_id, json_extract_string(props, '$.k')::bigint as k, json_extract_string(props, '$.absent') as absent from events")
def json_paths(spark, sf_dir):
    v = F.try_parse_json("props")
    return _events(spark, sf_dir).select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.absent", "string").alias("absent"))


_JSON = """case event_id % 6 when 0 then concat('[{"Package Name": "a', event_id % 7, '", "Package Manager": ["PyPI", "npm"], "Version": "1"}]') when 1 then concat('{"packages": [{"package_name": ["x", "y', event_id % 5, '"], "Version": ["2", "3"]}]}')
  when 2 then '[]' when 3 then concat('```json', chr(10), '[{"PackageName": "f", "package_manager": "pip"}]', chr(10), '```') when 4 then '[{"Package Name": "cut' else concat('Here it is: [{"Package Name": "s', event_id % 3, '"}] as asked') end"""
_JSON_SQL = f"select event_id, {_JSON} as t from events"


def _records(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.expr(_JSON.replace("chr(10)", "'\\n'")).alias("t"))


@plan("select event_id, case event_id % 6 when 2 then 'empty' when 4 then 'bad' else 'good' end as state from events")
def bad_json_quarantine(spark, sf_dir):
    return n.triage(_records(spark, sf_dir), "t").select("event_id", "state")


@plan("""select event_id, name as package_name, manager as package_manager from (
select event_id, 'a' || (event_id % 7)::varchar as name, unnest(['pypi', 'npm']) as manager from events where event_id % 6 = 0
union all select event_id, unnest(['x', 'y' || (event_id % 5)::varchar]), 'other' from events where event_id % 6 = 1
union all select event_id, 'f', 'pypi' from events where event_id % 6 = 3
union all select event_id, 's' || (event_id % 3)::varchar, 'other' from events where event_id % 6 = 5)""")
def split_records(spark, sf_dir):
    good = n.triage(_records(spark, sf_dir), "t").filter("state = 'good'").select("event_id", "doc")
    return n.split_records(good, normalise.NAME_KEYS, normalise.MANAGER_KEYS).select("event_id", "package_name", "package_manager")


@plan("select event_id, case when event_id % 6 = 0 then '1' when event_id % 6 = 1 then '2, 3' else '' end as versions, case when event_id % 6 = 0 then '1' when event_id % 6 = 1 then '2' end as first_version from events where event_id % 6 in (0, 1, 3, 5)")
def scalar_or_list(spark, sf_dir):
    good = n.triage(_records(spark, sf_dir), "t").filter("state = 'good'").select("event_id", F.explode(n.items(F.col("doc"))).alias("r"))
    versions = n.first_present(F.col("r"), normalise.VERSION_KEYS)
    return good.select("event_id", n.comma_text(versions).alias("versions"), F.get(versions, F.lit(0)).alias("first_version"))


@plan("select event_id, case event_id % 6 when 2 then 0 when 4 then null else 1 end::int as n_items from events")
def unwrap_keys(spark, sf_dir):
    doc = n.parsed(F.col("t"))
    return _records(spark, sf_dir).select("event_id", F.when(doc.isNotNull(), F.size(n.items(doc))).alias("n_items"))


@plan("select event_id, event_id % 6 in (2) as empty from events")
def empty_records(spark, sf_dir):
    """The recursive test runs over Arrow batches."""
    return _records(spark, sf_dir).select("event_id", n.empty_record(text.without_fence(F.col("t"))).alias("empty"))


@plan("""select event_id, case event_id % 3 when 0 then 'a, b' when 1 then '[1' else 'plain' end as cleaned, case event_id % 3 when 0 then 2 end::int as n_parts from events""")
def list_literals(spark, sf_dir):
    t = F.expr("case event_id % 3 when 0 then \"['a', 'b']\" when 1 then '[1' else ' plain ' end")
    e = _events(spark, sf_dir).select("event_id", t.alias("t"))
    return e.select("event_id", normalise.list_text(F.col("t")).alias("cleaned"), F.when(normalise.literal_list(F.col("t")).isNotNull(), F.size(normalise.literal_list(F.col("t")))).alias("n_parts"))


@plan("select event_id, 2::int as n_values from events")
def key_at_any_depth(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.lit('{"a": [{"source_link": "u"}, {"b": {"source_link": "v"}}]}').alias("t"))
    return e.select("event_id", F.size(n.values_of_key("t", F.lit("source_link"))).alias("n_values"))
