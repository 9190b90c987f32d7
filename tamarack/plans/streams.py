"""Event time windows, and streams that must agree with their batch form."""

from pyspark.sql import functions as F

from tamarack.plans.registry import plan
from tamarack.session import scratch, table
from tamarack.sources import committed, feeds
from tamarack.streaming import incremental as inc


def _day(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@plan("select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by all")
def tumbling_1d(spark, sf_dir):
    out = inc.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", "event_type")
    return out.select(_day("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@plan("with w as (select time_bucket(interval 6 hours, ts) - k * interval 6 hours as s, value from events, range(0, 4) r(k)) select strftime(s, '%Y-%m-%d %H:%M:%S') as window_start, count(*)::bigint as n, round(sum(value), 4) as total from w group by 1")
def sliding_1d_6h(spark, sf_dir):
    out = inc.sliding(table(spark, sf_dir, "events"), "ts", "1 day", "6 hours")
    return out.select(_day("window_start").alias("window_start"), "n", F.round("total", 4).alias("total"))


@plan("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts) + interval 6 hours, '%Y-%m-%d %H:%M:%S') as session_end, count(*)::bigint as n from s group by user_id, k""")
def session_6h(spark, sf_dir):
    out = inc.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "user_id")
    return out.select("user_id", _day("session_start").alias("session_start"), _day("session_end").alias("session_end"), "n")


@plan("select event_id from events where event_id > (select max(event_id) filter (where event_id % 7 = 0 and event_id < 500) from events)")
def high_water_mark(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.lit("all").alias("k"))
    marks = e.filter("event_id % 7 = 0 and event_id < 500").groupBy("k").agg(F.max("event_id").alias("mark"))
    return inc.above_mark(e, marks, "k", "event_id").select("event_id")


@plan("select user_id, event_type from events group by all")
def stream_dedupe(spark, sf_dir):
    """A stream over the whole table, run to its end into a written table; equal to the batch distinct."""
    columns = table(spark, sf_dir, "events").schema
    path = scratch(spark, "stream")
    stream = spark.readStream.schema(columns).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*")
    q = inc.unseen(stream.select("user_id", "event_type"), "user_id", "event_type").writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


_FOLD = """with recursive f as (select conv_id, turn as part, ''::varchar as memory, text from conversations where turn = 0
union all select c.conv_id, c.turn, right(concat_ws(' ', nullif(f.memory, ''), nullif(f.text, '')), 600), c.text from f join conversations c on c.conv_id = f.conv_id and c.turn = f.part + 1)"""


@plan(f"{_FOLD} select conv_id, part, length(memory)::int as n_chars from f")
def article_memory(spark, sf_dir):
    """What is remembered before each turn of a conversation: the last 600 characters of the turns so far."""
    c = table(spark, sf_dir, "conversations")
    return inc.fold(c, "conv_id", "turn", "text").select("conv_id", "part", F.length("memory").alias("n_chars"))


def _advisories(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.col("user_id") % 2 == 0, "npm").otherwise("pypi").alias("manager"), F.col("event_id").alias("number"), F.col("user_id").cast("string").alias("package"), F.col("event_type").alias("type"))


@plan("select case when user_id % 2 = 0 then 'npm' else 'pypi' end as manager, event_id as number, user_id::varchar as package from events where event_type = 'error'")
def advisory_stream(spark, sf_dir):
    """A feed read as a stream that is stopped half-way: the second run starts at the marks that the first one reached.

    Half of the feed is published and read into a committed table; then all of it, and the query goes on from its checkpoint.
    """
    top, out = scratch(spark, "feed"), scratch(spark, "advisories")
    rows = _advisories(spark, sf_dir)
    middle = rows.agg(F.percentile_approx("number", 0.5)).first()[0] or 0
    spark.dataSource.register(feeds.FeedSource)
    committed.register(spark)
    for version, part in enumerate((rows.filter(F.col("number") <= middle), rows)):
        feeds.publish(part, top, version)
        stream = spark.readStream.format("feed").option("uri", top).option("marks", f"{top}/marks.json").load()
        wanted = stream.filter("type = 'error'").select("manager", "number", "package")
        q = wanted.writeStream.format("committed").option("path", out).option("checkpointLocation", f"{out}-progress").outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return spark.read.format("committed").option("path", out).schema("manager string, number long, package string").load()


def _run(spark, stream, path):
    with inc.state_store(spark):
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()


@plan(f"{_FOLD} select conv_id, part, md5(memory) as digest from f")
def article_memory_stream(spark, sf_dir):
    """The memory before each turn, over a stream in which later turns come first: state holds what came too early."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    path = scratch(spark, "turns")
    for part in (F.col("turn") % 3 == 2, F.col("turn") % 3 == 1, F.col("turn") % 3 == 0):
        c.filter(part).write.mode("append").parquet(path)
    files = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 8).parquet(path)
    _run(spark, inc.fold_stream(files, "conv_id", "turn", "text"), f"{path}-out")
    return spark.read.parquet(f"{path}-out").select("conv_id", "part", F.md5("memory").alias("digest"))


@plan("select user_id, event_id from events")
def high_water_stream(spark, sf_dir):
    """Marks as state: the table is read as a stream, grown by half, and read on; old rows come again and aren't new."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    path = scratch(spark, "marks")
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    for part in (e.filter(F.col("event_id") <= middle), e):
        part.write.mode("append").parquet(f"{path}-in")
        stream = spark.readStream.schema(e.schema).parquet(f"{path}-in")
        _run(spark, inc.above_mark_stream(stream, "user_id", "event_id"), path)
    return spark.read.parquet(path).select("user_id", F.col("order").alias("event_id"))
