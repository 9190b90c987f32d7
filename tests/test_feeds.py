"""Feeds with marks, committed tables under killed tasks and repeated batches, and state against the batch folds."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tamarack.sources import committed, feeds, store
from tamarack.streaming import incremental as inc


class Listed:
    """A feed in memory that grows while it is read: a new entry comes after every page."""

    def __init__(self, numbers, size=4, grow=0):
        self.numbers, self.size, self.grow, self.calls = sorted(numbers), size, grow, 0

    def managers(self):
        return ["npm"]

    def pages(self, manager):
        return -(-len(self.numbers) // self.size)

    def page(self, manager, number):
        self.calls += 1
        down = self.numbers[::-1][(number - 1) * self.size : number * self.size]
        if self.grow:
            self.grow -= 1
            self.numbers.append(self.numbers[-1] + 1)
        return [{"number": n, "package": f"p{n}", "type": "t"} for n in down]


@pytest.mark.parametrize("low,high", [(-1, 99), (10, 60), (99, 99), (40, 41), (-1, 0), (97, 99)])
@pytest.mark.parametrize("grow", [0, 30])
def test_entries_between_marks(low, high, grow):
    feed = Listed([n for n in range(100) if n % 7], grow=grow)
    assert [e["number"] for e in feeds.between(feed, "npm", low, high)] == [n for n in range(high, low, -1) if n % 7 and n >= 0]


def test_bisection_skips_pages():
    feed = Listed(range(4000))
    assert [e["number"] for e in feeds.between(feed, "npm", 100, 104)] == [104, 103, 102, 101] and feed.calls < 40


def test_spans_cover_the_numbers_once():
    got = [s.value for s in feeds.spans({"a": 9, "c": 5}, {"a": 30, "b": 1, "c": 5}, 10)]
    assert got == [("a", 9, 19), ("a", 19, 29), ("a", 29, 30), ("b", -1, 1)]
    assert len(feeds.spans({}, {"a": 10**9}, 10)) <= 64


def test_a_stored_feed_as_batch_and_its_marks(spark, tmp_path):
    top = str(tmp_path)
    rows = [("npm", i, f"p{i}", "x" if i % 5 else None) for i in range(0, 90, 2)] + [("pypi", 7, "q", "x"), (None, 1, "n", "x"), ("npm", None, "n", "x")]
    df = spark.createDataFrame(rows, feeds.ENTRY)
    feeds.publish(df.filter("number < 40 or number is null"), top, 0, size=10)
    feeds.publish(df, top, 1, size=10)
    spark.dataSource.register(feeds.FeedSource)
    got = spark.read.format("feed").option("uri", top).option("span", 25).load().collect()
    assert sorted(map(tuple, got), key=str) == sorted((r for r in rows if r[0] and r[1] is not None), key=str)
    assert spark.read.format("feed").option("uri", f"{top}/none").load().count() == 0
    # a query without a checkpoint starts at the stored marks
    store.write(f"{top}/marks.json", b'{"npm": 80, "pypi": 7}')
    stream = spark.readStream.format("feed").option("uri", top).option("marks", f"{top}/marks.json").load()
    q = stream.writeStream.format("memory").queryName("after_marks").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["number"] for r in spark.table("after_marks").collect()) == [82, 84, 86, 88]


def test_appends_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.register(spark)
    df = spark.range(100).repartition(4).withColumn("name", F.when(F.col("id") % 3 == 0, F.concat(F.lit("n"), "id")))
    for _ in range(2):
        df.write.format("committed").mode("append").option("path", path).save()
    back = spark.read.format("committed").option("path", path).load()
    assert back.count() == 200 and back.filter("name is null").count() == 132 and back.schema.simpleString() == df.schema.simpleString()
    # a batch that is committed again is dropped, an aborted one leaves nothing
    w = committed._Stream(path, "s", "id long, name string")
    batch = df.limit(5).toArrow().to_batches()
    for _ in range(2):
        w.commit([w.write(iter(batch)), None, w.write(iter([]))], 7)
    w.abort([w.write(iter(batch))], 8)
    assert spark.read.format("committed").option("path", path).load().count() == 205
    assert committed.orphans(path) == []
    w.write(iter(batch))  # a task that was killed after writing
    assert spark.read.format("committed").option("path", path).load().count() == 205
    assert committed.vacuum(path) == 1 and committed.orphans(path) == []
    with pytest.raises(Exception, match="committed"):
        spark.read.format("committed").option("path", f"{path}/none").load()
    assert spark.read.format("committed").option("path", f"{path}/none").schema("id long").load().count() == 0


KILLED = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.taskcontext import TaskContext
from tamarack.session import build_session
from tamarack.sources import committed
spark = build_session("killed", "local[2,3]", 3)

class Killed(committed.CommittedTable):
    @classmethod
    def name(cls):
        return "killed"
    def streamWriter(self, schema, overwrite):
        class Dying(committed._Stream):
            def write(self, iterator):
                done = super().write(iterator)
                if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
                    os._exit(9)  # the worker dies with its file written
                return done
        return Dying(self.options["path"], "s", committed.ddl(schema))

spark.dataSource.register(Killed)
committed.register(spark)
spark.range(300).repartition(3).write.parquet({path!r} + "/in")
s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet({path!r} + "/in").repartition(3)
q = s.writeStream.format("killed").option("path", {path!r} + "/out").option("checkpointLocation", {path!r} + "/ck").trigger(availableNow=True).start()
q.awaitTermination()
got = spark.read.format("committed").option("path", {path!r} + "/out").load()
print("ROWS", got.count(), got.distinct().count(), len(committed.orphans({path!r} + "/out")) > 0)
"""


def test_killed_tasks_leave_no_row_twice(tmp_path):
    code = KILLED.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), path=str(tmp_path))
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert "ROWS 300 300 True" in run.stdout, run.stderr[-2000:]


def test_early_parts_wait_in_state(spark, tmp_path):
    """Parts in any order over several batches, repeated parts, nulls: as the fold of the whole article."""
    batches = [[("a", 2, "cc"), ("b", 0, "x"), (None, 0, "n")], [("a", 0, "aaaa"), ("b", 0, "again"), ("b", None, "y")], [("a", 1, "bb"), ("b", 2, "z")], [("a", 3, None), ("a", 1, "late")]]
    path = str(tmp_path)
    for rows in batches:
        spark.createDataFrame(rows, "k string, o long, t string").coalesce(1).write.mode("append").parquet(f"{path}/in")
    s = spark.readStream.schema("k string, o long, t string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with inc.state_store(spark):
        for _ in range(2):  # the second run finds nothing new
            inc.fold_stream(s, "k", "o", "t", most=6).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{path}/out").collect()))
    whole = spark.createDataFrame([("a", 0, "aaaa"), ("a", 1, "bb"), ("a", 2, "cc"), ("a", 3, None), ("b", 0, "x")], "k string, o long, t string")
    assert got == sorted(map(tuple, inc.fold(whole, "k", "o", "t", 6).collect()))  # b waits for part 1


def test_files_are_written_by_executors(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "x"), ("c.txt", None), (None, "y")], "name string, body string")
    assert store.write_files(df, str(tmp_path)) == 2
    assert store.read(f"file:{tmp_path}/a/b.txt") == b"x" and store.read(f"{tmp_path}/c.txt") == b"" and store.names(str(tmp_path / "none")) == []
