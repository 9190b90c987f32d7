"""Incremental work as Structured Streaming: queues, duplicates, high-water marks, windows and folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamarack import schema


def link_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a link folder; the checkpoint keeps which were read, so each link comes once."""
    return spark.readStream.schema(schema.LINKS).option("sep", "\t").option("maxFilesPerTrigger", files_per_trigger).csv(folder)


def parquet_stream(spark: SparkSession, path: str, columns: str | object) -> DataFrame:
    return spark.readStream.schema(columns).parquet(path)


def unseen(stream: DataFrame, *keys: str, event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """First occurrences by key. With an event time the state is dropped after the delay; without one it holds every key."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Run `work` on each batch and append its rows, once for all input there is.

    A batch writes to its own folder, which a repeated batch overwrites, so a crash leaves no row twice.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(rows: DataFrame, ts: str, size: str, *keys: str, value: str = "value") -> DataFrame:
    return sliding(rows, ts, size, size, *keys, value=value)


def sliding(rows: DataFrame, ts: str, size: str, step: str, *keys: str, value: str = "value") -> DataFrame:
    """(window_start, *keys, n, total): works on tables and streams alike."""
    out = rows.groupBy(F.window(ts, size, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """(key, session_start, session_end, n): the end is the last event's time plus the gap."""
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def above_mark(rows: DataFrame, marks: DataFrame, key: str, order: str) -> DataFrame:
    """Rows later than their key's high-water mark; all rows of keys without one."""
    return rows.join(marks.select(key, F.col("mark").alias("_m")), key, "left").filter(F.col("_m").isNull() | (F.col(order) > F.col("_m"))).drop("_m")


def new_marks(rows: DataFrame, marks: DataFrame, key: str, order: str) -> DataFrame:
    seen = rows.select(key, F.col(order).alias("mark")).unionByName(marks.select(key, "mark"))
    return seen.groupBy(key).agg(F.max("mark").alias("mark"))


def high_water(stream: DataFrame, key: str, order: str) -> DataFrame:
    """(key, mark, n_new): per batch and key, the new mark and how many rows were beyond the old one. Rows are long-valued."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else None
        top, new = mark, 0
        for f in frames:
            fresh = f[order] if mark is None else f.loc[f[order] > mark, order]
            new += len(fresh)
            if len(fresh):
                top = int(fresh.max()) if top is None else max(top, int(fresh.max()))
        if top is not None:
            state.update((top,))
        yield pd.DataFrame({key: [k[0]], "mark": [top], "n_new": [new]})

    return stream.select(key, F.col(order).cast("long").alias(order)).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, mark long, n_new long", "mark long", "append", GroupStateTimeout.NoTimeout)


def fold(rows: DataFrame, key: str, order: str, text: str, most: int = 600) -> DataFrame:
    """(key, part, memory): what is remembered before each part of an article, the tail of all parts so far.

    The parts of an article are its own and few; they are folded in order inside the row, so nothing grows with the table.
    """
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_p"))

    def step(s: Column, x: Column) -> Column:
        tail = F.element_at(s, -1)["tail"]
        grown = F.concat_ws(" ", F.nullif(tail, F.lit("")), x["t"])
        return F.array_append(s, F.struct(x["o"].alias("o"), tail.alias("memory"), F.right(grown, F.lit(most)).alias("tail")))

    kind = dict(rows.dtypes)[order]
    start = F.expr(f"array(struct(cast(null as {kind}) as o, cast('' as string) as memory, cast('' as string) as tail))")
    out = parts.select(key, F.explode(F.slice(F.aggregate("_p", start, step), 2, 1_000_000_000)).alias("s"))
    return out.select(key, F.col("s.o").alias("part"), F.col("s.memory").alias("memory"))


class Memory(StatefulProcessor):
    """What an article's parts leave behind, in order of their numbers, whatever order they arrive in.

    A value state has the number of the next part and the tail of all parts before it; a list state holds parts that came
    too early. Both live for `ttl` milliseconds after their last change, or for ever.
    """

    def __init__(self, key: str, key_kind: str, first: int, most: int, ttl: int | None) -> None:
        self.key, self.key_kind, self.first, self.most, self.ttl = key, key_kind, first, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "next long, tail string", self.ttl)
        self.early = handle.getListState("early", "part long, text string", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        at, tail = self.tail.get() if self.tail.exists() else (self.first, "")
        held = {int(p): t for p, t in self.early.get()} if self.early.exists() else {}
        had = len(held)
        for frame in rows:
            for part, text in zip(frame["part"], frame["text"]):
                if part >= at:
                    held.setdefault(int(part), text)
        out = []
        while at in held:
            out.append((key[0], at, tail))
            text = held.pop(at)
            tail = " ".join(x for x in (tail, text) if x)[-self.most :]
            at += 1
        if out:
            self.tail.update((at, tail))
        if held:
            self.early.put([(p, held[p]) for p in sorted(held)])
        elif had:
            self.early.clear()
        yield pd.DataFrame(out, columns=[self.key, "part", "memory"])

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, key: str, order: str, text: str, most: int = 600, first: int = 0, ttl: int | None = None) -> DataFrame:
    """`fold` over a stream: (key, part, memory), a row for each part as soon as all parts before it have come.

    Parts are numbered from `first` without gaps; a part that comes again changes nothing, and rows without key or number
    are left out. State is one tail of `most` characters a key and the parts that wait, never a whole article; with `ttl`
    (milliseconds) it goes when nothing changes for so long; such a query goes by the clock, so it runs until it is
    stopped, also with availableNow. Needs the RocksDB state store (see `state_store`).
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key), F.col(order).cast("long").alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.groupBy(key).transformWithStateInPandas(Memory(key, kind, first, most, ttl), f"`{key}` {kind}, part long, memory string", "append", "processingTime" if ttl else "none")


class Marks(StatefulProcessor):
    """A value state with the highest order seen of a key: what lies above it is new."""

    def __init__(self, key: str, ttl: int | None) -> None:
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "mark long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        orders = [int(v) for frame in rows for v in frame["order"] if mark is None or v > mark]
        if orders:
            self.mark.update((max(orders),))
        yield pd.DataFrame({self.key: [key[0]] * len(orders), "order": sorted(orders)})

    def close(self) -> None:
        pass


def above_mark_stream(stream: DataFrame, key: str, order: str, ttl: int | None = None) -> DataFrame:
    """(key, order) of rows beyond their key's mark, which is the highest order of all batches before (G3 as a stream)."""
    kind = dict(stream.dtypes)[key]
    rows = stream.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, F.col(order).cast("long").alias("order"))
    return rows.groupBy(key).transformWithStateInPandas(Marks(key, ttl), f"`{key}` {kind}, order long", "append", "processingTime" if ttl else "none")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that transformWithState needs, set for the queries started inside. A batch keeps its changes alone."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    was = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
