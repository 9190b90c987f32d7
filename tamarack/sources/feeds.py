"""Feeds of advisories, newest first and in pages, as a streaming source whose offset is the high-water mark."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tamarack.sources import store

ENTRY = "manager string, number long, package string, type string"
FIELDS = ("manager", "number", "package", "type")


class Feed(Protocol):
    """A paged list per manager. Pages count from 1 and are newest first; new entries push older ones to later pages."""

    def managers(self) -> list[str]: ...

    def pages(self, manager: str) -> int: ...

    def page(self, manager: str, number: int) -> list[dict]: ...


class StoredFeed:
    """A feed whose pages are folders of JSON lines: v=<version>/manager=<name>/page=<number>, the last whole version."""

    def __init__(self, uri: str) -> None:
        versions = [v for v in store.names(uri) if v.startswith("v=") and store.exists(f"{uri}/{v}/_SUCCESS")]
        self.top = f"{uri}/{max(versions, key=lambda v: int(v[2:]))}" if versions else None

    def managers(self) -> list[str]:
        return [n.split("=", 1)[1] for n in store.names(self.top) if n.startswith("manager=")] if self.top else []

    def pages(self, manager: str) -> int:
        return max((int(n.split("=")[1]) for n in store.names(f"{self.top}/manager={manager}") if n.startswith("page=")), default=0)

    def page(self, manager: str, number: int) -> list[dict]:
        at = f"{self.top}/manager={manager}/page={number}"
        lines = [line for n in store.names(at) if n.endswith(".json") for line in store.read(f"{at}/{n}").splitlines()]
        return sorted((json.loads(x) for x in lines), key=lambda e: -e["number"])


def publish(entries: DataFrame, uri: str, version: int, size: int = 1000) -> None:
    """Write (manager, number, package, type) as a version of a stored feed; a page has `size` consecutive numbers.

    Rows without manager or number aren't part of a feed. No page of a manager without entries in it is written.
    """
    rows = entries.filter("manager is not null and number is not null").select(*FIELDS)
    tops = rows.groupBy("manager").agg(F.max("number").alias("_top"))
    paged = rows.join(tops, "manager").withColumn("page", F.expr(f"(_top - number) div {size} + 1")).drop("_top")
    paged.repartition("manager", "page").sortWithinPartitions("manager", "page").write.partitionBy("manager", "page").json(f"{uri}/v={version}")


def newest(feed: Feed, manager: str) -> int | None:
    """The number at the head of the list; pages may be empty."""
    for p in range(1, feed.pages(manager) + 1):
        if entries := feed.page(manager, p):
            return entries[0]["number"]
    return None


def between(feed: Feed, manager: str, low: int, high: int) -> Iterator[dict]:
    """Entries with numbers over `low` up to `high`, newest first, each once.

    The first page is found by bisection; reading goes on until the mark `low` is reached. Entries that arrive meanwhile
    move older ones to later pages only, so some may come twice (they are told by number) and none is lost.
    """
    first, last = 1, max(1, feed.pages(manager))
    while first < last:  # the last page whose head is at least `high`
        mid = (first + last + 1) // 2
        head = next((e[0]["number"] for p in range(mid, last + 1) if (e := feed.page(manager, p))), None)
        first, last = (mid, last) if head is not None and head >= high else (first, mid - 1)
    seen: set[tuple] = set()
    p = first
    while p <= feed.pages(manager):
        for e in feed.page(manager, p):
            if e["number"] <= low:
                return
            if e["number"] <= high and (e["number"], e.get("package"), e.get("type")) not in seen:
                seen.add((e["number"], e.get("package"), e.get("type")))
                yield e
        p += 1


class Span(InputPartition):
    """Numbers over `low` up to `high` of one manager."""

    def __init__(self, manager: str, low: int, high: int) -> None:
        super().__init__((manager, low, high))


def spans(start: dict, end: dict, size: int, most: int = 64) -> list[Span]:
    """The numbers from the marks `start` to the marks `end`, cut into at most `most` spans a manager of `size` or more."""
    out = []
    for manager in sorted(end):
        low, high = start.get(manager, -1), end[manager]
        step = max(size, -(-(high - low) // most))
        out += [Span(manager, a, min(a + step, high)) for a in range(low, high, step)]
    return out


class FeedSource(DataSource):
    """spark.read or readStream.format("feed"): entries of all managers of a feed.

    Options: `uri` of the feed, `marks` (a file that keeps the marks of committed batches, so that a query without a
    checkpoint goes on where the last one stopped), `span` (numbers a partition). Subclasses give another `client`.

    The stream's offset is the newest number of every manager: a batch reads what lies above the marks that the last one
    reached, and a manager that appears later starts from its beginning. Entries whose number is negative are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return ENTRY

    def client(self) -> Feed:
        return StoredFeed(self.options["uri"])

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(self)


class _Reading:
    def __init__(self, source: FeedSource) -> None:
        self.source = source

    def marks(self) -> dict:
        feed = self.source.client()
        return {m: top for m in feed.managers() if (top := newest(feed, m)) is not None}

    def planned(self, start: dict, end: dict) -> list[Span]:
        return spans(start, end, int(self.source.options.get("span", 10_000)))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows = list(between(self.source.client(), *partition.value))
        own = [partition.value[0]] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([r["number"] for r in rows], pa.int64()), *(pa.array([r.get(c) for r in rows], pa.string()) for c in FIELDS[2:])], list(FIELDS))


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.planned({}, self.marks()) or [Span("", -1, -1)]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        at = self.source.options.get("marks")
        return json.loads(store.read(at)) if at and store.exists(at) else {}

    def latestOffset(self) -> dict:
        return self.marks()

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.planned(start, end)

    def commit(self, end: dict) -> None:
        if at := self.source.options.get("marks"):
            store.write(at, json.dumps(end).encode())
