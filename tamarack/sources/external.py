"""Boundaries to the outside: fetching, models, search and scraping are interfaces with bounded retries.

An engine without a network can't run them; pipelines take any object with these methods, and tests take fakes. Failures
are rows, never exceptions that end a job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tamarack.functions.text import candidates

STEPS = ("extract", "relation", "verify")


class Fetcher(Protocol):
    def fetch(self, source: str, url: str) -> str: ...


class ModelClient(Protocol):
    def ask(self, model: str, prompt: str, text: str) -> str: ...


#: What turns a fetched page into text, by source; sources register here.
EXTRACTORS: dict[str, Callable[[str], str]] = {}


def extractor(source: str) -> Callable[[Callable[[str], str]], Callable[[str], str]]:
    def register(f: Callable[[str], str]) -> Callable[[str], str]:
        EXTRACTORS[source] = f
        return f

    return register


def retried(call: Callable[[], str], attempts: int = 5, wait: float = 10.0, more: float = 5.0, sleep: Callable[[float], None] = time.sleep, failures: list[Exception] | None = None) -> str:
    """The call's answer; after failures (which are added to `failures`) it waits longer each time, and gives '' in the end."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if failures is not None:
                failures.append(e)
            if i + 1 < attempts:
                sleep(wait + more * i)
    return ""


def fetch_pages(queue: DataFrame, fetcher: Fetcher, extractors: dict[str, Callable[[str], str]] | None = None, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(timestamp, source, link, text, error) of a link queue; unknown sources and failures have an error.

    A failed call is tried again, waiting longer each time; the error of the last try is kept.
    """
    table = dict(EXTRACTORS if extractors is None else extractors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text, error = None, None
                if r["source"] not in table:
                    error = "no extractor"
                else:
                    failures: list[Exception] = []
                    page = retried(lambda r=r: fetcher.fetch(r["source"], r["link"]), attempts, sleep=sleep, failures=failures)
                    try:
                        if len(failures) == attempts:
                            raise failures[-1]
                        text = table[r["source"]](page)
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                rows.append(r | {"text": text, "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in ("timestamp", "source", "link", "text", "error")]))

    return queue.select("timestamp", "source", "link").mapInArrow(run, "timestamp string, source string, link string, text string, error string")


class Search(Protocol):
    def results(self, phrase: str, start: int) -> list[dict]: ...


class Probe(Protocol):
    """A page's status and text, and the links on it; what can't be reached raises."""

    def get(self, url: str) -> tuple[int, str, list[str]]: ...


def searched(packages: DataFrame, client: Search, size: int = 10, pages: int = 10, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(manager, package, result_index, title, link, display_link, snippet, error) of searches for (manager, package).

    Pages of `size` results are asked for until one is short or empty, or there were `pages`; indexes count from 1 over
    all pages. A page that fails `attempts` times is a row with its first index and the error, and the next page follows.
    """
    names = ("title", "link", "display_link", "snippet")
    schema = pa.schema([("manager", pa.string()), ("package", pa.string()), ("result_index", pa.int32()), *((n, pa.string()) for n in names), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                for start in range(1, 1 + size * pages, size):
                    failures: list[Exception] = []
                    found = retried(lambda r=r, at=start: client.results(f'"{r["package"]}" "malicious" "{r["manager"]}"', at), attempts, 5.0, 0.0, sleep, failures)
                    if len(failures) == attempts:
                        out.append(r | {"result_index": start, "error": f"{type(failures[-1]).__name__}: {failures[-1]}"})
                        continue
                    out += [r | {"result_index": start + i} | {n: x.get(n) for n in names} for i, x in enumerate(found)]
                    if len(found) < size:
                        break
            yield pa.RecordBatch.from_pylist(out, schema)

    return packages.select("manager", "package").mapInArrow(run, "manager string, package string, result_index int, title string, link string, display_link string, snippet string, error string")


def mirrored(packages: DataFrame, client: Probe, mirrors: dict[str, str], listing: dict[str, str] | None = None) -> DataFrame:
    """(package, mirror, available, error): whether each mirror still has a package.

    `mirrors` maps a mirror to its page's address with {} for the package. A page counts with status 200 and without
    `404 not found` in its text. Mirrors in `listing` (to the base of their relative links) show a list of files, of which
    one has to be there. What can't be reached isn't available, and the error says why.
    """
    bases = dict(listing or {})

    def there(url: str) -> tuple[bool, list[str]]:
        status, text, links = client.get(url)
        return status == 200 and "404 not found" not in text.lower(), links

    def held(mirror: str, url: str) -> bool:
        if mirror not in bases:
            return there(url)[0]
        status, _, links = client.get(url)
        for link in links if status == 200 else ():
            try:
                if there(link if link.startswith("http:") else bases[mirror] + link.replace("../../", ""))[0]:
                    return True
            except Exception:  # noqa: BLE001, S112
                continue
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for package in b.column(0).to_pylist():
                for mirror, page in mirrors.items():
                    try:
                        out.append((package, mirror, held(mirror, page.replace("{}", package or "")), None))
                    except Exception as e:  # noqa: BLE001
                        out.append((package, mirror, False, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string()))], ["package", "mirror", "available", "error"])

    return packages.select("package").mapInArrow(run, "package string, mirror string, available boolean, error string")


def model_chain(docs: DataFrame, client: ModelClient, models: list[str], prompts: dict[tuple[str, str], str], stop: tuple[str, ...] = (), common: tuple[str, ...] = (), ranks: dict[bytes, int] | None = None, pattern: str = "", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(file, model, prompt, step, answer): the three steps in order for every model and prompt type.

    `prompts` maps (prompt type, step) to its template; each step sees the candidates and the answer before it.
    Texts are shown whole; with a byte-pair vocabulary (`ranks`, `pattern`) those over the ceiling as token_slices() has them.
    """
    kinds = sorted({k for k, _ in prompts})
    shown, docs = F.col("text"), docs.select("file", "text")
    if ranks is not None:
        shown, docs = F.col("first_part"), token_slices(docs, "text", ranks, pattern)
    rows = docs.select("file", shown.alias("shown"), F.array_join(F.array_sort(candidates(F.col("text"), common, stop)), ", ").alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                text = r["shown"] or ""
                for m in models:
                    for kind in kinds:
                        before = ""
                        for step in STEPS:
                            prompt = f"{prompts[kind, step]}\n{r['names']}\n{before}"
                            before = retried(lambda m=m, p=prompt, t=text: client.ask(m, p, t), sleep=sleep)
                            out.append({"file": r["file"], "model": m, "prompt": kind, "step": step, "answer": before})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.string()) for c in ("file", "model", "prompt", "step", "answer")]))

    return rows.mapInArrow(run, "file string, model string, prompt string, step string, answer string")


def token_budget(messages: DataFrame, by: str, tokens: str, per_message: int = 4, closing: int = 2) -> DataFrame:
    """Tokens of each conversation: its messages', a few for each message, and the closing ones."""
    return messages.groupBy(by).agg((F.sum(F.col(tokens) + per_message) + closing).cast("long").alias("n_tokens"))


def token_counts(docs: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, column: str = "tokens") -> DataFrame:
    """`docs` with the number of tokens of each text by a byte-pair vocabulary."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in b.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {column} long")


def token_slices(docs: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, ceiling: int = 110_000, slice_tokens: int = 30_000, column: str = "first_part") -> DataFrame:
    """`docs` with the text a model is shown: the first `slice_tokens` tokens of texts over the ceiling, others whole."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            out = []
            for t in b.column(names.index(text)).to_pylist():
                ids = [] if t is None else enc.encode_ordinary(t)
                out.append(enc.decode(ids[:slice_tokens]) if len(ids) > ceiling else t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {column} string")


class VectorClient(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LabelClient(Protocol):
    def label(self, texts: list[str]) -> list[list[str]]: ...


class EntityClient(Protocol):
    def entities(self, text: str) -> list[tuple[int, int, str]]: ...


def embeddings(docs: DataFrame, client: VectorClient, text: str = "text", attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """`docs` with `vector` and `vector_error`, asked for in batches; a null text has neither, a failure the error alone."""
    return _answered(docs, text, client.embed, "vector", "array<double>", pa.list_(pa.float64()), attempts, sleep)


def labelled(docs: DataFrame, client: LabelClient, text: str = "text", attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """`docs` with `labels`, several a text (tactics, behaviours), and `labels_error`, asked for in batches."""
    return _answered(docs, text, client.label, "labels", "array<string>", pa.list_(pa.string()), attempts, sleep)


def answers_of(ask: Callable[[list[str]], list], texts: list[str], attempts: int, sleep: Callable[[float], None]) -> tuple[list, list[str | None]]:
    """(answers, errors) of texts asked for together; if that fails `attempts` times each is asked for by itself, and what
    fails again has no answer and the error."""
    failures: list[Exception] = []
    whole = retried(lambda: ask(texts), attempts, sleep=sleep, failures=failures) if texts else []
    if len(failures) < attempts:
        return list(whole), [None] * len(texts)
    out, errors = [], []
    for t in texts:
        alone: list[Exception] = []
        got = retried(lambda t=t: ask([t]), attempts, sleep=sleep, failures=alone)
        bad = len(alone) == attempts
        out.append(None if bad else got[0])
        errors.append(f"{type(alone[-1]).__name__}: {alone[-1]}" if bad else None)
    return out, errors


def _answered(docs: DataFrame, text: str, ask: Callable, column: str, kind: str, arrow: pa.DataType, attempts: int, sleep: Callable[[float], None]) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text)).to_pylist()
            asked = [i for i, t in enumerate(texts) if t is not None]
            held, wrong = [None] * len(texts), [None] * len(texts)
            for i, answer, error in zip(asked, *answers_of(ask, [texts[i] for i in asked], attempts, sleep)):
                held[i], wrong[i] = answer, error
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held, arrow), pa.array(wrong, pa.string())], [*names, column, f"{column}_error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, {column} {kind}, {column}_error string")


def windows_of(text: str, most: int) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text in parts of at most `most` characters that end at white space where there is some."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text) and (space := text.rfind(" ", at + 1, end)) > 0:
            end = space + 1
        yield at, text[at:end]
        at = end


def entities(docs: DataFrame, client: EntityClient, key: str, text: str = "text", most: int = 2000) -> DataFrame:
    """(key, start, end, kind, entity): entities of texts shown to a model in parts, with places in the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for at, part in windows_of(t or "", most):
                    out += [(k, at + a, at + z, kind, part[a:z]) for a, z, kind in client.entities(part)]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(0).type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int64(), pa.string(), pa.string())))], [key, "start", "end", "kind", "entity"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, end long, kind string, entity string")


def scrolled(load: Callable[[], list[dict]], most: int, refresh: Callable[[], None] = lambda: None, last: int = 15, empty: int = 5, refreshes: int = 2) -> list[dict]:
    """Rows of an endless page, one an id, until there are `most`: each pass looks at the `last` cards it has loaded.

    After `empty` passes without a new row the page is refreshed, and after `refreshes` in vain the loop ends.
    """
    held: dict[object, dict] = {}
    idle = renewed = 0
    while len(held) < most and renewed <= refreshes:
        new = [r for r in load()[-last:] if r["id"] not in held]
        for r in new:
            held.setdefault(r["id"], r)
        idle = 0 if new else idle + 1
        if new:
            renewed = 0
        elif idle >= empty:
            idle, renewed = 0, renewed + 1
            refresh()
    return list(held.values())[:most]


class ListedSource(DataSource):
    """A data source over a Python lister: spark.read.format("listed") with an option per listing page.

    Register a subclass that gives `pages` and `rows` for a collector; each page is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "listed"

    def schema(self) -> str:
        return "source string, date string, link string"

    def pages(self) -> list[str]:
        return [p for p in self.options.get("pages", "").split(",") if p]

    def rows(self, page: str) -> Iterator[tuple[str, str, str]]:
        yield self.options.get("source", ""), self.options.get("date", ""), page

    def reader(self, schema: object) -> DataSourceReader:
        owner = self

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [InputPartition(p) for p in owner.pages()]

            def read(self, partition: InputPartition) -> Iterator[tuple]:
                yield from owner.rows(partition.value)

        return Reader()
