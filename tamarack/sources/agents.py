"""Models at work on long texts: entities over overlapping parts, and agents that vote, check and try again in bounded rounds."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.session import stored
from tamarack.sources.external import EntityClient, retried

Span = tuple[int, int, str]


def overlapping(text: str, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of at most `most` characters, of which each shares `overlap` with the one before it.

    A part ends behind a space where there is one in its last `overlap` characters."""
    if not 0 <= overlap < most:
        raise ValueError("parts must go on: the overlap has to be less than a part")
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text) and (space := text.rfind(" ", max(end - overlap, at + overlap + 1), end)) > 0:
            end = space + 1
        yield at, end
        if end == len(text):
            return
        at = max(at + 1, end - overlap)


def met(found: list[tuple[int, int, list[Span]]], length: int) -> list[Span]:
    """The entities of a whole text from (start, end, spans) of its parts, spans counted from the text's start.

    A span that ends at a part's edge inside the text may be cut there. If another part holds that place with more of the
    text around it, that part's answer stands and the cut span goes. An entity longer than the overlap is cut in every
    part: such spans of one kind that meet become one. Of spans that remain, those of one kind that overlap become one of
    their whole length; equal ones are one.
    """
    whole: set[Span] = set()
    cut: list[Span] = []
    for start, end, spans in found:
        for a, z, kind in spans:
            low, high = a == start and start > 0, z == end and end < length
            if not (low or high):
                whole.add((a, z, kind))
            elif not any(s < a + (not low) and z - (not high) < e and (s, e) != (start, end) and (not low or s < a) and (not high or e > z) for s, e, _ in found):
                cut.append((a, z, kind))
    out: list[Span] = []
    for a, z, kind in sorted(cut, key=lambda s: (s[2], s[0], s[1])):
        if out and out[-1][2] == kind and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]), kind)
        else:
            out.append((a, z, kind))
    for a, z, kind in sorted(whole, key=lambda s: (s[2], s[0], s[1])):
        out.append((a, z, kind))
    merged: list[Span] = []
    for a, z, kind in sorted(out, key=lambda s: (s[2], s[0], s[1])):
        if merged and merged[-1][2] == kind and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(z, merged[-1][1]), kind)
        else:
            merged.append((a, z, kind))
    return sorted(merged)


def entity_spans(docs: DataFrame, client: EntityClient, key: str, text: str = "text", most: int = 2000, overlap: int = 200, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, start, end, kind, entity, error): entities of whole texts that are shown in overlapping parts.

    An entity of up to `overlap` characters is whole in some part, so it is found as in the whole text. A part on which the
    client fails `attempts` times is a row with its place and the error, and the other parts' entities stay. Null and
    empty texts have no row; repeated rows are read each by itself.
    """
    schema = [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("entity", pa.string()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = []
                for start, end in overlapping(t or "", most, overlap):
                    failures: list[Exception] = []
                    spans = retried(lambda s=start, e=end, t=t: client.entities(t[s:e]), attempts, sleep=sleep, failures=failures)
                    if len(failures) == attempts:
                        rows.append((k, start, end, None, None, f"{type(failures[-1]).__name__}: {failures[-1]}"))
                    else:
                        found.append((start, end, [(start + a, start + z, kind) for a, z, kind in spans]))
                rows += [(k, a, z, kind, t[a:z], None) for a, z, kind in met(found, len(t or ""))]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(0).type), *(pa.array(c, kind) for c, (_, kind) in zip(columns[1:], schema))], [key, *(n for n, _ in schema)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, start long, end long, kind string, entity string, error string")


class Agent(Protocol):
    """A model in a role: worker, integrator (shown the workers' answers) or checker (answers OK, or why not)."""

    def ask(self, role: str, text: str, temperature: float) -> str: ...


def balanced(answer: str) -> bool:
    """Square brackets open before they close, there are some, and all are closed."""
    depth = 0
    for c in answer:
        depth += (c == "[") - (c == "]")
        if depth < 0:
            return False
    return depth == 0 and "[" in answer


def agreed(parts: DataFrame, client: Agent, key: str, text: str = "text", temperatures: tuple[float, ...] = (0.1, 0.4, 0.7), rounds: int = 3, sound: Callable[[str], bool] = balanced, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, round, answer, votes, state, error): one row for every part, by workers, an integrator and a checker.

    In a round every part that is still open is answered once at each temperature. An answer that more than half of the
    workers give (white space at its ends left off) wins by `votes`; without one the integrator is shown all of them. An
    answer that isn't `sound`, or that the checker doesn't call OK, leaves its part open. Each round's rows are a written
    table and only open parts go on, so later rounds get smaller, and a lost executor repeats no earlier round. After
    `rounds` open parts have the state `refused` with their last answer; a part whose calls fail `attempts` times in a row
    has the state `failed` with the error and isn't tried again. A null text is an empty one; keys may repeat or be null.
    """
    kind = parts.schema[key].dataType.simpleString()
    fields = f"_n long, `{key}` {kind}, text string, answer string, votes int, state string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def call(role: str, shown: str, temperature: float) -> str:
            failures: list[Exception] = []
            answer = retried(lambda: client.ask(role, shown, temperature), attempts, sleep=sleep, failures=failures)
            if len(failures) == attempts:
                raise failures[-1]
            return answer.strip()

        for b in batches:
            out = []
            for shown in b.column(2).to_pylist():
                try:
                    answers = [call("worker", shown, t) for t in temperatures]
                    best, votes = Counter(answers).most_common(1)[0]
                    if 2 * votes <= len(answers):
                        best, votes = call("integrator", "\n".join([shown, *answers]), 0.0), 0
                    good = sound(best) and call("checker", best, 0.0) == "OK"
                    out.append((best, votes, "done" if good else "open", None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, None, "failed", f"{type(e).__name__}: {e}"))
            columns = list(zip(*out)) if out else [()] * 4
            types = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, types))], ["_n", key, "text", "answer", "votes", "state", "error"])

    left = parts.select(F.monotonically_increasing_id().alias("_n"), key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    done = []
    for i in range(1, rounds + 1):
        got = stored(left.mapInArrow(run, fields), "round")
        last = i == rounds
        state = F.when(F.col("state") == "open", "refused").otherwise(F.col("state")) if last else F.col("state")
        closed = got if last else got.filter("state <> 'open'")
        done.append(closed.select(key, F.lit(i).alias("round"), "answer", "votes", state.alias("state"), "error"))
        left = got.filter("state = 'open'").select("_n", key, "text")
        if last or left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
