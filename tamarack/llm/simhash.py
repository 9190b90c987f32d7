"""SimHash near-duplicates: multi-index hashing over the segments of 64-bit fingerprints."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tamarack.llm.common import materialize, text_or_empty, tidied
from tamarack.llm.components import components


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text: bit b is set if over half of the shingles' hashes have it. No word: zero.

    A-Z are lower-cased; words are runs without the six ASCII white-space characters; with fewer words than `width` the
    whole sequence is the only shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        h = np.array([xxh64_intdigest(line, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
        h = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 14):  # blocks bound the unpacked bits
        ones += np.unpackbits(h[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, th, fp): a hash and the fingerprint of each whole text, as signed longs."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("th"), text_or_empty(text).alias("body"))
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, th long, fp long")


def best_parts(n: int, distance: int = 4) -> int:
    """The number of segments that makes least work for n distinct fingerprints.

    Per segment a fingerprint probes its ball and meets about n / 2**width others at each probe: longer segments take more
    probes (529 of 32 bits within distance two) and meet fewer (a 2,048th of those of 21 bits). Segments stay few enough
    that some ball is enumerated: short segments without balls are cheap only while tables are small.
    """
    def work(parts: int) -> float:
        return sum((1 + n / 2.0**w) * sum(comb(w, k) for k in range(distance // parts + 1)) for _, w in segments(parts))

    return min(range(2, max(3, distance)), key=work)


def segments(parts: int = 3) -> list[tuple[int, int]]:
    """(offset, width) of the segments; widths differ by one bit at most."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _mask(width: int) -> int:
    return (1 << width) - 1


def _segment(fp: str, at: tuple[int, int]) -> str:
    return f"(shiftrightunsigned({fp}, {at[0]}) & {_mask(at[1])}L)"


def near_pairs(prints: DataFrame, distance: int = 4, parts: int = 3, apart: str | None = None) -> DataFrame:
    """(a, b), a < b: distinct fingerprints that differ in `distance` bits at most, each pair once, for any number of segments.

    With `distance` bits over `parts` segments some segment differs in at most r = distance // parts bits. The table
    holds each fingerprint under its value in every segment; the probe enumerates the ball of radius r around each of
    its own values. A fetched pair is verified by its whole distance, and counts only in the first segment that is
    within r, so no distinct is needed. `apart`: a column of `prints`; pairs that have it in common are left out.
    """
    r = distance // parts
    cuts = segments(parts)
    extra = [F.col(apart).alias("_ap")] if apart else []
    tag = lambda i: f"{i << 40}L"
    stored = prints.select(F.col("fp").alias("b"), *[x.alias("_bp") for x in extra], F.explode(F.expr("array(" + ", ".join(f"{_segment('fp', at)} | {tag(i)}" for i, at in enumerate(cuts)) + ")")).alias("key"))
    balls = []
    for i, at in enumerate(cuts):
        masks = [sum(1 << k for k in c) for d in range(r + 1) for c in combinations(range(at[1]), d)]
        balls.append(f"transform(array({', '.join(f'{m}L' for m in masks)}), m -> ({_segment('fp', at)} ^ m) | {tag(i)})")
    probes = prints.select(F.col("fp").alias("a"), *extra, F.explode(F.expr(f"concat({', '.join(balls)})")).alias("key"))
    close = [f"bit_count({_segment('(a ^ b)', at)}) <= {r}" for at in cuts]
    first = " or ".join("(" + " and ".join([f"p.key >> 40 = {i}", *(f"not {c}" for c in close[:i])]) + ")" for i in range(parts))
    on = f"p.key = s.key and a < b and bit_count(a ^ b) <= {distance} and ({first})" + (" and _ap <> _bp" if apart else "")
    return probes.alias("p").join(stored.alias("s"), F.expr(on)).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4, width: int = 4, parts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, th (a hash of the text), fp (long), component_id (the smallest doc_id reachable over
    links, itself included).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id are nodes of their
    own; null doc_ids never become a component_id unless a component has no other. An empty table gives an empty
    result. Copies share a fingerprint and are linked through it, so only distinct fingerprints meet in joins.

    Dense groups of near copies don't emit all their pairs: fingerprints at distance one are linked first (64 probes
    each, hence at most 32 links a fingerprint), and the multi-index join then emits pairs between different
    components of that first pass only. No link that matters for a component is lost. The number of segments follows
    the number of distinct fingerprints unless `parts` is given; the links are the same for any.
    """
    prints = materialize(fingerprints(docs, doc_id, text, width), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    flips = ", ".join(f"fp ^ {1 << k if k < 63 else -(1 << 63)}L" if k < 63 else "fp ^ shiftleft(1L, 63)" for k in range(64))
    hops = distinct.select(F.col("fp").alias("a"), F.explode(F.expr(f"array({flips})")).alias("b")).filter("a < b")
    ones = hops.join(distinct.select(F.col("fp").alias("b")), "b").select("a", "b")
    first = components(ones)
    held = distinct.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("part"))
    held = materialize(held, "parts")
    pairs = near_pairs(held, distance, parts or best_parts(held.count(), distance), apart="part")
    part = held.select(F.col("fp"), F.col("part"))
    # links between parts: each pair's ends are replaced by their parts
    links = pairs.join(part.select(F.col("fp").alias("a"), F.col("part").alias("pa")), "a").join(part.select(F.col("fp").alias("b"), F.col("part").alias("pb")), "b")
    joined = components(links.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    whole = held.join(joined.withColumnRenamed("node", "part"), "part", "left").select("fp", "least", F.coalesce("label", "part").alias("whole"))
    whole = materialize(whole, "whole")
    least = materialize(whole.groupBy("whole").agg(F.min("least").alias("component_id")), "least")
    classes = materialize(whole.join(least, "whole").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "th", "fp", "component_id")


def hex_digits(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 4) -> DataFrame:
    """The rows whose doc_id is the smallest of their group, all columns unchanged, whatever their names.

    A row goes by its doc_id and text together: one that shares its doc_id with a near copy but not the text is judged
    by its own group. Rows that repeat both are one document and share its fate; rows with a null doc_id are kept.
    """
    gone = near_duplicates(docs, doc_id, text, distance).filter("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_text")).distinct()
    gone = materialize(gone, "gone")
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names that can't clash
    key, body = (own.columns[docs.columns.index(c)] for c in (doc_id, text))
    left = own.join(gone, (own[key] == gone["gone_id"]) & (F.xxhash64(text_or_empty(body)) == gone["gone_text"]), "left_anti")
    return left.toDF(*docs.columns)
