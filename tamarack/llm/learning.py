"""From labelled rows to bags of hashed features on the driver, and from a model to scores on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialize, tidied, utf8
from tamarack.llm.subword import Features, Model


#: The most bytes of bags that are brought to the driver.
SAMPLE_BYTES = 256 << 20


def sample_bags(docs: DataFrame, target: str, limit: int, features: Features, doc_id: str = "doc_id", text: str = "text", most_bytes: int = SAMPLE_BYTES) -> tuple[list, list]:
    """Bags and targets of at most `limit` ids, chosen by a hash of the id (ties: by the id), one row of each, so the same
    rows come at any partitioning; of rows that repeat an id, the one with the least hash of its text.

    `docs` has doc_id, text and `target`. Only ids are ranked; the chosen rows' whole texts are hashed on the executors,
    and their bags are a written table, of which the driver takes the first `most_bytes` in order of the ids' hashes.
    """
    rank = F.xxhash64(F.lit("sample"), F.col("_pick"))
    chosen = docs.select(F.col(doc_id).alias("_pick")).distinct().orderBy(rank, "_pick").limit(limit)
    rows = docs.select(F.col(doc_id).alias("_pick"), F.col(target).cast("string").alias("_target"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_body"))
    rows = rows.join(F.broadcast(chosen), "_pick", "left_semi")  # at most `limit` ids
    one = rows.groupBy("_pick").agg(F.min_by(F.struct("_target", "_body"), F.struct(F.xxhash64("_body"), "_target")).alias("r"))

    def bag(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            found = list(features.bags(data, offsets))
            columns = (pa.array(x, pa.binary()) for x in ([r.tobytes() for r, _ in found], [s.tobytes() for _, s in found]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([8 * len(r) for r, _ in found], pa.int64()), *columns], ["rank", "id", "target", "size", "rows", "share"])

    picked = one.select(rank.alias("rank"), F.col("_pick").cast("string").alias("id"), F.col("r._target").alias("target"), F.col("r._body").alias("body"))
    bags = materialize(picked.mapInArrow(tidied(bag), "rank long, id string, target string, size long, rows binary, share binary"), "bags")
    sizes = bags.select("rank", "id", "size").toArrow().to_pylist()  # at most `limit` short rows
    order, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["rank"], r["id"] or "")):
        total += r["size"]
        if order and total > most_bytes:
            break
        order.append(r["id"])
    known = set(order)
    got = {r["id"]: r for r in bags.filter(F.col("rank") <= max((r["rank"] for r in sizes if r["id"] in known), default=0)).toArrow().to_pylist()}
    order = sorted((i for i in order if i in got), key=lambda i: (i or "", got[i]["target"]))
    return [(np.frombuffer(got[i]["rows"], np.int32), np.frombuffer(got[i]["share"], np.float32)) for i in order], [got[i]["target"] for i in order]


def score_texts(docs: DataFrame, keep: list[F.Column], model: Model, text: str = "text") -> DataFrame:
    """`keep` and prob, array<double> in the order of the model's classes, of every whole text (null: the empty text)."""
    body = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_body"))
    names = body.columns[:-1]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(len(names)))
            p = model.probabilities(data, offsets)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), values], [*names, "prob"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema[:-1])
    return body.mapInArrow(tidied(run), f"{fields}, prob array<double>")
