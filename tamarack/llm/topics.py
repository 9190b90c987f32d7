"""Topics of documents without a topic column: clusters of hashed words, learnt on all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import discard, materialize, text_or_empty, tidied, uniform, utf8, written
from tamarack.llm.subword import Features, Model

FEATURES = Features(bits=13, ngrams=(), words=True)
NO_TOPIC = "(none)"


#: Unit vectors are summed as whole numbers of this scale, so sums don't depend on the order of documents.
SCALE = 1 << 24
#: Cells (a document's distinct hashed words) of a run: documents are kept and worked on in runs of about so many.
CELLS = 1 << 16
#: Moves of centres (of length 1) up to this let a round's documents be narrowed.
CALM = 0.1
PACKED = "keys binary, sizes binary, rows binary"


def bags(docs: DataFrame, features: Features, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(keys, sizes, rows, share), stored: runs of documents that have a word, with their hashed words one document behind the
    other; a key is a hash of a document's id and text."""
    kind = np.uint16 if features.bits <= 16 else np.int32

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            keys, first = batch.column(0).to_numpy(zero_copy_only=False), 0
            for sizes, rows, share in features.packed(data, offsets):
                own = keys[first : first + len(sizes)][sizes > 0]
                first += len(sizes)
                cuts = np.r_[0, np.cumsum(sizes[sizes > 0])]
                yield from _rows_of(own, cuts, rows.astype(kind), share, "share")

    rows = docs.select(F.xxhash64(F.lit("topic"), F.col(doc_id), text_or_empty(text)).alias("key"), text_or_empty(text).alias("body"))
    return materialize(rows.mapInArrow(tidied(run), f"{PACKED}, share binary"), "bags")


def _rows_of(keys: np.ndarray, cuts: np.ndarray, rows: np.ndarray, values: np.ndarray, name: str):
    """A row for each run of about CELLS cells; a longer document is a run of its own."""
    first = 0
    while first < len(keys):
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + CELLS, side="right")) - 1)
        i, j = cuts[first], cuts[last]
        parts = (keys[first:last], np.diff(cuts[first : last + 1]).astype(np.int32), rows[i:j], values[i:j])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["keys", "sizes", "rows", name])
        first = last


def units(batches):
    """(keys, cuts, rows, values) of every run: documents between `cuts`, with their shares or whole numbers."""
    for batch in batches:
        kind = np.int32 if batch.schema.names[3] == "x" else np.float32
        for i in range(batch.num_rows):
            keys, sizes, rows, values = (batch.column(c)[i].as_buffer() for c in range(4))
            cuts = np.r_[0, np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64)]
            yield np.frombuffer(keys, np.int64), cuts, np.frombuffer(rows, np.uint16 if rows.size == 2 * cuts[-1] else np.int32).astype(np.intp), np.frombuffer(values, kind)


def scaled(held: DataFrame, idf: np.ndarray) -> DataFrame:
    """(keys, sizes, rows, x), stored: every document as whole numbers of SCALE that make a vector of unit length."""
    kind = np.uint16 if len(idf) <= 1 << 16 else np.int32

    def run(batches):
        for keys, cuts, rows, share in units(batches):
            v = share.astype(np.float64) * idf[rows]
            norm = np.sqrt(np.add.reduceat(v * v, cuts[:-1]))
            x = np.rint(v / np.repeat(np.maximum(norm, 1e-12), np.diff(cuts)) * SCALE).astype(np.int32)
            yield from _rows_of(keys, cuts, rows.astype(kind), x, "x")

    return materialize(held.mapInArrow(tidied(run), f"{PACKED}, x binary"), "units")


def products(cuts: np.ndarray, rows: np.ndarray, values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(centres, documents), for centres of (centres, rows): a centre at a time, so that its look-ups stay in the cache."""
    share = values.astype(np.float32) * np.float32(1 / SCALE)
    out, one = np.empty((len(centres), len(cuts) - 1), np.float32), np.empty(len(rows), np.float32)
    for k, centre in enumerate(centres):
        np.take(centre, rows, out=one, mode="clip")
        np.multiply(one, share, out=one)
        np.add.reduceat(one, cuts[:-1], out=out[k])
    return out


def summed(held: DataFrame, centres: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (classes, size) over all documents of their vectors, by nearest centre, and documents a class. Without centres
    there is one class, without idf every row of a document counts one. Tasks send sums, at most classes x size numbers."""
    k = 1 if centres is None else centres.shape[1]
    tables = None if centres is None else np.ascontiguousarray(centres.T, np.float32)

    def run(batches):
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, cuts, rows, values in units(batches):
            near = np.zeros(len(cuts) - 1, np.int64) if tables is None else np.argmax(products(cuts, rows, values, tables), axis=0)
            n += np.bincount(near, minlength=k)
            weight = values if values.dtype == np.int32 else None  # sums of a run are under 2**53: exact
            total += np.bincount(np.repeat(near * size, np.diff(cuts)) + rows, weight, k * size).reshape(k, size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array([t.tobytes() for t in total], pa.binary())], ["c", "n", "s"])

    def add(batches):
        """Tasks' sums of the classes of a partition, added up as they come."""
        held_sums: dict[int, list] = {}
        for batch in batches:
            for c, n, t in zip(*(x.to_pylist() for x in batch.columns)):
                was = held_sums.get(c, [0, 0])
                held_sums[c] = [was[0] + n, was[1] + np.frombuffer(t, np.int64)]
        for c, (n, t) in held_sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([n], pa.int64()), pa.array([t.tobytes()], pa.binary())], ["c", "n", "s"])

    kind = "c int, n long, s binary"
    total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
    for r in held.mapInArrow(tidied(run), kind).repartition(k, "c").mapInArrow(tidied(add), kind).collect():  # a row a class
        n[r["c"]], total[r["c"]] = r["n"], np.frombuffer(r["s"], np.int64)
    return total, n


def narrowed(held: DataFrame, centres: np.ndarray, room: np.ndarray) -> DataFrame:
    """The documents of `held`, stored, whose nearest centre may be another one once each centre has moved from `centres` by no
    more than its `room`: a unit vector's product changes by no more than that. All others keep theirs."""
    tables = np.ascontiguousarray(centres.T, np.float32)
    slack = len(centres) * 2.0**-21  # over the rounding of four sums of so many numbers of 24 bits

    def run(batches):
        for keys, cuts, rows, values in units(batches):
            near = products(cuts, rows, values, tables).astype(np.float64)
            own, at = np.argmax(near, axis=0), np.arange(len(keys))
            least = near[own, at] - room[own]
            most = near + room[:, None]
            most[own, at] = -np.inf
            loose = most.max(axis=0) >= least - slack
            cells = np.repeat(loose, np.diff(cuts))
            kind = np.uint16 if len(centres) <= 1 << 16 else np.int32
            yield from _rows_of(keys[loose], np.r_[0, np.cumsum(np.diff(cuts)[loose])], rows[cells].astype(kind), values[cells], "x")

    return materialize(held.mapInArrow(tidied(run), f"{PACKED}, x binary"), "loose")


def picked(held: DataFrame, centres: np.ndarray, size: int, seed: int | None) -> np.ndarray | None:
    """The vector of one document of all: the one nearest to the centre without a seed, else drawn with chances in proportion
    to the square of its gap to the nearest centre (the least of -log(u) / gap is such a draw). None where no gap is left.
    Each task sends its best."""
    tables = np.ascontiguousarray(centres.T, np.float32)

    def run(batches):
        best = None
        for keys, cuts, rows, values in units(batches):
            near = products(cuts, rows, values, tables).max(axis=0).astype(np.float64)
            if seed is None:
                cost = -near
            else:
                gap = np.maximum(0, 1 - near) ** 2
                cost = np.where(gap > 1e-9, -np.log(uniform(keys.astype(np.uint64) ^ np.uint64(seed))) / np.maximum(gap, 1e-300), np.inf)
            j = int(np.lexsort((keys, cost))[0])
            if np.isfinite(cost[j]) and (best is None or (cost[j], keys[j]) < best[:2]):
                best = (float(cost[j]), int(keys[j]), rows[cuts[j] : cuts[j + 1]].astype(np.int32).tobytes(), values[cuts[j] : cuts[j + 1]].tobytes())
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in best], ["cost", "key", "rows", "x"])

    got = held.mapInArrow(tidied(run), "cost double, key long, rows binary, x binary").orderBy("cost", "key").limit(1).collect()
    if not got:
        return None
    out = np.zeros(size)
    out[np.frombuffer(got[0]["rows"], np.int32)] = np.frombuffer(got[0]["x"], np.int32) / SCALE
    return out


def fit(docs: DataFrame, topics: int = 8, features: Features = FEATURES, rounds: int = 30, seed: int = 5, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Spherical k-means over hashed words weighted by inverse document frequency; classes `topic0`, `topic1`, ...

    All rows with a word are counted, drawn from and clustered, each as often as it comes: frequencies and centres are sums
    over tasks, of topics x 2**bits numbers. The first centre is the document nearest to the mean, each further one is drawn
    far from those before. Rounds end when no sum changes. Once centres move little, rounds read only the documents that may
    still change (`narrowed`) and add the fixed sums of the others: the same sums. Clusters are named in order of size. A document's topic
    is the centre with the greatest dot product: linear in its words, so every text is classed whole at a look-up a word.
    """
    size = 1 << features.bits
    mark = written()
    held = bags(docs, features, doc_id, text)
    frequency, n = summed(held, None, size)
    if not n[0]:
        return Model(features, [], np.zeros((size, 0), np.float32), np.zeros(0))
    idf = np.log((1 + n[0]) / (1 + frequency[0]))
    held = scaled(held, idf)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    columns = lambda c: np.ascontiguousarray(np.array(c).T.astype(np.float32))
    moved = lambda a, b: np.linalg.norm(np.array(a) - np.array(b), axis=1)
    centres = [picked(held, columns([unit(summed(held, None, size)[0][0].astype(float))]), size, None)]
    while len(centres) < min(topics, n[0]):
        more = picked(held, columns(centres), size, seed * 1000 + len(centres))
        if more is None:
            break
        centres.append(more)
    last, count, loose, kept = None, np.zeros(len(centres), np.int64), None, written()
    for _ in range(rounds):
        if loose is not None and (moved(origin, centres) > room).any():
            loose = None
            discard(docs.sparkSession, kept)
        total, count = summed(held if loose is None else loose, columns(centres), size)
        if loose is not None:
            total, count = total + fixed[0], count + fixed[1]
        if last is not None and np.array_equal(total, last):
            break
        last, were = total, centres
        centres = [unit(t.astype(float)) if m else c for c, t, m in zip(centres, total, count)]
        if loose is None and moved(were, centres).max() <= CALM:
            origin, room = were, 2 * moved(were, centres) + CALM / 10
            loose = narrowed(held, columns(origin), room)
            fixed = [x - y for x, y in zip((total, count), summed(loose, columns(origin), size))]
    discard(docs.sparkSession, mark)
    order = np.argsort(-count, kind="stable")
    return Model(features, [f"topic{k}" for k in range(len(centres))], np.ascontiguousarray((np.array(centres)[order] * idf).T.astype(np.float32)), np.zeros(len(centres)))


def topics_and_tokens(docs: DataFrame, keep: list[Column], model: Model | None, text: str = "text") -> DataFrame:
    """`keep`, _topic and _tokens (runs of characters above the space, U+0020) of every whole text.

    A text without a word (null or empty too) has the topic "(none)" and no tokens. Without a model every topic is null.
    """
    rows = docs.select(*keep, text_or_empty(text).alias("_body"))
    names = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(len(names)))
            tokens = np.zeros(batch.num_rows, np.int64)
            for i, padded, starts, ends in FEATURES.documents(data, offsets):
                begins = np.cumsum(np.r_[False, (padded[1:] > 32) & (padded[:-1] <= 32)])
                tokens[i : i + len(starts)] = begins[ends - 1] - begins[starts - 1]
            if model is None:
                topic = pa.nulls(batch.num_rows, pa.string())
            elif not model.classes:
                topic = pa.array([NO_TOPIC] * batch.num_rows)
            else:
                best = np.argmax(model.logits(data, offsets), axis=1)
                topic = pa.array(np.where(tokens > 0, np.array(model.classes)[best], NO_TOPIC).tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), topic, pa.array(tokens)], [*names, "_topic", "_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(tidied(run), f"{fields}, _topic string, _tokens long" if fields else "_topic string, _tokens long")
