"""LM scoring by cross-entropy difference between matched target and background bigram models.

Texts are packed into blocks of a few million tokens: the block's distinct words and a stream of their numbers. A block
sends each of its distinct words and bigrams once, with its counts, to the part of the key space that adds up all
blocks' counts, and gets the totals of just its own entries back. So the models keep every word and bigram, grow with the
corpus, and are never held in one place, while no token is shuffled by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tamarack.llm.common import materialize, splitmix, text_or_empty, tidied

#: Marks of target documents are broadcast up to this number (8 bytes each), and joined by a shuffle beyond it.
MAX_MARKS = 1 << 22
BLOCK_TOKENS = 1_500_000
#: Entries that meet in one task that adds up.
PART_ENTRIES = 1_000_000
#: Bits of a gram's key: 10**12 different ones have about one in 10**5 share a key with another.
KEY_BITS = 56
BOS, EOS = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)


def tokens(text: str) -> list[str]:
    return text.lower().split()


class _Numbers(dict):
    """word -> its number, in order of first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(x: np.ndarray) -> bytes:
    """The planes of bytes of an array, compressed: small numbers and small differences take few."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return planes.size.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _encode(batches, block_tokens: int):
    """Blocks of the rows (doc_id, text, scored); scored and unscored rows are in blocks of their own."""
    task, made = TaskContext.get().partitionId(), 0
    held: dict[bool, tuple] = {}
    size: dict[bool, int] = {}

    def out(scored: bool):
        nonlocal made
        ids, lens, stream, numbers = held.pop(scored)
        words = np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in numbers), np.uint64, len(numbers))
        made, size[scored] = made + 1, 0
        one = [[task << 32 | made], [sum(lens)], [len(words)], [scored]]
        packed = [[_packed(x)] for x in (np.array(lens, np.int64), words, np.concatenate(stream))]
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in one), pa.array([ids], pa.list_(kind)), *(pa.array(x, pa.binary()) for x in packed)], BLOCK)

    for batch in batches:
        kind = batch.column(0).type
        for i, text in enumerate(batch.column(1)):
            scored = batch.column(2)[i].as_py()
            ids, lens, stream, numbers = held.setdefault(scored, ([], [], [], _Numbers()))
            words = tokens(text.as_py())
            ids.append(batch.column(0)[i].as_py())
            lens.append(len(words))
            stream.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            size[scored] = size.get(scored, 0) + len(words)
            if size[scored] >= block_tokens:
                yield out(scored)
    for scored in list(held):
        yield out(scored)


BLOCK = ["block", "n_tokens", "n_words", "scored", "ids", "lens", "words", "stream"]


@dataclass
class _Block:
    """The grams of a block: words, then different bigrams (`code` ascending), then every word with EOS, whose count says how
    often it is the last, and the start with EOS, whose count is the number of documents that have a token. `inverse` is
    each token's bigram."""

    lens: np.ndarray
    words: np.ndarray
    stream: np.ndarray

    def __post_init__(self):
        self.stream = self.stream.astype(np.int64)
        v = len(self.words)
        full = np.flatnonzero(self.lens)
        self.doc = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        ends = np.cumsum(self.lens)[full]
        self.starts, self.last = ends - self.lens[full], np.zeros(len(self.lens), np.int64)
        self.last[full] = self.stream[ends - 1]
        self.before = np.r_[v, self.stream[:-1]][: len(self.stream)]
        self.before[self.starts] = v
        self.code, self.inverse, self.count = np.unique(self.before * (v + 1) + self.stream, return_inverse=True, return_counts=True)
        heads = np.r_[self.words, BOS]
        first = np.r_[heads[self.code // (v + 1)] if v else heads[:0], self.words, BOS]
        second = np.r_[self.words[self.code % (v + 1)], np.full(v + 1, EOS)]
        # the lowest bit tells words from pairs, so that words can be counted
        pair = splitmix(splitmix(first) + second) >> np.uint64(64 - KEY_BITS) & ~np.uint64(1)
        word = splitmix(self.words) >> np.uint64(64 - KEY_BITS) | np.uint64(1)
        self.keys = np.r_[word, pair]
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, docs: np.ndarray | None = None) -> np.ndarray:
        """Counts of the grams in order of `keys`, of all documents or of those marked."""
        v = len(self.words)
        if docs is None:
            stream, count, last, n = self.stream, self.count, self.last[self.lens > 0], int((self.lens > 0).sum())
        else:
            mine = docs[self.doc]
            stream, count = self.stream[mine], np.bincount(self.inverse[mine], minlength=len(self.code))
            last = self.last[docs & (self.lens > 0)]
            n = len(last)
        return np.r_[np.bincount(stream, minlength=v), count, np.bincount(last, minlength=v), n].astype(np.int64)

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token, how often its own document has the bigram, its first word as a context, and the word."""
        def repeats(key: np.ndarray) -> np.ndarray:
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            return count[inverse]

        word = repeats(self.doc.astype(np.int64) * max(1, len(self.words)) + self.stream)
        context = np.r_[1, word[:-1]][: len(word)] - (self.last[self.doc] == self.before)
        context[self.starts] = 1
        return repeats(self.doc.astype(np.int64) * max(1, len(self.code)) + self.inverse), context, word


def _marked(n: int, places) -> np.ndarray:
    out = np.zeros(n, bool)
    if places is not None:
        out[np.array(places, np.int64)] = True
    return out


def _send(batches, bits: int, counted: bool | None):
    """(part, block, keys, background, target): a block's sorted keys and counts, cut at the parts' borders.

    `counted`: blocks of which kind (scored or not) are background; null for both.
    """
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            b = _Block(_unpacked(row["lens"], np.int64), _unpacked(row["words"], np.uint64), _unpacked(row["stream"], np.uint32))
            keys = b.keys[b.order]
            background = b.counts()[b.order] if counted in (None, row["scored"]) else np.zeros(len(keys), np.int64)
            target = b.counts(_marked(len(b.lens), row["places"]))[b.order]
            part = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            step = np.diff(keys, prepend=keys[:1])
            step[cuts[:-1]] = keys[cuts[:-1]]
            rows = [(int(part[x]), row["block"], *(_packed(z[x:y]) for z in (step, background.astype(np.int32), target.astype(np.int32)))) for x, y in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "block", "keys", "background", "target"), r)) for r in rows], pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("background", pa.binary()), ("target", pa.binary())]))


def _add_up(table: pa.Table) -> pa.Table:
    """For each block that has entries in this part their totals, and once the number and the counts of the words."""
    blocks = table.sort_by("block")
    keys = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in blocks.column("keys").to_pylist()]
    sizes = np.cumsum([0, *map(len, keys)])
    known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = ([_unpacked(x, np.int32) for x in blocks.column(name).to_pylist()] for name in ("background", "target"))
    total = [np.bincount(inverse, np.concatenate(c), len(known)).astype(np.int64) for c in counts]
    word = (known & np.uint64(1) > 0) & (total[0] + total[1] > 0)
    once = [int(word.sum()), int(total[0][word].sum()), int(total[1][word].sum())]
    zeros = [0] * (len(keys) - 1)
    totals = [[_packed(t[inverse[a:b]]) for a, b in zip(sizes[:-1], sizes[1:])] for t in total]
    return pa.table({"block": blocks.column("block"), "part": blocks.column("part"), **{n: pa.array([x, *zeros], pa.int64()) for n, x in zip(("words", "nb", "nt"), once)}, "background": pa.array(totals[0], pa.binary()), "target": pa.array(totals[1], pa.binary())})


def _finish(blocks: pa.Table, totals: pa.Table, sizes: tuple[int, int, int], counted: bool | None, leave_out: bool, weight: float, smoothing: float) -> pa.Table:
    """The losses of the documents of one block."""
    if not blocks.num_rows:  # of the background only
        return pa.table({"doc_id": pa.array([], blocks.schema.field("ids").type.value_type), "n_tokens": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("ce_target", "ce_background", "score")}})
    row = blocks.to_pylist()[0]
    b = _Block(_unpacked(row["lens"], np.int64), _unpacked(row["words"], np.uint64), _unpacked(row["stream"], np.uint32))
    v, n = len(b.words), sizes[0]
    own = b.own() if leave_out else None
    mine = (np.full(len(b.lens), counted in (None, True)), _marked(len(b.lens), row["places"]))
    totals = totals.sort_by("part")
    full = b.lens > 0
    means = []
    for name, size, docs in zip(("background", "target"), sizes[1:], mine):
        total = np.empty(len(b.keys), np.float64)
        total[b.order] = np.concatenate([_unpacked(x, np.int64) for x in totals.column(name).to_pylist()])
        words, pairs, final, start = np.split(total, [v, v + len(b.code), len(total) - 1])
        context = np.r_[words - final, start]  # a word is a context wherever it isn't the last
        pair, context, word, size = pairs[b.inverse], context[b.before], words[b.stream], np.full(len(b.lens), float(size))
        if leave_out:
            less = docs[b.doc]
            pair, context, word = (x - np.where(less, o, 0) for x, o in zip((pair, context, word), own))
            size -= np.where(docs, b.lens, 0)
        extra = smoothing * np.maximum(1, size)
        uni = (word + (extra / max(1, n))[b.doc]) / (size + extra)[b.doc]
        p = np.where(context > 0, weight * pair / np.maximum(context, 1) + (1 - weight) * uni, uni)
        means.append(np.full(len(b.lens), np.nan))
        means[-1][full] = np.add.reduceat(-np.log(p), b.starts) / b.lens[full] if full.any() else 0
    none = ~full
    out = [pa.array(x, pa.float64(), mask=none) for x in (means[1], means[0], means[1] - means[0])]
    return pa.table({"doc_id": blocks.column("ids").combine_chunks().flatten(), "n_tokens": pa.array(b.lens), **dict(zip(("ce_target", "ce_background", "score"), out))})


def score(docs: DataFrame, target_ids: DataFrame, background: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", leave_out: bool = True, weight: float = 0.7, smoothing: float = 1e-3, block_tokens: int = BLOCK_TOKENS, part_entries: int = PART_ENTRIES, max_marks: int = MAX_MARKS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ce_target, ce_background, score (nats a token; lower: more like the target).

    The target model is counted over the rows of `docs` whose id is in `target_ids` (its first column; ids it has twice
    count once), the background model over `docs`, or over `background` if it is given. Both keep every word (lower-cased,
    split at white space) and bigram, and share vocabulary, interpolation `weight` and additive `smoothing`:
    P(w | h) = weight c(hw) / c(h) + (1 - weight) P(w). With `leave_out` a document's own counts are taken off the models
    that have counted it, so that no document is scored by a model that knows it; a copy still knows its twin.

    Null and empty texts have no token and null losses. Repeated rows are documents of their own. A null id is in no
    target. An empty target or background gives every word the same probability; an empty table an empty result. A word of
    any length is one token; a text longer than a block is a block of its own. Other columns aren't read.

    A block's entries are cut by key into parts of about `part_entries`; the rows sent are never more than the entries, however
    many blocks and parts there are. Only ids meet the target's ids; their marks return to the blocks by broadcast up to
    `max_marks`, else by a shuffle of the packed blocks.
    """
    rows = lambda df, scored: df.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("_text"), F.lit(scored).alias("_scored"))
    every = rows(docs, True) if background is None else rows(docs, True).unionByName(background.select(F.lit(None).cast(docs.schema[doc_id].dataType).alias("doc_id"), text_or_empty(text).alias("_text"), F.lit(False).alias("_scored")))
    counted = None if background is None else False
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"block long, n_tokens long, n_words long, scored boolean, ids array<{kind}>, lens binary, words binary, stream binary"
    blocks = materialize(every.mapInArrow(tidied(lambda batches: _encode(batches, block_tokens)), schema), "blocks")
    good = target_ids.select(F.col(target_ids.columns[0]).alias("id"))
    marks = materialize(blocks.filter("scored").select("block", F.posexplode("ids").alias("place", "id")).join(good, "id", "left_semi").select("block", "place"), "marks")
    places = marks.groupBy("block").agg(F.collect_list("place").alias("places"))  # no more than a block has documents
    places = F.broadcast(places) if marks.count() <= max_marks else places.hint("shuffle_hash")
    marked = blocks.join(places, "block", "left")
    entries = blocks.agg(F.coalesce(F.sum(F.col("n_tokens") + F.col("n_words")), F.lit(0))).first()[0]
    bits = max(5, int(np.ceil(np.log2(max(1, entries / part_entries)))))
    sent = marked.select("block", "scored", "lens", "words", "stream", "places").mapInArrow(tidied(lambda batches: _send(batches, bits, counted)), "part long, block long, keys binary, background binary, target binary")
    totals = materialize(sent.groupBy("part").applyInArrow(_add_up, "block long, part long, words long, nb long, nt long, background binary, target binary"), "totals")
    sizes = tuple(totals.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "nb", "nt"))).first())
    finish = lambda mine, back: _finish(mine, back, sizes, counted, leave_out, weight, smoothing)
    ours = marked.filter("scored").select("block", "ids", "lens", "words", "stream", "places")
    out = ours.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, n_tokens long, ce_target double, ce_background double, score double")
    return out.withColumnRenamed("doc_id", doc_id) if doc_id != "doc_id" else out


def target_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The ids of documents labelled good and not toxic."""
    return labels.filter("quality = 1 and toxic = 0").select(doc_id)
