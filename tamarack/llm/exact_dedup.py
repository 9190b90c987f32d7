"""Exact deduplication: counting quotient filters per partition, merged by sorted remainders, then byte verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialize, text_or_empty


@dataclass
class CountingQuotientFilter:
    """A set of 64-bit fingerprints with exact counts, of the quotients from `low` up to `high`.

    A fingerprint splits into a quotient (its upper bits) and a remainder (the rest, whole bytes). The quotient isn't
    stored: `occupied` has a bit per quotient that has a run, `run_end` a bit per slot that ends one, and the slots hold
    remainders in ascending order within their run. Most counts are one and take a bit: `repeated` has a bit per slot,
    and `more` the counts above one, less two, as variable-length integers. Nothing is approximate up to equality of
    fingerprints, and two filters merge by one pass over the sorted remainders of their runs.
    """

    quotient_bits: int
    low: int
    high: int
    occupied: np.ndarray
    run_end: np.ndarray
    remainders: np.ndarray  # (slots, bytes of a remainder)
    repeated: np.ndarray
    more: bytes

    @classmethod
    def of(cls, fingerprints: np.ndarray, quotient_bits: int = 16) -> CountingQuotientFilter:
        """From fingerprints in any order, repeated ones counted."""
        keys, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        left = np.uint64(64 - quotient_bits)
        return cls._of_slots((keys >> left).astype(np.int64), keys & ((np.uint64(1) << left) - np.uint64(1)), counts, quotient_bits, 0, 1 << quotient_bits)

    @classmethod
    def _of_slots(cls, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray, quotient_bits: int, low: int, high: int) -> CountingQuotientFilter:
        """From slots in order, no two alike."""
        if quotient_bits % 8 or not 0 < quotient_bits < 64:
            raise ValueError("remainders are whole bytes")
        occupied = np.zeros(high - low, bool)
        occupied[quotients - low] = True
        run_end = np.r_[quotients[1:] != quotients[:-1], np.ones(min(1, len(quotients)), bool)]
        raw = remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - quotient_bits // 8]
        return cls(quotient_bits, low, high, np.packbits(occupied), np.packbits(run_end), np.ascontiguousarray(raw), np.packbits(counts > 1), varints(counts[counts > 1] - 2))

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quotient, remainder and count of every slot, in order."""
        n = len(self.remainders)
        runs = np.flatnonzero(np.unpackbits(self.occupied, count=self.high - self.low)) + self.low
        ends = np.unpackbits(self.run_end, count=n).astype(np.int64)
        quotients = runs[np.cumsum(ends) - ends] if n else np.zeros(0, np.int64)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : self.remainders.shape[1]] = self.remainders
        counts = np.ones(n, np.int64)
        counts[np.unpackbits(self.repeated, count=n).astype(bool)] = of_varints(self.more) + 2
        return quotients, wide.view("<u8").ravel().astype(np.uint64), counts

    def fingerprints(self) -> np.ndarray:
        quotients, remainders, _ = self.slots()
        return quotients.astype(np.uint64) << np.uint64(64 - self.quotient_bits) | remainders

    @property
    def counts(self) -> np.ndarray:
        return self.slots()[2]

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """One pass over both filters' runs: equal remainders of a run add their counts."""
        (qa, ra, ca), (qb, rb, cb) = self.slots(), other.slots()
        # a slot's place in the merged order: its own place and how many of the other's slots come before it
        width = np.uint64(64 - self.quotient_bits)
        a, b = qa.astype(np.uint64) << width | ra, qb.astype(np.uint64) << width | rb
        order = np.argsort(np.r_[a, b], kind="stable")  # two ascending runs: the stable sort merges them in linear time
        q, r, c = np.r_[qa, qb][order], np.r_[ra, rb][order], np.r_[ca, cb][order]
        new = np.r_[np.ones(min(1, len(q)), bool), (q[1:] != q[:-1]) | (r[1:] != r[:-1])]
        heads = np.flatnonzero(new)
        return self._of_slots(q[heads], r[heads], np.add.reduceat(c, heads) if len(heads) else c, self.quotient_bits, min(self.low, other.low), max(self.high, other.high))

    def count(self, fingerprint: int) -> int:
        """The count of one fingerprint: a search among the remainders of its quotient's run."""
        q, r = fingerprint >> (64 - self.quotient_bits), fingerprint & ((1 << (64 - self.quotient_bits)) - 1)
        quotients, remainders, counts = self.slots()
        a, b = np.searchsorted(quotients, [q, q + 1])
        at = a + int(np.searchsorted(remainders[a:b], np.uint64(r)))
        return int(counts[at]) if at < b and int(remainders[at]) == r else 0

    def parts(self, bits: int):
        """(block, bytes) of the slots whose quotients share their upper `bits` bits: bitmaps, remainders and counts."""
        quotients, remainders, counts = self.slots()
        wide = 1 << (self.quotient_bits - bits)
        blocks = quotients // wide
        edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True]) if len(blocks) else np.zeros(0, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            low = int(blocks[a]) * wide
            part = self._of_slots(quotients[a:b], remainders[a:b], counts[a:b], self.quotient_bits, low, low + wide)
            head = np.array([self.quotient_bits, low, low + wide, b - a], "<i8")
            yield int(blocks[a]), b"".join(x.tobytes() for x in (head, part.occupied, part.run_end, part.repeated, part.remainders)) + part.more

    @classmethod
    def from_part(cls, data: bytes) -> CountingQuotientFilter:
        bits, low, high, n = (int(x) for x in np.frombuffer(data, "<i8", 4))
        width, at, fields = 8 - bits // 8, 32, []
        for size in ((high - low + 7) // 8, (n + 7) // 8, (n + 7) // 8, n * width):
            fields.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(bits, low, high, fields[0], fields[1], fields[3].reshape(n, width), fields[2], data[at:])


def varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first, the upper bit set where more follow."""
    out = []
    left = values.astype(np.uint64)
    place = np.arange(len(left))
    while len(left):
        byte = (left & np.uint64(127)).astype(np.uint8)
        left = left >> np.uint64(7)
        out.append((place, np.where(left > 0, byte | 128, byte).astype(np.uint8)))
        place, left = place[left > 0], left[left > 0]
    if not out:
        return b""
    places, digits = np.concatenate([p for p, _ in out]), np.concatenate([b for _, b in out])
    return digits[np.argsort(places, kind="stable")].tobytes()


def of_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    number = np.cumsum(last) - last
    starts = np.flatnonzero(np.r_[True, last[:-1]]) if len(raw) else np.zeros(0, np.int64)
    shift = np.uint64(7) * (np.arange(len(raw)) - starts[number]).astype(np.uint64)
    digits = (raw & 127).astype(np.uint64) << shift
    return np.add.reduceat(digits, starts).astype(np.int64) if len(starts) else np.zeros(0, np.int64)


def repeated_fingerprints(digests: DataFrame, column: str = "fp", block_rows: int = 1 << 18) -> DataFrame:
    """(fp, n) of fingerprints that occur more than once.

    Every partition builds filters and sends them by block of quotients: bitmaps, remainders and the few counts above
    one. A block holds one slot per fingerprint and filter, however often the fingerprint occurs, and the number of
    blocks grows with the table, so merging is bounded in memory. A fingerprint repeated in a third of all rows costs one
    slot per filter.
    """
    rows = digests.count()
    bits = max(4, int(np.ceil(np.log2(max(1, rows / block_rows)))))
    quotient_bits = 8 * max(2, -(-(bits + 4) // 8))

    def build(batches):
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(held[-1])
            if size >= 1 << 20:
                yield from slots(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from slots(np.concatenate(held))

    def slots(values: np.ndarray):
        parts = list(CountingQuotientFilter.of(values, quotient_bits).parts(bits))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["block", "slots"])

    def merge(table: pa.Table) -> pa.Table:
        level = [CountingQuotientFilter.from_part(x) for x in table.column("slots").to_pylist()]
        while len(level) > 1:
            level = [a.merge(b) for a, b in zip(level[::2], level[1::2])] + ([level[-1]] if len(level) % 2 else [])
        keys, (_, _, counts) = level[0].fingerprints(), level[0].slots()
        keep = counts > 1
        return pa.table({"fp": keys[keep].view(np.int64), "n": counts[keep]})

    filters = digests.select(column).mapInArrow(build, "block long, slots binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text. Of equal texts the row with the largest doc_id
    stays; a null doc_id is smaller than any other, and rows that repeat both doc_id and text share one verdict. An
    empty table gives an empty result. Other columns, whatever their names, are not read.

    1. Each row gets a fingerprint; filters per partition merge into the fingerprints with a count above one.
    2. Only rows with such a fingerprint are routed to byte verification, which groups by the text itself with
       map-side combining (a copy group of any size sends one row per task).
    3. Verified groups return to the rows by digest; both sides are written tables, so a hot group's rows are split.
    """
    body = text_or_empty(text)
    digests = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.sha2(body, 256).alias("sha"), F.xxhash64(body).alias("fp")), "digests")
    repeated = materialize(repeated_fingerprints(digests), "repeated")
    suspects = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("fp")).join(repeated.select("fp"), "fp", "left_semi")
    groups = suspects.groupBy("body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.filter("group_size > 1").select(F.sha2("body", 256).alias("sha"), "keep_id", "group_size"), "groups")
    out = digests.join(groups, "sha", "left")
    # without a group a row is its own
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep_id.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("sha").alias("text_sha256"))
