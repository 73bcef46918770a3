"""Hierarchical multi-length packing of token streams.

Tiers are context sizes, each a power of two. Documents are routed whole: one of
more than the largest size fills windows of it first; what it leaves, or the
document itself, goes to the largest tier if it exceeds a quarter of that size,
else to the tier whose size it fills by a quarter to a half. Each tier is packed
into windows of its own size: a window opens with the longest piece routed to its
tier, and the gap behind it is filled from the same and from shorter tiers, by
one piece or two that fit it exactly where there are such, else by the longest
that fits. Only where none fits is a piece cut, and its rest routed again. So
windows are full, most documents stay whole, and each tier has its own mixture.

Packing runs over a pool of at most ``POOL`` ids of a task's documents. What a
task leaves below the smallest tier runs on behind the others' in windows of the
largest size, so only the very last window of the corpus is padded.

Step groups: windows are numbered tier by tier; ``step_group`` deals each tier's
windows evenly over the steps, so every step sees the same mixture of context
sizes and about the same number of tokens.

Execution: one narrow pass encodes and packs (checkpointed: digests of pieces,
and the ids of less than the smallest tier for each task); one small aggregate
gives each partition's windows; one narrow pass numbers them by running sums.
Texts and ids are never shuffled.

Null and empty texts hold only the end id. Repeated rows are packed each on its
own. Columns besides id and text play no part.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rapid
from .common import bounded_batches, checkpointed

TIERS = (4096, 2048, 1024, 512, 256)
END_ID = 2
#: Ids that wait in one task for a place; half of them stay to choose from until its end.
POOL = 1 << 21


def route(length: int, tiers=TIERS) -> int:
    """Number of the tier of a piece that the largest window holds."""
    k = 0
    while k < len(tiers) - 1 and 4 * length <= tiers[k]:
        k += 1
    return k


class Pool:
    """Pieces (document, start, ids) by length, and the windows that they fill."""

    def __init__(self, tiers):
        self.tiers = tuple(tiers)
        self.pieces: list[list] = [[] for _ in range(tiers[0] + 1)]
        self.count = np.zeros(tiers[0] + 1, np.int64)
        self.total = 0
        #: Longest and shortest length of each tier.
        most = [tiers[0], *(t // 4 for t in tiers[:-1])]
        self.bounds = [(low + 1, high) for high, low in zip(most, [*most[1:], 0], strict=True)]

    def add(self, doc, start: int, ids: np.ndarray) -> None:
        self.pieces[len(ids)].append((doc, start, ids))
        self.count[len(ids)] += 1
        self.total += len(ids)

    def take(self, length: int):
        self.count[length] -= 1
        self.total -= length
        return self.pieces[length].pop()

    def longest(self, most: int, least: int = 1) -> int:
        """The longest length in the pool within bounds; 0 if there is none."""
        found = np.flatnonzero(self.count[least : most + 1])
        return int(found[-1]) + least if len(found) else 0

    def _two(self, gap: int, most: int) -> int:
        """The longer of two lengths that fill the gap together; 0 if there are none."""
        low, high = (gap + 1) // 2, min(most, gap - 1)
        if high < low:
            return 0
        other = self.count[gap - high : gap - low + 1][::-1].copy()
        if gap % 2 == 0:
            other[0] -= self.count[low] < 2
        found = np.flatnonzero((self.count[low : high + 1] > 0) & (other > 0))
        return int(found[-1]) + low if len(found) else 0

    def window(self, size: int, first: int, most: int) -> list:
        """Pieces that fill a window of ``size``, opened by one of length ``first``; none is over ``most``."""
        out, gap = [], size
        length = first
        while gap:
            if not length:
                length = gap if gap <= most and self.count[gap] else self._two(gap, most) or self.longest(min(gap, most))
            # None fits: the shortest of any tier is taken, and cut if it is too long.
            doc, start, ids = piece = self.take(length or int(np.flatnonzero(self.count)[0]))
            if len(ids) > gap:
                piece = (doc, start, ids[:gap])
                self.add(doc, start + gap, ids[gap:])
            out.append(piece)
            gap -= len(piece[2])
            length = 0
        return out

    def windows(self, keep: int):
        """(tier, pieces) of full windows while more than ``keep`` ids wait, the tiers in turn by what waits for them."""
        lengths = np.arange(len(self.count))
        while self.total > keep:
            weight = self.count * lengths
            waiting = [int(weight[low : high + 1].sum()) for low, high in self.bounds]
            moved = False
            for k, (size, (low, high)) in enumerate(zip(self.tiers, self.bounds, strict=True)):
                # A tier gives up the windows that its own pieces make up, and leaves shorter ones to fill gaps.
                for _ in range(max(1, waiting[k] // size)):
                    first = self.longest(high, low)
                    if self.total <= keep or not first or self.total < size:
                        break
                    yield k, self.window(size, first, high)
                    moved = True
            if not moved:
                return

    def rest(self):
        """Full windows of whatever size is left, largest first."""
        for k, size in enumerate(self.tiers):
            while self.total >= size:
                yield k, self.window(size, self.longest(len(self.count) - 1), len(self.count) - 1)

    def leftover(self) -> list:
        """All pieces that are left."""
        return [self.take(n) for n in np.flatnonzero(self.count).tolist() for _ in range(int(self.count[n]))]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


NAMES = ("id", "part", "doc_tokens", "start", "length", "ids_crc32", "slot", "window", "offset", "ids")


def _cut(batches, path: str, end_id: int, tiers, limit: int):
    """Pieces of full windows, numbered in this task by slot; those of slot ``len(tiers)`` are left over, with their ids."""
    encoder = rapid.encoder(path)
    part = TaskContext.get().partitionId()
    pool, made = Pool(tiers), [0] * len(tiers)
    largest, kind = tiers[0], None

    def rows(windows):
        out: list[list] = [[] for _ in NAMES[2:]]
        docs = []
        for slot, pieces in windows:
            at = 0
            for (doc, n), start, ids in pieces:
                docs.append(doc)
                for column, x in zip(out, (n, start, len(ids), _crc(ids), slot, made[slot], at, None), strict=True):
                    column.append(x)
                at += len(ids)
            made[slot] += 1
        return arrays(docs, out)

    def arrays(docs, out):
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(docs, kind), pa.array([part] * len(docs), pa.int32()), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=list(NAMES))

    for batch in batches:
        kind = batch.column(0).type
        whole = []
        for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode_batch([x or "" for x in batch.column(1).to_pylist()]), strict=True):
            ids = np.append(ids.astype("<u4"), np.uint32(end_id))
            n = len(ids)
            full = n - n % largest
            whole += [(0, [((doc, n), at, ids[at : at + largest])]) for at in range(0, full, largest)]
            if full < n:
                # A copy, so that a waiting piece does not hold its whole document.
                pool.add((doc, n), full, ids[full:].copy() if full else ids)
        if pool.total > limit:
            whole += pool.windows(limit // 2)
        yield rows(whole)
    if kind is None:
        return
    yield rows(pool.windows(0))
    yield rows(pool.rest())
    out: list[list] = [[] for _ in NAMES[2:]]
    docs, at = [], 0
    for (doc, n), start, ids in pool.leftover():
        docs.append(doc)
        for column, x in zip(out, (n, start, len(ids), 0, len(tiers), 0, at, ids.tobytes()), strict=True):
            column.append(x)
        at += len(ids)
    yield arrays(docs, out)


def _place(batches, bases: dict, first: list[int], tiers):
    """Bases: for each partition the windows of each tier, and the ids left over, before it."""
    long = tiers[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, slots = np.asarray(batch.column(1)), np.asarray(batch.column(6))
        before = np.array([bases[p] for p in np.unique(parts).tolist()], np.int64)[np.searchsorted(np.unique(parts), parts), slots]
        n, start, length, crc, _, window, offset = (np.asarray(batch.column(k)).astype(np.int64) for k in range(2, 9))
        sequence = np.array(first, np.int64)[slots] + before + window
        tier = np.array([*tiers, long], np.int64)[slots]
        rest = slots == len(tiers)
        columns = [start, length, crc, n, sequence, offset, tier]
        keep = np.flatnonzero(~rest)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), *(pa.array(c[keep]) for c in columns)], names=["id", *PLACED])
        out: list[tuple] = []
        for k in np.flatnonzero(rest).tolist():
            ids, at = np.frombuffer(batch.column(9)[k].as_py(), "<u4"), int(before[k] + offset[k])
            begin = int(start[k])
            while len(ids):
                piece = ids[: long - at % long]
                out.append((k, begin, len(piece), _crc(piece), int(n[k]), first[len(tiers)] + at // long, at % long, long))
                begin, at, ids = begin + len(piece), at + len(piece), ids[len(piece) :]
        if out:
            chosen, *columns = (np.array(c, np.int64) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(chosen)), *map(pa.array, columns)], names=["id", *PLACED])


PLACED = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, end_id: int = END_ID, step_tokens: int = 1 << 20, pool: int = POOL) -> DataFrame:
    """One row for each piece: where it lies in its document and in which window.

    ``tiers``: descending powers of two. ``step_tokens``: about so many ids make a
    step. ``pool``: ids that wait in a task, which bounds its memory.
    """
    if list(tiers) != sorted({*tiers}, reverse=True) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be descending powers of two")
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_cut, path=path, end_id=end_id, tiers=tuple(tiers), limit=pool),
        f"id {kind}, part int, doc_tokens long, start long, length long, ids_crc32 long, slot int, window long, offset long, ids binary",
    )
    cut = checkpointed(cut)
    windows = [F.coalesce(F.max(F.when(F.col("slot") == k, F.col("window") + 1)), F.lit(0)).alias(f"w{k}") for k in range(len(tiers))]
    left = F.coalesce(F.sum(F.when(F.col("slot") == len(tiers), F.col("length"))), F.lit(0)).alias("left")
    # One row for each partition of the scan: bounded by the number of input splits.
    totals = cut.groupBy("part").agg(*windows, left).orderBy("part").collect()
    bases, before = {}, [0] * (len(tiers) + 1)
    for row in totals:
        bases[row["part"]] = list(before)
        before = [a + x for a, x in zip(before, row[1:], strict=True)]
    counts = [*before[:-1], -(-before[-1] // tiers[0])]
    first = [sum(counts[:k]) for k in range(len(counts) + 1)]
    placed = cut.mapInArrow(
        partial(_place, bases=bases, first=first, tiers=tuple(tiers)),
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long",
    )
    tokens = sum(c * t for c, t in zip(counts, [*tiers, tiers[0]], strict=True))
    steps = max(1, tokens // step_tokens)
    # The window's rank within its tier, dealt evenly over the steps.
    rank = F.col("sequence_id") - F.element_at(F.array(*map(F.lit, first)), F.col("slot"))
    size = F.element_at(F.array(*map(F.lit, counts)), F.col("slot"))
    slot = F.lit(0)
    for k in range(len(counts)):
        slot = F.when(F.col("sequence_id") >= first[k], k + 1).otherwise(slot) if counts[k] else slot
    return (
        placed.withColumn("slot", slot)
        .withColumn("step_group", F.floor(rank * F.lit(steps) / size).cast("long"))
        .drop("slot")
        .withColumnRenamed("id", id_col)
    )
