"""SimHash near-dedup in a segment-popcount embedding.

A text's fingerprint has a bit set where over half of its shingles' XXH64
hashes have it set. A fingerprint is embedded as the bit counts of its 32
two-bit segments: the Manhattan distance of two such vectors never exceeds the
Hamming distance of the fingerprints. The 32 dimensions form 6 groups; vectors
within Manhattan distance 3 agree in at least 3 groups, so the grid has one cell
for each choice of 3 groups and each setting of their counts, and a pair within
range meets in at least one of a fingerprint's 20 cells. In a cell the vectors
are compared by Manhattan distance, then the fingerprints exactly.

Skew: documents are collapsed to distinct fingerprints first. Cells of one
fingerprint go at once. A cell is searched by a breadth-first walk that removes
what it has reached, so a dense cell costs few comparisons and yields one link
for each fingerprint, not all pairs; cells over ``cell_rows`` are split into
blocks, and each pair of blocks is searched on its own, so no task holds a whole
hot cell. Links become components by star steps.

Null and empty texts, and texts of white space, have fingerprint zero and link
like any other. Texts of fewer words than a shingle are one shingle. Repeated
rows stay, each with the component of its fingerprint; a null id never names a
component unless all its ids are null. Columns besides id and text play no part.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed
from .components import components

SEED = 42
DISTANCE = 3
#: Groups of the 32 two-bit segments: (first segment, segments).
GROUPS = ((0, 6), (6, 6), (12, 5), (17, 5), (22, 5), (27, 5))
CHOICES = tuple(combinations(range(len(GROUPS)), len(GROUPS) - DISTANCE))
CELL_ROWS = 4096
#: Shingle hashes of one step, which bounds memory with very long texts.
STEP = 1 << 16
TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
OFFSETS = (256 * np.arange(8)).astype(np.int64)
#: Bit counts of the four two-bit segments of a byte, four bits for each.
COUNTS = sum((((np.arange(256) >> 2 * k) & 1) + ((np.arange(256) >> 2 * k + 1) & 1)) << 4 * k for k in range(4)).astype(np.uint64)


def shingle_hashes(text: str | None, width: int):
    """Hashes of the text's shingles, in arrays of at most ``STEP``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    h, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, len(words) - width + 1, STEP):
        part = words[at : at + STEP + width - 1]
        yield np.array([h(join(s), SEED) for s in zip(*(part[k:] for k in range(width)), strict=False)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    total, counts = 0, np.zeros(2048, np.int64)
    for hashes in shingle_hashes(text, width):
        total += len(hashes)
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + OFFSETS).ravel(), minlength=2048)
    if not total:
        return 0
    bits = (counts.reshape(8, 256) @ TABLE).ravel() * 2 > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches, width: int):
    for batch in batches:
        prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint's 64 bits as a long. Narrow."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_fingerprints, width=width), f"id {kind}, fp long")


def embed(prints: np.ndarray) -> np.ndarray:
    """Two words for each fingerprint: its 32 segment counts, four bits for each."""
    raw = COUNTS[prints.view(np.uint8).reshape(-1, 8)]
    half = (np.uint64(1) << (np.uint64(16) * np.arange(4, dtype=np.uint64)))
    return np.stack([(raw[:, :4] * half).sum(axis=1), (raw[:, 4:] * half).sum(axis=1)], axis=1)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embedded fingerprints (counts are at most 2)."""
    mask = np.uint64(0x3333333333333333)
    guard = np.uint64(0x4444444444444444)
    # Each four-bit field of a + 4 - b holds 4 plus the difference, from 2 to 6.
    diff = (a + guard) - b
    above = np.bitwise_count(diff & guard).astype(np.int64)
    low = diff & mask
    total = np.bitwise_count(low & np.uint64(0x1111111111111111)).astype(np.int64) + 2 * np.bitwise_count(low & np.uint64(0x2222222222222222)).astype(np.int64)
    # Fields below 4 hold 4 + d with d < 0: their size is 4 minus the field.
    below = 16 - above
    low_below = low & ~(((diff & guard) >> np.uint64(2)) * np.uint64(3))
    sum_below = np.bitwise_count(low_below & np.uint64(0x1111111111111111)).astype(np.int64) + 2 * np.bitwise_count(low_below & np.uint64(0x2222222222222222)).astype(np.int64)
    return ((total - sum_below) + (4 * below - sum_below)).sum(axis=-1)


def _cells(batches):
    """Twenty (cell, fp) rows for each fingerprint."""
    for batch in batches:
        prints = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        if not len(prints):
            continue
        both = embed(prints)
        parts = []
        for first, size in GROUPS:
            key = np.zeros(len(prints), np.uint64)
            for s in range(first, first + size):
                key = key * np.uint64(3) + ((both[:, s // 16] >> np.uint64(4 * (s % 16))) & np.uint64(3))
            parts.append(key)
        keys = []
        for k, choice in enumerate(CHOICES):
            key = np.full(len(prints), k, np.uint64)
            for g in choice:
                key = key * np.uint64(3 ** GROUPS[g][1]) + parts[g]
            keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(prints.view(np.int64), len(CHOICES)))], names=["cell", "fp"])


def reach(prints: np.ndarray, sources: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (fp, root) that connect what lies within ``DISTANCE``.

    With ``sources``, only links between them and ``prints`` count.
    """
    if sources is None:
        left, links = np.unique(prints), []
        vectors = embed(left)
        while len(left) > 1:
            root, front = left[0], [(left[0], vectors[0])]
            left, vectors = left[1:], vectors[1:]
            while front and len(left):
                fp, v = front.pop()
                near = np.flatnonzero(manhattan(vectors, v) <= DISTANCE)
                near = near[np.bitwise_count(left[near] ^ fp) <= DISTANCE]
                if len(near):
                    links += [(int(x), int(root)) for x in left[near]]
                    front += [*zip(left[near], vectors[near], strict=True)]
                    keep = np.ones(len(left), bool)
                    keep[near] = False
                    left, vectors = left[keep], vectors[keep]
        return links
    # Two blocks: a walk that goes from side to side.
    sides = [np.unique(sources), np.unique(prints)]
    vectors = [embed(s) for s in sides]
    links = []
    while len(sides[0]):
        root = sides[0][0]
        front = [(root, vectors[0][0], 1)]
        sides[0], vectors[0] = sides[0][1:], vectors[0][1:]
        while front:
            fp, v, k = front.pop()
            if not len(sides[k]):
                continue
            near = np.flatnonzero(manhattan(vectors[k], v) <= DISTANCE)
            near = near[np.bitwise_count(sides[k][near] ^ fp) <= DISTANCE]
            if len(near):
                links += [(int(x), int(root)) for x in sides[k][near]]
                front += [(x, y, 1 - k) for x, y in zip(sides[k][near], vectors[k][near], strict=True)]
                keep = np.ones(len(sides[k]), bool)
                keep[near] = False
                sides[k], vectors[k] = sides[k][keep], vectors[k][keep]
    return links


def _search(batches):
    """Rows (cell, i, j, block, fp) sorted by (cell, i, j): links of each (cell, i, j)."""

    def flush(groups, rest):
        out = []
        for own in groups:
            blocks, prints = own[:, 3], own[:, 4].view(np.uint64)
            if own[0, 1] == own[0, 2]:
                out += reach(prints)
            else:
                first = blocks == own[0, 1]
                out += reach(prints[~first], prints[first])
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    waiting = np.zeros((0, 5), np.int64)
    for batch in batches:
        rows = np.concatenate([waiting, np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)])
        if not len(rows):
            continue
        edges = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        groups = np.split(rows, edges)
        waiting = groups.pop()
        yield flush(groups, None)
    if len(waiting):
        yield flush([waiting], None)


def links(prints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``prints`` (fp) within ``DISTANCE``."""
    bounded_batches(prints.sparkSession)
    cells = prints.mapInArrow(_cells, "cell long, fp long")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cells.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("n") / cell_rows).cast("long"))
    # A cell of b blocks becomes b (b + 1) / 2 pairs of blocks; each row joins the b that hold its own.
    block = F.pmod(F.xxhash64(F.lit(5), "fp"), F.col("blocks"))
    dealt = shared.withColumn("block", block).select(
        "cell", "block", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_search, "a long, b long")


def near_groups(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, fp, component): the smallest id that links reach."""
    own = checkpointed(fingerprints(docs, width, id_col, text_col))
    first = own.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = components(links(first.select("fp"), cell_rows))
    joined = first.join(nodes, first["fp"] == nodes["node"], "left")
    rooted = joined.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(names, "root").select("fp", "component")
    return own.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")
