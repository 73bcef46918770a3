"""Near copies by the Jaccard similarity of five-word shingles, found with SimHash fingerprints.

One fingerprint of plain bit majorities moves too far for this measure: texts of
similarity 0.8 differ in up to 14 of 64 bits, beyond what a grid can select. So
each text has ``TABLES`` fingerprints of four 16-bit parts, and in each part a
shingle votes with a weight drawn from its hash by a heavy-tailed law: the few
heaviest shingles decide, and two texts agree in a part about as often as they
share those. Fingerprints are embedded as segment popcounts (see
``op07_simhash``); pairs within ``DISTANCE`` bits share the counts of one of the
two halves, which are the grid cells.

In a cell, texts are compared by Manhattan distance, then by how many of all 64
parts agree, which estimates the similarity. The walk starts at the text that is
nearest to the cell's consensus, the likely origin of its copies, links what is
like it and goes on from there, so a dense cell yields one link a text. Cells
over ``CELL_ROWS`` are searched in pairs of blocks. Every link is then verified
exactly on the two whole shingle sets, and verified links become components.

Fingerprints miss some pairs, so an exact search follows between components. Two
sets of similarity s share one of the first n - ceil(s n) + 1 of their n shingles
in any order that all sets have in common; the order puts frequent shingles last.
These shingles are dealt into buckets, packed, sixteen bytes each; a bucket gives
back only those that several texts share, and of these only what unlike
components share is searched, hot shingles in pairs of blocks. Pairs are compared
by size and by the parity of their shingles in ``PARITY`` places, whose bits
differ at most as often as the sets do: both bounds lose no pair. Links found so
are verified and join components.

Before whole sets travel, each pair is compared once more by the parities of as
many places as a set has shingles, up to the next power of two; wider ones fold
to narrower ones. An eighth of a byte a shingle rules out nearly all pairs below
a similarity of 0.74, and no similar one.

Texts are collapsed by hash first, so copies cost one row each. Null texts count
as empty, and texts without words all have the empty shingle; a text of fewer
words than a shingle is one shingle. Repeated rows stay, each with the component
of its text; a null id names no component unless all its ids are null. Columns
besides id and text play no part.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed
from .components import components
from .op07_simhash import embed, manhattan, shingle_hashes

TABLES, PARTS, BITS = 16, 4, 16
DISTANCE = 1
#: Heaviest shingles that vote in a part; the weights of others are too small to turn it.
VOTERS = 4
#: Parts that texts of similarity 0.8 share in 98 of 100 cases.
AGREE = 40
CELL_ROWS = 4096
STEP = 4096
#: Bits that hold the parity of a set's shingles.
PARITY = 512
#: Bits that tell which texts no pair asks for.
MARKS = 1 << 26
#: Buckets of prefix shingles for each shuffle partition; entries that a task packs at a time; texts that it knows it has dealt.
BUCKETS, HELD, SEEN = 16, 1 << 20, 1 << 20
#: Texts that tell frequent shingles, how many of them hold one, and how many shingles count.
SAMPLE, FREQUENT, MOST_FREQUENT = 4000, 4, 1 << 17
_draw = np.random.default_rng(20_240_607)
FACTORS = _draw.integers(0, 1 << 63, TABLES * PARTS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
SALTS = _draw.integers(0, 1 << 63, TABLES * PARTS, dtype=np.uint64)
PLACES = (1 << np.arange(BITS)).astype(np.int64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, at least one."""
    parts = [*shingle_hashes(text, width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def parts_of(hashes: np.ndarray) -> np.ndarray:
    """The 64 sixteen-bit parts of a shingle set's fingerprints."""
    best = np.full((0, len(SALTS)), 0, np.uint64)
    which = np.zeros((0, len(SALTS)), np.uint64)
    for at in range(0, len(hashes), STEP):
        h = hashes[at : at + STEP, None]
        drawn = (h ^ SALTS) * FACTORS
        drawn ^= drawn >> np.uint64(32)
        drawn = drawn * FACTORS
        if at:
            drawn, own = np.concatenate([best, drawn]), np.concatenate([which, np.broadcast_to(h, drawn.shape)])
        if len(drawn) > VOTERS:
            top = np.argpartition(drawn, VOTERS - 1, axis=0)[:VOTERS]
        else:
            top = np.broadcast_to(np.arange(len(drawn))[:, None], drawn.shape)
        which = np.take_along_axis(own, top, axis=0) if at else h[:, 0][top]
        best = np.take_along_axis(drawn, top, axis=0)
    weight = ((best >> np.uint64(12)).astype(np.float64) + 1) ** -3.0
    bits = (_mix(which ^ SALTS)[:, :, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    votes = (weight[:, :, None] * (bits.astype(np.float64) * 2 - 1)).sum(axis=0)
    return ((votes > 0) @ PLACES).astype(np.uint16)


def prefix(hashes: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, one of which any similar set has among its own first ones."""
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1
    order = hashes >> np.uint64(1)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        order = order | common.astype(np.uint64) << np.uint64(63)
    # By the whole hash where the shortened ones are equal.
    return hashes[np.lexsort((hashes, order))[: min(n, len(hashes))]]


def parity(hashes: np.ndarray, places: int = PARITY) -> np.ndarray:
    return np.packbits(np.bincount((_mix(hashes) % np.uint64(places)).astype(np.int64), minlength=places) & 1)


def wide_parity(hashes: np.ndarray) -> np.ndarray:
    """The parity in the least power of two of places that is no less than the set's size and ``PARITY``."""
    return parity(hashes, max(PARITY, 1 << (len(hashes) - 1).bit_length()))


def parities_apart(x: bytes, y: bytes) -> int:
    """How many places of the narrower of two parities differ: never more than the sets' elements do."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    places = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, places), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _sketch(batches, width: int):
    names = ["id", "node", "sketch", "size", "parity", "wide"]
    for batch in batches:
        sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
        more = [pa.array([parts_of(x).tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity(x).tobytes() for x in sets], pa.binary()), pa.array([wide_parity(x).tobytes() for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=names)


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that many of a sample of ``texts`` (node, text) have, sorted. They order prefixes; no result hangs on them."""
    part = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(max(1, texts.count() // SAMPLE))) == 0
    sets = texts.where(part).select("node", "text").mapInArrow(partial(_sets, width=width), "node long, shingles array<long>")
    counts = sets.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    found = [r["s"] for r in counts.orderBy(F.col("n").desc(), "s").limit(MOST_FREQUENT).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TABLES * PARTS)


def _prints(sketches: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(sketches).view("<u8").astype(np.uint64)


def _cells(batches):
    """Two (cell, node) rows for each fingerprint: one for each half of its segment counts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, prints = np.asarray(batch.column(0)), _prints(_matrix(batch.column(1)))
        keys = [_mix(embed(np.ascontiguousarray(prints[:, t]))[:, half] + np.uint64(2 * t + half)) for t in range(TABLES) for half in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(nodes, len(keys)))], names=["cell", "node"])


def walk(nodes: np.ndarray, sketches: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (node, node it is like) that span what lies together.

    With ``side`` (booleans), only pairs of unlike sides count.
    """
    order = np.argsort(nodes, kind="stable")
    nodes, sketches = nodes[order], sketches[order]
    side = None if side is None else side[order]
    left, out = np.arange(len(nodes)), []
    if len(nodes) > 2:
        ranked = np.sort(sketches, axis=0)
        # The middle value of a column is its most frequent one wherever most texts agree.
        left = np.argsort(-(sketches == ranked[len(ranked) // 2]).sum(axis=1), kind="stable")
    prints = _prints(sketches)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = left if side is None else left[side[left] != side[x]]
            near = near[(sketches[near] == sketches[x]).sum(axis=1) >= AGREE]
            if len(near):
                # Exact in the bits of some fingerprint, behind its lower bound.
                flat = [np.ascontiguousarray(prints[k]).reshape(-1) for k in (near, [x])]
                close = (manhattan(embed(flat[0]).reshape(-1, TABLES, 2), embed(flat[1])) <= DISTANCE) & (np.bitwise_count(prints[near] ^ prints[x]) <= DISTANCE)
                near = near[close.any(axis=1)]
            if len(near):
                out += [(int(nodes[k]), int(nodes[x])) for k in near]
                front += [*near]
                left = left[~np.isin(left, near)]
    return out


def _search(batches):
    """Rows (cell, i, j, block, node, sketch) sorted by (cell, i, j): the links of each."""

    def flush(groups):
        out = []
        for keys, nodes, sketches in groups:
            first = keys[:, 3] == keys[0, 1]
            out += walk(nodes, sketches, None if keys[0, 1] == keys[0, 2] else first)
        pairs = np.array([(min(p), max(p)) for p in out], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns[:4]], axis=1), np.asarray(batch.column(4)), _matrix(batch.column(5))
        if waiting is not None:
            own = tuple(np.concatenate([x, y]) for x, y in zip(waiting, own, strict=True))
        edges = np.flatnonzero((own[0][1:, :3] != own[0][:-1, :3]).any(axis=1)) + 1
        groups = [*zip(*(np.split(x, edges) for x in own), strict=True)]
        waiting = groups.pop()
        yield flush(groups)
    if waiting is not None:
        yield flush([waiting])


def candidates(nodes: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct pairs (a, b) of ``nodes`` (node, sketch) that look alike, spanning each group."""
    bounded_batches(nodes.sparkSession)
    cells = nodes.select("node", "sketch").mapInArrow(_cells, "cell long, node long")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cells.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("n") / cell_rows).cast("long"))
    block = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks"))
    # A cell of b blocks becomes b (b + 1) / 2 pairs of blocks; each row joins the b that hold its own.
    dealt = shared.withColumn("block", block).select("cell", "block", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")
    dealt = dealt.join(nodes.select("node", "sketch"), "node").select("cell", "i", "j", "block", "node", "sketch")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_search, "a long, b long").distinct()


def _deal(batches, width: int, similarity: float, shipped, buckets: int):
    """(bucket, entries): prefix shingles and their texts, packed; each text once for a task at least.

    Frequent shingles are dealt by text as well, so that no bucket is a hot one.
    """
    frequent, seen, held, size = shipped.value, set(), [], 0

    def flush():
        both = np.concatenate(held)
        cell, node = both[:, 0], both[:, 1]
        common = np.isin(cell, frequent) if len(frequent) else np.zeros(len(cell), bool)
        bucket = (_mix(np.where(common, cell ^ _mix(node), cell)) >> np.uint64(16)) % np.uint64(buckets)
        # Buckets of frequent shingles are apart: there all entries pass.
        bucket = bucket.astype(np.int64) + buckets * common
        order = np.argsort(bucket, kind="stable")
        names, starts = np.unique(bucket[order], return_index=True)
        parts = np.split(both[order], starts[1:])
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "entries"])

    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            cells = prefix(shingle_set(text, width), frequent, similarity)
            held.append(np.stack([cells, np.full(len(cells), node, np.int64).view(np.uint64)], axis=1))
            size += len(cells)
            if size >= HELD:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _shared(batches, buckets: int):
    """Rows (bucket, entries) sorted by bucket: the (cell, node) whose cell several texts have."""

    def given(bucket, parts):
        both = np.unique(np.concatenate([np.frombuffer(p, np.uint64).reshape(-1, 2) for p in parts]), axis=0)
        if bucket < buckets:
            cell = both[:, 0]
            same = cell[1:] == cell[:-1]
            both = both[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        both = both.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["cell", "node"])

    now, waiting = None, []
    for batch in batches:
        for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now and waiting:
                yield given(now, waiting)
                waiting = []
            now = bucket
            waiting.append(entries)
    if waiting:
        yield given(now, waiting)


def meet(group: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, bits: np.ndarray, similarity: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (rows are sorted by it), of unlike roots and sides, that no bound rules out."""
    left, right = [], []
    at, lag = np.arange(len(group) - 1), 1
    while len(at := at[at + lag < len(group)]) and len(at := at[group[at] == group[at + lag]]):
        a, b = at, at + lag
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        use = (root[a] != root[b]) & (small >= similarity * large - 1e-6)
        if side is not None:
            use &= side[a] != side[b]
        a, b = a[use], b[use]
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        use = apart <= (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + 1e-6
        left.append(np.minimum(node[a[use]], node[b[use]]))
        right.append(np.maximum(node[a[use]], node[b[use]]))
        lag += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _meet(batches, similarity: float):
    """Rows (cell, i, j, block, node, root, size, parity) sorted by (cell, i, j): the pairs of each that may be similar."""

    def pairs(rows, bits):
        group = np.concatenate([[0], np.cumsum((rows[1:, :3] != rows[:-1, :3]).any(axis=1))])
        # Rows of one block meet each other; those of a pair of blocks meet the other side.
        side = np.where(rows[:, 1] == rows[:, 2], np.arange(len(rows)), rows[:, 3])
        found = np.unique(np.stack(meet(group, rows[:, 4], rows[:, 5], rows[:, 6], bits, similarity, side), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    rows, bits = np.zeros((0, 7), np.int64), np.zeros((0, PARITY // 64), np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([rows, np.stack([np.asarray(c).astype(np.int64) for c in batch.columns[:7]], axis=1)])
        bits = np.concatenate([bits, np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, PARITY // 64)])
        edge = np.flatnonzero((rows[:-1, :3] != rows[-1, :3]).any(axis=1))
        if len(edge):
            cut = int(edge[-1]) + 1
            yield pairs(rows[:cut], bits[:cut])
            rows, bits = rows[cut:], bits[cut:]
    if len(rows):
        yield pairs(rows, bits)


def strays(keyed: DataFrame, nodes: DataFrame, rooted: DataFrame, shipped, width: int, similarity: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct pairs (a, b) of ``nodes`` in unlike components that may be similar: none is missing."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * n
    dealt = keyed.select("node", "text").mapInArrow(partial(_deal, width=width, similarity=similarity, shipped=shipped, buckets=buckets), "bucket long, entries binary")
    shared = dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(partial(_shared, buckets=buckets), "cell long, node long")
    named = rooted.select(F.col("node").alias("member"), "root")
    cells = checkpointed(shared.join(named, F.col("node") == F.col("member"), "left").select("cell", "node", F.coalesce("root", "node").alias("root")))
    # Counts and extremes are partial sums, so a shingle that one large component shares is dropped on the way.
    open_cells = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell", F.ceil(F.col("n") / cell_rows).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks"))
    met = cells.join(open_cells, "cell").withColumn("block", block)
    met = met.select("cell", "block", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root").join(nodes.select("node", "size", "parity"), "node")
    met = met.select("cell", "i", "j", "block", "node", "root", "size", "parity")
    return met.repartition(n, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(partial(_meet, similarity=similarity), "a long, b long").distinct()


def _sets(batches, width: int):
    for batch in batches:
        found = [shingle_set(t, width).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])


def marked(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of ``MARKS`` bits, a fixed size, that has the bit of every key set."""
    # Spark's buckets hold 32768 bits each and number them from place 1 on.
    place = F.col(key).bitwiseAND(F.lit(MARKS - 1)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    # At most MARKS / 32768 rows of 4096 bytes.
    out = np.zeros((MARKS >> 15, 4096), np.uint8)
    for row in parts.collect():
        out[row["at"] - 1] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.ravel()


def _asked(batches, shipped):
    bits = shipped.value
    for batch in batches:
        place = np.asarray(batch.column(0)).astype(np.int64) & (MARKS - 1)
        use = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        yield batch.filter(pa.array(use.astype(bool)))


def row_key(id_col: str, node) -> Column:
    """Names a row up to equal ones, by its id and its text's hash, so that copies of one text spread."""
    return F.xxhash64(F.col(id_col), node)


def _bounded(batches, similarity: float):
    for batch in batches:
        size = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
        apart = np.array([parities_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
        use = apart <= (1 - similarity) / (1 + similarity) * size + 1e-6
        yield batch.select(["a", "b"]).filter(pa.array(use))


def bounded_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) that wide parities do not rule out."""
    named = [nodes.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("wide").alias(f"{k}_wide")) for k in "ab"]
    both = pairs.join(named[0], "a").join(named[1], "b").select("a", "b", "a_size", "b_size", "a_wide", "b_wide")
    return both.mapInArrow(partial(_bounded, similarity=similarity), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose whole shingle sets are similar; ``texts`` has (id, node, text)."""
    bounded_batches(pairs.sparkSession)
    pairs = checkpointed(bounded_pairs(pairs, nodes, similarity))
    wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    wanted = checkpointed(wanted.select(row_key("least", F.col("node")).alias("row")))
    # Texts that surely no pair asks for stay where they are; the rest meets the exact keys.
    shipped = pairs.sparkSession.sparkContext.broadcast(marked(wanted, "row"))
    named = texts.select(row_key("id", F.col("node")).alias("row"), "node", "text")
    asked = named.mapInArrow(partial(_asked, shipped=shipped), "row long, node long, text string")
    own = asked.join(wanted.hint("shuffle_hash"), "row", "left_semi").dropDuplicates(["row"]).select("node", "text")
    sets = checkpointed(own.mapInArrow(partial(_sets, width=width), "node long, shingles array<long>"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def text_node(text_col: str = "text") -> Column:
    """The hash that stands for a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _classes(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each row, and (node, least, component, leads) of each distinct text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), text_node(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(frequent_shingles(keyed, width))
    own = checkpointed(keyed.mapInArrow(partial(_sketch, width=width), f"id {kind}, node long, sketch binary, size long, parity binary, wide binary"))
    nodes = checkpointed(own.groupBy("node").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("sketch", "size", "parity", "wide")]))
    pairs = checkpointed(candidates(nodes, cell_rows))
    rooted = components(verified(pairs, keyed, nodes, width, similarity))
    more = checkpointed(verified(strays(keyed, nodes, rooted, shipped, width, similarity, cell_rows), keyed, nodes, width, similarity))
    if not more.isEmpty():
        # A link between texts is one between their components.
        rooted = components(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    rooted = rooted.withColumnRenamed("node", "member")
    named = nodes.join(rooted, nodes["node"] == rooted["member"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("first"))
    classes = named.join(first, "root").select("node", "least", F.col("first.least").alias("component"), (F.col("node") == F.col("first.node")).alias("leads"))
    return own.select("id", "node"), classes


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, component) of each row: the smallest id that links reach."""
    own, classes = _classes(docs, width, similarity, id_col, text_col, cell_rows)
    return own.join(classes.select("node", "component"), "node").select(F.col("id").alias(id_col), "component")


def leaders(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row of ``docs`` from each group: one with the smallest id."""
    _, classes = _classes(docs, width, similarity, id_col, text_col, cell_rows)
    chosen = classes.where("leads").select(row_key("least", F.col("node")).alias("__row"))
    named = docs.withColumn("__row", row_key(id_col, text_node(text_col)))
    return named.join(chosen.hint("shuffle_hash"), "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)
