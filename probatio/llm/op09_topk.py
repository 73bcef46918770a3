"""Exact top-k search with multi-resolution segment statistics.

An orthogonal transform, fitted on at most ``SAMPLE_ROWS`` rows, turns vectors so
that the means of long segments hold the directions of most energy, those of
shorter segments the next ones, and so on. For each resolution (segments of 16,
then 8, 4 and 2 components) a vector is described by its segments' means and
standard deviations. The squared distance of two vectors is at least the sum over
segments of length x ((difference of means)^2 + (difference of deviations)^2); in
terms of inner products, the score is at most the sum of length x (product of
means + product of deviations). A pair of query and row goes on to the next
resolution only if that bound reaches the query's k-th best score so far; exact
integer scores are computed for the surviving pairs only. Bounds carry a slack
above their rounding error, so no true result is lost; the transform decides how
many pairs survive, never the result. Each query starts from the k-th best score
within the fitting sample, so all tasks prune alike from their first row.

Execution: the query set runs against all rows in blocks. At most ``block_bytes``
of queries are broadcast at a time and each task keeps at most k rows a query
that reach the shared first scores; the partial lists meet in one grouped top-k.

Vectors that are null or hold a null or non-finite component take no part; empty
ones have score 0 with all others. Vectors of different lengths compare as if the
shorter ended in zeros. Ties go to the smaller vec_id. A query is a row: rows
that repeat an id are candidates each, but none of its own id's rows; of query
rows that repeat an id, the largest valid vector in array order is answered. Null
ids take no part. Scores beyond 64 bits become the nearest long. Columns besides
id and vector play no part.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

SCALE = 1024
RESOLUTIONS = (16, 8, 4, 2)
#: Rows that the transform and the first scores are taken from.
SAMPLE_ROWS = 4096
#: Share of surviving pairs from which whole blocks are multiplied.
DENSE = 0.02
#: Integers up to which sums of products are exact in double precision.
EXACT = float(1 << 53)


def quantized(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their floor(SCALE * x) as float64, padded with zeros)."""
    if len(vectors) and not vectors.null_count and not (flat := vectors.flatten()).null_count:
        sizes = np.diff(np.asarray(vectors.offsets))
        if (sizes == sizes[0]).all():
            q = np.floor(SCALE * np.asarray(flat).astype(np.float64)).reshape(len(vectors), sizes[0])
            use = np.isfinite(q).all(axis=1)
            return np.flatnonzero(use), q[use]
    rows, out = [], []
    for k, v in enumerate(vectors.to_pylist()):
        if v is not None and all(x is not None for x in v):
            q = np.floor(SCALE * np.array(v, np.float64))
            if np.isfinite(q).all():
                rows.append(k)
                out.append(q)
    width = max(map(len, out), default=0)
    full = np.zeros((len(out), width))
    for k, q in enumerate(out):
        full[k, : len(q)] = q
    return np.array(rows, np.int64), full


def widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def haar(n: int) -> np.ndarray:
    """The orthonormal Haar matrix of a power of two: rows from long steps to short ones."""
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.concatenate([np.kron(h, [1.0, 1.0]), np.kron(np.eye(len(h)), [1.0, -1.0])])
        h /= np.linalg.norm(h, axis=1)[:, None]
    return h


def transform(sample: np.ndarray) -> np.ndarray:
    """Turns rows so that means of segments hold what varies most; a matrix to multiply from the right.

    Its width is the next power of two, at least the longest segment.
    """
    width = sample.shape[1]
    full = max(RESOLUTIONS[0], 1 << max(0, width - 1).bit_length())
    scaled = sample / max(1.0, np.abs(sample).max(initial=0))
    _, axes = np.linalg.eigh(scaled.T @ scaled) if width else (None, np.zeros((0, 0)))
    # Strongest axes first, onto the steps from long to short.
    return axes[:, ::-1] @ haar(full)[:width]


def statistics(x: np.ndarray) -> list[np.ndarray]:
    """For each resolution, segment means and deviations, scaled so that inner products are score bounds."""
    out = []
    for length in RESOLUTIONS:
        parts = x.reshape(len(x), -1, length)
        out.append(np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(length))
    return out


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, queries.shape[1])
    if most < EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = [[[int(v) for v in r] for r in x] for x in (queries, rows)]
    return np.array([[min(max(sum(a * b for a, b in zip(q, r, strict=True)), -(1 << 63)), (1 << 63) - 1) for r in whole[1]] for q in whole[0]], np.int64).reshape(len(queries), len(rows))


class Best:
    """The k best (score, id) of each query, ties to smaller ids; ``start`` is a score that they reach anyway."""

    def __init__(self, start: np.ndarray, k: int):
        self.k, self.start = k, start
        self.scores = np.full((len(start), k), np.iinfo(np.int64).min)
        self.ids = np.full((len(start), k), np.iinfo(np.int64).max)
        self.filled = np.zeros((len(start), k), bool)

    def floor(self) -> np.ndarray:
        """The score that a row must reach to matter, for each query."""
        return np.maximum(self.start, np.where(self.filled[:, -1], self.scores[:, -1].astype(np.float64), -np.inf))

    def add(self, scores: np.ndarray, ids: np.ndarray, taken: np.ndarray) -> None:
        """``scores``: queries x rows; ``taken``: pairs that count."""
        scores = np.concatenate([self.scores, scores], axis=1)
        ids = np.concatenate([self.ids, np.broadcast_to(ids, (len(scores), len(ids)))], axis=1)
        taken = np.concatenate([self.filled, taken], axis=1)
        order = np.lexsort((ids, -scores.astype(np.float64) if np.abs(scores[taken]).max(initial=0) < EXACT else np.array([[-int(x) for x in r] for r in scores], object), ~taken), axis=1)[:, : self.k]
        self.scores, self.ids, self.filled = (np.take_along_axis(x, order, axis=1) for x in (scores, ids, taken))


class Queries:
    """A step of queries, with what bounds their scores."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.statistics = statistics(widen(vectors, len(turn)) @ turn)
        self.norms = np.linalg.norm(vectors, axis=1)


def survivors(queries: Queries, floor: np.ndarray, described: list[np.ndarray], norms: np.ndarray) -> np.ndarray:
    """Pairs (queries x rows) that no resolution rules out, coarse to fine."""
    alive = np.ones((len(queries.ids), len(norms)), bool)
    left = np.arange(len(norms))
    floor = floor[:, None] - 1e-6
    for own, rows in zip(queries.statistics, described, strict=True):
        bound = own @ rows[left].T
        # Rounding of the turned vectors and of the sums lies far below this share of the norms.
        bound += 1e-9 * queries.norms[:, None] * norms[left]
        # Not a number, where squares overflow, rules nothing out.
        alive[:, left] &= ~(bound < floor)
        left = left[alive[:, left].any(axis=0)]
        if not len(left):
            break
    alive[:, np.setdiff1d(np.arange(len(norms)), left, assume_unique=True)] = False
    return alive


def scan(best: Best, queries: Queries, ids: np.ndarray, rows: np.ndarray, described: list[np.ndarray], norms: np.ndarray) -> int:
    """Take ``rows`` into ``best``; the number of pairs whose score was computed."""
    floor = best.floor()
    alive = survivors(queries, floor, described, norms) if np.isfinite(floor).any() else np.ones((len(queries.ids), len(ids)), bool)
    use = np.flatnonzero(alive.any(axis=0))
    if not len(use):
        return 0
    alive, ids, rows = alive[:, use], ids[use], rows[use]
    most = np.abs(queries.vectors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if most < EXACT and alive.mean() < DENSE:
        q, r = np.nonzero(alive)
        scores = np.zeros(alive.shape, np.int64)
        scores[q, r] = np.einsum("ij,ij->i", queries.vectors[q], rows[r]).astype(np.int64)
    else:
        scores = exact_scores(queries.vectors, rows)
    taken = alive & (queries.ids[:, None] != ids) & (scores >= floor[:, None])
    some = taken.any(axis=0)
    if some.any():
        best.add(scores[:, some], ids[some], taken[:, some])
    return int(alive.sum())


def first_scores(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int, step: int) -> np.ndarray:
    """For each query, a score that its k best rows reach: the k-th best in the sample; -inf without so many."""
    out = np.full(len(ids), -np.inf)
    if len(sample) < k:
        return out
    for at in range(0, len(ids), step):
        scores = exact_scores(queries[at : at + step], sample).astype(np.float64)
        scores[ids[at : at + step, None] == sample_ids] = -np.inf
        out[at : at + step] = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
    return out


def _search(batches, shipped, k: int, step: int):
    ids, vectors, start, turn = shipped.value
    steps = [Queries(ids[at : at + step], vectors[at : at + step], turn) for at in range(0, len(ids), step)]
    best = [Best(start[at : at + step], k) for at in range(0, len(ids), step)]
    for batch in batches:
        use, rows = quantized(batch.column(1))
        if not len(use):
            continue
        own = np.asarray(batch.column(0).take(pa.array(use))).astype(np.int64)
        # Shorter rows end in zeros; the width covers every row of the table.
        rows = widen(rows, vectors.shape[1])
        described, norms = statistics(rows @ turn), np.linalg.norm(rows, axis=1)
        for queries, kept in zip(steps, best, strict=True):
            scan(kept, queries, own, rows, described, norms)
    for queries, kept in zip(steps, best, strict=True):
        who, place = np.nonzero(kept.filled)
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[who]), pa.array(kept.ids[who, place]), pa.array(kept.scores[who, place])], names=["query_id", "vec_id", "score"])


def _collected(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors of this width) of a bounded table, by Arrow, ids ascending."""
    found = rows.select("id", "v").toArrow().combine_chunks()
    use, matrix = quantized(found.column("v").combine_chunks())
    ids = np.asarray(found.column("id").combine_chunks()).astype(np.int64)[use]
    order = np.argsort(ids, kind="stable")
    return ids[order], widen(matrix, width)[order]


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, block_bytes: int = 64 << 20, step: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id ``every`` divides.

    ``block_bytes`` bounds the queries that the driver and each task hold at a
    time. The fitting sample of ``SAMPLE_ROWS`` rows is chosen by a hash of ids.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    known = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    known = known.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    queries = known.where(F.col("id") % every == 0)
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.count_if(F.col("id") % every == 0).alias("queries")).first()
    if not sizes["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = sizes["width"]
    blocks = -(-sizes["queries"] * max(1, width) * 8 // block_bytes)
    part = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30))
    share = min(1 << 30, (SAMPLE_ROWS << 30) // sizes["n"] + 1)
    # The limit cuts the few rows above the expected number.
    sample_ids, sample = _collected(known.where(part < share).limit(2 * SAMPLE_ROWS), width)
    turn = transform(sample)
    parts = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).groupBy("id").agg(F.max("v").alias("v"))
        ids, matrix = _collected(own, width)
        if not len(ids):
            continue
        start = first_scores(ids, matrix, sample_ids, sample, k, step)
        shipped = spark.sparkContext.broadcast((ids, matrix, start, turn))
        found = checkpointed(known.mapInArrow(partial(_search, shipped=shipped, k=k, step=step), "query_id long, vec_id long, score long"))
        parts = found if parts is None else parts.union(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
