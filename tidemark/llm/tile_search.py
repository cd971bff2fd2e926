"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, then floats."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import DATA_ROWS, QUERY_ROWS, best_of, clean_vectors, numbered_blocks, packed, table_of
from tidemark.llm.shared import arrow_map, materialise
from tidemark.session import ship_package

TOP_K = 20
QUERY_EVERY = 20
LEVELS = 127
#: Products of norms from which a sum of products may leave the range of a double.
MOST = 1e300
#: Queries of one product tile at a time.
TILE_ROWS = 256


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and upper bounds of the norms of the rounded rows and of the errors."""
    scale = np.maximum(np.abs(x).max(1), np.finfo(float).tiny) / LEVELS
    units = x / scale[:, None]  # norms are taken of these, so that no square leaves the range of a double
    q = np.clip(np.rint(units), -LEVELS, LEVELS).astype(np.int8)
    up = scale * (1 + 1e-9)
    return q, scale, np.sqrt((q.astype(np.float64) ** 2).sum(1)) * up, np.sqrt(((units - q) ** 2).sum(1) + 1e-24) * up


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, added from the first component to the last in double precision."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(x.shape[1]):
            total += x[:, d] * y[:, d]
    return total


class Heaps:
    """For each query a heap of its ``k`` best; ties go to the smaller id, and a score that is no number is above all."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.heaps: list[list[tuple[float, bool, int]]] = [[] for _ in ids]

    def least(self) -> np.ndarray:
        return np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])

    def push(self, query: int, vec_ids: list[int], scores: list[float]) -> None:
        heap = self.heaps[query]
        for vec, score in zip(vec_ids, scores, strict=True):
            entry = (score, False, -vec) if score == score else (np.inf, True, -vec)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def found(self) -> Iterator[pa.RecordBatch]:
        rows = [(int(q), -v, np.nan if no else s) for q, h in zip(self.ids, self.heaps, strict=True) for s, no, v in h]
        if rows:
            q, v, s = zip(*rows, strict=True)
            yield from table_of([np.array(q, np.int64)], [np.array(v, np.int64)], [np.array(s)], pa.float64())


def tile(q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, heaps: Heaps, d_quantised: tuple) -> None:
    """One query block against one data block.

    The int8 product, scaled, differs from the true one by at most
    ``|eq| |y'| + |x'| |ed| + |eq| |ed|``, where primes are the rounded rows and
    e the errors. Only pairs whose upper end reaches the query's kth lower end
    (of this tile, or kth score so far) are recomputed. Where a score may leave
    the range of a double its bound says nothing, and it is recomputed as well.
    """
    k = heaps.k
    dq, ds, dn, de = d_quantised
    wide = np.float32 if q.shape[1] * LEVELS * LEVELS < 2**24 else np.float64  # whole numbers stay exact
    dq = dq.astype(wide).T
    for lo in range(0, len(q), TILE_ROWS):
        part = slice(lo, lo + TILE_ROWS)
        qq, qs, qn, qe = quantise(q[part])
        with np.errstate(over="ignore", invalid="ignore"):
            rough = (qq.astype(wide) @ dq).astype(np.float64) * qs[:, None] * ds[None, :]
            slack = qe[:, None] * dn[None, :] + (qn + qe)[:, None] * de[None, :]
            slack = slack * (1 + 1e-9) + np.abs(rough) * 1e-12 + 1e-300
            sure = (qn + qe)[:, None] * (dn + de)[None, :] < MOST
            lower, upper = np.where(sure, rough - slack, -np.inf), np.where(sure, rough + slack, np.inf)
        own = q_ids[part][:, None] == d_ids[None, :]
        lower[own] = -np.inf
        floor = heaps.least()[part]
        if rough.shape[1] > k:
            floor = np.maximum(floor, np.partition(lower, rough.shape[1] - k, 1)[:, -k])
        i, j = np.nonzero((upper >= floor[:, None]) & ~own)
        scores = exact_scores(q[part][i], d[j])
        cut = np.searchsorted(i, np.arange(len(qq) + 1))
        for a in range(len(qq)):
            rows = slice(cut[a], cut[a + 1])
            heaps.push(lo + a, d_ids[j[rows]].tolist(), scores[rows].tolist())


def matrix(raw: pa.Scalar, kind: pa.Scalar, dim: int) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind.as_py()).reshape(-1, dim).astype(np.float64)


def nearest(vectors: DataFrame, is_query: str, k: int = TOP_K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products found.

    Data and queries are packed into blocks of bounded size. Every query block
    meets every data block once: the data blocks go to the query blocks by the
    number of the query block, and a task keeps its heaps over the tiles it has,
    so that ``k`` rows per query and task at most cross the network to the final
    merge. Bounds make the pruning lossless, so nothing above the kth is missed.
    """
    ship_package(vectors.sparkSession)
    rows = materialise(vectors, "vectors")
    schema = "block int, dim int, ids binary, points binary, kind string"

    def make(ids: np.ndarray, points: np.ndarray) -> dict:
        """Components travel as floats where that loses nothing."""
        short = points.astype(np.float32)
        sent = short if (short == points).all() else points
        return {"ids": ids.tobytes(), "points": sent.tobytes(), "kind": sent.dtype.str}

    data_rows, n_data = numbered_blocks(rows, DATA_ROWS)
    query_rows, n_query = numbered_blocks(rows.where(is_query), QUERY_ROWS)
    data = materialise(packed(data_rows, make, schema), "data-blocks")
    queries = packed(query_rows, make, schema)
    if not n_query:
        return best_of(vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double"), k)
    spread = data.select("dim", F.col("block").alias("d_block"), F.col("ids").alias("d_ids"), F.col("points").alias("d_points"), F.col("kind").alias("d_kind")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)))
    )
    met = queries.join(spread, ["block", "dim"])
    # A query block's tiles are dealt to several tasks, and stand together there.
    lanes = max(1, min(n_data, 64))
    met = met.withColumn("lane", F.pmod(F.xxhash64("d_block"), F.lit(lanes))).repartition("block", "lane").sortWithinPartitions("block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heaps, q = None, None, None
        for batch in batches:
            for row in range(len(batch)):
                c = {n: batch.column(n)[row] for n in batch.schema.names}
                dim = c["dim"].as_py()
                if c["block"].as_py() != at:
                    if heaps:
                        yield from heaps.found()
                    at = c["block"].as_py()
                    q_ids = np.frombuffer(c["ids"].as_buffer(), np.int64)
                    q, heaps = matrix(c["points"], c["kind"], dim), Heaps(q_ids, k)
                d_ids = np.frombuffer(c["d_ids"].as_buffer(), np.int64)
                d = matrix(c["d_points"], c["d_kind"], dim)
                tile(q, heaps.ids, d, d_ids, heaps, quantise(d))
        if heaps:
            yield from heaps.found()

    return best_of(arrow_map(met, work, "query_id long, vec_id long, score double"), k)


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's search over original vectors in double precision.

    Defined cases: vectors that are null, zero or hold a null or non-finite
    component take no part; an id in several rows counts once, with its least
    vector; vectors of different lengths never meet; a query with fewer
    candidates gets them all; a score beyond the range of a double is infinite,
    or no number where infinities of both signs meet, and then comes first; an
    empty table gives an empty result.
    """
    return nearest(clean_vectors(embeddings, zero_ok=False), f"vec_id % {QUERY_EVERY} = 0")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.w) = len(q.w) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
