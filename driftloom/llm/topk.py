"""Exact top-k search by aggregation without random access, over blocks of candidates.

Each component of the candidates of a block is a list sorted by value, and their lengths are known. Lists are read
from the end that a query's own component favours, those of heavy components further: a list whose share of the
query's square is large enough is read whole, others in proportion to theirs. What has been read gives each
candidate a lower and an upper bound of its score. The first reading is of the heaviest lists, whole, for many queries
at once: it is a product of matrices. The candidates with the best lower bounds are resolved then, and the k-th of
their scores is a floor; bounds that do not reach it end most candidates. Others are read further. The rest of its components lie between the list's last value and
the last one read, and their product with the query's is at most that of what is left of both lengths. Candidates
whose upper bound is below the k-th best lower bound cannot qualify. Reading goes on, for those in sight alone,
until few are left; their scores are then resolved. Scores are whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
#: Rows of a block of candidates and of queries.
CANDIDATES, QUERIES = 16_384, 16_384
#: How far lists are read in each round, as multiples of a component's share of the query's square; the least part of a
#: list that is read; and the part of candidates that ends reading.
ROUNDS, LEAST, FEW = (1.0, 2.0, 4.0, 8.0), 1 / 16, 0.02
#: The share of a query's square whose lists the first reading reads, and the queries that it takes at once.
FIRST, AT_ONCE = 0.98, 64
#: Sums of products below this are exact in doubles; those beyond the second may wrap and are not bounded.
EXACT, WRAPS = 2.0**52, 2.0**62
RESULT = "query_id long, vec_id long, score long"


def quantised(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -(2.0**62), 2.0**62).astype(np.int64).reshape(-1, width)


def one_each(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id; of those that repeat an id, the one with the least vector."""
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], vectors[first]


class Lists:
    """The sorted lists of a block's candidates, by component."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = np.ascontiguousarray(x.T, dtype=np.float64)
        self.n = len(x)
        order = np.argsort(self.x, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.x, order, axis=1)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=np.int32)[None, :].repeat(len(order), 0), axis=1)
        self.squares = self.x * self.x
        self.lengths = self.squares.sum(axis=0)

    def bounds(self, q: np.ndarray, rows: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of rows, after lists were read as far as reach says."""
        weight = q * q
        parts = np.clip(reach * weight / max(weight.mean(), 1e-300), LEAST, 1.0)
        whole = (parts >= 1) & (q != 0)
        seen = q[whole] @ self.x[np.ix_(whole, rows)]
        left = self.lengths[rows] - self.squares[np.ix_(whole, rows)].sum(axis=0)
        most, least, unread = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
        for i in np.flatnonzero((parts < 1) & (q != 0)):
            depth = max(1, int(parts[i] * self.n))
            read = self.place[i, rows] >= self.n - depth if q[i] > 0 else self.place[i, rows] < depth
            last, worst = (self.sorted[i, self.n - depth], self.sorted[i, 0]) if q[i] > 0 else (self.sorted[i, depth - 1], self.sorted[i, -1])
            seen += np.where(read, q[i] * self.x[i, rows], 0.0)
            left -= np.where(read, self.squares[i, rows], 0.0)
            unread += np.where(read, 0.0, weight[i])
            most += np.where(read, 0.0, q[i] * last)
            least += np.where(read, 0.0, q[i] * worst)
        span = np.sqrt(unread * np.maximum(left, 0.0))
        slack = 1e-9 * (np.sqrt(weight.sum() * self.lengths[rows])) + 1e-6  # what rounding may take
        return seen + np.maximum(least, -span) - slack, seen + np.minimum(most, span) + slack

    def first_bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of all scores of many queries, after the lists that make FIRST of each query's square were read whole."""
        weight = q * q
        order = np.argsort(-weight, axis=1, kind="stable")
        ranked = np.take_along_axis(weight, order, axis=1)
        before = np.cumsum(ranked, axis=1) - ranked
        whole = np.zeros(q.shape, bool)
        np.put_along_axis(whole, order, before < FIRST * weight.sum(axis=1, keepdims=True), axis=1)
        rest = np.where(whole, 0.0, q)
        ends = rest[:, :, None] * self.sorted[:, [0, -1]]
        least, most = ends.min(axis=2).sum(axis=1, keepdims=True), ends.max(axis=2).sum(axis=1, keepdims=True)
        seen = np.where(whole, q, 0.0) @ self.x
        left = self.lengths - whole.astype(np.float64) @ self.squares
        span = np.sqrt((rest * rest).sum(axis=1, keepdims=True) * np.maximum(left + 1e-9 * self.lengths, 0.0))
        slack = 1e-9 * np.sqrt(weight.sum(axis=1, keepdims=True) * self.lengths) + 1e-6  # what rounding may take
        return seen + np.maximum(least, -span) - slack, seen + np.minimum(most, span) + slack

    def survivors(self, q: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Those of rows whose bounds allow a place among the k best."""
        for reach in ROUNDS:
            if len(rows) <= max(k, FEW * self.n):
                break
            lower, upper = self.bounds(q, rows, reach)
            rows = rows[upper >= np.partition(lower, len(rows) - k)[len(rows) - k]]
        return rows


def search(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, resolved: list[int] | None = None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """The k best candidates of each query (all, if fewer): query ids, candidate ids, scores.

    resolved: takes how many scores were worked out for each query. Sums that may wrap are all resolved.
    """
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if most < EXACT else np.int64
    exact_q, exact_x, lists = q.astype(kind), x.astype(kind), Lists(x) if most < WRAPS else None
    every, order = np.arange(len(x)), np.argsort(ids, kind="stable")
    out: tuple[list, list, list] = ([], [], [])
    for start in range(0, len(q), AT_ONCE):
        names, real = query_ids[start : start + AT_ONCE], q[start : start + AT_ONCE].astype(np.float64)
        lower, upper = lists.first_bounds(real) if lists else (None, None)
        begin, end = np.searchsorted(ids, names, sorter=order), np.searchsorted(ids, names, side="right", sorter=order)
        for i, (name, own) in enumerate(zip(names, exact_q[start : start + AT_ONCE], strict=True)):
            itself, tried = order[begin[i] : end[i]], 0
            if lists is None or len(x) - len(itself) <= k:
                some = every[ids != name]
            else:
                lower[i, itself] = upper[i, itself] = -np.inf
                tried = k
                floor = (exact_x[np.argpartition(lower[i], len(x) - k)[len(x) - k :]] @ own).min()
                some = np.flatnonzero(upper[i] >= floor)
                if len(some) > max(k, FEW * len(x)):
                    some = lists.survivors(real[i], some, k)
            if resolved is not None:
                resolved.append(len(some) + tried)
            scores = exact_x[some] @ own
            best = np.lexsort((ids[some], -scores))[:k]
            out[0].append(np.full(len(best), name))
            out[1].append(ids[some][best])
            out[2].append(scores[best].astype(np.int64))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products for each query, ties to the smaller vec_id.

    vectors, queries: (vec_id, embedding). Vectors that are null or hold null or non-finite components, and
    rows of a null vec_id, take no part; vectors of different lengths are not compared. Of rows that repeat a
    vec_id the one with the least vector counts. A query's own vec_id is no candidate. Components beyond 2^62
    after scaling saturate, and sums beyond 64 bits wrap. Without other vectors a query gives no row.
    """

    def sound(df: DataFrame) -> DataFrame:
        bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        return df.select("vec_id", "embedding", F.size("embedding").alias("width")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)

    rows, asked = sound(vectors), sound(queries)
    n_candidates, n_queries = vectors.count(), queries.count()
    c_blocks, q_blocks = max(1, math.ceil(n_candidates / CANDIDATES)), max(1, math.ceil(n_queries / QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q_block", block(q_blocks)).withColumn("c_block", every(c_blocks))
    right = rows.withColumn("c_block", block(c_blocks)).withColumn("q_block", every(q_blocks))
    key = ["width", "q_block", "c_block"]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        width = key[0].as_py()
        if not a.num_rows or not b.num_rows or not width:
            return pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        q = one_each(a.column("vec_id").to_numpy(), quantised(a.column("embedding"), width))
        x = one_each(b.column("vec_id").to_numpy(), quantised(b.column("embedding"), width))
        return pa.table([np.concatenate(c).astype(np.int64) for c in search(*q, *x, k)], names=["query_id", "vec_id", "score"])

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
