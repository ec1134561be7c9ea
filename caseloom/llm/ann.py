"""Nearest neighbours by cosine: a block matrix join on int8 tiles with error bounds.

Queries and candidates are cut into blocks by a hash of their id. Each pair of
blocks is one tile: an int8 product gives every cosine within a bound on its
quantisation error; a candidate whose upper bound is below a query's k-th best
lower bound is out; the rest are recomputed from the original vectors in double
precision and kept in one heap per query. The tiles' heaps are merged per query.
The bounds are strict, so the answer is exact (recall 1).

Vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows with a null id. A vector is compared with those of its own length
only. Rows that repeat an id are candidates each; a query never returns its own id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 4096
CHUNK = 1024

COLUMNS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows (vec_id, v) whose vector can be compared."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull())
    return rows.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, and the length of each rounding error."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    code = np.rint(unit / scale).astype(np.int8)
    error = np.sqrt(((unit - code * scale) ** 2).sum(axis=1))
    return code, scale[:, 0], error


def ordered_sum(x: np.ndarray) -> np.ndarray:
    """Row sums added from left to right, so that equal rows give equal sums."""
    return np.cumsum(x, axis=1)[:, -1]


def tile_nearest(q_id, q, c_id, c, k: int) -> list[tuple[int, int, float]]:
    """The k nearest candidates of each query in one tile."""
    q_square, c_square = ordered_sum(q * q), ordered_sum(c * c)
    # components from 1e-150 to 1e150 square within the range of doubles; others are scaled first
    q_unit = q / np.abs(q).max(axis=1, keepdims=True)
    c_unit = c / np.abs(c).max(axis=1, keepdims=True)
    q_unit /= np.sqrt((q_unit**2).sum(axis=1, keepdims=True))
    c_unit /= np.sqrt((c_unit**2).sum(axis=1, keepdims=True))
    q_code, q_scale, q_error = quantised(q_unit)
    c_code, c_scale, c_error = quantised(c_unit)
    exact32 = q.shape[1] <= 1000
    wide = np.float32 if exact32 else np.float64
    floor = np.full(len(q), -np.inf)
    heaps: list[list] = [[] for _ in q_id]
    for low in range(0, len(c), CHUNK):
        part = slice(low, low + CHUNK)
        product = (q_code.astype(wide) @ c_code[part].astype(wide).T).astype(np.float64)
        about = product * q_scale[:, None] * c_scale[None, part]
        bound = q_error[:, None] + (1 + q_error[:, None]) * c_error[None, part] + 1e-9
        about[q_id[:, None] == c_id[None, part]] = -np.inf
        lower = about - bound
        if lower.shape[1] >= k:
            floor = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
        i, j = np.nonzero(about + bound >= np.maximum(floor, -2)[:, None])
        if not len(i):
            continue
        at = j + low
        norm = q_square[i] * c_square[at]
        score = ordered_sum(q[i] * c[at]) / np.sqrt(norm)
        odd = ~((norm > 1e-280) & (norm < 1e280))
        if odd.any():
            score[odd] = ordered_sum(q_unit[i[odd]] * c_unit[at[odd]])
        score = np.clip(score, -1.0, 1.0)
        for a, s, b in zip(i.tolist(), score.tolist(), c_id[at].tolist(), strict=True):
            heap = heaps[a]
            if len(heap) < k:
                heapq.heappush(heap, (s, -b))
            elif (s, -b) > heap[0]:
                heapq.heapreplace(heap, (s, -b))
        full = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        floor = np.maximum(floor, full - 1e-9)
    return [(int(a), -b, s) for a, heap in zip(q_id, heaps, strict=True) for s, b in heap]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE) -> DataFrame:
    """Each query's k nearest vectors: query_id, rank, vec_id, score; ties to the smaller id."""
    c, q = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    c_blocks = max(1, -(-vectors.count() // tile))
    q_blocks = max(1, -(-queries.count() // tile))
    c = c.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks)))
    q = q.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)))
    c = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<long>")))
    q = q.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)).cast("array<long>")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, part in left.groupby(left["v"].str.len()):
            others = right[right["v"].str.len() == size]
            if len(others):
                out += tile_nearest(
                    part["vec_id"].to_numpy(), np.stack(part["v"].to_list()), others["vec_id"].to_numpy(), np.stack(others["v"].to_list()), k
                )
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInPandas(run, COLUMNS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
