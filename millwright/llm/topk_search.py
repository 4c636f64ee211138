"""Operator 4: exact top-k search with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; from the mean and deviation of every segment follows a
lower bound of the distance of two vectors,

    d(q, x)^2 >= sum over segments of length * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2),

which for inner products reads as an upper bound of the score, (|q|^2 + |x|^2 - d^2) / 2.  Blocks
of queries meet blocks of rows; bounds are taken coarse to fine against each query's k-th best
score so far, and only the survivors' exact scores are computed.  Every block returns at most k
rows per query, and a ranked window merges them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import by_block
from .common import partitions, settled
from .crosspoly import _vectors

SEGMENTS = (1, 4, 16)
ROW_BLOCK = 1 << 15
SMALL_BLOCK = 1 << 12                            # the fewest rows that are worth a block of their own
QUERY_BLOCK = 1024
STEP = 1024


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a dot product is the score's bound."""
    n, d = x.shape
    parts = x.reshape(n, segments, d // segments)
    scale = math.sqrt(d // segments)
    return np.concatenate([parts.mean(2), parts.std(2)], axis=1) * scale


def _top(keys: np.ndarray, k: int) -> np.ndarray:
    """The k largest of every row, largest first."""
    return -np.sort(-np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:], axis=1)


def best_rows(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, row index, score) of each query's k best rows; ties go to the smaller id.

    The vectors hold integers; a query's own id is left out.  Scores beyond a long are clamped.
    """
    pad = (-x.shape[1]) % SEGMENTS[-1]
    q, x = (np.pad(m, ((0, 0), (0, pad))) for m in (q, x))
    rank = np.empty(len(x), np.int64)            # among the block's ids
    rank[np.argsort(x_ids, kind="stable")] = np.arange(len(x))
    place = len(x) + 1
    if np.abs(q).max() * np.abs(x).max() * x.shape[1] * place > 2.0 ** 52:
        return _best_rows_of_large_numbers(q, q_ids, x, x_ids, rank, k)
    by_norm = np.argsort(-(x * x).sum(1), kind="stable")
    none = np.iinfo(np.int64).min + 1
    best = np.full((len(q), k), none)            # keys: score * place - rank
    q_stats = [segment_statistics(q, s) for s in SEGMENTS]
    for a in range(0, len(x), STEP):
        cols, rows = by_norm[a:a + STEP], np.arange(len(q))
        kth = best[:, -1]
        least = np.where(kth == none, -np.inf, -((-kth) // place) - 1e-3)
        alive = q_ids[:, None] != x_ids[cols][None, :]
        for s, stats in zip(SEGMENTS, q_stats):
            alive &= stats[rows] @ segment_statistics(x[cols], s).T >= least[rows][:, None]
            some_r, some_c = alive.any(1), alive.any(0)
            rows, cols, alive = rows[some_r], cols[some_c], alive[np.ix_(some_r, some_c)]
            if not len(rows):
                break
        if len(rows):
            score = np.rint(q[rows] @ x[cols].T).astype(np.int64)
            key = np.where(alive, score * place - rank[cols][None, :], none)
            best[rows] = _top(np.concatenate([best[rows], key], axis=1), k)
    qi, slot = np.nonzero(best != none)
    key = best[qi, slot]
    score = -((-key) // place)
    return qi, np.argsort(rank)[score * place - key], score


def _best_rows_of_large_numbers(q, q_ids, x, x_ids, rank, k):
    """The same in Python integers, for components so large that doubles can't hold the scores."""
    out = []
    columns = [[int(v) for v in row] for row in x]
    for i, row in enumerate(q):
        values = [int(v) for v in row]
        scores = sorted(((-sum(a * b for a, b in zip(values, c)), rank[j], j) for j, c in enumerate(columns) if x_ids[j] != q_ids[i]))
        out += [(i, j, max(-2 ** 63, min(2 ** 63 - 1, -s))) for s, _, j in scores[:k]]
    return tuple(np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all rows.

    Vectors become floor(scale * x).  A vector that is null, empty or holds null or non-finite
    components takes no part, nor does a row without id.  Every row is a candidate for the queries
    of other ids, repeated rows as often as they occur; query rows that share an id are ranked as one
    query.  Vectors meet only those of their length; ties go to the smaller vec_id; fewer than k rows
    give all; no rows give no rows.
    """
    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter("vec_id is not null")
                .filter(F.coalesce(ok, F.lit(False))).withColumn("_size", F.size("embedding")))

    x, q = settled(clean(rows), "search-rows"), settled(clean(queries), "search-queries")
    n, ways = x.count(), partitions(rows.sparkSession)
    row_blocks = max(1, -(-n // ROW_BLOCK), min(ways, -(-n // SMALL_BLOCK)))
    query_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    part = lambda n: F.expr(f"pmod(xxhash64(vec_id, embedding, 3), {n})")
    dealt = (x.withColumn("_r", part(row_blocks)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("_query", F.lit(False))
             .unionByName(q.withColumn("_q", part(query_blocks)).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))).withColumn("_query", F.lit(True))
                          .select("vec_id", "embedding", "_size", "_r", "_q", "_query"), allowMissingColumns=False)
             .withColumn("_block", F.xxhash64("_size", "_r", "_q")))

    def search(block: pa.Table):
        is_query = block.column("_query").to_numpy()
        ids = block.column("vec_id").to_numpy()
        v = np.floor(scale * _vectors(block.column("embedding")))
        if not is_query.any() or is_query.all():
            return
        i, j, score = best_rows(v[is_query], ids[is_query], v[~is_query], ids[~is_query], k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[is_query][i]), pa.array(ids[~is_query][j]), pa.array(score)], ["query_id", "vec_id", "score"])

    found = by_block(dealt, "_block", search, "query_id long, vec_id long, score long", n=min(row_blocks * query_blocks, max(4 * ways, row_blocks)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
