"""Exact top-k inner products by the threshold algorithm, in blocks.

Vectors and queries are dealt at random to blocks of bounded size; every pair of a query block and a
vector block is one group of a cogrouped job, so that no task holds more than two blocks however many
queries there are. A task sorts each dimension of its vectors once. For each query it reads these lists
from the end that its component favours, in steps that double, scores each newly seen vector in full, and
stops when the score of a vector made of the last read components cannot reach its k-th result. Results
of the blocks are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_VECTORS, BLOCK_QUERIES = 2048, 1024
FIRST_STEP = 32


def quantised(vector: str | Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component as bigint; null if the vector or a component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(x * scale)))


def threshold_search(
    vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int | None, k: int, ranked: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the ``k`` best rows (ties: smaller id) and the number of rows looked at.

    ``ranked[d]`` are the row numbers in ascending order of dimension ``d``. Rows whose id is ``own`` are left out.
    """
    n = len(vectors)
    down, up = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    weights = np.concatenate((query[down], query[up])).astype(np.int64)
    dims = np.concatenate((down, up))
    unseen = np.ones(n, bool)
    best_ids, best_scores = np.empty(0, np.int64), np.empty(0, vectors.dtype)
    depth, step = 0, FIRST_STEP
    while True:
        stop = min(n, depth + step) if len(dims) else n
        fresh = np.full(n, not len(dims))
        fresh[ranked[down, n - stop : n - depth]] = True
        fresh[ranked[up, depth:stop]] = True
        rows = np.flatnonzero(fresh & unseen)
        unseen[rows] = False
        scores = vectors[rows] @ query
        keep = ids[rows] != own if own is not None else np.ones(len(rows), bool)
        if len(best_scores) == k:
            keep &= scores >= best_scores[-1]
        best_ids = np.concatenate((best_ids, ids[rows[keep]]))
        best_scores = np.concatenate((best_scores, scores[keep]))
        order = np.lexsort((best_ids, -best_scores))[:k]
        best_ids, best_scores = best_ids[order], best_scores[order]
        if stop == n:
            break
        last = np.concatenate((ranked[down, n - stop], ranked[up, stop - 1]))
        bound = int((vectors[last, dims].astype(np.int64) * weights).sum())
        # an unseen row may tie with the k-th result and have a smaller id: only a smaller bound ends the search
        if len(best_scores) == k and bound < best_scores[-1]:
            break
        depth, step = stop, step * 2
    return best_ids, best_scores, int(n - unseen.sum())


def exact_type(vectors: np.ndarray, queries: np.ndarray) -> type:
    """Smallest type in which every partial inner product is exact, by the product of the largest norms."""
    most = 1.0
    for part in (vectors, queries):
        most *= float(np.sqrt((part.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) + 1
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _search(k: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple[int, int, int]] = []
    blocks = dict(list(right.groupby(right["v"].map(len)))) if len(right) else {}
    for dims, queries in left.groupby(left["v"].map(len)) if len(left) else ():
        if dims not in blocks:
            continue
        block = blocks[dims]
        v, q = (np.array(x["v"].tolist(), dtype=np.int64).reshape(len(x), dims) for x in (block, queries))
        kind = exact_type(v, q)
        v, q, ids = v.astype(kind), q.astype(kind), block["id"].to_numpy(np.int64)
        ranked = np.argsort(v.T, axis=1, kind="stable") if dims else np.empty((0, len(v)), np.int64)
        for own, query in zip(queries["id"].to_numpy(np.int64), q):
            found, scores, _ = threshold_search(v, ids, query, int(own), k, ranked)
            out += [(int(own), int(i), int(s)) for i, s in zip(found, scores)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024,
    block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vectors`` for every row of ``queries``.

    A row whose key equals the query's is no candidate; fewer candidates give fewer rows. Rows with a
    null key, and vectors that are null or hold a null or a component that is not finite, take no part;
    vectors of different lengths do not meet. Rows that repeat a key are candidates each; a query that is
    repeated is one query. Other columns are not read.
    """
    def read(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("bigint").alias("id"), quantised(vector, scale).alias("v"))
        return rows.where("id is not null and v is not null")

    candidates, asked = read(vectors), read(queries).distinct()
    nv = max(1, -(-candidates.count() // block_vectors))
    nq = max(1, -(-asked.count() // block_queries))
    salted = F.xxhash64("id", "v")
    left = asked.withColumns({"qb": F.pmod(salted, F.lit(nq)), "vb": F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))})
    # rows are dealt by place, so that copies of one row spread over blocks
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(nv)).cast("int")
    right = candidates.withColumn("vb", dealt).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))))
    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(
        lambda a, b: _search(k, a, b), "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
