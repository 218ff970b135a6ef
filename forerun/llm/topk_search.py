"""Exact top-k inner-product search by MaxScore over quantised vectors.

A component is a query term; its posting list is a column of a shard. Contributions are shifted so that none is
negative, terms are ordered by their score bound, and the terms whose bounds together cannot reach the current k-th
score are non-essential: only vectors with a positive part on an essential term are candidates, and the others' terms
are probed, highest bound first, only while a candidate can still get into the results. Each (query block, shard) pair
is one task; the shards' lists are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Vectors in a shard and queries in a block.
SHARD_ROWS, BLOCK_ROWS = 16384, 4096
#: Vectors scored in full to get a first threshold, and non-essential terms probed between two prunings.
SEED_ROWS, PROBE_TERMS = 256, 8
_EXACT = 2.0**53
#: The range of a component and of a score.
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def maxscore(query: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: int, k: int):
    """(rows, scores) of the k best rows of one shard for one query; ``columns`` is term-major, ``ids`` ascending."""
    n = columns.shape[1]
    ends = np.stack((query * low, query * high))
    base, bound = ends.min(0), ends.max(0)
    spread = bound - base
    order = np.argsort(-spread, kind="stable")
    rest = np.concatenate((np.cumsum(spread[order][::-1])[::-1], [0]))
    floor = base.sum()
    mine = ids == own
    theta = -np.inf
    if n > max(SEED_ROWS, 4 * k):
        seed = query @ columns[:, :SEED_ROWS]
        seed[mine[:SEED_ROWS]] = -np.inf
        theta = np.partition(seed, -k)[-k]
    # essential: the fewest leading terms after which the rest's bounds cannot reach theta alone
    essential = int(np.searchsorted(-(rest + floor), -theta, side="right"))
    head = order[: max(1, min(essential, len(order)))]
    part = query[head] @ columns[head] - base[head].sum()
    at = len(head)
    rows = np.flatnonzero((part > 0) & ~mine) if floor + rest[at] < theta else np.flatnonzero(~mine)
    part = part[rows]
    while True:
        if len(rows) > 4 * k and n > SEED_ROWS:
            # a row's lower bound is its part alone; the k-th of those is a threshold too
            theta = max(theta, floor + np.partition(part, -k)[-k])
        alive = part + rest[at] + floor >= theta
        rows, part = rows[alive], part[alive]
        if at == len(order) or not len(rows):
            break
        probe = order[at : at + PROBE_TERMS]
        part = part + query[probe] @ columns[np.ix_(probe, rows)] - base[probe].sum()
        at += len(probe)
    score = part + floor
    best = np.lexsort((ids[rows], -score))[:k]
    return rows[best], score[best]


def _search_pair(k: int):
    def search(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.int64)})
        if not len(queries) or not len(shard):
            return empty
        out = []
        width = max(shard["terms"].map(len).max(), queries["terms"].map(len).max())

        def matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            frame = frame.assign(key=frame["terms"].map(tuple)).sort_values(["vec_id", "key"])
            rows = np.zeros((len(frame), width), dtype=np.int64)
            for i, terms in enumerate(frame["terms"]):
                rows[i, : len(terms)] = terms
            return frame["vec_id"].to_numpy(np.int64), rows

        q_ids, q = matrix(queries)
        ids, x = matrix(shard)
        peak = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1)
        kind = np.float64 if peak < _EXACT else object  # object: Python's whole numbers, exact at any size
        columns = np.ascontiguousarray(x.T).astype(kind)
        low, high = columns.min(1), columns.max(1)
        for query_id, query in zip(q_ids, q.astype(kind)):
            if kind is object:
                score = np.clip(query @ columns, _LEAST, _MOST)
                rows = [r for r in sorted(range(len(ids)), key=lambda r: (-score[r], ids[r])) if ids[r] != query_id][:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows], "score": [int(score[r]) for r in rows]}))
                continue
            rows, score = maxscore(query, columns, low, high, ids, query_id, k)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows], "score": score.astype(np.int64)}))
        return pd.concat(out, ignore_index=True) if out else empty

    return search


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows by integer inner product, ties to smaller ids.

    Null vectors, and vectors holding null or non-finite components, take no part. Missing trailing components count
    as 0; an empty vector scores 0 with all. Rows that repeat an id are candidates each, but never of their own id; of a
    query id with several vectors all pairs are ranked together. Rows without an id are left out. Components and scores
    beyond 64 bits count as the nearest 64-bit integer. No rows give no result; other columns are never read.
    """
    rows = (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))))
        .select("vec_id", quantised(F.col("v"), scale).alias("terms"))
    )
    queries = rows.where(is_query)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    # a stated query set against all rows: block by block, one (block, shard) pair a task
    left = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(_search_pair(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.t, c.t), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
