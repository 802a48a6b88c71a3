"""Exact top-k search by tiled matrix products.

Queries are dealt into blocks and candidates into shards of bounded size, by
position, so that no id or repeated vector can fill one tile. Every (block,
shard) pair is one tile: one matrix product, from which each query keeps its
k best. These lists are merged as a tree, ``fan`` shards at a time, and only
lists of k entries travel. Scores are integer inner products of floored,
scaled vectors; products run in double precision where every partial sum stays
below 2^53, in 64-bit integers where it stays below 2^63, and in integers of any
length otherwise. A score that no long can hold is an error, never a wrong
number. Ties go to the smaller id.

Vectors that are null or hold null or non-finite components take no part, nor
do rows without an id.
Vectors of another length than the query meet none of its candidates: each
length is searched for itself. Of queries with the same id the smallest vector
counts; repeated candidates each count as a row. A query has all its
candidates where there are fewer than k, and no row where there are none.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, materialise


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    scale: int = 64
    block_rows: int = 2048
    shard_rows: int = 8192
    fan: int = 16


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """_id, _v (floored scaled components, as doubles: no long need hold them) of the rows that take part."""
    v = F.col("_x")
    # From 2^53 on, doubles are whole.
    floored = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_x")).filter(F.col("_id").isNotNull() & v.isNotNull() & fit)
    return kept.select(F.col("_id").cast("long").alias("_id"), F.transform("_x", lambda x: floored(x.cast("double") * scale)).alias("_v"))


def select_best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) positions of each row's k best; columns are in ascending id order, so ties fall to the left."""
    n = score.shape[1]
    if n <= k:
        keep = np.broadcast_to(np.arange(n), score.shape)
        return np.repeat(np.arange(len(score)), n), keep.ravel()
    edge = np.partition(score, n - k, axis=1)[:, n - k]
    above, level = score > edge[:, None], score == edge[:, None]
    room = k - above.sum(1, keepdims=True)
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))


def tile_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of q and c, both whole numbers as doubles or integers."""
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if bound < 2.0**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2.0**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda a: np.array([[int(x) for x in row] for row in a.tolist()], dtype=object).reshape(a.shape)
    out = whole(q) @ whole(c).T
    if (abs(out) >= 1 << 63).any():
        raise ValueError("a score leaves the range of long: scale the vectors down")
    return out.astype(np.int64)


def top_k(queries: DataFrame, candidates: DataFrame, params: TopKParams = TopKParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of each query's best candidates other than its own rows."""
    q = integer_vectors(queries, id_col, vector_col, params.scale).groupBy("_id").agg(F.min("_v").alias("_v"))
    q = materialise(q, "topk-queries")
    c = integer_vectors(candidates, id_col, vector_col, params.scale)
    blocks = buckets_for(q.count(), params.block_rows)
    shards = buckets_for(candidates.count(), params.shard_rows)
    dealt = lambda df, n: df.withColumn("_at", (F.monotonically_increasing_id() % n + F.shiftrightunsigned(F.monotonically_increasing_id(), 33)) % n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt(q, blocks).select(F.col("_at").cast("int").alias("block"), every(shards).alias("shard"), "_id", "_v", F.lit(True).alias("_query"))
    right = dealt(c, shards).select(every(blocks).alias("block"), F.col("_at").cast("int").alias("shard"), "_id", "_v", F.lit(False).alias("_query"))

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            is_query = b.column(4).to_numpy(zero_copy_only=False)
            ids, lists = b.column(2).to_numpy(zero_copy_only=False), b.column(3)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            width = np.diff(offsets)
            for w in np.unique(width).tolist():
                for side in (True, False):
                    at = np.flatnonzero((width == w) & (is_query == side))
                    if len(at):
                        sides.setdefault((w, side), []).append((ids[at], flat[offsets[at][:, None] + np.arange(w)].reshape(len(at), w)))
        for w in {w for w, side in sides if side}:
            if (w, False) not in sides:
                continue
            qi, qv = (np.concatenate(x) for x in zip(*sides[w, True], strict=True))
            ci, cv = (np.concatenate(x) for x in zip(*sides[w, False], strict=True))
            order = np.argsort(ci, kind="stable")
            ci, cv = ci[order], cv[order]
            lowest = np.iinfo(np.int64).min
            for at in range(0, len(qi), 512):
                ids = qi[at : at + 512]
                s = tile_scores(qv[at : at + 512], cv)
                own_from, own_to = np.searchsorted(ci, ids, "left"), np.searchsorted(ci, ids, "right")
                own = np.zeros(s.shape, bool)
                for r in np.flatnonzero(own_to > own_from):
                    own[r, own_from[r] : own_to[r]] = True
                s[own] = lowest
                row, col = select_best(s, ci, params.k)
                ok = ~own[row, col]
                row, col = row[ok], col[ok]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), key[1].as_py(), np.int32)), pa.array(ids[row]), pa.array(ci[col]), pa.array(s[row, col])], names=["shard", "query_id", "vec_id", "score"])

    lists = left.unionByName(right).groupBy("block", "shard").applyInArrow(tile, "shard int, query_id long, vec_id long, score long")

    def merged(df: DataFrame, by: list[Column]) -> DataFrame:
        """The k best of every group, as one sorted list."""
        entry = F.struct((-F.col("score")).alias("down"), F.col("vec_id"))
        return df.groupBy(*by, "query_id").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, params.k).alias("best"))

    opened = lambda df, *keep: df.select(*keep, "query_id", F.explode("best").alias("e")).select(*keep, "query_id", F.col("e.vec_id").alias("vec_id"), (-F.col("e.down")).alias("score"))
    while shards > params.fan:
        # Each level takes at most fan * k entries a query.
        lists = opened(merged(lists.withColumn("shard", (F.col("shard") / params.fan).cast("int")), [F.col("shard")]), "shard")
        shards = -(-shards // params.fan)
    best = merged(lists, [])
    return best.select("query_id", F.posexplode("best").alias("pos", "e")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias(id_col), (-F.col("e.down")).alias("score"))
