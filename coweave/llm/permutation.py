"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order.  Every shard of the
rows posts its vectors in pivot inverted files (pivot -> rows that have it,
with its place in their order).  A query adds up, over its own pivots' files,
what two orders that share a pivot save of the footrule distance, keeps the
best part of the shard by that distance, and reranks it with exact inner
products in double precision.

Nearness is the inner product, which prefers long vectors, so rows and pivots
get one coordinate more that fills them up to a common norm M, and queries a
zero there: the order by angle is then the order by inner product.  M is a
high percentile of the shard's norms; the few longer rows are always reranked,
so that one huge vector does not make all others look alike.

Queries come in blocks; a block meets every shard once, as one co-grouped
task with bounded blocks on both sides, and leaves its k best per shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PIVOTS = 512             # bounded sample of the vectors
PREFIX = 96              # nearest pivots kept of each vector
RERANK_SHARE = 0.08      # part of a shard that is reranked, at least RERANK_LEAST
RERANK_LEAST = 256
LONG_SHARE = 0.02        # longest rows of a shard, always reranked
SHARD_ROWS = 8_192
QUERY_ROWS = 16_384


def _valid(embedding: Column) -> Column:
    """Vectors that take part: not null, all components finite, one not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def filled_up(x: np.ndarray, norm: float) -> np.ndarray:
    """The rows with a coordinate more, so that each has length ``norm``;
    longer ones are shortened to it."""
    long = np.linalg.norm(x, axis=1)
    x = x * np.minimum(1.0, norm / long)[:, None]
    return np.hstack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0.0))[:, None]])


def pivot_orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots (largest product) of every row, in order."""
    near = -(x @ pivots.T)
    prefix = min(prefix, len(pivots))
    some = np.argpartition(near, prefix - 1, axis=1)[:, :prefix]
    o = np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, o, axis=1)


class InvertedFiles:
    """Per pivot: the rows that hold it and what meeting it there saves."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        n, self.prefix = orders.shape
        self.rows_total = n
        flat = orders.ravel()
        o = np.argsort(flat, kind="stable")
        self.rows, self.places = o // self.prefix, o % self.prefix
        self.bounds = np.searchsorted(flat[o], np.arange(n_pivots + 1))

    def saved(self, order: np.ndarray) -> np.ndarray:
        """Of every row, what shared pivots save of the footrule distance of
        two orders without a common pivot: with a pivot at places p and q of
        ``prefix`` m, (m - p) + (m - q) - |p - q| = 2 (m - max(p, q))."""
        acc = np.zeros(self.rows_total, np.int32)
        for place, pivot in enumerate(order.tolist()):
            lo, hi = self.bounds[pivot], self.bounds[pivot + 1]
            acc[self.rows[lo:hi]] += 2 * (self.prefix - np.maximum(self.places[lo:hi], place)).astype(np.int32)
        return acc


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, n_pivots: int = PIVOTS,
            prefix: int = PREFIX, rerank_share: float = RERANK_SHARE, seed: int = 42,
            shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``embeddings``
    (vec_id, embedding) with ``is_query``, the ``k`` nearest rows found by
    largest inner product, nearest first, ties to the smaller vec_id.  A query
    is not its own neighbour.

    Vectors that are null, zero or hold null or non-finite components take no
    part, rows without vec_id neither.  Every row is a candidate; rows that are
    equal in vec_id and vector count once, rows that share a vec_id and differ
    are each a candidate (and a query).  Only vectors of one length are
    compared.  Where fewer than ``k`` candidates exist, all are returned; an
    empty table gives none.  Pivots are at most ``n_pivots`` vectors, least
    hash of vec_id first; every row is indexed.
    """
    rows = (embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                              F.col("embedding").cast("array<double>").alias("x"),
                              is_query.alias("q"))
            .where(F.col("vec_id").isNotNull() & _valid(F.col("x")))
            .groupBy("vec_id", "x").agg(F.max("q").alias("q")))
    # written, so that ``uid`` is a row's own on both sides below
    rows = cut_lineage(rows.select("vec_id", "x", "q", F.size("x").alias("dim"),
                                   F.monotonically_increasing_id().alias("uid")))
    total, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    spark = embeddings.sparkSession
    fields = "query bigint, query_id bigint, vec_id bigint, score double"
    if not n_queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = (rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "x").limit(n_pivots)
              .select("x", "dim").collect())
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["x"])
    pivots = {d: np.array(x) for d, x in by_dim.items()}       # n_pivots vectors at most

    shards, blocks = 1 + total // shard_rows, 1 + n_queries // query_rows
    spread = lambda n, s: F.pmod(F.xxhash64("uid", F.lit(s)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    left = rows.where("q").select("uid", "vec_id", "x", "dim", spread(blocks, 1).alias("block"),
                                  every(shards).alias("shard"))
    right = rows.select("uid", "vec_id", "x", "dim", every(blocks).alias("block"),
                        spread(shards, 2).alias("shard"))

    def search(queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not queries.num_rows or not shard.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()),
                             "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        shard = shard.sort_by("vec_id")                        # ties: smaller ids first
        ids, uids, x = shard["vec_id"].to_numpy(), shard["uid"].to_numpy(), _matrix(shard["x"])
        q_ids, q_uids, q = queries["vec_id"].to_numpy(), queries["uid"].to_numpy(), _matrix(queries["x"])
        found: list[tuple] = []
        known = pivots.get(x.shape[1])
        some = max(RERANK_LEAST, int(np.ceil(rerank_share * len(ids)))) + k
        ranked = known is not None and some < len(ids)
        if ranked:
            norms = np.linalg.norm(x, axis=1)
            norm = float(np.quantile(norms, 1 - LONG_SHARE, method="higher"))
            long = np.flatnonzero(norms > norm)
            near = filled_up(known, norm)
            files = InvertedFiles(pivot_orders(filled_up(x, norm), near, prefix), len(known))
            orders = pivot_orders(q, near[:, :-1], prefix)     # a query's last coordinate is zero
        for n, (query, query_id, vector) in enumerate(zip(q_uids.tolist(), q_ids.tolist(), q)):
            rows = np.arange(len(ids))
            if ranked:
                saved = files.saved(orders[n])
                # largest saving first, then smaller id; exact, whatever ties
                worth = saved.astype(np.int64) * len(ids) - rows
                rows = np.union1d(np.argpartition(-worth, some)[:some], long)
            scores = np.einsum("ij,j->i", x[rows], vector)
            others = uids[rows] != query
            rows, scores = rows[others], scores[others]
            best = np.lexsort((ids[rows], -scores))[:k]
            found.append((np.full(len(best), query), np.full(len(best), query_id), ids[rows[best]], scores[best]))
        cols = [np.concatenate(c) for c in zip(*found)]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("query", "query_id", "vec_id", "score"), cols, types)})

    keys = ["block", "shard", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, fields)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
