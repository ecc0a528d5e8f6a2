"""Exact top-k by inner product, pruned by segment statistics from coarse to fine.

Vectors are cut into segments. With the mean m and deviation s of each segment of length L, the inner product of two vectors is at most
the sum of L * (m1 * m2 + s1 * s2) over the segments (Cauchy-Schwarz on what deviates from the means); with the vectors' lengths, that
bounds their distance from below. Few long segments give a cheap bound, more and shorter ones a tighter one. Each task keeps the
best ``k`` candidates of every query so far; candidates whose bound at one level falls short of a query's k-th score are dropped before the
next level, and only the rest are multiplied out.

Queries go round in blocks of bounded size, broadcast one after the other; each block passes over all candidates, and tasks send
``k`` rows per query. Vectors that are null or hold null or non-finite components take no part. Vectors of other dimension than the
query's are no candidates. Rows with the query's id are its own. A query row that is repeated is answered once per row.
Components become floor(1024 * x); scores beyond a long are set to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from editlore.llm import common

K = 10
EVERY = 100
SCALE = 1024
BLOCK = 4_096  # queries of one block
LEVELS = (4, 8, 16)
DENSE = 0.2  # share of pairs from which a level is computed as one product


class Level:
    """Vectors as (root of length * mean, root of length * deviation) of each segment: products of these bound inner products."""

    def __init__(self, vectors: np.ndarray, segments: int):
        parts = np.array_split(vectors, min(segments, vectors.shape[1]), axis=1)
        root = np.sqrt([p.shape[1] for p in parts])
        self.rows = np.column_stack([np.column_stack([p.mean(axis=1) for p in parts]) * root, np.column_stack([p.std(axis=1) for p in parts]) * root])


class Block:
    """Queries of one dimension with the best candidates seen so far."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int):
        self.vectors, self.ids, self.k = vectors, ids, k
        self.levels = [Level(vectors, s) for s in LEVELS if s < vectors.shape[1]]
        self.length = np.sqrt((vectors ** 2).sum(axis=1))
        self.most = np.abs(vectors).max(initial=0)
        self.query, self.score, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def offer(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        slack = 1e-9 * self.length[:, None] * np.sqrt((vectors ** 2).sum(axis=1))[None, :] + 1e-6
        q = c = None
        if not np.isfinite(self.least).any():
            q, c = (x.ravel() for x in np.indices((len(self.ids), len(ids))))
        else:
            for level in self.levels:
                other = Level(vectors, level.rows.shape[1] // 2).rows
                if q is None or len(q) > DENSE * slack.size:
                    bound = level.rows @ other.T + slack
                    keep = bound >= self.least[:, None]
                    if q is not None:
                        some = np.zeros_like(keep)
                        some[q, c] = True
                        keep &= some
                    q, c = np.nonzero(keep)
                else:
                    keep = np.einsum("ij,ij->i", level.rows[q], other[c]) + slack[q, c] >= self.least[q]
                    q, c = q[keep], c[keep]
            if q is None:
                q, c = (x.ravel() for x in np.indices((len(self.ids), len(ids))))
        own = self.ids[q] == ids[c]
        q, c = q[~own], c[~own]
        self._keep(q, self._exact(q, c, vectors), ids[c])

    def _exact(self, q: np.ndarray, c: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        if max(self.most, np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1] < 2 ** 53:
            if len(q) > DENSE * len(self.ids) * len(vectors):
                return (self.vectors @ vectors.T)[q, c].astype(np.int64)
            return np.einsum("ij,ij->i", self.vectors[q], vectors[c]).astype(np.int64)
        # Beyond the exact range of doubles: whole numbers of any size.
        low, high = -2 ** 63, 2 ** 63 - 1
        return np.array([min(high, max(low, sum(int(x) * int(y) for x, y in zip(self.vectors[i], vectors[j])))) for i, j in zip(q.tolist(), c.tolist())], np.int64)

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.concatenate([self.query, q]), np.concatenate([self.score, score]), np.concatenate([self.found, ids])
        order = np.lexsort((ids, -score.astype(np.float64) if len(score) and np.abs(score).max() < 2 ** 53 else ~score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        self.query, self.score, self.found = q[keep], score[keep], ids[keep]
        full = rank[keep] == self.k - 1
        self.least[self.query[full]] = self.score[full]


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    ok = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * SCALE) < F.lit(float("inf"))))
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ok & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best candidates of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    usable = _usable(vectors, key, vector)
    results = None
    held: list[tuple[int, list[float]]] = []
    number = 0

    def flush():
        nonlocal results, held, number
        found = common.stored(_pass(usable, held, k, number))
        number += len(held)
        results = found if results is None else results.unionByName(found)
        held = []

    for row in usable.filter(F.col("vec_id") % every == 0).toLocalIterator():
        held.append((row.vec_id, row.x))
        if len(held) >= block:
            flush()
    if held:
        flush()
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return results.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(usable: DataFrame, queries: list[tuple[int, list[float]]], k: int, number: int) -> DataFrame:
    shared = usable.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[Block, np.ndarray]] = {}
        for dimension in {len(x) for _, x in shared.value}:
            rows = np.array([i for i, (_, x) in enumerate(shared.value) if len(x) == dimension])
            blocks[dimension] = Block(np.array([shared.value[i][1] for i in rows]), np.array([shared.value[i][0] for i in rows]), k), rows
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                part = batch.slice(at, 2_000)
                lists, ids = part.column(1), part.column(0).to_numpy()
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                for dimension in set(size.tolist()) & set(blocks):
                    ok = size == dimension
                    blocks[dimension][0].offer(flat[np.repeat(ok, size)].reshape(-1, dimension), ids[ok])
        for found, rows in blocks.values():
            yield pa.RecordBatch.from_pydict({"query": rows[found.query] + number, "query_id": found.ids[found.query], "vec_id": found.found, "score": found.score})

    return usable.mapInArrow(search, "query long, query_id long, vec_id long, score long")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
