"""Centroid clustering (Lloyd's rounds) with the dimensions cut into shards.

Vectors lie in chunks of rows, cut into blocks of columns; chunk and block together are one cell, and cells of one block lie together. A task
meets only the slices of the centroids that belong to its blocks: it computes, exactly and in whole numbers, the part of all squared
distances that its columns contribute. The parts of a chunk are added by its key, the least distance gives each vector's centroid, and per block the
vectors of each centroid are summed up, first within tasks. Each block's sums meet in one group of bounded size, which moves that block's
slice of the centroids. No task and no group holds all columns of the centroids, all vectors, or all distances.

What is broadcast are the slices, joined by block: ``k`` times the dimensions, checked against ``MOST_CELLS``.

Components become floor(scale * x) with x as a double, and those too large for exact sums (2**27 for 64 dimensions) become that limit. Vectors of another dimension,
null, or with null or non-finite components take no part; vectors without id do. Repeated rows are vectors of their own, also as starting centroids.
Equally near centroids: the smaller number. A centroid without vectors stays. Fewer vectors than ``k`` are fewer centroids; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from editlore.llm import common

K = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
BLOCK = 16  # columns of one shard
CHUNK_CELLS = 65_536  # vectors of one chunk times centroids
MOST_CELLS = 16_000_000  # components of all centroids
WAYS = 32  # groups that add a block's sums before the last one


def usable(vectors: DataFrame, dimensions: int, scale: int, key: str, vector: str) -> DataFrame:
    """vec_id and x, the whole numbers of the vectors that take part."""
    most = 2 ** ((61 - math.ceil(math.log2(dimensions))) // 2)
    ok = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(F.col(vector), lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), v.cast("double") * scale))))).cast("int"))
    return vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == dimensions) & ok).select(F.col(key).cast("long").alias("vec_id"), whole.alias("x"))


def _cells(points: DataFrame, dimensions: int, block: int, chunk: int) -> DataFrame:
    """chunk, block, ids (in the first block only), cells: the columns of one block of the vectors of one chunk."""
    blocks = range(0, dimensions, block)

    def run(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, len(batch), chunk):
                some = batch.slice(at, chunk)
                x = some.column(1).flatten().to_numpy().reshape(-1, dimensions)
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([part | number] * len(blocks), pa.int64()), "block": pa.array(range(len(blocks)), pa.int32()),
                    "ids": pa.array([some.column(0).to_pylist() if b == 0 else None for b in blocks], pa.list_(pa.int64())),
                    "cells": pa.array([np.ascontiguousarray(x[:, b:b + block], np.int32).tobytes() for b in blocks], pa.binary())})
                number += 1

    packed = points.select("vec_id", "x").mapInArrow(run, "chunk long, block int, ids array<long>, cells binary")
    return common.stored(packed.repartitionByRange(common.partitions(points.sparkSession), "block", "chunk"))


def _first_slices(points: DataFrame, k: int, dimensions: int, block: int, seed: int) -> DataFrame:
    """block, slice: the columns of one block of the starting centroids, in their order."""
    first = points.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(k)
    numbered = first.withColumn("number", F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x")))  # k rows
    parts = numbered.select("number", F.posexplode(F.array(*(F.slice("x", at + 1, min(block, dimensions - at)) for at in range(0, dimensions, block)))).alias("block", "part"))

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("number").to_pylist(), table.column("part").to_pylist()))
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "slice": pa.array([np.array([x for _, x in rows], np.int64).tobytes()], pa.binary())})

    return parts.groupBy("block").applyInArrow(gather, "block int, slice binary")


def _parts(cells: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """The cells with ``part``: what their columns add to the squared distances of their vectors from all centroids."""
    def run(batches):
        for batch in batches:
            parts = []
            for cell, piece in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                c = np.frombuffer(piece, np.int64).reshape(k, -1)
                x = np.frombuffer(cell, np.int32).reshape(-1, c.shape[1]).astype(np.int64)
                part = np.zeros((len(x), k), np.int64)
                for j in range(c.shape[1]):  # column by column, so that no third dimension is held
                    part += np.square(x[:, j, None] - c[None, :, j])
                parts.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(parts, pa.binary())], names=["chunk", "block", "ids", "cells", "part"])

    # Slices hold at most MOST_CELLS components in all.
    return cells.join(F.broadcast(slices), "block").select("chunk", "block", "ids", "cells", "slice").mapInArrow(
        run, "chunk long, block int, ids array<long>, cells binary, part binary")


def _nearest(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one chunk the nearest centroid and the squared distance of each vector: the parts of its blocks added up."""
    total = sum(np.frombuffer(p, np.int64) for p in table.column("part").to_pylist()).reshape(-1, k)
    near = total.argmin(axis=1)
    return near, total[np.arange(len(total)), near]


def _moved(cells: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """The slices after one round."""
    schema = pa.schema([("block", pa.int32()), ("way", pa.int32()), ("sums", pa.binary()), ("counts", pa.binary())])

    def rows(found: dict[int, tuple[np.ndarray, np.ndarray]], way: int):
        return [pa.array(list(found), pa.int32()), pa.array([way] * len(found), pa.int32()),
                pa.array([s.tobytes() for s, _ in found.values()], pa.binary()), pa.array([c.tobytes() for _, c in found.values()], pa.binary())]

    def sums(table: pa.Table) -> pa.Table:
        near, _ = _nearest(table, k)
        counts, found = np.bincount(near, minlength=k), {}
        for block, cell in zip(table.column("block").to_pylist(), table.column("cells").to_pylist()):
            x = np.frombuffer(cell, np.int32).reshape(len(near), -1)
            total = np.zeros((k, x.shape[1]), np.int64)
            np.add.at(total, near, x)
            found[block] = total, counts
        return pa.Table.from_arrays(rows(found, 0), schema=schema)

    def add(found, columns):
        for block, total, counts in zip(*(c.to_pylist() for c in columns)):
            total, counts = np.frombuffer(total, np.int64), np.frombuffer(counts, np.int64)
            old = found.get(block)
            found[block] = (total, counts) if old is None else (old[0] + total, old[1] + counts)
        return found

    def in_task(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            add(found, (batch.column(0), batch.column(2), batch.column(3)))
        yield pa.RecordBatch.from_arrays(rows(found, TaskContext.get().partitionId() % WAYS), schema=schema)

    def together(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(rows(add({}, [table.column(n) for n in ("block", "sums", "counts")]), 0), schema=schema)

    def move(table: pa.Table, old: pa.Table) -> pa.Table:
        before = np.frombuffer(old.column("slice")[0].as_py(), np.int64).reshape(k, -1)
        (total, counts), = add({}, [table.column(n) for n in ("block", "sums", "counts")]).values()
        after = np.where(counts[:, None] > 0, total.reshape(k, -1) // np.maximum(counts, 1)[:, None], before)
        return pa.table({"block": old.column("block").cast(pa.int32()), "slice": pa.array([after.tobytes()], pa.binary())})

    of_chunks = _parts(cells, slices, k).groupBy("chunk").applyInArrow(sums, "block int, way int, sums binary, counts binary")
    of_tasks = of_chunks.mapInArrow(in_task, "block int, way int, sums binary, counts binary")
    of_ways = of_tasks.groupBy("block", "way").applyInArrow(together, "block int, way int, sums binary, counts binary")
    return of_ways.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(move, "block int, slice binary")


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, block: int = BLOCK, seed: int = 1,
          key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of all vectors after ``rounds`` rounds and a last assignment, and the centroids (cluster, values).

    Centroids start as the vectors with the least hexadecimal sha256 of ``<seed>:<id>``, in that order.
    """
    if k * dimensions > MOST_CELLS:
        raise ValueError(f"{k} centroids of {dimensions} dimensions are more than {MOST_CELLS} components")
    spark = vectors.sparkSession
    points = usable(vectors, dimensions, scale, key, vector)
    slices = common.stored(_first_slices(points, k, dimensions, block, seed))
    one = slices.first()
    if one is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], "cluster int, values array<long>")
    k = len(one.slice) // 8 // min(block, dimensions - one.block * block)
    cells = _cells(points, dimensions, block, max(1, CHUNK_CELLS // k))
    for _ in range(rounds):
        slices = common.stored(_moved(cells, slices, k))

    def assign(table: pa.Table) -> pa.Table:
        near, distance = _nearest(table, k)
        ids = next(x for x in table.column("ids").to_pylist() if x is not None)
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(near, pa.int32()), "distance": pa.array(distance, pa.int64())})

    def spell(batches):
        for batch in batches:
            for number, piece in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(piece, np.int64).reshape(k, -1)
                yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(k), pa.int32()), "block": pa.array([number] * k, pa.int32()), "part": pa.array(values.tolist(), pa.list_(pa.int64()))})

    assigned = common.stored(_parts(cells, slices, k).groupBy("chunk").applyInArrow(assign, "vec_id long, cluster int, distance long"))
    parts = slices.select("block", "slice").mapInArrow(spell, "cluster int, block int, part array<long>")
    centroids = parts.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("p")).select("cluster", F.flatten("p.part").alias("values"))
    return assigned, centroids


def op12_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    last = F.lit(2 ** 63 - 1).cast("decimal(38,0)")
    # k rows: the sums of clusters, and their sum.
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    sums = sums.select("cluster", F.least("own", last).cast("long").alias("cluster_inertia"), F.least(F.sum("own").over(Window.partitionBy(F.lit(0))), last).cast("long").alias("inertia"))
    shown = centroids.select("cluster", F.sha2(F.array_join(F.col("values").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(sums.join(shown, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> str:
    steps = [f"""
v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) <= {k})"""]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, vec_id, v.x AS x, c, CAST(list_sum(list_transform(range(1, {dimensions} + 1), lambda i: (v.x[i] - c{t}.x[i]) * (v.x[i] - c{t}.x[i]))) AS BIGINT) AS d
  FROM v, c{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if t < rounds:
            steps.append(f"""
m{t} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
  FROM (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT c, x, unnest(range(1, {dimensions} + 1)) AS i FROM a{t}) GROUP BY c, i) GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m{t}.x, c{t}.x) AS x FROM c{t} LEFT JOIN m{t} USING (c))""")
    return f"""
WITH {','.join(steps)}
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


SQL = _sql()
