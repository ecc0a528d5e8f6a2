"""Exact k nearest labelled vectors by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlore.functions.columns import share
from editlore.session import materialise

BROADCAST_VECTORS = 50_000
BROADCAST_BYTES = 200_000_000  # of labelled vectors as doubles
MOST_PIVOTS = 1_024  # vectors of the index on the driver: 6 MB of 768 doubles
MOST_RINGS = 200_000  # three numbers each
SLACK = 1e-6  # distances near zero have half the digits of similarities
VISITS = 4_096  # copies of queries made at once
BLOCK_BYTES = 32_000_000  # of doubles; a quarter of it in most blocks, twice in the largest
MEETINGS = 64  # tasks in which queries and blocks should meet at least
CELLS = 1_000_000  # similarities held at once
FEW = 64  # similarities of a query that are sorted without a cut at its k-th

PAIRS = T.StructType([
    T.StructField("property_id", T.LongType()), T.StructField("nn_property_id", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
])


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.vstack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray | None = None) -> pd.DataFrame:
    """The ``k`` most similar vectors per query, smaller ids first on ties; a few queries at a time. With ``floors`` similarities below each query's may be left out."""
    k, step = min(k, len(ids)), max(CELLS // len(ids), 1)
    parts = []
    for start in range(0, len(query_ids), step):
        similarities = queries[start:start + step] @ vectors.T
        low = np.full(len(similarities), -np.inf) if floors is None else floors[start:start + step].copy()
        reached = similarities >= low[:, None]
        many = np.flatnonzero(np.count_nonzero(reached, axis=1) > max(FEW, k))
        if len(many):
            reached[many] &= similarities[many] >= np.partition(similarities[many], -k, axis=1)[:, -k][:, None]
        rows, columns = np.nonzero(reached)  # about k per row, more on ties
        values, found = similarities[rows, columns], ids[columns]
        order = np.lexsort((found, -values, rows))
        rows, values, found = rows[order], values[order], found[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        parts.append(pd.DataFrame({
            "property_id": query_ids[start:start + step][rows[keep]], "nn_property_id": found[keep], "similarity": values[keep]}))
    return pd.concat(parts, ignore_index=True)


def nearest_labelled(vectors: DataFrame, labelled: DataFrame, k: int = 4, broadcast_vectors: int = BROADCAST_VECTORS) -> DataFrame:
    """(property_id, nn_property_id, similarity, rank) for the ``k`` nearest labelled vectors of every vector.

    Labelled vectors are counted and measured first. Few are broadcast once as a matrix; more are searched in an index of pivots. Both ways
    are exact, and no similarity matrix larger than one batch by one block ever exists.
    """
    queries = vectors.select("property_id", "embedding")
    targets = labelled.select("property_id", "embedding").filter(F.col("embedding").isNotNull())
    n, length = targets.select("embedding").limit(broadcast_vectors + 1).agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    fits = n <= broadcast_vectors and n * length * 8 <= BROADCAST_BYTES
    found = _broadcast_search(queries, targets, k) if fits else _block_search(queries, targets, k)
    line = Window.partitionBy("property_id").orderBy(F.desc("similarity"), "nn_property_id")
    return found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


def _broadcast_search(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    known = targets.toPandas()
    if known.empty:
        return queries.sparkSession.createDataFrame([], PAIRS)
    shared = queries.sparkSession.sparkContext.broadcast((known["property_id"].to_numpy(), _unit(known["embedding"])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for batch in batches:
            if len(batch):
                yield _top(batch["property_id"].to_numpy(), _unit(batch["embedding"]), ids, matrix, k)

    return queries.mapInPandas(search, PAIRS)


def _known(batch: pd.DataFrame) -> pd.DataFrame:
    return batch[batch["embedding"].notna()]


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (units @ pivots.T), 0))


def _block_search(queries: DataFrame, targets: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """Search in an index of pivots, with queries that visit only the cells they can reach.

    Every labelled vector lies in the cell of its nearest pivot; cells are cut into blocks by their distance from the pivot, so a block is a ring. First every query
    searches one block near it, which bounds the distance of its ``k``-th neighbour. By the triangle inequality a ring whose distances from the pivot differ by more than
    that bound from the query's cannot have a nearer vector; the query is sent to all other rings. Blocks stay where they are, and queries stream past them, so no
    vector is copied once per block of the other side. Vectors without length are a cell of their own, similar to nothing.

    Queries are copied once per block they reach, so blocks are as large as ``BLOCK_BYTES`` allows. Where that leaves few of them, each is copied for several
    slices of the queries. The bound also goes with each copy, so that a block's similarities are only compared with it.
    """
    spark = queries.sparkSession
    n, length = targets.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    block = max(block or BLOCK_BYTES // (8 * max(length, 1)), 1, ceil(4 * n / MOST_RINGS))
    wanted = max(1, min(MOST_PIVOTS, ceil(2 * n / block)))
    first = targets.filter(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("property_id"), "property_id").limit(wanted).toPandas()  # at most MOST_PIVOTS vectors
    if first.empty:
        return queries.sparkSession.createDataFrame([], PAIRS) if not n else _broadcast_search(queries, targets.orderBy("property_id").limit(k), k)
    shared = spark.sparkContext.broadcast(_unit(first["embedding"]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = shared.value
        for batch in map(_known, batches):
            if len(batch):
                units = _unit(batch["embedding"])
                distance = _distances(units, pivots)
                near = distance.argmin(axis=1)
                some = units.any(axis=1)
                yield batch.assign(pivot=np.where(some, near, -1), distance=np.where(some, distance[np.arange(len(batch)), near], 0.0))

    shape = "property_id long, embedding array<double>, pivot int, distance double"
    kept = [F.col("property_id").cast("long").alias("property_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    homes = materialise(targets.select(*kept).mapInPandas(place, shape))
    # Rings: cells are cut at rows by hash, about ``block`` vectors apart in the order of their distance.
    cells = homes.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
    cuts = homes.filter(F.pmod(F.xxhash64("property_id"), F.lit(max(block // 2, 1))) == 0).select("pivot", "distance").distinct()
    edges = cells.select("pivot", F.lit(-1.0).alias("low")).unionByName(cuts.select("pivot", F.col("distance").alias("low")))
    rings = edges.withColumn("high", F.coalesce(F.lead("low").over(Window.partitionBy("pivot").orderBy("low")), F.lit(float("inf"))))
    ring_rows = rings.toPandas().sort_values(["pivot", "low"], ignore_index=True)  # about 2 n / block, MOST_RINGS / 2 at most
    pivot, low, high = (ring_rows[c].to_numpy() for c in ("pivot", "low", "high"))

    def ring_of(batch: pd.DataFrame) -> np.ndarray:
        """Where the vectors of a batch lie: in the last ring of their cell that begins before them."""
        out = np.empty(len(batch), np.int64)
        for cell in batch["pivot"].unique():
            start, stop = np.searchsorted(pivot, [cell, cell + 1])
            own = (batch["pivot"] == cell).to_numpy()
            out[own] = start + np.searchsorted(low[start:stop], batch["distance"].to_numpy()[own], "right") - 1
        return out

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"ring": ring_of(batch)})

    # Rings of many vectors at one distance are dealt into blocks by id.
    sizes = homes.mapInPandas(numbers, "ring long").groupBy("ring").agg(F.count(F.lit(1)).alias("size")).toPandas()
    blocks = np.ones(len(pivot), np.int64)
    blocks[sizes["ring"]] = -(-sizes["size"] // (2 * block))
    offset = np.cumsum(blocks) - blocks
    table = spark.sparkContext.broadcast(tuple(np.repeat(x, blocks) for x in (pivot, low, high)))

    def rings_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ring = ring_of(batch)
                yield batch[["property_id", "embedding"]].assign(ring=(offset[ring] + batch["property_id"].to_numpy() % blocks[ring]).astype(np.int32))

    slices = max(1, MEETINGS // int(blocks.sum()))
    placed = homes.mapInPandas(rings_of, "property_id long, embedding array<double>, ring int").withColumns({
        "floor": F.lit(None).cast("double"), "kind": F.lit(0), "slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))})
    asked = queries.select(*kept)

    def first_ring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rings_of(place(batches)):
            yield batch

    def meet(visits: DataFrame) -> DataFrame:
        dealt = visits.withColumns({"kind": F.lit(1), "slice": F.pmod(F.xxhash64("property_id"), F.lit(slices)).cast("int")})
        return placed.unionByName(dealt).repartition("ring", "slice").sortWithinPartitions("ring", "slice", "kind").mapInPandas(
            lambda batches: _streamed(batches, k), PAIRS)

    start = materialise(meet(asked.mapInPandas(first_ring, "property_id long, embedding array<double>, ring int").withColumn("floor", F.lit(-2.0))))
    bounds = start.groupBy("property_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("kth"))

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, (pivot, low, high) = shared.value, table.value
        for batch in map(_known, batches):
            for at in range(0, len(batch), max(1, CELLS // len(pivot))):
                some = batch.iloc[at:at + max(1, CELLS // len(pivot))]
                units = _unit(some["embedding"])
                distance = np.column_stack([_distances(units, pivots), np.zeros(len(some))])[:, pivot]  # the last column stands for -1
                kth = some["kth"].fillna(-1.0).to_numpy(dtype=np.float64)
                far = np.sqrt(np.maximum(2 - 2 * kth, 0))[:, None] + SLACK
                open_ = (distance - high[None, :] <= far) & (low[None, :] - distance <= far)
                open_ |= ~units.any(axis=1)[:, None]  # similar to nothing, so as near to all
                open_ = np.where(pivot[None, :] == -1, (kth <= SLACK)[:, None], open_)
                row, ring = np.nonzero(open_)
                for part in range(0, len(row), VISITS):
                    rows = some.iloc[row[part:part + VISITS]]
                    yield rows[["property_id", "embedding"]].assign(
                        ring=ring[part:part + VISITS].astype(np.int32), floor=kth[row[part:part + VISITS]] - SLACK)

    visits = asked.join(bounds, "property_id", "left").mapInPandas(reached, "property_id long, embedding array<double>, ring int, floor double")
    return meet(visits)


def _streamed(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Each ring's vectors come first and are held; queries stream past them."""
    place, ids, vectors, matrix = None, [], [], None
    for batch in batches:
        for number, part in batch.groupby(["ring", "slice"], sort=False):
            if number != place:
                place, ids, vectors, matrix = number, [], [], None
            own = part[part["kind"] == 0]
            if len(own):
                ids.append(own["property_id"].to_numpy())
                vectors.append(_unit(own["embedding"]))
                matrix = None
            asked = part[part["kind"] == 1]
            if len(asked) and ids:
                if matrix is None:
                    ids, vectors = [np.concatenate(ids)], [np.vstack(vectors)]
                    matrix = vectors[0]
                yield _top(asked["property_id"].to_numpy(), _unit(asked["embedding"]), ids[0], matrix, k, asked["floor"].to_numpy(dtype=np.float64))


def labelled_properties(embeddings: DataFrame) -> DataFrame:
    return embeddings.filter(F.col("property_type").isNotNull())


def neighbours(embeddings: DataFrame, k: int = 4, broadcast_vectors: int = BROADCAST_VECTORS) -> DataFrame:
    """One row per property and neighbour rank, with label and type of the neighbour."""
    known = labelled_properties(embeddings)
    found = nearest_labelled(embeddings, known, k, broadcast_vectors)
    names = known.select(F.col("property_id").alias("nn_property_id"), F.col("property_label").alias("nn_property_label"),
                         F.col("property_type").alias("nn_property_type"))
    return found.join(names, "nn_property_id").select(
        "property_id", "rank", "nn_property_id", "nn_property_label", "nn_property_type", "similarity")


def neighbour_lists(found: DataFrame) -> DataFrame:
    """The neighbours of a property as parallel lists, nearest first (``k`` items each)."""
    items = F.array_sort(F.collect_list(F.struct("rank", "nn_property_id", "nn_property_label", "nn_property_type", "similarity")))
    return found.groupBy("property_id").agg(items.alias("_n")).select(
        "property_id", F.col("_n.nn_property_id").alias("nearest_property_ids"),
        F.col("_n.nn_property_label").alias("nearest_property_labels"),
        F.col("_n.nn_property_type").alias("nearest_property_types"), F.col("_n.similarity").alias("nearest_similarities"))


def nearest_non_self(found: DataFrame, hint_from: float | None = None) -> DataFrame:
    """The best neighbour that is not the property itself; ``nn_sim`` only from ``hint_from`` on, if given."""
    best = F.min(F.struct("rank", "nn_property_id", "nn_property_label", "nn_property_type", "similarity"))
    nearest = found.filter(F.col("property_id") != F.col("nn_property_id")).groupBy("property_id").agg(best.alias("_b"))
    similarity = F.col("_b.similarity")
    return nearest.select(
        "property_id", "_b.nn_property_id", "_b.nn_property_label", "_b.nn_property_type",
        (similarity if hint_from is None else F.when(similarity >= hint_from, similarity)).alias("nn_sim"))


def similarity_bucket(similarity: Column) -> Column:
    return (F.when((similarity > 0) & (similarity <= 0.3), "(0.0, 0.3]").when((similarity > 0.3) & (similarity <= 0.5), "(0.3, 0.5]")
            .when((similarity > 0.5) & (similarity <= 0.7), "(0.5, 0.7]").when((similarity > 0.7) & (similarity <= 1), "(0.7, 1.0]"))


def neighbour_accuracy(embeddings: DataFrame, nearest: DataFrame) -> DataFrame:
    """How often the nearest neighbour has the right type: overall, per type and per similarity bucket."""
    studied = labelled_properties(embeddings).filter(~F.col("property_label").contains(" ID")).select("property_id", "property_type")
    judged = studied.join(nearest, "property_id", "left").select(
        "property_type", similarity_bucket(F.col("nn_sim")).alias("bucket"),
        F.coalesce(F.col("property_type") == F.col("nn_property_type"), F.lit(False)).cast("int").alias("hit"))
    views = F.array(
        F.struct(F.lit("overall").alias("grouping"), F.lit("all").alias("value")),
        F.struct(F.lit("property_type").alias("grouping"), F.col("property_type").alias("value")),
        F.struct(F.lit("sim_bucket").alias("grouping"), F.col("bucket").alias("value")))
    return (
        judged.select("hit", F.explode(views).alias("_v")).filter(F.col("_v.value").isNotNull())
        .groupBy("_v.grouping", "_v.value").agg(
            F.count(F.lit(1)).alias("num_properties"), F.sum("hit").alias("num_correct"),
            share(F.sum("hit"), F.count(F.lit(1))).alias("accuracy"))
    )


def property_text(only_label: bool = False) -> Column:
    if only_label:
        return F.col("property_label")
    return F.concat(F.col("property_label"), F.lit(". "), F.coalesce("property_description", F.lit("")))


def embed(df: DataFrame, make_encoder, batch_size: int = 256, only_label: bool = False) -> DataFrame:
    """Add ``embedding``: ``make_encoder()`` runs once per worker and returns texts -> 2-d array."""
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", encode(property_text(only_label)))
