"""Packing token sequences by best fit, on counted sizes.

Pieces of one size are alike, so best fit needs only how many there are of each: at most ``capacity`` counts, whatever the number of pieces. Sizes come in
descending order; the pieces of one size fill the smallest gaps that hold them, whole runs of sequences with equal gaps at a time, and open further sequences where
no gap does. The packing is that of best fit decreasing, piece by piece. A run that takes pieces keeps less than half of its gap, and each size splits two runs at
most, so there are at most about ``2 * capacity * log2(capacity)`` runs, again whatever the number of pieces.

Pieces are numbered within their size where they lie: dealt into buckets, numbered in each bucket of a size, and moved up by the counts of the buckets before. A
piece's size and number then give its run, its sequence and its offset, without a join. No task holds a size.

Pieces of full length are sequences of their own. Null texts are empty, and an empty document is one piece with its end id. Equal
sizes are matched in any order. Repeated documents are packed once per row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlore.llm import common, tokens

CAPACITY = 2048

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and ``end_id``, cut from its end into pieces of ``capacity``, so that only the first may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary, "bytes")
        for batch in (part for whole in batches for part in common.slices(whole, 1, tokens.SLICE_BYTES // 2)):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.texts(docs, key, text).mapInArrow(cut, PIECES)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``; all sequences are filled without gaps from 0.

    Pieces of one size are numbered in so many ``buckets``; None: one for each shuffle partition, more where these would get many.
    """
    spark = pieces.sparkSession
    table = common.stored(pieces.withColumn("_piece", F.monotonically_increasing_id()))
    items = table.filter(F.col("length") < capacity)
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    numbered = _numbered(items, buckets or max(common.partitions(spark), common.few(spark, sum(counts.values()))))
    alone = table.filter(F.col("length") >= capacity).select("*", (-1 - F.col("_piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return _placed(numbered, runs(counts, capacity)).unionByName(alone).drop("_piece")


def runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit decreasing over ``counts`` (size: number): rows of size, number of the first piece, first sequence, pieces in each, offset; in order."""
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # ascending
    of: dict[int, list[tuple[int, int]]] = {}  # sequences with a gap: first, number
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in of:
                insort(gaps, gap)
            of.setdefault(gap, []).append((first, n))

    for size in sorted(counts, reverse=True):
        at, left = 0, counts[size]
        while left:
            if (place := bisect_left(gaps, size)) == len(gaps):
                leave(capacity, opened, new := -(-left // (capacity // size)))
                opened += new
            gap = gaps[place]
            first, n = of[gap].pop()
            if not of[gap]:
                del of[gap], gaps[place]
            each = gap // size
            # Full ones take ``each``; where fewer pieces than that are left, one more sequence takes them.
            for each, filled in ((each, min(n, left // each)), (left % each, int(left < n * each))):
                if each and filled:
                    out.append((size, at, first, each, capacity - gap))
                    leave(gap - each * size, first, filled)
                    at, left, first, n = at + each * filled, left - each * filled, first + filled, n - filled
            leave(gap, first, n)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _numbered(items: DataFrame, buckets: int) -> DataFrame:
    """``items`` with ``_number``, from 0 within each length."""
    dealt = items.withColumn("_bucket", F.pmod(F.xxhash64("_piece"), F.lit(buckets)).cast("int"))
    inside = dealt.withColumn("_number", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_piece")) - 1)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return inside.join(starts, ["length", "_bucket"]).withColumn("_number", F.col("_number") + F.col("_start")).select(*items.columns, "_number")


def _placed(numbered: DataFrame, table: np.ndarray) -> DataFrame:
    """``numbered`` with ``sequence_id`` and ``offset`` from the runs of ``table`` instead of ``_number``."""
    shared = numbered.sparkSession.sparkContext.broadcast(table)
    kept = [f for f in numbered.schema.fields if f.name != "_number"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in schema.fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, numbers, firsts, each, offsets = shared.value.T
        starts = (sizes << 40) + numbers
        for batch in batches:
            size, number = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "_number"))
            at = np.searchsorted(starts, (size << 40) + number, "right") - 1
            inside = number - numbers[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(firsts[at] + inside // each[at]), pa.array(offsets[at] + inside % each[at] * size)],
                names=names)

    return numbered.mapInArrow(place, schema)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    import public_tokenizers

    return best_fit(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
