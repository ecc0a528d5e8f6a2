"""Token ids in directly addressable codes: any token can be read without decoding a block.

An id is cut into chunks of ``widths`` bytes, lowest first. Level 0 holds the first chunk of every id and a bitmap that
says which ids continue; level 1 holds the second chunks of those, and so on. A rank directory per bitmap (bits set before each
512 bits) leads from a position in one level to the place in the next.

Files are segments: rows of a Parquet table, each with a self-contained binary in the format below, so that they lie in
whatever store Spark writes to. Documents are range-sorted by id, a segment holds whole documents in a row, and each segment ends
after ``SEGMENT_TOKENS`` ids. Segment layout, little-endian: ``b"DAC1"``, number of levels, documents and tokens (three u64), chunk widths
(u8 each), document ids (i64 each), their ends in tokens (u64 each), then per level the chunk count (u64), the chunks, and, but for the last
level, bitmap bytes and directory (u32 each).

Null texts are empty; an empty document is its end id. Repeated ids keep all their rows; documents without id come first. Only the two named columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.llm import common, tokens

WIDTHS = (1, 1, 2)
SEGMENT_TOKENS = 1_000_000
NO_ID = -2**63  # stands for a null document id
RANK_BITS = 512
MAGIC = b"DAC1"


def pack_segment(doc_ids: list[int], lengths: list[int], ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The segment of the documents ``doc_ids`` with ``lengths`` ids each, ``ids`` in a row."""
    out = [MAGIC, struct.pack("<3Q", len(widths), len(doc_ids), len(ids)), bytes(widths), np.array([NO_ID if i is None else i for i in doc_ids], "<i8").tobytes(),
           np.cumsum(np.array(lengths, np.uint64)).astype("<u8").tobytes()]
    rest = ids.astype(np.uint64)
    for level, width in enumerate(widths):
        out += [struct.pack("<Q", len(rest)), _chunks(rest, width)]
        rest = rest >> np.uint64(8 * width)
        goes_on = rest > 0
        if level < len(widths) - 1:
            bitmap = np.packbits(goes_on, bitorder="little")
            ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS)))]) if len(goes_on) else [0]
            out += [bitmap.tobytes(), np.array(ranks, "<u4").tobytes()]
            rest = rest[goes_on]
        elif goes_on.any():
            raise ValueError("an id is wider than all levels together")
    return b"".join(out)


def _chunks(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


class Segment:
    """A packed segment: documents, all ids, or the id at any position."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        levels, docs, self.n_tokens = struct.unpack_from("<3Q", data, 4)
        at = 28
        self.widths = tuple(data[at:at + levels])
        at += levels
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.ends = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        at += 16 * docs
        self.levels = []
        for level, width in enumerate(self.widths):
            n, = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n * width, at + 8).reshape(-1, width)
            at += 8 + n * width
            bitmap = ranks = None
            if level < levels - 1:
                bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
                ranks = np.frombuffer(data, "<u4", -(-n // RANK_BITS) + 1, at + len(bitmap))
                at += len(bitmap) + 4 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def token(self, position: int) -> int:
        """The id at ``position``: one chunk, bit and rank lookup per level."""
        if not 0 <= position < self.n_tokens:
            raise IndexError(position)
        value = shift = 0
        for (chunks, bitmap, ranks), width in zip(self.levels, self.widths):
            value |= int.from_bytes(chunks[position].tobytes(), "little") << shift
            shift += 8 * width
            if bitmap is None or not bitmap[position >> 3] >> (position & 7) & 1:
                break
            block = position // RANK_BITS
            inside = np.unpackbits(bitmap[block * RANK_BITS // 8:position // 8 + 1], bitorder="little")[:position - block * RANK_BITS]
            position = int(ranks[block]) + int(inside.sum())
        return value

    def tokens(self) -> np.ndarray:
        """All ids, level by level."""
        values = shift = None
        for (chunks, bitmap, _), width in zip(self.levels, self.widths):
            wide = np.zeros((len(chunks), 8), np.uint8)
            wide[:, :width] = chunks
            level = wide.view("<u8").ravel()
            if values is None:
                values, places, shift = level.copy(), np.arange(len(level)), 0
            else:
                values[places] |= level << np.uint64(shift)
            shift += 8 * width
            if bitmap is not None:
                places = places[np.unpackbits(bitmap, count=len(level), bitorder="little").view(bool)]
        return values.astype("<u4")


SEGMENTS = "_part int, _before long, n_tokens long, first_doc long, data binary"


def write_codes(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text",
                segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Encode every text, write the segments in ascending ``key`` order and return the table of segments, each with ``start``, the
    number of ids in all segments before it."""
    spark = docs.sparkSession
    rows = common.texts(docs, key, text)
    placed = rows.repartitionByRange(common.partitions(spark), key).sortWithinPartitions(key)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokens.encoder(vocabulary, "words"), TaskContext.get().partitionId()
        before, doc_ids, found, size = 0, [], [], 0

        def flush():
            data = pack_segment(doc_ids, [len(x) for x in found], np.concatenate(found))
            return pa.RecordBatch.from_pydict({"_part": pa.array([part], pa.int32()), "_before": [before], "n_tokens": [size], "first_doc": pa.array([doc_ids[0]], pa.int64()), "data": [data]})

        for batch in (part for whole in batches for part in common.slices(whole, 1, tokens.SLICE_BYTES)):
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                doc_ids.append(doc_id)
                found.append(np.append(ids, np.uint32(end_id)))
                size += len(ids) + 1
                if size >= segment_tokens:
                    yield flush()
                    before, doc_ids, found, size = before + size, [], [], 0
        if doc_ids:
            yield flush()

    table = common.stored(placed.mapInArrow(encode, SEGMENTS))
    return common.offset_by_part(table, "n_tokens").select(
        "first_doc", (F.col("_offset") + F.col("_before")).alias("start"), "n_tokens", "data")


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document of the segments: doc_id, start, n_tokens and the crc32 of its ids, from the segments' bytes alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment = Segment(data.as_py())
                ids, starts = segment.tokens(), np.insert(segment.ends[:-1], 0, 0)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), segment.ends.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(segment.doc_ids, mask=segment.doc_ids == NO_ID), "start": starts + start, "n_tokens": segment.ends - starts, "ids_crc32": pa.array(crcs, pa.int64())})

    return segments.select("start", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(segments: DataFrame, positions: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The ids at corpus ``positions`` (column ``position``), each by random access in its segment; unknown positions are left out.

    The axis of positions is cut into buckets as long as a segment; positions meet the few segments that touch their bucket.
    """
    bucket = F.lit(segment_tokens)
    touched = segments.select(F.col("start").alias("segment"), (F.col("start") + F.col("n_tokens")).alias("end"), F.explode(F.sequence(
        F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.col("n_tokens") - 1) / bucket))).alias("bucket"))
    wanted = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("bucket", F.floor(F.col("position") / bucket))
    wanted = wanted.join(touched, "bucket").filter("position >= segment and position < end").select("position", "segment")

    def read(key, table: pa.Table, data: pa.Table) -> pa.Table:
        if not len(data) or not len(table):
            return pa.table({"position": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
        segment = Segment(data.column("data")[0].as_py())
        at = table.column("position").to_pylist()
        return pa.table({"position": pa.array(at, pa.int64()), "token": pa.array([segment.token(p - key[0].as_py()) for p in at], pa.int64())})

    return wanted.groupBy("segment").cogroup(segments.select(F.col("start").alias("segment"), "data").groupBy("segment")).applyInArrow(read, "position long, token long")


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_codes(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))
