"""Removal of lines that many documents share, by a sharded minimal perfect hash.

A line's key is the line without white space (blank, tab to carriage return) at its ends and with A-Z in lower case, as a 128-bit hash. An
index over all distinct keys is cut into shards; each shard numbers its n keys from 0 to n - 1 without gaps by a minimal perfect hash (about three
bits a key) and has two compact arrays in that order: 32-bit fingerprints, and document counts in one byte, with an exact list of those above 254.

Documents never meet a table of lines. Each sends its distinct keys, 16 bytes each, to the shards, where they stream past the arrays; only keys
found in enough documents come back, to the documents that asked. The few keys that hold more than one in ``HEAD`` of all probes are at
most ``HEAD`` by arithmetic: they get a perfect hash of their own over their whole keys, which is broadcast, and documents probe it on the spot, so that a line of
every third document sends no probes to one shard. Memory: one shard of arrays, one batch of probes, one document's keys.

Rows are documents: a repeated row counts again, rows with a null id are documents as well. Equal rows (id and text) share one answer. A null or empty
text is one empty line. Blank lines are neither counted nor dropped. Very long texts are cut into lines piece by piece. An empty table
gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editlore.llm import common

LEAST = 10  # documents that share a line
MIN_POINTS = 1  # code points of a key
SHARD_KEYS = 500_000  # distinct keys of one shard
SHARDS_PER_TASK = 4
HEAD = 20_000  # keys beyond one in so many probes are probed on the spot
PIECE = 4_000_000  # bytes of text that are cut into lines at once
BLANK = b" \t\n\x0b\x0c\r"
SLACK = 2  # bits per key of each level of the hash
ESCAPE = 255

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """One number per key (rows of two), another for each seed."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] ^ (keys[:, 1] + np.uint64(seed + 1) * _GOLD)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 128-bit keys numbered without gaps.

    Each level has ``SLACK`` bits per key that is left; a key alone at its bit stays there, the others go on. A key's number is the
    number of bits set before its own, over all levels.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits, as bytes
        self.sizes = [len(x) * 8 for x in levels]
        ones = [np.unpackbits(x).astype(np.int64) for x in levels]
        starts = np.cumsum([0, *(int(x.sum()) for x in ones)])
        self.before = [(np.cumsum(x) - x + s).astype(np.int32) for x, s in zip(ones, starts)]
        self.bits = [x.astype(bool) for x in ones]
        self.count = int(starts[-1])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, seed = [], keys, 0
        while len(left):
            if seed > 500:
                raise ValueError("keys are not distinct")
            size = max(64, -(-len(left) * SLACK // 8) * 8)
            at = (_mixed(left, seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[at]]
            seed += 1
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; keys outside the set get any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for seed, (bits, before, size) in enumerate(zip(self.bits, self.before, self.sizes)):
            if not len(rest):
                break
            at = (_mixed(keys[rest], seed) % np.uint64(size)).astype(np.int64)
            here = bits[at]
            out[rest[here]] = before[at[here]]
            rest = rest[~here]
        return out


class Shard:
    """Counts of distinct keys: a perfect hash and the arrays that it indexes."""

    def __init__(self, order: PerfectHash, prints: np.ndarray, counts: np.ndarray, at: np.ndarray, large: np.ndarray):
        self.order, self.prints, self.counts, self.at, self.large = order, prints, counts, at, large

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Shard:
        order = PerfectHash.of(keys)
        number = order.number(keys)
        prints, small, whole = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint8), np.zeros(len(keys), np.int64)
        prints[number] = (keys[:, 1] >> np.uint64(32)).astype(np.uint32)
        whole[number] = counts
        small[:] = np.minimum(whole, ESCAPE)
        at = np.flatnonzero(small == ESCAPE)
        return cls(order, prints, small, at, whole[at])

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Documents of each key; 0 for keys outside the set, but for one in 2**32 of them."""
        number = self.order.number(keys)
        out = np.zeros(len(keys), np.int64)
        known = number >= 0
        known[known] = self.prints[number[known]] == (keys[known, 1] >> np.uint64(32)).astype(np.uint32)
        found = self.counts[number[known]].astype(np.int64)
        above = found == ESCAPE
        found[above] = self.large[np.searchsorted(self.at, number[known][above])]
        out[known] = found
        return out

    def to_bytes(self) -> bytes:
        parts = [np.array([len(x) for x in self.order.levels], np.int64), *self.order.levels, self.prints, self.counts, self.at, self.large]
        head = np.array([len(self.order.levels), len(self.prints), len(self.at)], np.int64)
        return b"".join([head.tobytes(), *(np.ascontiguousarray(x).tobytes() for x in parts)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        place = 0

        def take(n: int, kind) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(data, kind, n, place)
            place += out.nbytes
            return out

        levels, keys, large = take(3, np.int64).tolist()
        sizes = take(levels, np.int64).tolist()
        order = PerfectHash([take(n, np.uint8) for n in sizes])
        return cls(order, take(keys, np.uint32), take(keys, np.uint8), take(large, np.int64), take(large, np.int64))


def as_keys(column: pa.Array) -> np.ndarray:
    """Binary keys of 16 bytes as rows of two numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2) if len(column) else np.zeros((0, 2), np.uint64)


def line_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The lines of a text, in pieces of bounded size (or one line)."""
    start = 0
    while len(text) - start > PIECE:
        cut = text.find(b"\n", start + PIECE)
        if cut < 0:
            break
        yield text[start:cut].split(b"\n")
        start = cut + 1
    yield (text[start:] if start else text).split(b"\n")


def line_key(line: bytes) -> bytes:
    """The 128-bit key of a line, empty if it has no code point to compare."""
    line = line.strip(BLANK).lower()  # bytes: A-Z only
    return xxhash.xxh3_128_digest(line) if line else b""


def distinct_keys(text: bytes, min_points: int) -> list[bytes]:
    """The distinct keys of a text."""
    seen: set[bytes] = set()
    for lines in line_pieces(text):
        for line in lines:
            key = line.strip(BLANK).lower()
            if key and (min_points <= 1 or len(key.decode()) >= min_points):
                seen.add(xxhash.xxh3_128_digest(key))
    return list(seen)


def _keys(rows: DataFrame, min_points: int) -> DataFrame:
    """id1, id2, key: the distinct keys of each row (id1, id2, text)."""
    schema = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("key", pa.binary())])

    def run(batches):
        ids: list[tuple[int, int, int]] = []
        held: list[bytes] = []

        def packed():
            one, two, n = (np.array(x, np.int64) for x in zip(*ids))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(one, n)), pa.array(np.repeat(two, n)), pa.array(held, pa.binary())], schema=schema)

        for batch in batches:
            for part in common.slices(batch, 2):
                for one, two, text in zip(*(c.to_pylist() for c in part.columns)):
                    keys = distinct_keys(text, min_points)
                    for at in range(0, len(keys), 100_000):
                        some = keys[at:at + 100_000]
                        ids.append((one, two, len(some)))
                        held += some
                        if len(held) >= 50_000:
                            yield packed()
                            ids, held = [], []
        if held:
            yield packed()

    return rows.mapInArrow(run, "id1 long, id2 long, key binary")


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def line_index(counts: DataFrame, shards: int) -> DataFrame:
    """shard, arrays: the shards over ``counts`` (key, n)."""
    def build(table: pa.Table) -> pa.Table:
        keys = np.concatenate([as_keys(c) for c in table.column("key").chunks])
        data = Shard.of(keys, table.column("n").to_numpy()).to_bytes()
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "arrays": pa.array([data], pa.binary())})

    return counts.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, "shard int, arrays binary")


def _settled(probes: DataFrame, head: np.ndarray) -> DataFrame:
    """``probes`` with ``hit``: whether their key is one of ``head``, whose arrays hold whole keys beside the fingerprints."""
    order = PerfectHash.of(head)
    keys = np.zeros_like(head)
    keys[order.number(head)] = head
    shared = probes.sparkSession.sparkContext.broadcast((order.levels, keys))

    def run(batches):
        levels, keys = shared.value
        order = PerfectHash(levels)
        for batch in batches:
            asked = as_keys(batch.column(2))
            number = order.number(asked)
            hit = number >= 0
            hit[hit] = (keys[number[hit]] == asked[hit]).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "hit"])

    return probes.mapInArrow(run, "id1 long, id2 long, key binary, hit boolean")


def _answered(probes: DataFrame, index: DataFrame, shards: int, least: int) -> DataFrame:
    """id1, id2, key of the probes whose key is in ``least`` documents or more; probes stream past the arrays of their shard."""
    spark = probes.sparkSession
    asked = probes.select(_shard(shards).alias("shard"), F.lit(1).alias("kind"), "id1", "id2", "key", F.lit(None).cast("binary").alias("arrays"))
    arrays = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id1"), F.lit(None).cast("long").alias("id2"), F.lit(None).cast("binary").alias("key"), "arrays")
    placed = arrays.unionByName(asked).repartition(max(common.partitions(spark), shards), "shard").sortWithinPartitions("shard", "kind")

    def run(batches):
        shard, now = None, None
        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                if stop == start:
                    continue
                part = batch.slice(start, stop - start)
                if now != number[start]:
                    now, shard = number[start], Shard.from_bytes(part.column(5)[0].as_py())
                    part = part.slice(1)
                keys = as_keys(part.column(4))
                yield part.filter(pa.array(shard.count(keys) >= least)).select(["id1", "id2", "key"])

    return placed.mapInArrow(run, "id1 long, id2 long, key binary")


def drop_common_lines(docs: DataFrame, least: int = LEAST, min_points: int = MIN_POINTS, shard_keys: int = SHARD_KEYS, head: int = HEAD, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """``docs`` without the lines that ``least`` documents or more share, with ``n_lines`` and ``n_dropped``.

    All other lines of a document stay as they are, joined by a line feed. Columns called ``n_lines`` or ``n_dropped`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_dropped")))
    whole = F.coalesce(F.col(text), F.lit(""))
    binary = whole.cast("binary")
    one, two = F.xxhash64(F.col(key), whole), F.xxhash64(whole, F.col(key), F.lit(1))

    probes = common.stored(_keys(docs.select(one.alias("id1"), two.alias("id2"), binary.alias("text")), min_points))
    counts = common.stored(probes.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(SHARDS_PER_TASK * common.partitions(spark), -(-distinct // shard_keys))
    index = common.stored(line_index(counts, shards))
    # At most ``head`` keys can be in more than total / head documents.
    often = counts.filter((F.col("n") >= least) & (F.col("n") > total // head)).select("key").collect()
    asked = _settled(probes, np.frombuffer(b"".join(bytes(r.key) for r in often), np.uint64).reshape(-1, 2))
    hits = asked.filter("hit").select("id1", "id2", "key").unionByName(_answered(asked.filter("not hit"), index, shards, least))
    answers = hits.groupBy(F.col("id1").alias("_id1"), F.col("id2").alias("_id2")).agg(F.collect_set("key").alias("_keys"))

    id1, id2, keys = (common.fresh(docs, c) for c in ("_id1", "_id2", "_keys"))
    joined = docs.withColumns({id1: one, id2: two}).join(answers.toDF(id1, id2, keys), [id1, id2], "left").drop(id1, id2)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, place):
                kept, lines, dropped = [], [], []
                for value, gone in zip(part.column(place).to_pylist(), part.column(len(part.columns) - 1).to_pylist()):
                    stays, total, left = [], 0, 0
                    gone = set(gone or ())
                    for some in line_pieces((value or "").encode()):
                        good = [x for x in some if line_key(x) not in gone] if gone else some
                        total, left = total + len(some), left + len(good)
                        stays += [b"\n".join(good)] if good else []
                    kept.append(b"\n".join(stays).decode())
                    lines.append(total)
                    dropped.append(total - left)
                columns = list(part.columns[:-1])
                columns[place] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = drop_common_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, pos, lines[pos] AS line,
         translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS pos FROM d)),
c AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
k AS (
  SELECT r, count(*) AS n_lines, count(c.key) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '') AS kept
  FROM l LEFT JOIN c ON c.key = l.key GROUP BY r)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM k JOIN d USING (r)
"""
