"""Similarity join of texts by word 5-grams, Jaccard 0.8 or more, by chosen-path splitting.

Every text gets a sketch of ``POSITIONS`` sampled shingles (the least hash of its shingles per position). A run starts at one position and puts
texts with the same sampled shingle there into one bucket. Buckets of more than ``LIMIT`` texts are split again by ``BRANCHES`` more
positions, chosen by a hash of the path, and so on. Small buckets are compared whole. A split that keeps most of its bucket
has met near copies, which no further split would part: such a bucket, and what is left after ``DEPTH`` splits, is compared in blocks, every block
with every other one. The number of runs follows from the target recall.

Texts with the same words are one text with a number of copies. In a bucket, pairs whose sketches are far apart are left out first; the
shingles of the others are then fetched and compared exactly. A pair belongs to the least bucket that holds both texts, and in a bucket compared in
blocks to the one pair of their blocks, so that it is counted once. A text carries its list of buckets, whose length runs and branches bound, not the
blocks they are cut into. Tasks return one row per text and bucket (links and a union-find root), never pairs. Classes are connected
components over these rows.

Null and empty texts have no shingles: each is a class of its own with no links. Texts of fewer than five words have one shingle, all their words.
Documents without id go by a negative number derived from their text. Words lie between ASCII white space, A-Z in lower case. Repeated rows are copies of one text. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from editlore.llm import common
from editlore.llm.words import SPACED, Words, mix

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
POSITIONS = 64
BRANCHES = 2
LIMIT = 400
DEPTH = 8
DENSE = 0.5  # share of a bucket that a split must not keep
FAR = 0.5  # sketches that agree at fewer positions are left out; five deviations below the threshold


def run_count(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold is found with the given probability: each run needs its first sampled shingle shared, and after every
    further split one of the branches."""
    alive = threshold
    for _ in range(DEPTH):
        alive = threshold * (1 - (1 - alive) ** BRANCHES)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


_FACTORS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketches(texts: list[str]) -> tuple[list[bytes | None], np.ndarray]:
    """Each text's key (a digest of its words, None without words) and its sketch (texts x positions)."""
    words = Words(texts, SPACED)
    of, values = words.shingles(SHINGLE)
    out = np.zeros((len(texts), POSITIONS), np.uint32)
    if len(of):
        starts = np.flatnonzero(np.insert(of[1:] != of[:-1], 0, True))
        for i, factor in enumerate(_FACTORS):
            out[of[starts], i] = np.minimum.reduceat(((values * factor) >> np.uint64(32)).astype(np.uint32), starts)
    first = words.first.tolist()
    keys = [hashlib.md5(words.hash[a:b].tobytes(), usedforsecurity=False).digest() if b > a else None for a, b in zip(first, first[1:])]
    return keys, out


def _node(parent: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A bucket's number: its path, the position chosen there, and the sampled shingle."""
    return mix(mix(parent + position.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ value.astype(np.uint64)).view(np.int64)


def identity(key: str, text: str = "text"):
    """The document's id, or a negative number derived from its text."""
    return F.coalesce(F.col(key).cast("long"), -1 - F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(2**62)))


def _sketched(rows: DataFrame, runs: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1):
                keys, values = sketches(part.column(1).to_pylist())
                roots = _node(np.arange(runs, dtype=np.uint64)[None, :] + np.zeros((len(keys), 1), np.uint64), np.arange(runs)[None, :] + np.zeros((len(keys), 1), np.int64), values[:, :runs])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(keys, pa.binary()), pa.array([v.tobytes() for v in values], pa.binary()),
                     pa.FixedSizeListArray.from_arrays(pa.array(roots.ravel()), runs).cast(pa.list_(pa.int64()))], names=["doc_id", "given", "mark", "key", "sketch", "roots"])

    return rows.mapInArrow(sketch, "doc_id long, given boolean, mark long, key binary, sketch binary, roots array<long>")


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next buckets of texts in a bucket that is split; branches that choose one position are one bucket."""
    for batch in batches:
        node = batch.column(1).to_numpy().view(np.uint64)
        sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, POSITIONS)
        chosen = [(mix(node + np.uint64(branch + 1)) % np.uint64(POSITIONS)).astype(np.int64) for branch in range(BRANCHES)]
        for branch, position in enumerate(chosen):
            own = np.flatnonzero(np.all([position != other for other in chosen[:branch]], axis=0) if branch else np.ones(len(node), bool))
            value = sketch[own, position[own]]
            places = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), pa.array(_node(node[own], position[own], value)), batch.column(2).take(places)], names=["key", "node", "was"])


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` narrow rows: what the rows fill, and no fewer than run at once."""
    return max(common.few(spark, rows), spark.sparkContext.defaultParallelism)


def _buckets(texts: DataFrame, limit: int, depth: int) -> DataFrame:
    """Buckets that are not split further: key, node, n. ``texts`` has key, sketch, roots."""
    spark = texts.sparkSession
    live = texts.select("key", F.explode("roots").alias("node"), F.lit(None).cast("long").alias("was"))
    tasks = _tasks(spark, live.count())
    buckets = None
    for level in range(depth + 1):
        sizes = live.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        table = common.stored(live.join(sizes, "node").coalesce(tasks))
        split = (F.col("n") > limit) & (F.coalesce(F.col("n") <= DENSE * F.col("was"), F.lit(True)) if level < depth else F.lit(False))
        done = table.filter(~split).select("key", "node", "n")
        buckets = done if buckets is None else buckets.unionByName(done)
        rest = table.filter(split)
        left = rest.count() if level < depth else 0
        if not left:
            return buckets
        tasks = _tasks(spark, BRANCHES * left)
        sketched = rest.select("key", "node", F.col("n").alias("was")).join(texts.select("key", "sketch"), "key").select("key", "node", "was", "sketch")
        live = common.stored(sketched.coalesce(tasks).mapInArrow(_children, "key binary, node long, was long"))


def _leaves(buckets: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """Comparisons that a text takes part in: leaf, node, side, key, nodes (all its buckets, ascending), sketch.

    A bucket of at most ``limit`` texts is one leaf, compared whole (side 0). A larger one is dealt into blocks; a leaf is a block (side 0), or two of them,
    whose texts (sides -1 and 1) are compared across only.
    """
    lists = buckets.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("buckets"))
    rows = lists.join(texts.select("key", "sketch"), "key").select("key", "sketch", F.col("buckets.node").alias("nodes"), F.explode("buckets").alias("bucket"))
    blocks = F.when(F.col("bucket.n") > limit, F.ceil(F.col("bucket.n") / limit)).otherwise(1).cast("int")
    rows = rows.select("key", "sketch", "nodes", F.col("bucket.node").alias("node"), blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("own"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    leaf = F.when(F.col("blocks") > 1, F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("node"))
    return rows.select(leaf.alias("leaf"), "node", F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "key", "nodes", "sketch")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one leaf after another; rows come sorted by the first column."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        leaf = table.column(0).to_numpy()
        cuts = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
        bounds = [0, *cuts.tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(bounds[-1]) if len(table) else None
    if rest is not None and len(rest):
        yield rest


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts to compare with each other in a leaf: those of its two blocks, or twice all."""
    if side.any():
        return np.flatnonzero(side < 0), np.flatnonzero(side > 0)
    every = np.arange(len(side))
    return every, every


def _owned(node: int, nodes: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``node`` is the least bucket that texts ``a`` and ``b`` share, for each pair. ``nodes`` has each text's buckets."""
    if len(a) <= 8:
        own = {i: set(nodes[i].as_py()) for i in {*a.tolist(), *b.tolist()}}
        return np.array([min(own[i] & own[j]) == node for i, j in zip(a.tolist(), b.tolist())], bool)
    of, values = np.repeat(np.arange(len(nodes)), np.diff(nodes.offsets.to_numpy())), nodes.flatten().to_numpy()
    of, values = of[values < node], values[values < node]
    _, at, often = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    of, at = of[often[at] > 1], column[at[often[at] > 1]]
    earlier = np.zeros((len(nodes), len(nodes)), bool)
    for low in range(0, int(at.max()) + 1 if len(at) else 0, 1024):
        holds = np.zeros((len(nodes), 1024), np.float32)
        some = (at >= low) & (at < low + 1024)
        holds[of[some], at[some] - low] = 1
        earlier |= holds @ holds.T > 0
    return ~earlier[a, b]


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """At how many positions two sketches agree, for each of ``left`` and each of ``right``."""
    if len(left) * len(right) <= 1024:
        return (left[:, None, :] == right[None, :, :]).sum(axis=2)
    out = np.zeros((len(left), len(right)), np.uint8)
    for x, y in zip(np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)):
        out += x[:, None] == y[None, :]
    return out


def _pairs(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs marked in ``found`` (left x right), each once."""
    a, b = np.nonzero(np.triu(found, 1) if left is right else found)
    return left[a], right[b]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each leaf with a partner whose sketch is not far and whose pair belongs to the leaf. Columns leaf, node, side, key, nodes, sketch; all but the
    sketch are returned."""
    found: list[pa.Table] = []
    rows = 0
    for group in _groups(batches):
        m = len(group)
        if m < 2:
            continue
        left, right = _sides(group.column(2).to_numpy())
        sketch = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint32).reshape(m, POSITIONS)
        a, b = _pairs(_agreeing(sketch[left], sketch[right]) >= FAR * POSITIONS, left, right)
        if not len(a):
            continue
        own = _owned(group.column(1)[0].as_py(), _list(group.column(4)), a, b)
        hit = np.unique(np.concatenate([a[own], b[own]]))
        if len(hit):
            found.append(group.select([0, 1, 2, 3, 4]).take(pa.array(hit)))
            rows += len(hit)
        if rows > 10_000:
            yield from pa.concat_tables(found).to_batches()
            found, rows = [], 0
    if found:
        yield from pa.concat_tables(found).to_batches()


def _list(column: pa.ChunkedArray) -> pa.ListArray:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of shared shingles of the sets at ``left`` with those at ``right``."""
    m = len(sets)
    if m == 2 and left is not right:
        return np.array([[len(np.intersect1d(*sets, assume_unique=True))]])
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    use = often[at] > 1
    of, at = of[use], column[at[use]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, [low, low + 4096])
        some = np.zeros((m, 4096), np.float32)
        some[of[a:b], at[a:b] - low] = 1
        out += some[left] @ some[right].T
    return out.astype(np.int64)


def _linker(threshold: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links and a root for each text of a leaf. Columns leaf, node, side, key, nodes, copies, shingles."""
        rows: list[tuple[bytes, int, bytes]] = []
        for group in _groups(batches):
            m = len(group)
            if m < 2:
                continue
            left, right = (np.array([0]), np.array([1])) if m == 2 else _sides(group.column(2).to_numpy())
            keys, copies = group.column(3).to_pylist(), group.column(5).to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group.column(6).to_pylist()]
            size = np.array([len(s) for s in sets])
            both = _shared(sets, left, right)
            a, b = _pairs(both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9, left, right)
            if not len(a):
                continue
            own = _owned(group.column(1)[0].as_py(), _list(group.column(4)), a, b)
            a, b = a[own], b[own]
            links = np.bincount(a, copies[b], m) + np.bincount(b, copies[a], m)
            root = np.arange(m)
            while True:  # least index of each component, by repeated minimum and jumps
                new = root.copy()
                np.minimum.at(new, a, root[b])
                np.minimum.at(new, b, root[a])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            rows += [(keys[i], int(links[i]), keys[root[i]]) for i in np.flatnonzero(links).tolist()]
            if len(rows) > 10_000:
                yield _linked(rows)
                rows = []
        yield _linked(rows)

    return link


def _linked(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()))], names=["key", "links", "root"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's key and its sorted distinct shingles."""
    for batch in batches:
        for part in common.slices(batch, 0):
            words = Words(part.column(0).to_pylist(), SPACED)
            of, values = words.shingles(SHINGLE)
            bounds = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
            first = words.first.tolist()
            keys = [hashlib.md5(words.hash[a:b].tobytes(), usedforsecurity=False).digest() if b > a else None for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([np.unique(values[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["key", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """``key`` and the least key ``label`` of its connected component, over ``edges`` (key, root): labels take the least of their
    neighbours' and jump to their label's label until nothing changes."""
    tasks = _tasks(edges.sparkSession, 2 * edges.count())
    both = common.stored(edges.filter("key != root").select("key", F.col("root").alias("to")).unionByName(
        edges.filter("key != root").select(F.col("root").alias("key"), F.col("key").alias("to"))).distinct().coalesce(tasks))
    labels = common.stored(both.groupBy("key").agg(F.least(F.min("key"), F.min("to")).alias("label")).coalesce(tasks))
    while True:
        around = both.join(labels.select(F.col("key").alias("to"), F.col("label").alias("seen")), "to").select("key", F.lit(None).cast("binary").alias("old"), "seen")
        lower = around.unionByName(labels.select("key", F.col("label").alias("old"), F.col("label").alias("seen"))).groupBy("key").agg(F.min("old").alias("old"), F.min("seen").alias("label"))
        jumped = lower.join(labels.select(F.col("key").alias("label"), F.col("label").alias("far")), "label", "left")
        table = common.stored(jumped.select("key", "old", F.least("label", F.coalesce("far", "label")).alias("label")).coalesce(tasks))
        changed = not table.filter("label != old").isEmpty()
        labels = table.select("key", "label")
        if not changed:
            return labels


def _mark(text: str = "text"):
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _classes(docs: DataFrame, threshold: float, recall: float, limit: int, depth: int, key: str, text: str) -> DataFrame:
    """One row per document: doc_id, given, mark, and of its text label (the class; null without words), class_id, copy_of, n_copies, n_links."""
    rows = docs.select(identity(key, text).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).isNotNull().alias("given"), _mark(text).alias("mark"))
    sketched = common.stored(_sketched(rows, run_count(threshold, recall)))
    texts = common.stored(sketched.filter("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "sketch", "roots")).alias("s"), F.count("*").alias("copies"))
                          .select("key", F.col("s.doc_id").alias("doc_id"), "s.sketch", "s.roots", "copies"))
    leaves = _leaves(_buckets(texts, limit, depth), texts, limit)
    n = common.partitions(docs.sparkSession)
    compared = "leaf long, node long, side int, key binary, nodes array<long>"
    near = common.stored(leaves.repartition(n, "leaf").sortWithinPartitions("leaf").mapInArrow(_near, compared))
    wanted = near.select("key").distinct().join(texts.select("key", "doc_id", "copies"), "key")
    source = rows.select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    sets = source.mapInArrow(_shingles, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    full = near.join(wanted.join(sets, "key").select("key", "copies", "shingles"), "key").select("leaf", "node", "side", "key", "nodes", "copies", "shingles")
    linked = common.stored(full.repartition(n, "leaf").sortWithinPartitions("leaf").mapInArrow(_linker(threshold), "key binary, links long, root binary"))
    labels = components(linked.select("key", "root"))
    of_text = texts.select("key", F.col("doc_id").alias("copy_of"), "copies").join(linked.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(labels, "key", "left")
    of_text = of_text.withColumn("label", F.coalesce("label", "key"))
    least = common.stored(of_text.groupBy("label").agg(F.min("copy_of").alias("class_id")))
    # Ids may repeat on different texts; of several classes with one least id, the first keeps it.
    owner = least.groupBy("class_id").agg(F.min("label").alias("owner"))
    named = least.join(owner, "class_id").select("label", F.when(F.col("label") == F.col("owner"), F.col("class_id")).otherwise(-1 - F.pmod(F.xxhash64("label"), F.lit(2**62))).alias("class_id"))
    of_text = of_text.join(named, "label").select(
        "key", "label", "class_id", "copy_of", F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sketched.select("doc_id", "given", "mark", "key").join(of_text, "key", "left").drop("key")


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, limit: int = LIMIT, depth: int = DEPTH,
                       key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least id of its component; where ids repeat and several components share their least id, another negative number for all
    but one), copy_of (least id with the same words), n_copies, n_links (other documents at the threshold or above, copies included)."""
    return _classes(docs, threshold, recall, limit, depth, key, text).select(
        F.when(F.col("given"), F.col("doc_id")).alias("doc_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the least id, and of several texts with that id the one with the least hash, with its columns.

    Rows of one id with different texts are different documents; of rows that repeat id and text one stays. Texts without words stay, each
    once per id. Null ids are told apart by their texts, null texts are empty; an empty table stays empty; columns may have any name.
    """
    classes = _classes(docs, THRESHOLD, RECALL, LIMIT, DEPTH, "doc_id", "text")
    alone = F.when(F.col("label").isNull(), F.struct("doc_id", "mark"))
    kept = classes.groupBy("label", alone).agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    name, mark, place = (common.fresh(docs, c) for c in ("identity", "mark", "place"))
    named = docs.withColumns({name: identity("doc_id"), mark: _mark()}).join(kept.select(F.col("first.doc_id").alias(name), F.col("first.mark").alias(mark)), [name, mark], "left_semi")
    same = Window.partitionBy(name, mark).orderBy(F.xxhash64(*docs.columns))
    return named.withColumn(place, F.row_number().over(same)).filter(F.col(place) == 1).select(*docs.columns)
