"""Grouping of spelling variants: words that one edit tells apart, by dense tiles of code-point matrices.

Two words, the longer of ``most`` code points, differ by one inserted, deleted or replaced code point if and only if their common prefix and
common suffix together reach ``most - 1``. So the longer half of that length is in the prefix or in the suffix, and words meet in tiles of one ``most``
whose words share so much of their beginning, or of their end. In a tile the words stand in two matrices of code points, padded by at most one column, one
aligned left and one right; rows are compared in blocks of bounded size, and prefix and suffix are read off the first unequal columns.

A tile of more than ``TILE`` words is split the same way: of what prefix and suffix still lack, the longer half is in either of them. This goes on until a tile
is small or lacks nothing; then its words differ in one known place, so it has no more words than there are letters. Every near pair is found in exactly one tile: where the prefix
reaches far enough, the prefix's tile has the pair, else the suffix's. No tile emits pairs: it gives one row per word with the number of near words and the best of
them, and these are added up.

Words are counted where texts lie, in dictionaries of bounded size, and added by Spark. A null text has no words, a null id counts as an empty one; repeated rows count
again; very long texts are worked through in pieces. Ties of n go to the smaller word in code-point order. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.llm import common

MIN_POINTS = 6
LEAST = 5  # occurrences of a word
TIMES = 5  # a form is so many times as frequent
MARK = 199  # runs whose hash this divides lose a code point
TILE = 512  # words of one tile
CELLS = 4_000_000  # code points compared at once
HELD = 200_000  # words counted at once in a task
PIECE = 2_000_000  # code points of a text looked at at once
FREE = 2_000_000_000  # any prefix

LETTERS = "a-zÀ-ÿ"  # after A-Z are lower-cased; one byte each in Latin-1
TILE_KEYS = ["most", "head", "tail", "cap", "key"]


def pieces(text: str, no_letter: re.Pattern) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` code points, cut where no run is."""
    start = 0
    while len(text) - start > PIECE:
        cut = no_letter.search(text, start + PIECE)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.end()
    yield text[start:] if start else text


def runs(text: str, min_points: int) -> Counter:
    """The runs of letters of at least ``min_points``, in lower case (A-Z only), and how often they occur."""
    found: Counter = Counter()
    long_run, no_letter = re.compile(f"[{LETTERS}]{{{min_points},}}"), re.compile(f"[^{LETTERS}]")
    for piece in pieces(text.encode().lower().decode(), no_letter):  # bytes: A-Z only
        found.update(long_run.findall(piece))
    return found


def word_counts(docs: DataFrame, min_points: int = MIN_POINTS, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of the words with at least ``min_points`` code points and ``least`` occurrences."""
    def count(batches):
        total: dict[str, int] = {}

        def packed():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        for batch in batches:
            for part in common.slices(batch, 1):
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in runs(value, min_points).items():
                        h = zlib.crc32(run.encode(), before)
                        if h % MARK == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < min_points:
                                continue
                        total[run] = total.get(run, 0) + n
                    if len(total) >= HELD:
                        yield packed()
                        total = {}
        yield packed()

    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _split(rows: DataFrame) -> DataFrame:
    """The tiles below each tile: words that share half of what is lacking in the prefix, and in the suffix."""
    half = F.expr("(most - head - tail) div 2")  # the longer half of most - 1 - head - tail
    as_int = lambda c: c.cast("int")
    both = F.array(
        F.struct(as_int(F.col("head") + half).alias("head"), F.col("tail"), F.col("cap")),
        F.struct(F.col("head"), as_int(F.col("tail") + half).alias("tail"), as_int(F.least("cap", F.col("head") + half)).alias("cap")))
    below = rows.select("most", "word", "n", F.explode(both).alias("t")).select("most", "word", "n", "t.head", "t.tail", "t.cap").filter("head < cap")
    return below.withColumn("key", F.xxhash64(F.expr("left(word, head)"), F.expr("right(word, tail)"))).select(*TILE_KEYS, "word", "n")


class Rows:
    """Words of some tiles of one ``most``, longer words first in each tile."""

    def __init__(self, words: list[str], n: np.ndarray, starts: np.ndarray, most: int, head: np.ndarray, tail: np.ndarray, cap: np.ndarray):
        self.words, self.n, self.most, self.head, self.tail, self.cap = words, n, most, head, tail, cap
        codes = [w.encode("latin-1") for w in words]
        self.left = np.frombuffer(b"".join(c.ljust(most, b"\0") for c in codes), np.uint8).reshape(-1, most)
        self.right = np.frombuffer(b"".join(c.rjust(most, b"\0") for c in codes), np.uint8).reshape(-1, most)
        ends = np.append(starts[1:], len(words))
        long = np.array([len(c) == most for c in codes])
        self.after = np.where(long, np.repeat(ends, ends - starts) - np.arange(len(words)) - 1, 0)  # words that each is compared with

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of what is compared, block by block."""
        rows = np.flatnonzero(self.after)
        most = max(1, CELLS // self.most)
        total = np.cumsum(self.after[rows])
        at = 0
        while at < len(rows):
            done = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, done + most, "right")))
            some, size = rows[at:stop], self.after[rows[at:stop]]
            one = np.repeat(some, size)
            other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size)
            for k in range(0, len(one), most):
                yield one[k:k + most], other[k:k + most]
            at = stop

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """The near pairs that belong to their tile."""
        found = []
        for one, other in self.blocks():
            prefix = (self.left[one] == self.left[other]).argmin(axis=1)  # words differ, so some column does
            suffix = (self.right[one] == self.right[other])[:, ::-1].argmin(axis=1)
            ok = (prefix + suffix >= self.most - 1) & (prefix >= self.head[one]) & (suffix >= self.tail[one]) & (prefix < self.cap[one])
            found.append((one[ok], other[ok]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def summed(self) -> pa.RecordBatch | None:
        """word, n_near, best, best_n of the words with a near one."""
        one, other = self.near()
        if not len(one):
            return None
        one, other = np.concatenate([one, other]), np.concatenate([other, one])
        place = np.empty(len(self.words), np.int64)
        place[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        order = np.lexsort((place[other], -self.n[other], one))
        one, other = one[order], other[order]
        first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        return pa.RecordBatch.from_pydict({
            "word": pa.array([self.words[k] for k in one[first]], pa.string()), "n_near": np.diff(np.append(first, len(one))),
            "best": pa.array([self.words[k] for k in other[first]], pa.string()), "best_n": self.n[other[first]]})


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles arrive one after the other; as many as are complete are compared together."""
    held: list[pa.RecordBatch] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in TILE_KEYS])
        changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        stop = len(keys) if last else int(changes[-1]) if len(changes) else 0
        starts = np.append(0, changes[changes < stop])
        words, n = table.column("word").slice(0, stop).to_pylist(), table.column("n").to_numpy()
        of_most = np.flatnonzero(np.append(True, keys[starts[1:], 0] != keys[starts[:-1], 0])) if stop else []
        for k, at in enumerate(of_most):
            some = starts[at:of_most[k + 1] if k + 1 < len(of_most) else len(starts)]
            low, high = int(some[0]), int(starts[of_most[k + 1]]) if k + 1 < len(of_most) else stop
            found = Rows(words[low:high], n[low:high], some - low, int(keys[low, 0]), *(keys[low:high, c] for c in (1, 2, 3))).summed()
            if found is not None:
                yield found
        held.clear()
        if stop < len(keys):
            held.extend(table.slice(stop).to_batches())

    points = 0
    for batch in batches:
        held.append(batch)
        points += int(batch.column(0).to_numpy().sum()) if len(batch) else 0
        if points >= CELLS:
            yield from flush(False)
            points = sum(int(b.column(0).to_numpy().sum()) for b in held) // 2
    if held:
        yield from flush(True)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, best, best_n for the words (word, n; each once) that have a near word; best is the most frequent of them."""
    spark = words.sparkSession
    points = F.char_length("word")
    rows = common.stored(_split(words.select(
        F.explode(F.array(points, points + 1)).alias("most"), "word", "n").withColumns({"head": F.lit(0), "tail": F.lit(0), "cap": F.lit(FREE)})))
    small = None
    while True:
        sizes = rows.filter("head + tail < most - 1").groupBy(*TILE_KEYS).agg(F.count(F.lit(1)).alias("_n"))
        hot = common.stored(sizes.filter(F.col("_n") > tile).drop("_n"))
        if hot.isEmpty():
            small = rows if small is None else small.unionByName(rows)
            break
        cold = rows.join(hot, TILE_KEYS, "left_anti")
        small = cold if small is None else small.unionByName(cold)
        rows = common.stored(_split(rows.join(hot, TILE_KEYS, "left_semi")))
    placed = small.repartition(common.partitions(spark), *TILE_KEYS).sortWithinPartitions(*TILE_KEYS, F.desc(points))
    found = placed.mapInArrow(_compared, "word string, n_near long, best string, best_n long")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")).select(
        "word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def variants(words: DataFrame, times: int = TIMES, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words (word, n).

    Along forms n grows ``times`` over with each step, so the way to a root is short, and doubling it reaches all roots in a few rounds.
    """
    near = near_words(words, tile)
    whole = F.col("best_n") >= times * F.col("n")
    joined = common.stored(words.join(near, "word", "left").select(
        "word", F.when(whole, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(whole, F.col("best_n")).alias("form_n")))
    up = joined.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = common.stored(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_more")))
        more = not up.filter("_more").isEmpty()
        up = up.drop("_more")
        if not more:
            break
    return joined.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.stored(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


SQL = r"""
WITH RECURSIVE
crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) x(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (
  SELECT run, n, list_transform(range(strlen(s)), lambda i:
    16 * (strpos('0123456789ABCDEF', hex(encode(s))[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', hex(encode(s))[2 * i + 2]) - 1) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT x.word AS word, y.word AS other FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, w.word FROM holes x JOIN w ON w.word = x.a || x.b
  UNION SELECT w.word, x.word FROM holes x JOIN w ON w.word = x.a || x.b),
best AS (
  SELECT p.word, o.word AS other, o.n AS other_n, count(*) OVER (PARTITION BY p.word) AS n_near
  FROM pairs p JOIN w o ON o.word = p.other QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, o.word) = 1),
f AS MATERIALIZED (
  SELECT w.word, CASE WHEN other_n >= 5 * n THEN other END AS form, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
up AS (
  SELECT word, word AS root, 0 AS steps FROM f
  UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM up GROUP BY word) r ON r.word = f.word
"""
