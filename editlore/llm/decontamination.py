"""Benchmark decontamination by winnowing.

Fingerprints: of every window of ``WINDOW`` words, that is of ``WINDOW - GRAM + 1`` runs of ``GRAM`` words, the run with the least hash is
kept (the rightmost of equals). Any span of ``WINDOW`` words that a document shares with a benchmark item gives both the same least
run, so a join of fingerprints misses none. Each hit is extended to both sides word by word; spans of ``WINDOW`` words or more are
occurrences. An item with fewer words is one window of all its words, found by runs of its length.

The benchmark is split into blocks of items of bounded size. A block's fingerprints are broadcast and joined to the documents' in their
tasks, so documents are not shuffled; with several blocks the rows that had hits are merged per document. Items with the same words are one item
with several ids.

Null and empty texts have no words: such a document has no hits, such an item no windows. An item without id counts under an empty one. Equal ids keep all their rows. Only the named columns
are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.llm import common
from editlore.llm.words import Words

WINDOW = 10
GRAM = 5
BLOCK_WORDS = 2_000_000  # words of benchmark items in one block; about 100 MB with its indexes in a task


class Block:
    """Fingerprints and words of some items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        words = Words([text for _, text in items])
        ids: dict[bytes, list[str]] = defaultdict(list)
        spans: dict[bytes, np.ndarray] = {}
        for k, (item, _) in enumerate(items):
            some = words.hash[words.first[k]:words.first[k + 1]]
            if len(some):
                ids[some.tobytes()].append("" if item is None else str(item))
                spans[some.tobytes()] = some
        self.ids = list(ids.values())
        self.words = list(spans.values())
        marks: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, int]] = defaultdict(dict)  # length -> hash of all words -> item
        for k, some in enumerate(self.words):
            if len(some) < window:
                self.short[len(some)][int(_runs(some, len(some))[0])] = k
            else:
                grams = _runs(some, gram)
                for at in winnow(grams, window - gram + 1).tolist():
                    marks[int(grams[at])].append((k, at))
        self.marks = dict(marks)
        self.sorted = np.sort(np.fromiter(self.marks, np.uint64, len(self.marks)))
        self.sorted_short = {n: np.sort(np.fromiter(found, np.uint64, len(found))) for n, found in self.short.items()}

    def hits(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
        """By text: spans of words inside occurrences, and items with occurrences."""
        out: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        grams = words.runs(self.gram)
        if len(grams) and len(self.sorted):
            # A fingerprint of a text that touches no other text; windows across two texts only add harmless candidates.
            kept = np.unique(np.concatenate([winnow(grams, self.window - self.gram + 1), _borders(words, self.window, self.gram, len(grams))]))
            at = kept[_among(grams[kept], self.sorted) & words.whole(self.gram)[kept]]
            done: dict[tuple[int, int], int] = {}  # (item, diagonal) -> end of the last span there
            for p in at.tolist():
                text = int(words.text[p])
                low, high = int(words.first[text]), int(words.first[text + 1])
                for k, q in self.marks[int(grams[p])]:
                    if done.get((k, p - q), -1) > p:
                        continue
                    item = self.words[k]
                    a, b = _extend(words.hash, item, p, q, low, high, self.gram)
                    done[k, p - q] = b
                    if b - a >= self.window:
                        spans, found = out.setdefault(text, ([], set()))
                        spans.append((a - low, b - low))
                        found.add(k)
        for n, known in self.sorted_short.items():
            runs = words.runs(n)
            for p in np.flatnonzero(_among(runs, known) & words.whole(n)).tolist():
                text = int(words.text[p])
                k = self.short[n][int(runs[p])]
                spans, found = out.setdefault(text, ([], set()))
                spans.append((p - int(words.first[text]), p - int(words.first[text]) + n))
                found.add(k)
        return out


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    some = Words.__new__(Words)
    some.hash = words
    return some.runs(n)


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash in every window of ``width``, the rightmost of equals."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, width):
        better = hashes[i:n + i] <= best
        best[better] = hashes[i:n + i][better]
        at[better] = np.flatnonzero(better) + i
    return np.unique(at)


def _borders(words: Words, window: int, gram: int, n: int) -> np.ndarray:
    """Places near the first and last words of texts, where windows of several texts overlap."""
    around = np.arange(-window, window)
    at = (words.first[:, None] + around).ravel()
    return np.unique(at[(at >= 0) & (at < n)])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _extend(doc: np.ndarray, item: np.ndarray, p: int, q: int, low: int, high: int, gram: int) -> tuple[int, int]:
    """The span of ``doc`` around place ``p`` that equals ``item`` around ``q``."""
    left = min(p - low, q)
    equal = doc[p - left:p][::-1] == item[q - left:q][::-1]
    a = p - (left if equal.all() else int(equal.argmin()))
    right = min(high - p, len(item) - q)
    equal = doc[p:p + right] == item[q:q + right]
    return a, p + (right if equal.all() else int(equal.argmin()))


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``block_words`` words, or one item."""
    block, size = [], 0
    for row in common.texts(benchmark, key, text).toLocalIterator():
        words = len(row[1]) // 2 + 1
        if block and size + words > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += words
    if block:
        yield block


def _scan(docs: DataFrame, items: list[tuple[int, str]], window: int, gram: int, finish: Callable, schema: str) -> DataFrame:
    """One pass over ``docs`` (columns key, text, and any others) against a broadcast block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value, window, gram)
        for batch in batches:
            for part in common.slices(batch, 1):
                words = Words(part.column(1).to_pylist())
                hits = block.hits(words)
                yield finish(block, part, words, hits)

    return docs.mapInArrow(run, schema)


def covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, n_words, the spans of words that occur in the benchmark (array of [start, end)), and the ids of the items (as strings)."""
    rows = common.texts(docs, key, text)
    schema = "doc_id long, n_words long, spans array<array<long>>, items array<string>"
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def finish(block, part, words, hits):
        found = [hits.get(k, ([], set())) for k in range(len(part))]
        return pa.RecordBatch.from_pydict({
            "doc_id": part.column(0).cast(pa.int64()), "n_words": np.diff(words.first), "spans": [[list(s) for s in sorted(set(spans))] for spans, _ in found],
            "items": [sorted(i for k in items for i in block.ids[k]) for _, items in found]}, schema=kinds)

    blocks = blocks_of(benchmark, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(rows, first, window, gram, finish, schema)
    # Several blocks: rows get a number that all passes share, and their hits are merged by it.
    numbered = common.stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    wide = numbered.select(F.col("_row").alias("doc_id"), "text")
    parts = _scan(wide, first, window, gram, finish, schema)
    while second is not None:
        parts = parts.unionByName(_scan(wide, second, window, gram, finish, schema))
        second = next(blocks, None)
    merged = parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
                                         F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.withColumnRenamed("doc_id", "_row").join(numbered.select("doc_id" if key == "doc_id" else F.col(key).alias("doc_id"), "_row"), "_row").drop("_row")


def n_hit(spans: str = "spans"):
    """Words inside at least one of the spans."""
    step = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(s[0], acc.end))).alias("n"), F.greatest(acc.end, s[1]).alias("end")))
    return step.n


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any passage of the benchmark, with their columns."""
    blocks = blocks_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    kept = docs
    for items in blocks:
        kept = _clean(kept, items)
    return kept


def _clean(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    held: list[Block] = []

    def hits(texts: list[str]) -> np.ndarray:
        if not held:
            held.append(Block(shared.value))
        out = np.zeros(len(texts), np.int64)
        for k, (spans, _) in held[0].hits(Words(texts)).items():
            out[k] = covered(spans)
        return out

    name = common.fresh(docs, "n_hit")
    return common.add_column(docs, name, "long", hits).filter(F.col(name) == 0).drop(name)
