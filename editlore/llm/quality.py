"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares of kinds of characters, repetition of words and of lines, and
length, of the line itself and of the lines before and after; neighbouring labels interact through a transition matrix. Training lines
first take the label of their document; lines of bad documents that the fitted field takes for good are then good, and it is fitted again. A
document's quality is the mean of its lines' forward-backward marginals, weighted by length, stretched so that the cut with the best
balanced accuracy on the training documents lies at 0.3. An empty text is one empty line. Without labelled documents of both kinds
every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.llm import common

PER_CLASS = 2_000  # labelled texts of each class to fit on
FOLDS, HELD_OUT = 5, 0
CUT = 0.3
ROUNDS = 3  # fits, each but the first after lines were labelled anew
STEPS = 80

_KINDS = 8


def _table() -> np.ndarray:
    """Kinds of bytes: 0 rest, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence signs, 6 other signs, 7 beyond ASCII."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 6
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 1, 2, 3, 7
    kinds[[9, 10, 13, 32]] = 4
    kinds[[ord(c) for c in ".,;:?'\"-()"]] = 5
    return kinds


_TABLE = _table()
_POWER = np.uint64(0x9E3779B97F4A7C15)


def lines_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (lines x features), each line's document, and each line's bytes."""
    data = np.frombuffer("\n".join(texts).encode() + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.insert(ends[:-1] + 1, 0, 0)
    doc = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
    size = ends - starts
    kinds = _TABLE[data]
    counts = np.column_stack([_between(kinds == k, starts, ends) for k in range(1, _KINDS)]).astype(np.float64)
    word = kinds != 4
    first = np.flatnonzero(word & ~np.insert(word[:-1], 0, False))
    last = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    # A word's hash: its bytes times growing powers, moved to the word's start.
    with np.errstate(over="ignore"):
        mixed = (data.astype(np.uint64) + np.uint64(1)) * _POWER
        mixed ^= mixed >> np.uint64(29)
        place = np.arange(len(data), dtype=np.int64)
        inside = place - np.repeat(first, last - first)[np.cumsum(word) - 1] if len(first) else place
        mixed *= (inside.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(np.where(word, mixed, np.uint64(0)))])
        hashes = sums[last] - sums[first]
        same = np.zeros(len(data), bool)
        if len(first) > 1:
            line = np.searchsorted(ends, first)
            same[first[1:]] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        starts_word = np.zeros(len(data), bool)
        starts_word[first] = True
        line_hash = sums[ends] - sums[starts] + size.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    words, repeats = _between(starts_word, starts, ends), _between(same, starts, ends)
    _, at, often = np.unique(line_hash, return_inverse=True, return_counts=True)
    n = np.maximum(size, 1)
    plain = np.column_stack([
        counts / n[:, None], repeats / np.maximum(words, 1), (often[at] > 1) & (size > 0), np.log1p(size) / 8, np.log1p(words) / 6,
        (size - counts[:, 3]) / np.maximum(words, 1) / 10])
    return plain, doc, size


def _between(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks)])
    return sums[ends] - sums[starts]


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at a document's ends), and a constant."""
    same = (doc[1:] == doc[:-1])[:, None]
    none = np.zeros((min(1, len(x)), x.shape[1]))
    before, after = np.vstack([none, x[:-1] * same]), np.vstack([x[1:] * same, none])
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def marginals(node: np.ndarray, doc: np.ndarray, pair: np.ndarray, both: bool = False):
    """Each line's probability to be good, by forward and backward passes over all documents at once, line by line.

    ``node`` is the log-odds of good for each line alone, ``pair`` the 2 x 2 log weights of neighbouring labels. With ``both``, also the
    expected number of each pair of labels.
    """
    begins = np.flatnonzero(np.insert(doc[1:] != doc[:-1], 0, True)) if len(doc) else np.zeros(0, np.int64)
    length = np.diff(np.append(begins, len(doc)))
    order = np.argsort(-length, kind="stable")
    begins, length = begins[order], length[order]
    odds = np.column_stack([np.zeros(len(node)), np.clip(node, -30, 30)])
    weight = np.exp(odds - odds.max(axis=1, keepdims=True))
    step = np.exp(pair)
    ahead, back = np.empty_like(weight), np.ones_like(weight)
    longest = int(length[0]) if len(length) else 0
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(longest)]  # documents with more than t lines
    for t in range(longest):
        rows = begins[:alive[t]] + t
        f = weight[rows] if t == 0 else (ahead[rows - 1] @ step) * weight[rows]
        ahead[rows] = f / f.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        rows = begins[:alive[t + 1]] + t
        b = (back[rows + 1] * weight[rows + 1]) @ step.T
        back[rows] = b / b.sum(axis=1, keepdims=True)
    p = ahead * back
    p /= p.sum(axis=1, keepdims=True)
    if not both:
        return p[:, 1]
    first = np.flatnonzero(doc[1:] == doc[:-1])
    joint = ahead[first][:, :, None] * step * (weight[first + 1] * back[first + 1])[:, None, :]
    return p[:, 1], (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    cut: float = 0.5

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, doc, size = lines_of(texts)
        node = with_neighbours(np.clip((x - self.mean) / self.spread, -5, 5), doc) @ self.weights
        return marginals(node, doc, self.pair), doc, size

    def raw(self, texts: list[str]) -> np.ndarray:
        p, doc, size = self.lines(texts)
        weight = size + 1.0
        return np.bincount(doc, p * weight, len(texts)) / np.bincount(doc, weight, len(texts))

    def scores(self, texts: list[str]) -> np.ndarray:
        return common.stretched(self.raw(texts), self.cut, CUT) if texts else np.zeros(0)


def _chunks(texts: list[str], most: int = 1_000_000) -> list[list[str]]:
    """The texts in lists of about ``most`` characters, which bounds the memory for their features."""
    out, size = [[]], 0
    for text in texts:
        if out[-1] and size + len(text) > most:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out


def _gathered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found, docs, before = [], [], 0
    for some in _chunks(texts):
        x, doc, _ = lines_of(some)
        found.append(x)
        docs.append(doc + before)
        before += len(some)
    return np.vstack(found), np.concatenate(docs)


def fit(sample: list[tuple[str, int]]) -> Model | None:
    """A field fitted to (text, label) rows by gradient steps on the likelihood of the lines' labels."""
    texts, labels = [t for t, _ in sample], np.array([label for _, label in sample])
    if len(set(labels.tolist())) < 2:
        return None
    x, doc = _gathered(texts)
    model = Model(np.zeros(3 * x.shape[1] + 1), np.zeros((2, 2)), x.mean(axis=0), x.std(axis=0) + 1e-3)
    wide = with_neighbours(np.clip((x - model.mean) / model.spread, -5, 5), doc)
    truth = labels[doc].astype(np.float64)
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    of_line = share[doc] / np.bincount(doc)[doc]
    for k in range(ROUNDS):
        _descend(model, wide, doc, truth, of_line)
        if k < ROUNDS - 1:
            p = marginals(wide @ model.weights, doc, model.pair)
            truth = np.where(labels[doc] == 1, 1.0, (p > 0.5).astype(np.float64))
    model.cut = common.best_cut(np.concatenate([model.raw(some) for some in _chunks(texts)]), labels)
    return model


def _descend(model: Model, wide: np.ndarray, doc: np.ndarray, truth: np.ndarray, of_line: np.ndarray) -> None:
    """Adam steps on the mean log-likelihood; lines count so that documents and classes weigh alike."""
    first = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = truth[first].astype(int) * 2 + truth[first + 1].astype(int)
    seen = np.bincount(pairs, minlength=4).reshape(2, 2).astype(np.float64)
    moments = [np.zeros(len(model.weights) + 4), np.zeros(len(model.weights) + 4)]
    for step in range(1, STEPS + 1):
        p, expected = marginals(wide @ model.weights, doc, model.pair, both=True)
        node = wide.T @ (of_line * (p - truth)) / of_line.sum() + 1e-4 * model.weights
        grad = np.concatenate([node, ((expected - seen) / max(1, len(first)) + 1e-3 * model.pair).ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        change = 0.1 * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-8)
        model.weights = model.weights - change[:-4]
        model.pair = np.clip(model.pair - change[-4:].reshape(2, 2), -3, 3)


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(common.labelled(docs, labels, "quality", PER_CLASS, FOLDS, HELD_OUT))


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with a quality score from 0 to 1; null texts are empty."""
    return common.add_column(docs, name, "double", model.scores if model else lambda texts: np.full(len(texts), 0.5))


def op9_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (common.fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                                     (F.col("score") >= CUT).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents predicted good, with their columns."""
    model = trained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = common.fresh(docs, "quality")
    return score(docs, model, name).filter(F.col(name) >= CUT).drop(name)
