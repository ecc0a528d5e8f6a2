"""Toxicity by compression distance: windows are compressed with a dictionary of ordinary text and with one that adds toxic text.

There are two zstandard dictionaries from labelled texts. The ordinary one is trained by zstandard on ordinary texts. The toxic one is not trained:
the trainer picks what recurs, which in toxic texts is mostly ordinary (README has figures). It is a list of what makes texts toxic: runs of five bytes
inside words that are many times more frequent in toxic than in ordinary texts, joined where they overlap. A run
needs a fixed number of texts, however many were sampled, and the list has room for all of them. It is laid before the ordinary dictionary, so that a
window without toxic strings compresses to the same length with both, and the difference in bytes measures toxic content alone. Windows are short,
so that literals are stored as they are and every saved byte comes from a match. Words of up to three ASCII letters are
repeated before everything else, so that they hold a run and a match saves bytes.

A text's gains (their sum, largest, number and share of windows) go through a logistic regression; its score is stretched so that the cut with the
best balanced accuracy on the training texts lies at 0.3. A text without words scores as one window without gain. Without
labelled texts of both kinds there is no model and every score is 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlore.llm import common

PER_CLASS = 5_000  # labelled texts of each class to fit on
WINDOW, STEP = 60, 48  # bytes; the overlap is longer than a toxic stem
GRAM = 5
MIN_DOCS, MIN_RATIO = 4, 12.0  # toxic texts with a run; how much more frequent it is in toxic texts
ORDINARY_BYTES = 6_000
FOLDS, HELD_OUT = 4, 2
CUT = 0.3

_SHORT = [(re.compile(rb"(?<![a-z\x80-\xff])([a-z]{%d})(?![a-z\x80-\xff\x01-\x04])" % n), b"".join(b"\\1" + bytes([k]) for k in range(1, times + 1))) for n, times in ((3, 2), (2, 3), (1, 4))]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    cut: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        pair = _compressors(self.ordinary, self.toxic)
        x = _scaled(np.array([gains(normal(t), *pair) for t in texts]))
        p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.weights, -30, 30)))
        return common.stretched(p, self.cut, CUT)


def normal(text: str) -> bytes:
    """Lower case, white space as single spaces, one at each end; words of up to three ASCII letters are repeated, since a match of the bare
    word would save nothing. What stands between the repeats differs, so that they do not match each other."""
    data = b" " + b" ".join(text.lower().encode().split()) + b" "
    for short, longer in _SHORT:
        data = short.sub(longer, data)
    return data


def grams(data: bytes) -> np.ndarray:
    """Runs of ``GRAM`` bytes as numbers, 0 where a run leaves a word (only its first byte may be the space before)."""
    a = np.frombuffer(data, np.uint8)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    letter = ((a >= 97) & (a <= 122)) | (a >= 128) | ((a >= 1) & (a <= 4))
    inside = letter | (a == 32)
    found, ok = np.zeros(n, np.uint64), inside[:n].copy()
    for i in range(GRAM):
        found = found << np.uint64(8) | a[i:n + i]
        ok &= letter[i:n + i] if i else inside[:n]
    return np.where(ok, found, np.uint64(0))


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts, the number of texts with each, and its number in all."""
    values, docs, times = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for k in range(0, len(texts), 500):
        found = [np.unique(grams(t), return_counts=True) for t in texts[k:k + 500]]
        more = [values, *(v for v, _ in found)], [docs, *(np.ones(len(v)) for v, _ in found)], [times, *(n for _, n in found)]
        values, at = np.unique(np.concatenate(more[0]), return_inverse=True)
        docs, times = (np.bincount(at, np.concatenate(c), len(values)) for c in more[1:])
    return values, docs, times


def toxic_runs(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, int]:
    """Strings of distinctive runs in toxic texts and how often each occurs."""
    values, docs, times = _counts(toxic)
    others, _, other_times = _counts(ordinary)
    at = np.minimum(np.searchsorted(others, values), max(0, len(others) - 1))
    known = np.where(others[at] == values, other_times[at], 0) if len(others) else np.zeros(len(values))
    ratio = times / max(1, sum(map(len, toxic))) / ((known + 1) / max(1, sum(map(len, ordinary))))
    distinct = values[(values > 0) & (docs >= MIN_DOCS) & (ratio >= MIN_RATIO)]
    runs: dict[bytes, int] = {}
    for text in toxic:
        edges = np.diff(np.concatenate([[0], np.isin(grams(text), distinct).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            run = text[a:b + GRAM - 1]
            runs[run] = runs.get(run, 0) + 1
    return runs


def _trained(samples: list[bytes], size: int) -> bytes:
    """Dictionary content selected by zstandard's trainer; too few samples to train on are the dictionary themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\0".join(samples)[-size:]


def _compressors(ordinary: bytes, toxic: bytes):
    import zstandard

    out = []
    for content in (ordinary, toxic + b"\0" + ordinary):
        # Plain content without entropy tables; thorough search, so that a longer dictionary does not hide matches of a shorter one. Binary trees,
        # since the lazy strategies find only matches in the dictionary's last 8 KB.
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        log = max(15, (len(content) + WINDOW).bit_length())  # all of the dictionary is in reach
        how = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log, search_log=8, min_match=GRAM, target_length=16,
                                                  strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        data.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress)
    return out


def gains(data: bytes, ordinary, toxic) -> tuple[float, float, float, float]:
    """Sum, largest and number of the windows' saved bytes, and the number of windows."""
    windows = [data[i:i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]
    saved = np.fromiter(map(len, map(ordinary, windows)), np.int64, len(windows)) - np.fromiter(map(len, map(toxic, windows)), np.int64, len(windows))
    saved = np.maximum(saved, 0)
    return float(saved.sum()), float(saved.max()), float((saved > 0).sum()), float(len(windows))


def _scaled(x: np.ndarray) -> np.ndarray:
    total, most, hits, windows = x.T
    return np.column_stack([np.log1p(total), most / 4, np.log1p(hits), total / (windows + 10), np.log1p(windows) / 4])


def fit(sample: list[tuple[str, int]]) -> Model | None:
    """A model from (text, label) rows; three quarters of each class make the dictionaries, the others the calibration."""
    byes = [[normal(t) for t, label in sample if label == value] for value in (0, 1)]
    if min(map(len, byes)) < 4:
        return None
    most = [[t for k, t in enumerate(b) if k % 4 < 3] for b in byes]
    runs = toxic_runs(most[1], most[0])
    ordered = sorted(runs, key=lambda run: (runs[run], run))
    toxic = b"\0".join(ordered)
    ordinary = _trained(most[0][:800], 2 * ORDINARY_BYTES)[-ORDINARY_BYTES:]
    pair = _compressors(ordinary, toxic)
    rest = [b[3::4] for b in byes]
    x = _scaled(np.array([gains(t, *pair) for b in rest for t in b]))
    y = np.repeat([0, 1], list(map(len, rest)))
    weights = common.logistic(x, y)
    p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ weights, -30, 30)))
    return Model(ordinary, toxic, weights, common.best_cut(p, y))


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(common.labelled(docs, labels, "toxic", PER_CLASS, FOLDS, HELD_OUT))


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1; null texts are empty."""
    return common.add_column(docs, name, "double", model.scores if model else lambda texts: np.zeros(len(texts)))


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (common.fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                                     (F.col("score") >= CUT).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents not predicted toxic, with their columns."""
    model = trained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = common.fresh(docs, "toxicity")
    return score(docs, model, name).filter(F.col(name) < CUT).drop(name)
