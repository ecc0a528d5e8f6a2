import hashlib
import random

import numpy as np
import pytest

from editlore.llm import line_dedup
from editlore.llm.line_dedup import PerfectHash, Shard, drop_common_lines

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "text string, doc_id long, _id1 string, _keys long, n_lines string, key string, shard int"


def documents(spark, rows):
    return spark.createDataFrame([(t, i, "a", 1, "b", "c", 2) for i, t in rows], DOCS)


def brute(rows, least, min_points=1):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOW) for x in (t or "").split("\n")] for _, t in rows]
    counts = {}
    for some in keys:
        for k in set(some):
            counts[k] = counts.get(k, 0) + 1
    out = []
    for (i, t), some in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), some) if len(k) < min_points or counts[k] < least]
        out.append((i, len(some), len(some) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_perfect_hash_numbers_without_gaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1_000, 50_000):
        keys = rng.integers(0, 2 ** 64, (n, 2), np.uint64)
        order = PerfectHash.of(keys)
        assert sorted(order.number(keys).tolist()) == list(range(n))
        assert sum(len(x) for x in order.levels) * 8 <= 4 * n + 1_000
    with pytest.raises(ValueError):
        PerfectHash.of(np.zeros((2, 2), np.uint64))


def test_shard_counts_and_round_trip():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2 ** 64, (3_000, 2), np.uint64)
    keys[1::2, 0] = keys[::2, 0]  # one half of the key alone does not tell them apart
    counts = np.where(rng.random(3_000) < 0.1, rng.integers(250, 10 ** 12, 3_000), rng.integers(1, 260, 3_000))
    shard = Shard.from_bytes(Shard.of(keys, counts).to_bytes())
    assert (shard.count(keys) == counts).all()
    assert not shard.count(rng.integers(0, 2 ** 64, (3_000, 2), np.uint64)).any()


@pytest.mark.parametrize("head", [1, 20_000])
@pytest.mark.parametrize("min_points", [1, 4])
def test_common_lines_equal_brute_force(spark, monkeypatch, head, min_points):
    monkeypatch.setattr(line_dedup, "PIECE", 40)
    rng = random.Random(3)
    line = lambda: rng.choice(["", "  ", "Ab c", " ab C\t", "AB c\r", "é", "É", "\x0bé\x0c", "x ", "x", "日本語日", "tail\x1c", "tail", *(f"own {rng.randint(0, 60)}" for _ in range(8))])
    rows = [(k, "\n".join(line() for _ in range(rng.randint(0, 12)))) for k in range(80)]
    rows += [(None, None), (None, None), (None, "x\nAb c"), (7, "x\nAb c"), (7, "x\nAb c"), (81, ""), (82, "\n\n"), (83, "one very long line " * 5_000 + "\n" + "x\n" * 5_000)]
    rows += [(k, "in a third of all\nmine " + str(k)) for k in range(100, 140)]
    got = drop_common_lines(documents(spark, rows), 10, min_points, shard_keys=7, head=head)
    assert got.columns == ["text", "doc_id", "_id1", "_keys", "key", "shard", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute(rows, 10, min_points)


def test_empty_table(spark):
    assert drop_common_lines(documents(spark, []).limit(0)).count() == 0


def test_line_query(spark, tmp_path):
    rows = [(k, f"Shared  \nown {k}\n\nshared") for k in range(10)] + [(20, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op13_line_dedup(spark, str(tmp_path)).collect()}
    assert got[3] == (4, 2, hashlib.sha256(b"own 3\n").hexdigest()) and got[20] == (1, 0, hashlib.sha256(b"").hexdigest())
