import hashlib
import math
import random

import pytest

from editlore.llm import sharded_lloyd
from editlore.llm.sharded_lloyd import lloyd

VECTORS = "label string, embedding array<float>, vec_id long, block int, chunk long, x string"


def vectors(spark, rows):
    return spark.createDataFrame([("l", x, i, 1, 2, "x") for i, x in rows], VECTORS)


def brute(rows, k, rounds, dimensions, scale=64):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == dimensions and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str), centres


@pytest.mark.parametrize("dimensions, block, k", [(64, 16, 16), (5, 2, 3), (3, 8, 7), (1, 1, 4)])
def test_lloyd_equals_brute_force(spark, monkeypatch, dimensions, block, k):
    monkeypatch.setattr(sharded_lloyd, "CHUNK_CELLS", 11 * k)
    rng = random.Random(dimensions)
    rows = [(n, [rng.choice([-0.75, -0.5, 0.0, 0.25, 1.0]) + (n % 3) for _ in range(dimensions)]) for n in range(150)]
    rows += [(n, [0.5] * dimensions) for n in range(200, 290)]  # a hot group of copies; ties
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[5][1])]
    rows += [(300, None), (301, []), (302, [1.0] * (dimensions + 1)), (303, [math.nan] * dimensions), (304, [None] * dimensions), (305, [math.inf] * dimensions), (306, [-math.inf] * dimensions)]
    assigned, centroids = lloyd(vectors(spark, rows), k, 3, dimensions, block=block)
    want, centres = brute(rows, k, 3, dimensions)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in assigned.collect()), key=str) == want
    assert {r.cluster: r["values"] for r in centroids.collect()} == dict(enumerate(centres))


def test_few_none_and_large_vectors(spark):
    assigned, centroids = lloyd(vectors(spark, [(1, [1.0, 2.0]), (2, [9.0, 9.0])]), 16, 3, 2)
    assert sorted(r.distance for r in assigned.collect()) == [0, 0] and centroids.count() == 2
    assigned, _ = lloyd(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]), 1)
    assert all(0 <= r.distance < 2 ** 63 for r in assigned.collect())
    assigned, centroids = lloyd(vectors(spark, [(1, None)]))
    assert assigned.count() == centroids.count() == 0
    with pytest.raises(ValueError):
        lloyd(vectors(spark, []), 10 ** 7)


def test_empty_centroids_stay(spark):
    rows = [(n, [0.0]) for n in range(20)] + [(50, [1.0])]
    assigned, centroids = lloyd(vectors(spark, rows), 4, 3, 1)
    want, centres = brute(rows, 4, 3, 1)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in assigned.collect()), key=str) == want
    assert {r.cluster: r["values"] for r in centroids.collect()} == dict(enumerate(centres))


def test_query_on_an_empty_table(spark, tmp_path):
    vectors(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sharded_lloyd.op12_sharded_lloyd(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0
