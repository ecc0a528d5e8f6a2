import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from editlore.operators import quantiles
from editlore.operators.quantiles import quantile_columns
from editlore.operators.sampling import keep_share, stratified_split, top_by_hash
from editlore.session import Scale

FRACTIONS = [0.25, 0.5, 0.75, 1.0]


@pytest.mark.parametrize("limit", [1_000_000, 50, 5])
def test_matches_numpy(spark, limit):
    rng = random.Random(3)
    data = [("big", rng.choice([rng.random(), 0.5, None]), float(rng.randrange(9))) for _ in range(700)]
    data += [(g, rng.random(), None) for g in "abc" for _ in range(4)] + [("empty", None, None)]
    df = spark.createDataFrame(data, "g string, x double, y double").repartition(5)
    found = quantile_columns(df, ["g"], {"qx": F.col("x"), "qy": F.col("y")}, FRACTIONS, Scale(len(data), limit),
                             extra=[F.count(F.lit(1)).alias("n")]).collect()
    assert {r.g: r.n for r in found} == {"big": 700, "a": 4, "b": 4, "c": 4, "empty": 1}
    for r in found:
        for name, i in (("qx", 1), ("qy", 2)):
            known = [d[i] for d in data if d[0] == r.g and d[i] is not None]
            if known:
                assert np.allclose(r[name], np.quantile(known, FRACTIONS))
            else:
                assert r[name] is None


@pytest.mark.parametrize("counters", [12, 1_024])
def test_refinement_reaches_every_rank(spark, monkeypatch, counters):
    monkeypatch.setattr(quantiles, "COUNTERS", counters)
    rng = random.Random(counters)
    groups = {
        "tails": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(150)], "ends": [1.7e308, -1.7e308, 0.0, 5e-324, -0.5] * 3,
        "copies": [3.5] * 500 + [rng.random() for _ in range(100)], "steps": [float(rng.randrange(1_000)) for _ in range(900)], "one": [2.0],
        "without bound": [float("-inf")] * 6 + [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] + [float("inf")] * 8}
    df = spark.createDataFrame([(g, x, None) for g, xs in groups.items() for x in xs] + [("none", None, None)], "g string, x double, y double")
    found = quantiles._selected(df, ["g"], {"qx": F.col("x"), "qy": F.col("y")}, [0.0, 0.1, 0.5, 0.75, 1.0], 5).collect()
    assert {r.g for r in found} == set(groups) and all(r.qy is None for r in found)
    for r in found:
        xs = sorted(groups[r.g])
        for q, got in zip([0.0, 0.1, 0.5, 0.75, 1.0], r.qx):
            rank = q * (len(xs) - 1)
            low, high = xs[int(rank)], xs[-int(-rank // 1)]
            assert got == pytest.approx(low if low == high else low + (high - low) * (rank - int(rank)), rel=1e-12), (r.g, q)


@pytest.mark.parametrize("limit", [1_000_000, 7])
def test_shares_are_exact_and_repeatable(spark, limit):
    df = spark.range(105).select("id", F.when(F.col("id") < 80, "many").otherwise("few").alias("kind"))
    scale = Scale(105, limit)
    train, test = stratified_split(df, "kind", ["id"], scale)
    assert {r.kind: r["count"] for r in test.groupBy("kind").count().collect()} == {"many": 16, "few": 5}
    assert train.count() + test.count() == 105 and train.join(test, "id").count() == 0
    again = stratified_split(df.repartition(7), "kind", ["id"], scale)[1]
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in test.collect())
    kept = keep_share(df, F.col("kind") == "many", 0.6, ["id"], scale)
    assert {r.kind: r["count"] for r in kept.groupBy("kind").count().collect()} == {"many": 48, "few": 25}


def test_top_by_hash_takes_all_of_small_groups(spark):
    df = spark.range(40).select("id", (F.col("id") % 3).alias("kind"))
    assert sorted(r["count"] for r in top_by_hash(df, "kind", ["id"], 5).groupBy("kind").count().collect()) == [5, 5, 5]
    assert top_by_hash(df, "kind", ["id"], 100).count() == 40
