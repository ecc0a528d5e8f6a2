import random

import pytest
from pyspark.sql import functions as F

from editlore.operators.ranking import cumulated, roc_auc, roc_curve


def test_area_equals_pairs_and_curve_equals_counts(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice([None, float("nan"), *(float(x) for x in range(9))]), int(rng.random() < 0.4)) for g in ("a", "b", None) for _ in range(120)]
    rows += [("ties", 1.0, k % 2) for k in range(50)] + [("positive only", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int").repartition(5)
    counts = cumulated(df, "s", "y", ["g"])
    order = lambda s: -1.0 if s is None else 99.0 if s != s else s
    for r in roc_auc(counts, ["g"]).collect():
        up, down = ([order(s) for g, s, y in rows if g == r.g and y == k] for k in (1, 0))
        if down:
            assert r.roc_auc == pytest.approx(sum((u > d) + (u == d) / 2 for u in up for d in down) / len(up) / len(down))
        else:
            assert r.roc_auc is None
    for r in roc_curve(counts).filter("g = 'a'").collect():
        up = [order(s) >= order(r.score) for g, s, y in rows if g == "a" and y == 1]
        assert r.true_positive_rate == pytest.approx(sum(up) / len(up))


def test_scores_are_sorted_in_parts(spark):
    df = spark.range(1_000).select((F.col("id") % 701).cast("double").alias("s"), (F.col("id") % 2).cast("int").alias("y"))
    counts = cumulated(df, "s", "y")
    assert counts.count() == 701 and counts.agg(F.max("positives_below")).first()[0] <= 500
    assert 0 <= roc_auc(counts).first().roc_auc <= 1
