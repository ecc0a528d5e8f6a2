import random

import pytest
from pyspark.sql import functions as F

from editlore.operators.ordered import (
    STATEMENT, After, Before, First, Latest, Running, Total, by_heat, ordered_scan, overlay, row_number, scan_in_slices,
)
from editlore.plans import history
from editlore.session import TASK_BYTES, Scale, spread_shuffles

from .conftest import changes, day


def skewed(spark, n=600, seed=1):
    """A log in which one statement holds over half of the rows, many of them on one day and some at one instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.6
        at = rng.choice([3, 3, 3 + rng.random(), 40 * rng.random()])
        rows.append(dict(
            at=at, value_id="hot" if hot else f"v{rng.randrange(40)}", user_id=rng.choice([None, 1, 2, 3, 4]),
            is_reverted=int(rng.random() < 0.3), new_value=rng.choice(['"a"', '"b"', None]), action=rng.choice(["CREATE", "UPDATE", "DELETE"]),
            new_datatype=rng.choice(["quantity", "unknown-values"]), user_type=rng.choice(["human", "bot", "anonymous"])))
    return changes(spark, *rows)


def small_limit(log, limit=25):
    keys = log.select(*STATEMENT, F.lit(1).alias("weight"))
    return Scale(log.count(), limit, lambda: keys)


def measures():
    return {
        "before": Before(F.col("new_value")), "after": After(F.col("action")), "running": Running(F.col("is_reverted")),
        "latest": Latest(F.col("new_value")), "first": First(F.col("user_id")), "total": Total(F.lit(1)), "n": row_number(),
    }


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_slices_equal_windows(spark, seed):
    log = skewed(spark, seed=seed)
    assert rows(ordered_scan(log, STATEMENT, measures(), small_limit(log))) == rows(
        ordered_scan(log, STATEMENT, measures(), Scale(log.count())))


@pytest.mark.parametrize("every", [1, 3, 10_000])
def test_any_slice_length(spark, every):
    log = skewed(spark, 200)
    expected = ordered_scan(log, STATEMENT, measures(), Scale(log.count()))
    assert rows(scan_in_slices(log, STATEMENT, measures(), ("timestamp", "revision_id"), every)) == rows(expected)


def test_slices_are_bounded(spark):
    """The point of slices: no window group keeps the size of the hot statement."""
    from editlore.operators.ordered import _with_slices

    log = skewed(spark).filter("value_id = 'hot'")
    sliced = _with_slices(log, list(STATEMENT), ["timestamp", "revision_id"], every=10)
    largest = sliced.groupBy(*STATEMENT, "_slice").count().agg(F.max("count")).first()[0]
    assert largest < log.count() / 3


def test_only_hot_groups_are_sliced(spark):
    log = skewed(spark)
    parts = []

    def plan(part, scan):
        parts.append(part.select("value_id").distinct().count())
        return part

    assert by_heat(log, STATEMENT, small_limit(log, 100), plan).count() == log.count()
    assert sorted(parts) == [1, 40]


def test_no_hot_group_needs_no_split(spark):
    log = skewed(spark, 100)
    scale = Scale(10**9, 1_000_000, lambda: log.select(*STATEMENT, F.lit(1).alias("weight")))
    assert scale.hot(STATEMENT) is None and not scale.fits


def test_ties_follow_the_revision(spark):
    log = changes(spark, dict(at=1, action="CREATE"), dict(at=1), dict(at=1, action="DELETE"))
    scanned = ordered_scan(log, STATEMENT, {"p": Before(F.col("action")), "n": After(F.col("action"))}, Scale(3))
    assert [(r.p, r.n) for r in scanned.orderBy("revision_id").collect()] == [
        (None, "UPDATE"), ("CREATE", "DELETE"), ("UPDATE", None)]


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_overlay_sees_events_of_the_same_instant(spark, limit):
    log = changes(spark, *(dict(at=i / 2) for i in range(12)))
    events = spark.createDataFrame([(1, 1, "v", day(1), 99, "x"), (1, 1, "v", day(3.2), 98, "y"), (1, 1, "w", day(0), 97, "z")],
                                   "entity_id bigint, property_id bigint, value_id string, timestamp timestamp, revision_id bigint, mark string")
    found = overlay(log, events, STATEMENT, {"seen": Latest(F.col("mark"))}, small_limit(log, limit))
    assert [r.seen for r in found.orderBy("revision_id").collect()] == [None] * 2 + ["x"] * 5 + ["y"] * 5


@pytest.mark.parametrize("limit", [10, 60])
def test_history_is_the_same_for_hot_statements(spark, limit):
    log = history.with_change_types(skewed(spark, 400))
    assert rows(history.running_history(log, small_limit(log, limit))) == rows(history.running_history(log, Scale(log.count())))


def test_history_does_not_depend_on_partitions(spark):
    log = history.with_change_types(skewed(spark, 200))
    expected = rows(history.running_history(log, Scale(200)))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(history.running_history(log.repartition(13), Scale(200))) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tasks_are_given_bounded_shuffles(spark):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    fresh, choosy = spark.newSession(), spark.newSession()
    choosy.conf.set(size, "32m")
    for session in (fresh, choosy):
        spread_shuffles(session, 1_000)
    assert fresh.conf.get(size) == str(TASK_BYTES) and choosy.conf.get(size) == "32m"
