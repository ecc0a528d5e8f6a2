import pytest

from editlore.operators import intervals
from editlore.operators.ordered import STATEMENT
from editlore.session import Scale
from pyspark.sql import functions as F

from .conftest import changes, day, values

REFERENCE_DDL = ("revision_id bigint, entity_id bigint, property_id bigint, value_id string, timestamp timestamp, action string, "
                 "change_target string, ref_hash string, ref_property_id bigint, new_value string")


def references(spark, *rows):
    """(day, action, hash, property) rows of one statement."""
    return spark.createDataFrame(
        [(100 + i, 1, 1, "v", day(at), action, "", ref, prop, "{}" if action == "DELETE" else '"r"')
         for i, (at, action, ref, prop) in enumerate(rows)], REFERENCE_DDL)


def scale_of(log, limit):
    return Scale(10 * log.count() + 100, limit, lambda: log.select(*STATEMENT, F.lit(1).alias("weight")))


LIMITS = [1_000_000, 2]


@pytest.mark.parametrize("limit", LIMITS)
def test_rank_intervals_close_at_deletions(spark, limit):
    log = changes(spark, dict(at=1, change_target="rank", new_value='"normal"'), dict(at=3, change_target="rank", new_value="{}"),
                  dict(at=5, change_target="rank", new_value='["preferred"]'), dict(at=2), dict(at=3), dict(at=4), dict(at=5), dict(at=9), dict(at=0))
    ranks = intervals.rank_intervals(log, scale_of(log, limit))
    assert [(r.rank, r.revision_id_from, r.revision_id_to) for r in ranks.orderBy("valid_from").collect()] == [
        ("normal", 1, 2), ("preferred", 3, None)]
    known = spark.createDataFrame([(1,)], "property_id bigint")
    found = intervals.current_rank(log, ranks, known, scale_of(log, limit)).filter("change_target = ''")
    assert values(found, "current_rank") == ["normal", None, None, "preferred", "preferred", None]
    unknown = spark.createDataFrame([(7,)], "property_id bigint")
    assert set(values(intervals.current_rank(log, ranks, unknown, scale_of(log, limit)), "current_rank")) == {None}


@pytest.mark.parametrize("limit", LIMITS)
def test_reference_intervals_are_half_open_and_closed_by_default(spark, limit):
    log = changes(spark, dict(at=1), dict(at=2), dict(at=4), dict(at=6), dict(at=8))
    found = intervals.reference_intervals(references(spark, (2, "CREATE", "h", 143), (4, "DELETE", "h", 143), (7, "CREATE", "k", 5)),
                                          scale_of(log, limit))
    assert found.count() == 3  # removals open intervals, too
    scale = scale_of(log, limit)
    assert values(intervals.in_interval(log, found, "flag", scale), "flag") == [0, 1, 0, 0, 0]
    assert values(intervals.in_interval(log, found, "flag", scale, include_open=True), "flag") == [0, 1, 1, 1, 1]
    states = intervals.reference_intervals(references(spark, (2, "CREATE", "h", 143), (4, "DELETE", "h", 143)), scale, drop_deletes=True)
    assert states.count() == 1


def test_overlapping_and_empty_intervals(spark):
    log = changes(spark, *(dict(at=i) for i in range(8)))
    spans = [(1, 5), (2, 3), (6, 6)]
    table = spark.createDataFrame([(1, 1, "v", 50 + i, day(a), day(b)) for i, (a, b) in enumerate(spans)],
                                  "entity_id bigint, property_id bigint, value_id string, revision_id_from bigint, valid_from timestamp, valid_to timestamp")
    found = values(intervals.in_interval(log, table, "flag", Scale(50)), "flag")
    assert found == [int(any(a <= i < b for a, b in spans)) for i in range(8)]


def test_reference_attributes_are_gathered(spark):
    rows = spark.createDataFrame(
        [(1, 1, 1, "v", day(1), "CREATE", "", "h", 143, '"enwiki"'), (1, 1, 1, "v", day(1), "CREATE", "", "h", 813, '"2020"')], REFERENCE_DDL)
    state = intervals.reference_intervals(rows, Scale(2)).first()
    assert state.ref_values == {143: "enwiki", 813: "2020"} and state.valid_to is None


def test_intervals_of_a_key_never_overlap(spark):
    log = changes(spark, *(dict(at=i % 5 + i / 10, change_target="rank", new_value='"normal"', value_id=f"v{i % 3}") for i in range(30)))
    ranks = intervals.rank_intervals(log, Scale(30))
    pairs = ranks.alias("a").join(ranks.alias("b"), list(STATEMENT)).filter(
        "a.revision_id_from <> b.revision_id_from and a.valid_from < b.valid_to and b.valid_from < a.valid_from")
    assert ranks.count() == 30 and pairs.count() == 0
