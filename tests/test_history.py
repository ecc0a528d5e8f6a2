import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from editlore.functions import columns
from editlore.operators import gaps
from editlore.plans import frequency, history, quality, users
from editlore.session import Scale

from .conftest import changes, day, values
from .test_intervals import references


def run(spark, *rows):
    log = history.with_change_types(changes(spark, *rows))
    return history.running_history(log, Scale(len(rows)))


def test_single_edit_has_no_gaps(spark):
    row = run(spark, {}).first()
    assert row.time_since_last_edit_days is None and row.time_to_next_edit_days == 4745.0
    assert row.total_changes_up_to_t == 1 and row.num_value_reoccurrences == 0 and row.type_of_next_edit == "None"


def test_zero_gap_is_not_a_missing_edit(spark):
    assert values(run(spark, dict(at=1), dict(at=1)), "time_to_next_edit_days") == [0.0, 4745.0]


def test_distinct_users_ignore_anonymous_edits(spark):
    found = run(spark, dict(user_id=1), dict(user_id=None, user_type="anonymous"), dict(user_id=1), dict(user_id=2))
    assert values(found, "num_unique_registered_users") == [1, 1, 1, 2]
    assert values(found, "num_edits_human") == [0, None, 1, 2] and values(found, "num_edits_anonymous") == [None, 0, None, None]


def test_reoccurring_values_and_reverts(spark):
    found = run(spark, dict(new_value='"a"', is_reverted=1), dict(new_value=None), dict(new_value='"a"', reversion=1), dict(new_value=None))
    assert values(found, "num_value_reoccurrences") == [0, 0, 1, 0]
    assert values(found, "num_reverted_edits_up_to_t") == [1, 1, 1, 1]
    assert values(found, "num_non_reverted_edits_up_to_t") == [0, 1, 1, 2]


def test_labels_are_completed_once(spark):
    log = changes(spark, dict(label="value_update"), dict(label="property_value_update"), dict(change_type="refinement, textual_change"),
                  dict(change_type=None, label=None))
    found = history.with_change_types(log)
    assert values(found, "labels_list") == [["property_value_update"], ["property_value_update"], ["refinement", "textual_change"], []]
    assert values(found, "textual_change") == [0, 0, 1, 0]


def test_references_count_once_per_action(spark):
    refs = references(spark, (1, "CREATE", "h", 813), (1, "CREATE", "h", 143), (2, "DELETE", "h", 143), (3, "CREATE", "h", 143), (3, "UPDATE", "k", 5))
    refs = refs.withColumn("revision_id", F.when(F.col("ref_property_id") == 813, F.col("revision_id") + 1).otherwise(F.col("revision_id")))
    log = changes(spark, dict(at=0), dict(at=1), dict(at=2), dict(at=3), dict(at=4))
    found = history.with_reference_counts(log, refs, Scale(100))
    assert values(found, "num_wikipedia_refs_up_to_t") == [0, 1, 0, 0, 0]
    assert values(found, "num_non_wikipedia_refs_up_to_t") == [0, 0, 0, 0, 0]


def test_replaced_values_stay_within_value_or_rank(spark):
    log = changes(spark, dict(new_value='"a"'), dict(new_value='"normal"', change_target="rank"), dict(new_value='"b"')).drop(
        "old_value", "old_datatype", "old_value_label")
    assert values(history.with_replaced_values(log, Scale(3)), "old_value") == ["{}", "{}", '"a"']


def test_users_without_model_keep_their_rows(spark):
    log = changes(spark, dict(user_id=None, user_type="anonymous"), dict(user_id=1), dict(user_id=9))
    dim = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (-5, "negative"), (0, "zero")], "user_id bigint, name string")
    assert values(history.spread_left_join(log, dim, "user_id", "revision_id"), "name") == [None, "x", None]
    odd = changes(spark, dict(user_id=-5), dict(user_id=0), dict(user_id=None))
    assert values(history.spread_left_join(odd, dim, "user_id", "revision_id"), "name") == ["negative", "zero", None]


def test_modal_datatype_takes_the_smallest_on_ties(spark):
    log = changes(spark, dict(new_datatype="string"), dict(new_datatype="quantity"), dict(property_id=2, new_datatype="time"),
                  *[dict(property_id=2, new_datatype=None)] * 3, dict(property_id=3, new_datatype=None))
    assert {r.property_id: r.expected_datatype for r in history.expected_datatypes(log).collect()} == {1: "quantity", 2: "time", 3: None}


@pytest.mark.parametrize("value, text", [('"+12.5"', "+12.5"), ("7", "7"), ('["a", "b"]', "a"), ("{}", None), ('{"a": 1}', None), (None, None)])
def test_json_text(spark, value, text):
    assert spark.createDataFrame([(value,)], "v string").select(columns.json_text(F.col("v"))).first()[0] == text


def test_comment_rules(spark):
    texts = ["/* a */ keep /* b */ fixed", "prefix", "A FIX", "Corrected", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "revision_id int, comment string")
    found = df.select("revision_id", columns.without_first_section(F.col("comment")).alias("cleaned"),
                      columns.comment_has_keyword(F.col("comment")).alias("flag"),
                      columns.flag(columns.mentions_repair(F.col("comment"))).alias("spaced"))
    assert values(found, "cleaned")[0] == " keep /* b */ fixed"
    assert values(found, "flag") == [1, 0, 1, 1, 0, 0] and values(found, "spaced") == [1, 0, 1, 0, 0, 0]


def test_constraints(spark):
    log = changes(spark, dict(new_value='"+12.5"'), dict(new_value='"7"'), dict(new_value='"abc"'), dict(new_value="{}"),
                  dict(new_datatype="string"), dict(new_datatype=None, new_value='"99"'), dict(property_id=2, new_value='"500"'))
    bounds = spark.createDataFrame([(1, None, 10.0), (3, 1.0, 2.0)], "property_id bigint, minimum_value double, maximum_value double")
    assert values(quality.with_range_violations(log, bounds), "violates_range_constraint") == [1, 0, 0, 0, 1, 1, 0]
    whole = spark.createDataFrame([(1,)], "property_id bigint")
    assert values(quality.with_integer_violations(log, whole), "violates_integer_constraint") == [1, 0, 0, 0, 1, 0, 0]


def test_entity_types_split(spark):
    stats = spark.createDataFrame([(1, ""), (2, "a, b"), (3, None)], "entity_id bigint, entity_types_31 string")
    assert sorted((r.entity_id, r.entity_type) for r in frequency.exploded_types(stats).collect()) == [(2, "a"), (2, "b")]


def test_update_gaps_are_the_mean_of_consecutive_gaps(spark):
    log = changes(spark, *(dict(at=a, change_type="property_value_update", property_id=1113) for a in (0, 1, 5, 6)),
                  dict(at=2, entity_id=2, change_type="property_value_update", property_id=1113))
    found = frequency.update_gaps(frequency.real_updates(log)).collect()
    assert [(r.entity_id, r.avg_days_between_updates, r.num_updates) for r in found] == [(1, 2.0, 3)]


def test_user_model_of_a_single_edit(spark):
    log = changes(spark, {}, dict(user_id=2, username="user2", at=0.5), dict(user_id=2, username="user2", at=3))
    revision = log.select("revision_id", "entity_id", "timestamp", "user_type", "user_id", "username", "comment")
    found = {r.user_id: r for r in users.user_model(log, revision).collect()}
    assert found[1].avg_days_between_revisions is None and found[1].avg_entities_per_day is None
    assert found[2].avg_days_between_revisions == 2.5 and found[2].avg_entities_per_day == 0.5
    assert found[2].num_edits_afternoon == 1 and found[2].num_edits_night == 1
    assert found[2].first_edit is not None and day(0).tzinfo is not None


def test_gaps_run_along_the_username(spark):
    kinds = [("human", 0), ("bot", 1), ("human", 4), ("human", 10), ("bot", 11)]
    log = changes(spark, *(dict(user_type=t, at=a) for t, a in kinds), dict(user_type="anonymous", at=2, user_id=None))
    revision = log.select("revision_id", "entity_id", "timestamp", "user_type", "user_id", "username", "comment")
    found = {r.user_type: r for r in users.user_model(log, revision).collect()}
    assert found["human"].avg_days_between_revisions == 4.5 and found["bot"].avg_days_between_revisions == 1.0
    assert found["human"].num_revisions == 3 and found["human"].num_entities == found["human"].num_properties == 1 and "anonymous" not in found


def test_gaps_equal_those_of_a_window(spark):
    """Random lines with changing owners, repeated instants, several changes of a revision, and null names."""
    rng = random.Random(4)
    rows = []
    for revision in range(600):
        name = rng.choice(["a", "b", None, "quiet"])
        kind = "human" if name == "quiet" else rng.choice(["bot", "human", "human"])
        moment = rng.choice([0, rng.randint(0, 3), rng.randint(0, 40) * 600, rng.randint(0, 40) * 86_400, 86_399])
        rows += [(name, kind, 1 if kind == "bot" else 2, day(moment / 86_400), revision)] * rng.choice([1, 1, 3])
    events = spark.createDataFrame(rows, "username string, user_type string, user_id long, timestamp timestamp, revision_id long")
    owner = ["user_id", "username", "user_type"]
    events = events.withColumn("_day", gaps.day_of(F.col("timestamp")))
    days = gaps.days_by_owner(events, "username", owner, F.min(F.struct("timestamp", "revision_id")), F.max("timestamp"), F.count(F.lit(1)))
    found = {tuple(r) for r in gaps.gap_sums(days, events, "username", owner).collect()}
    before = F.lag("timestamp").over(Window.partitionBy("username").orderBy("timestamp", "revision_id"))
    line = events.withColumn("gap", F.unix_micros("timestamp") - F.unix_micros(before))
    assert found == {tuple(r) for r in line.groupBy(*owner).agg(F.coalesce(F.sum("gap"), F.lit(0)), F.count("gap")).collect()}


def test_no_task_sorts_all_changes_of_a_user(spark, monkeypatch):
    for module in (gaps, users):
        monkeypatch.setattr(module, "materialise", lambda df: df)
    log = changes(spark, {}, dict(at=0.1, user_type="bot"), dict(at=3, user_type="bot"))  # a day with two owners: all steps are planned
    revision = log.select("revision_id", "entity_id", "timestamp", "user_type", "user_id", "username", "comment")
    lines = users.user_model(log, revision)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    along = [k for k, line in enumerate(lines) if "Window [" in line and "[revision_id" not in line]
    assert len(along) >= 4
    for k in along:  # ordered along a username are sums of days, hours or instants, never changes
        below = [m[0] for line in lines[k + 1:] if (m := re.search(r"\w+", line))]
        assert "Aggregate" in below[:below.index("Join")]
