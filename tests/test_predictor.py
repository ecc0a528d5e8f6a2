import pytest
from pyspark.sql import functions as F

from editlore.operators.ordered import STATEMENT
from editlore.plans import predictor
from editlore.session import Scale

from .conftest import changes, day, values


def targets(spark, *rows, keep_all=False):
    log = predictor.with_groups(changes(spark, *rows))
    return values(predictor.with_target(log, Scale(len(rows)), keep_all), "target_to_predict")


def test_deleted_for_good_within_half_a_year(spark):
    assert targets(spark, dict(action="CREATE"), dict(action="DELETE")) == [1, 0]


def test_deletion_after_half_a_year_is_no_rejection(spark):
    assert targets(spark, dict(action="CREATE", at=-400), dict(action="DELETE", at=-400 + 183)) == [0, 0]
    assert targets(spark, dict(action="CREATE", at=-400), dict(action="DELETE", at=-400 + 182.64)) == [1, 0]


def test_recreated_value_is_not_rejected(spark):
    assert targets(spark, dict(action="CREATE"), dict(action="DELETE"), dict(action="CREATE")) == [0, 0, 0]


def test_reverted_without_time_counts_as_at_once(spark):
    assert targets(spark, dict(is_reverted=1), dict(is_reverted=1, reversion_timestamp=day(150)),
                   dict(is_reverted=1, reversion_timestamp=day(300))) == [1, 1, 0]


def test_history_stops_at_the_split_and_between_groups(spark):
    assert targets(spark, dict(action="CREATE", at=110), dict(action="DELETE", at=130)) == [0, 0]
    assert targets(spark, dict(action="CREATE"), dict(action="DELETE", user_type="anonymous", user_id=None)) == [0, 0]


def test_rank_rows_do_not_multiply_or_count(spark):
    rows = [dict(action="CREATE"), dict(change_target="rank", revision_id=1, at=0, is_reverted=1), dict(action="DELETE", revision_id=3)]
    assert targets(spark, *rows) == [1, 0, 0]
    assert sorted(targets(spark, *rows, keep_all=True)) == [0, 1, 1]


def test_features_with_and_without_the_current_edit(spark):
    log = changes(spark, dict(is_reverted=1), {}, dict(reversion=1), {}).withColumns({
        "entity_first_revision_timestamp": F.lit(day(-10)), "entity_last_revision_timestamp": F.lit(day(500)),
        **{c: F.lit(4) for c in ("entity_num_value_change_updates", "entity_num_value_change_creates", "entity_num_value_change_deletes",
                                 "entity_num_bot_edits", "entity_num_anonymous_edits", "entity_num_human_edits", "entity_num_revisions")},
        "entity_num_value_changes": F.lit(0), "user_first_edit": F.lit(day(-3)), "property_type": F.lit("static")})
    found = predictor.predictor_features(log, Scale(4))
    assert values(found, "num_non_reverted_edits_up_to_t") == [0, 1, 1, 2]
    assert values(predictor.predictor_features(log, Scale(4), before_t=True), "num_non_reverted_edits_before_t") == [0, 0, 1, 1]
    row = found.orderBy("revision_id").first()
    assert row.entity_pct_updates_to_total_edits is None and row.entity_pct_bot_edits == 1.0
    assert row.entity_age_days_at_t == 10 and row.time_to_last_edit_of_entity_at_t == -500 and row.user_age_days == 3
    assert row.entity_abandoned == 1 and row.type_of_previous_edit == "None"


def test_anonymous_models_see_no_user_features():
    numerical, categorical, binary = predictor.features_for("changes_anonymous")
    assert not [f for f in numerical + categorical + binary if "user" in f]
    assert "user_type" in predictor.features_for("changes_no_anonymous")[1]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "t int, p int")
    row = predictor.binary_metrics(df, "t", "p", []).first()
    assert (row.precision, row.recall) == (pytest.approx(2 / 3), pytest.approx(2 / 3)) and row.f1 == pytest.approx(2 / 3)
    empty = predictor.binary_metrics(df.filter("t = 0 and p = 0"), "t", "p", []).first()
    assert (empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0)


def test_validation_and_statement_history(spark):
    log = changes(spark, {}, {}, dict(change_target="rank"))
    predicted = log.filter("revision_id = 2").withColumn("prediction", F.lit(1.0))
    validated = predictor.prediction_validation(log, predicted)
    assert values(validated, "prediction") == [0, 1, 0]
    assert predictor.rejected_values(validated, None).count() == predictor.rejected_values(validated, 1).count() == 1
    assert values(predictor.statement_history(log, 1, 1, "v"), "revision_id") == [1, 2]
    assert STATEMENT == ("entity_id", "property_id", "value_id")
