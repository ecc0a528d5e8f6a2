"""Physical plans keep their shape: no nested loops, few shuffles, limits before shuffles, narrow scans."""

import os
import re

import pytest

from editlore.queries import ANALYSES, Analyses
from editlore.session import prepare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
TRAINING = {"search_scores", "rf_metrics", "feature_importance", "static_inference"}


def plan(spark, name: str) -> str:
    return ANALYSES[name](Analyses(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ANALYSES) - TRAINING))
def test_no_nested_loops(spark, name):
    assert not re.search("CartesianProduct|NestedLoop", plan(spark, name))


def hash_exchanges(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning\(entity_id", text))


def test_history_shuffles_the_log_once(spark):
    assert hash_exchanges(plan(spark, "running_history")) == 1


def test_logs_meet_without_another_shuffle(spark):
    # one for each of the four logs: values, ranks, references, qualifiers
    text = plan(spark, "annotated_changes")
    assert hash_exchanges(text) == 4
    assert text.index("Union") < text.index("Exchange hashpartitioning(entity_id")


@pytest.mark.parametrize("name", ["user_top_entities", "representative_values", "sample_entities_static"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .*Partial", plan(spark, name))


def test_scans_read_what_they_need(spark):
    text = plan(spark, "values_per_property")
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"event_id:bigint,props:string"}
    assert "PushedFilters: [In(event_type, [click,error,signup])]" in plan(spark, "reference_intervals").replace(
        "signup,error,click", "click,error,signup")


def test_stages_of_wide_rows_are_not_one_long_method(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    prepare(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000  # what the JVM compiles


@pytest.mark.parametrize("name", ["roc_curve", "target_label", "predictor_features"])
def test_first_edits_do_not_take_the_user_model(spark, name):
    analyses = Analyses(spark, FOLDER)
    ANALYSES[name](analyses)
    assert "model" not in vars(analyses)


def test_first_edits_are_those_of_the_user_model(spark):
    analyses = Analyses(spark, FOLDER)
    columns = ["user_id", "username", "user_type", "first_edit"]
    first, model = (sorted(map(tuple, df.select(*columns).collect()), key=str) for df in (analyses.first_edits, analyses.model))
    assert first == model and len(first) > 10
