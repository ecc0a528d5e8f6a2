"""Every registered query against its SQL, over the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from verification.compare import database, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal_to_sql(spark, db, name):
    assert difference(spark, db, FOLDER, name)[0].startswith("equal")


HOT = ["change_log", "entity_prop_overall_activity", "property_features", "annotated_changes", "running_history", "reference_counts_asof",
       "target_label", "prev_edit_on_entity", "update_frequency_by_type"]


@pytest.mark.parametrize("name", HOT)
def test_equal_to_sql_when_groups_are_hot(spark, db, name):
    spark.conf.set("editlore.group.rows", "6")
    try:
        assert difference(spark, db, FOLDER, name)[0].startswith("equal")
    finally:
        spark.conf.unset("editlore.group.rows")


def test_smoke_query(spark):
    assert entry.entry(spark).columns[:2] == ["entity_id", "property_id"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
