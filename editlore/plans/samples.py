"""Change and reference samples for studying a set of properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlore.operators.ordered import Before, Latest, ordered_scan, overlay
from editlore.plans.frequency import exploded_types
from editlore.session import Scale


def previous_edit_on_entity(revision: DataFrame, scale: Scale) -> DataFrame:
    return ordered_scan(revision, ["entity_id"], {"prev_edit_on_entity": Before(F.col("timestamp"))}, scale)


def sampled_changes(pairs: DataFrame, value_change: DataFrame, entity_stats: DataFrame, revision: DataFrame) -> DataFrame:
    """All value changes of the sampled (entity, property) pairs with revision and entity context."""
    changes = value_change.filter(F.col("change_target") == "").drop("timestamp")
    return (
        changes.join(pairs, ["entity_id", "property_id"])
        .join(entity_stats.select("entity_id", F.col("first_revision_timestamp").alias("entity_first_revision_timestamp")), "entity_id")
        .join(revision.drop("entity_id"), "revision_id")
    )


def sampled_changes_for_features(
    pairs: DataFrame, value_change: DataFrame, entity_stats: DataFrame, revision: DataFrame, scale: Scale
) -> DataFrame:
    """``sampled_changes`` without deletions, with the entity's previous edit (of any kind) beside each change."""
    return sampled_changes(
        pairs, value_change.filter(F.col("action") != "DELETE"), entity_stats, previous_edit_on_entity(revision, scale))


#: What a reference change shows of the sampled change it belongs to.
CONTEXT = ["revision_id", "entity_label", "property_label", "timestamp", "year", "label", "action", "old_value", "new_value", "old_datatype", "new_datatype",
           "user_type", "username", "user_id", "comment"]


def sampled_references(changes: DataFrame, reference_change: DataFrame, scale: Scale) -> DataFrame:
    """Every reference change beside the latest sampled change of its statement at or before it.

    Both logs are scanned on one time axis, so the result has at most one row per reference change, however many changes a statement has.
    """
    statement = ["entity_id", "property_id", "value_id"]
    events = changes.select(*statement, "timestamp", "revision_id", F.struct(*(F.col(c).alias(f"change_{c}") for c in CONTEXT)).alias("_change"))
    found = overlay(reference_change, events, statement, {"_latest": Latest(F.col("_change"))}, scale)
    return found.filter(F.col("_latest").isNotNull()).select(*reference_change.columns, "_latest.*")


def shown_sample(changes: DataFrame, prop_ref_rate: DataFrame) -> DataFrame:
    """Sampled changes with their month and whether their property needs a source."""
    needs = prop_ref_rate.select("property_id", "citation_needed")
    return changes.join(needs, "property_id", "left").withColumn("year_month", F.date_format("timestamp", "yyyy-MM"))


def with_entity_type(changes: DataFrame, entity_stats: DataFrame) -> DataFrame:
    """One type per entity beside each change (the first in order), '' where the entity has none."""
    first = exploded_types(entity_stats).groupBy("entity_id").agg(F.min("entity_type").alias("entity_type"))
    return changes.join(first, "entity_id", "left").fillna("", ["entity_type"])
