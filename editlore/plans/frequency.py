"""How often entities of each type see one property updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editlore.functions.columns import MICROS_PER_DAY, comma_list, micros_between
from editlore.operators.quantiles import quantile_columns
from editlore.session import Scale

STUDIED_PROPERTY = 1113


def real_updates(value_change: DataFrame, property_id: int | None = STUDIED_PROPERTY) -> DataFrame:
    """Lasting updates that replaced a value by a different one; ``property_id`` None takes every property."""
    kept = value_change.filter(
        (F.col("action") == "UPDATE") & (F.col("change_target") == "") & (F.col("is_reverted") == 0) & (F.col("reversion") == 0)
        & ((F.col("change_type") == "property_value_update") | (F.col("label") == "property_value_update")))
    return kept if property_id is None else kept.filter(F.col("property_id") == property_id)


def representative_values(updates: DataFrame) -> DataFrame:
    """Per entity the value with most updates (the smallest id on ties)."""
    counted = updates.groupBy("entity_id", "value_id").agg(F.count(F.lit(1)).alias("num_updates"))
    line = Window.partitionBy("entity_id").orderBy(F.desc("num_updates"), "value_id")
    return counted.withColumn("_rank", F.row_number().over(line)).filter("_rank = 1").drop("_rank")


def update_gaps(updates: DataFrame) -> DataFrame:
    """Average days between updates of each entity's representative value, where there are two or more.

    The mean of consecutive gaps is the span over their number, so the history needs no ordering, and one
    aggregate per (entity, value) serves both the choice of the value and its gaps.
    """
    spans = updates.groupBy("entity_id", "value_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    line = Window.partitionBy("entity_id").orderBy(F.desc("_n"), "value_id")
    chosen = spans.withColumn("_rank", F.row_number().over(line)).filter((F.col("_rank") == 1) & (F.col("_n") > 1))
    gaps = F.col("_n") - 1
    return chosen.select(
        "entity_id",
        (micros_between(F.col("_last"), F.col("_first")) / gaps / float(MICROS_PER_DAY)).alias("avg_days_between_updates"),
        gaps.alias("num_updates"))


def exploded_types(entity_stats: DataFrame) -> DataFrame:
    """One row per entity and type; entities without types have none."""
    return entity_stats.select("entity_id", F.explode(comma_list(F.col("entity_types_31"))).alias("entity_type"))


def update_frequency_by_type(updates: DataFrame, entity_stats: DataFrame, scale: Scale) -> DataFrame:
    """Entities, updates, mean and median days between updates per entity type with more than one entity."""
    gaps = update_gaps(updates)
    studied = entity_stats.join(gaps, "entity_id", "left_semi")
    typed = exploded_types(studied).join(gaps, "entity_id")
    found = quantile_columns(
        typed, ["entity_type"], {"_median": F.col("avg_days_between_updates")}, [0.5], scale,
        extra=[F.count_distinct("entity_id").alias("num_entities"), F.sum("num_updates").alias("total_updates_all_entities"),
               F.avg("avg_days_between_updates").alias("avg_days_between_updates")])
    return (
        found.filter(F.col("num_entities") > 1)
        .select("entity_type", "num_entities", "total_updates_all_entities", "avg_days_between_updates",
                F.col("_median")[0].alias("median_days_between_updates"))
        .orderBy("avg_days_between_updates")
    )
