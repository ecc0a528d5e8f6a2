"""Constraint violations and repair comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlore.functions.columns import flag, json_text, mentions_repair, without_first_section
from editlore.operators.intervals import annotate_intervals
from editlore.session import Scale


def _out_of_range() -> Column:
    number = json_text(F.col("new_value")).try_cast("double")
    outside = (number < F.col("_min")) | (number > F.col("_max"))
    return F.coalesce(F.col("new_datatype") != "quantity", F.lit(False)) | F.coalesce(outside, F.lit(False))


def _not_integer() -> Column:
    number = json_text(F.col("new_value")).try_cast("decimal(38,10)")
    return F.coalesce(F.col("new_datatype") != "quantity", F.lit(False)) | F.coalesce(number != F.floor(number), F.lit(False))


def with_range_violations(changes: DataFrame, range_constraint: DataFrame) -> DataFrame:
    """A change violates a range constraint if its value is no quantity, or lies outside either bound.

    A property may carry several constraints; their tightest bounds decide, so every change stays one row.
    """
    bounds = range_constraint.groupBy("property_id").agg(
        F.max("minimum_value").alias("_min"), F.min("maximum_value").alias("_max"), F.lit(True).alias("_ranged"))
    joined = changes.join(bounds, "property_id", "left")
    return joined.select(*changes.columns, flag(F.col("_ranged") & _out_of_range()).alias("violates_range_constraint"))


def with_integer_violations(changes: DataFrame, integer_constraint: DataFrame) -> DataFrame:
    """A change violates an integer constraint if its value is no quantity, or has a fraction."""
    constrained = integer_constraint.select("property_id", F.lit(True).alias("_whole")).distinct()
    joined = changes.join(constrained, "property_id", "left")
    return joined.select(*changes.columns, flag(F.col("_whole") & _not_integer()).alias("violates_integer_constraint"))


def annotated_changes(
    changes: DataFrame, ranks: DataFrame, references: DataFrame, qualifiers: DataFrame, to_classify: DataFrame,
    range_constraint: DataFrame, integer_constraint: DataFrame, scale: Scale,
) -> DataFrame:
    """The change log with rank, reference, unreliable-source and both constraint annotations."""
    checked = with_integer_violations(with_range_violations(changes, range_constraint), integer_constraint)
    return annotate_intervals(checked, ranks, references, qualifiers, to_classify, scale)


def update_comments(value_change: DataFrame, revision: DataFrame) -> DataFrame:
    """Comments of revisions that updated values, with the automatic first section removed."""
    updates = value_change.filter((F.col("action") == "UPDATE") & (F.col("change_target") == "")).select("revision_id")
    # NULL comments stay, as only empty ones are removed.
    kept = revision.select("revision_id", "comment").filter((F.col("comment") != "") | F.col("comment").isNull())
    return kept.join(updates, "revision_id", "left_semi").distinct().withColumn(
        "cleaned_comment", without_first_section(F.col("comment")))


def repair_comments(comments: DataFrame) -> DataFrame:
    return comments.filter(mentions_repair(F.col("cleaned_comment")))
