"""Validity intervals ``[valid_from, valid_to)`` out of change logs, and looking changes up in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlore.functions.columns import flag, json_text
from editlore.operators.ordered import STATEMENT, After, Latest, Running, ordered_scan, overlay, placed
from editlore.session import Scale
from editlore.vocabulary import DEPRECATION_REASON, PSEUDO_PROPERTIES, UNRELIABLE_SOURCE


def build_intervals(log: DataFrame, keys: Sequence[str], value: str, scale: Scale, keep: Column | None = None) -> DataFrame:
    """Each log row holds until the next row of its key. Rows outside ``keep`` still end the interval before them."""
    held = ordered_scan(
        log, keys, {"_next": After(F.struct("revision_id", "timestamp"))}, scale)
    return held.filter(F.col(value).isNotNull() if keep is None else keep).select(
        F.col("revision_id").alias("revision_id_from"), F.col("_next.revision_id").alias("revision_id_to"), *keys, value,
        F.col("timestamp").alias("valid_from"), F.col("_next.timestamp").alias("valid_to"))


def rank_intervals(value_change: DataFrame, scale: Scale) -> DataFrame:
    ranks = value_change.filter((F.col("change_target") == "rank") & ~F.col("property_id").isin(PSEUDO_PROPERTIES)).select(
        "revision_id", *STATEMENT, "timestamp", json_text(F.col("new_value")).alias("rank"))
    return build_intervals(ranks, STATEMENT, "rank", scale)


def qualifier_intervals(qualifier_change: DataFrame, scale: Scale) -> DataFrame:
    values = placed(qualifier_change, STATEMENT, scale).select(
        "revision_id", *STATEMENT, "qual_property_id", "value_hash", "timestamp", json_text(F.col("new_value")).alias("qual_value"))
    return build_intervals(values, (*STATEMENT, "qual_property_id", "value_hash"), "qual_value", scale)


def reference_intervals(reference_change: DataFrame, scale: Scale, drop_deletes: bool = False) -> DataFrame:
    """One interval per state of a reference; its attributes are gathered into a map property -> value.

    Removals open intervals too unless ``drop_deletes`` is set.
    """
    attributes = placed(reference_change, STATEMENT, scale).select(
        "revision_id", *STATEMENT, "ref_hash", "timestamp", "action", "ref_property_id", json_text(F.col("new_value")).alias("v"))
    whole = (
        attributes.groupBy("revision_id", *STATEMENT, "ref_hash", "timestamp", "action", "ref_property_id")
        .agg(F.max("v").alias("v"))
        .groupBy("revision_id", *STATEMENT, "ref_hash", "timestamp", "action")
        .agg(F.map_from_entries(F.collect_list(F.struct("ref_property_id", "v"))).alias("ref_values"))
    )
    return build_intervals(whole, (*STATEMENT, "ref_hash"), "ref_values", scale,
                           keep=(F.col("action") != "DELETE") if drop_deletes else F.lit(True))


def rank_events(intervals: DataFrame) -> DataFrame:
    return intervals.select(
        *STATEMENT, F.col("valid_from").alias("timestamp"), F.col("revision_id_from").alias("revision_id"),
        F.struct("rank", "valid_to").alias("_rank_span"))


def presence_events(intervals: DataFrame, name: str, include_open: bool = False) -> DataFrame:
    """+1 where an interval starts and -1 where it ends: a change lies in some interval while the sum is positive."""
    kept = intervals if include_open else intervals.filter(F.col("valid_to").isNotNull())
    steps = kept.select(*STATEMENT, "revision_id_from", F.explode(F.array(
        F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("valid_to").alias("at"), F.lit(-1).alias("step")))).alias("_s"))
    return steps.filter(F.col("_s.at").isNotNull()).select(
        *STATEMENT, F.col("_s.at").alias("timestamp"), F.col("revision_id_from").alias("revision_id"),
        F.col("_s.step").alias(name))


def unreliable_source_intervals(intervals: DataFrame) -> DataFrame:
    return intervals.filter((F.col("qual_property_id") == DEPRECATION_REASON) & (F.col("qual_value") == UNRELIABLE_SOURCE))


def _current_rank(classified: Column) -> Column:
    span = F.col("_rank_now")
    holds = span["valid_to"].isNull() | (F.col("timestamp") < span["valid_to"])
    return F.when(classified & (F.col("change_target") == "") & holds, span["rank"])


def _inside(running: str) -> Column:
    return flag((F.col("change_target") == "") & (F.col(running) > 0))


def current_rank(changes: DataFrame, ranks: DataFrame, to_classify: DataFrame, scale: Scale) -> DataFrame:
    """Rank of the statement at the time of each value change, for the properties under study."""
    marked = changes.join(to_classify.select("property_id", F.lit(True).alias("_classified")), "property_id", "left")
    found = overlay(marked, rank_events(ranks), STATEMENT, {"_rank_now": Latest(F.col("_rank_span"))}, scale)
    return found.select(*changes.columns, _current_rank(F.coalesce("_classified", F.lit(False))).alias("current_rank"))


def in_interval(changes: DataFrame, intervals: DataFrame, name: str, scale: Scale, include_open: bool = False) -> DataFrame:
    """0/1 whether any interval of the statement covers the value change."""
    found = overlay(changes, presence_events(intervals, "_step", include_open), STATEMENT,
                    {"_open": Running(F.col("_step"))}, scale)
    return found.select(*changes.columns, _inside("_open").alias(name))


def annotate_intervals(
    changes: DataFrame, ranks: DataFrame, references: DataFrame, qualifiers: DataFrame, to_classify: DataFrame, scale: Scale
) -> DataFrame:
    """Rank, reference and unreliable-source annotations from one shared scan: one shuffle for all three."""
    marked = changes.join(to_classify.select("property_id", F.lit(True).alias("_classified")), "property_id", "left")
    events = (
        rank_events(ranks)
        .unionByName(presence_events(references, "_ref_step"), allowMissingColumns=True)
        .unionByName(presence_events(unreliable_source_intervals(qualifiers), "_source_step"), allowMissingColumns=True)
    )
    found = overlay(marked, events, STATEMENT, {
        "_rank_now": Latest(F.col("_rank_span")),
        "_refs": Running(F.col("_ref_step")),
        "_sources": Running(F.col("_source_step")),
    }, scale)
    return found.select(
        *changes.columns, _current_rank(F.coalesce("_classified", F.lit(False))).alias("current_rank"),
        _inside("_refs").alias("has_reference"),
        _inside("_sources").alias("reason_for_deprecated_rank_source_known_to_be_unreliable"))
