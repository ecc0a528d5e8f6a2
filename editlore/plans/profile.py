"""How often properties are updated: profiles per statement, per (entity, property) and per property."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlore.functions.columns import count_where, micros_between, share, whole_days
from editlore.operators.ordered import STATEMENT, Before, First, Measure, Running, Scan, by_heat, row_number
from editlore.operators.quantiles import quantile_columns
from editlore.session import Scale
from editlore.vocabulary import CLOSE_IN_TIME_SECONDS, PSEUDO_PROPERTIES, TEMPORAL_QUALIFIERS

PAIR = ("entity_id", "property_id")
SECOND = 1e6
CLOSE = CLOSE_IN_TIME_SECONDS * 1_000_000


def small_table(value_change: DataFrame, revision: DataFrame) -> DataFrame:
    """Lasting insertions and updates of values, with the kind of editor and whether the change counts as activity."""
    lasting = value_change.filter(
        (F.col("change_target") == "") & (F.col("is_reverted") == 0) & (F.col("reversion") == 0)
        & ~F.col("property_id").isin(PSEUDO_PROPERTIES) & (F.col("action") != "DELETE"))
    activity = (F.col("action") == "CREATE") | (
        (F.col("action") == "UPDATE")
        & ((F.col("label") == "value_update") | (F.col("change_type") == "property_value_update")))
    return lasting.join(revision.select("revision_id", "user_type"), "revision_id").select(
        "revision_id", *STATEMENT, "timestamp", "action", "label", "change_type", "user_type",
        activity.alias("is_overall_activity"))


def distinct_value_profile(value_change: DataFrame, revision: DataFrame) -> DataFrame:
    """Values, insertions and updates per (entity, property), with the time span they cover."""
    kept = value_change.filter((F.col("action") != "DELETE") & (F.col("change_target") == ""))
    return (
        kept.join(revision.select("revision_id", "user_type"), "revision_id")
        .groupBy(*PAIR)
        .agg(
            F.count_distinct("value_id").alias("num_distinct_values"),
            count_where(F.col("action") == "CREATE").alias("num_creates"),
            count_where(F.col("action") == "UPDATE").alias("num_updates"),
            F.count(F.lit(1)).alias("total_creates_updates"),
            F.min("timestamp").alias("first_prop_value_insert"),
            F.max("timestamp").alias("last_prop_value_insert_update"),
            count_where(F.col("user_type") == "bot").alias("num_bot_changes"),
            count_where(F.col("user_type") == "human").alias("num_human_changes"),
        )
    )


def _gap_columns(gap: Column, span: str) -> list[Column]:
    """Average, shortest and longest gap in seconds, all and without gaps under an hour."""
    apart = F.when(gap >= CLOSE, gap)
    return [
        (F.avg(gap) / SECOND).alias(f"avg_time_between_{span}_sec"),
        (F.min(gap) / SECOND).alias(f"min_time_between_{span}_sec"),
        (F.max(gap) / SECOND).alias(f"max_time_between_{span}_sec"),
        count_where(gap < CLOSE).alias("num_close_in_time_changes"),
        (F.avg(apart) / SECOND).alias("avg_time_between_changes_not_close_in_time_sec"),
        (F.min(apart) / SECOND).alias("min_time_between_changes_not_close_in_time_sec"),
        (F.max(apart) / SECOND).alias("max_time_between_changes_not_close_in_time_sec"),
    ]


def _with_gaps(
    small: DataFrame, keys: tuple[str, ...], scale: Scale, per_value: dict[str, Measure] | None = None
) -> DataFrame:
    """Activity rows with the gap to the row before and the age since the first one, in microseconds.

    ``per_value`` adds scans along each value, in the same placement of the rows.
    """
    rows = small.filter("is_overall_activity").select("revision_id", *STATEMENT, "timestamp", "action")
    along = {"_previous": Before(F.col("timestamp")), "_first": First(F.col("timestamp"))}

    def plan(part: DataFrame, scan: Scan) -> DataFrame:
        scanned = scan(part, keys, along)
        return scan(scanned, STATEMENT, per_value) if per_value else scanned

    gap = micros_between(F.col("timestamp"), F.col("_previous"))
    age = F.when(F.col("_previous").isNotNull(), micros_between(F.col("timestamp"), F.col("_first")))
    return by_heat(rows, keys, scale, plan).select(
        *STATEMENT, "action", *(per_value or {}), gap.alias("gap"), age.alias("age"))


def overall_activity(small: DataFrame, scale: Scale) -> DataFrame:
    """Update rhythm of a property within an entity, whichever of its values changed.

    Distinct values are counted at the first row, creation and update of each value, so one plain aggregate does.
    """
    created, updated = F.col("action") == "CREATE", F.col("action") == "UPDATE"
    gaps = _with_gaps(small, PAIR, scale, {
        "_nth": row_number(), "_nth_create": Running(created.cast("int")), "_nth_update": Running(updated.cast("int"))})
    found = quantile_columns(
        gaps, PAIR, {"_median": F.col("gap")}, [0.5], scale,
        extra=[
            F.count(F.lit(1)).alias("num_changes"),
            count_where(F.col("_nth") == 1).alias("num_distinct_values"),
            *_gap_columns(F.col("gap"), "changes"),
            count_where(created & (F.col("_nth_create") == 1)).alias("num_value_creates"),
            count_where(updated).alias("num_real_updates"),
            count_where(updated & (F.col("_nth_update") == 1)).alias("num_value_id_real_updated"),
            (F.avg("age") / SECOND).alias("avg_age_of_value_to_first_insert_sec"),
        ])
    return found.withColumn("median_time_between_updates_sec", F.col("_median")[0] / SECOND).drop("_median")


def value_activity(small: DataFrame, scale: Scale) -> DataFrame:
    """What happens to one value after it was inserted."""
    gaps = _with_gaps(small, STATEMENT, scale)
    found = quantile_columns(
        gaps, STATEMENT, {"_median": F.col("gap")}, [0.5], scale,
        extra=[
            F.count(F.lit(1)).alias("num_changes"),
            F.count("gap").alias("num_changes_after_birth"),
            *_gap_columns(F.col("gap"), "updates"),
            (F.avg("age") / SECOND).alias("avg_age_of_value_at_update_sec"),
        ])
    return found.withColumn("median_time_between_updates_sec", F.col("_median")[0] / SECOND).drop("_median")


def average_value_activity(values: DataFrame) -> DataFrame:
    """``value_activity`` averaged over the values of an (entity, property). Averages of averages stay two steps."""
    return values.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("num_distinct_values"),
        F.sum("num_changes").alias("num_changes"),
        F.sum("num_changes_after_birth").alias("num_changes_after_birth"),
        F.avg("num_changes").alias("avg_num_changes_per_value"),
        share(count_where(F.col("num_changes_after_birth") > 0), F.count(F.lit(1))).alias("pct_values_ever_changed"),
        F.avg("avg_time_between_updates_sec").alias("avg_time_between_updates_sec"),
        F.min("min_time_between_updates_sec").alias("min_time_between_updates_sec"),
        F.max("max_time_between_updates_sec").alias("max_time_between_updates_sec"),
        F.avg("median_time_between_updates_sec").alias("avg_median_time_between_updates_sec"),
        F.sum("num_close_in_time_changes").alias("num_close_in_time_changes"),
        F.avg("avg_time_between_changes_not_close_in_time_sec").alias("avg_time_between_changes_not_close_in_time_sec"),
        F.min("min_time_between_changes_not_close_in_time_sec").alias("min_time_between_changes_not_close_in_time_sec"),
        F.max("max_time_between_changes_not_close_in_time_sec").alias("max_time_between_changes_not_close_in_time_sec"),
        F.avg("avg_age_of_value_at_update_sec").alias("avg_age_of_value_at_update_sec"),
        share(F.sum("num_close_in_time_changes"), F.sum("num_changes_after_birth")).alias("pct_changes_close_in_time"),
    )


def entity_property_stats(
    catalogue: DataFrame, distinct_values: DataFrame, average_values: DataFrame, overall: DataFrame
) -> DataFrame:
    """All (entity, property) pairs with both activity profiles; pairs without activity keep NULLs."""
    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*PAIR, *(F.col(c).alias(prefix + c) for c in df.columns if c not in PAIR))

    return (
        distinct_values.select(*PAIR)
        .join(prefixed(average_values, "epaav_"), list(PAIR), "left")
        .join(prefixed(overall, "epoa_"), list(PAIR), "left")
        .join(catalogue.select("property_id", "property_label", "property_type"), "property_id")
    )


# What is measured per property. "count" is divided by the age of the entity in days, "time" also reports how
# often it is missing, "plain" is taken as it is.
MEASURES = {
    "epaav_num_distinct_values": "plain",
    "epaav_num_changes": "count",
    "epaav_num_changes_after_birth": "count",
    "epaav_avg_num_changes_per_value": "plain",
    "epaav_pct_values_ever_changed": "plain",
    "epaav_avg_time_between_updates_sec": "time",
    "epaav_avg_median_time_between_updates_sec": "time",
    "epaav_min_time_between_updates_sec": "time",
    "epaav_max_time_between_updates_sec": "time",
    "epaav_avg_age_of_value_at_update_sec": "time",
    "epaav_num_close_in_time_changes": "count",
    "epaav_pct_all_changes_close_in_time": "plain",
    "epaav_avg_time_between_changes_not_close_in_time_sec": "time",
    "epaav_min_time_between_changes_not_close_in_time_sec": "time",
    "epaav_max_time_between_changes_not_close_in_time_sec": "plain",  # has no missing rate
    "epoa_num_changes": "count",
    "epoa_num_distinct_values": "plain",
    "epoa_avg_time_between_changes_sec": "time",
    "epoa_min_time_between_changes_sec": "time",
    "epoa_max_time_between_changes_sec": "time",
    "epoa_median_time_between_updates_sec": "time",
    "epoa_num_close_in_time_changes": "count",
    "epoa_avg_time_between_changes_not_close_in_time_sec": "time",
    "epoa_min_time_between_changes_not_close_in_time_sec": "time",
    "epoa_max_time_between_changes_not_close_in_time_sec": "time",
    "epoa_num_value_creates": "count",
    "epoa_num_real_updates": "count",
    "epoa_num_value_id_real_updated": "plain",
    "epoa_avg_age_of_value_to_first_insert_sec": "time",
}
SHORTER = {"epaav_": "epv_", "epoa_": "ep_", "between_changes": "bc", "not_close": "nc"}
STORED_AS = {"epaav_pct_all_changes_close_in_time": "epaav_pct_changes_close_in_time"}


def feature_name(measure: str, kind: str = "plain") -> str:
    for long, short in SHORTER.items():
        measure = measure.replace(long, short)
    return measure + ("_per_day" if kind == "count" else "")


def property_features(stats: DataFrame, entity_stats: DataFrame, scale: Scale) -> DataFrame:
    """Average, median and interquartile range of every measure per property, over all its entities."""
    ages = entity_stats.select(
        "entity_id",
        F.greatest(whole_days(F.col("last_revision_timestamp"), F.col("first_revision_timestamp")).cast("double"), F.lit(1.0))
        .alias("_age"))
    values = {
        feature_name(m, kind): f"cast({STORED_AS.get(m, m)} as double)" + (" / _age" if kind == "count" else "")
        for m, kind in MEASURES.items()
    }
    values["pct_gaps_are_close_in_time"] = "try_divide(cast(epoa_num_close_in_time_changes as double), epoa_num_changes - 1)"
    keys = ["property_id", "property_label", "property_type"]
    wide = stats.join(ages, "entity_id").selectExpr(*keys, *(f"{v} as {name}" for name, v in values.items()))

    missing = [feature_name(m) for m, kind in MEASURES.items() if kind == "time"]
    found = quantile_columns(
        wide, keys, {f"_q_{name}": F.col(name) for name in values}, [0.25, 0.5, 0.75], scale,
        extra=[
            F.count(F.lit(1)).alias("num_entity_property_pairs"),
            *(F.expr(f"avg({name}) as avg_{name}") for name in values),
            *(F.expr(f"count_if({name} is null) / count(1) as null_rate_{name}") for name in missing),
        ])
    return found.selectExpr(
        *[c for c in found.columns if not c.startswith("_q_")],
        *(f"_q_{name}[1] as median_{name}" for name in values),
        *(f"_q_{name}[2] - _q_{name}[0] as iqr_{name}" for name in values))


def updates_as_creates(small: DataFrame, qualifier_change: DataFrame) -> DataFrame:
    """Share of a property's values that ever got a point in time or start time: those properties are updated by
    adding values. The two thresholds become flags.

    Both logs are stacked and grouped by statement once; no join.
    """
    statement = list(STATEMENT)
    temporal = qualifier_change.filter(F.col("qual_property_id").isin(TEMPORAL_QUALIFIERS) & (F.col("action") == "CREATE"))
    stacked = small.select(*statement, F.lit(1).alias("_changed"), F.lit(0).alias("_temporal")).unionByName(
        temporal.select(*statement, F.lit(0).alias("_changed"), F.lit(1).alias("_temporal")))
    flags = stacked.groupBy(*statement).agg(F.max("_changed").alias("_changed"), F.max("_temporal").alias("_temporal"))
    counted = flags.filter("_changed = 1").groupBy("property_id").agg(
        F.count(F.lit(1)).alias("num_values"), F.sum("_temporal").alias("num_values_temporal"))
    pct = share(F.col("num_values_temporal"), F.col("num_values"))
    return counted.withColumn("pct_values_temporal_qualifier", pct).select(
        "*", *(F.when(F.col("pct_values_temporal_qualifier") >= at / 100, 1).otherwise(0).alias(f"updates_as_creates_{at}")
               for at in (50, 60)))


COMMON_FEATURES = ["avg_ep_num_distinct_values", "avg_epv_num_changes_after_birth_per_day", "avg_epv_avg_num_changes_per_value",
                   "avg_epv_pct_values_ever_changed", "avg_epv_avg_age_of_value_at_update_sec"]

# Feature -> (value-level column, property-level column).
ROUTES = {
    "avg_time_between_updates": ("avg_epv_avg_time_between_updates_sec", "avg_ep_avg_time_bc_sec"),
    "avg_min_time_between_updates": ("avg_epv_min_time_between_updates_sec", "avg_ep_min_time_bc_sec"),
    "avg_max_time_between_updates": ("avg_epv_max_time_between_updates_sec", "avg_ep_max_time_bc_sec"),
    "avg_median_time_between_updates": ("avg_epv_avg_median_time_between_updates_sec", "avg_ep_median_time_between_updates_sec"),
    "avg_num_close_in_time_changes": ("avg_epv_num_close_in_time_changes_per_day", "avg_ep_num_close_in_time_changes_per_day"),
    "avg_avg_time_bc_nc_in_time_sec": ("avg_epv_avg_time_bc_nc_in_time_sec", "avg_ep_avg_time_bc_nc_in_time_sec"),
    "avg_min_time_bc_nc_in_time_sec": ("avg_epv_min_time_bc_nc_in_time_sec", "avg_ep_min_time_bc_nc_in_time_sec"),
    "avg_max_time_bc_nc_in_time_sec": ("avg_epv_max_time_bc_nc_in_time_sec", "avg_ep_max_time_bc_nc_in_time_sec"),
    "null_rate_avg_time_between_updates_sec": ("null_rate_epv_avg_time_between_updates_sec", "null_rate_ep_avg_time_bc_sec"),
}
ROUTED_FEATURES = COMMON_FEATURES + list(ROUTES)


def routed_features(features: DataFrame, flags: DataFrame, flag: str = "updates_as_creates_50") -> DataFrame:
    """Rhythm features from the property level where updates arrive as new values, else from the value level."""
    flagged = features.join(
        flags.select("property_id", "pct_values_temporal_qualifier", "updates_as_creates_50", "updates_as_creates_60"),
        "property_id", "left").fillna(0, ["updates_as_creates_50", "updates_as_creates_60"])
    return flagged.select(
        "*", *(F.when(F.col(flag) == 1, F.col(ep)).otherwise(F.col(epv)).alias(name) for name, (epv, ep) in ROUTES.items()))
