"""Features, target and evaluation tables for predicting which changes get rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlore.functions.columns import (
    MICROS_PER_DAY, canonical_label, change_type_flags, change_type_list, comment_has_keyword, count_where, days_between, flag,
    micros_between, share, time_of_day, time_of_week, whole_days,
)
from editlore.operators.ordered import (
    STATEMENT, After, Before, First, Running, Scan, Total, by_heat, ordered_scan, row_number,
)
from editlore.plans.history import spread_left_join, with_replaced_values
from editlore.session import Scale
from editlore.vocabulary import CHANGE_TYPES, DUMP_TIME, REJECTION_DAYS, TRAINING_CUTOFF

# Entity columns that get an ``entity_`` prefix beside a change.
ENTITY_COLUMNS = ["first_revision_timestamp", "last_revision_timestamp", "num_human_edits", "num_bot_edits", "num_anonymous_edits",
                  "num_reverted_edits", "num_value_changes", "num_revisions", "num_value_change_creates",
                  "num_value_change_deletes", "num_value_change_updates", "num_unique_editors"]

ENTITY_SHARES = {
    "entity_pct_updates_to_total_edits": ("entity_num_value_change_updates", "entity_num_value_changes"),
    "entity_pct_creates_to_total_edits": ("entity_num_value_change_creates", "entity_num_value_changes"),
    "entity_pct_deletes_to_total_edits": ("entity_num_value_change_deletes", "entity_num_value_changes"),
    "entity_pct_bot_edits": ("entity_num_bot_edits", "entity_num_revisions"),
    "entity_pct_anonymous_edits": ("entity_num_anonymous_edits", "entity_num_revisions"),
    "entity_pct_human_edits": ("entity_num_human_edits", "entity_num_revisions"),
}

NUMERICAL = ["value_age_in_days_up_to_t", "total_changes_up_to_t", "num_non_reverted_edits_up_to_t", "time_to_previous_edit_days",
             "num_value_reoccurrences_at_t", "entity_age_days_at_t", *ENTITY_SHARES, "entity_num_unique_editors",
             "time_to_last_edit_of_entity_at_t"]
CATEGORICAL = ["time_of_day", "time_of_week", "user_type", "action", "property_type", "type_of_previous_edit"]
BINARY = [*CHANGE_TYPES, "comment_has_keyword", "entity_abandoned"]

GROUPS = ["changes_anonymous", "changes_no_anonymous"]
ANONYMOUS_GROUP = GROUPS[0]


def features_for(group: str) -> tuple[list[str], list[str], list[str]]:
    """(numerical, categorical, binary) feature names; the anonymous model has none about users."""
    def kept(names: list[str]) -> list[str]:
        return [n for n in names if group != ANONYMOUS_GROUP or "user" not in n]

    return kept(NUMERICAL), kept(CATEGORICAL), kept(BINARY)


def change_sample(
    value_change: DataFrame, revision: DataFrame, entity_stats: DataFrame, catalogue: DataFrame, first_edits: DataFrame, scale: Scale
) -> DataFrame:
    """Changes (values and ranks) with the values they replaced, their editor, entity statistics and property type.

    Everything is joined before the changes are placed by statement, so no later step has to move them again.
    """
    entities = entity_stats.select("entity_id", *ENTITY_COLUMNS).withColumnsRenamed({c: f"entity_{c}" for c in ENTITY_COLUMNS})
    editors = revision.select("revision_id", "user_id", "username", "user_type", "comment")
    joined = (
        value_change.join(editors, "revision_id")
        .join(entities, "entity_id")
        .join(catalogue.select("property_id", F.nullif("property_type", F.lit("")).alias("property_type")), "property_id", "left")
    )
    first = first_edits.select("user_id", F.col("first_edit").alias("user_first_edit"))
    return with_replaced_values(spread_left_join(joined, first, "user_id", "revision_id"), scale)


def _labels() -> Column:
    """Insertions and deletions are described by their label alone, updates by change type and label."""
    updated = F.col("action") == "UPDATE"
    return change_type_list(F.when(updated, F.col("change_type")), canonical_label(F.col("label")))


def predictor_features(sample: DataFrame, scale: Scale, before_t: bool = False) -> DataFrame:
    """All predictor features beside the sampled changes.

    ``before_t`` counts unreverted edits without the current one, so that the count does not give the label away.
    """
    at = F.col("timestamp")
    clean = flag((F.col("is_reverted") == 0) & (F.col("reversion") == 0))
    prepared = sample.withColumns({
        "change_target": F.coalesce("change_target", F.lit("")), "_labels": _labels(),
        "_value": F.coalesce("new_value", F.lit("")), "_clean": clean})

    def plan(part: DataFrame, scan: Scan) -> DataFrame:
        scanned = scan(part, STATEMENT, {
            "total_changes_up_to_t": row_number(), "_clean_so_far": Running(F.col("_clean")), "_previous": Before(at),
            "_first": First(at), "_previous_action": Before(F.col("action"))})
        return scan(scanned, [*STATEMENT, "_value"], {"_same_value": row_number()})

    seen = by_heat(prepared, STATEMENT, scale, plan)
    last = F.col("entity_last_revision_timestamp")
    return seen.select(
        *[c for c in prepared.columns if not c.startswith("_")],
        *change_type_flags(F.col("_labels")),
        time_of_day(at).alias("time_of_day"), time_of_week(at).alias("time_of_week"),
        comment_has_keyword(F.col("comment")).alias("comment_has_keyword"),
        days_between(at, F.col("_first")).alias("value_age_in_days_up_to_t"),
        "total_changes_up_to_t",
        (F.col("_clean_so_far") - F.col("_clean")).alias("num_non_reverted_edits_before_t") if before_t
        else F.col("_clean_so_far").alias("num_non_reverted_edits_up_to_t"),
        days_between(at, F.col("_previous")).alias("time_to_previous_edit_days"),
        F.when(F.col("new_value").isNull(), F.lit(0)).otherwise(F.col("_same_value") - 1).alias("num_value_reoccurrences_at_t"),
        F.coalesce("_previous_action", F.lit("None")).alias("type_of_previous_edit"),
        whole_days(at, F.col("entity_first_revision_timestamp")).alias("entity_age_days_at_t"),
        whole_days(at, F.col("entity_first_revision_timestamp")).alias("time_to_first_edit_of_entity_in_days_at_t"),
        *(share(F.col(part), F.col(whole)).alias(name) for name, (part, whole) in ENTITY_SHARES.items()),
        whole_days(at, last).alias("time_to_last_edit_of_entity_at_t"),
        flag(micros_between(F.lit(DUMP_TIME).cast("timestamp"), last) > 365 * MICROS_PER_DAY).alias("entity_abandoned"),
        F.when(F.col("user_type") != "anonymous", whole_days(at, F.col("user_first_edit"))).otherwise(F.lit(0)).alias("user_age_days"))


def with_groups(df: DataFrame, cutoff: str = TRAINING_CUTOFF) -> DataFrame:
    """Mark the model a change belongs to and the side of the time split."""
    return df.withColumns({
        "model_group": F.when(F.col("user_type") == "anonymous", GROUPS[0]).otherwise(GROUPS[1]),
        "split": F.when(F.col("timestamp") < F.lit(cutoff).cast("timestamp"), "train").otherwise("test")})


def with_target(df: DataFrame, scale: Scale, keep_all: bool = False) -> DataFrame:
    """1 if the change is reverted within six months, or followed only by a deletion within six months.

    History ends at the borders of ``model_group`` and ``split``, so the label never looks across the split.
    Deletions and rank changes are 0 unless ``keep_all``; then a rank change shares the fate of a value change
    made in the same revision.
    """
    keys = [*STATEMENT, "change_target", "model_group", "split"]
    scanned = ordered_scan(df, keys, {
        "_next": After(F.struct("action", "timestamp")), "_position": row_number(), "_count": Total(F.lit(1))}, scale)
    limit = F.lit(int(round(REJECTION_DAYS * MICROS_PER_DAY)))
    is_deleted = flag(
        (F.col("change_target") == "") & (F.col("_next.action") == "DELETE") & (F.col("_position") == F.col("_count") - 1)
        & (micros_between(F.col("_next.timestamp"), F.col("timestamp")) <= limit))
    days = F.coalesce(whole_days(F.col("reversion_timestamp"), F.col("timestamp")), F.lit(0))
    reverted = (F.col("is_reverted") == 1) & (days <= F.lit(REJECTION_DAYS))
    marked = scanned.withColumn("is_deleted", is_deleted).drop("_next", "_position", "_count")
    if keep_all:
        same_revision = Window.partitionBy("revision_id", *STATEMENT, "model_group", "split")
        return marked.withColumn("target_to_predict", flag(reverted | (F.max("is_deleted").over(same_revision) == 1)))
    not_predicted = (F.col("action") == "DELETE") | (F.col("change_target") == "rank")
    return marked.withColumn("target_to_predict", F.when(not_predicted, 0).otherwise(flag(reverted | (F.col("is_deleted") == 1))))


def model_rows(df: DataFrame) -> DataFrame:
    """Rows a model is fitted on and applied to; ranks and deletions only helped to find the target."""
    return df.filter((F.col("change_target") == "") & (F.col("action") != "DELETE"))


def target_distribution(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    positive = F.sum("target_to_predict")
    return df.groupBy("model_group", "split").agg(
        n.alias("num_rows"), positive.alias("num_positive"), share(positive, n).alias("ratio_positive"),
        share(n - positive, n).alias("ratio_negative"))


def binary_metrics(df: DataFrame, target: str, prediction: str, by: list[str], more: list[Column] = ()) -> DataFrame:
    """Counts, precision, recall and F1 of class 1, and ``more`` aggregates, from one pass; nothing to divide by gives 0."""
    hit, said, true = (
        count_where((F.col(target) == 1) & (F.col(prediction) == 1)),
        count_where(F.col(prediction) == 1), count_where(F.col(target) == 1))
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_rows"), true.alias("num_positive"), said.alias("num_predicted"), hit.alias("num_hits"),
        F.coalesce(share(hit, said), zero).alias("precision"), F.coalesce(share(hit, true), zero).alias("recall"),
        F.coalesce(share(2 * hit, said + true), zero).alias("f1"), *more)


def baseline_anonymous(df: DataFrame) -> DataFrame:
    """What calling exactly the rejected anonymous edits unreliable would score; its precision is 1 by construction."""
    anonymous = F.col("user_type") == "anonymous"
    predicted = df.withColumn("prediction_anonymous", flag(anonymous & (F.col("target_to_predict") == 1)))
    return binary_metrics(predicted, "target_to_predict", "prediction_anonymous", ["split"], [
        count_where(anonymous).alias("num_anonymous"),
        count_where(anonymous & (F.col("target_to_predict") == 1)).alias("num_anonymous_rejected"),
        count_where(~anonymous & (F.col("target_to_predict") == 1)).alias("num_other_rejected")])


def prediction_validation(original: DataFrame, predictions: DataFrame) -> DataFrame:
    """The whole test set with its predictions; changes that were not predicted get 0."""
    keys = ["revision_id", *STATEMENT, "change_target"]
    return original.join(predictions.select(*keys, "prediction"), keys, "left").withColumn(
        "prediction", F.coalesce(F.col("prediction").cast("int"), F.lit(0)))


def rejected_values(validated: DataFrame, n: int | None) -> DataFrame:
    """Value changes predicted to be rejected, the first ``n`` for reading through or, with None, all."""
    rejected = validated.filter((F.col("prediction") == 1) & (F.col("action") != "DELETE") & (F.col("change_target") == ""))
    shown = ["entity_id", "entity_label", "property_id", "property_label", "value_id", "old_value", "new_value"]
    if n is None:
        return rejected.select(*shown)
    return rejected.orderBy(*STATEMENT, "timestamp", "revision_id").select(*shown).limit(n)


def statement_history(changes: DataFrame, entity_id: int, property_id: int, value_id: str) -> DataFrame:
    """Everything that happened to one statement's value, in order."""
    return changes.filter(
        (F.col("entity_id") == entity_id) & (F.col("property_id") == property_id) & (F.col("value_id") == value_id)
        & (F.col("change_target") == "")).orderBy("timestamp", "revision_id")


def longest_history(changes: DataFrame) -> DataFrame:
    """The history of the statement with most value changes, the one with the smallest key among equals."""
    values = changes.filter(F.col("change_target") == "")
    counted = values.groupBy(*STATEMENT).agg(F.count(F.lit(1)).alias("_n"))
    most = F.broadcast(counted.orderBy(F.desc("_n"), *STATEMENT).limit(1).drop("_n"))  # one row
    return values.join(most, list(STATEMENT), "left_semi").orderBy("timestamp", "revision_id")


def profile_counts(sample: DataFrame) -> DataFrame:
    """Changes, entities and properties overall and per property type, as one table (NULL type = overall)."""
    counted = sample.rollup("property_type").agg(
        F.grouping_id().alias("_all"), F.count(F.lit(1)).alias("num_changes"),
        F.count_distinct("entity_id").alias("num_entities"), F.count_distinct("property_id").alias("num_properties"))
    return counted.select(
        F.when(F.col("_all") == 1, "(all)").otherwise(F.coalesce("property_type", F.lit("(none)"))).alias("property_type"),
        "num_changes", "num_entities", "num_properties")


def average_values_per_property(changes: DataFrame) -> DataFrame:
    """Mean number of distinct values an entity has for each property."""
    pairs = changes.groupBy("entity_id", "property_id").agg(F.count_distinct("value_id").alias("num_distinct_values"))
    return pairs.groupBy("property_id").agg(F.avg("num_distinct_values").alias("avg_num_distinct_values_per_property"))
