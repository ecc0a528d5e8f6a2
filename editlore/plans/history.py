"""Features of a change from its own text, its editor, its property and the history of its statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlore.functions.columns import (
    change_type_flags, change_type_list, comment_has_keyword, days_between, empty_object_to_null, flag, share_or_zero,
    time_of_day, time_of_week, whole_days,
)
from editlore.operators.ordered import (
    STATEMENT, After, Before, First, Latest, Running, Scan, by_heat, ordered_scan, overlay, placed, row_number,
)
from editlore.session import Scale
from editlore.vocabulary import (
    BASE_COLUMNS, CHANGE_TYPES, ENTITY_DATATYPES, IMPORTED_FROM_WIKIPEDIA, NO_NEXT_EDIT_DAYS, UNKNOWN_VALUES, USER_TYPES,
)

# Which features exist, by family and kind.
FEATURES = {
    "single_change": {
        "categorical": ["time_of_day", "time_of_week", "type_of_next_edit"],
        "binary": ["is_reverted", "reversion", *CHANGE_TYPES],
        "numerical": [],
    },
    "user_model": {
        "categorical": ["user_type"],
        "binary": ["user_is_expert"],
        "numerical": [f"{name}_user" for name in (
            "user_age_days", "num_entities", "num_revisions", "num_properties", "num_creates", "num_deletes", "num_updates",
            "num_value_changes", "num_reverted_edits", "num_non_reverted_edits", "avg_days_between_revisions",
            "num_edits_morning", "num_edits_afternoon", "num_edits_night", "num_edits_weekday", "num_edits_weekend",
            "avg_entities_per_day", "avg_properties_per_day")],
    },
    "historical": {
        "categorical": [],
        "binary": [],
        "numerical": [
            "num_reverted_edits_up_to_t", "num_non_reverted_edits_up_to_t",
            "ratio_reverted_edits_up_to_t", "ratio_non_reverted_edits_up_to_t", "time_since_last_edit_days",
            "time_to_next_edit_days", "value_age_in_entity_in_days_up_to_t", "num_changes_wd_values",
            "num_value_reoccurrences", "num_unique_registered_users", "num_references_up_to_t", "num_wikipedia_refs_up_to_t",
            "num_non_wikipedia_refs_up_to_t", "ratio_non_wikipedia_refs_up_to_t", "ratio_wikipedia_refs_up_to_t",
            "total_changes_up_to_t", "total_references_up_to_t", *(f"num_{t}" for t in CHANGE_TYPES)],
    },
    "property": {"categorical": [], "binary": ["citation_needed"], "numerical": ["property_reference_rate"]},
}


def spread_left_join(df: DataFrame, dimension: DataFrame, key: str, spread_on: str) -> DataFrame:
    """Left join on a key that is often NULL. Rows without a key match nothing; a second join column, 0 for real keys, scatters
    them, so that they do not all meet in one task."""
    salt = F.when(F.col(key).isNull(), 1 + F.pmod(F.xxhash64(spread_on), F.lit(65_536))).otherwise(0)
    salted = df.withColumns({"_key": F.coalesce(F.col(key), F.lit(0)), "_salt": salt})
    renamed = dimension.filter(F.col(key).isNotNull()).withColumnRenamed(key, "_key").withColumn("_salt", F.lit(0).cast("long"))
    return salted.join(renamed, ["_key", "_salt"], "left").drop("_key", "_salt")


def with_change_types(changes: DataFrame) -> DataFrame:
    """One 0/1 column per change type, from the comma lists of both labels."""
    listed = changes.withColumn("labels_list", change_type_list(F.col("change_type"), F.col("label")))
    return listed.select("*", *change_type_flags(F.col("labels_list")))


def user_features(model: DataFrame) -> DataFrame:
    """The user model as features: every column suffixed, age of the account, missing daily rates as 0."""
    aged = model.withColumn("user_age_days", whole_days(F.col("last_edit"), F.col("first_edit"))).fillna(
        0.0, ["avg_entities_per_day", "avg_properties_per_day"])
    return aged.select("user_id", *(F.col(c).alias(f"{c}_user") for c in aged.columns
                                    if c not in ("user_id", "username", "user_type")))


def with_editor_and_property(changes: DataFrame, model: DataFrame, prop_ref_rate: DataFrame) -> DataFrame:
    """Features of the single edit that need no ordering. Everyone's edits keep their row; anonymous ones have no model."""
    joined = spread_left_join(changes, user_features(model), "user_id", "revision_id").join(
        prop_ref_rate.select("property_id", F.col("reference_rate").alias("property_reference_rate"), "citation_needed"),
        "property_id", "left")
    return joined.withColumns({
        "time_of_day": time_of_day(F.col("timestamp")),
        "time_of_week": time_of_week(F.col("timestamp")),
        "comment_has_keyword": comment_has_keyword(F.col("comment")),
        "user_is_expert": flag(F.array_contains("property_id_expertise_list_user", F.col("property_id"))),
    })


def with_next_edit(changes: DataFrame, scale: Scale) -> DataFrame:
    scanned = ordered_scan(changes, STATEMENT, {"_next_action": After(F.col("action"))}, scale)
    return scanned.withColumn("type_of_next_edit", F.coalesce("_next_action", F.lit("None"))).drop("_next_action")


def single_change_features(changes: DataFrame, model: DataFrame, prop_ref_rate: DataFrame, scale: Scale) -> DataFrame:
    return with_editor_and_property(with_next_edit(changes, scale), model, prop_ref_rate)


def with_replaced_values(changes: DataFrame, scale: Scale) -> DataFrame:
    """Changes together with what they replaced: the value, datatype and label before them.

    Rows stay placed by statement for the scans that usually follow.
    """
    told = ordered_scan(placed(changes, STATEMENT, scale), [*STATEMENT, "change_target"],
                        {"_old": Before(F.struct("new_value", "new_datatype", "new_value_label"))}, scale)
    return told.select(
        *changes.columns,
        F.coalesce(F.col("_old.new_value"), F.lit("{}")).alias("old_value"),
        F.col("_old.new_datatype").alias("old_datatype"),
        F.col("_old.new_value_label").alias("old_value_label"))


def expected_datatypes(changes: DataFrame) -> DataFrame:
    """The most frequent datatype of each property, the smallest on ties. Counting first keeps groups small.

    Missing datatypes take no part; a property that has no other keeps its row with NULL.
    """
    counted = changes.groupBy("property_id", F.col("new_datatype").alias("_type")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct(F.col("_type").isNull().alias("missing"), (-F.col("_n")).alias("n"), F.col("_type").alias("t")))
    return counted.groupBy("property_id").agg(best["t"].alias("expected_datatype"))


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def running_history(changes: DataFrame, scale: Scale) -> DataFrame:
    """What had happened to the statement up to and including each change.

    All scans share the statement as partitioning, so the log is shuffled once; scans over finer keys
    (statement and value, statement and user) only sort again.
    """
    at = F.col("timestamp")
    clean = _is((F.col("is_reverted") == 0) & (F.col("reversion") == 0))
    unknown = _is((F.col("old_datatype") == UNKNOWN_VALUES) | (F.col("new_datatype") == UNKNOWN_VALUES))
    measures = {
        "num_reverted_edits_up_to_t": Running(F.col("is_reverted")),
        "total_changes_up_to_t": row_number(),
        "num_non_reverted_edits_up_to_t": Running(clean),
        "num_changes_wd_values": Running(unknown),
        "_previous": Before(at),
        "_next": After(at),
        "_first": First(at),
        "_next_action": After(F.col("action")),
        **{f"_n_{t}": Running(_is(F.col("user_type") == t)) for t in USER_TYPES},
        **{f"num_{t}": Running(F.col(t)) for t in CHANGE_TYPES},
    }
    is_new_user = _is((F.col("_of_user") == 1) & F.col("user_id").isNotNull())

    def plan(part: DataFrame, scan: Scan) -> DataFrame:
        scanned = scan(part, STATEMENT, measures).withColumns({
            "_value": F.coalesce("new_value", F.lit("")), "_user": F.coalesce("user_id", F.lit(-1))})
        seen = scan(scanned, [*STATEMENT, "_value"], {"_same_value": row_number()})
        met = scan(seen, [*STATEMENT, "_user"], {"_of_user": row_number()})
        return scan(met, STATEMENT, {"num_unique_registered_users": Running(is_new_user)})

    counted = by_heat(changes, STATEMENT, scale, plan)
    total = F.col("total_changes_up_to_t")
    return counted.select(
        *changes.columns,
        "num_reverted_edits_up_to_t", "num_non_reverted_edits_up_to_t", "total_changes_up_to_t",
        share_or_zero(F.col("num_reverted_edits_up_to_t"), total).alias("ratio_reverted_edits_up_to_t"),
        share_or_zero(F.col("num_non_reverted_edits_up_to_t"), total).alias("ratio_non_reverted_edits_up_to_t"),
        days_between(at, F.col("_previous")).alias("time_since_last_edit_days"),
        F.coalesce(days_between(F.col("_next"), at), F.lit(float(NO_NEXT_EDIT_DAYS))).alias("time_to_next_edit_days"),
        days_between(at, F.col("_first")).alias("value_age_in_entity_in_days_up_to_t"),
        F.coalesce("_next_action", F.lit("None")).alias("type_of_next_edit"),
        *(F.when(F.col("user_type") == t, F.col(f"_n_{t}") - 1).alias(f"num_edits_{t}") for t in USER_TYPES),
        unknown.alias("is_wd_value_change"), "num_changes_wd_values",
        F.when(F.col("new_value").isNull(), F.lit(0)).otherwise(F.col("_same_value") - 1).alias("num_value_reoccurrences"),
        "num_unique_registered_users",
        *(f"num_{t}" for t in CHANGE_TYPES))


def first_reference_actions(reference_change: DataFrame) -> DataFrame:
    """The first row per reference and action: a reference has several attributes but counts once.

    Of rows of one instant the Wikipedia import attribute comes first, so the kind of a reference is well defined.
    """
    line = Window.partitionBy(*STATEMENT, "ref_hash", "action").orderBy(
        "timestamp", "revision_id", F.desc(F.col("ref_property_id") == IMPORTED_FROM_WIKIPEDIA), "ref_property_id")
    return reference_change.withColumn("_rank", F.row_number().over(line)).filter("_rank = 1").drop("_rank")


def running_references(reference_change: DataFrame, scale: Scale) -> DataFrame:
    """Active references of both kinds after each reference change; updates leave the counts as they are."""
    delta = F.when(F.col("action") == "CREATE", 1).when(F.col("action") == "DELETE", -1).otherwise(0)
    imported = F.col("ref_property_id") == IMPORTED_FROM_WIKIPEDIA
    deltas = first_reference_actions(placed(reference_change, STATEMENT, scale)).select(
        "revision_id", *STATEMENT, "change_target", "timestamp", imported.alias("_imported"), delta.alias("_delta"))
    scanned = ordered_scan(deltas, STATEMENT, {
        "_wiki": Running(F.when(F.col("_imported"), F.col("_delta"))),
        "_non_wiki": Running(F.when(~F.col("_imported"), F.col("_delta")))}, scale)
    return scanned.select(
        "revision_id", *STATEMENT, "change_target", "timestamp",
        F.when(F.col("_imported"), F.col("_wiki")).alias("wiki_refs_up_to_t"),
        F.when(~F.col("_imported"), F.col("_non_wiki")).alias("non_wiki_refs_up_to_t"))


def with_reference_counts(changes: DataFrame, reference_change: DataFrame, scale: Scale) -> DataFrame:
    """References of both kinds as of each change (a reference of the same instant counts)."""
    found = overlay(changes, running_references(reference_change, scale), [*STATEMENT, "change_target"], {
        "_wiki_now": Latest(F.col("wiki_refs_up_to_t")), "_non_wiki_now": Latest(F.col("non_wiki_refs_up_to_t"))}, scale)
    wiki, non_wiki = F.coalesce("_wiki_now", F.lit(0)), F.coalesce("_non_wiki_now", F.lit(0))
    return found.select(
        *changes.columns,
        wiki.alias("num_wikipedia_refs_up_to_t"), non_wiki.alias("num_non_wikipedia_refs_up_to_t"),
        (wiki + non_wiki).alias("num_references_up_to_t"), (wiki + non_wiki).alias("total_references_up_to_t"),
        share_or_zero(non_wiki, wiki + non_wiki).alias("ratio_non_wikipedia_refs_up_to_t"),
        share_or_zero(wiki, wiki + non_wiki).alias("ratio_wikipedia_refs_up_to_t"))


def _value_label(value: str, datatype: str, label: str) -> Column:
    """Labels only make sense for entity values; an entity without one is shown as unknown."""
    entity = F.col(value).isNotNull() & F.col(datatype).isin(ENTITY_DATATYPES)
    return F.when(entity, F.coalesce(F.col(label), F.lit("Unknown")))


def feature_table(
    changes: DataFrame, reference_change: DataFrame, model: DataFrame, prop_ref_rate: DataFrame, scale: Scale
) -> DataFrame:
    """Base columns and all features of each sampled change; missing features are 0.

    ``changes`` carry their revision's user and comment.
    """
    cleaned = changes.withColumns({c: empty_object_to_null(F.col(c)) for c in ("old_value", "new_value")})
    history = with_reference_counts(running_history(with_change_types(cleaned), scale), reference_change, scale)
    full = with_editor_and_property(history, model, prop_ref_rate)
    names = [n for family in FEATURES.values() for kind in family.values() for n in kind] + ["comment_has_keyword"]
    base = [c for c in BASE_COLUMNS if c not in ("old_value_label", "new_value_label")]
    return full.select(
        *base,
        _value_label("old_value", "old_datatype", "old_value_label").alias("old_value_label"),
        _value_label("new_value", "new_datatype", "new_value_label").alias("new_value_label"),
        *names).fillna(0, [n for n in names if n not in _texts()])


def _texts() -> list[str]:
    return [n for family in FEATURES.values() for n in family["categorical"]]
