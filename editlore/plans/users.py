"""Editor models: how much, when and on what a registered user edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editlore.functions.columns import MICROS_PER_DAY, count_where, is_weekend, share, time_of_day, whole_days
from editlore.operators.gaps import day_of, days_by_owner, gap_sums
from editlore.session import materialise

USER = ["user_id", "username", "user_type"]


def user_model(value_change: DataFrame, revision: DataFrame) -> DataFrame:
    """One row per bot or human editor.

    Changes are summed up once by user, day, entity and property; users, days of users, and counts of entities and properties come from those sums. Gaps between
    consecutive changes run along the username, whatever its type at the time, and count for the later change; they are merged from days, so no task
    sorts all changes of a user.
    """
    changes = (
        value_change.filter(F.col("change_target") == "")
        .select("revision_id", "entity_id", "property_id", "action", "is_reverted", "reversion")
        .join(revision.filter(F.col("user_type").isin("bot", "human"))
              .select("revision_id", "user_id", "username", "user_type", "timestamp"), "revision_id")
    )
    at, n = F.col("timestamp"), F.count(F.lit(1))
    part, weekend = time_of_day(at), is_weekend(at)
    in_revision = Window.partitionBy("revision_id").orderBy("entity_id", "property_id")
    changes = changes.select("*", day_of(at).alias("_day"), (F.row_number().over(in_revision) == 1).alias("_opens"))
    sums = {
        "num_revisions": count_where(F.col("_opens")),
        "num_creates": count_where(F.col("action") == "CREATE"),
        "num_deletes": count_where(F.col("action") == "DELETE"),
        "num_updates": count_where(F.col("action") == "UPDATE"),
        "num_value_changes": n,
        "num_reverted_edits": count_where(F.col("is_reverted") == 1),
        "num_non_reverted_edits": count_where((F.col("is_reverted") == 0) & (F.col("reversion") == 0)),
        "num_edits_morning": count_where(part == "morning"),
        "num_edits_afternoon": count_where(part == "afternoon"),
        "num_edits_night": count_where(part == "night"),
        "num_edits_weekday": count_where(~weekend),
        "num_edits_weekend": count_where(weekend),
    }
    pairs = materialise(changes.groupBy(*USER, "_day", "entity_id", "property_id").agg(
        F.min(F.struct("timestamp", "revision_id")).alias("_first"), F.max(at).alias("last_edit"), *(c.alias(name) for name, c in sums.items())))
    days = days_by_owner(pairs, "username", USER, F.min("_first"), F.max("last_edit"), F.sum("num_value_changes"))
    gaps = gap_sums(days, changes, "username", USER)
    by_entity = pairs.groupBy(*USER, "entity_id").agg(F.min("_first.timestamp").alias("first_edit"), F.max("last_edit").alias("last_edit"), *(F.sum(c).alias(c) for c in sums))
    model = by_entity.groupBy(*USER).agg(
        F.min("first_edit").alias("first_edit"), F.max("last_edit").alias("last_edit"), n.alias("num_entities"), *(F.sum(c).alias(c) for c in sums))
    properties = pairs.select(*USER, "property_id").distinct().groupBy(*USER).agg(n.alias("num_properties"))
    # Names and ids may be NULL, so the three meet in a grouping.
    found = model.unionByName(properties, allowMissingColumns=True).unionByName(gaps, allowMissingColumns=True)
    whole = found.groupBy(*USER).agg(*(F.max(c).alias(c) for c in found.columns if c not in USER))
    time = F.nullif(whole_days(F.col("last_edit"), F.col("first_edit")), F.lit(0))
    return whole.select(
        *USER, "first_edit", "last_edit", "num_entities", "num_revisions", "num_properties", "num_creates", "num_deletes", "num_updates", "num_value_changes",
        "num_reverted_edits", "num_non_reverted_edits",
        F.when(F.col("_gaps") > 0, F.col("_gap") / F.col("_gaps") / float(MICROS_PER_DAY)).alias("avg_days_between_revisions"),
        "num_edits_morning", "num_edits_afternoon", "num_edits_night", "num_edits_weekday", "num_edits_weekend",
        share(F.col("num_entities"), time).alias("avg_entities_per_day"), share(F.col("num_properties"), time).alias("avg_properties_per_day"))


def first_edits(value_change: DataFrame, revision: DataFrame) -> DataFrame:
    """The users of ``user_model`` with their first edit only: one sum, without days, entities and gaps."""
    edits = revision.filter(F.col("user_type").isin("bot", "human")).select("revision_id", *USER, "timestamp")
    changed = value_change.filter(F.col("change_target") == "").select("revision_id").join(edits, "revision_id")
    return changed.groupBy(*USER).agg(F.min("timestamp").alias("first_edit"))


def user_property(value_change: DataFrame, revision: DataFrame, model: DataFrame) -> DataFrame:
    """Unreverted changes per user and property, also as a share of all the user's changes."""
    counted = (
        value_change.filter((F.col("change_target") == "") & (F.col("is_reverted") == 0)).select("revision_id", "property_id")
        .join(revision.filter(F.col("user_type") != "anonymous").select("revision_id", "user_id"), "revision_id")
        .groupBy("user_id", "property_id").agg(F.count(F.lit(1)).alias("count_changes"))
    )
    totals = model.groupBy("user_id").agg(F.sum("num_value_changes").alias("_total"))
    return counted.join(totals, "user_id", "left").select(
        "user_id", "property_id", "count_changes",
        F.coalesce(share(F.col("count_changes"), F.col("_total")), F.lit(0.0)).alias("avg_changes_to_property"))


def _top_lists(df: DataFrame, score: str, tie: str, k: int, lists: dict[str, str]) -> DataFrame:
    """Per user the first ``k`` rows by falling ``score``, as parallel ordered arrays.

    Ranking up to a constant is pre-limited before the shuffle, and the arrays hold ``k`` items at most.
    """
    line = Window.partitionBy("user_id").orderBy(F.desc(score), F.asc(tie))
    top = df.withColumn("_rank", F.row_number().over(line)).filter(F.col("_rank") <= k)
    items = F.array_sort(F.collect_list(F.struct("_rank", *lists.values())))
    return top.groupBy("user_id").agg(items.alias("_items")).select(
        "user_id", *(F.col(f"_items.{column}").alias(name) for name, column in lists.items()))


def expertise(shares: DataFrame, catalogue: DataFrame, k: int = 10) -> DataFrame:
    """The properties a user edits most, as id and label lists."""
    labelled = shares.join(catalogue.select("property_id", "property_label"), "property_id")
    return _top_lists(labelled, "avg_changes_to_property", "property_id", k,
                      {"property_id_expertise_list": "property_id", "property_label_expertise_list": "property_label"})


def top_entities(revision: DataFrame, k: int = 3) -> DataFrame:
    """The entities a user revised most often."""
    counted = revision.filter(F.col("user_type") != "anonymous").groupBy("user_id", "entity_id").agg(
        F.count(F.lit(1)).alias("num_revisions_entity"))
    return _top_lists(counted, "num_revisions_entity", "entity_id", k, {"top_3_entity_id": "entity_id"})


def full_user_model(model: DataFrame, skills: DataFrame, favourites: DataFrame) -> DataFrame:
    """The user model with expertise and favourite entities; users without either get empty lists."""
    joined = model.join(skills, "user_id", "left").join(favourites, "user_id", "left")
    lists = {"property_id_expertise_list": "array<bigint>", "property_label_expertise_list": "array<string>",
             "top_3_entity_id": "array<bigint>"}
    return joined.withColumns({name: F.coalesce(name, F.array().cast(kind)) for name, kind in lists.items()})
