"""The property catalogue: which properties are identifiers, deleted, or labelled with a type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlore.functions.columns import flag, plain_latin
from editlore.vocabulary import PSEUDO_PROPERTIES

ID_WORD = r"\bID\b"


def _speaks_of_identifiers(text: Column) -> Column:
    latin = plain_latin(text)
    return latin.ilike("%identif%") | latin.rlike(r"\bIDs?\b") | latin.rlike(r"\bcode\b")


def properties(labels: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every property ever labelled, with metadata where it still exists, and the flags derived from both."""
    joined = labels.join(metadata, "property_id", "left").withColumn(
        "has_characteristic_num_id", F.coalesce("has_characteristic_num_id", F.lit(False)))
    is_id = (
        F.col("has_characteristic_num_id")
        | F.coalesce(F.col("property_data_type") == "ExternalId", F.lit(False))
        | (F.coalesce(F.col("property_label").rlike(ID_WORD), F.lit(False))
           & (F.coalesce(_speaks_of_identifiers(F.col("property_description")), F.lit(False))
              | F.coalesce(_speaks_of_identifiers(F.col("aliases")), F.lit(False))))
    )
    kind = (
        F.when(F.col("frequency_update_label") == "sometimes changes", "irregular")
        .when(F.col("frequency_update_label") == "continuously changes", "regular")
        .when(F.col("frequency_update_label") == "never changes", "static")
        .otherwise("")
    )
    return (
        joined.withColumn("is_id_property", flag(is_id))
        .withColumn("was_deleted", flag(F.col("property_data_type").isNull()))
        .withColumn("to_exclude", flag(
            ((F.col("was_deleted") == 1) & F.col("property_label").rlike(ID_WORD)) | (F.col("is_id_property") == 1)))
        .withColumn("property_type", kind)
    )


def properties_to_classify(catalogue: DataFrame) -> DataFrame:
    return catalogue.filter((F.col("to_exclude") == 0) & ~F.col("property_id").isin(PSEUDO_PROPERTIES))


def label_counts(catalogue: DataFrame) -> DataFrame:
    """How many properties carry which label, and how many of them are identifiers by name. One pass."""
    is_id = F.col("property_label").contains(" ID")
    kind = F.nullif(F.col("property_type"), F.lit(""))

    def n(condition: Column, name: str) -> Column:
        return F.count(F.when(condition, 1)).alias(name)

    counted = catalogue.agg(
        n(kind == "static", "num_static"), n((kind == "static") & is_id, "num_static_ids"),
        n(kind == "regular", "num_regular"),
        n(kind == "irregular", "num_irregular"), n((kind == "irregular") & is_id, "num_irregular_ids"),
        n(kind.isNull(), "num_unlabeled"), n(kind.isNull() & is_id, "num_unlabeled_ids"),
        n(kind.isNull() & ~F.coalesce(is_id, F.lit(False)), "num_unlabeled_non_ids"))
    return counted.select(
        "*", (100.0 * F.try_divide(F.col("num_static_ids"), F.col("num_static"))).alias("pct_static_ids"),
        (100.0 * F.try_divide(F.col("num_irregular_ids"), F.col("num_irregular"))).alias("pct_irregular_ids"))


def non_id_static_properties(catalogue: DataFrame, n: int | None) -> DataFrame:
    """Static properties that are no identifiers, the first ``n`` for reading through or, with None, all."""
    found = (
        catalogue.filter((F.col("property_type") == "static") & ~F.col("property_label").contains(" ID"))
        .select("property_id", "property_label", "property_type")
    )
    return found if n is None else found.orderBy("property_id").limit(n)
