"""Vectors of short texts by hashing their character n-grams: no model, the same in any engine that knows MD5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
GRAM = 3


def grams(text: Column, length: int = GRAM) -> Column:
    """All runs of ``length`` characters of the lower-cased text between two spaces; NULL counts as empty."""
    characters = F.split(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), "")
    # One slice per place: linear in the text, where a substring would count from its start each time.
    starts = F.when(F.size(characters) >= length, F.sequence(F.lit(1), F.size(characters) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.concat_ws("", F.slice(characters, at, length)))


def text_vectors(df: DataFrame, key: str, text: Column, dimensions: int = DIMENSIONS, length: int = GRAM) -> DataFrame:
    """(key, embedding) for every key: signed counts of n-grams by hash, scaled to length 1.

    Place and sign of an n-gram come from different digits of its digest. A text without n-grams, or whose counts cancel, has a zero
    vector. Rows that share a key count as one text; a NULL key is a key. Texts are shuffled once, n-grams never: both aggregates keep
    the partitioning of the key, and the second one holds at most ``dimensions`` rows per key.
    """
    placed = df.select(F.col(key).alias("_key"), text.alias("_text")).repartition("_key")
    digest = F.md5(F.col("_gram"))
    hashed = placed.select("_key", F.explode_outer(grams(F.col("_text"), length)).alias("_gram")).select(
        "_key", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int").alias("_place"),
        F.when(F.substring(digest, 9, 1) < "8", 1).otherwise(-1).alias("_sign"))
    counted = hashed.groupBy("_key", "_place").agg(F.sum("_sign").alias("_n"))
    found = counted.groupBy("_key").agg(
        F.map_from_entries(F.filter(F.collect_list(F.struct("_place", "_n")), lambda e: e["_place"].isNotNull())).alias("_counts"),
        F.sqrt(F.sum(F.when(F.col("_place").isNotNull(), F.col("_n") * F.col("_n")))).alias("_norm"))
    one = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.when(F.col("_norm") > 0, F.coalesce(F.try_element_at("_counts", i), F.lit(0)) / F.col("_norm")).otherwise(0.0))
    return found.select(F.col("_key").alias(key), one.alias("embedding"))
