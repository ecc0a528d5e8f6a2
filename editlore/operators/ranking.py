"""Ranking quality of scores: ROC curve and the area under it, from counts by score.

Rows are counted per score first, so ties are one step of the curve. The counts are sorted across range partitions; each partition is summed up in one row, and
a scan over those few rows says what lies below each partition. No task sees all scores. NULL is the lowest score, NaN the highest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editlore.functions.columns import count_where, share
from editlore.session import materialise


def cumulated(scored: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` and distinct score: rows of either label (``positives``, ``negatives``), those below, and those of the group."""
    by = list(by)
    counts = scored.groupBy(*by, F.col(score).alias("score")).agg(
        count_where(F.col(label) == 1).alias("positives"), count_where(F.col(label) == 0).alias("negatives"))
    placed = materialise(counts.repartitionByRange(*by, "score").withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*by, "_part").agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
    line, group = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    below = parts.select(
        *(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_of"), F.coalesce(F.sum("_p").over(line), F.lit(0)).alias("_p"),
        F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_n"), F.sum("_p").over(group).alias("all_positives"), F.sum("_n").over(group).alias("all_negatives"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_part") == F.col("_of"))
    inside = Window.partitionBy(*by, "_part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)

    def lower(c: str, before: str):
        return (F.col(before) + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below")

    return placed.join(below, same).select(
        *by, "score", "positives", "negatives", lower("positives", "_p"), lower("negatives", "_n"), "all_positives", "all_negatives")


def roc_curve(counts: DataFrame) -> DataFrame:
    """``cumulated`` rows with the shares of positives and negatives that score at least as high."""
    return counts.withColumns({
        "true_positive_rate": share(F.col("all_positives") - F.col("positives_below"), F.col("all_positives")),
        "false_positive_rate": share(F.col("all_negatives") - F.col("negatives_below"), F.col("all_negatives"))})


def roc_auc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` the share of (positive, negative) pairs in the right order, ties as halves; NULL without pairs."""
    won = F.sum(F.col("positives").cast("double") * (F.col("negatives_below") + F.col("negatives") / 2))
    pairs = F.sum("positives").cast("double") * F.sum("negatives")
    return counts.groupBy(*by).agg(F.sum("positives").alias("num_positive"), F.sum("negatives").alias("num_negative"),
                                   F.count(F.lit(1)).alias("num_scores"), share(won, pairs).alias("roc_auc"))
