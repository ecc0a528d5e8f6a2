"""Gaps along a line of events, summed up by the owner of the later event, without a window over a whole line.

A line may hold a large part of the log, so it is cut by the calendar. A day of a line whose events all have one owner needs no order: its inner gaps add
up to its span, and there is one less than it has events. Only days with several owners are looked at by instant; instants are merged into hours, hours
into days, days into the line. Each merge sees the first and last event of its parts alone and adds the gaps between them: at most 3600 parts (times are
whole seconds), 24 parts, and the days of the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlore.functions.columns import micros_between
from editlore.session import materialise

EVENT = ("timestamp", "revision_id")


def day_of(at: Column) -> Column:
    return F.to_date(at)


def days_by_owner(events: DataFrame, line: str, owner: Sequence[str], first: Column, last: Column, n: Column) -> DataFrame:
    """Per line, day and owner the first event, the last time and the number of events; the arguments are aggregates over ``events`` with a ``_day``."""
    keys = list(dict.fromkeys([line, "_day", *owner]))
    return events.groupBy(*keys).agg(first.alias("_first"), last.alias("_last"), n.alias("_n"))


def gap_sums(days: DataFrame, events: DataFrame, line: str, owner: Sequence[str]) -> DataFrame:
    """Per ``owner`` the sum ``_gap`` (microseconds) and the number ``_gaps`` of gaps between consecutive events of a line, each counted
    for the later event. ``days`` is the result of ``days_by_owner``, ``events`` all events with ``EVENT`` and ``_day``."""
    owner = list(owner)
    days = materialise(days.withColumn("_owners", F.count(F.lit(1)).over(Window.partitionBy(line, "_day"))))
    pure = days.filter("_owners = 1")
    inner = [pure.select(*owner, micros_between(F.col("_last"), F.col("_first.timestamp")).alias("_gap"), (F.col("_n") - 1).alias("_gaps"))]
    parts = pure.select(line, "_day", F.struct(*owner).alias("_owner"), F.col("_first.timestamp").alias("_from"), F.col("_last").alias("_to"))
    mixed = days.filter("_owners > 1").select(F.col(line).alias("_line"), F.col("_day").alias("_on")).distinct()
    if not mixed.isEmpty():
        some = events.join(mixed, F.col(line).eqNullSafe(F.col("_line")) & (F.col("_day") == F.col("_on")), "left_semi")
        found, whole_days = _by_instant(some, line, owner)
        inner += found
        parts = parts.unionByName(whole_days)
    inner.append(_between(parts, [line], owner))
    total = inner[0]
    for more in inner[1:]:
        total = total.unionByName(more)
    return total.groupBy(*owner).agg(F.sum("_gap").alias("_gap"), F.sum("_gaps").alias("_gaps"))


def _between(parts: DataFrame, keys: Sequence[str], owner: Sequence[str]) -> DataFrame:
    """The gaps between consecutive parts of ``keys``: one per part but the first, for the owner of its first event."""
    before = F.lag("_to").over(Window.partitionBy(*keys).orderBy("_from"))
    return parts.select("_owner", micros_between(F.col("_from"), before).alias("_gap")).filter(F.col("_gap").isNotNull()).select(
        *(F.col(f"_owner.{c}").alias(c) for c in owner), "_gap", F.lit(1).cast("long").alias("_gaps"))


def _merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.min_by("_owner", "_from").alias("_owner"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))


def _by_instant(events: DataFrame, line: str, owner: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Inner gaps, and the days as parts, of days with several owners. Within an instant gaps are zero, and its first event is the one of the least revision."""
    at, revision = EVENT
    keys = list(dict.fromkeys([line, "_day", at, *owner]))
    shares = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(revision).alias("_least"))
    place = F.row_number().over(Window.partitionBy(line, at).orderBy("_least", *owner))
    shares = shares.withColumn("_place", place)
    inner = [shares.select(*owner, F.lit(0).cast("long").alias("_gap"), (F.col("_n") - (F.col("_place") == 1).cast("long")).alias("_gaps"))]
    parts = shares.filter("_place = 1").select(
        line, "_day", F.date_trunc("hour", F.col(at)).alias("_hour"), F.struct(*owner).alias("_owner"), F.col(at).alias("_from"), F.col(at).alias("_to"))
    inner.append(_between(parts, [line, "_day", "_hour"], owner))
    parts = _merged(parts, [line, "_day", "_hour"])
    inner.append(_between(parts, [line, "_day"], owner))
    return inner, _merged(parts, [line, "_day"]).select(line, "_day", "_owner", "_from", "_to")
