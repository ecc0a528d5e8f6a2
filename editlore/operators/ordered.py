"""Ordered scans over keyed logs: previous / next row, running totals, latest value so far.

A window per key puts a whole key into one task. That is the plan for all keys within the limit. Larger keys, if
the log has any, are cut into time slices: windows run inside a slice, every slice is summed up in one row, and a
scan over those few rows carries totals, first and last rows across the slice borders. The result is the same, and
no task ever holds more than about one slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlore.session import Scale, materialise

STATEMENT = ("entity_id", "property_id", "value_id")
TIMELINE = ("timestamp", "revision_id")


@dataclass(frozen=True)
class Before:
    """The value on the previous row of the group."""

    value: Column


@dataclass(frozen=True)
class After:
    """The value on the next row of the group."""

    value: Column


@dataclass(frozen=True)
class Running:
    """Sum from the first row of the group up to and including this row; NULL counts as 0."""

    value: Column


@dataclass(frozen=True)
class Latest:
    """The last value that is not NULL, up to and including this row."""

    value: Column


@dataclass(frozen=True)
class First:
    """The value on the first row of the group."""

    value: Column


@dataclass(frozen=True)
class Total:
    """The sum over the whole group; NULL counts as 0."""

    value: Column


Measure = Before | After | Running | Latest | First | Total
Scan = Callable[..., DataFrame]


def row_number() -> Running:
    return Running(F.lit(1))


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    measures: dict[str, Measure],
    scale: Scale,
    order: Sequence[str] = TIMELINE,
) -> DataFrame:
    """Add one column per measure, computed per ``keys`` group in ``order`` (first column: a timestamp)."""
    return by_heat(df, keys, scale, lambda part, scan: scan(part, keys, measures, order))


def by_heat(df: DataFrame, keys: Sequence[str], scale: Scale, plan: Callable[[DataFrame, Scan], DataFrame]) -> DataFrame:
    """Apply ``plan`` to ``df``, handing it the scan that suits the groups of ``keys``.

    Without hot groups that is one plan over all rows. Otherwise rows of hot groups, and only those, are planned
    with slices. ``plan`` may scan repeatedly by ``keys`` and by keys that refine them.
    """
    level = scale.level(keys)
    hot = scale.hot(level) if level else None
    if hot is None:
        return plan(df, scan_in_windows)
    df = materialise(df)
    cold = df.join(F.broadcast(hot), list(level), "left_anti")
    warm = materialise(df.join(F.broadcast(hot), list(level), "left_semi"))
    every = max(scale.limit // 4, 1)
    return plan(cold, scan_in_windows).unionByName(
        plan(warm, lambda part, keys, measures, order=TIMELINE: scan_in_slices(part, keys, measures, order, every)))


def placed(df: DataFrame, keys: Sequence[str], scale: Scale) -> DataFrame:
    """Shuffle by ``keys`` once, so that scans and aggregates by these or finer keys need no shuffle of their own.

    Left as it is if a group of ``keys`` is too large for one task.
    """
    return df.repartition(*keys) if scale.hot(tuple(keys)) is None else df


def scan_in_windows(df: DataFrame, keys: Sequence[str], measures: dict[str, Measure], order: Sequence[str] = TIMELINE) -> DataFrame:
    return df.select("*", *(_in_window(m, keys, order).alias(name) for name, m in measures.items()))


def _in_window(measure: Measure, keys: Sequence[str], order: Sequence[str]) -> Column:
    group = Window.partitionBy(*keys)
    line = group.orderBy(*order)
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    match measure:
        case Before(value):
            return F.lag(value).over(line)
        case After(value):
            return F.lead(value).over(line)
        case Running(value):
            return F.sum(F.coalesce(value, F.lit(0))).over(so_far)
        case Latest(value):
            return F.last(value, ignorenulls=True).over(so_far)
        case First(value):
            return F.first(value).over(so_far)
        case Total(value):
            return F.sum(F.coalesce(value, F.lit(0))).over(group)


def scan_in_slices(
    df: DataFrame, keys: Sequence[str], measures: dict[str, Measure], order: Sequence[str], every: int
) -> DataFrame:
    """As ``scan_in_windows``, with about ``every`` rows of a group per task."""
    keys, order = list(keys), list(order)
    columns = df.columns
    sliced = materialise(_with_slices(df, keys, order, every))
    at = F.struct(*order)

    # Inside a slice the previous and next row are wrapped, so that "no row" differs from "row with NULL".
    inner = {
        name: _in_window(type(m)(F.struct(m.value.alias("v"))) if isinstance(m, Before | After) else m,
                         [*keys, "_slice"], order).alias(name)
        for name, m in measures.items()
    }
    local = sliced.select(*columns, "_slice", *inner.values())

    borders = sliced.groupBy(*keys, "_slice").agg(*(_summary(m, at).alias(f"_b_{name}") for name, m in measures.items()))
    group = Window.partitionBy(*keys)
    line = group.orderBy("_slice")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    carried = borders.select(
        *keys, "_slice", *(_carry(m, F.col(f"_b_{name}"), group, line, earlier).alias(f"_c_{name}")
                           for name, m in measures.items()))
    joined = local.join(carried, [*keys, "_slice"], "left")
    return joined.select(
        *columns, *(_combine(m, F.col(name), F.col(f"_c_{name}")).alias(name) for name, m in measures.items()))


def _with_slices(df: DataFrame, keys: list[str], order: list[str], every: int) -> DataFrame:
    """Add ``_slice``, an ordered (day, cut) pair.

    Cuts are the rows whose hash falls into one of ``every`` classes, so a slice holds about ``every`` rows however
    the rows crowd in time. There are about rows / ``every`` cuts, which the limit keeps few enough to broadcast.
    """
    at = F.struct(*order)
    dated = df.withColumn("_day", F.unix_date(F.to_date(F.col(order[0]))))
    cuts = (
        dated.filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
        .groupBy(*keys, "_day").agg(F.sort_array(F.collect_set(at)).alias("_cuts"))
    )
    found = dated.join(F.broadcast(cuts), [*keys, "_day"], "left")
    passed = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut <= at)), F.lit(0))
    return found.select(*df.columns, F.struct("_day", passed.alias("cut")).alias("_slice"))


def _summary(measure: Measure, at: Column) -> Column:
    match measure:
        case Before(value):
            return F.max_by(F.struct(value.alias("v")), at)
        case After(value):
            return F.min_by(F.struct(value.alias("v")), at)
        case Running(value) | Total(value):
            return F.sum(F.coalesce(value, F.lit(0)))
        case Latest(value):
            return F.max_by(value, F.when(value.isNotNull(), at))
        case First(value):
            return F.min_by(F.struct(value.alias("v")), at)


def _carry(measure: Measure, border: Column, group, line, earlier) -> Column:
    match measure:
        case Before():
            return F.lag(border).over(line)
        case After():
            return F.lead(border).over(line)
        case Running():
            return F.sum(border).over(earlier)
        case Latest():
            return F.last(border, ignorenulls=True).over(earlier)
        case First():
            return F.first(border).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        case Total():
            return F.sum(border).over(group)


def _combine(measure: Measure, local: Column, carried: Column) -> Column:
    match measure:
        case Before() | After():
            return F.coalesce(local, carried)["v"]
        case Running():
            return local + F.coalesce(carried, F.lit(0))
        case Latest():
            return F.coalesce(local, carried)
        case First():
            return carried["v"]
        case Total():
            return carried


def overlay(
    changes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    measures: dict[str, Measure],
    scale: Scale,
) -> DataFrame:
    """Scan changes and events on one time axis and keep the changes.

    Events (``keys``, ``timestamp``, ``revision_id`` and payload columns) of the same instant come first, so a
    change sees every event up to and including its own time. This replaces as-of and interval joins: one
    shuffle, linear in both inputs, no pairing of a key's changes with a key's events.
    """
    lanes = placed(changes, keys[:3], scale).withColumn("_lane", F.lit(1)).unionByName(
        events.withColumn("_lane", F.lit(0)), allowMissingColumns=True)
    scanned = ordered_scan(lanes, keys, measures, scale, ("timestamp", "_lane", "revision_id"))
    return scanned.filter(F.col("_lane") == 1).select(*changes.columns, *measures)
