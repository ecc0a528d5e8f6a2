"""Exact interpolated quantiles per group, also for groups too large for one task.

Groups with few values have them in one aggregation buffer. For all others the distinct values of every measure are counted once, and the wanted ranks are
selected by refinement: the range of a group's values is cut into ``COUNTERS`` parts, a counter per part tells which parts hold a wanted
rank, and only their values are looked at again, cut anew between their own least and greatest value, until a part has few distinct values. A pass
separates at least the least from the greatest value, and usually divides what is left by the number of counters. No task holds more than one part's
counters, or the values of a part that is small enough.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editlore.session import Scale, hot_groups, materialise

COUNTERS = 1_024


def quantile_columns(
    df: DataFrame,
    keys: Sequence[str],
    measures: dict[str, Column],
    fractions: Sequence[float],
    scale: Scale,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per group: ``extra`` aggregates, and one array column per measure with the quantiles at ``fractions``.

    NULLs do not take part; a measure without values gives NULL. The definition is the continuous one:
    linear interpolation between the two neighbouring ranks. NaN is greater than all numbers.
    """
    scale = scale.shared_by(len(measures))  # the buffers of all measures are in one task
    keys = list(keys)
    names = list(extra)

    def in_buffers(part: DataFrame) -> DataFrame:
        wanted = F.array(*(F.lit(float(f)) for f in fractions))
        return part.groupBy(*keys).agg(*names, *(F.percentile(value, wanted).alias(name) for name, value in measures.items()))

    if scale.fits:
        return in_buffers(df)
    level = scale.level(keys)
    df = df if level else materialise(df)
    hot = scale.hot(level) if level else hot_groups(df, keys, scale.limit)
    if hot is None:
        return in_buffers(df)
    on = list(level or keys)
    warm = materialise(df.join(F.broadcast(hot), on, "left_semi"))
    totals = warm.groupBy(*keys).agg(*(names or [F.count(F.lit(1)).alias("_n")]))
    found = totals.select(*(c for c in totals.columns if c != "_n")).join(_selected(warm, keys, measures, fractions, max(scale.limit, COUNTERS)), keys, "left")
    return in_buffers(df.join(F.broadcast(hot), on, "left_anti")).unionByName(found)


def _part(x: str, low: str, high: str) -> Column:
    """Which of the parts between the least and the greatest value has ``x``; those two are in parts of their own, so that each pass separates them.

    Parts are equally wide in magnitude (the exponent, with the sign) until the ends are within a factor of two, and in value from then on, so that a
    few passes reach any two doubles.
    """
    def magnitude(v: str) -> str:
        return f"case when {v} > 0 then log2({v}) + 1075 when {v} < 0 then -1075 - log2(-{v}) else 0d end"

    def share(f: Callable[[str], str]) -> str:
        return f"({f(x)} - {f(low)}) / ({f(high)} - {f(low)})"

    wide = f"({magnitude(high)}) - ({magnitude(low)}) > 1"
    place = f"case when {wide} then {share(lambda v: f'({magnitude(v)})')} else {share(str)} end"
    return F.expr(f"case when {x} <= {low} then 0 when {x} >= {high} then {COUNTERS - 1} else 1 + least({COUNTERS - 3}, cast(floor(nanvl({place}, 0.5d) * {COUNTERS - 2}) as int)) end")


def _selected(df: DataFrame, keys: list[str], measures: dict[str, Column], fractions: Sequence[float], few: int) -> DataFrame:
    """The quantiles of groups of any size; parts of at most ``few`` distinct values are sorted."""
    names = list(measures)
    group = [*keys, "_m"]
    stacked = df.select(*keys, F.posexplode(F.array(*(measures[n].cast("double") for n in names))).alias("_m", "_x"))
    values = materialise(stacked.filter(F.col("_x").isNotNull()).groupBy(*group, "_x").agg(F.count(F.lit(1)).alias("_c")))

    # A part is known by its group and its least value.
    whole = values.groupBy(*group).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_distinct"))
    parts = materialise(whole.withColumn("_start", F.lit(0).cast("long")).withColumn("_all", F.col("_n")))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(*(f(F.lit(float(q)) * (F.col("_all") - 1)) for f in (F.floor, F.ceil))) for q in fractions))))
    wanted = F.exists(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_n")))
    inside = values.join(parts.select(*group, "_low", "_high"), group)
    small = inside.join(parts.filter(F.col("_distinct") <= few).select(*group, "_low", "_start", "_all"), [*group, "_low"])
    while True:
        large = materialise(parts.filter(F.col("_distinct") > few))
        if large.isEmpty():
            break
        cut = materialise(inside.join(large.select(*group, "_low", "_start", "_all"), [*group, "_low"]).withColumn("_part", _part("_x", "_low", "_high")))
        counters = cut.groupBy(*group, "_low", "_part").agg(
            F.min("_x").alias("_least"), F.max("_x").alias("_high"), F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_distinct"),
            F.first("_start").alias("_before"), F.first("_all").alias("_all"))
        earlier = Window.partitionBy(*group, "_low").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        placed = counters.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        next_parts = materialise(placed.filter(wanted).drop("_before"))
        inside = cut.select(*group, "_low", "_part", "_x", "_c").join(
            next_parts.select(*group, "_low", "_part", "_least", "_high"), [*group, "_low", "_part"]).select(*group, F.col("_least").alias("_low"), "_high", "_x", "_c")
        parts = next_parts.select(*group, F.col("_least").alias("_low"), "_high", "_n", "_distinct", "_start", "_all")
        small = small.unionByName(inside.join(parts.filter(F.col("_distinct") <= few).select(*group, "_low", "_start", "_all"), [*group, "_low"]))

    line = Window.partitionBy(*group, "_low").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = small.withColumn("_to", F.col("_start") + F.sum("_c").over(line)).withColumn("_from", F.col("_to") - F.col("_c"))

    def value_at(side, q: float) -> Column:
        rank = side(F.lit(float(q)) * (F.col("_all") - 1))
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_x")))

    points = ranked.groupBy(*group).agg(F.first("_all").alias("_all"), *(value_at(f, q).alias(f"_{side}{i}") for i, q in enumerate(fractions) for side, f in (("low", F.floor), ("high", F.ceil))))

    def between(i: int, q: float) -> Column:
        rank = F.lit(float(q)) * (F.col("_all") - 1)
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank)))

    arrays = points.select(*group, F.array(*(between(i, q) for i, q in enumerate(fractions))).alias("_v"))
    return arrays.groupBy(*keys).agg(*(F.max(F.when(F.col("_m") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)))
