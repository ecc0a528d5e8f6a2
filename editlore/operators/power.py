"""Yeo-Johnson power transform as a Spark ML estimator, fitted for all columns at once."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlore.session import materialise

STEP = 0.001  # powers are multiples of this
BOUND = 5.0  # and lie between its negative and itself
CUTS = 12  # parts into which a pass cuts the bracket of each column


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The transform with parameter ``lam``; the two logarithmic cases are its limits."""
    up, down = F.log1p(F.abs(x)), F.lit(2.0) - lam
    # (|x| + 1) ** p - 1 written as expm1, which keeps small values exact.
    positive = F.when(F.abs(lam) < 1e-9, up).otherwise(F.try_divide(F.expm1(lam * up), lam))
    negative = F.when(F.abs(down) < 1e-9, up).otherwise(F.try_divide(F.expm1(down * up), down))
    return F.when(x >= 0, positive).otherwise(-negative)


def _transformed(x: float, lam: float) -> float:
    """One number transformed on the driver."""
    up, power = math.log1p(abs(x)), lam if x >= 0 else 2.0 - lam
    return math.copysign(up if abs(power) < 1e-9 else math.expm1(power * up) / power, x)


class FittedPower(NamedTuple):
    rows: int  # values that are there
    power: float
    mean: float  # of the transformed values
    deviation: float
    likelihood: float | None  # logarithm, per row; None for a column without spread


def value_counts(dataset: DataFrame, names: list[str]) -> DataFrame:
    """(i, x, n): how often each value occurs in column ``names[i]``. NULL, NaN and infinite values are left out."""
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.col(name).cast("double").alias("x")) for i, name in enumerate(names)))
    return dataset.select(F.explode(cells).alias("c")).select("c.i", "c.x").filter(
        F.abs("x") < float("inf")).groupBy("i", "x").agg(F.count(F.lit(1)).alias("n"))


def fit_powers(dataset: DataFrame, names: list[str], step: float = STEP, bound: float = BOUND) -> list[FittedPower]:
    """The likeliest power of each column among the multiples of ``step`` up to ``bound``, and moments of the transformed column.

    Values of all columns are counted once. The logarithm of the likelihood has one peak, so a bracket around it shrinks
    safely: a pass over the counts weighs a dozen powers of every column by two sums each, and the neighbours of the best are the next
    bracket. About five passes, each with a row per column as its result; no row is multiplied by the powers tried.
    """
    counted = materialise(value_counts(dataset, names))
    total = F.sum("n")
    known = {row["i"]: row for row in counted.groupBy("i").agg(
        total.alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"),
        (F.sum(F.col("n") * F.col("x")) / total).alias("centre"),
        F.sum(F.col("n") * F.signum("x") * F.log1p(F.abs("x"))).alias("logs")).collect()}  # one row per column
    fitted = [FittedPower(0, 1.0, 0.0, 1.0, None)] * len(names)
    top = round(bound / step)
    brackets = {}
    for i, row in known.items():
        fitted[i] = FittedPower(row["rows"], 1.0, _transformed(row["centre"], 1.0), 1.0, None)
        if row["low"] < row["high"]:
            brackets[i] = (-top, top)
    while brackets:
        tried = {i: sorted({low + (high - low) * k // CUTS for k in range(CUTS + 1)}) for i, (low, high) in brackets.items()}
        weighed = _weighed(counted, {i: [j * step for j in places] for i, places in tried.items()}, known)
        for i, places in tried.items():
            best = max(range(len(places)), key=lambda k: weighed[i][k].likelihood)
            if math.isinf(weighed[i][best].likelihood):  # spread too small for doubles, as if there were none
                del brackets[i]
                continue
            fitted[i] = weighed[i][best]
            low = places[best - 1] + 1 if best else places[best]
            high = places[best + 1] - 1 if best + 1 < len(places) else places[best]
            if low == high or len(places) == places[-1] - places[0] + 1:
                # The rest of the bracket is this place alone, or every place of it was tried.
                del brackets[i]
            else:
                brackets[i] = (low, high)
    counted.unpersist()
    return fitted


def _weighed(counted: DataFrame, powers: dict[int, list[float]], known: dict) -> dict[int, list[FittedPower]]:
    """Moments and likelihood of each column for each of its powers, from one pass.

    Sums are taken from the transformed mean of the column on, so that squares lose little.
    """
    width = max(map(len, powers.values()))
    padded = {i: tried + tried[-1:] * (width - len(tried)) for i, tried in powers.items()}
    origin = {i: [_transformed(known[i]["centre"], p) for p in tried] for i, tried in padded.items()}
    places = sorted(powers)
    # Literal arrays by column place; a few dozen numbers for each.
    place = F.element_at(F.create_map(*(F.lit(v) for at, i in enumerate(places) for v in (i, at))), F.col("i"))
    rows = counted.filter(F.col("i").isin(places)).withColumn("_at", place)
    sums = []
    for k in range(width):
        power = F.lit([padded[i][k] for i in places])[F.col("_at")]
        away = yeo_johnson(F.col("x"), power) - F.lit([origin[i][k] for i in places])[F.col("_at")]
        sums += [F.sum(F.col("n") * away).alias(f"s{k}"), F.sum(F.col("n") * away * away).alias(f"q{k}")]
    found = {}
    for row in rows.groupBy("i").agg(*sums).collect():
        i, n = row["i"], known[row["i"]]["rows"]
        found[i] = []
        for k, power in enumerate(powers[i]):
            shift = row[f"s{k}"] / n
            variance, mean = row[f"q{k}"] / n - shift * shift, origin[i][k] + shift
            # Less spread than this is rounding noise of the mean.
            sound = (1e-12 * mean) ** 2 < variance < math.inf
            likelihood = (power - 1) * known[i]["logs"] / n - math.log(variance) / 2 if sound else -math.inf
            found[i].append(FittedPower(n, power, mean, math.sqrt(variance) if sound else 1.0, likelihood))
    return found


class _PowerParams(HasInputCols, HasOutputCols):
    lambdas = Param(Params._dummy(), "lambdas", "power per column", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean of each transformed column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "standard deviation of each transformed column", TypeConverters.toListFloat)


class PowerTransform(Estimator, _PowerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Choose each column's power by maximum likelihood (``fit_powers``), then standardise."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PowerTransformModel":
        fitted = fit_powers(dataset, self.getInputCols())
        return PowerTransformModel()._set(
            inputCols=self.getInputCols(), outputCols=self.getOutputCols(), lambdas=[f.power for f in fitted],
            means=[f.mean for f in fitted], deviations=[f.deviation for f in fitted])


class PowerTransformModel(Model, _PowerParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = zip(self.getInputCols(), self.getOutputCols(), *(self.getOrDefault(p) for p in (
            self.lambdas, self.means, self.deviations)))
        return dataset.withColumns({
            out: (yeo_johnson(F.col(name).cast("double"), F.lit(power)) - F.lit(mean)) / F.lit(deviation)
            for name, out, power, mean, deviation in parts})
