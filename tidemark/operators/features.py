"""Model features of units from their cycles and curves, and scoring with intervals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .curves import cycle_difference
from .series import along


def curve_moments(curves: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Least value, mean, sample variance, population skewness, sums of sizes and squares, and first value of each curve.

    Moments are sums of powers of the deviations from the mean, along the positions: where they are nothing but rounding, as the
    skewness of two points is, they are that of their formula. One shuffle serves the mean and the sums.
    """
    mean = F.avg(value).over(along(keys, [position]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c, n = F.col("__c"), F.count(value)
    square, cube = F.sum(c * c), F.sum(c * c * c)
    return curves.withColumn("__c", F.col(value) - mean).groupBy(*keys).agg(
        F.min(value).alias("least"), F.avg(value).alias("mean"), F.when(n > 1, square / (n - 1)).alias("variance"),
        F.when(square > 0, (cube / n) / F.pow(square / n, F.lit(1.5))).alias("skew"),
        F.sum(F.abs(value)).alias("sum_size"), F.sum(F.col(value) * F.col(value)).alias("sum_square"), F.min_by(value, position).alias("first"),
    )


def line_fit(df: DataFrame, keys: list[str], x: str, y: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Least-squares slope and intercept of y over x in [low, high]; null with fewer than two different x."""
    own = df if low is None else df.filter(F.col(x).between(low, high))
    return own.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def trapezoid(df: DataFrame, keys: list[str], position: str, x: str, y: str, out: str = "area") -> DataFrame:
    """Integral of y over x along the positions of each key."""
    w = along(keys, [position])
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("__part", part).groupBy(*keys).agg(F.coalesce(F.sum("__part"), F.lit(0.0)).alias(out))


def log_size(x: Column) -> Column:
    """log10 of the absolute value; null at 0."""
    return F.when(x != 0, F.log10(F.abs(x)))


def unit_features(summary: DataFrame, curves: DataFrame, unit: str, k: str, capacity: str, grid_idx: str, v: str, q: str, early: int = 10, tail: int = 91, cutoff: int = 100) -> DataFrame:
    """f1 .. f15 of every unit with ``cutoff`` cycles or more.

    From the capacities of cycles 2..cutoff: value at 2, rise to the greatest, value at cutoff, line through
    all and through tail..cutoff. From the difference of the curves of cutoff and early: log10 of the
    sizes of its minimum, mean, variance, skewness and first point, of the sums of sizes and squares,
    and of the difference of the areas. ``curves`` has columns unit, k, grid_idx, v and q.
    """
    own = summary.filter(F.col(k) <= cutoff)
    at = lambda c: F.max(F.when(F.col(k) == c, F.col(capacity)))
    inside = lambda x, low: F.when(F.col(k).between(low, cutoff), F.col(x))
    capacity_part = own.groupBy(unit).agg(
        at(2).alias("f1"), (F.max(capacity) - at(2)).alias("f2"), at(cutoff).alias("f3"),
        F.regr_slope(inside(capacity, 2), inside(k, 2)).alias("f4"), F.regr_intercept(inside(capacity, 2), inside(k, 2)).alias("f5"),
        F.regr_slope(inside(capacity, tail), inside(k, tail)).alias("f6"), F.regr_intercept(inside(capacity, tail), inside(k, tail)).alias("f7"),
    ).filter(F.col("f3").isNotNull())
    pair = curves.filter(F.col(k).isin(early, cutoff))
    delta = cycle_difference(pair, k, cutoff, early, q, [unit, grid_idx], "d")
    shape = curve_moments(delta, [unit], grid_idx, "d")
    areas = trapezoid(pair, [unit, k], grid_idx, q, v).groupBy(unit).agg((F.max(F.when(F.col(k) == early, F.col("area"))) - F.max(F.when(F.col(k) == cutoff, F.col("area")))).alias("fall"))
    names = ("least", "mean", "variance", "skew", "first", "sum_size", "sum_square")
    logs = [log_size(F.col(c)).alias(f"f{i}") for i, c in enumerate(names, 8)]
    return capacity_part.join(shape, unit, "left").join(areas, unit, "left").select(unit, *(f"f{i}" for i in range(1, 8)), *logs, F.when(F.col("fall") > 0, F.log10("fall")).alias("f15"))


def score(features: DataFrame, unit: str, columns: list[str], model: dict, widest: float = 2000.0) -> DataFrame:
    """Prediction, bounds, and whether the interval is too wide to use, for every unit.

    ``model`` holds, over the chosen columns, mu, sigma and b1, and y_mu, t, mse and the inverse design matrix over
    those and 1. The linear predictor is in log10. A wide interval keeps its bounds, and the prediction becomes -1 in
    ``shown``. Null features give null predictions. The model is a few numbers; all of it becomes literals.
    """
    z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(columns, model["mu"], model["sigma"])]
    lit = lambda values: F.array(*(F.lit(float(v)) for v in values))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    with_z = features.withColumn("__z", F.array(*z)).withColumn("__z1", F.concat("__z", F.array(F.lit(1.0))))
    inverse = np.asarray(model["inverse"], dtype=float)
    through = F.array(*(dot(F.col("__z1"), lit(row)) for row in inverse.T))
    half = float(model["t"]) * F.sqrt(float(model["mse"]) * (1 + dot(through, F.col("__z1"))))
    centre = dot(F.col("__z"), lit(model["b1"])) + float(model["y_mu"])
    scored = with_z.withColumn("__centre", centre).withColumn("__half", half)
    ten = F.lit(10.0)
    return scored.select(
        unit, F.pow(ten, F.col("__centre")).alias("prediction"), F.pow(ten, F.col("__centre") - F.col("__half")).alias("low"), F.pow(ten, F.col("__centre") + F.col("__half")).alias("high")
    ).withColumn("too_wide", F.col("high") - F.col("low") > widest).withColumn("shown", F.when(F.col("too_wide"), -1.0).otherwise(F.col("prediction")))


def export(scored: DataFrame, by_rates: bool) -> DataFrame:
    """Scored cells as a result table: numbers rounded, halves away from zero, in one of two layouts.

    ``scored`` has policy (readable), shown, low, high, life, channel and barcode. Policies of four rates give a column a rate and
    the policy's numbers first; others keep the policy's name, last, and are meant to be read in its order.
    """
    numbers = [F.round(F.col(c)).alias(name) for c, name in (("shown", "Prediction"), ("low", "CI_Lo"), ("high", "CI_Hi"))]
    about = [F.col("channel").alias("Channel"), text.barcode_number(F.col("barcode")).alias("Barcode"), F.col("life").alias("Lifetime")]
    if by_rates:
        rates = [text.step_part(F.col("policy"), k).alias(f"C{k}") for k in range(1, 5)]
        return scored.select(*rates, *numbers, about[2], about[0], about[1])
    return scored.select(*about, *numbers, F.col("policy").alias("Policy"))


def for_all_units(units: DataFrame, scored: DataFrame, unit: str) -> DataFrame:
    """A row for every unit; those that weren't scored have null."""
    return units.select(unit).distinct().join(scored, unit, "left")
