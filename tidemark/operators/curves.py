"""Curves on fixed grids: plateaus, interpolation, averages, differences, protocol profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import chunked, scan
from .series import along, clean_discharge, slope, whole

#: The shared axis of resampled curves.
GRID_POINTS, GRID_HIGH, GRID_LOW = 1000, 3.5, 2.0


def grid(spark: SparkSession, points: int = GRID_POINTS, first: float = GRID_HIGH, last: float = GRID_LOW) -> DataFrame:
    """grid_idx from 0 and the evenly spaced v of each, from first to last; rising grids are those with first < last."""
    return spark.range(points).select(F.col("id").cast("int").alias("grid_idx"), (F.lit(first) + F.col("id") * ((last - first) / (points - 1))).alias("v"))


def own_grid(df: DataFrame, value: str, keys: list[str], points: int, rising: bool = False) -> DataFrame:
    """An even grid for each key between the extremes of its values: keys, grid_idx and v, from the greatest down or, ``rising``, from the least up."""
    ends = df.groupBy(*keys).agg(F.max(value).alias("__high"), F.min(value).alias("__low"))
    first, last = ("__low", "__high") if rising else ("__high", "__low")
    return ends.select(*keys, first, last, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_idx")).select(*keys, "grid_idx", (F.col(first) + F.col("grid_idx") * ((F.col(last) - F.col(first)) / (points - 1))).alias("v"))


def plateau_level(value: str, keys: list[str]) -> Column:
    """Most frequent rounded value of the key, the smallest of equally frequent ones; halves round away from zero."""
    return F.mode(F.round(value), True).over(whole(keys))


def plateau(df: DataFrame, current: str, level: Column, x: str, keys: list[str], order: list[str], tolerance: float = 0.05, ignored: int = 2) -> DataFrame:
    """Rows within ``tolerance`` of ``level`` up to the first minimum of ``x``, for which the last two rows don't count."""
    near = df.withColumn("__level", level).filter(F.abs(F.col(current) - F.col("__level")) < tolerance).drop("__level")
    numbered = near.withColumn("__n", F.row_number().over(along(keys, order))).withColumn("__of", F.count("*").over(whole(keys)))
    stop = F.min_by("__n", F.when(F.col("__n") <= F.col("__of") - ignored, F.struct(F.col(x).alias("x"), F.col("__n").alias("n")))).over(whole(keys))
    return numbered.withColumn("__stop", stop).filter(F.col("__n") <= F.col("__stop")).drop("__n", "__of", "__stop")


def charge_from_minutes(minutes: str, current: Column, keys: list[str], order: list[str], nominal: float = 1.1) -> Column:
    """Charge drawn since the first row at a constant rate; minutes are elapsed time."""
    start = F.first(minutes).over(along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return -(F.col(minutes) - start) / 60 * current * nominal


def first_of_each(df: DataFrame, x: str, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each value of ``x`` in its key."""
    return df.withColumn("__n", F.row_number().over(along([*keys, x], order))).filter("__n = 1").drop("__n")


def with_anchors(df: DataFrame, x: str, y: str, keys: list[str], order: str) -> DataFrame:
    """Two rows before each key's own: (3.6, 0), and its first point moved by (+1e-4, -1e-4)."""
    heads = df.groupBy(*keys).agg(F.min_by(x, order).alias("__x"))
    anchors = heads.select(*keys, F.explode(F.array(
        F.struct(F.lit(-1).alias("o"), F.lit(3.6).alias("x"), F.lit(0.0).alias("y")),
        F.struct(F.lit(0).alias("o"), (F.col("__x") + 1e-4).alias("x"), F.lit(-1e-4).alias("y")),
    )).alias("a")).select(*keys, F.col("a.o").cast("long").alias(order), F.col("a.x").alias(x), F.col("a.y").alias(y))
    return anchors.unionByName(df.select(*keys, F.col(order).cast("long").alias(order), x, y))


def interpolate(points: DataFrame, targets: DataFrame, x: str, y: str, keys: list[str], rows: int | None = None) -> DataFrame:
    """``targets`` with ``y`` interpolated on the straight line between the two nearest points of the key; null outside.

    ``targets`` has the columns of ``keys``, ``x`` and any others. Points must have distinct ``x``
    in a key. Points and targets are merged in one ordered scan, so that no range join is needed, and a key of any length is scanned in ranges.
    """
    rest = [c for c in targets.columns if c not in (*keys, x)]
    own = points.select(*keys, F.col(x).cast("double").alias(x), F.col(y).alias("__y"), F.lit(0).alias("__target"), *(F.lit(None).cast(dict(targets.dtypes)[c]).alias(c) for c in rest))
    asked = targets.select(*keys, F.col(x).cast("double").alias(x), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__target"), *rest)
    point = F.when(F.col("__target") == 0, F.struct(F.col(x).alias("x"), F.col("__y").alias("y")))
    order = [x, "__target"]
    # targets of one place are equal in order, and all find the same points
    marked = scan(chunked(own.unionByName(asked), keys, order, rows), keys, order, upto={"__a": point}, onward={"__b": point})
    on_line = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * F.try_divide(F.col(x) - F.col("__a.x"), F.col("__b.x") - F.col("__a.x"))
    value = F.when(F.col("__a.x") == F.col(x), F.col("__a.y")).otherwise(on_line)
    return marked.filter("__target = 1").select(*keys, x, *rest, value.alias(y))


def shrinking_average(df: DataFrame, value: str, keys: list[str], order: list[str], half: int = 4, out: str = "smooth") -> DataFrame:
    """Centred mean over 2 * half + 1 rows that shrinks evenly towards both ends of the key.

    The window of a row reaches as far as the nearer end allows; the sums of all reaches share one
    sort, and each row picks its own.
    """
    w = along(keys, order)
    n = F.row_number().over(w)
    numbered = df.withColumn("__n", n).withColumn("__of", F.count("*").over(whole(keys)))
    reach = F.least(F.lit(half), F.col("__n") - 1, F.col("__of") - F.col("__n"))
    sums = [F.sum(value).over(w.rowsBetween(-k, k)) for k in range(half + 1)]
    picked = F.coalesce(*(F.when(F.col("__reach") == k, s) for k, s in enumerate(sums)))
    return numbered.withColumn("__reach", reach).withColumn(out, picked / (2 * F.col("__reach") + 1)).drop("__n", "__of", "__reach")


def discharge_slope_curve(samples: DataFrame, keys: list[str], order: str, v: str, q: str, points: int = GRID_POINTS, half: int = 4) -> DataFrame:
    """The cleaned slope dq/dv of every key on the fixed grid, smoothed: keys, grid_idx, v, dqdv.

    Slopes are cleaned in order, two anchor points go before the first, the first of equal
    voltages counts, and what is interpolated on the grid is averaged; null outside the curve.
    """
    sloped = samples.withColumn("__s", slope(q, v, keys, [order]))
    cleaned = sloped.withColumn("__c", clean_discharge("__s", v, keys, [order]))
    numbered = cleaned.select(*keys, F.row_number().over(along(keys, [order])).alias("__o"), F.col(v).cast("double").alias("v"), F.col("__c").alias("dqdv"))
    distinct = first_of_each(with_anchors(numbered, "v", "dqdv", keys, "__o"), "v", keys, ["__o"]).drop("__o")
    targets = samples.select(*keys).distinct().crossJoin(F.broadcast(grid(samples.sparkSession, points)))  # the grid has a fixed size
    on_grid = interpolate(distinct, targets, "v", "dqdv", keys)
    return shrinking_average(on_grid, "dqdv", keys, ["grid_idx"], half, "smooth").select(*keys, "grid_idx", "v", F.col("smooth").alias("dqdv"))


def cycle_difference(df: DataFrame, cycle: str, late: int, early: int, value: str, keys: list[str], out: str = "delta") -> DataFrame:
    """Value of the late cycle less that of the early one for every key; keys without both have null."""
    both = df.filter(F.col(cycle).isin(late, early)).groupBy(*keys)
    return both.agg((F.max(F.when(F.col(cycle) == late, F.col(value))) - F.max(F.when(F.col(cycle) == early, F.col(value)))).alias(out))


def step_profile(df: DataFrame, rates: list[str], width: float = 20.0) -> DataFrame:
    """A row for each step of a protocol: its SOC range in percent and its rate."""
    steps = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(k * width).alias("soc_low"), F.lit((k + 1) * width).alias("soc_high"), F.col(c).alias("rate")) for k, c in enumerate(rates)))
    return df.select(*df.columns, F.inline(steps))


def voltage_tail(df: DataFrame, begin: str, keys: list[str], points: int = 100, start: float = 89.0, end: float = 100.0, decay: float = 0.5) -> DataFrame:
    """The constant-voltage end of a charge for each row: its current over SOC falls from ``begin``."""
    soc = F.lit(start) + F.col("grid_idx") * ((end - start) / (points - 1))
    steps = df.select(*keys, begin, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_idx"))
    return steps.select(*keys, "grid_idx", soc.alias("soc"), (F.col(begin) * F.exp(-decay * (soc - start))).alias("current"))


def lattice(spark: SparkSession, steps: int = 30) -> DataFrame:
    """All points of a cubic lattice over [0, 1] in three dimensions."""
    axis = [F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: k / (steps - 1))).alias(c) for c in ("r", "g", "b")]
    return spark.range(1).select(axis[0]).select("r", axis[1]).select("r", "g", axis[2])


def lattice_cells(df: DataFrame, axes: list[str], low: float, high: float, steps: int = 30) -> DataFrame:
    """Rows at each point of a cubic lattice over [low, high] that some row is nearest to; what lies outside goes to the border."""
    at = [F.least(F.greatest(F.round((F.col(c) - low) / (high - low) * (steps - 1)), F.lit(0.0)), F.lit(steps - 1.0)) / (steps - 1) for c in axes]
    return df.select(*(x.alias(c) for x, c in zip(at, ("r", "g", "b")))).groupBy("r", "g", "b").agg(F.count("*").alias("n"))


def farthest_points(vectors: DataFrame, id_: str, vector: str, start: np.ndarray, picks: int) -> DataFrame:
    """Greedy choice of ``picks`` ids, each the farthest from ``start`` and all chosen before; ties take the smallest id.

    The table is read once. Every row keeps its distance to the nearest chosen point, which each pick lowers.
    """
    spark = vectors.sparkSession

    def square(point: list[float]) -> Column:
        return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, point)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    chosen: list[tuple[int, int, float]] = []
    left = vectors.select(id_, vector, square([float(v) for v in start]).alias("d")).persist()
    for k in range(picks):
        top = left.orderBy(F.desc("d"), id_).first()
        if top is None:
            break
        chosen.append((k, top[id_], float(top["d"])))
        if k < picks - 1:
            nearer = left.filter(F.col(id_) != top[id_]).select(id_, vector, F.least("d", square([float(v) for v in top[vector]])).alias("d")).persist()
            nearer.count()
            left.unpersist()
            left = nearer
    left.unpersist()
    return spark.createDataFrame(chosen, f"pick int, {id_} long, distance double")
