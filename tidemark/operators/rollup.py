"""From samples to cycles, from cycles to units, from units to policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import along, whole

#: Capacity under which a unit counts as worn out, and the tolerance of near misses.
LIFE_LIMIT, NEAR_LIMIT = 0.88, 0.01


def cycle_summary(samples: DataFrame, keys: list[str], order: list[str], charge: str, discharge: str, temperature: str, resistance: str) -> DataFrame:
    """Per cycle: greatest charges, temperature range and mean, and the resistance of the last row."""
    return samples.groupBy(*keys).agg(
        F.max(charge).alias("qcharge"), F.max(discharge).alias("qdischarge"),
        F.max(temperature).alias("tmax"), F.min(temperature).alias("tmin"), F.avg(temperature).alias("tavg"),
        F.max_by(resistance, F.struct(*order)).alias("ir"),
    )


def life_by_first(capacity: str, k: str, limit: float = LIFE_LIMIT) -> Column:
    """Aggregate: first cycle under the limit if the last is under it, else the last cycle."""
    return F.when(F.max_by(capacity, k) < limit, F.min(F.when(F.col(capacity) < limit, F.col(k)))).otherwise(F.max(k))


def life_by_confirmed(cycles: DataFrame, unit: str, k: str, capacity: str, raw_cycle: str, near_units: Column, limit: float = LIFE_LIMIT, near: float = NEAR_LIMIT) -> DataFrame:
    """Life of each unit: the first cycle under the limit that is followed by a lower one, if the last cycle is under it.

    A unit whose last cycle is just above the limit gets its last raw cycle plus 1 if ``near_units``
    holds for it; all others have null. A drop in the last cycle has no successor and confirms nothing.
    """
    marked = cycles.withColumn("__next", F.lead(capacity).over(along([unit], [k]))).withColumn("__near", near_units)
    last = F.max_by(capacity, k)
    return marked.groupBy(unit).agg(
        F.when(last < limit, F.min(F.when((F.col(capacity) < limit) & (F.col("__next") < F.col(capacity)), F.col(k))))
        .when(F.bool_or("__near") & (last - limit < near), F.max(raw_cycle) + 1).alias("life")
    )


def wear_rates(cycles: DataFrame, unit: str, k: str, capacity: str, head: int = 100, tail: int = 101, per: int = 100) -> DataFrame:
    """Fall of capacity a cycle: overall, over the first ``head`` and over the last ``tail`` cycles; short units have the overall rate in all."""
    marked = cycles.withColumn("__n", F.row_number().over(along([unit], [k]))).withColumn("__of", F.count("*").over(whole([unit])))
    fall = lambda inside: F.max(F.when(inside, F.col(capacity))) - F.min(F.when(inside, F.col(capacity)))
    overall = (F.max(capacity) - F.min(capacity)) / F.count("*")
    long = F.max("__of") > head
    return marked.groupBy(unit).agg(
        overall.alias("rate"), F.when(long, fall(F.col("__n") <= head) / per).otherwise(overall).alias("initial_rate"),
        F.when(long, fall(F.col("__n") > F.col("__of") - tail) / per).otherwise(overall).alias("final_rate"),
    )


def early_mean(value: str, k: str, cycles: int = 100) -> Column:
    """Aggregate: mean over the first cycles."""
    return F.avg(F.when(F.col(k) <= cycles, F.col(value)))


def policy_rollup(units: DataFrame, policy: str, position: str, fixed: list[str], means: list[str]) -> DataFrame:
    """Per policy: number of units, the fixed columns of its first unit, means of the others; in order of policies."""
    return units.groupBy(policy).agg(
        F.count("*").alias("n_units"), *(F.min_by(c, position).alias(c) for c in fixed), *(F.avg(c).alias(f"mean_{c}") for c in means)
    ).orderBy(policy)


def complete_units(cycles: DataFrame, unit: str, least: int = 100) -> DataFrame:
    """Number of cycles of each unit and whether they are enough to be scored."""
    return cycles.groupBy(unit).agg(F.count("*").alias("n_cycles"), (F.count("*") >= least).alias("complete"))


def shared_cycles(cycles: DataFrame, unit: str, cap: int = 1000) -> DataFrame:
    """The number of cycles that every unit has, ``cap`` at most."""
    return cycles.groupBy(unit).agg(F.count("*").alias("n")).agg(F.least(F.min("n"), F.lit(cap)).alias("shared"))
