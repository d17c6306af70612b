"""Domain scalars as column expressions. Half-even rounding is ``bround``, half-away-from-zero is ``round``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOMINAL_AH = 1.1
STEP_SOC = 0.2
TOTAL_HOURS = 1 / 6


def dependent_rate(*rates: Column) -> Column:
    """The last rate of a protocol of equal SOC steps that must end after TOTAL_HOURS; null if no time is left."""
    used = sum((STEP_SOC / r for r in rates[1:]), STEP_SOC / rates[0])
    return F.try_divide(F.lit(STEP_SOC), F.lit(TOTAL_HOURS) - used)


def minutes_to_80(first: Column, switch: Column, second: Column) -> Column:
    """Minutes of a two-step protocol to 80 % that changes rate at ``switch`` percent."""
    return 60 / first * switch / 100 + 60 / second * (80 - switch) / 100


def switch_for_minutes(minutes: Column, first: Column, second: Column) -> Column:
    """The switch percent that makes minutes_to_80() come out at ``minutes``."""
    return F.try_divide(100 * (minutes - 48 / second), 60 / first - 60 / second)


def second_for_minutes(minutes: Column, first: Column, switch: Column) -> Column:
    """The second rate that makes minutes_to_80() come out at ``minutes``."""
    return F.try_divide(0.6 * (80 - switch), minutes - 0.6 * switch / first)


def rate_to_current(rate: Column, nominal: float = NOMINAL_AH) -> Column:
    return F.bround(rate * nominal, 4)


def current_to_rate(current: Column, nominal: float = NOMINAL_AH) -> Column:
    return current / nominal


def percent_to_charge(percent: Column, nominal: float = NOMINAL_AH) -> Column:
    return F.bround(percent / 100 * nominal, 4)


def sigma_of_bound(mean: Column, lower: Column, beta: float) -> Column:
    """Standard deviation behind a bound that lies ``beta`` of them below the mean."""
    return (mean - lower) / beta


def colour_bucket(x: Column, low: Column, high: Column, buckets: int = 64) -> Column:
    """1-based bucket between limits that are one wider on both sides."""
    return F.ceil((x - (low - 1)) / ((high + 1) - (low - 1)) * buckets)


def masked(x: Column, low: float, high: float) -> Column:
    """``x`` inside the limits, else null."""
    return F.when(x.between(low, high), x)


def jitter(x: Column, width: float = 0.1, seed: int = 0) -> Column:
    return x + (F.rand(seed) * 2 - 1) * width


def current_range(current: Column, limit: float) -> Column:
    """Name of the instrument range that a current needs: over ``limit`` amperes the high one."""
    return F.when(current > limit, "Range1").otherwise("Range2")


def floor_life(life: Column) -> Column:
    """Lives below zero become 1."""
    return F.when(life < 0, F.lit(1)).otherwise(life)


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0))
