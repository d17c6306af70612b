"""Ordered series per key: repair, trimming, cleaning, crossings. Missing values are null, order is explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ordered import chunked, scan


def along(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: list[str], order: list[str]) -> WindowSpec:
    return along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def inner(df: DataFrame, unit: str = "unit", cycle: str = "cycle", number: str = "k") -> DataFrame:
    """A table of one row a cycle without the first and the last of each unit, the others numbered from 1 in ``number``."""
    first, last = F.min(cycle).over(whole([unit])), F.max(cycle).over(whole([unit]))
    kept = df.withColumn("__low", first).withColumn("__high", last).filter((F.col(cycle) > F.col("__low")) & (F.col(cycle) < F.col("__high"))).drop("__low", "__high")
    return kept.withColumn(number, F.row_number().over(along([unit], [cycle])))


def elapsed_minutes(seconds: str, keys: list[str], order: list[str]) -> Column:
    return (F.col(seconds) - F.first(seconds).over(so_far(keys, order))) / 60


def from_first(value: str, keys: list[str], order: list[str]) -> Column:
    """Difference to the first value of the key."""
    return F.col(value) - F.first(value).over(so_far(keys, order))


def share_of_first(value: str, keys: list[str], order: list[str]) -> Column:
    return F.try_divide(F.col(value), F.first(value).over(so_far(keys, order)))


def repair_clock(df: DataFrame, time: str, keys: list[str], order: list[str], wrong: Column, only_if: Column | None = None, rows: int | None = None) -> DataFrame:
    """Shift ``time`` from the first ``wrong`` row of each key on, so that that row gets its predecessor's time.

    ``only_if``, over the key's last time in ``__last``, must hold for a repair. A key whose first row is
    wrong has no predecessor and stays as it is. A key is scanned in ranges, so that one of any length is many tasks' work.
    """
    at = F.struct(*order)
    first = scan(
        chunked(df.withColumn("__wrong", F.coalesce(wrong, F.lit(False))), keys, order, rows), keys, order, before={"__before": F.col(time)},
        total={"__start": (F.when(F.col("__wrong"), at), F.min), "__tail": (F.struct(at.alias("at"), F.col(time).alias("t")), F.max)},
    )
    step = F.when(at == F.col("__start"), F.col("__before") - F.col(time))
    moved = scan(first, keys, order, upto={"__shift": step})
    fixed = F.when(at >= F.col("__start"), F.col(time) + F.coalesce("__shift", F.lit(0.0))).otherwise(F.col(time))
    if only_if is not None:
        moved = moved.withColumn("__last", F.col("__tail.t"))
        fixed = F.when(only_if, fixed).otherwise(F.col(time))
    return moved.withColumn(time, fixed).select(*df.columns)


def repair_if_negative_end(df: DataFrame, time: str, keys: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """Repair the clock of keys whose last time is negative."""
    return repair_clock(df, time, keys, order, F.col(time) < 0, F.col("__last") < 0, rows)


def repair_clock_twice(df: DataFrame, time: str, keys: list[str], order: list[str], most: float = 100.0) -> DataFrame:
    """Repair from the first negative time on, then from the first time over ``most`` on, in keys that have one."""
    return repair_clock(repair_clock(df, time, keys, order, F.col(time) < 0), time, keys, order, F.col(time) > most)


def before_crossing(df: DataFrame, value: str, keys: list[str], order: list[str], limit: float) -> DataFrame:
    """Rows before the first under ``limit``; all rows of a key that has none."""
    under = F.max(F.when(F.col(value) < limit, 1).otherwise(0)).over(so_far(keys, order))
    return df.withColumn("__under", under).filter("__under = 0").drop("__under")


def span(df: DataFrame, inside: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows from the first to the last that is ``inside``, whatever lies between; without any, the first two rows of the key."""
    numbered = df.withColumn("__n", F.row_number().over(along(keys, order))).withColumn("__in", inside)
    low = F.coalesce(F.min(F.when(F.col("__in"), F.col("__n"))).over(whole(keys)), F.lit(1))
    high = F.coalesce(F.max(F.when(F.col("__in"), F.col("__n"))).over(whole(keys)), F.lit(2))
    return numbered.withColumn("__low", low).withColumn("__high", high).filter(F.col("__n").between(F.col("__low"), F.col("__high"))).drop("__n", "__in", "__low", "__high")


def from_first_match(df: DataFrame, match: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows from the first that matches on; none if no row does."""
    return df.withColumn("__on", F.max(F.when(match, 1).otherwise(0)).over(so_far(keys, order))).filter("__on = 1").drop("__on")


def slope(y: str, x: str, keys: list[str], order: list[str]) -> Column:
    """First differences dy/dx: 0 in the first row; where x stands still, infinite with the sign of dy, or null if y does too."""
    w = along(keys, order)
    dy, dx = F.col(y) - F.lag(y).over(w), F.col(x) - F.lag(x).over(w)
    still = F.when(dy > 0, float("inf")).when(dy < 0, float("-inf"))
    return F.when(F.lag(F.lit(1)).over(w).isNull(), F.lit(0.0)).when(dx != 0, F.try_divide(dy, dx)).otherwise(still)


def discharge_rules(s: Column, x: Column, first: Column, clip: float = 50.0, low_cut: float = 2.0) -> Column:
    """What the rules for a discharge slope make of a row, null where the previous result stays.

    The rules in order: null becomes 0, |slope| >= clip becomes 0, a positive slope and a slope of
    0 take the previous result, x <= low_cut becomes 0. The first row is 0. What is carried is
    always the last row that a rule resolved, so that it is a last non-null value.
    """
    zero = F.lit(0.0)
    return F.when(first, zero).when(s.isNull() | (F.abs(s) >= clip), zero).when(s >= 0, F.lit(None).cast("double")).when(x <= low_cut, zero).otherwise(s)


def charge_rules(s: Column, x: Column, first: Column, top: Column, clip: float = 25.0, low_cut: float = 2.5, top_margin: float = 0.001) -> Column:
    """The same for a charge slope: null 0, negative carried, outliers 0, near the top of x 0, zero carried, x <= low_cut 0."""
    zero, carried = F.lit(0.0), F.lit(None).cast("double")
    return F.when(first | s.isNull(), zero).when(s < 0, carried).when((s >= clip) | (x >= top - top_margin), zero).when(s == 0, carried).when(x <= low_cut, zero).otherwise(s)


def _is_first(keys: list[str], order: list[str]) -> Column:
    return F.lag(F.lit(1)).over(along(keys, order)).isNull()


def clean_discharge(raw: str, x: str, keys: list[str], order: list[str], clip: float = 50.0, low_cut: float = 2.0) -> Column:
    """Discharge slope with outliers set to 0 and positive or zero slopes replaced by the last cleaned one, for keys of bounded length."""
    ruled = discharge_rules(F.col(raw), F.col(x), _is_first(keys, order), clip, low_cut)
    return F.coalesce(F.last(ruled, ignorenulls=True).over(so_far(keys, order)), F.lit(0.0))


def clean_charge(raw: str, x: str, keys: list[str], order: list[str], clip: float = 25.0, low_cut: float = 2.5, top_margin: float = 0.001) -> Column:
    """Charge slope, cleaned, for keys of bounded length."""
    ruled = charge_rules(F.col(raw), F.col(x), _is_first(keys, order), F.max(x).over(whole(keys)), clip, low_cut, top_margin)
    return F.coalesce(F.last(ruled, ignorenulls=True).over(so_far(keys, order)), F.lit(0.0))


def cleaned_slopes(df: DataFrame, y: str, x: str, keys: list[str], order: list[str], rows: int | None = None, discharge: str = "discharge", charge: str = "charge") -> DataFrame:
    """``df`` with the slope dy/dx of each row cleaned as a discharge and as a charge, for keys of any length, which are scanned in ranges."""
    names = {"__y": F.col(y), "__x": F.col(x), "__any": F.lit(1)}
    one = scan(chunked(df, keys, order, rows), keys, order, before=names, total={"__top": (F.col(x), F.max)})
    dy, dx = F.col(y) - F.col("__y"), F.col(x) - F.col("__x")
    first = F.col("__any").isNull()
    still = F.when(dy > 0, float("inf")).when(dy < 0, float("-inf"))
    sloped = one.withColumn("__slope", F.when(first, F.lit(0.0)).when(dx != 0, F.try_divide(dy, dx)).otherwise(still))
    s = F.col("__slope")
    two = scan(sloped, keys, order, upto={discharge: discharge_rules(s, F.col(x), first), charge: charge_rules(s, F.col(x), first, F.col("__top"))})
    return two.select(*(c for c in df.columns if c not in (discharge, charge)), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in (discharge, charge)))


def crossing_time(df: DataFrame, unit: str, cycle: str, order: list[str], seconds: str, reached: Column, hits: int = 2, fallback: float = 1200.0) -> DataFrame:
    """Seconds from a cycle's start to the row after its ``hits``-th row that is ``reached``, which may be in the next cycle.

    Cycles with fewer hits, or with no row after, get ``fallback``.
    """
    keys = [unit, cycle]
    marked = df.withColumn("__hit", reached).withColumn("__next", F.lead(seconds).over(along([unit], [cycle, *order])))
    marked = marked.withColumn("__hits", F.sum(F.when(F.col("__hit"), 1).otherwise(0)).over(so_far(keys, order)))
    after = F.min(F.when(F.col("__hit") & (F.col("__hits") == hits), F.col("__next")))
    start = F.min_by(seconds, F.struct(*order))
    return marked.groupBy(unit, cycle).agg(F.coalesce(after - start, F.lit(fallback)).alias("crossing"))


def fill_incomplete(value: str, keys: list[str], order: list[str], least: float = 300.0) -> Column:
    """Values under ``least`` take the last that was not; null before the first such."""
    return F.last(F.when(F.col(value) >= least, F.col(value)), ignorenulls=True).over(so_far(keys, order))


def hold_last(df: DataFrame, unit: str, position: str, value: str, last: int) -> DataFrame:
    """One row for every position 1..last of every unit; a position without a value has the last one before it."""
    frame = df.select(unit).distinct().select(unit, F.explode(F.sequence(F.lit(1), F.lit(last))).alias(position))
    filled = frame.join(df.select(unit, F.col(position).cast("int").alias(position), value), [unit, position], "left")
    return filled.withColumn(value, F.last(value, ignorenulls=True).over(so_far([unit], [position])))


def step_relaxation(df: DataFrame, unit: str, step: str, order: list[str], value: str) -> DataFrame:
    """For every step of a unit: the value just before the step less the value of its last row."""
    marked = df.withColumn("__before", F.lag(value).over(along([unit], order)))
    return marked.groupBy(unit, step).agg((F.min_by("__before", F.struct(*order)) - F.max_by(value, F.struct(*order))).alias("relaxation"))


def every_nth(df: DataFrame, number: str, n: int = 5) -> DataFrame:
    """Rows 1, 1+n, 1+2n, ... by a number that counts from 1."""
    return df.filter((F.col(number) - 1) % n == 0)


def step_series(df: DataFrame, step: str, first: int, period: int, last: int) -> DataFrame:
    """Rows of steps first, first + period, ... up to last."""
    return df.filter(F.col(step).between(first, last) & ((F.col(step) - first) % period == 0))


def next_change(df: DataFrame, keys: list[str], round_: str, value: str) -> DataFrame:
    """Change to the next round, also in percent of the new value; rows of the last round go."""
    after = F.lead(value).over(along(keys, [round_]))
    changed = df.withColumn("change", after - F.col(value)).withColumn("percent_change", 100 * F.try_divide(after - F.col(value), after))
    return changed.filter(F.col("change").isNotNull())
