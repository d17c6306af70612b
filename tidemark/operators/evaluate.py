"""Outcome statistics: replicates, errors, ranks, correlation, sensitivity, convergence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .ordered import chunked, discordant

Z95 = 1.96


def long_replicates(wide: DataFrame, keys: list[str], columns: list[str], name: str = "replicate", value: str = "value") -> DataFrame:
    """A row for each replicate that isn't missing."""
    return wide.unpivot(keys, columns, name, value).filter(F.col(value).isNotNull())


def replicate_stats(replicates: DataFrame, keys: list[str], value: str, divisor: int | None = 5) -> DataFrame:
    """Mean and population deviation, rounded half-even, and the 95 % half-width; noise under a millionth decides no tie.

    The half-width divides by the root of ``divisor`` whatever is missing, or of the true number if it is None.
    """
    n = F.lit(float(divisor)) if divisor else F.count(value).cast("double")
    whole = lambda x: F.bround(F.round(x, 6), 0)
    return replicates.groupBy(*keys).agg(
        F.count(value).alias("n"), whole(F.avg(value)).alias("mean"), whole(F.stddev_pop(value)).alias("deviation"), whole(Z95 * F.stddev_pop(value) / F.sqrt(n)).alias("half_width")
    )


def error_metrics(pairs: DataFrame, predicted: str, actual: str, keys: list[str] | None = None) -> DataFrame:
    """RMSE and MAPE, plain and after shifting predictions by the difference of the means, and Pearson's r.

    A mean is taken over what is not missing on its side; errors over pairs with both sides.
    """
    means = pairs.groupBy(*(keys or [])).agg(F.avg(actual).alias("__a"), F.avg(predicted).alias("__p"))
    both = pairs.join(means, keys) if keys else pairs.crossJoin(F.broadcast(means))  # one row if there are no keys
    shift = F.col("__a") - F.col("__p")
    error, shifted = F.col(predicted) - F.col(actual), F.col(predicted) + shift - F.col(actual)
    share = lambda e: F.avg(F.try_divide(F.abs(e), F.col(actual))) * 100
    return both.groupBy(*(keys or [])).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), share(error).alias("mape"), F.first(shift).alias("shift"),
        F.sqrt(F.avg(shifted * shifted)).alias("shifted_rmse"), share(shifted).alias("shifted_mape"), F.corr(predicted, actual).alias("pearson"),
    )


def unique_rank(value: str, keys: list[str], tie: str) -> Column:
    """1-based descending rank in each key, of bounded keys such as the policies of a year; ties go by ``tie``. ordered.ranked() ranks all rows of a table."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie))


def rank_of_value(values: DataFrame, value: str, rows: int | None = None) -> DataFrame:
    """Each distinct value and its place, from 0, in descending order of all rows; equal values have the first place, null the last.

    Ranges of values are summed apart and offset by the sums of the ranges above, so that no task orders all values.
    """
    counted = values.groupBy(value).agg(F.count("*").alias("__n"))
    keyed = counted.withColumn("__null", F.col(value).isNull()).withColumn("__down", -F.col(value))
    order = ["__null", "__down"]
    numbered = chunked(keyed, [], order, rows)
    inside = Window.partitionBy("__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = numbered.groupBy("__chunk").agg(F.sum("__n").alias("__rows")).select(F.col("__chunk").alias("__of"), F.coalesce(F.sum("__rows").over(above), F.lit(0)).alias("__offset"))
    placed = numbered.join(F.broadcast(offsets), F.col("__chunk") == F.col("__of"))
    return placed.select(value, (F.col("__offset") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).alias("place"))


def kendall(pairs: DataFrame, x: str, y: str, keys: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Kendall's tau-b of each key over the rows that have both values; null where either is the same in all rows.

    No two rows are compared: ties are counted by grouping, and pairs in opposite order by ordered.discordant(). The rows are made once
    and settled in the scratch folder, as counts, cuts, ties and inversions each read them.
    """
    keys = keys or []
    own = settled(pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*keys, x, y])))
    tied = lambda c: F.sum(F.col(c).cast("decimal(38,0)") * (F.col(c) - 1) / 2).cast("decimal(38,0)")
    both = own.groupBy(*keys, x, y).agg(F.count("*").alias("n"))
    ties = lambda by, name: both.groupBy(*keys, by).agg(F.sum("n").alias("n")).groupBy(*keys).agg(tied("n").alias(name))
    counts = both.groupBy(*keys).agg(F.sum("n").alias("__all"), tied("n").alias("__xy"))
    parts = [counts, ties(x, "__x"), ties(y, "__y"), discordant(own, x, y, keys, rows).withColumnRenamed("n", "__q")]
    row = parts[0]
    for part in parts[1:]:
        if keys:
            named = part.toDF(*(f"__k{i}" for i in range(len(keys))), part.columns[-1])
            match = reduce(lambda m, c: m & c, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
            row = row.join(named, match, "left").drop(*(f"__k{i}" for i in range(len(keys))))
        else:
            row = row.crossJoin(F.broadcast(part))  # one row each
    pairs_of = F.col("__all").cast("decimal(38,0)") * (F.col("__all") - 1) / 2
    d = lambda c: c.cast("double")
    agree = d(pairs_of.cast("decimal(38,0)") - F.col("__x") - F.col("__y") + F.col("__xy") - 2 * F.coalesce("__q", F.lit(0)))
    spread = F.sqrt(d(pairs_of.cast("decimal(38,0)") - F.col("__x")) * d(pairs_of.cast("decimal(38,0)") - F.col("__y")))
    return row.select(*keys, F.try_divide(agree, spread).alias("tau"))


def top_change(changes: DataFrame, rank: str, change: str, percent: str, tops: tuple[int, ...] = (5, 10, 50, 224), keys: list[str] | None = None) -> DataFrame:
    """Mean size of the change and of the percent change among the first k ranks, for each k."""
    spread = changes.withColumn("top", F.explode(F.array(*map(F.lit, tops)))).filter(F.col(rank) <= F.col("top"))
    return spread.groupBy(*(keys or []), "top").agg(F.avg(F.abs(change)).alias("mean_change"), F.avg(F.abs(percent)).alias("mean_percent"))


def square_sum(df: DataFrame, keys: list[str], columns: list[str], out: str = "square_sum") -> DataFrame:
    """Sum over the rows of each key of the squares of several columns."""
    return df.groupBy(*keys).agg(F.sum(sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))).alias(out))


def shared_range(df: DataFrame, value: str) -> DataFrame:
    """Each row with the least and greatest value of all rows, as a scale that several tables share."""
    return df.crossJoin(F.broadcast(df.agg(F.min(value).alias("low"), F.max(value).alias("high"))))  # one row


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in each of ``bins`` equal bins; the last takes its upper edge, what is outside is left out, empty bins have 0."""
    inside = df.filter(F.col(value).between(low, high)).select(F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int").alias("bin"))
    return _all_bins(df, inside, 1, bins)


def count_histogram(df: DataFrame, count: str, most: int) -> DataFrame:
    """Rows for each count 0..most."""
    return _all_bins(df, df.select(F.col(count).cast("int").alias("bin")), 0, most)


def _all_bins(df: DataFrame, inside: DataFrame, first: int, last: int) -> DataFrame:
    bins = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(inside.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def sensitivity(df: DataFrame, keys: list[str], life: str, rank: str) -> DataFrame:
    """Mean and sample deviation of life, and mean and range of rank, for each setting."""
    return df.groupBy(*keys).agg(
        F.avg(life).alias("mean_life"), F.stddev_samp(life).alias("std_life"), F.avg(rank).alias("mean_rank"), F.min(rank).alias("min_rank"), F.max(rank).alias("max_rank")
    )


def spread_parts(replicates: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """Mean and population deviation of all outcomes, deviation of the residuals, mean deviation within keys, and what the quadrature leaves between keys.

    The rows are read once: deviations of all rows follow from the number, mean and deviation of each key.
    """
    stats = lambda c, name: [F.count(c).alias(f"__n_{name}"), F.avg(c).alias(f"__m_{name}"), F.var_pop(c).alias(f"__v_{name}")]
    per_key = replicates.groupBy(*keys).agg(*stats(F.col(actual), "a"), *stats(F.col(predicted) - F.col(actual), "r"))
    n = lambda name: F.col(f"__n_{name}")
    mean = lambda name: F.try_divide(F.sum(n(name) * F.col(f"__m_{name}")), F.sum(n(name)))
    # within keys, and between them about the mean of all rows
    between = lambda name: F.try_divide(F.sum(n(name) * F.pow(F.col(f"__m_{name}"), F.lit(2))), F.sum(n(name))) - F.pow(mean(name), F.lit(2))
    spread = lambda name: F.sqrt(F.greatest(F.try_divide(F.sum(n(name) * F.col(f"__v_{name}")), F.sum(n(name))) + between(name), F.lit(0.0)))
    parts = per_key.agg(mean("a").alias("mean"), spread("a").alias("sigma"), spread("r").alias("sigma_residual"), F.avg(F.sqrt("__v_a")).alias("sigma_within"))
    return parts.withColumn("eta", F.sqrt(F.greatest(F.col("sigma") * F.col("sigma") - F.col("sigma_within") * F.col("sigma_within"), F.lit(0.0))))


def two_level_fit(df: DataFrame, outer: list[str], inner: str, x: str, y: str) -> DataFrame:
    """A line y over x in each (outer, inner), then a line of log slope over 1/inner in each outer: activation from rates."""
    slopes = df.groupBy(*outer, inner).agg(F.regr_slope(y, x).alias("__s")).filter("__s > 0")
    return slopes.groupBy(*outer).agg(
        F.count("*").alias("n_fits"), F.regr_slope(F.log("__s"), 1 / F.col(inner)).alias("slope"), F.regr_intercept(F.log("__s"), 1 / F.col(inner)).alias("intercept")
    )


def mean_fit(df: DataFrame, unit: str, level: str, x: str, y: str, order: list[str], skip_from: int = 2) -> DataFrame:
    """Mean and population deviation over units of the slopes fitted at each level; from level ``skip_from`` on without a fit's first point."""
    first = F.row_number().over(Window.partitionBy(unit, level).orderBy(*order)) == 1
    own = df.withColumn("__first", first).filter(~(F.col("__first") & (F.col(level) >= skip_from)))
    fits = own.groupBy(unit, level).agg(F.regr_slope(y, x).alias("slope"))
    return fits.groupBy(level).agg(F.avg("slope").alias("mean_slope"), F.stddev_pop("slope").alias("std_slope"))


def band(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and the 95 % band of 1.96 sample deviations around it."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.avg(value) - Z95 * F.stddev_samp(value)).alias("low"), (F.avg(value) + Z95 * F.stddev_samp(value)).alias("high"))
