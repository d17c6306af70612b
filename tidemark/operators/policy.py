"""Parameter grids of charging protocols, their meshes and the files and schedules made of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from .ordered import chunked, scan

# The rates of each free step, the allowed range of the last rate, and the baseline that is left out.
FIRST = (3.6, 4.0, 4.4, 4.8, 5.2, 5.6, 6.0, 7.0, 8.0)
SECOND = (3.6, 4.0, 4.4, 4.8, 5.2, 5.6, 6.0, 7.0)
THIRD = (3.6, 4.0, 4.4, 4.8, 5.2, 5.6)
LAST_LIMITS = (0.1, 4.81)
BASELINE = (4.8, 4.8, 4.8)
#: Distinct values of an axis, and policies that are shuffled as numpy does, at most.
AXIS, MOST_SHUFFLED = 1000, 100_000


def all_combinations(spark: SparkSession, first=FIRST, second=SECOND, third=THIRD) -> DataFrame:
    """Every c1, c2, c3 and the c4 that follows from them; ``position`` counts them in this order."""
    frame = spark.range(1)
    for name, values in (("c1", first), ("c2", second), ("c3", third)):
        frame = frame.select(*[c for c in frame.columns if c != "id"], F.posexplode(F.array(*map(F.lit, values))).alias(f"{name}_at", name))
    place = (F.col("c1_at") * len(second) + F.col("c2_at")) * len(third) + F.col("c3_at")
    return frame.select(place.cast("int").alias("position"), "c1", "c2", "c3", scalars.dependent_rate(F.col("c1"), F.col("c2"), F.col("c3")).alias("c4"))


def combinations(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """The same for rates that tables hold: each axis is one column, of which the distinct values are taken in rising order, AXIS at most."""
    numbered = []
    for name, axis in (("c1", first), ("c2", second), ("c3", third)):
        values = axis.toDF(name).filter(F.col(name).isNotNull()).distinct().limit(AXIS + 1)
        counted = values.agg(F.sort_array(F.collect_set(name)).alias("all"))  # AXIS values
        checked = F.when(F.size("all") <= AXIS, F.col("all")).otherwise(F.raise_error(F.lit(f"{name} has more than {AXIS} values")))
        numbered.append(counted.select(F.size("all").alias(f"{name}_n"), F.posexplode(checked).alias(f"{name}_at", name)))
    frame = numbered[0].crossJoin(F.broadcast(numbered[1])).crossJoin(F.broadcast(numbered[2]))  # AXIS rows each
    place = (F.col("c1_at") * F.col("c2_n") + F.col("c2_at")) * F.col("c3_n") + F.col("c3_at")
    return frame.select(place.cast("int").alias("position"), "c1", "c2", "c3", scalars.dependent_rate(F.col("c1"), F.col("c2"), F.col("c3")).alias("c4"))


def valid(combinations: DataFrame, limits=LAST_LIMITS, baseline=BASELINE) -> DataFrame:
    """Combinations whose last rate is within limits, without the baseline."""
    is_baseline = (F.col("c1") == baseline[0]) & (F.col("c2") == baseline[1]) & (F.col("c3") == baseline[2])
    return combinations.filter(F.col("c4").between(*limits) & ~is_baseline)


def policy_key(*rates: str) -> list:
    """Rates in thousandths, to join on instead of on floating point."""
    return [F.round(F.col(c) * 1000).cast("long").alias(f"{c}_key") for c in rates]


def arms(policies: DataFrame, seed: int = 0) -> DataFrame:
    """Policies with ``arm_id`` as numpy's legacy generator shuffles them, which only one process can do: MOST_SHUFFLED rows at most, which is checked. shuffled() has no such bound."""
    n = policies.count()
    if n > MOST_SHUFFLED:
        raise ValueError(f"more than {MOST_SHUFFLED} policies can't be shuffled on the driver")
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    at = {int(row): k for k, row in enumerate(order)}
    ids = policies.sparkSession.createDataFrame([(k, v) for k, v in at.items()], "row int, arm_id int")
    ranked = policies.orderBy("position").select("position").collect()
    rows = policies.sparkSession.createDataFrame([(r["position"], k) for k, r in enumerate(ranked)], "position int, row int")
    return policies.join(rows, "position").join(ids, "row").drop("row")


def shuffled(policies: DataFrame, id_: str, seed: int = 0, rows: int | None = None) -> DataFrame:
    """Policies with ``arm_id`` from 0 in the order of a hash of seed and id, for any number of policies; ids are unique."""
    keyed = policies.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_).cast("string"))))
    order = ["__h", id_]
    return scan(chunked(keyed, [], order, rows), [], order, number="__n").select(*policies.columns, (F.col("__n") - 1).alias("arm_id"))


def channels(policies: DataFrame, seed: int, first_line: int = 14, lines_each: int = 49) -> DataFrame:
    """Random channel, from 1, of each policy, and the line of the batch file that names it."""
    shuffled = arms(policies, seed)
    return shuffled.select("c1", "c2", "c3", "c4", (F.col("arm_id") + 1).alias("channel"), (F.col("arm_id") * lines_each + first_line).alias("line_no"))


def mesh(facets: DataFrame, x: tuple[float, float, float], y: tuple[float, float, float], limits=LAST_LIMITS) -> DataFrame:
    """c1, c2 on an even grid (low, step, number) for each facet, a row with c3, with c4 null outside the limits."""
    axis = lambda low, step, n: F.transform(F.sequence(F.lit(0), F.lit(int(n) - 1)), lambda k: F.round(low + k * step, 6))
    frame = facets.select("c3", F.explode(axis(*x)).alias("c1")).select("c3", "c1", F.explode(axis(*y)).alias("c2"))
    return frame.withColumn("c4", scalars.masked(scalars.dependent_rate(F.col("c1"), F.col("c2"), F.col("c3")), *limits))


def edited(template: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines (file, line_no, text) with the text of ``edits`` where it names a file's line."""
    new = edits.withColumnRenamed("text", "__text")
    return template.join(new, ["file", "line_no"], "left").select("file", "line_no", F.coalesce("__text", "text").alias("text"))


def repetitions(policies: DataFrame, observed: DataFrame, rates: list[str]) -> DataFrame:
    """How often each policy was observed, by exact rates in thousandths."""
    seen = observed.select(*policy_key(*rates)).withColumn("__seen", F.lit(1))
    keyed = policies.select("*", *policy_key(*rates))
    names = [f"{c}_key" for c in rates]
    return keyed.join(seen, names, "left").groupBy(*rates).agg(F.count("__seen").alias("n"))


def by_round(policies: DataFrame, observed: DataFrame, rates: list[str], round_: str, value: str, rounds: list[int]) -> DataFrame:
    """A column r<k> a round with the value observed for each policy, null if none."""
    keyed = policies.select("*", *policy_key(*rates))
    names = [f"{c}_key" for c in rates]
    wide = observed.select(*policy_key(*rates), round_, value).groupBy(*names).pivot(round_, rounds).agg(F.max(value))
    wide = wide.withColumnsRenamed({str(k): f"r{k}" for k in rounds})
    return keyed.join(wide, names, "left").drop(*names)
