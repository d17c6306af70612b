"""The driver's tables in the roles of telemetry: users are units, days are cycles, events are samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, cycle (days since the start of 2024), t (seconds), idx, event_type, value; ordered by (t, idx)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("unit"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("cycle"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("idx"), "event_type", "value",
    )


ORDER = ["t", "idx"]
SAMPLES_SQL = "samples AS (SELECT user_id AS unit, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS cycle, epoch_us(ts) / 1e6 AS t, event_id AS idx, event_type, value FROM events)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, cycle, k (cycles of a unit from 1), q (mean value of the day)."""
    from ..operators.series import along

    days = samples(spark, sf_dir).groupBy("unit", "cycle").agg(F.avg("value").alias("q"))
    return days.withColumn("k", F.row_number().over(along(["unit"], ["cycle"])))


DAILY_SQL = f"{SAMPLES_SQL}, daily AS (SELECT *, CAST(row_number() OVER (PARTITION BY unit ORDER BY cycle) AS INTEGER) AS k FROM (SELECT unit, cycle, avg(value) AS q FROM samples GROUP BY unit, cycle))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that sums in another order compare equal; a negative zero becomes zero."""
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
