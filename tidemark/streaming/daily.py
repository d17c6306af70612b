"""Telemetry as a stream: files that arrive during a test become per-cycle summaries, late samples included up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema: str, files_at_once: int = 200) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows, greatest, least and mean value of each key in each window of time."""
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
        .agg(F.count("*").alias("n"), F.max(value).alias("greatest"), F.min(value).alias("least"), F.avg(value).alias("mean"))
        .select(F.col("window.start").alias("window_start"), *keys, "n", "greatest", "least", "mean")
    )


def run(spark: SparkSession, windows: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Add the windows that have closed since the last run to the table in ``out``, and read it; a window closes once the watermark has passed its end."""
    windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(windows.schema).parquet(out)
