"""Telemetry and metadata that arrive apart, paired as streams.

Both sides have a time of arrival and a watermark: a sample waits for its metadata, and metadata for its samples, for ``late``
at most. Samples whose metadata hasn't come by then leave with null metadata, into a table of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def paired(samples: DataFrame, about: DataFrame, key: str, time: str, about_time: str, late: str) -> DataFrame:
    """Samples with their metadata, or with nulls once it can't come any more; both streams have ``key`` and a time."""
    left = samples.withWatermark(time, late)
    right = about.withColumnRenamed(key, "__key").withWatermark(about_time, late)
    near = F.col(about_time).between(F.col(time) - F.expr(f"interval {late}"), F.col(time) + F.expr(f"interval {late}"))
    return left.join(right, (F.col(key) == F.col("__key")) & near, "leftOuter").withColumn("unpaired", F.col("__key").isNull()).drop("__key")


def run(spark: SparkSession, pairs: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Write what has arrived to ``out``/pairs and ``out``/unpaired, from where the last run stopped, and read both; a batch that is run again replaces itself."""
    columns = [c for c in pairs.columns if c != "unpaired"]

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in (("pairs", batch.filter("not unpaired")), ("unpaired", batch.filter("unpaired"))):
            rows.select(columns).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    pairs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    schema = pairs.select(columns).schema
    read = lambda name: spark.read.schema(schema).parquet(f"{out}/{name}/*")
    return read("pairs").withColumn("unpaired", F.lit(False)).union(read("unpaired").withColumn("unpaired", F.lit(True)))
