"""Readers for telemetry folders, sidecar metadata and the tables around an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.series import from_first_match
from . import schemas


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, pattern: str | None = None) -> DataFrame:
    """A CSV scan with a fixed schema: columns by position, blank fields null, short rows filled with null, a byte-order mark skipped."""
    reader = spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("nullValue", "").option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(path)


def file_name() -> Column:
    """The name of a row's file, which Spark gives with signs such as # escaped as in a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def telemetry(spark: SparkSession, folder: str, batch_date: str) -> DataFrame:
    """Samples of all cells of a batch, with ``file`` and the batch; temporary files, which begin with ``~``, are left out.

    The pattern prunes files before they are read. The leading index is kept as the order of rows.
    """
    found = csv(spark, folder, schemas.TELEMETRY, pattern=f"*{batch_date}*.csv").withColumn("file", file_name())
    return found.filter(~F.col("file").startswith("~") & ~F.col("file").contains("_Metadata")).withColumn("batch_date", F.lit(batch_date))


def metadata(spark: SparkSession, folder: str, batch_date: str) -> DataFrame:
    """barcode, channel (from 1), schedule, policy and the telemetry file of every cell of a batch."""
    found = csv(spark, folder, schemas.METADATA, pattern=f"*{batch_date}*_Metadata.csv").withColumn("metadata_file", file_name())
    schedule = F.upper("schedule_file_name")
    return found.select(
        F.col("item_id").alias("barcode"), (F.col("iv_ch_id") + 1).alias("channel"), schedule.alias("schedule"),
        text.schedule_policy(F.col("schedule_file_name")).alias("policy"), text.data_file_of_metadata(F.col("metadata_file")).alias("file"),
    )


def cells(samples: DataFrame, about: DataFrame, strict: bool = True) -> DataFrame:
    """Samples with their cell's metadata, paired by file name; a row a cell, so that the metadata side is broadcast where it is small.

    A file without metadata fails the query where its samples are read. Without ``strict`` its samples stay, with null metadata; unpaired() lists such files.
    """
    both = samples.join(about.withColumn("__paired", F.lit(True)), "file", "left")
    if strict:
        fail = F.raise_error(F.concat(F.lit("no metadata for "), F.coalesce("file", F.lit("a file without a name")))).cast("boolean")
        both = both.filter(F.when(F.col("__paired").isNull(), fail).otherwise(True))
    return both.drop("__paired")


def unpaired(samples: DataFrame, about: DataFrame) -> DataFrame:
    """Files of samples without metadata (side ``samples``) and of metadata without samples (side ``metadata``)."""
    left, right = samples.select("file").distinct(), about.select("file").distinct()
    return left.join(right, "file", "left_anti").select("file", F.lit("samples").alias("side")).union(right.join(left, "file", "left_anti").select("file", F.lit("metadata").alias("side")))


def without_denied(samples: DataFrame, denied: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of files that aren't listed as bad."""
    return samples.join(denied.select(*keys), keys, "left_anti")


def borrowed(samples: DataFrame, other: DataFrame, channel: str, value: int, batch_date: str) -> DataFrame:
    """Samples and, relabelled to this batch, those of one channel of another."""
    return samples.unionByName(other.filter(F.col(channel) == value).withColumn("batch_date", F.lit(batch_date)))


def without_positions(files: DataFrame, order: str, low: int, high: int) -> DataFrame:
    """Files but those at the places low..high, from 1, of their order; for lists of files."""
    placed = files.withColumn("__n", F.row_number().over(Window.orderBy(order)))
    return placed.filter(~F.col("__n").between(low, high)).drop("__n")


def from_first_cycle_zero(samples: DataFrame, unit: str = "file", order: str = "sample_idx") -> DataFrame:
    """Samples from the first of cycle 0 on, for files that start in the middle of a run."""
    return from_first_match(samples, F.col("cycle_idx") == 0, [unit], [order])


def without_sensors(samples: DataFrame) -> DataFrame:
    """Samples of rigs that had no temperature and resistance sensors: null instead of what was filled in."""
    none = F.lit(None).cast("double")
    return samples.withColumn("internal_resistance", none).withColumn("temperature", none)


def rounds(spark: SparkSession, folder: str, schema: str = schemas.PREDICTIONS) -> DataFrame:
    """All ``<k>.csv`` of a folder, with ``round`` from the name."""
    found = csv(spark, folder, schema, header=False, pattern="[0-9]*.csv")
    return found.withColumn("round", F.regexp_extract(file_name(), r"(\d+)\.csv", 1).cast("int"))


def batch_dates(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """Lookup of batch names."""
    return spark.createDataFrame(list(names.items()), "batch_name string, batch_date string")


def with_batch_date(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Unknown names have a null date."""
    return df.join(lookup, "batch_name", "left")
