"""Shared helpers of the corpus operators: table access, lineage cuts, joins on hot keys and driver-side constants."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The share of documents that supervised operators hold out (crc32(doc_id as text) mod 4 = 2).
HOLD_MODULUS, HOLD_REMAINDER = 4, 2
#: Rows from which a join key counts as hot, and hot keys that are split at most.
HOT_ROWS, HOT_KEYS = 2000, 4096
#: Bytes that a broadcast table may take on an executor, and what a row of one or two numbers takes there.
BROADCAST_BYTES, BROADCAST_ROW = 64 << 20, 64

_local_folder: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session or of ``spark.checkpoint.dir``; a temporary one only where all runs in one process."""
    global _local_folder
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _local_folder = _local_folder or tempfile.mkdtemp(prefix="tidemark-")
    return _local_folder


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there goes when the session ends."""
    name = f"{_shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


#: Names of the tables that settle() has written, in order, but for discarded ones.
_written: dict[str, None] = {}


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that its lineage is cut.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A table is written and
    not an RDD checkpoint: the planner then knows its true size, where checkpoints carry
    estimates that every self-join of a loop squares.
    """
    name = scratch(df.sparkSession)
    df.write.parquet(name)
    _written[name] = None
    out = df.sparkSession.read.schema(df.schema).parquet(name)
    out._settled = name
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written.pop(name, None)


def discard(*settled: DataFrame) -> None:
    """Delete tables of settle() that nothing still to be computed reads."""
    for df in settled:
        _delete(df.sparkSession, df._settled)


def written() -> list[str]:
    """The names of all tables of settle() that still stand."""
    return list(_written)


def discard_written(spark: SparkSession, names: Iterable[str]) -> None:
    """Delete tables of settle() by name."""
    for name in names:
        _delete(spark, name)


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """The names wanted, each with underscores before it until it differs from all columns and the names before it."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fits_broadcast(rows: int, more_bytes: int = 0) -> bool:
    """Whether so many rows of a number or two, and of so many bytes besides, may be broadcast."""
    return rows * BROADCAST_ROW + more_bytes <= BROADCAST_BYTES


def spread_join(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``other``, which has few rows a key, without a task for all rows of a hot key.

    The heaviest keys, HOT_KEYS at most, are broadcast with a number of parts in proportion to their rows; the rows
    of each are dealt over its parts by their number, so that equal rows part as well, and ``other`` has a copy of its row for each part.
    What is not split holds less than one row in HOT_KEYS, or HOT_ROWS. Which keys are split changes no result. ``counts``, if known, has the keys and their n.

    ``rows`` must come from files or settled tables without a shuffle between, as a row that is computed again must have the same number.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("hot_n")) if counts is None else counts.withColumnRenamed("n", "hot_n")
    found = counts.filter(F.col("hot_n") > HOT_ROWS).select(*on, "hot_n").orderBy(F.desc("hot_n")).limit(HOT_KEYS)
    heaviest = found.collect()
    if not heaviest:
        return rows.join(other, on, how)
    part_rows = max(HOT_ROWS, heaviest[-1]["hot_n"]) if len(heaviest) == HOT_KEYS else HOT_ROWS
    # all parts together are as many as keys and a share of all rows; the share keeps them few
    part_rows = max(part_rows, -(-sum(r["hot_n"] for r in heaviest) // HOT_KEYS))
    hot = rows.sparkSession.createDataFrame(heaviest, found.schema)
    hot = F.broadcast(hot.select(*on, F.ceil(F.col("hot_n") / part_rows).cast("int").alias("hot_parts")))
    parts = F.coalesce("hot_parts", F.lit(1))
    numbered = rows.withColumn("hot_row", F.monotonically_increasing_id())
    dealt = numbered.join(hot, on, "left").withColumn("hot_part", F.pmod(F.xxhash64("hot_row"), parts).cast("int")).drop("hot_parts", "hot_row")
    copies = other.join(hot, on, "left").withColumn("hot_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hot_parts")
    return dealt.join(copies, [*on, "hot_part"], how).drop("hot_part")


def held_out(doc_id: Column) -> Column:
    """True for documents whose labels and text no learner may use; a null id is never held out."""
    crc = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    return F.coalesce(crc % HOLD_MODULUS == HOLD_REMAINDER, F.lit(False))


def text_key(text: Column) -> Column:
    """Hash that, beside doc_id, identifies a document's content; null and empty text differ."""
    return F.xxhash64(text, text.isNull())


#: Rows of an Arrow batch at most, so that a batch of long texts stays small in a Python worker.
ARROW_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded before texts are handed to Python.

    Spark reads this setting when a job runs, so that it can't be put back here; it bounds memory and changes no result.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df
