"""A new name in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def scratch(spark: SparkSession) -> str:
    """A name under the checkpoint folder, deleted when the session ends; a temporary folder only where all runs in one process."""
    global _local_folder
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _local_folder = _local_folder or tempfile.mkdtemp(prefix="tidemark-")
    name = f"{folder}/scratch-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch name and read back, for what many steps read and is costly to make again."""
    name = scratch(df.sparkSession)
    df.write.parquet(name)
    return df.sparkSession.read.schema(df.schema).parquet(name)
