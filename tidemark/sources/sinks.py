"""Sinks: fixed-precision CSV, display names, nested tables, per-round state and the run log.

State is kept in snapshots: data are written first, under names of their own, and a manifest that names them is published by one rename.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .named_files import write_csv


def fixed_csv(df: DataFrame, path: str, decimals: int = 3) -> None:
    """Headerless CSV of numbers with a fixed number of decimals."""
    df.select(*(F.format_string(f"%.{decimals}f", F.col(c).cast("double")).alias(c) for c in df.columns)).write.mode("overwrite").csv(path)


def display_csv(df: DataFrame, folder: str, file: str, names: list[str], order: list[str]) -> None:
    """One CSV file with display names as header and rows by ``order``, written as a stream by one task and in place when it is whole."""
    write_csv(df.toDF(*names).withColumn("__file", F.lit(file)), folder, "__file", order, names)


def nested(units: DataFrame, cycles: DataFrame, unit: str, order: str) -> DataFrame:
    """Units with their cycles as an array of structs in order. A unit's cycles are few thousand rows."""
    fields = [c for c in cycles.columns if c != unit]
    packed = cycles.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias("cycles"))
    return units.join(packed, unit, "left")


def _hadoop(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> tuple[int, list[dict]]:
    """The number and the entries of the last published manifest; 0 and none before the first."""
    folder, files = _hadoop(spark, f"{root}/_manifest")
    found = sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []
    found = [name for name in found if re.fullmatch(r"\d{10}\.json", name)]
    if not found:
        return 0, []
    path, _ = _hadoop(spark, f"{root}/_manifest/{found[-1]}")
    stream = files.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(found[-1][:10]), json.loads(text)


def publish(spark: SparkSession, root: str, change: Callable[[list[dict]], list[dict]], tries: int = 20) -> int:
    """Publish what ``change`` makes of the entries, by one rename of a new manifest; if another was published meanwhile, it is done again on that one."""
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    for _ in range(tries):
        number, entries = manifest(spark, root)
        draft, files = _hadoop(spark, f"{root}/_manifest/draft-{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(json.dumps(change(entries)).encode())
        stream.close()
        final, _ = _hadoop(spark, f"{root}/_manifest/{number + 1:010d}.json")
        try:
            # unlike a plain rename, this one never replaces a file
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(draft), files.makeQualified(final), none)
            return number + 1
        except Py4JJavaError:
            files.delete(draft, False)
            if not files.exists(final):
                raise
    raise RuntimeError(f"{root}: too many writers published at once")


def write_state(df: DataFrame, root: str, round_: int) -> dict:
    """Write the state of one round, which no reader sees before its entry is published."""
    path = f"{root}/data/round-{round_}-{uuid.uuid4().hex}"
    df.withColumn("round", F.lit(round_)).write.parquet(path)
    return {"round": round_, "path": path}


def publish_state(spark: SparkSession, root: str, entry: dict) -> int:
    """Publish the state of a round in place of an earlier one of that round."""
    return publish(spark, root, lambda entries: [*(e for e in entries if e["round"] != entry["round"]), entry])


def save_state(df: DataFrame, root: str, round_: int) -> None:
    """Write and publish the state of one round; readers see the old one whole, and then the new one whole."""
    publish_state(df.sparkSession, root, write_state(df, root, round_))


def load_state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The published states of all rounds, or of those before one."""
    paths = [e["path"] for e in manifest(spark, root)[1] if before is None or e["round"] < before]
    if not paths:
        raise ValueError(f"no round is published under {root}")
    return spark.read.parquet(*paths)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete data that the last manifest doesn't name and manifests before it, once no reader of older ones is left; the number of folders deleted."""
    number, entries = manifest(spark, root)
    named = {e["path"].rpartition("/")[2] for e in entries}
    folder, files = _hadoop(spark, f"{root}/data")
    old = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in named] if files.exists(folder) else []
    past, _ = _hadoop(spark, f"{root}/_manifest")
    for path in [*old, *(s.getPath() for s in files.listStatus(past) if s.getPath().getName() < f"{number:010d}.json")]:
        files.delete(path, True)
    return len(old)


def append_log(lives: DataFrame, root: str) -> None:
    """Add rows of run, round and life to the run log, all in one write and published at once; the same run and round again replaces it."""
    path = f"{root}/data/log-{uuid.uuid4().hex}"
    lives.select("run", F.col("round").cast("int").alias("round"), F.col("life").cast("double").alias("life")).write.parquet(path)
    publish(lives.sparkSession, root, lambda entries: [*entries, {"path": path}])


def read_log(spark: SparkSession, root: str, rounds: int) -> DataFrame:
    """A row a run, a column l<k> a round, null where a run has not come that far."""
    parts = [spark.read.schema("run string, round int, life double").parquet(e["path"]).withColumn("batch", F.lit(k)) for k, e in enumerate(manifest(spark, root)[1])]
    if not parts:
        raise ValueError(f"no log is published under {root}")
    found = reduce(DataFrame.union, parts)
    return found.groupBy("run").pivot("round", list(range(rounds))).agg(F.max_by("life", "batch")).toDF("run", *(f"l{k + 1}" for k in range(rounds)))


def summaries_first(names: DataFrame, name: str = "name") -> DataFrame:
    """Names in the order of a report: those with ``summary`` first, each part by name."""
    return names.orderBy(F.col(name).contains("summary").desc(), name)
