"""Totals of rounds that arrive as files, kept as state that holds sums and no rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that arbitrary state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class RoundTotals(StatefulProcessor):
    """Rows and sum of outcomes of every round of an experiment, and the totals of all its rounds so far.

    A round comes in one file, and so in one batch. One that comes again, in a file of another name, is known and changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rounds = handle.getMapState("rounds", "round int", "n long, total double")
        self.so_far = handle.getValueState("so_far", "rounds int, n long, total double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a file is told by its name: of two files with one round in one batch the first counts
        sums: dict[tuple[int, str], list[float]] = {}
        for part in rows:
            for (round_, file), own in part.groupby(["round", "file"]):
                held = sums.setdefault((int(round_), file), [0, 0.0])
                held[0] += len(own)
                held[1] += float(own["outcome"].sum())
        out = []
        for (round_, _), (n, total) in sorted(sums.items()):
            if self.rounds.containsKey((round_,)):
                continue
            self.rounds.updateValue((round_,), (n, total))
            rounds, all_n, all_total = self.so_far.get() if self.so_far.exists() else (0, 0, 0.0)
            self.so_far.update((rounds + 1, all_n + n, all_total + total))
            out.append((*key, round_, n, total, rounds + 1, all_n + n, all_total + total))
        if out:
            yield pd.DataFrame(out, columns=["experiment", "round", "n", "total", "rounds_so_far", "n_so_far", "total_so_far"])

    def close(self) -> None:
        pass


_OUT = "experiment string, round int, n long, total double, rounds_so_far int, n_so_far long, total_so_far double"


def totals(stream: DataFrame) -> DataFrame:
    """experiment, round, n, total and the totals so far, a row for every round as it arrives; ``stream`` has experiment, round, outcome and file.

    The session's state store must be the one of STORE.
    """
    rows = stream.select(F.col("experiment").cast("string").alias("experiment"), F.col("round").cast("int").alias("round"), F.col("outcome").cast("double").alias("outcome"), "file")
    return rows.groupBy("experiment").transformWithStateInPandas(RoundTotals(), _OUT, "Append", "None")


def arriving(spark: SparkSession, folder: str, schema: str, files_at_once: int = 10) -> DataFrame:
    """Parquet files of a folder as they arrive, with the file of each row."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder).withColumn("file", F.col("_metadata.file_name"))


def run(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, files_at_once: int = 10) -> DataFrame:
    """Add the totals of all files that have come since the last run to the table in ``out``, and read it."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        found = totals(arriving(spark, folder, schema, files_at_once))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(_OUT).parquet(out)
