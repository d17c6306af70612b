"""Queries that let tables arrive as files and read what streams make of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import scratch
from ..streaming import daily, pairing, rounds
from .tables import SAMPLES_SQL, rounded, samples, table

QUERIES, SQL = {}, {}
#: When the streams' files arrive, in seconds.
_DAY = 1_704_067_200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH r AS (SELECT o_orderpriority AS experiment, CAST(o_orderkey % 4 AS INTEGER) AS round, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT experiment, round, n, round(total, 2) AS total, CAST(max(round) OVER () + 1 AS INTEGER) AS rounds, sum(n) OVER (PARTITION BY experiment)::BIGINT AS all_n, round(sum(total) OVER (PARTITION BY experiment), 2) AS all_total FROM r""")
def streamed_rounds(spark, sf_dir):
    """Rounds of orders that arrive as files in two runs, one of them twice: totals of each round and of all, from state that holds sums."""
    folder, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("experiment"), (F.col("o_orderkey") % 4).cast("int").alias("round"), F.col("o_totalprice").alias("outcome"))
    for part in ([0, 1], [1, 2, 3]):  # round 1 comes again
        # a file a round
        orders.filter(F.col("round").isin(part)).withColumn("of", F.col("round")).repartition("of").write.partitionBy("of").mode("append").parquet(folder)
        found = rounds.run(spark, folder, "experiment string, round int, outcome double", out, checkpoint)
    last = found.groupBy("experiment").agg(F.max_by(F.struct("rounds_so_far", "n_so_far", "total_so_far"), "rounds_so_far").alias("all"))
    return rounded(found.join(last, "experiment").select("experiment", "round", "n", "total", F.col("all.rounds_so_far").alias("rounds"), F.col("all.n_so_far").alias("all_n"), F.col("all.total_so_far").alias("all_total")), 2)


@query(f"""WITH {SAMPLES_SQL} SELECT idx, unit, p_brand AS brand, p_partkey IS NULL AS unpaired FROM samples LEFT JOIN part ON p_partkey = unit AND p_size <= 25""")
def paired_streams(spark, sf_dir):
    """Samples and what is known of their units, as two streams of which the second comes first for some units, later for others and never for the rest."""
    left, right, out, checkpoint = (scratch(spark) for _ in range(4))
    own = samples(spark, sf_dir).select("idx", "unit", F.timestamp_seconds(F.lit(_DAY)).alias("at"))
    about = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("brand"), F.timestamp_seconds(F.lit(_DAY + 60)).alias("about_at"))
    end = F.timestamp_seconds(F.lit(_DAY + 1_000_000))
    ends = spark.range(1).select(F.lit(-1).cast("long").alias("idx"), F.lit(-1).cast("long").alias("unit"), end.alias("at")), spark.range(1).select(F.lit(-2).cast("long").alias("unit"), F.lit(None).cast("string").alias("brand"), end.alias("about_at"))
    steps = [(own.filter("unit % 2 = 0"), left), (about.filter("unit % 3 = 0"), right), (own.filter("unit % 2 = 1"), left), (about.filter("unit % 3 > 0"), right)]
    for rows, folder in steps[:2]:
        rows.write.mode("append").parquet(folder)
    pairs = pairing.paired(daily.arriving(spark, left, "idx long, unit long, at timestamp"), daily.arriving(spark, right, "unit long, brand string, about_at timestamp"), "unit", "at", "about_at", "1 hour")
    pairing.run(spark, pairs, out, checkpoint)
    for rows, folder in (*steps[2:], *zip(ends, (left, right))):  # rows of a later time end the waiting
        rows.write.mode("append").parquet(folder)
    found = pairing.run(spark, pairs, out, checkpoint)
    return found.filter("idx >= 0").select("idx", "unit", "brand", "unpaired")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, max(value) AS greatest, min(value) AS least, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def streamed_days(spark, sf_dir):
    """Daily summaries of events that arrive day by day, half of each day's a day late; a row of a later time closes the last windows."""
    folder, out, checkpoint = (scratch(spark) for _ in range(3))
    own = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "event_id")
    days = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + F.col("event_id") % 2
    found = None
    for part in (own.filter(days < 15), own.filter(days >= 15), own.agg((F.max("ts") + F.expr("interval 9 days")).alias("ts")).select("ts", F.lit("").alias("event_type"), F.lit(0.0).alias("value"), F.lit(-1).cast("long").alias("event_id"))):
        part.drop("event_id").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.mode("append").parquet(folder)
        windows = daily.windowed(daily.arriving(spark, folder, "ts timestamp, event_type string, value double"), "ts", ["event_type"], "value")
        found = daily.run(spark, windows, out, checkpoint)
    return rounded(found.select("window_start", "event_type", "n", "greatest", "least", "mean"))
