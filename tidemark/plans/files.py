"""Queries that write files and read them again: what comes back must be what SQL makes of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features
from ..sources import named_files, readers, schemas, sinks, workbooks
from ..sources.scratch import scratch
from .tables import SAMPLES_SQL, rounded, samples, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Cells that the samples are dealt over, each a telemetry file and a metadata file.
_CELLS = 24


def _telemetry_folder(spark, sf_dir) -> str:
    """Files of a batch as a cycler leaves them: samples and metadata of each cell, a temporary file and a file of another day."""
    folder = scratch(spark)
    own = samples(spark, sf_dir).withColumn("cell", F.col("unit") % _CELLS)
    kept = {"sample_idx": F.col("idx"), "test_time": F.col("t"), "step_idx": F.lit(1), "cycle_idx": F.col("cycle") % 3, "voltage": F.col("value")}
    columns = [c.split()[0] for c in schemas.TELEMETRY.split(", ")]
    rows = own.select("cell", *(kept.get(c, F.lit(None).cast("double")).alias(c) for c in columns))
    named = lambda day, before="", after="": F.concat(F.lit(f"{before}{day}_batch_CH"), (F.col("cell") + 1).cast("string"), F.lit(f"{after}.csv"))
    # a temporary file and one of another day for each cell, with the first samples of the batch
    others = F.explode(F.array(named("2024-01-24"), F.when(F.col("sample_idx") < 50, named("2024-01-24", "~")), F.when(F.col("sample_idx") < 50, named("2024-02-01")))).alias("file")
    named_files.write_csv(rows.select("*", others).filter("file is not null"), folder, "file", ["test_time", "sample_idx"], columns)
    about = {"iv_ch_id": F.col("cell"), "schedule_file_name": F.concat(F.lit("x\\a-b-"), F.col("cell").cast("string"), F.lit("_6c.sdu")), "databases": F.lit("one,two"), "item_id": F.concat(F.lit("EL"), F.col("cell").cast("string"), F.lit("50"))}
    fields = [c.split()[0] for c in schemas.METADATA.split(", ")]
    cells = own.select("cell").distinct().select(named("2024-01-24", after="_Metadata").alias("file"), *(about.get(c, F.lit(0)).alias(c) for c in fields))
    named_files.write_csv(cells, folder, "file", [], fields)
    return folder


@query(f"""WITH {SAMPLES_SQL} SELECT 'EL' || (unit % {_CELLS}) || '50' AS barcode, CAST(unit % {_CELLS} + 1 AS INTEGER) AS channel, (unit % {_CELLS}) || '_6C' AS policy, idx AS sample_idx, t AS test_time, value AS voltage,
  CAST(cycle % 3 AS INTEGER) AS cycle_idx FROM samples""")
def telemetry_cells(spark, sf_dir):
    """Every sample of a batch beside its cell's metadata, from CSV files paired by name."""
    folder = _telemetry_folder(spark, sf_dir)
    both = readers.cells(readers.telemetry(spark, folder, "2024-01-24"), readers.metadata(spark, folder, "2024-01-24"))
    return both.select("barcode", "channel", "policy", "sample_idx", "test_time", "voltage", "cycle_idx")


@query(f"""WITH {SAMPLES_SQL}, batch AS (SELECT unit, idx, t, cycle % 3 AS c, value, 'a' AS batch_date FROM samples WHERE unit % 2 = 0 UNION ALL SELECT unit, idx, t, cycle % 3, value, 'a' FROM samples WHERE unit = 1),
begun AS (SELECT *, max(CASE WHEN c = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY idx ROWS UNBOUNDED PRECEDING) AS go FROM batch)
SELECT unit AS file, idx AS sample_idx, value AS voltage, batch_date, CAST(NULL AS DOUBLE) AS internal_resistance, CAST(NULL AS DOUBLE) AS temperature FROM begun WHERE go = 1""")
def batch_corrections(spark, sf_dir):
    """A batch with a channel of another, cut at its first cycle 0, without the sensors that it had not."""
    own = samples(spark, sf_dir).select(F.col("unit").alias("file"), F.col("idx").alias("sample_idx"), (F.col("cycle") % 3).alias("cycle_idx"), F.col("value").alias("voltage"), F.lit(1.0).alias("temperature"), F.lit(1.0).alias("internal_resistance"))
    even, odd = (own.filter(F.col("file") % 2 == k).withColumn("batch_date", F.lit("ab"[k])) for k in (0, 1))
    whole = readers.from_first_cycle_zero(readers.borrowed(even, odd, "file", 1, "a"))
    return readers.without_sensors(whole).select("file", "sample_idx", "voltage", "batch_date", "internal_resistance", "temperature")


@query("""SELECT name FROM (SELECT DISTINCT p_brand AS name, dense_rank() OVER (ORDER BY p_brand) AS n FROM part) WHERE n NOT BETWEEN 5 AND 9""")
def file_subset(spark, sf_dir):
    return readers.without_positions(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct(), "name", 5, 9)


@query("""SELECT s_name AS batch_name, CASE s_nationkey WHEN 1 THEN '2018-01-01' WHEN 2 THEN '2018-02-02' END AS batch_date FROM supplier""")
def batch_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select("s_name", F.col("s_nationkey").cast("string").alias("batch_name"))
    return readers.with_batch_date(names, readers.batch_dates(spark, {"1": "2018-01-01", "2": "2018-02-02"})).select(F.col("s_name").alias("batch_name"), "batch_date")


@query("""WITH n AS (SELECT o_orderkey % 3 AS round, o_orderkey, o_custkey, o_totalprice FROM orders)
SELECT CAST(round AS INTEGER) AS round, o_orderkey / 1.0::DOUBLE AS c1, o_custkey / 1.0::DOUBLE AS c2, 1.5::DOUBLE AS c3, CAST(NULL AS DOUBLE) AS c4, CASE WHEN round < 2 THEN o_totalprice END AS life FROM n""")
def rounds_of_files(spark, sf_dir):
    """Headerless tables a round, whose numbers are in the names of the files; blanks are null, and the last round lacks its column."""
    folder = scratch(spark)
    k = F.col("o_orderkey") % 3
    rates = [(F.col("o_orderkey") / 1.0).alias("c1"), (F.col("o_custkey") / 1.0).alias("c2"), F.lit(1.5).alias("c3"), F.lit(None).cast("double").alias("c4")]
    line = F.when(k < 2, F.to_csv(F.struct(*rates, F.col("o_totalprice").alias("life")))).otherwise(F.to_csv(F.struct(*rates)))
    rows = table(spark, sf_dir, "orders").select(F.concat(k.cast("string"), F.lit(".csv")).alias("name"), F.concat(line, F.lit("\n")).cast("binary").alias("content"), "o_orderkey")
    named_files.write_contents(rows, folder, ["o_orderkey"])
    return readers.rounds(spark, folder)


@query("""SELECT p_brand || '.csv' AS file, nullif(p_size % 7, 0) AS life, count(*) AS n FROM part GROUP BY 1, 2""")
def lives_of_files(spark, sf_dir):
    """Files of one column without a header, a file a brand, with blank lines where a life is missing."""
    folder = scratch(spark)
    size = F.col("p_size") % 7
    line = F.concat(F.when(size > 0, size.cast("string")).otherwise(F.lit('""')), F.lit("\n"))
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".csv")).alias("name"), line.cast("binary").alias("content"), "p_partkey")
    named_files.write_contents(rows, folder, ["p_partkey"])
    found = readers.csv(spark, folder, schemas.LIVES, header=False).select(readers.file_name().alias("file"), "life")
    return found.groupBy("file", "life").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, printf('%.3f,%.3f', p_retailprice, p_size::DOUBLE) AS line FROM part""")
def fixed_precision_lines(spark, sf_dir):
    path = scratch(spark)
    part = table(spark, sf_dir, "part")
    sinks.fixed_csv(part.select("p_partkey", "p_retailprice", "p_size"), path)
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.select(F.split_part("line", F.lit("."), F.lit(1)).cast("long").alias("id"), F.substring_index("line", ",", -2).alias("line"))


@query("""WITH u AS (SELECT c_custkey, c_name, list({'k': o_orderkey, 'v': o_totalprice} ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL) AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_custkey, c_name, CAST(len(l) AS INTEGER) AS n, l[1].v AS first, l[-1].v AS last FROM u""")
def nested_orders(spark, sf_dir):
    """Units with their rows nested, written and read again."""
    path = scratch(spark)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    sinks.nested(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_orderkey").write.parquet(path)
    cycles = F.col("cycles")
    return spark.read.parquet(path).select("c_custkey", "c_name", F.when(cycles.isNotNull(), F.size(cycles)).alias("n"), F.get(cycles, 0)["o_totalprice"].alias("first"), F.element_at(cycles, -1)["o_totalprice"].alias("last"))


@query("""SELECT CAST(s_nationkey % 3 AS INTEGER) AS round, s_suppkey, s_acctbal FROM supplier WHERE s_nationkey % 3 < 2""")
def state_of_rounds(spark, sf_dir):
    """The states of all rounds before the third; a round that is written again replaces itself."""
    root = scratch(spark)
    supplier = table(spark, sf_dir, "supplier")
    for k in (0, 1, 2, 1):
        sinks.save_state(supplier.filter(F.col("s_nationkey") % 3 == k).select("s_suppkey", "s_acctbal"), root, k)
    return sinks.load_state(spark, root, before=2).select("round", "s_suppkey", "s_acctbal")


@query("""SELECT r_name AS run, max(n_nationkey) / 1.0::DOUBLE AS l1, CASE WHEN r_regionkey < 3 THEN min(n_nationkey) / 1.0::DOUBLE END AS l2 FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey""")
def run_log(spark, sf_dir):
    """A row a run and a column a round, from a log that rounds are added to one by one."""
    root = scratch(spark)
    runs = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("run"), "r_regionkey").agg(F.max("n_nationkey").alias("a"), F.min("n_nationkey").alias("b"))
    sinks.append_log(runs.select("run", F.lit(0).alias("round"), F.lit(-1.0).alias("life")), root)
    sinks.append_log(runs.select("run", F.lit(0).alias("round"), F.col("a").alias("life")), root)
    sinks.append_log(runs.filter("r_regionkey < 3").select("run", F.lit(1).alias("round"), F.col("b").alias("life")), root)
    return sinks.read_log(spark, root, 2)


@query("""SELECT p_name AS name, CAST(row_number() OVER (ORDER BY CASE WHEN contains(p_name, 'summary') THEN 0 ELSE 1 END, p_name) AS INTEGER) AS place FROM (
  SELECT DISTINCT p_brand || CASE WHEN p_size % 4 = 0 THEN ' summary' ELSE ' detail' END AS p_name FROM part)""")
def report_order(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat("p_brand", F.when(F.col("p_size") % 4 == 0, " summary").otherwise(" detail")).alias("name")).distinct()
    ordered = sinks.summaries_first(names).coalesce(1)
    return ordered.select("name", F.monotonically_increasing_id().alias("at")).select("name", (F.row_number().over(Window.orderBy("at"))).alias("place"))


_SCORED = """scored AS (SELECT *, p_size || '.6-4.8-' || (p_size % 9) || '.25-3.611' AS policy, 'EL' || p_partkey || '00' AS barcode FROM part)"""


def _scored(spark, sf_dir):
    s = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        F.concat(s, F.lit(".6-4.8-"), (F.col("p_size") % 9).cast("string"), F.lit(".25-3.611")).alias("policy"), F.col("p_retailprice").alias("shown"), (F.col("p_retailprice") - 10.5).alias("low"),
        (F.col("p_retailprice") + 10.5).alias("high"), F.col("p_size").alias("life"), (F.col("p_partkey") % 48).alias("channel"), F.concat(F.lit("EL"), F.col("p_partkey").cast("string"), F.lit("00")).alias("barcode"),
    )


_NUMBERS = "round(p_retailprice) AS Prediction, round(p_retailprice - 10.5) AS CI_Lo, round(p_retailprice + 10.5) AS CI_Hi, p_size AS Lifetime, p_partkey % 48 AS Channel, CAST(substr(barcode, 3) AS BIGINT) AS Barcode"


@query(f"WITH {_SCORED} SELECT " + ", ".join(f"CAST(split_part(policy, '-', {k}) AS DOUBLE) AS C{k}" for k in range(1, 5)) + f", {_NUMBERS} FROM scored")
def export_by_rates(spark, sf_dir):
    return features.export(_scored(spark, sf_dir), by_rates=True)


@query(f"WITH {_SCORED} SELECT {_NUMBERS}, policy AS Policy FROM scored")
def export_by_name(spark, sf_dir):
    """Written with its display names and read again."""
    path = scratch(spark)
    own = features.export(_scored(spark, sf_dir), by_rates=False)
    sinks.display_csv(own, path, "table.csv", own.columns, ["Policy", "Barcode"])
    return rounded(readers.csv(spark, path, "Channel long, Barcode long, Lifetime int, Prediction double, CI_Lo double, CI_Hi double, Policy string"))


@query("""SELECT 'nation' AS sheet, n_nationkey AS key, n_name AS name, n_regionkey / 1.0::DOUBLE AS parent FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, NULL FROM region""")
def workbook_of_two_sheets(spark, sf_dir):
    """A workbook with a sheet for each table, written and read again."""
    folder = scratch(spark)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    workbooks.write(workbooks.as_cells(nation, "places.xlsx", "nation", ["n_nationkey"]).union(workbooks.as_cells(region, "places.xlsx", "region", ["r_regionkey"])), folder)
    found = workbooks.cells(spark, folder)
    one = workbooks.sheet(found, "nation", "key long, name string, parent double")
    two = workbooks.sheet(found, "region", "key long, name string").withColumn("parent", F.lit(None).cast("double"))
    return one.select(F.lit("nation").alias("sheet"), "key", "name", "parent").union(two.select(F.lit("region"), "key", "name", "parent"))


@query("""SELECT s_nationkey || '.xlsx' AS file, s_suppkey, s_name, s_acctbal FROM supplier""")
def workbooks_of_a_key(spark, sf_dir):
    """A workbook for each nation's suppliers, all written in one job."""
    folder = scratch(spark)
    own = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    file = F.concat(F.col("s_nationkey").cast("string"), F.lit(".xlsx"))
    workbooks.write(workbooks.as_cells(own, file, "suppliers", ["s_suppkey"]), folder)
    found = workbooks.sheet(workbooks.cells(spark, folder), "suppliers", "s_nationkey long, s_suppkey long, s_name string, s_acctbal double")
    return found.select("file", "s_suppkey", "s_name", "s_acctbal")
