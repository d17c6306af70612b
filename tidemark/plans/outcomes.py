"""Queries that evaluate outcomes: replicates, errors, ranks, sensitivity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, ordered, policy, rollup, series
from .tables import rounded, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT p_type, count(*) AS n_units, arg_min(p_size, p_partkey) AS p_size, round(avg(p_retailprice), 4) AS mean_p_retailprice FROM part GROUP BY p_type""")
def policy_rollup(spark, sf_dir):
    return rounded(rollup.policy_rollup(table(spark, sf_dir, "part"), "p_type", "p_partkey", ["p_size"], ["p_retailprice"]), 4)


_WIDE = "wide AS (SELECT l_orderkey AS key, " + ", ".join(f"max(l_extendedprice) FILTER (WHERE l_linenumber = {k}) AS r{k}" for k in range(1, 6)) + " FROM lineitem GROUP BY l_orderkey)"


@query(f"""WITH {_WIDE}, tall AS (SELECT key, unnest([r1, r2, r3, r4, r5]) AS value FROM wide)
SELECT key, count(value) AS n, round_even(round(avg(value), 6), 0) AS mean, round_even(round(stddev_pop(value), 6), 0) AS deviation, round_even(round(1.96 * stddev_pop(value) / sqrt(5.0::DOUBLE), 6), 0) AS half_width FROM tall WHERE value IS NOT NULL GROUP BY key""")
def replicate_stats(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).pivot("l_linenumber", [1, 2, 3, 4, 5]).agg(F.max("l_extendedprice")).toDF("key", "r1", "r2", "r3", "r4", "r5")
    return evaluate.replicate_stats(evaluate.long_replicates(wide, ["key"], ["r1", "r2", "r3", "r4", "r5"]), ["key"], "value")


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_extendedprice, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem)
SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_extendedprice), 4) AS mean_life, round(stddev_samp(l_extendedprice), 4) AS std_life, round(avg(r), 6) AS mean_rank, min(r) AS min_rank, max(r) AS max_rank FROM g GROUP BY 1, 2, 3""")
def group_sensitivity(spark, sf_dir):
    ranked = table(spark, sf_dir, "lineitem").withColumn("r", F.rank().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"))).cast("long"))
    out = evaluate.sensitivity(ranked, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice", "r")
    return out.select("l_returnflag", "l_linestatus", "l_linenumber", F.round("mean_life", 4).alias("mean_life"), F.round("std_life", 4).alias("std_life"), F.round("mean_rank", 6).alias("mean_rank"), "min_rank", "max_rank")


@query("""WITH v AS (SELECT CAST(l_quantity AS INTEGER) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT q, CAST(coalesce(sum(n) OVER (ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM v""")
def rank_lookup(spark, sf_dir):
    return evaluate.rank_of_value(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("q")), "q")


@query("""WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, count(c_custkey) AS n FROM (SELECT unnest(generate_series(0, 60)) AS b) LEFT JOIN n ON n.n = b GROUP BY b""")
def repetition_histogram(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") / 1.0).alias("c_custkey"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") / 1.0).alias("c_custkey"))
    return evaluate.count_histogram(policy.repetitions(customers, orders, ["c_custkey"]), "n", 60)


@query("""WITH b AS (SELECT least(CAST(floor((l_extendedprice - 600) / 600) AS INTEGER) + 1, 12) AS bin FROM lineitem WHERE l_extendedprice BETWEEN 600 AND 7800)
SELECT CAST(k AS INTEGER) AS bin, count(b.bin) AS n FROM (SELECT unnest(generate_series(1, 12)) AS k) LEFT JOIN b ON b.bin = k GROUP BY k""")
def value_histogram(spark, sf_dir):
    return evaluate.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 600.0, 7800.0, 12)


_PAIRS = "pairs AS (SELECT o_orderpriority AS g, o_orderkey AS id, o_totalprice AS a, p FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON l_orderkey = o_orderkey)"


def _pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("p"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a")).join(lines, "id", "left")


@query(f"""WITH {_PAIRS}, m AS (SELECT g, avg(a) - avg(p) AS shift FROM pairs GROUP BY g), e AS (SELECT pairs.*, shift, p - a AS d, p + shift - a AS s FROM pairs JOIN m USING (g))
SELECT g, round(sqrt(avg(d * d)), 4) AS rmse, round(avg(abs(d) / a) * 100, 4) AS mape, round(any_value(shift), 4) AS shift, round(sqrt(avg(s * s)), 4) AS shifted_rmse, round(avg(abs(s) / a) * 100, 4) AS shifted_mape,
  round(corr(p, a), 4) AS pearson FROM e GROUP BY g""")
def error_metrics(spark, sf_dir):
    return rounded(evaluate.error_metrics(_pairs(spark, sf_dir), "p", "a", ["g"]), 4)


@query(f"""WITH {_PAIRS}, m AS (SELECT avg(a) - avg(p) AS shift FROM pairs), e AS (SELECT pairs.*, shift, p - a AS d, p + shift - a AS s FROM pairs, m)
SELECT round(sqrt(avg(d * d)), 4) AS rmse, round(avg(abs(d) / a) * 100, 4) AS mape, round(any_value(shift), 4) AS shift, round(sqrt(avg(s * s)), 4) AS shifted_rmse, round(avg(abs(s) / a) * 100, 4) AS shifted_mape, round(corr(p, a), 4) AS pearson FROM e""")
def error_metrics_overall(spark, sf_dir):
    return rounded(evaluate.error_metrics(_pairs(spark, sf_dir), "p", "a"), 4)


@query(f"""WITH {_PAIRS}, w AS (SELECT avg(s) AS sw FROM (SELECT g, stddev_pop(a) AS s FROM pairs GROUP BY g)), o AS (SELECT avg(a) AS mean, stddev_pop(a) AS sigma, stddev_pop(p - a) AS r FROM pairs)
SELECT round(mean, 3) AS mean, round(sigma, 3) AS sigma, round(r, 3) AS sigma_residual, round(sw, 3) AS sigma_within, round(sqrt(greatest(sigma * sigma - sw * sw, 0)), 3) AS eta FROM o, w""")
def spread_parts(spark, sf_dir):
    return rounded(evaluate.spread_parts(_pairs(spark, sf_dir), ["g"], "a", "p"), 3)


@query("""WITH line AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, o_totalprice AS p, v, o_orderpriority AS g FROM orders JOIN line ON k = o_orderkey),
whole AS (SELECT NULL::VARCHAR AS g, sum(sign(x.p - y.p) * sign(x.v - y.v)) AS s, sum(abs(sign(x.p - y.p))) AS a, sum(abs(sign(x.v - y.v))) AS b FROM o AS x JOIN o AS y ON x.k < y.k),
parts AS (SELECT x.g, sum(sign(x.p - y.p) * sign(x.v - y.v)) AS s, sum(abs(sign(x.p - y.p))) AS a, sum(abs(sign(x.v - y.v))) AS b FROM o AS x JOIN o AS y ON x.g = y.g AND x.k < y.k GROUP BY x.g)
SELECT g, round(s / sqrt(a::DOUBLE * b), 6) AS tau FROM (SELECT * FROM whole UNION ALL SELECT * FROM parts)""")
def kendall_tau(spark, sf_dir):
    """Rank correlation of an order's total and the sum of its lines: over all orders (a null g) and in each priority."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    both = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.col("o_orderpriority").alias("g"), "o_totalprice", "v")
    overall = evaluate.kendall(both, "o_totalprice", "v").select(F.lit(None).cast("string").alias("g"), "tau")
    return rounded(overall.union(evaluate.kendall(both, "o_totalprice", "v", ["g"])))


@query("""WITH f AS (SELECT l_linenumber AS g, l_quantity AS x, l_discount AS y, count(*)::HUGEINT AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT a.g, round(sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(a.n * b.n * abs(sign(a.x - b.x)))::DOUBLE * sum(a.n * b.n * abs(sign(a.y - b.y)))), 6) AS tau FROM f AS a JOIN f AS b USING (g) GROUP BY a.g""")
def kendall_tau_with_ties(spark, sf_dir):
    """Of quantity and discount, which have few values each, in every line number."""
    return rounded(evaluate.kendall(table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "g"), "l_quantity", "l_discount", ["g"]))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS place,
  (rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0)::DOUBLE AS average FROM lineitem""")
def rank_kinds(spark, sf_dir):
    """Both ranks of every line by quantity, which has fifty values."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return ordered.ranked(lines, "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "place", "average")


@query("""WITH monthly AS (SELECT p_brand AS b, CAST(year(l_shipdate) AS INTEGER) AS y, sum(l_extendedprice) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2
), moved AS (SELECT *, lead(v) OVER (PARTITION BY b ORDER BY y) - v AS change, 100 * (lead(v) OVER (PARTITION BY b ORDER BY y) - v) / lead(v) OVER (PARTITION BY b ORDER BY y) AS pct FROM monthly
), ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, b) AS r FROM moved WHERE change IS NOT NULL)
SELECT y, CAST(top AS INTEGER) AS top, round(avg(abs(change)), 3) AS mean_change, round(avg(abs(pct)), 4) AS mean_percent FROM ranked, (SELECT unnest([5, 10, 50, 224]) AS top) WHERE r <= top GROUP BY y, top""")
def topk_change(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    yearly = lines.groupBy(F.col("p_brand").alias("b"), F.year("l_shipdate").alias("y")).agg(F.sum("l_extendedprice").alias("v"))
    moved = series.next_change(yearly, ["b"], "y", "v").withColumn("r", evaluate.unique_rank("v", ["y"], "b"))
    out = evaluate.top_change(moved, "r", "change", "percent_change", keys=["y"])
    return out.select("y", "top", F.round("mean_change", 3).alias("mean_change"), F.round("mean_percent", 4).alias("mean_percent"))


@query("""SELECT c_custkey, """ + ", ".join(f"max(v) FILTER (WHERE y = {y}) AS r{y}" for y in (1995, 1996, 1997)) + """ FROM customer LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS y, max(o_totalprice) AS v FROM orders GROUP BY 1, 2) ON o_custkey = c_custkey GROUP BY c_custkey""")
def round_pivot(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select((F.col("o_custkey") / 1.0).alias("c_custkey"), F.year("o_orderdate").alias("y"), "o_totalprice")
    return policy.by_round(table(spark, sf_dir, "customer").select("c_custkey"), seen, ["c_custkey"], "y", "o_totalprice", [1995, 1996, 1997])


@query("""WITH f AS (SELECT l_returnflag, l_linenumber, regr_slope(l_extendedprice, l_quantity) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, count(*) AS n_fits, round(regr_slope(ln(s), 1.0::DOUBLE / l_linenumber), 4) AS slope, round(regr_intercept(ln(s), 1.0::DOUBLE / l_linenumber), 4) AS intercept FROM f WHERE s > 0 GROUP BY 1""")
def two_level_fit(spark, sf_dir):
    return rounded(evaluate.two_level_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_quantity", "l_extendedprice"), 4)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) AS n FROM lineitem), f AS (
  SELECT l_suppkey, l_linenumber, regr_slope(l_extendedprice, l_quantity) AS s FROM n WHERE NOT (n = 1 AND l_linenumber >= 2) GROUP BY 1, 2)
SELECT l_linenumber, round(avg(s), 3) AS mean_slope, round(stddev_pop(s), 3) AS std_slope FROM f GROUP BY 1""")
def mean_fit(spark, sf_dir):
    return rounded(evaluate.mean_fit(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", ["l_orderkey", "l_partkey", "l_extendedprice"]), 3)


@query("SELECT l_shipdate::DATE AS day, round(avg(l_quantity), 4) AS mean, round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity), 4) AS low, round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity), 4) AS high FROM lineitem GROUP BY 1")
def confidence_band(spark, sf_dir):
    return rounded(evaluate.band(table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate")), ["day"], "l_quantity"), 4)
