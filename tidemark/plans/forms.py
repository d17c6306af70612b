"""Queries over scalar forms, variants of curves and features, and the parts of a selection round."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import bandit, curves, evaluate, features, ordered, series
from .policies import _GRID, _grid
from .tables import DAILY_SQL, ORDER, SAMPLES_SQL, daily, rounded, samples, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""WITH n AS (SELECT p_partkey AS id, p_size AS s, p_retailprice AS p, p_size / 10.0::DOUBLE + 1 AS a FROM part)
SELECT id, round(p / 1.1::DOUBLE, 6) AS rate, round_even(s / 100.0::DOUBLE * 1.1::DOUBLE, 4) AS charge, nullif(s % 3, 0) AS third, CASE WHEN s - 25 < 0 THEN 1 ELSE s - 25 END AS life,
  round((p - s) / 2.5::DOUBLE, 6) AS sigma, CAST(ceil((s - 0.0) / (51.0 - 0.0) * 64) AS BIGINT) AS bucket, TRUE AS near,
  round(0.6 * (80 - 40.0) / (12.1 - 0.6 * 40.0 / a), 6) AS second, regexp_extract(upper('x\a-' || s || '_6c-' || s || 'c_1.sdu'), '^.*-([^.]*)\.', 1) AS schedule,
  replace(replace(replace(s || '_6c-35per.3_6c', '_', '.'), '-', '('), 'per.', '%)-') AS plain,
  replace(s || '.5C_35per_3.6C', '.', '_') AS two_step, replace(s || '.5C_35per_3.6C_60per_4.0C', '.', '_') AS three_step, '2018_' || s || '.csv' AS data_file
FROM n""")
def scalar_forms(spark, sf_dir):
    s, p = F.col("p_size"), F.col("p_retailprice")
    t, half, three, four = s.cast("string"), F.concat(s.cast("string"), F.lit(".5")), F.lit("3.6"), F.lit("4.0")
    path = F.concat(F.lit("x\\a-"), t, F.lit("_6c-"), t, F.lit("c_1.sdu"))
    return rounded(table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), scalars.current_to_rate(p).alias("rate"), scalars.percent_to_charge(s.cast("double")).alias("charge"), scalars.zero_to_null(s % 3).alias("third"), scalars.floor_life(s - 25).alias("life"),
        scalars.sigma_of_bound(p, s, 2.5).alias("sigma"), scalars.colour_bucket(s, F.lit(1.0), F.lit(50.0)).alias("bucket"), (F.abs(scalars.jitter(p) - p) <= 0.1000001).alias("near"),
        scalars.second_for_minutes(F.lit(12.1), s / 10 + 1, F.lit(40.0)).alias("second"), text.schedule_policy(path).alias("schedule"), text.readable_plain(F.concat(t, F.lit("_6c-35per.3_6c"))).alias("plain"),
        text.two_step_file(half, F.lit("35"), three).alias("two_step"), text.three_step_file(half, F.lit("35"), three, F.lit("60"), four).alias("three_step"), text.data_file_of_metadata(F.concat(F.lit("2018_"), t, F.lit("_Metadata.csv"))).alias("data_file"),
    ))


@query(f"""WITH {SAMPLES_SQL} SELECT idx, unit, round(-((t - first_value(t) OVER w) / 60) / 60 * value * 1.1::DOUBLE, 6) + 0.0 AS charge FROM samples WINDOW w AS (PARTITION BY unit ORDER BY t, idx)""")
def charge_from_time(spark, sf_dir):
    own = samples(spark, sf_dir).withColumn("minutes", series.elapsed_minutes("t", ["unit"], ORDER))
    return rounded(own.select("idx", "unit", curves.charge_from_minutes("minutes", F.col("value"), ["unit"], ORDER).alias("charge")))


@query(f"""WITH {SAMPLES_SQL}, near AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t, idx) AS n, count(*) OVER (PARTITION BY unit) AS total FROM samples WHERE abs(value / 10 + -4) < 0.9
), stop AS (SELECT unit, arg_min(n, (value, n)) AS stop FROM near WHERE n <= total - 2 GROUP BY unit)
SELECT idx, unit, value FROM near JOIN stop USING (unit) WHERE n <= stop""")
def plateau_fixed(spark, sf_dir):
    tenth = samples(spark, sf_dir).withColumn("tenth", F.col("value") / 10)
    return curves.plateau(tenth, "tenth", F.lit(4.0), "value", ["unit"], ORDER, tolerance=0.9).select("idx", "unit", "value")


@query(f"""WITH {DAILY_SQL}, marked AS (SELECT *, max(CASE WHEN q < 15 THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY k ROWS UNBOUNDED PRECEDING) AS under FROM daily),
scale AS (SELECT min(q) AS low, max(q) AS high FROM daily)
SELECT unit, k, round(q, 6) AS q, round(low, 6) AS low, round(high, 6) AS high FROM marked, scale WHERE under = 0""")
def cycles_before_crossing(spark, sf_dir):
    """The cycles before the first under a limit, on the scale of all cycles of all units."""
    return rounded(series.before_crossing(evaluate.shared_range(daily(spark, sf_dir), "q"), "q", ["unit"], ["k"], 15.0).select("unit", "k", "q", "low", "high"))


@query("SELECT l_suppkey, round(sum(l_quantity * l_quantity + l_discount * l_discount), 4) AS square_sum FROM lineitem GROUP BY l_suppkey")
def square_sums(spark, sf_dir):
    return rounded(evaluate.square_sum(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity", "l_discount"]), 4)


@query("""SELECT l_suppkey AS key, count(l_quantity) AS n, round_even(round(avg(l_quantity), 6), 0) AS mean, round_even(round(stddev_pop(l_quantity), 6), 0) AS deviation,
  round_even(round(1.96 * stddev_pop(l_quantity) / sqrt(count(l_quantity)), 6), 0) AS half_width FROM lineitem GROUP BY l_suppkey""")
def replicate_stats_by_number(spark, sf_dir):
    return evaluate.replicate_stats(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), "l_quantity"), ["key"], "l_quantity", divisor=None)


def _repair_sql(source: str, out: str, wrong: str) -> str:
    """SQL of one clock repair from the first wrong row of a unit on."""
    w = "OVER (PARTITION BY unit ORDER BY n)"
    return f"""{out}_seen AS (SELECT *, count(*) FILTER (WHERE {wrong}) OVER (PARTITION BY unit ORDER BY n ROWS UNBOUNDED PRECEDING) AS wrong, lag(clock) {w} - clock AS step FROM {source}
), {out}_shift AS (SELECT unit, first(step ORDER BY n) AS shift FROM {out}_seen WHERE {wrong} AND wrong = 1 GROUP BY unit
), {out} AS (SELECT idx, unit, n, CASE WHEN wrong > 0 THEN clock + coalesce(shift, 0) ELSE clock END AS clock FROM {out}_seen LEFT JOIN {out}_shift USING (unit))"""


@query(f"""WITH {SAMPLES_SQL}, raw AS (SELECT idx, unit, row_number() OVER (PARTITION BY unit ORDER BY t, idx) AS n FROM samples),
broken AS (SELECT *, CASE WHEN n BETWEEN 4 AND 5 THEN n - 50.0 WHEN n >= 7 THEN n + 500.0 ELSE n / 1.0 END::DOUBLE AS clock FROM raw), {_repair_sql("broken", "once", "clock < 0")}, {_repair_sql("once", "twice", "clock > 100")}
SELECT idx, unit, round(clock, 4) AS clock FROM twice""")
def clock_repaired_twice(spark, sf_dir):
    n = F.row_number().over(series.along(["unit"], ORDER))
    own = samples(spark, sf_dir).select("idx", "unit", n.alias("n"))
    broken = own.withColumn("clock", F.when(F.col("n").between(4, 5), F.col("n") - 50.0).when(F.col("n") >= 7, F.col("n") + 500.0).otherwise(F.col("n") / 1.0))
    return rounded(series.repair_clock_twice(broken, "clock", ["unit"], ["n"]).select("idx", "unit", "clock"), 4)


@query(f"""WITH {DAILY_SQL}, own AS (SELECT unit, cycle AS k, q FROM daily WHERE cycle <= 18)
SELECT unit, round(max(q) FILTER (WHERE k = 18), 6) AS f3, round(regr_slope(q, k) FILTER (WHERE k BETWEEN 2 AND 18), 6) AS f4, round(regr_slope(q, k) FILTER (WHERE k BETWEEN 15 AND 18), 6) + 0.0 AS f6 FROM own GROUP BY unit HAVING max(q) FILTER (WHERE k = 18) IS NOT NULL""")
def features_of_a_shorter_life(spark, sf_dir):
    """Features with an earlier cutoff, of which the tail begins where it does in the whole ones."""
    days = daily(spark, sf_dir).withColumn("k", F.col("cycle"))
    curve = samples(spark, sf_dir).filter(F.col("cycle").isin(5, 18)).groupBy("unit", F.col("cycle").alias("k"), (F.floor(F.col("t") / 3600) % 24).cast("int").alias("g")).agg(F.avg("value").alias("q")).withColumn("v", F.col("g") / 1.0)
    return rounded(features.unit_features(days, curve, "unit", "k", "q", "g", "v", "q", early=5, tail=15, cutoff=18).select("unit", "f3", "f4", "f6"))


def _farthest_sql(picks: int) -> str:
    square = lambda b: f"list_sum(list_transform(generate_series(1, len(v.e)), lambda k: (v.e[k] - {b}[k]) * (v.e[k] - {b}[k])))"
    parts = ["v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)", "p0 AS (SELECT vec_id, e, list_sum(list_transform(e, lambda x: x * x)) AS d FROM v ORDER BY d DESC, vec_id LIMIT 1)"]
    for k in range(1, picks):
        nearest = ", ".join(["list_sum(list_transform(v.e, lambda x: x * x))", *(square(f"p{j}.e") for j in range(k))])
        others = " AND ".join(f"v.vec_id <> p{j}.vec_id" for j in range(k))
        parts.append(f"p{k} AS (SELECT v.vec_id, v.e, least({nearest}) AS d FROM v, {', '.join(f'p{j}' for j in range(k))} WHERE {others} ORDER BY d DESC, v.vec_id LIMIT 1)")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS pick, vec_id, round(d, 4) AS distance FROM p{k}" for k in range(picks))


SQL["farthest_point"] = _farthest_sql(6)


@query("""WITH RECURSIVE b AS (SELECT l_returnflag AS experiment, l_suppkey AS arm_id, max(l_quantity) AS upper, avg(l_quantity) AS lower FROM lineitem GROUP BY 1, 2
), top AS (SELECT experiment, max(upper) AS first, arg_max(arm_id, (upper, -arm_id)) AS best FROM b GROUP BY 1), second AS (SELECT b.experiment, max(upper) AS second FROM b JOIN top ON b.experiment = top.experiment AND arm_id <> best GROUP BY 1
), arm AS (SELECT b.experiment, {'gap': CASE WHEN arm_id = best THEN second ELSE first END - lower, 'id': arm_id, 'upper': upper, 'width': upper - lower} AS a FROM b JOIN top USING (experiment) JOIN second USING (experiment)
), state AS (SELECT experiment, CAST(-1 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS arm_id, list(a) AS free FROM arm GROUP BY experiment
  UNION ALL
  SELECT experiment, place + 1, pick, list_filter(free, lambda x: x.id <> pick) FROM (
    SELECT *, CASE WHEN rival IS NULL OR best.width >= rival.width THEN best.id ELSE rival.id END AS pick FROM (
      SELECT *, list_filter(free, lambda x: x.id = list_sort(list_transform(list_filter(free, lambda y: y.id <> best.id), lambda y: {'u': -y.upper, 'id': y.id}))[1].id)[1] AS rival FROM (
        SELECT *, list_sort(free)[1] AS best FROM state WHERE place < 7)))
) SELECT experiment, arm_id, place FROM state WHERE place >= 0""")
def batch_choice(spark, sf_dir):
    """The next batch of each experiment from given bounds."""
    bounds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("experiment"), F.col("l_suppkey").alias("arm_id")).agg(F.max("l_quantity").alias("upper"), F.avg("l_quantity").alias("lower"))
    return bandit.choose_batches(bounds, "experiment", 8)


@query(f"""WITH {_GRID}, o AS (SELECT r_regionkey AS experiment, max(s_acctbal) AS yp, min(s_acctbal) AS yq FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1
), n AS (SELECT count(*) AS n FROM grid), arm AS (SELECT row_number() OVER (ORDER BY position) - 1 AS arm_id, c1, c2, c3 FROM grid
), pair AS (SELECT experiment, (experiment * 7 + 3) % n AS p, (experiment * 7 + 40) % n AS q, yp / 10 AS yp, yq / 10 AS yq FROM o, n
), k AS (SELECT experiment, a.arm_id, yp - 947 AS yp, yq - 947 AS yq, exp(-((a.c1 - x.c1) ** 2 + (a.c2 - x.c2) ** 2 + (a.c3 - x.c3) ** 2)) * 26896 AS kp, exp(-((a.c1 - z.c1) ** 2 + (a.c2 - z.c2) ** 2 + (a.c3 - z.c3) ** 2)) * 26896 AS kq,
    exp(-((z.c1 - x.c1) ** 2 + (z.c2 - x.c2) ** 2 + (z.c3 - x.c3) ** 2)) * 26896 AS o, 53792.0::DOUBLE AS g FROM pair JOIN arm AS x ON x.arm_id = p JOIN arm AS z ON z.arm_id = q, arm AS a
), g AS (SELECT experiment, arm_id, (kp * (g * yp - o * yq) + kq * (g * yq - o * yp)) / (g * g - o * o) AS mean, 26896 - (kp * (g * kp - o * kq) + kq * (g * kq - o * kp)) / (g * g - o * o) AS var FROM k)
, m AS (SELECT experiment, arm_id, round_even(mean + 2.5 * sqrt(greatest(var, 0)), 4) AS u, round_even(mean - 2.5 * sqrt(greatest(var, 0)), 4) AS l FROM g)
SELECT experiment, arm_id, round(u + 947, 6) AS upper, round(l + 947, 6) AS lower, round((u + l) / 2 + 947, 6) AS mean FROM m""")
def bandit_posterior(spark, sf_dir):
    """Bounds and means of all arms after a round in which each region's greatest and least balance were the outcomes, which SQL solves as a system of two."""
    grid = ordered.scan(ordered.chunked(_grid(spark, sf_dir), [], ["position"]), [], ["position"], number="n").select((F.col("n") - 1).alias("arm_id"), F.array("c1", "c2", "c3").alias("point"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    ends = nations.groupBy(F.col("n_regionkey").alias("experiment")).agg((F.max("s_acctbal") / 10).alias("high"), (F.min("s_acctbal") / 10).alias("low"))
    size = grid.agg(F.count("*").alias("size"))
    outcome = lambda shift, c: F.struct(((F.col("experiment") * 7 + shift) % F.col("size")).alias("arm_id"), F.col(c).alias("outcome"))
    seen = ends.crossJoin(F.broadcast(size)).select("experiment", F.inline(F.array(outcome(3, "high"), outcome(40, "low")))).join(grid, "arm_id")  # one row
    arms = ends.select("experiment").crossJoin(F.broadcast(grid))  # the grid has AXIS values an axis at most
    return rounded(bandit.arm_bounds(arms, seen, bandit.Settings(), 1), 6)
