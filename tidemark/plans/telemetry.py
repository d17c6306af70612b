"""Queries over samples and cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves, features, rollup, series, smoothing
from .tables import DAILY_SQL, ORDER, SAMPLES_SQL, daily, rounded, samples

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {SAMPLES_SQL}, inside AS (
  SELECT *, dense_rank() OVER (PARTITION BY unit ORDER BY cycle) AS k FROM (
    SELECT *, min(cycle) OVER (PARTITION BY unit) AS low, max(cycle) OVER (PARTITION BY unit) AS high FROM samples) WHERE cycle > low AND cycle < high)
SELECT unit, CAST(k AS INTEGER) AS k, cycle, max(value) AS qcharge, max(value * value) AS qdischarge, max(value) AS tmax, min(value) AS tmin, round(avg(value), 6) AS tavg,
  arg_max(value, (t, idx)) AS ir FROM inside GROUP BY unit, k, cycle""")
def cycle_summary(spark, sf_dir):
    squared = samples(spark, sf_dir).withColumn("square", F.col("value") * F.col("value"))
    cycles = rollup.cycle_summary(squared, ["unit", "cycle"], ORDER, "value", "square", "value", "value")
    return series.inner(cycles).withColumn("tavg", F.round("tavg", 6))


@query(f"""WITH {SAMPLES_SQL} SELECT idx, unit, cycle, round((t - first_value(t) OVER w) / 60, 6) AS minutes, round(value - first_value(value) OVER w, 6) AS change,
  round(CASE WHEN first_value(value) OVER w <> 0 THEN value / first_value(value) OVER w END, 6) AS share
FROM samples WINDOW w AS (PARTITION BY unit, cycle ORDER BY t, idx)""")
def elapsed_in_cycle(spark, sf_dir):
    keys = ["unit", "cycle"]
    return rounded(samples(spark, sf_dir).select(
        "idx", *keys, series.elapsed_minutes("t", keys, ORDER).alias("minutes"), series.from_first("value", keys, ORDER).alias("change"), series.share_of_first("value", keys, ORDER).alias("share")
    ))


@query(f"""WITH {SAMPLES_SQL}, broken AS (
  SELECT *, t - first_value(t) OVER w - CASE WHEN row_number() OVER w >= 4 THEN 1000000 ELSE 0 END AS clock FROM samples WINDOW w AS (PARTITION BY unit ORDER BY t, idx)
), marked AS (
  SELECT *, last_value(clock) OVER (PARTITION BY unit ORDER BY t, idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
    lag(clock) OVER w - clock AS step, count(*) FILTER (WHERE clock < 0) OVER (PARTITION BY unit ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS wrong FROM broken WINDOW w AS (PARTITION BY unit ORDER BY t, idx)
), shifted AS (SELECT unit, first(step ORDER BY t, idx) AS shift FROM marked WHERE clock < 0 AND wrong = 1 GROUP BY unit)
SELECT idx, unit, round(CASE WHEN last < 0 AND wrong > 0 THEN clock + coalesce(shift, 0) ELSE clock END, 4) AS clock FROM marked LEFT JOIN shifted USING (unit)""")
def negative_gap_repair(spark, sf_dir):
    w = series.along(["unit"], ORDER)
    start = F.first("t").over(series.so_far(["unit"], ORDER))
    broken = samples(spark, sf_dir).withColumn("clock", F.col("t") - start - F.when(F.row_number().over(w) >= 4, 1000000).otherwise(0))
    return rounded(series.repair_if_negative_end(broken, "clock", ["unit"], ORDER).select("idx", "unit", "clock"), 4)


_CLEAN = """first_row, s, CASE WHEN first_row THEN 0 WHEN s IS NULL OR abs(s) >= 50 THEN 0 WHEN s >= 0 THEN NULL WHEN value <= 2 THEN 0 ELSE s END AS a,
  CASE WHEN first_row OR s IS NULL THEN 0 WHEN s < 0 THEN NULL WHEN s >= 25 OR value >= top - 0.001 THEN 0 WHEN s = 0 THEN NULL WHEN value <= 2.5 THEN 0 ELSE s END AS b"""


@query(f"""WITH {SAMPLES_SQL}, sloped AS (
  SELECT *, lag(1) OVER w IS NULL AS first_row, max(value) OVER (PARTITION BY unit) AS top,
    CASE WHEN lag(1) OVER w IS NULL THEN 0 WHEN value - lag(value) OVER w <> 0 THEN (t / 3600 - lag(t / 3600) OVER w) / (value - lag(value) OVER w) END AS s
  FROM samples WINDOW w AS (PARTITION BY unit ORDER BY t, idx)
), ruled AS (SELECT idx, unit, t, {_CLEAN} FROM sloped)
SELECT idx, unit, round(coalesce(last_value(a IGNORE NULLS) OVER w, 0), 4) + 0.0 AS discharge, round(coalesce(last_value(b IGNORE NULLS) OVER w, 0), 4) + 0.0 AS charge
FROM ruled WINDOW w AS (PARTITION BY unit ORDER BY t, idx ROWS UNBOUNDED PRECEDING)""")
def derivative_clean(spark, sf_dir):
    hours = samples(spark, sf_dir).withColumn("hours", F.col("t") / 3600)
    return rounded(series.cleaned_slopes(hours, "hours", "value", ["unit"], ORDER).select("idx", "unit", "discharge", "charge"), 4)


@query(f"""WITH {SAMPLES_SQL}, marked AS (
  SELECT *, lead(t) OVER (PARTITION BY unit ORDER BY cycle, t, idx) AS after, count(*) FILTER (WHERE value >= 30) OVER (PARTITION BY unit, cycle ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS hits FROM samples
), crossed AS (
  SELECT unit, cycle, coalesce(min(after) FILTER (WHERE value >= 30 AND hits = 2) - arg_min(t, (t, idx)), 1200) AS crossing FROM marked GROUP BY unit, cycle)
SELECT unit, cycle, round(crossing, 4) AS crossing,
  round(last_value(CASE WHEN crossing >= 300 THEN crossing END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY cycle ROWS UNBOUNDED PRECEDING), 4) AS filled FROM crossed""")
def nth_crossing(spark, sf_dir):
    crossed = series.crossing_time(samples(spark, sf_dir), "unit", "cycle", ORDER, "t", F.col("value") >= 30)
    return rounded(crossed.withColumn("filled", series.fill_incomplete("crossing", ["unit"], ["cycle"])), 4)


@query(f"""WITH {SAMPLES_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY unit, cycle ORDER BY t, idx) AS n FROM samples
), ends AS (
  SELECT unit, cycle, coalesce(min(n) FILTER (WHERE value < 10), 1) AS low, coalesce(max(n) FILTER (WHERE value < 10), 2) AS high FROM numbered GROUP BY unit, cycle
), inside AS (SELECT numbered.* FROM numbered JOIN ends USING (unit, cycle) WHERE n BETWEEN low AND high
), started AS (SELECT *, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS go FROM inside)
SELECT idx, unit, cycle, value FROM started WHERE go = 1""")
def span_trim(spark, sf_dir):
    inside = series.span(samples(spark, sf_dir), F.col("value") < 10, ["unit", "cycle"], ORDER)
    return series.from_first_match(inside, F.col("event_type") == "click", ["unit"], ORDER).select("idx", "unit", "cycle", "value")


@query(f"""WITH {SAMPLES_SQL}, counted AS (SELECT unit, round(value / 10) AS r, count(*) AS c FROM samples GROUP BY unit, r
), level AS (SELECT unit, r AS level FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY c DESC, r) AS n FROM counted) WHERE n = 1
), near AS (SELECT samples.*, row_number() OVER (PARTITION BY unit ORDER BY t, idx) AS n, count(*) OVER (PARTITION BY unit) AS total FROM samples JOIN level USING (unit) WHERE abs(value / 10 - level) < 0.3
), stop AS (SELECT unit, arg_min(n, (value, n)) AS stop FROM near WHERE n <= total - 2 GROUP BY unit)
SELECT idx, unit, value FROM near JOIN stop USING (unit) WHERE n <= stop""")
def plateau_mode(spark, sf_dir):
    tenth = samples(spark, sf_dir).withColumn("tenth", F.col("value") / 10)
    return curves.plateau(tenth, "tenth", curves.plateau_level("tenth", ["unit"]), "value", ["unit"], ORDER, tolerance=0.3).select("idx", "unit", "value")


@query(f"""WITH {DAILY_SQL}, ahead AS (SELECT *, lead(q) OVER (PARTITION BY unit ORDER BY k) AS following FROM daily)
SELECT unit, CAST(CASE WHEN arg_max(q, k) < 20 THEN min(k) FILTER (WHERE q < 20) ELSE max(k) END AS INTEGER) AS first_life,
  CAST(CASE WHEN arg_max(q, k) < 20 THEN min(k) FILTER (WHERE q < 20 AND following < q) WHEN unit % 3 = 0 AND arg_max(q, k) - 20 < 3 THEN max(cycle) + 1 END AS INTEGER) AS confirmed_life,
  count(*) AS n_cycles, count(*) >= 25 AS complete FROM ahead GROUP BY unit""")
def cycle_life(spark, sf_dir):
    days = daily(spark, sf_dir)
    one = days.groupBy("unit").agg(rollup.life_by_first("q", "k", 20.0).cast("int").alias("first_life"))
    two = rollup.life_by_confirmed(days, "unit", "k", "q", "cycle", F.col("unit") % 3 == 0, 20.0, 3.0).select("unit", F.col("life").cast("int").alias("confirmed_life"))
    return one.join(two, "unit").join(rollup.complete_units(days, "unit", 25), "unit")


@query(f"""WITH {DAILY_SQL}, halves AS (SELECT unit, unnest(generate_series(0, 118)) / 4.0 AS x FROM (SELECT DISTINCT unit FROM daily)
), line AS (SELECT unit, CAST(cycle AS DOUBLE) AS x, q, lead(CAST(cycle AS DOUBLE)) OVER w AS x2, lead(q) OVER w AS q2 FROM daily WINDOW w AS (PARTITION BY unit ORDER BY cycle))
SELECT h.unit, CAST(h.x AS DOUBLE) AS x, round(CASE WHEN h.x = line.x THEN line.q ELSE line.q + (q2 - line.q) * ((h.x - line.x) / (x2 - line.x)) END, 9) AS q
FROM halves AS h LEFT JOIN line ON h.unit = line.unit AND h.x >= line.x AND (h.x < line.x2 OR (line.x2 IS NULL AND h.x = line.x))""")
def grid_interpolate(spark, sf_dir):
    days = daily(spark, sf_dir)
    targets = days.select("unit").distinct().select("unit", F.explode(F.transform(F.sequence(F.lit(0), F.lit(118)), lambda i: i / 4.0)).alias("x"))
    points = curves.first_of_each(days.withColumn("x", F.col("cycle").cast("double")), "x", ["unit"], ["k"])
    return rounded(curves.interpolate(points, targets, "x", "q", ["unit"]), 9)


@query(f"""WITH {DAILY_SQL}, numbered AS (SELECT *, count(*) OVER (PARTITION BY unit) AS total FROM daily), reach AS (SELECT *, least(4, k - 1, total - k) AS h FROM numbered)
SELECT a.unit, a.cycle, round(avg(b.q), 6) AS smooth FROM reach AS a JOIN reach AS b ON a.unit = b.unit AND b.k BETWEEN a.k - a.h AND a.k + a.h GROUP BY a.unit, a.cycle""")
def shrinking_moving_average(spark, sf_dir):
    return rounded(curves.shrinking_average(daily(spark, sf_dir), "q", ["unit"], ["k"]).select("unit", "cycle", "smooth"))


_FEATURES_SQL = f"""{DAILY_SQL}, curve AS (
  SELECT unit, cycle AS k, CAST(floor(t / 3600) % 24 AS INTEGER) AS g, avg(value) AS q FROM samples WHERE cycle IN (5, 20) GROUP BY ALL
), cap AS (SELECT unit, max(q) FILTER (WHERE cycle = 2) AS f1, max(q) - max(q) FILTER (WHERE cycle = 2) AS f2, max(q) FILTER (WHERE cycle = 20) AS f3,
    regr_slope(q, cycle) FILTER (WHERE cycle BETWEEN 2 AND 20) AS f4, regr_intercept(q, cycle) FILTER (WHERE cycle BETWEEN 2 AND 20) AS f5,
    regr_slope(q, cycle) FILTER (WHERE cycle BETWEEN 15 AND 20) AS f6, regr_intercept(q, cycle) FILTER (WHERE cycle BETWEEN 15 AND 20) AS f7
  FROM daily WHERE cycle <= 20 GROUP BY unit HAVING f3 IS NOT NULL
), delta AS (SELECT unit, g, max(q) FILTER (WHERE k = 20) - max(q) FILTER (WHERE k = 5) AS d FROM curve GROUP BY unit, g
), centred AS (SELECT *, d - avg(d) OVER (PARTITION BY unit) AS c FROM delta
), shape AS (SELECT unit, min(d) AS least, avg(d) AS mean, CASE WHEN count(d) > 1 THEN sum(c * c) / (count(d) - 1) END AS variance,
    CASE WHEN sum(c * c) > 0 THEN (sum(c * c * c) / count(d)) / pow(sum(c * c) / count(d), 1.5) END AS skew, sum(abs(d)) AS size, sum(d * d) AS sq, arg_min_null(d, g) AS first FROM centred GROUP BY unit
), step AS (SELECT unit, k, (q - lag(q) OVER w) * (g + lag(g) OVER w) / 2 AS part FROM curve WINDOW w AS (PARTITION BY unit, k ORDER BY g)
), area AS (SELECT unit, k, coalesce(sum(part), 0) AS area FROM step GROUP BY unit, k
), fall AS (SELECT unit, max(area) FILTER (WHERE k = 5) - max(area) FILTER (WHERE k = 20) AS fall FROM area GROUP BY unit
), features AS (SELECT unit, f1, f2, f3, f4, f5, f6, f7, {", ".join(f"CASE WHEN {c} <> 0 THEN log10(abs({c})) END AS f{i}" for i, c in enumerate(("least", "mean", "variance", "skew", "first", "size", "sq"), 8))},
    CASE WHEN fall > 0 THEN log10(fall) END AS f15 FROM cap LEFT JOIN shape USING (unit) LEFT JOIN fall USING (unit))"""


def _features(spark, sf_dir):
    own = samples(spark, sf_dir).filter(F.col("cycle").isin(5, 20))
    hour = (F.floor(F.col("t") / 3600) % 24).cast("int")
    curve = own.groupBy("unit", F.col("cycle").alias("k"), hour.alias("g")).agg(F.avg("value").alias("q")).withColumn("v", F.col("g").cast("double"))
    return features.unit_features(daily(spark, sf_dir).withColumn("k", F.col("cycle")), curve, "unit", "k", "q", "g", "v", "q", early=5, tail=15, cutoff=20)


@query(f"WITH {_FEATURES_SQL} SELECT unit, {', '.join(f'round(f{i}, 6) + 0.0 AS f{i}' for i in range(1, 16))} FROM features")
def delta_curve_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir), 6)


#: Any model will do: weights on three features, with an inverse design matrix over them and 1.
MODEL = {"mu": [30.0, 5.0, 30.0], "sigma": [10.0, 4.0, 12.0], "b1": [0.2, -0.1, 0.05], "y_mu": 2.5, "t": 1.98, "mse": 0.01, "inverse": [[0.02, 0.001, 0, 0], [0.001, 0.03, 0, 0], [0, 0, 0.025, 0.002], [0, 0, 0.002, 0.01]]}


@query(f"""WITH {_FEATURES_SQL}, z AS (SELECT unit, (f1 - 30) / 10 AS a, (f2 - 5) / 4 AS b, (f3 - 30) / 12 AS c FROM features
), lin AS (SELECT unit, 0.2 * a - 0.1 * b + 0.05 * c + 2.5 AS m, 1.98 * sqrt(0.01 * (1 + 0.02 * a * a + 0.002 * a * b + 0.03 * b * b + 0.025 * c * c + 0.004 * c + 0.01)) AS h FROM z
), scored AS (SELECT unit, pow(10, m) AS p, pow(10, m - h) AS low, pow(10, m + h) AS high FROM lin)
SELECT u.unit, round(p, 4) AS prediction, round(low, 4) AS low, round(high, 4) AS high, high - low > 200 AS too_wide, round(CASE WHEN high - low > 200 THEN -1.0 ELSE p END, 4) AS shown
FROM (SELECT DISTINCT unit FROM samples) AS u LEFT JOIN scored USING (unit)""")
def linear_score_interval(spark, sf_dir):
    scored = features.score(_features(spark, sf_dir), "unit", ["f1", "f2", "f3"], MODEL, widest=200.0)
    return rounded(features.for_all_units(samples(spark, sf_dir), scored, "unit"), 4)


@query(f"""WITH {DAILY_SQL}, numbered AS (SELECT *, count(*) OVER (PARTITION BY unit) AS total FROM daily)
SELECT unit, round((max(q) - min(q)) / count(*), 6) AS rate,
  round(CASE WHEN max(total) > 10 THEN (max(q) FILTER (WHERE k <= 10) - min(q) FILTER (WHERE k <= 10)) / 10 ELSE (max(q) - min(q)) / count(*) END, 6) AS initial_rate,
  round(CASE WHEN max(total) > 10 THEN (max(q) FILTER (WHERE k > total - 11) - min(q) FILTER (WHERE k > total - 11)) / 10 ELSE (max(q) - min(q)) / count(*) END, 6) AS final_rate,
  round(avg(q) FILTER (WHERE k <= 10), 6) AS early FROM numbered GROUP BY unit""")
def wear_rates(spark, sf_dir):
    days = daily(spark, sf_dir)
    rates = rollup.wear_rates(days, "unit", "k", "q", head=10, tail=11, per=10)
    return rounded(rates.join(days.groupBy("unit").agg(rollup.early_mean("q", "k", 10).alias("early")), "unit"))


@query(f"""WITH {DAILY_SQL}, place AS (SELECT unit, unnest(generate_series(1, 32)) AS k FROM (SELECT DISTINCT unit FROM daily))
SELECT place.unit, CAST(place.k AS INTEGER) AS k, round(last_value(q IGNORE NULLS) OVER (PARTITION BY place.unit ORDER BY place.k ROWS UNBOUNDED PRECEDING), 6) AS q
FROM place LEFT JOIN daily ON daily.unit = place.unit AND daily.k = place.k""")
def hold_last(spark, sf_dir):
    return rounded(series.hold_last(daily(spark, sf_dir), "unit", "k", "q", 32))


@query(f"""WITH {SAMPLES_SQL}, steps AS (SELECT *, lag(value) OVER (PARTITION BY unit ORDER BY t, idx) AS before FROM samples), ended AS (
  SELECT unit, cycle, arg_min_null(before, (t, idx)) - arg_max(value, (t, idx)) AS relaxation FROM steps GROUP BY unit, cycle)
SELECT unit, cycle, round(relaxation, 6) AS relaxation FROM ended WHERE cycle BETWEEN 2 AND 26 AND (cycle - 2) % 4 = 0""")
def step_relaxation(spark, sf_dir):
    return rounded(series.step_series(series.step_relaxation(samples(spark, sf_dir), "unit", "cycle", ORDER, "value"), "cycle", 2, 4, 26))


@query(f"""WITH {DAILY_SQL}, fit AS (SELECT unit, regr_slope(q, k) AS slope, regr_intercept(q, k) AS intercept FROM daily WHERE k BETWEEN 2 AND 20 GROUP BY unit)
SELECT unit, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit""")
def linear_fit(spark, sf_dir):
    return rounded(features.line_fit(daily(spark, sf_dir), ["unit"], "k", "q", 2, 20))


@query(f"WITH {DAILY_SQL} SELECT unit, k, round(q, 6) AS q FROM daily WHERE (k - 1) % 5 = 0")
def every_fifth_cycle(spark, sf_dir):
    return rounded(series.every_nth(daily(spark, sf_dir), "k").select("unit", "k", "q"))


@query(f"WITH {DAILY_SQL} SELECT least(min(n), 25) AS shared FROM (SELECT count(*) AS n FROM daily GROUP BY unit)")
def shared_cycles(spark, sf_dir):
    return rollup.shared_cycles(daily(spark, sf_dir), "unit", 25)


@query()
def spline_resample(spark, sf_dir):
    """Daily means as splines whose stiffness the data choose."""
    days = daily(spark, sf_dir).withColumn("x", F.col("cycle").cast("double"))
    return rounded(smoothing.spline_resample(days, "x", ["q"], ["unit"], points=59, first=29.0, last=0.0))


@query()
def robust_smooth(spark, sf_dir):
    return rounded(smoothing.robust_smooth(daily(spark, sf_dir), "cycle", "q", ["unit"]))


@query(f"""WITH {SAMPLES_SQL}, own AS (SELECT unit, idx, value / 20 + 1 AS v, t / 3600 - first_value(t / 3600) OVER (PARTITION BY unit ORDER BY idx) AS q FROM samples
), sloped AS (SELECT *, row_number() OVER w AS o, CASE WHEN lag(1) OVER w IS NULL THEN 0 WHEN v - lag(v) OVER w <> 0 THEN (q - lag(q) OVER w) / (v - lag(v) OVER w)
    WHEN q > lag(q) OVER w THEN 'inf'::DOUBLE WHEN q < lag(q) OVER w THEN '-inf'::DOUBLE END AS s FROM own WINDOW w AS (PARTITION BY unit ORDER BY idx)
), ruled AS (SELECT *, CASE WHEN o = 1 THEN 0 WHEN s IS NULL OR abs(s) >= 50 THEN 0 WHEN s >= 0 THEN NULL WHEN v <= 2 THEN 0 ELSE s END AS a FROM sloped
), cleaned AS (SELECT unit, o, v, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY unit ORDER BY o ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS s FROM ruled
), anchored AS (SELECT * FROM cleaned UNION ALL SELECT unit, -1, 3.6, 0 FROM cleaned WHERE o = 1 UNION ALL SELECT unit, 0, v + 1e-4, -1e-4 FROM cleaned WHERE o = 1
), single AS (SELECT unit, v, arg_min(s, o) AS s FROM anchored GROUP BY unit, v
), line AS (SELECT *, lead(v) OVER w AS v2, lead(s) OVER w AS s2 FROM single WINDOW w AS (PARTITION BY unit ORDER BY v)
), target AS (SELECT unit, CAST(i AS INTEGER) AS g, 3.5 + i * (-1.5::DOUBLE / 49) AS v FROM (SELECT DISTINCT unit FROM own), (SELECT unnest(generate_series(0, 49)) AS i)
), found AS (SELECT t.unit, g, t.v, CASE WHEN t.v = l.v THEN l.s ELSE l.s + (l.s2 - l.s) * ((t.v - l.v) / (l.v2 - l.v)) END AS y
    FROM target AS t LEFT JOIN line AS l ON l.unit = t.unit AND t.v >= l.v AND (t.v < l.v2 OR (l.v2 IS NULL AND t.v = l.v))
), reach AS (SELECT *, least(4, g, 49 - g) AS h FROM found)
SELECT a.unit, a.g AS grid_idx, round(a.v, 6) AS v, round(sum(b.y) / (2 * max(a.h) + 1), 5) + 0.0 AS dqdv FROM reach AS a JOIN reach AS b ON a.unit = b.unit AND b.g BETWEEN a.g - a.h AND a.g + a.h GROUP BY a.unit, a.g, a.v""")
def discharge_slope_curve(spark, sf_dir):
    """The whole way from samples to a smoothed slope curve on the shared grid, for every unit."""
    start = F.first(F.col("t") / 3600).over(series.so_far(["unit"], ["idx"]))
    own = samples(spark, sf_dir).select("unit", "idx", (F.col("value") / 20 + 1).alias("v"), (F.col("t") / 3600 - start).alias("q"))
    out = curves.discharge_slope_curve(own, ["unit"], "idx", "v", "q", points=50)
    return out.select("unit", "grid_idx", F.round("v", 6).alias("v"), (F.round("dqdv", 5) + 0.0).alias("dqdv"))
