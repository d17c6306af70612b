"""Edge cases of series, curves and evaluation on hand-made rows."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars, text
from tidemark.operators import bandit, curves, evaluate, features, ordered, policy, rollup, series, smoothing


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_clean_discharge_carries_the_last_resolved(spark):
    rows = [(1, i, x, s) for i, (x, s) in enumerate([(3.4, 0.0), (3.3, -1.0), (3.2, 2.0), (3.1, 0.0), (3.0, None), (2.9, 1.0), (2.8, -60.0), (2.7, -2.0), (1.9, -3.0), (1.8, 4.0)])]
    out = frame(spark, rows, "u int, i int, v double, s double").withColumn("c", series.clean_discharge("s", "v", ["u"], ["i"])).orderBy("i")
    assert [r["c"] for r in out.collect()] == [0, -1, -1, -1, 0, 0, 0, -2, 0, 0]


def test_negative_clock_is_moved_to_its_predecessor(spark):
    rows = [(1, i, t) for i, t in enumerate([0.0, 10.0, -990.0, -980.0])] + [(2, i, t) for i, t in enumerate([0.0, -5.0, 7.0])]
    out = series.repair_if_negative_end(frame(spark, rows, "u int, i int, t double"), "t", ["u"], ["i"]).orderBy("u", "i")
    assert [r["t"] for r in out.collect()] == [0, 10, 10, 20, 0, -5, 7]


def test_inner_cycles_of_short_units(spark):
    rows = [(1, c) for c in (5, 6, 9, 11)] + [(2, 1), (3, 1), (3, 2)]
    out = series.inner(frame(spark, rows, "unit int, cycle int")).orderBy("cycle")
    assert [(r["unit"], r["cycle"], r["k"]) for r in out.collect()] == [(1, 6, 1), (1, 9, 2)]


def test_crossing_reads_the_row_after_and_may_leave_the_cycle(spark):
    rows = [(1, 1, i, float(100 * i), q) for i, q in enumerate([0.1, 0.9, 0.91])] + [(1, 2, i, float(100 * i), q) for i, q in enumerate([0.1, 0.9], 3)]
    out = series.crossing_time(frame(spark, rows, "unit int, cycle int, i int, t double, q double"), "unit", "cycle", ["i"], "t", F.col("q") >= 0.88)
    assert {r["cycle"]: r["crossing"] for r in out.collect()} == {1: 300.0, 2: 1200.0}


def test_interpolation_is_null_outside_and_exact_on_points(spark):
    points = frame(spark, [(1, 1.0, 10.0), (1, 3.0, 30.0)], "u int, x double, y double")
    targets = frame(spark, [(1, x) for x in (0.5, 1.0, 2.0, 3.0, 3.5)], "u int, x double")
    out = curves.interpolate(points, targets, "x", "y", ["u"]).orderBy("x")
    assert [r["y"] for r in out.collect()] == [None, 10.0, 20.0, 30.0, None]


def test_shrinking_average_ends(spark):
    out = curves.shrinking_average(frame(spark, [(1, i, float(i * i)) for i in range(5)], "u int, i int, v double"), "v", ["u"], ["i"], half=2).orderBy("i")
    assert [round(r["smooth"], 6) for r in out.collect()] == [0, round(5 / 3, 6), 6, round(29 / 3, 6), 16]


def test_spline_follows_points_and_short_curves_are_zero(spark):
    rows = [(1, x / 2, math.sin(x / 2)) for x in range(9)] + [(2, 1.0, 1.0)]
    out = smoothing.spline_resample(frame(spark, rows, "u int, x double, y double"), "x", ["y"], ["u"], points=5, first=4.0, last=0.0, stiffness=1e-9).toPandas()
    one = out[out.u == 1].sort_values("v")
    assert np.allclose(one["y"], np.sin(one["v"]), atol=0.02)
    assert (out[out.u == 2]["y"] == 0).all()


def test_lives(spark):
    rows = [(1, k, q) for k, q in enumerate([1.0, 0.87, 0.9, 0.86, 0.85], 1)] + [(2, k, q) for k, q in enumerate([1.0, 0.885], 1)] + [(3, 1, 0.95)]
    df = frame(spark, rows, "unit int, k int, q double")
    out = rollup.life_by_confirmed(df, "unit", "k", "q", "k", F.col("unit") == 2)
    assert {r["unit"]: r["life"] for r in out.collect()} == {1: 4, 2: 3, 3: None}
    first = df.groupBy("unit").agg(rollup.life_by_first("q", "k").alias("life"))
    assert {r["unit"]: r["life"] for r in first.collect()} == {1: 2, 2: 2, 3: 1}


def test_moments_are_population_skewness(spark):
    out = features.curve_moments(frame(spark, [(1, i, v) for i, v in enumerate([1.0, 2.0, 2.0, 9.0])], "u int, i int, v double"), ["u"], "i", "v").first()
    x = np.array([1.0, 2.0, 2.0, 9.0])
    assert out["skew"] == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3)
    assert out["variance"] == pytest.approx(x.var(ddof=1)) and out["first"] == 1.0


def test_moments_that_are_rounding_are_those_of_the_formula(spark):
    """Two points have no skewness and equal ones no variance, but for the rounding of their mean."""
    curves_ = {1: [0.01, 0.02], 2: [29.27, 2.11], 3: [0.1, 0.1, 0.1], 4: [1.0, 1.0], 5: [0.7]}
    rows = [(u, i, v) for u, values in curves_.items() for i, v in enumerate(values)] + [(6, 0, None), (1, 9, None)]
    out = {r["u"]: r for r in features.curve_moments(frame(spark, rows, "u int, i int, v double"), ["u"], "i", "v").collect()}
    for u, values in curves_.items():
        mean = sum(values) / len(values)
        square, cube = sum((v - mean) * (v - mean) for v in values), sum((v - mean) * (v - mean) * (v - mean) for v in values)
        assert out[u]["variance"] == (square / (len(values) - 1) if len(values) > 1 else None)
        assert (out[u]["skew"] or 0.0) == pytest.approx(cube / len(values) / (square / len(values)) ** 1.5 if square > 0 else 0.0, rel=1e-9, abs=0.0)
    assert out[6]["variance"] is None and out[6]["skew"] is None


def test_kendall_with_ties(spark):
    out = evaluate.kendall(frame(spark, [(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 3, 3)], "i int, x int, y int"), "x", "y").first()
    assert out["tau"] == pytest.approx(4 / 5)


def plain_tau(rows):
    pairs = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for k, a in enumerate(rows) for b in rows[:k]]
    size = sum(abs(x) for x, _ in pairs) * sum(abs(y) for _, y in pairs)
    return sum(x * y for x, y in pairs) / size**0.5 if size else None


@pytest.mark.parametrize("rows_a_range", [7, 1 << 20])
def test_kendall_of_keys_with_heavy_ties(spark, rows_a_range):
    rng = np.random.default_rng(4)
    rows = [(k, int(x), float(y)) for k in range(3) for x, y in zip(rng.integers(0, [3, 40, 9][k], 90), rng.choice([0.5, 0.5, 0.5, *rng.random(9 * k + 2)], 90))]
    rows += [(3, 1, 1.0), (3, 1, 2.0), (4, 2, 2.0), (None, 1, 1.0), (None, 2, 0.5), (0, None, 1.0), (1, 5, None)]
    out = evaluate.kendall(frame(spark, rows, "k int, x int, y double"), "x", "y", ["k"], rows=rows_a_range)
    got = {r["k"]: r["tau"] for r in out.collect()}
    for k in (0, 1, 2, 3, 4, None):
        want = plain_tau([r[1:] for r in rows if r[0] == k and None not in r[1:]])
        assert got[k] == (want if want is None else pytest.approx(want))
    whole = evaluate.kendall(frame(spark, rows, "k int, x int, y double"), "x", "y", rows=rows_a_range).first()
    assert whole["tau"] == pytest.approx(plain_tau([r[1:] for r in rows if None not in r[1:]]))
    assert evaluate.kendall(frame(spark, [], "k int, x int, y double"), "x", "y", ["k"]).count() == 0


def test_kendall_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: made.add(1) or v, "long").asNondeterministic()
    df = spark.range(300).select((F.col("id") % 3).alias("g"), seen(F.col("id") * 7919 % 41).alias("x"), (F.col("id") * 7877 % 59).alias("y"))
    got = {r["g"]: r["tau"] for r in evaluate.kendall(df, "x", "y", ["g"], rows=10).collect()}
    assert made.value == 300
    for g in range(3):
        assert got[g] == pytest.approx(plain_tau([(i * 7919 % 41, i * 7877 % 59) for i in range(g, 300, 3)]))


def test_pairs_of_a_hot_value_reach_no_task(spark):
    # a third of all rows has one x: its range makes no pair, and no other range is larger than its share
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).alias("x"), (F.col("id") * 7919 % 3000).alias("y"))
    place, same = ordered._value_ranges(df, "x", 100)
    sizes = {(r["p"], r["s"]): r["count"] for r in df.groupBy(place.alias("p"), same.alias("s")).count().collect()}
    assert max(n for (_, s), n in sizes.items() if not s) < 300 and max(n for (_, s), n in sizes.items() if s) >= 1000


def test_scan_in_ranges_equals_plain_loops(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, None if rng.random() < 0.6 else int(rng.integers(0, 9))) for k in (1, 2, None) for i in range([5, 60, 23][(k or 0) % 3])]
    own = ordered.chunked(frame(spark, rows, "k int, i int, v int"), ["k"], ["i"], rows=6)
    assert own.select("__chunk").distinct().count() > 5
    out = ordered.scan(own, ["k"], ["i"], before={"b": F.col("v")}, after={"a": F.col("v")}, upto={"u": F.col("v")}, onward={"o": F.col("v")}, number="n", total={"t": (F.col("v"), F.sum)})
    got = {(r["k"], r["i"]): (r["b"], r["a"], r["u"], r["o"], r["n"], r["t"]) for r in out.collect()}
    for k in (1, 2, None):
        v = [r[2] for r in rows if r[0] == k]
        for i in range(len(v)):
            known = [x for x in v[: i + 1] if x is not None], [x for x in v[i:] if x is not None]
            want = (v[i - 1] if i else None, v[i + 1] if i + 1 < len(v) else None, known[0][-1] if known[0] else None, known[1][0] if known[1] else None, i + 1, sum(x for x in v if x is not None) if any(x is not None for x in v) else None)
            assert got[k, i] == want


@pytest.mark.parametrize("rows_a_range", [9, 1 << 20])
def test_one_key_of_many_rows_is_scanned_in_ranges(spark, rows_a_range):
    rng = np.random.default_rng(6)
    t = np.cumsum(rng.random(200))
    clock = np.where(np.arange(200) >= 120, t - 1000, t)
    v = np.round(rng.normal(3, 0.6, 200), 2)
    df = frame(spark, [(1, i, float(c), float(x), float(s)) for i, (c, x, s) in enumerate(zip(clock, v, t))], "u int, i int, t double, v double, q double")
    fixed = [r["t"] for r in series.repair_if_negative_end(df, "t", ["u"], ["i"], rows_a_range).orderBy("i").collect()]
    assert np.allclose(fixed, np.where(np.arange(200) >= 120, t - 1000 + (t[119] - (t[120] - 1000)), t))
    plain = df.withColumn("s", series.slope("q", "v", ["u"], ["i"])).select("i", series.clean_discharge("s", "v", ["u"], ["i"]).alias("d"), series.clean_charge("s", "v", ["u"], ["i"]).alias("c"))
    cleaned = series.cleaned_slopes(df, "q", "v", ["u"], ["i"], rows_a_range, "d", "c")
    assert sorted(map(tuple, cleaned.select("i", "d", "c").collect())) == sorted(map(tuple, plain.collect()))
    points = df.select("u", F.col("q").alias("x"), F.col("v").alias("y"))
    targets = spark.range(300).select(F.lit(1).alias("u"), (F.col("id") / 3.0).alias("x"))
    got = {r["x"]: r["y"] for r in curves.interpolate(points, targets, "x", "y", ["u"], rows_a_range).collect()}
    for x, y in got.items():
        assert y == (None if x < t[0] or x > t[-1] else pytest.approx(np.interp(x, t, v)))


def test_ranks_over_all_rows_with_heavy_ties(spark):
    values = [None, 3.0, 3.0, *[1.0] * 40, 2.0, 7.0, None]
    df = frame(spark, list(enumerate(values)), "i int, v double")
    got = {r["i"]: (r["place"], r["average"]) for r in ordered.ranked(df, "v", ["i"], rows=5).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    for i, v in enumerate(values):
        same = [order.index(j) + 1 for j in range(len(values)) if values[j] == v]
        assert got[i] == (order.index(i) + 1, sum(same) / len(same))
    places = {r["v"]: r["place"] for r in evaluate.rank_of_value(df, "v", rows=2).collect()}
    assert places == {7.0: 0, 3.0: 1, 2.0: 3, 1.0: 4, None: 44}


@pytest.mark.parametrize("seed", range(3))
def test_ranks_of_values_that_cuts_have(spark, seed):
    """Values that begin, end, fill and cross ranges, not-a-numbers and both zeros; one sort of the rows serves all ranks."""
    rng = np.random.default_rng(seed)
    values = [[None, math.nan, 0.0, -0.0, 1.0, 2.0, 5.0, 7.5][k] for k in rng.integers(0, 8, 150)]
    df = frame(spark, list(enumerate(values)), "i int, v double")
    out = ordered.ranked(df, "v", ["i"], descending=False, rows=[4, 13, 60][seed])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.split("\n") if "Sort [__chunk" in line and "i#" in line]) == 1
    got = {r["i"]: (r["place"], r["average"]) for r in out.collect()}
    number = [(v is None, v is not None and math.isnan(v), 0.0 if v is None or math.isnan(v) else v + 0.0) for v in values]
    order = sorted(range(len(values)), key=lambda i: (number[i], i))
    for i in range(len(values)):
        same = [order.index(j) + 1 for j in range(len(values)) if number[j] == number[i]]
        assert got[i] == (order.index(i) + 1, sum(same) / len(same))


def test_search_for_a_range_takes_a_step_for_each_doubling(spark):
    assert [len(ordered._halves(n)) for n in (1, 3, 1000, 1 << 14)] == [1, 2, 10, 15]
    df = spark.range(2000).select("id", (F.col("id") * 7919 % 2000).alias("v"))
    placed = ordered.chunked(df, [], ["v"], rows=3)
    firsts = [tuple(r) for r in placed.groupBy("__chunk").agg(F.min("v"), F.max("v")).orderBy("__chunk").collect()]
    assert len(firsts) > 300 and all(a[2] < b[1] for a, b in zip(firsts, firsts[1:]))


def test_policy_space_has_its_known_size_and_range(spark):
    grid = policy.valid(policy.all_combinations(spark))
    by_third = {r["c3"]: r["count"] for r in grid.groupBy("c3").count().collect()}
    assert by_third == {3.6: 15, 4.0: 28, 4.4: 35, 4.8: 42, 5.2: 49, 5.6: 55}
    low, high = grid.agg(F.min("c4"), F.max("c4")).first()
    assert round(low, 3) == 2.585 and round(high, 3) == 4.8


def test_first_batch_of_the_policy_space(spark):
    # fixed values: the published first picks, which follow from the shuffle alone
    arms = policy.arms(policy.valid(policy.all_combinations(spark)), seed=0)
    first = [(r["c1"], r["c2"], r["c3"]) for r in arms.filter("arm_id < 3").orderBy("arm_id").collect()]
    assert arms.count() == 224 and first == [(5.6, 6.0, 4.8), (8.0, 5.2, 4.8), (7.0, 6.0, 3.6)]
    lines = policy.channels(policy.valid(policy.all_combinations(spark)), 0).orderBy("channel").first()
    assert (lines["channel"], lines["line_no"]) == (1, 14)


def test_greatest_other(spark):
    out = bandit.greatest_other(frame(spark, [(1, 1, 5.0), (1, 2, 9.0), (1, 3, 9.0), (2, 1, 4.0)], "e int, arm int, u double"), "u", "arm", ["e"], "o")
    assert {(r["e"], r["arm"]): r["o"] for r in out.collect()} == {(1, 1): 9.0, (1, 2): 9.0, (1, 3): 9.0, (2, 1): None}


def test_posterior_equals_the_primal_form():
    rng = np.random.default_rng(1)
    k = bandit.kernel(rng.random((12, 3)), 1.0)
    seen, y = np.array([0, 3, 3, 7]), rng.normal(size=4) * 100
    mean, variance = bandit.posterior(k, seen, y, 164.0, 150.0)
    root = np.linalg.cholesky(k + 1e-10 * np.eye(12))
    cover = np.linalg.inv(root[seen].T @ root[seen] / 164.0**2 + np.eye(12) / 150.0**2)
    assert np.allclose(mean, root @ cover @ root[seen].T @ y / 164.0**2, atol=1e-3)
    assert np.allclose(variance, ((root @ cover) * root).sum(axis=1), rtol=1e-4)


def test_text_forms(spark):
    row = frame(spark, [("8C_35PER_3_6C", "a-b-2018-06-01\\x-POL_1.sdu", "EL150", "3_6PT5")], "raw string, path string, code string, oed string")
    out = row.select(text.readable_structured(F.col("raw")), text.schedule_policy(F.col("path")), text.barcode_number(F.col("code")), text.readable_steps(F.col("oed"))).first()
    assert tuple(out) == ("8C(35%)-3.6C", "POL_1", 150, "3-6.5")


def test_second_rate_inverts_the_minutes(spark):
    out = frame(spark, [(6.0, 40.0, 4.0)], "a double, q double, b double").select(scalars.minutes_to_80(F.col("a"), F.col("q"), F.col("b")).alias("m"), "a", "q", "b")
    again = out.select(scalars.second_for_minutes(F.col("m"), F.col("a"), F.col("q")).alias("b2"), scalars.switch_for_minutes(F.col("m"), F.col("a"), F.col("b")).alias("q2")).first()
    assert again["b2"] == pytest.approx(4.0) and again["q2"] == pytest.approx(40.0)


def test_discharge_slope_curve_equals_a_plain_version(spark):
    rng = np.random.default_rng(2)
    v = np.round(np.linspace(3.45, 1.95, 120) + rng.normal(0, 0.004, 120), 3)
    q = np.cumsum(rng.random(120)) / 100
    clean = [0.0]
    for k in range(1, 120):
        dv, dq = v[k] - v[k - 1], q[k] - q[k - 1]
        s = dq / dv if dv else 0.0
        clean.append(0.0 if abs(s) >= 50 or not dv else clean[-1] if s >= 0 else 0.0 if v[k] <= 2 else s)
    x, y = np.concatenate([[3.6, v[0] + 1e-4], v]), np.concatenate([[0, -1e-4], clean])
    x, first = np.unique(x, return_index=True)
    at = 3.5 - np.arange(200) * (1.5 / 199)
    line = np.interp(at, x, y[first])
    want = [line[i - h : i + h + 1].mean() for i in range(200) for h in [min(4, i, 199 - i)]]
    df = frame(spark, [(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(v, q))], "u int, i int, v double, q double")
    out = curves.discharge_slope_curve(df, ["u"], "i", "v", "q", points=200).orderBy("grid_idx").toPandas()
    assert np.allclose(out["dqdv"], want, atol=1e-9)


def dense_spline(x, y, stiffness):
    """Levels and the trace of I - A."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for k in range(n - 2):
        q[k : k + 3, k] = 1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]
        r[k, k] = (h[k] + h[k + 1]) / 3
        if k:
            r[k, k - 1] = r[k - 1, k] = h[k] / 6
    away = stiffness * q @ np.linalg.solve(r + stiffness * q.T @ q, q.T)
    return y - away @ y, np.trace(away)


def test_splines_equal_a_dense_solve_and_its_cross_validation():
    rng = np.random.default_rng(7)
    xs = [np.cumsum(rng.random(n) + 0.05) for n in (3, 4, 5, 40, 12)]
    ys = [np.column_stack([np.sin(x) + rng.normal(0, 0.2, len(x)), rng.normal(size=len(x))]) for x in xs]
    levels, _, used = smoothing.fit_splines(xs, ys, 0.3)
    for x, y, level in zip(xs, ys, levels):
        for v in range(2):
            assert np.allclose(level[:, v], dense_spline(x, y[:, v], 0.3)[0])
    levels, _, used = smoothing.fit_splines(xs, ys)
    for x, y, level, chosen in zip(xs, ys, levels, used):
        for v in range(2):
            tried = ((x[-1] - x[0]) / (len(x) - 1)) ** 3 * smoothing.TRIED
            fits = [dense_spline(x, y[:, v], w) for w in tried]
            scores = [len(x) * ((y[:, v] - fit) ** 2).sum() / trace**2 for fit, trace in fits]
            mine = int(np.argmin(np.abs(tried - chosen[v])))
            assert scores[mine] == pytest.approx(min(scores), rel=1e-6) and np.allclose(level[:, v], fits[mine][0])


def test_local_lines_equal_plain_loops(spark):
    rng = np.random.default_rng(11)
    for n, nearest in ((1, 5), (2, 5), (7, 9), (30, 7), (31, 4)):
        x = np.cumsum(rng.random(n) + 0.01)
        y = np.sin(x) + rng.normal(0, 0.1, n) + (np.arange(n) % 11 == 5) * 9
        trust, want = np.ones(n), y
        for turn in range(6):
            want = np.empty(n)
            for i in range(n):
                near = sorted(range(n), key=lambda j: (abs(x[j] - x[i]), j))[: min(nearest, n)]
                reach = max(abs(x[j] - x[i]) for j in near)
                w = np.array([(1 - (abs(x[j] - x[i]) / reach) ** 3) ** 3 if reach else 1.0 for j in near])
                w = w * trust[near] if (w * trust[near]).sum() > 0 else w
                mx, my = np.average(x[near], weights=w), np.average(y[near], weights=w)
                spread = (w * (x[near] - mx) ** 2).sum()
                want[i] = my + ((w * (x[near] - mx) * (y[near] - my)).sum() / spread * (x[i] - mx) if spread > 1e-12 else 0)
            size = np.median(np.abs(y - want))
            if size < 1e-11:
                break
            trust = np.clip(1 - ((y - want) / (6 * size)) ** 2, 0, None) ** 2
        assert np.allclose(smoothing.local_lines(x, y, nearest), want, atol=1e-7)
    rows = [(k, i, float(i % 4) if i != 3 else None) for k in (1, None) for i in range(9)]
    out = smoothing.robust_smooth(frame(spark, rows, "k int, i int, v double"), "i", "v", ["k"])
    assert out.count() == 16 and out.columns == ["k", "i", "v"]


def test_charge_slope_falling_at_a_standing_voltage_is_carried(spark):
    rows = [(1, i, v, q) for i, (v, q) in enumerate([(3.0, 0.0), (3.1, 0.2), (3.1, 0.1), (3.1, 0.3), (3.1, 0.3), (3.5, 0.4)])]
    df = frame(spark, rows, "u int, i int, v double, q double").withColumn("s", series.slope("q", "v", ["u"], ["i"]))
    out = df.withColumn("c", series.clean_charge("s", "v", ["u"], ["i"])).orderBy("i").collect()
    assert [r["s"] for r in out[2:5]] == [float("-inf"), float("inf"), None]
    assert [round(r["c"], 6) for r in out] == [0, 2, 2, 0, 0, 0]


def test_unbounded_query_sets_and_axes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(bandit, "MOST_QUERIES", 2)
    monkeypatch.setattr(policy, "AXIS", 2)
    df = frame(spark, [(k, [1.0]) for k in range(3)], "i int, e array<double>")
    with pytest.raises(ValueError):
        bandit.kernel_to(df, "i", df, "i", "e", 1.0)
    with pytest.raises(Exception, match="more than 2 values"):
        policy.combinations(*(spark.range(3).select(F.col("id") + 1.0),) * 3).collect()


def test_axes_of_a_table_give_the_same_grid(spark):
    axes = [frame(spark, [(v,) for v in (*map(float, values), values[0], None)], "v double") for values in (policy.FIRST, policy.SECOND, policy.THIRD)]
    one, two = (sorted(map(tuple, policy.valid(df).collect())) for df in (policy.combinations(*axes), policy.all_combinations(spark)))
    assert one == two and len(one) == 224


def test_shuffled_in_ranges(spark):
    got = [r["arm_id"] for r in policy.shuffled(spark.range(100), "id", 3, rows=9).orderBy("id").collect()]
    order = sorted(range(100), key=lambda k: (hashlib.md5(f"3-{k}".encode()).hexdigest(), k))
    assert [order.index(k) for k in range(100)] == got


def test_bounds_of_arms_equal_the_joint_posterior(spark):
    rng = np.random.default_rng(5)
    points, settings = rng.random((30, 3)), bandit.Settings()
    seen, outcome = np.array([2, 2, 9, 17]), rng.normal(947, 200, 4)
    arms = frame(spark, [(e, k, p.tolist()) for e in (1, 2) for k, p in enumerate(points)], "experiment int, arm_id long, point array<double>")
    known = frame(spark, [(1, int(k), points[k].tolist(), float(y)) for k, y in zip(seen, outcome)], "experiment int, arm_id long, point array<double>, outcome double")
    got = {(r["experiment"], r["arm_id"]): (r["upper"], r["lower"], r["mean"]) for r in bandit.arm_bounds(arms, known, settings, 2).collect()}
    for e, args in ((1, (seen, outcome - settings.mean)), (2, (np.empty(0, int), np.empty(0)))):
        upper, lower = bandit.bounds(*bandit.posterior(bandit.kernel(points, settings.gamma), *args, settings.sigma, settings.eta), bandit.beta_of_round(settings, 2))
        for k in range(30):
            assert got[e, k] == pytest.approx((upper[k] + 947, lower[k] + 947, (upper[k] + lower[k]) / 2 + 947), abs=2e-4)


def test_batches_of_very_many_arms_come_from_few_candidates(spark):
    rng = np.random.default_rng(12)
    n, picks = 100_000, 7
    lower = rng.integers(0, 60, n).astype(float)
    upper = lower + rng.integers(1, 60, n)
    df = spark.createDataFrame(pd.DataFrame({"e": 1, "arm_id": np.arange(n), "upper": upper, "lower": lower}))
    few = bandit.candidates(df, "e", picks)
    assert few.count() <= 2 * picks + 1
    got = [r["arm_id"] for r in bandit.choose_batches(df, "e", picks).orderBy("place").collect()]
    assert got == bandit.choose(upper, lower, picks)[0]
    one = spark.createDataFrame([(1, 5, 2.0, 1.0)], "e int, arm_id long, upper double, lower double")
    assert [tuple(r) for r in bandit.choose_batches(one, "e", 3).collect()] == [(1, 5, 0)]


def test_choice_equals_plain_loops():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lower = rng.integers(0, 6, 9).astype(float)
        upper = lower + rng.integers(1, 6, 9)
        free, want = list(range(9)), []
        for _ in range(7):
            gap = {k: max(upper[j] for j in range(9) if j != k) - lower[k] for k in free}
            best = min(free, key=lambda k: (gap[k], k))
            rival = min((k for k in free if k != best), key=lambda k: (-upper[k], k))
            want.append(best if upper[best] - lower[best] >= upper[rival] - lower[rival] else rival)
            free.remove(want[-1])
        assert bandit.choose(upper, lower, 7)[0] == want
