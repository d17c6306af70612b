"""Queries over parameter grids, names, selections and the experiment loop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import bandit, curves, policy
from ..sources import readers
from .tables import rounded, samples, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Rates that the lines of orders stand for, as axes of the policy space.
_AXES = {"c1": "round(3.6 + 40 * l_discount, 1)", "c2": "round(3.6 + 40 * l_tax, 1)", "c3": "round(3.2 + 0.4 * l_linenumber, 1)"}

_GRID = ", ".join(f"{c}_axis AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS {c}_at, count(*) OVER () AS {c}_n FROM (SELECT DISTINCT CAST({e} AS DOUBLE) AS {c} FROM lineitem))" for c, e in _AXES.items()) + """, combos AS (
  SELECT CAST((c1_at * c2_n + c2_at) * c3_n + c3_at AS INTEGER) AS position, c1, c2, c3,
    CASE WHEN CAST(1 AS DOUBLE) / 6 - (0.2::DOUBLE / c1 + 0.2::DOUBLE / c2 + 0.2::DOUBLE / c3) <> 0 THEN 0.2::DOUBLE / (CAST(1 AS DOUBLE) / 6 - (0.2::DOUBLE / c1 + 0.2::DOUBLE / c2 + 0.2::DOUBLE / c3)) END AS c4
  FROM c1_axis, c2_axis, c3_axis
), grid AS (SELECT * FROM combos WHERE c4 BETWEEN 0.1 AND 4.81 AND NOT (c1 = 4.8 AND c2 = 4.8 AND c3 = 4.8))"""


def _axis(spark, sf_dir, name):
    return table(spark, sf_dir, "lineitem").select(F.expr(f"cast({_AXES[name]} as double)").alias(name)).distinct()


def _grid(spark, sf_dir):
    """Every valid policy of the rates that the table holds."""
    return policy.valid(policy.combinations(*(_axis(spark, sf_dir, c) for c in _AXES)))


@query(f"WITH {_GRID} SELECT position, c1, c2, c3, round(c4, 3) AS c4 FROM grid")
def policy_grid(spark, sf_dir):
    return _grid(spark, sf_dir).withColumn("c4", F.round("c4", 3))


@query(f"WITH {_GRID} SELECT position, row_number() OVER (ORDER BY md5('7-' || position), position) - 1 AS arm_id FROM grid")
def shuffled_policies(spark, sf_dir):
    return policy.shuffled(_grid(spark, sf_dir).select("position"), "position", 7)


@query(f"""WITH {_GRID} SELECT position, printf('%sC-%sC-%sC-%.3fC: %.0f', c1::VARCHAR, c2::VARCHAR, c3::VARCHAR, c4, position::DOUBLE) AS label,
  replace(replace(replace(c1 || '_' || c2 || '_' || c3, '.', 'pt') || '.sdu', 'pt0_', '_'), 'pt0.', '.') AS file, round_even(c1 * 1.1::DOUBLE, 4) AS current,
  CASE WHEN c1 * 1.1::DOUBLE > 5 THEN 'Range1' ELSE 'Range2' END AS instrument_range FROM grid""")
def policy_label(spark, sf_dir):
    return _grid(spark, sf_dir).select(
        "position", text.life_label([F.col(c).cast("string") for c in ("c1", "c2", "c3")] + [F.col("c4")], F.col("position").cast("double")).alias("label"),
        text.machine_file(F.col("c1"), F.col("c2"), F.col("c3")).alias("file"), scalars.rate_to_current(F.col("c1")).alias("current"),
        scalars.current_range(F.col("c1") * 1.1, 5).alias("instrument_range"),
    )


@query(f"""WITH {_GRID}, mesh AS (SELECT c3, round(3.6 + i * 0.1, 6)::DOUBLE AS c1, round(3.6 + j * 0.1, 6)::DOUBLE AS c2 FROM c3_axis, (SELECT unnest(generate_series(0, 44)) AS i), (SELECT unnest(generate_series(0, 34)) AS j)
), rated AS (SELECT *, 1::DOUBLE / 6 - (0.2::DOUBLE / c1 + 0.2::DOUBLE / c2 + 0.2::DOUBLE / c3) AS left_over FROM mesh
), m AS (SELECT c1, c2, c3, CASE WHEN left_over <> 0 AND 0.2 / left_over BETWEEN 0.1 AND 4.81 THEN 0.2 / left_over END AS c4 FROM rated)
SELECT c1, c2, c3, round(c4, 6) AS c4, round(60 / c1 * 40 / 100 + 60 / c2 * 40 / 100, 6) AS minutes,
  CASE WHEN c1 <> c2 THEN round(100 * (10 - 48 / c2) / (60 / c1 - 60 / c2), 4) END AS switch FROM m""")
def facet_mesh(spark, sf_dir):
    mesh = policy.mesh(_axis(spark, sf_dir, "c3"), (3.6, 0.1, 45), (3.6, 0.1, 35))
    c1, c2 = F.col("c1"), F.col("c2")
    out = mesh.select("c1", "c2", "c3", "c4", scalars.minutes_to_80(c1, F.lit(40.0), c2).alias("minutes"), F.when(c1 != c2, F.round(scalars.switch_for_minutes(F.lit(10.0), c1, c2), 4)).alias("switch"))
    return rounded(out)


@query(f"""WITH {_GRID}, step AS (SELECT position, unnest([0, 1, 2, 3]) AS step, unnest([c1, c2, c3, c4]) AS rate FROM grid)
SELECT position, CAST(step AS INTEGER) AS step, step * 20.0::DOUBLE AS soc_low, (step + 1) * 20.0::DOUBLE AS soc_high, round(rate, 6) AS rate FROM step""")
def step_profile(spark, sf_dir):
    return rounded(curves.step_profile(_grid(spark, sf_dir).select("position", "c1", "c2", "c3", "c4"), ["c1", "c2", "c3", "c4"]).select("position", "step", "soc_low", "soc_high", "rate"))


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS grid_idx, round(89 + i * (11.0::DOUBLE / 19), 6) AS soc, round(p_size * exp(-0.5 * (i * (11.0::DOUBLE / 19))), 6) AS current FROM part, (SELECT unnest(generate_series(0, 19)) AS i)""")
def voltage_tail(spark, sf_dir):
    return rounded(curves.voltage_tail(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], points=20))


def _own_grid_sql(points: int, first: str, last: str) -> str:
    return f"""WITH ends AS (SELECT user_id AS unit, max(value) AS high, min(value) AS low FROM events GROUP BY 1)
SELECT unit, CAST(i AS INTEGER) AS grid_idx, round({first} + i * (({last} - {first}) / {points - 1}), 6) AS v FROM ends, (SELECT unnest(generate_series(0, {points - 1})) AS i)"""


@query(_own_grid_sql(100, "high", "low"))
def voltage_grid(spark, sf_dir):
    return rounded(curves.own_grid(samples(spark, sf_dir), "value", ["unit"], 100))


@query(_own_grid_sql(51, "low", "high"))
def rising_grid(spark, sf_dir):
    return rounded(curves.own_grid(samples(spark, sf_dir), "value", ["unit"], 51, rising=True))


@query("""WITH v AS (SELECT embedding::DOUBLE[] AS e FROM embeddings), cell AS (SELECT """ + ", ".join(f"least(greatest(round((e[{k}] + 1) / 2 * 7), 0), 7) / 7 AS {c}" for k, c in ((1, "r"), (2, "g"), (3, "b"))) + """ FROM v)
SELECT round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, count(*) AS n FROM cell GROUP BY ALL""")
def colour_lattice(spark, sf_dir):
    """Vectors at each point of a lattice over their first three dimensions."""
    first = table(spark, sf_dir, "embeddings").select(*(F.get(F.col("embedding").cast("array<double>"), k).alias(f"x{k}") for k in range(3)))
    return rounded(curves.lattice_cells(first, ["x0", "x1", "x2"], -1.0, 1.0, 8))


@query("""WITH lines AS (SELECT p_brand AS file, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS line_no, p_name AS text, p_size FROM part)
SELECT file, line_no, CASE WHEN p_size > 25 THEN 'size=' || p_size ELSE text END AS text FROM lines""")
def schedule_edits(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("int").alias("line_no"), F.col("p_name").alias("text"), "p_size")
    edits = lines.filter("p_size > 25").select("file", "line_no", F.concat(F.lit("size="), F.col("p_size").cast("string")).alias("text"))
    return policy.edited(lines.drop("p_size"), edits)


@query(r"""WITH n AS (SELECT p_partkey AS id, p_size AS s, p_brand FROM part), named AS (
  SELECT id, s || 'C(' || (s + 10) || '%)-' || (s % 7) || '.6C' AS two, s || '.5-4.8-' || (s % 9) || '-3.6' AS steps, 'EL' || id || '00' AS barcode, '2018-04-12_batch_CH' || (s + 1) || '.csv' AS file,
    s || 'C_' || (s + 10) || 'PER_' || (s % 7) || '_6C' AS raw, '3_6PT' || s || '_4PT0' AS oed, s || ' 1.5 x ' || id AS list FROM n)
SELECT id, TRY_CAST(regexp_extract(two, '^([0-9.]+)C', 1) AS DOUBLE) AS first, TRY_CAST(regexp_extract(two, '\(([0-9.]+)%\)', 1) AS DOUBLE) AS switch, TRY_CAST(regexp_extract(two, '-([0-9.]+)C', 1) AS DOUBLE) AS second,
  TRY_CAST(split_part(steps, '-', 3) AS DOUBLE) AS third, coalesce(TRY_CAST(substr(barcode, 3) AS BIGINT), 0) AS barcode, TRY_CAST(regexp_extract(file, '_CH(\d+)\.', 1) AS INTEGER) AS channel,
  regexp_extract(file, '^[^_]*_(.*)_[^_]*$', 1) AS inner_name, CAST(substr(file, 1, 10) AS DATE) AS day,
  regexp_replace(replace(replace(replace(raw, 'C_', 'C('), '_', '.'), 'PER.', '%)-'), 'C\d', 'C(' || regexp_extract(replace(replace(replace(raw, 'C_', 'C('), '_', '.'), 'PER.', '%)-'), 'C(\d)', 1), 'g') AS structured,
  replace(replace(oed, '_', '-'), 'PT', '.') AS stepped, list_transform(string_split(list, ' '), lambda x: TRY_CAST(x AS DOUBLE)) AS numbers, length(two) - length(replace(two, '%', '')) = 2 AS experimental
FROM named""")
def string_parse(spark, sf_dir):
    s, i = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    plus, mod = (F.col("p_size") + 10).cast("string"), (F.col("p_size") % 7).cast("string")
    named = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(s, F.lit("C("), plus, F.lit("%)-"), mod, F.lit(".6C")).alias("two"), F.concat(s, F.lit(".5-4.8-"), (F.col("p_size") % 9).cast("string"), F.lit("-3.6")).alias("steps"),
        F.concat(F.lit("EL"), i, F.lit("00")).alias("code"), F.concat(F.lit("2018-04-12_batch_CH"), (F.col("p_size") + 1).cast("string"), F.lit(".csv")).alias("file"),
        F.concat(s, F.lit("C_"), plus, F.lit("PER_"), mod, F.lit("_6C")).alias("raw"), F.concat(F.lit("3_6PT"), s, F.lit("_4PT0")).alias("oed"), F.concat(s, F.lit(" 1.5 x "), i).alias("list"),
    )
    first, switch, second = text.two_step_parts(F.col("two"))
    return named.select(
        "id", first.alias("first"), switch.alias("switch"), second.alias("second"), text.step_part(F.col("steps"), 3).alias("third"), text.barcode_number(F.col("code")).alias("barcode"),
        text.channel_of_file(F.col("file")).alias("channel"), text.inner_name(F.col("file")).alias("inner_name"), text.date_of_name(F.col("file")).alias("day"),
        text.readable_structured(F.col("raw")).alias("structured"), text.readable_steps(F.col("oed")).alias("stepped"), text.numbers(F.col("list")).alias("numbers"), text.has_two_percents(F.col("two")).alias("experimental"),
    )


@query("""WITH v AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS n FROM orders), chosen AS (SELECT o_custkey AS c_custkey, max(n) AS orders FROM v GROUP BY 1 HAVING max(n) >= 12)
SELECT c_custkey, c_mktsegment, orders FROM customer JOIN chosen USING (c_custkey)""")
def semi_align(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("int").alias("orders")).filter("orders >= 12")
    arms = table(spark, sf_dir, "customer").join(chosen, "c_custkey", "left_semi")
    return arms.join(chosen, "c_custkey").select("c_custkey", "c_mktsegment", "orders")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def anti_set(spark, sf_dir):
    taken = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return readers.without_denied(table(spark, sf_dir, "customer"), taken, ["c_custkey"]).select("c_custkey", "c_nationkey")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def denylist(spark, sf_dir):
    denied = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    return readers.without_denied(table(spark, sf_dir, "events"), denied, ["user_id"]).select("event_id", "user_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def index_intersection(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").intersect(table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey"))


@query("""WITH part AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE label IS NOT NULL), centre AS (SELECT label, k, avg(x) AS x FROM part GROUP BY label, k),
own AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)
SELECT vec_id AS i, label AS j, round(exp(-0.5 * sum((own.x - centre.x) * (own.x - centre.x))), 6) AS k FROM own JOIN centre USING (k) GROUP BY vec_id, label""")
def kernel_matrix(spark, sf_dir):
    """The kernel of every vector with the centres of all labels, each the mean of all its vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    part = vectors.filter("label is not null").select("label", F.posexplode("e").alias("k", "x"))
    means = part.groupBy("label", "k").agg(F.avg("x").alias("x"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("kx")).select("label", F.col("kx.x").alias("e"))  # a row a dimension
    return rounded(bandit.kernel_to(vectors, "vec_id", centres, "label", "e", 0.5))


@query(f"""WITH {_GRID}
SELECT a.position AS i, b.position AS j, round(exp(-0.5 * ((a.c1 - b.c1) * (a.c1 - b.c1) + (a.c2 - b.c2) * (a.c2 - b.c2) + (a.c3 - b.c3) * (a.c3 - b.c3))), 6) AS k FROM grid AS a, grid AS b""")
def policy_kernel(spark, sf_dir):
    """The kernel of every valid policy with every other."""
    arms = _grid(spark, sf_dir).select("position", F.array("c1", "c2", "c3").alias("point"))
    return rounded(bandit.kernel_to(arms, "position", arms, "position", "point", 0.5))


@query("""WITH b AS (SELECT l_suppkey AS arm, l_returnflag AS experiment, max(l_extendedprice) AS upper, min(l_extendedprice) AS lower FROM lineitem GROUP BY 1, 2), top AS (
  SELECT experiment, max(upper) AS first, arg_max(arm, (upper, -arm)) AS best FROM b GROUP BY 1), second AS (SELECT b.experiment, max(upper) AS second FROM b JOIN top ON b.experiment = top.experiment AND b.arm <> top.best GROUP BY 1)
SELECT arm, b.experiment, round(CASE WHEN arm = best THEN second ELSE first END - lower, 4) AS gap FROM b JOIN top USING (experiment) LEFT JOIN second USING (experiment)""")
def gap_index(spark, sf_dir):
    bounds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("arm"), F.col("l_returnflag").alias("experiment")).agg(F.max("l_extendedprice").alias("upper"), F.min("l_extendedprice").alias("lower"))
    return bandit.greatest_other(bounds, "upper", "arm", ["experiment"]).select("arm", "experiment", F.round(F.col("other") - F.col("lower"), 4).alias("gap"))


@query()
def farthest_point(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rounded(curves.farthest_points(vectors, "vec_id", "e", np.zeros(64), 6), 4)
