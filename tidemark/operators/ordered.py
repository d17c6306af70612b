"""Order over all rows without one task that holds them: cuts, segmented scans, ranks, inversions.

Rows are cut into ranges of their order, of about equal size. A range is worked through by itself; what a row needs
from the rows before its range comes from a summary of each range, over which the same step runs once more. A key
of any size is then spread over as many tasks as it has ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, and ranges at most; sampled rows a range from which the cuts are taken.
ROWS, RANGES, SAMPLED = 1 << 19, 1 << 14, 50
#: Ranges of x and of y between which pairs are counted by cells, at most, and rows of such a range.
PAIR_RANGES, PAIR_ROWS = 1024, 1 << 16


def _halves(many: int) -> list[int]:
    """The steps of a search by halves among ``many`` cuts: ten times the cuts take three steps more."""
    return [1 << k for k in reversed(range(many.bit_length()))]


def _step(at: Column, step: Column, cuts: Column, own: Column) -> Column:
    return at + F.when(F.get(cuts, at + step - 1) <= own, step).otherwise(F.lit(0))


def chunked(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None, out: str = "__chunk", edge: tuple[str, int] | None = None) -> DataFrame:
    """``df`` with a number that rises along (keys, order): rows of one number follow each other there, ``rows`` of them or about as many.

    The cuts are taken from a sample; they change no result. Rows that are equal in keys and order get one number. ``edge`` is the name of a
    further column and how many of the first columns it looks at: the number of the first cut that equals the row in these, null if none does. Rows
    that are equal there stand in one range if it is null, and otherwise in the range that this cut ends, the next, or both and those behind.
    """
    rows = rows or ROWS
    by = [*keys, *order]
    n = df.count()
    many = min(RANGES, math.ceil(n / rows))
    cuts = []
    if many > 1:
        own = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)))
        names = own.columns
        share = min(1.0, SAMPLED * many / n)
        sampled = own if share == 1.0 else own.sample(share, seed=7)
        firsts = sampled.repartitionByRange(many, *(F.asc_nulls_first(c) for c in names)).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*names)).alias("first"))
        # a row a range; the list stays small, whatever the table
        cuts = [r["first"] for r in firsts.orderBy("first").collect()][1:]
    if not cuts:
        return df.withColumns({out: F.lit(0)} | ({edge[0]: F.lit(None).cast("int")} if edge else {}))
    first = [0] * len(cuts)
    for k in range(1, len(cuts)):
        same = edge and all(a == b or a != a and b != b for a, b in zip(cuts[k - 1][: edge[1]], cuts[k][: edge[1]]))
        first[k] = first[k - 1] if same else k
    struct = own.schema.simpleString()
    table = df.sparkSession.createDataFrame([(cuts, first)], f"__cuts array<{struct}>, __first array<int>")
    placed = df.crossJoin(F.broadcast(table))  # one row
    # a column a step, which is compiled; a lambda over the steps is not, and takes many times as long
    placed = placed.withColumn("__own", F.struct(*(F.col(c).alias(n) for c, n in zip(by, names))).cast(struct)).withColumn(out, F.lit(0))
    for step in _halves(len(cuts)):
        placed = placed.withColumn(out, _step(F.col(out), F.lit(step), F.col("__cuts"), F.col("__own")))
    if edge:
        def at(k: Column) -> Column:
            equal = [F.get("__cuts", k)[n].eqNullSafe(F.col(c)) for c, n in zip(by[: edge[1]], names)]
            return F.when((k >= 0) & (k < len(cuts)) & reduce(lambda a, b: a & b, equal), F.get("__first", k))

        placed = placed.withColumn(edge[0], F.coalesce(at(F.col(out) - 1), at(F.col(out))))
    return placed.drop("__cuts", "__first", "__own")


def scan(
    df: DataFrame, keys: list[str], order: list[str], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None,
    upto: dict[str, Column] | None = None, onward: dict[str, Column] | None = None, number: str | None = None, total: dict[str, tuple] | None = None, chunk: str = "__chunk",
) -> DataFrame:
    """A scan along ``order`` in every key, for rows that chunked() has numbered.

    ``before`` and ``after`` give a column of the row before and after, null at the ends of the key; ``upto`` the last value that
    is not null up to this row, ``onward`` the first from this row on; ``number`` counts the rows of the key from 1; ``total`` has pairs
    of a column and an aggregate of all its values in the key that is its own combination (F.min, F.max, F.sum). Order must tell the rows of a key apart.
    """
    before, after, upto, onward, total = before or {}, after or {}, upto or {}, onward or {}, total or {}
    temporary = {n: f"__{n}" for n in (*before, *after, *upto, *onward)}
    own = df.select("*", *(c.alias(temporary[n]) for part in (before, after, upto, onward) for n, c in part.items()), *(c.alias(f"__{n}") for n, (c, _) in total.items()))
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    # a frame to the end is summed anew for every row; the same frame in reverse order is not
    on = Window.partitionBy(*keys, chunk).orderBy(*(F.desc_nulls_last(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    local = own.select(
        "*", F.row_number().over(w).alias("__row"), (F.lead(F.lit(1)).over(w).isNull()).alias("__end"),
        *(F.lag(temporary[n]).over(w).alias(f"__in_{n}") for n in before), *(F.lead(temporary[n]).over(w).alias(f"__in_{n}") for n in after),
        *(F.last(temporary[n], ignorenulls=True).over(back).alias(f"__in_{n}") for n in upto), *(F.last(temporary[n], ignorenulls=True).over(on).alias(f"__in_{n}") for n in onward),
    )
    known = lambda n: F.when(F.col(temporary[n]).isNotNull(), at)
    summary = own.groupBy(*keys, chunk).agg(
        F.count("*").alias("__rows"),
        *(F.max_by(F.struct(temporary[n]), at).alias(f"__s_{n}") for n in before), *(F.min_by(F.struct(temporary[n]), at).alias(f"__s_{n}") for n in after),
        *(F.max_by(temporary[n], known(n)).alias(f"__s_{n}") for n in upto), *(F.min_by(temporary[n], known(n)).alias(f"__s_{n}") for n in onward),
        *(f(f"__{n}").alias(f"__s_{n}") for n, (_, f) in total.items()),
    )
    # a row a range of the key
    along = Window.partitionBy(*keys).orderBy(chunk)
    past, all_ = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    coming = Window.partitionBy(*keys).orderBy(F.desc(chunk)).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *(F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)), F.col(chunk).alias("__of"), F.coalesce(F.sum("__rows").over(past), F.lit(0)).alias("__offset"),
        *(F.lag(f"__s_{n}").over(along)[temporary[n]].alias(f"__c_{n}") for n in before), *(F.lead(f"__s_{n}").over(along)[temporary[n]].alias(f"__c_{n}") for n in after),
        *(F.last(f"__s_{n}", ignorenulls=True).over(past).alias(f"__c_{n}") for n in upto), *(F.last(f"__s_{n}", ignorenulls=True).over(coming).alias(f"__c_{n}") for n in onward),
        *(f(f"__s_{n}").over(all_).alias(f"__c_{n}") for n, (_, f) in total.items()),
    )
    match = F.col(chunk) == F.col("__of")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    made = {n: F.when(F.col("__row") == 1, F.col(f"__c_{n}")).otherwise(F.col(f"__in_{n}")) for n in before}
    made |= {n: F.when(F.col("__end"), F.col(f"__c_{n}")).otherwise(F.col(f"__in_{n}")) for n in after}
    made |= {n: F.coalesce(f"__in_{n}", f"__c_{n}") for n in (*upto, *onward)} | {n: F.col(f"__c_{n}") for n in total}
    if number:
        made[number] = F.col("__offset") + F.col("__row")
    return local.join(carried, match).select(*(c for c in df.columns if c not in made), *(c.alias(n) for n, c in made.items()))


def ranked(df: DataFrame, value: str, tie: list[str], descending: bool = True, rows: int | None = None, unique: str = "place", average: str = "average") -> DataFrame:
    """``df`` with two ranks over all rows: ``unique`` from 1, equals by ``tie``, and ``average``, in which equals share the mean of their places.

    Null values come after all others, and share their places as well. A value that very many rows have is cut into ranges by its ties.
    The rows are sorted once, inside their ranges. Only a value that a cut has can stand in several ranges; its places come from the ranges' row numbers.
    """
    signed = -F.col(value) if descending else F.col(value)
    own = df.withColumn("__null", F.col(value).isNull()).withColumn("__v", signed)
    numbered = chunked(own, [], ["__null", "__v", *tie], rows, edge=("__edge", 2))
    chunk = Window.partitionBy("__chunk")
    # the finest order first: one sort serves all three
    local = numbered.withColumn("__n", F.row_number().over(chunk.orderBy("__null", "__v", *tie)))
    local = local.withColumn("__r", F.rank().over(chunk.orderBy("__null", "__v"))).withColumn("__same", F.count("*").over(chunk.orderBy("__null", "__v").rangeBetween(Window.currentRow, Window.currentRow)))
    # three rows a range at most: what the cut before it has, what the cut after it has, and all else
    counted = numbered.groupBy("__chunk", "__edge").agg(F.count("*").alias("__m"))
    before = Window.orderBy("__chunk").rangeBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__offset", F.coalesce(F.sum("__m").over(before), F.lit(0))).withColumn("__rows", F.sum("__m").over(chunk))
    # a value's rows begin its range if the cut there is the first with it, and end it otherwise
    begins = F.col("__offset") + F.when(F.col("__chunk") > F.col("__edge"), F.lit(0)).otherwise(F.col("__rows") - F.col("__m"))
    of_edge = Window.partitionBy("__edge")
    edges = placed.select(
        F.col("__chunk").alias("__of"), F.col("__edge").alias("__at"), "__offset",
        F.when(F.col("__edge").isNotNull(), F.min(begins).over(of_edge) + 1).alias("__begins"), F.sum("__m").over(of_edge).alias("__total"),
    )
    both = local.join(F.broadcast(edges), (F.col("__chunk") == F.col("__of")) & F.col("__edge").eqNullSafe(F.col("__at")))
    mean = F.when(F.col("__edge").isNull(), F.col("__offset") + F.col("__r") + (F.col("__same") - 1) / 2).otherwise(F.col("__begins") + (F.col("__total") - 1) / 2)
    return both.select(*df.columns, (F.col("__offset") + F.col("__n")).alias(unique), mean.alias(average))


def _value_ranges(df: DataFrame, value: str, rows: int, n: int | None = None) -> tuple[Column, Column]:
    """The range of a value and whether all values of its range are equal; a value that fills ranges has one of its own. ``n`` is the number of rows."""
    n = df.count() if n is None else n
    many = max(1, min(PAIR_RANGES, math.ceil(n / rows)))
    if many == 1:
        return F.lit(0), F.lit(False)
    share = min(1.0, SAMPLED * many / n)
    sampled = df if share == 1.0 else df.sample(share, seed=7)
    found = sampled.agg(F.percentile_approx(value, [k / many for k in range(1, many)], 100 * many)).first()[0] or []
    # a cut before each value and, behind those that fill a range, another
    hot = sorted({v for v in found if found.count(v) > 1})
    cuts = sorted(set(found))
    if not cuts:
        return F.lit(0), F.lit(False)
    kind = dict(df.dtypes)[value]

    def below(values: list, own: Column) -> Column:
        """The number of values that are not greater."""
        table = F.array(*(F.lit(v).cast(kind) for v in values))
        return F.aggregate(F.array(*map(F.lit, _halves(len(values)))), F.lit(0), lambda at, step: _step(at, step, table, own))

    own = F.col(value)
    if not hot:
        return below(cuts, own), F.lit(False)
    return below(cuts, own) + below(hot, own) - own.isin(*hot).cast("int"), own.isin(*hot)


def inversions(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], by merging runs of doubled length."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    n, found, width = len(rank), 0, 1
    while width < n:
        # every pair of runs is merged at once: runs are told apart by adding a multiple of n
        run = np.arange(n) // (2 * width)
        key = run * n + rank
        left = (np.arange(n) // width) % 2 == 0
        lefts, rights = key[left], key[~left]  # each half is in order, and so are the halves of all runs
        above = np.searchsorted(lefts, (run[~left] + 1) * n) - np.searchsorted(lefts, rights, side="right")
        found += int(above.sum())
        rank = np.sort(key, kind="stable") - run * n
        width *= 2
    return found


def _discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs with x < x' and y > y'."""
    order = np.lexsort((y, x))  # equal x rise in y, which makes no inversion
    return inversions(y[order])


def discordant(pairs: DataFrame, x: str, y: str, keys: list[str], rows: int | None = None) -> DataFrame:
    """keys and n: the pairs of rows of a key with x < x' and y > y', for rows without nulls.

    x and y are cut into ranges, which makes cells. Two rows in different ranges of both are counted from the cells' row
    numbers; those in one range of x, and those in one range of y but in different ones of x, by merging inside it. A
    value that fills a range has no such pair there, so that no range need hold more than its share.
    """
    rows = rows or PAIR_ROWS
    n = pairs.count()
    x_range, x_same = _value_ranges(pairs, x, rows, n)
    y_range, y_same = _value_ranges(pairs, y, rows, n)
    names = [f"k{i}" for i in range(len(keys))]
    own = pairs.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(x).alias("x"), F.col(y).alias("y"), x_range.alias("r"), y_range.alias("c"), x_same.alias("x_same"), y_same.alias("y_same"))
    kinds = dict(own.dtypes)
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "n long"])

    def out(key: Iterable[pa.Scalar], n: int) -> pa.Table:
        return pa.table({**{name: pa.array([v.as_py()], v.type) for name, v in zip(names, key)}, "n": pa.array([n], pa.int64())})

    def in_x(key: tuple, part: pa.Table) -> pa.Table:
        return out(key[:-1], _discordant(part.column("x").to_numpy(), part.column("y").to_numpy()))

    def in_y(key: tuple, part: pa.Table) -> pa.Table:
        a, b, r = (part.column(c).to_numpy() for c in ("x", "y", "r"))
        # pairs of one range of x as well were counted there: they are what is left if y rises from each range of x to the next
        rank = np.unique(b, return_inverse=True)[1].astype(np.int64)
        return out(key[:-1], _discordant(a, rank) - _discordant(a, r.astype(np.int64) * len(rank) + rank))

    def between(key: tuple, part: pa.Table) -> pa.Table:
        r, c, n = (part.column(name).to_numpy() for name in ("r", "c", "n"))
        order = np.argsort(r, kind="stable")
        r, c, n = r[order], c[order], n[order]
        seen, found = np.zeros(int(c.max(initial=0)) + 2, dtype=np.int64), 0
        for lot in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r)) + 1):
            more = seen.sum() - np.cumsum(seen)  # rows of earlier ranges of x in ranges of y above each
            found += sum(int(a) * int(b) for a, b in zip(n[lot], more[c[lot]]))
            np.add.at(seen, c[lot], n[lot])
        return out(key, found)

    cells = own.groupBy(*names, "r", "c").agg(F.count("*").alias("n")).groupBy(*names) if names else own.groupBy("r", "c").agg(F.count("*").alias("n")).groupBy(F.lit(0).alias("all"))
    parts = [
        own.filter("not x_same").select(*names, "r", "x", "y").groupBy(*names, "r").applyInArrow(in_x, schema),
        own.filter("not y_same").select(*names, "c", "r", "x", "y").groupBy(*names, "c").applyInArrow(in_y, schema),
        cells.applyInArrow(between if names else lambda key, part: between((), part), schema),
    ]
    return parts[0].union(parts[1]).union(parts[2]).groupBy(*(F.col(n).alias(k) for n, k in zip(names, keys))).agg(F.sum("n").alias("n"))
