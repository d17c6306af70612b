"""Sharding along a Hilbert curve through quantised metadata.

DataFrame functions only. Language, source and size are quantised to a few bits each, every
cell of that grid gets its index on the Hilbert curve, and the curve is cut into runs of
nearly equal bytes. A shard then covers a compact piece of all three dimensions, so that
files can be skipped by any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, settle, spread_join

SHARDS = 16
BITS = 4
DIMENSIONS = ("lang", "source", "size")
#: Pieces that all cells are split into at most, besides one piece a cell; a piece is placed by one task.
PIECES = 8192
#: Ranges that the distinct names of a dimension are ordered in, names of a range where they are many, and ranges at most.
NAME_RANGES, NAMES_A_RANGE, MOST_NAME_RANGES = 64, 1 << 16, 1 << 16


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell with these coordinates, each in 0 .. 2**bits - 1.

    From the highest bit to the lowest, a set bit of an axis mirrors the bits below in the
    first axis and a clear one swaps them between the two; what is left is a Gray code over
    the axes, whose bits are then interleaved.
    """
    n = len(axes)
    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(k).alias("k")) for b in range(bits - 1, 0, -1) for k in range(n)))

    def turn(x: Column, step: Column) -> Column:
        low, at = step["q"] - 1, step["k"] + 1
        first, own = F.element_at(x, 1), F.element_at(x, at.cast("int"))
        differ = first.bitwiseXOR(own).bitwiseAND(low)
        new_first = F.when(own.bitwiseAND(step["q"]) != 0, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(differ))
        new_own = F.when(own.bitwiseAND(step["q"]) != 0, own).otherwise(own.bitwiseXOR(differ))
        return F.transform(x, lambda v, i: F.when(i == 0, new_first).when(i == step["k"], new_own).otherwise(v))

    turned = F.aggregate(steps, F.array(*(a.cast("int") for a in axes)), turn)
    gray = F.aggregate(turned, F.array().cast("array<int>"), lambda done, v: F.concat(done, F.array(F.when(F.size(done) == 0, v).otherwise(v.bitwiseXOR(F.element_at(done, -1))))))
    last = F.element_at(gray, -1)
    mask = F.aggregate(F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    places = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b in range(bits - 1, -1, -1) for k in range(n)))
    code = F.transform(gray, lambda v: v.bitwiseXOR(mask))
    one = lambda p: F.call_function("shiftright", F.element_at(code, (p["k"] + 1).cast("int")), p["b"]).bitwiseAND(1)
    return F.aggregate(places, F.lit(0), lambda h, p: h * 2 + one(p)).cast("long")


def _name_cells(coded: DataFrame, name: str, cells: int) -> DataFrame:
    """Each name of a column, whole, and its cell: names in their order, cut into runs of nearly equal numbers of rows.

    Ranges of names are numbered apart and offset by the rows of the ranges before, so that no task orders all names.
    """
    counted = settle(coded.groupBy(name).agg(F.count("*").alias("n")))
    ranges = min(MOST_NAME_RANGES, max(NAME_RANGES, counted.count() // NAMES_A_RANGE))
    ranged = settle(counted.repartitionByRange(ranges, name).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over MOST_NAME_RANGES rows at most
    offsets = sums.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("range").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return ranged.join(F.broadcast(offsets), "range").select(name, F.floor(place * cells / F.col("total")).cast("int").alias(f"{name}_cell"))


def _with_cells(coded: DataFrame, name: str, cells: int) -> DataFrame:
    found = settle(_name_cells(coded, name, cells))
    rows, size = found.agg(F.count("*"), F.sum(F.octet_length(name))).first()
    if fits_broadcast(rows, size or 0):
        return coded.join(F.broadcast(found), name)
    return spread_join(settle(coded), found, [name])


def _cut(value: str, edges: list[float]) -> Column:
    """How many of the edges lie below the value."""
    return reduce(lambda a, b: a + b, (F.when(F.col(value) > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0)).cast("int")


def place(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve (Hilbert index) of every row of ``docs``.

    The law is ``bytes``: with ``size`` the UTF-8 bytes of the text plus one (null: one), a row
    goes to the shard in whose sixteenth of all bytes it begins, so that no two shards differ by
    more than the two largest rows. ``slot`` counts the rows of a shard along the curve.
    Languages and sources are ordered by their whole names. Rows of one cell are ordered by a hash of doc_id, text_crc32 and size,
    then by these; what is equal in all is interchangeable, and equal texts of one language and source
    are in one cell, but may lie on both sides of a border between shards. Null and empty
    languages and sources come before all others. An empty table gives an empty result; other columns are not read.

    Passes: one over the documents that keeps only numbers and names, and some over those. What goes
    to one task or is broadcast has at most 2**(3*bits) cells or that and PIECES rows more, or MOST_NAME_RANGES rows, or names of a checked number.
    """
    text_crc32 = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    # rows of one id, also of none, are told apart by their text
    coded = settle(docs.select("doc_id", size.alias("size"), text_crc32.alias("text_crc32"), *names, F.xxhash64("doc_id", text_crc32, size).alias("spread")))
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    total = coded.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.percentile_approx("size", shares, 10_000).alias("size")).first()
    numbers = coded
    for name in ("lang", "source"):
        numbers = _with_cells(numbers, name, 1 << bits)
    numbers = numbers.select("doc_id", "size", "text_crc32", "spread", "lang_cell", "source_cell", _cut("size", total["size"] or []).alias("size_cell"))
    key = [f"{d}_cell" for d in DIMENSIONS]

    most = max(1, -(-total["n"] // PIECES))
    per_cell = numbers.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("long").alias("parts"))
    curve = per_cell.select(*key, "parts", hilbert_index([F.col(k) for k in key], bits).alias("curve"))
    # within a cell, pieces are ranges of the hash, so that they follow one another in its order
    part = F.least(F.floor((F.col("spread").cast("double") / 2.0**64 + 0.5) * F.col("parts")), F.col("parts") - 1).cast("long")
    rows = numbers.join(F.broadcast(curve), key).select("doc_id", "size", "text_crc32", "curve", part.alias("part"), "spread")
    rows = settle(rows)

    before = Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)  # over pieces, not over rows
    pieces = rows.groupBy("curve", "part").agg(F.sum("size").alias("bytes"))
    starts = pieces.select("curve", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    along = Window.partitionBy("curve", "part").orderBy("spread", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("bytes_before") + F.coalesce(F.sum("size").over(along), F.lit(0))
    placed = rows.join(F.broadcast(starts), ["curve", "part"]).withColumn("begin", begin)
    placed = placed.withColumn("shard", F.least(F.expr(f"(begin * {shards}) div {max(1, total['bytes'] or 0)}"), F.lit(shards - 1)).cast("int"))
    placed = settle(placed.select("doc_id", "size", "text_crc32", "curve", "part", "spread", "shard"))

    # a piece may reach over a border: slots go on from the rows of the shard in the pieces before
    counts = placed.groupBy("shard", "curve", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "curve", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("shard", "curve", "part").orderBy("spread", "doc_id", "size", "text_crc32")
    return placed.join(F.broadcast(offsets), ["shard", "curve", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rows_before") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def pruning(docs: DataFrame, placed: DataFrame, steps: int = 8) -> DataFrame:
    """How many shards a reader must open: by (of which dimensions a filter is), values (filters there are), shards (in which a filter's rows lie, on average) and all_shards.

    Filters are each value of one or two of language, source and a range of size (``steps`` ranges of equal rows). ``placed`` is place() of ``docs``, or
    any other dealing of its ids to shards. Ids must be unique; rows without one are left out. An empty table gives no rows.
    """
    named = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    rows = settle(named.join(placed.select("doc_id", "shard"), "doc_id"))
    edges = rows.agg(F.percentile_approx("bytes", [k / steps for k in range(1, steps)], 10_000)).first()[0] or []
    ranged = rows.withColumn("size", _cut("bytes", edges))
    total = ranged.agg(F.count_distinct("shard").alias("all_shards"))
    parts = []
    for by in (("lang",), ("source",), ("size",), ("lang", "source"), ("lang", "size"), ("source", "size")):
        each = ranged.groupBy(*by).agg(F.count_distinct("shard").alias("n"))
        parts.append(each.groupBy().agg(F.count("*").alias("values"), F.avg("n").alias("shards")).select(F.lit("+".join(by)).alias("by"), "values", "shards"))
    return reduce(DataFrame.union, parts).filter("values > 0").crossJoin(F.broadcast(total))  # one row
