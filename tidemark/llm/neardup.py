"""Near-duplicate documents by a multi-index Hamming join of b-bit minhash signatures.

A signature holds ``size`` minhashes of 16 bits each; the distance of two signatures is
the number of places that differ. Signatures are split into ``chunks`` equal parts. If two
of them differ in less than 2 * chunks places, some part holds one error at most
(pigeonhole), so that the two share a key made of that part with one place left out: every
part yields a key for each place that an error can take. All pairs under the distance
are found that way; links are then confirmed on whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import discard, fits_broadcast, settle, small_batches, spread_join, text_key, unused
from .components import components

#: Places of a chunk; a key holds all but one of them, 64 bits.
PLACES = 5
#: Probability, at most, that two documents just at the threshold differ in too many places.
MISS = 1e-5
#: Members of a block in the exact comparison of crowded keys.
BLOCK = 256

@dataclass(frozen=True)
class Plan:
    """Similarity num/den over shingles of so many words, and the signature that finds it."""

    shingle: int
    num: int
    den: int
    chunks: int

    @property
    def size(self) -> int:
        return self.chunks * PLACES

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1


def plan(shingle: int = 5, num: int = 4, den: int = 5) -> Plan:
    """The shortest signature that misses a pair at the threshold with a probability under MISS."""
    error = 1 - num / den
    for chunks in range(4, 60):
        size = chunks * PLACES
        found = sum(math.comb(size, k) * error**k * (1 - error) ** (size - k) for k in range(2 * chunks))
        if 1 - found <= MISS:
            return Plan(shingle, num, den, chunks)
    raise ValueError("the similarity is too low for signatures of this kind")


def _multipliers(size: int) -> np.ndarray:
    return textkit.mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, both in order of rows and hashes.

    A row with words, but fewer than ``size``, has its whole sequence as one shingle.
    """
    starts, ends, row = textkit.words(data, at)
    hashes = textkit.range_hash(textkit.ASCII_LOWER[data], starts, ends)
    found, first = textkit.windows(hashes, row, size)
    of = row[first]
    count = textkit.per_row(len(at) - 1, row)
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            head = np.searchsorted(row, short)
            h = np.full(len(short), k, dtype=np.uint64)
            for j in range(k):
                h = h * np.uint64(0xC6BC279692B5C323) + hashes[head + j]
            found, of = np.concatenate([found, textkit.mix(h)]), np.concatenate([of, short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], of[new]


def signatures(found: np.ndarray, heads: np.ndarray, size: int) -> np.ndarray:
    """The 16-bit minhashes of every set; ``heads`` are the sets' first positions in ``found``."""
    out = np.empty((len(heads), size), dtype=np.uint16)
    for k, a in enumerate(_multipliers(size)):
        out[:, k] = np.minimum.reduceat((found * a) >> np.uint64(32), heads).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray, chunks: int) -> np.ndarray:
    """A key for every chunk and every place in it that may hold the allowed error."""
    parts = signature.reshape(len(signature), chunks, PLACES).astype(np.uint64)
    out = np.empty((len(signature), chunks * PLACES), dtype=np.uint64)
    for left_out in range(PLACES):
        key = np.zeros((len(signature), chunks), dtype=np.uint64)
        for place in range(PLACES):
            if place != left_out:
                key = key << np.uint64(16) | parts[:, :, place]
        tag = np.arange(chunks, dtype=np.uint64) * np.uint64(PLACES) + np.uint64(left_out)
        out[:, left_out::PLACES] = textkit.mix(textkit.mix(key) + tag * np.uint64(0xE7037ED1A0B428DB))
    return out


def _set_hash(found: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes of all rows, rows with a set, their first positions, and the two halves of a 128-bit hash of each set."""
    n = textkit.per_row(rows, of)
    full = np.flatnonzero(n)
    heads = np.searchsorted(of, full)
    sums = np.zeros((2, rows), dtype=np.uint64)
    if len(full):
        for k, seed in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
            sums[k, full] = np.add.reduceat(textkit.mix(found ^ np.uint64(seed)), heads)
    return n, full, heads, sums.view(np.int64)


_SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("signature", T.BinaryType()),
])


def sketch(docs: DataFrame, how: Plan) -> DataFrame:
    """doc_id, set size, 128-bit hash of the shingle set and signature of every row; no signature for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, at in textkit.runs(batch.column(1)):
                found, of = shingles(data, at, how.shingle)
                n, full, heads, sums = _set_hash(found, of, stop - row)
                signed: list[bytes | None] = [None] * (stop - row)
                if len(full):
                    for r, s in zip(full, signatures(found, heads, how.size)):
                        signed[r] = s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row).cast(pa.int64()), pa.array(n), *map(pa.array, sums), pa.array(signed, pa.binary())], names=_SKETCH.names)

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, _SKETCH)


_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def sets(docs: DataFrame, how: Plan) -> DataFrame:
    """doc_id and the whole shingle set, with its hash, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, at in textkit.runs(batch.column(1)):
                found, of = shingles(data, at, how.shingle)
                heads = np.searchsorted(of, np.arange(stop - row + 1)).astype(np.int32)
                sums = _set_hash(found, of, stop - row)[3]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(heads), pa.array(found.view(np.int64)))], names=_SETS.names)

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, _SETS)


def _whole_sets(docs: DataFrame, ids: DataFrame, how: Plan) -> DataFrame:
    """doc_id and each of its shingle sets, for these ids; texts are only shuffled if the ids are too many to broadcast."""
    ids = settle(ids.distinct())
    if fits_broadcast(ids.count()):
        ids = F.broadcast(ids)
    found = sets(docs.join(ids, "doc_id", "left_semi"), how)
    return found.dropDuplicates(["doc_id", "set_a", "set_b"]).select("doc_id", "shingles")


def _keys(classes: DataFrame, how: Plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys = chunk_keys(_matrix(batch.column(1), how.size), how.chunks)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keys.shape[1])), pa.array(keys.ravel().view(np.int64))], names=["node", "key"])

    return classes.select("node", "signature").mapInArrow(run, "node long, key long")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, size)


def _near(pairs: DataFrame, how: Plan) -> DataFrame:
    """The pairs (a, b) whose signatures are within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (_matrix(batch.column(2), how.size) != _matrix(batch.column(3), how.size)).sum(axis=1)
            yield batch.filter(pa.array(apart <= how.distance)).select(["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _side(frame: DataFrame, name: str, **columns: str) -> DataFrame:
    return frame.select(F.col(name).alias(columns.pop("to")), *(F.col(v).alias(k) for k, v in columns.items()))


def _confirmed(pairs: DataFrame, whole: DataFrame, how: Plan) -> DataFrame:
    """The pairs whose shingle sets are as similar as the plan asks."""
    joined = spread_join(pairs, _side(whole, "doc_id", to="a", xa="shingles"), ["a"]).join(_side(whole, "doc_id", to="b", xb="shingles"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return joined.filter(how.den * common >= how.num * (F.size("xa") + F.size("xb") - common)).select("a", "b").distinct()


def _compare_blocks(how: Plan):
    """Links between members of different components in one pair of blocks, a spanning set of them."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        columns = {name: table.column(name).combine_chunks() for name in ("node", "block", "root", "signature", "shingles")}
        node, block, root = (columns[c].to_numpy() for c in ("node", "block", "root"))
        signed = _matrix(columns["signature"], how.size)
        whole = [np.asarray(x.values) for x in columns["shingles"]]
        sizes = np.array([len(x) for x in whole])
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = x = top.get(up, up)
            return x

        links = []
        here, there = np.flatnonzero(block == first), np.flatnonzero(block == second)
        for i in here:
            others = there[there > i] if first == second else there
            apart = (signed[others] != signed[i]).sum(axis=1)
            small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            fit = others[(apart <= how.distance) & (root[others] != root[i]) & (how.den * small >= how.num * large)]
            for j in fit[np.argsort(apart[np.searchsorted(others, fit)], kind="stable")]:
                a, b = find(int(root[i])), find(int(root[j]))
                if a == b:
                    continue
                common = len(np.intersect1d(whole[i], whole[j], assume_unique=True))
                if how.den * common >= how.num * (sizes[i] + sizes[j] - common):
                    top[max(a, b)] = min(a, b)
                    links.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _crowded_links(members: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, how: Plan) -> DataFrame:
    """Links that stars can miss: between members of a key that are still in different components.

    ``members`` holds (node, key, pivot) of keys with three members or more. Keys whose
    members are all in one component by now need nothing more. The members of the others are
    gathered into clusters that are connected by such keys. Of a cluster, the component with most
    members needs no comparison within itself: the blocks of the rest meet its blocks and each
    other, each pair of blocks in a task of its own, so that rows grow with the cluster times the rest.
    """
    now = settle(members.join(roots, "node", "left").select("node", "key", "pivot", F.coalesce("root", "node").alias("root")))
    split = settle(now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n"))
    open_members = settle(spread_join(now, split.select("key"), ["key"], "left_semi", split).select("node", "root", "pivot").distinct())
    discard(now, split)
    clusters = components(open_members.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    each = settle(open_members.select("node", "root").distinct().join(clusters.withColumnRenamed("root", "cluster"), "node"))
    sizes = each.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    parts = shape.select("cluster", "main", *(F.ceil(c / BLOCK).cast("int").alias(name) for c, name in ((F.col("most"), "main_parts"), (F.col("all") - F.col("most"), "rest_parts"))))
    placed = spread_join(each, parts, ["cluster"]).withColumn("is_main", F.col("root") == F.col("main"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("main_parts")).otherwise(F.col("rest_parts"))).cast("int")
    # blocks of the rest come first, those of the main component after them
    placed = settle(placed.withColumn("block", F.when(F.col("is_main"), at + F.col("rest_parts")).otherwise(at)))
    discard(open_members, each)
    whole = _whole_sets(docs, placed.select(F.col("node").alias("doc_id")), how)
    full = placed.join(classes.select("node", "signature"), "node").join(_side(whole, "doc_id", to="node", shingles="shingles"), "node")
    # a pair of blocks (i, j) with i <= j takes the members of both
    last = F.when(F.col("is_main"), F.col("rest_parts")).otherwise(F.col("rest_parts") + F.col("main_parts")) - 1
    spread = full.select("*", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    spread = spread.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "root", "signature", "shingles")
    return spread.groupBy("cluster", "i", "j").applyInArrow(_compare_blocks(how), "a long, b long")


_EQUAL = ["n_shingles", "set_a", "set_b"]


def _edges_of_ids(full: DataFrame, grouped: DataFrame) -> DataFrame:
    """Edges between the classes that one doc_id is in: none but for ids that stand on different texts."""
    ends = [f(c).alias(f"{c}_{k}") for c in ("set_a", "set_b") for k, f in enumerate((F.min, F.max))]
    several = full.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*ends).filter("set_a_0 <> set_a_1 or set_b_0 <> set_b_1").select("doc_id")
    each = full.join(several, "doc_id", "left_semi").select("doc_id", *_EQUAL).distinct().join(grouped.select(*_EQUAL, "node"), _EQUAL)
    least = each.groupBy("doc_id").agg(F.min("node").alias("a"))
    return each.join(least, "doc_id").select("a", F.col("node").alias("b")).distinct()


def link(docs: DataFrame, how: Plan) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for every row of ``docs``.

    Documents with equal shingle sets form a class, which its smallest doc_id stands for.
    Classes that share a key are compared with the smallest of the key first, a number of
    pairs that grows with the keys and not with their squares; _crowded_links() then finds
    what that can miss. A null or wordless text has an empty set and is linked with nothing.
    Rows of one doc_id with different texts count as linked, whatever their order. A row with a null
    doc_id takes the component of its equals; without one it has a null component and is kept.
    An empty table gives no rows; only doc_id and text of ``docs`` are read. Joins deal the rows of a
    hot class, key or pivot over several tasks.
    """
    rows = settle(sketch(docs, how))
    full = rows.filter(F.col("n_shingles") > 0)
    grouped = settle(full.groupBy(*_EQUAL).agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature"), F.count("*").alias("n")))
    classes = grouped.filter(F.col("node").isNotNull()).select("node", "signature")
    keys = _keys(classes, how)
    pivots = settle(keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("n")).filter("pivot < last").drop("last"))
    shared = settle(spread_join(keys, pivots, ["key"], counts=pivots).select("node", "key", "pivot", "n"))
    pairs = settle(shared.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    signed = spread_join(pairs, _side(classes, "node", to="a", sa="signature"), ["a"]).join(_side(classes, "node", to="b", sb="signature"), "b")
    near = settle(_near(signed, how).distinct())
    discard(pivots, pairs)
    whole = _whole_sets(docs, near.select(F.col("a").alias("doc_id")).union(near.select("b")), how)
    links = settle(_confirmed(near, whole, how).union(_edges_of_ids(full, grouped)))
    roots = components(links)
    more = settle(_crowded_links(shared.filter("n > 2").drop("n"), roots, classes, docs, how))
    if not more.isEmpty():
        discard(roots)
        roots = components(links.union(more))
    discard(near, shared, links, more)
    found = grouped.select(*_EQUAL, "n", "node").join(roots, "node", "left").select(*_EQUAL, F.coalesce("root", "node").alias("component"))
    empty = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    others = spread_join(full.drop("signature"), found, _EQUAL, "left", grouped.select(*_EQUAL, "n")).select("doc_id", "n_shingles", "component")
    return (
        others.union(empty).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def deduplicate(docs: DataFrame, how: Plan) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Repeated rows of a doc_id leave one row. A doc_id that stands on different texts names no document,
    and no more does a null one: rows of either stay, but for exact repeats of a named text, and
    link nothing. All columns of ``docs`` return as they are, whatever their names; an empty table gives none.
    """
    key, other, count = unused(docs.columns, "key", "key_high", "rows_of_id")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    named = keyed.filter(F.col("doc_id").isNotNull())
    # ids are counted first, so that only rows of repeated ids are ever moved with their texts
    often = settle(named.groupBy("doc_id").agg(F.min(key).alias(key), F.max(key).alias(other), F.count("*").alias(count)).filter(F.col(count) > 1).select("doc_id", (F.col(key) != F.col(other)).alias(other)))
    repeats = often.count()
    small = lambda ids, rows: F.broadcast(ids) if fits_broadcast(rows) else ids
    once = named.join(small(often.select("doc_id"), repeats), "doc_id", "left_anti") if repeats else named
    # of an id that stands on one text one row stays, of others each text
    again = named.join(small(often, repeats), "doc_id").dropDuplicates(["doc_id", key]) if repeats else None
    single = once.select("doc_id", "text")
    verdict = link(single.union(again.filter(~F.col(other)).select("doc_id", "text")) if repeats else single, how)
    dropped = settle(verdict.filter(~F.col("kept")).select("doc_id").distinct())
    gone = small(dropped, dropped.count())
    stay = once.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if repeats:
        stay = stay.union(again.filter(other).select(*docs.columns)).union(again.filter(~F.col(other)).join(gone, "doc_id", "left_anti").select(*docs.columns))
    return stay.union(docs.filter(F.col("doc_id").isNull()))


#: link() in DuckDB for three words and 85 of 100, comparing every two documents that share a shingle.
LINK_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), run AS (
  SELECT doc_id, w, least(len(w), 3) AS n, unnest(generate_series(1, len(w) - least(len(w), 3) + 1)) AS pos FROM doc WHERE len(w) > 0
), shingle AS (
  SELECT DISTINCT doc_id, hash(w[pos : pos + n - 1]) AS s FROM run
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle AS x JOIN shingle AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN sized AS p ON p.doc_id = a JOIN sized AS q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM doc
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN sized USING (doc_id) GROUP BY doc_id
"""
