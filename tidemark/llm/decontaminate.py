"""Benchmark decontamination: a broadcast hash set of benchmark word runs, scanned for in document text.

DataFrame functions only. A run of n words holds, wherever it begins, a whole block of
(n + 1) // 2 words that begins at a multiple of that number. So only every such block of a document is
hashed and looked up among all blocks of the benchmark; the words around a block that is
found are then compared with the benchmark's windows word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, settle, spread_join, text_key, unused

#: What a word is after A-Z have been lower-cased, the same with A-Z, and the words of a window.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words from the earliest begin to the latest end of a window that holds a given block.
_REACH = 2 * WINDOW - (WINDOW + 1) // 2
BETWEEN = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased: all that stands between words becomes blank, and blanks split."""
    plain = F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.coalesce(F.array_remove(F.split(plain, " ", -1), ""), F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, run (words) and n (their number) of every distinct window of every item; an item of fewer than WINDOW words is one window."""
    found = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    return found.select("item_id", F.explode(cut).alias("run")).distinct().select("item_id", "run", F.size("run").alias("n"))


def _block(n: Column) -> Column:
    return F.floor((n + 1) / 2).cast("int")


def _hash(w: Column | str, first: Column, size: Column) -> Column:
    """Hash of ``size`` words from ``first`` (from 0) on; words are fetched one by one, as a slice would walk the whole text."""
    return F.xxhash64(*(F.when(size > j, F.get(w, (first + j).cast("int"))) for j in range((WINDOW + 1) // 2)))


def benchmark_blocks(windows: DataFrame) -> DataFrame:
    """n and h (hash) of every block that a window of n words may hold."""
    size = _block(F.col("n"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - size), lambda i: _hash("run", i, size))
    return windows.select("n", F.explode(cut).alias("h")).distinct()


def _blocks(docs: DataFrame, lengths: list[int], *more: str) -> DataFrame:
    """n, begin (from 0) and h of every aligned block of every document, for windows of each n of ``lengths``."""
    cut = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w")).filter(F.size("w") >= min(lengths))
    sized = cut.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("n")) if len(lengths) > 1 else cut.withColumn("n", F.lit(lengths[0]))
    size = reduce(lambda c, n: c.when(F.col("n") == n, (n + 1) // 2), lengths, F.when(F.lit(False), 0)) if len(lengths) > 1 else F.lit((lengths[0] + 1) // 2)
    last = F.floor(F.size("w") / size).cast("int") - 1
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda b: _hash("w", b * size, size)))
    spread = sized.select("doc_id", "key", "n", "w", F.posexplode(hashes).alias("block", "h"))
    return spread.select("doc_id", "key", "n", (F.col("block") * size).alias("begin"), "h", *more)


def _around(w: str) -> list[Column]:
    """The words that a window with the block at ``begin`` can reach, null past the end, and the place of the first.

    Plain fetches and no lambda: the join's generated code then makes them itself and never copies all words of a text.
    """
    first = F.greatest(F.col("begin") - F.col("n") + _block(F.col("n")), F.lit(0)).cast("int")
    return [first.alias("first"), F.array(*(F.get(w, first + j) for j in range(_REACH))).alias("near")]


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, key, at, n and run of every verified occurrence of a benchmark window; ``windows`` has run and n."""
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect()) or [WINDOW]  # WINDOW numbers at most
    blocks = settle(benchmark_blocks(windows))
    if fits_broadcast(blocks.count()):
        # the words are only copied for the few blocks that the join lets through
        near = _blocks(docs, lengths, "w").join(F.broadcast(blocks), ["n", "h"]).select("doc_id", "key", "n", *_around("w"))
    else:
        # hashes alone are shuffled, and the few documents with a block are read again
        some = spread_join(settle(_blocks(docs, lengths)), blocks, ["n", "h"], "left_semi")
        places = some.groupBy("doc_id", "key").agg(F.collect_set(F.struct("n", "begin")).alias("places"))
        again = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w")).dropDuplicates(["doc_id", "key"])
        match = (places["key"] == again["key"]) & places["doc_id"].eqNullSafe(again["doc_id"])
        each = again.join(places, match).select(again["doc_id"], again["key"], "w", F.inline("places"))
        near = each.select("doc_id", "key", "n", *_around("w"))
    runs = F.transform(F.sequence(F.lit(0), F.lit(_REACH) - F.col("n")), lambda i: F.struct((F.col("first") + i).alias("at"), F.slice("near", i + 1, F.col("n")).alias("run")))
    cut = near.select("doc_id", "key", "n", F.inline(runs)).distinct()
    found = _by_run(cut, windows, ["n", "run"], "left_semi")
    return found.select("doc_id", "key", "at", "n", "run")


def _by_run(found: DataFrame, windows: DataFrame, on: list[str], how: str) -> DataFrame:
    """``found`` joined with settled windows; where they are too large to broadcast, a passage that is everywhere is not one task's work."""
    rows, size = windows.agg(F.count("*"), F.sum(F.octet_length(F.array_join("run", " ")) + 16 * F.size("run"))).first()
    if fits_broadcast(rows, size or 0):
        return found.join(F.broadcast(windows), on, how)
    return spread_join(settle(found), windows, on, how)


def hit_documents(docs: DataFrame, benchmark: DataFrame, with_items: bool = False) -> DataFrame:
    """doc_id, key and hit_words (positions of words in any window) of documents with an occurrence, and hit_items if asked for."""
    of_items = settle(benchmark_windows(benchmark))
    found = hits(docs, settle(of_items.select("run", "n").distinct()))
    found = settle(found) if with_items else found
    per = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    per = per.select("doc_id", "key", covered.alias("hit_words"))
    if not with_items:
        return per
    # items are looked up for the distinct windows of a document, and do not ride on every hit
    items = _by_run(found.select("doc_id", "key", "run").distinct(), of_items.select("item_id", "run"), ["run"], "inner").select(F.col("doc_id").alias("id"), F.col("key").alias("id_key"), "item_id").distinct()
    items = items.groupBy("id", "id_key").agg(F.collect_list("item_id").alias("hit_items"))
    return per.join(items, (F.col("key") == F.col("id_key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "key", "hit_words", "hit_items")


def _beside(docs: DataFrame, key: str, found: DataFrame, how: str) -> DataFrame:
    """``docs``, which has the text's hash in ``key``, joined with what was found; the columns of the latter end in ``key``."""
    found = found.toDF(*(f"{c}_{key}" for c in found.columns))
    return docs.join(found, (F.col(key) == F.col(f"key_{key}")) & F.col("doc_id").eqNullSafe(F.col(f"doc_id_{key}")), how)


def _free_key(docs: DataFrame) -> str:
    """A name that no column of ``docs`` ends in."""
    key = "match"
    while any(c.lower().endswith(key) for c in docs.columns):
        key = f"_{key}_"
    return key


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row for every row of ``docs``.

    Null and empty texts have no words and no hits, benchmark rows without item_id or words no
    windows. Repeated rows get equal reports, a null doc_id is reported like any other, an empty
    benchmark hits nothing, and an empty table gives no rows. Whole texts are scanned, however long.
    """
    found = hit_documents(docs, benchmark, with_items=True)
    counted = docs.select("doc_id", text_key(F.col("text")).alias("match"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce("hit_items_match", F.array().cast("array<bigint>"))
    names = F.array_sort(F.transform(items, lambda i: i.cast("string")))
    hit = F.col("hit_words_match")
    return _beside(counted, "match", found, "left").select(
        "doc_id", "n_words",
        F.coalesce(F.size(hit), F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), hit.isNotNull().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark removes nothing, and an empty table gives none.
    """
    key = _free_key(docs)
    found = settle(hit_documents(docs, benchmark).select("doc_id", "key"))
    if fits_broadcast(found.count()):
        found = F.broadcast(found)  # else texts are shuffled
    return _beside(docs.withColumn(key, text_key(F.col("text"))), key, found, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every hit word, and what stands between it and the next word, cut from ``text``.

    Null texts stay null; a text of hit words alone keeps what stands before its first word. Repeated rows are cut alike. All other columns
    pass unchanged, whatever their names. An empty table gives none.
    """
    key = _free_key(docs)
    found = hit_documents(docs, benchmark)
    others = [c for c in docs.columns if c != "text"]
    pieces = F.regexp_extract_all("text", F.lit(f"({WORD_ANY_CASE})([\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*)"), F.lit(0))
    lead = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    # pieces travel in place of the text, and those that stay are picked by number
    cut = docs.select(*others, text_key(F.col("text")).alias(key), lead.alias(f"lead_{key}"), pieces.alias(f"pieces_{key}"))
    all_pieces, hit = F.col(f"pieces_{key}"), F.col(f"hit_words_{key}")
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_pieces) - 1), hit)
    left = F.when(hit.isNull(), all_pieces).otherwise(F.transform(stay, lambda i: F.get(all_pieces, i)))
    text = F.concat(f"lead_{key}", F.array_join(left, ""))
    return _beside(cut, key, found, "left").select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns))


#: report() in DuckDB.
REPORT_SQL = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), item AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL)
  WHERE len(w) > 0
), item_at AS (
  SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS pos FROM item
), item_run AS (
  SELECT DISTINCT item_id, n, w[pos : pos + n - 1] AS run FROM item_at
), doc_at AS (
  SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS pos FROM doc, (SELECT DISTINCT n FROM item_run) WHERE len(w) >= n
), hit AS (
  SELECT r, pos, doc_run.n, item_id FROM (SELECT r, pos, n, w[pos : pos + n - 1] AS run FROM doc_at) AS doc_run JOIN item_run ON doc_run.run = item_run.run
), hit_word AS (
  SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(generate_series(pos, pos + n - 1)) AS word FROM hit) GROUP BY r
), hit_item AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit_word USING (r) LEFT JOIN hit_item USING (r)
"""
