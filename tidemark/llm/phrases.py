"""Phrase collocations by hierarchical pair naming.

Words that are frequent enough get ids; two neighbouring (k-1)-grams with ids make a pair, and the pairs that are
frequent over all documents get the ids of the k-grams. The ids come from windows over the whole corpus, so that equal
phrases have one name everywhere. A k-gram's pair is also its two parent pointers: counts of all prefixes and
suffixes are reached over them, for the cuts, and a longer phrase marks its parents as subsumed over them.

Texts are read once. Python tasks turn them into blocks: the sequence of a block as numbers that are local to it, and a
row for each distinct word of the block. What is counted and named is those rows, so that a word or pair on which a
third of all positions fall is one row a block, and no table of names is sent anywhere as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .common import discard, settle, small_batches

# What separates pieces and words.
PIECE_END = textkit.byte_table(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
BETWEEN = PIECE_END | textkit.byte_table((0x20, 0x20), (0x09, 0x09))
MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: A phrase goes if a longer one that holds it has this share of its count at least.
SUBSUMED = (50, 100)
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20

_LOCAL = "block long, at int, n long, seq binary"
_WORDS = f"lang string, word string, {_LOCAL}"
_PAIRS = f"left long, right long, {_LOCAL}"


def local_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word numbers of all positions, -1 between pieces, the distinct words in order of their numbers, and their counts."""
    data = textkit.ASCII_LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    starts, ends, row = textkit.words(data, at, BETWEEN)
    if not len(starts):
        return np.empty(0, np.int32), pa.array([], pa.large_string()), np.empty(0, np.int64)
    inside = data[~BETWEEN[data]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(inside))
    coded = pc.dictionary_encode(words)
    number = coded.indices.to_numpy().astype(np.int32)
    breaks = np.cumsum(PIECE_END[data], dtype=np.int64)
    new_piece = (row[1:] != row[:-1]) | (breaks[starts[1:]] != breaks[ends[:-1] - 1])
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(new_piece)])
    seq = np.full(int(place[-1]) + 1, -1, dtype=np.int32)
    seq[place] = number
    return seq, coded.dictionary, np.bincount(number, minlength=len(coded.dictionary)).astype(np.int64)


def local_pairs(seq: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sequence one level up, and (left, right, count) of its distinct pairs.

    ``name`` has the id of each local number, -1 for those that aren't frequent. A position of the
    new sequence has the number of the pair that begins there, -1 if one of the two has no id.
    """
    known = np.append(name, -1) >= 0
    both = np.flatnonzero(known[seq[:-1]] & known[seq[1:]])
    key = seq[both].astype(np.int64) << 32 | seq[both + 1]
    found, number, count = np.unique(key, return_inverse=True, return_counts=True)
    up = np.full(max(len(seq) - 1, 0), -1, dtype=np.int32)
    up[both] = number
    return up, name[found >> 32], name[found & 0xFFFFFFFF], count.astype(np.int64)


def _rows(block: int, n: np.ndarray, seq: np.ndarray | None, schema: list[str], **columns: pa.Array) -> pa.Table:
    """A row for each distinct entry of a block, and one with its sequence if that is needed."""
    more = 0 if seq is None else 1
    pad = lambda a: pa.concat_arrays([a, pa.nulls(more, a.type)])
    out = {k: pad(v) for k, v in columns.items()}
    out |= {"block": pa.array(np.full(len(n) + more, block, dtype=np.int64)), "at": pad(pa.array(np.arange(len(n), dtype=np.int32))), "n": pad(pa.array(n))}
    out["seq"] = pa.array([None] * len(n) + [seq.tobytes()] * more if more else [None] * len(n), pa.binary())
    return pa.table({name: out[name] for name in schema})


def blocks(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The documents as blocks of one language: rows of distinct words and, without a word, of sequences."""
    names = [field.split()[0] for field in _WORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made = 0
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}

        def flush(of: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            seq, words, n = local_words(waiting.pop(of))
            held.pop(of)
            if len(n):
                table = _rows(first + made, n, seq, names, lang=pa.array([of] * len(n), pa.string()), word=words.cast(pa.string()))
                made += 1
                yield from table.to_batches(max_chunksize=1 << 16)

        for batch in batches:
            for of, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                if not data:
                    continue
                if of in held and held[of] + len(data) > BLOCK_BYTES:
                    yield from flush(of)
                waiting.setdefault(of, []).append(data)
                held[of] = held.get(of, 0) + len(data)
                if sum(held.values()) > 4 * BLOCK_BYTES:  # many languages in one task
                    yield from flush(max(held, key=held.get))
        for of in list(waiting):
            yield from flush(of)

    return small_batches(docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), text)).mapInArrow(run, _WORDS)


def _raise_level(level: DataFrame, ids: DataFrame, again: bool) -> DataFrame:
    """Blocks one level up: ``ids`` has (block, at, id) of the frequent entries; ``again`` keeps the sequences for a further level."""
    names = [field.split()[0] for field in _PAIRS.split(", ")]

    def run(key: tuple, own: pa.Table, named: pa.Table) -> pa.Table:
        seq = np.frombuffer(own.column("seq")[0].as_py(), dtype=np.int32) if own.num_rows else np.empty(0, np.int32)
        name = np.full(int(seq.max(initial=-1)) + 1, -1, dtype=np.int64)
        name[named.column("at").to_numpy()] = named.column("id").to_numpy()
        up, left, right, n = local_pairs(seq, name)
        return _rows(key[0].as_py(), n, up if again else None, names, left=pa.array(left), right=pa.array(right))

    sequences = level.filter("at is null").select("block", "seq")
    return sequences.groupBy("block").cogroup(ids.toDF("in_block", "at", "id").groupBy("in_block")).applyInArrow(run, _PAIRS)


def _frequent(level: DataFrame, key: list[str], least: int) -> DataFrame:
    counted = level.filter("at is not null").groupBy(*key).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    return counted.withColumn("id", F.monotonically_increasing_id())


def _named(level: DataFrame, key: list[str], least: int) -> DataFrame:
    """The entries of frequent keys with the id of their key; one entry of each key has the key and its count f besides.

    A key is one row a block, so that its window has no more rows than there are blocks. Counting and
    naming share one shuffle of the entries. ``level`` must be settled: an id is the number of a row.
    """
    entries = level.filter("at is not null").select(*key, "block", "at", "n", F.monotonically_increasing_id().alias("row"))
    own = Window.partitionBy(*key)
    counted = entries.withColumns({"f": F.sum("n").over(own), "id": F.min("row").over(own)}).filter(F.col("f") >= least)
    return counted.select("block", "at", "id", *(F.when(F.col("row") == F.col("id"), F.col(c)).alias(c) for c in [*key, "f"]))


def grams(docs: DataFrame, least: int = MIN_COUNT, most_words: int = MAX_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2, ... words, and lang and n of all word occurrences.

    A phrase has id, lang, phrase, last (its last word), f, prefix_f and suffix_f (counts of its prefixes and suffixes of
    1, 2, ... words) and, from two words on, its parents left and right.
    """
    level = settle(blocks(docs))
    totals = settle(level.filter("at is not null").groupBy("lang").agg(F.sum("n").alias("n")))
    none = F.array().cast("array<long>")
    names = []
    for words in range(1, most_words + 1):
        key = ["lang", "word"] if words == 1 else ["left", "right"]
        if words < most_words:
            named = settle(_named(level, key, least))
            found = named.filter("f is not null").drop("block", "at")
        else:  # these are parts of nothing longer
            found = _frequent(level, key, least)
        if words == 1:
            names.append(settle(found.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("prefix_f"), none.alias("suffix_f"))))
        else:
            side = lambda name: names[-1].select(*(F.col(c).alias(f"{name}_{c}") for c in names[-1].columns))
            both = found.join(side("l"), F.col("left") == F.col("l_id")).join(side("r"), F.col("right") == F.col("r_id"))
            names.append(settle(both.select(
                "id", F.col("l_lang").alias("lang"), F.concat_ws(" ", "l_phrase", "r_last").alias("phrase"), F.col("r_last").alias("last"), "f",
                F.concat("l_prefix_f", F.array("l_f")).alias("prefix_f"), F.concat("r_suffix_f", F.array("r_f")).alias("suffix_f"),
                "left", "right", "l_f", "r_f",
            )))
        if words < most_words:
            higher = settle(_raise_level(level, named.select("block", "at", "id"), words + 1 < most_words))
            discard(level, named)
            level = higher
    discard(level)
    return names, totals


def _exact(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _best_cut(words: int) -> Column:
    """(score, l, r) of the cut that scores lowest, the shortest first part on ties; decimals of 38 digits hold all products of counts under 10^15."""
    cuts = []
    for k in range(1, words):
        left, right = F.get("prefix_f", F.lit(k - 1)), F.get("suffix_f", F.lit(words - k - 1))
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * _exact(F.col("f")) * _exact(F.col("f")), _exact(left) * _exact(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return cuts[0] if len(cuts) == 1 else F.least(*cuts)


def _top(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank.

    A language with many phrases is first cut in parts, about as many as leave each part and their winners equally
    large, so that no task ranks all phrases of a language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.groupBy("lang").agg(F.ceil(F.sqrt(F.count("*") / top)).cast("int").alias("parts"))
    dealt = found.join(F.broadcast(parts), "lang").withColumn("part", F.pmod(F.xxhash64("phrase"), F.col("parts")))  # a row a language
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = MIN_COUNT, most_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the strongest phrases of each language.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they stand; an empty
    table gives no rows. Only lang and text of ``docs`` are read. Texts are read whole: one longer than a block is a
    block of its own. Of equal scores the more frequent phrase comes first, then the one whose bytes sort lower.
    """
    names, totals = grams(docs, least, most_words)
    part, whole = SUBSUMED
    made = []
    for k in range(2, most_words + 1):
        best = names[k - 1].select("id", "lang", "phrase", F.col("f").alias("a"), _best_cut(k).alias("best"))
        if k < most_words:
            longer = names[k].filter(F.col("f") * whole >= F.col("l_f") * part).select(F.col("left").alias("id"))
            longer = longer.union(names[k].filter(F.col("f") * whole >= F.col("r_f") * part).select(F.col("right").alias("id")))
            best = best.join(longer.distinct(), "id", "left_anti")
        made.append(best.select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    found = made[0]
    for more in made[1:]:
        found = found.union(more)
    ranked = _top(settle(found), top).join(F.broadcast(totals), "lang")  # a row a language
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: collocations() in DuckDB.
COLLOCATIONS_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), gram AS (
  SELECT lang, k, array_to_string(w[pos : pos + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS pos FROM words, (VALUES (1), (2), (3)) AS size(k) WHERE len(w) >= k)
  GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM gram WHERE k = 1 GROUP BY lang
), cut AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS p, unnest(generate_series(1, k - 1)) AS j FROM gram WHERE k > 1 AND f >= 10
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, x.f AS l, y.f AS r, c.j,
         CAST(1000000 * CAST(c.f AS HUGEINT) * c.f // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut AS c
  JOIN gram AS x ON x.lang = c.lang AND x.k = c.j AND x.phrase = array_to_string(c.p[1 : c.j], ' ')
  JOIN gram AS y ON y.lang = c.lang AND y.k = c.k - c.j AND y.phrase = array_to_string(c.p[c.j + 1 :], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, f, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase
  FROM (SELECT DISTINCT lang, f, p FROM cut WHERE k = 3)
), kept AS (
  SELECT b.* FROM best AS b WHERE NOT EXISTS (SELECT 1 FROM inside AS i WHERE b.k = 2 AND i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 50 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang)
QUALIFY rank <= 2000
"""
