"""Document statistics: whole-text counts by byte arithmetic, the features made of them, and labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import held_out, small_batches, unused

#: The length in words of a repeated window, and the characters that count as symbols.
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Labelled rows that a model is fitted on at most; the rows with the smallest hash of doc_id are taken.
FIT_ROWS = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_upper", "n_digits", "n_other_marks", "n_exclamations", "n_bars", "n_wide_chars")

_CONTINUED, _WIDE, _LOWER, _UPPER, _DIGIT, _SYMBOL, _BAR, _EXCLAIM, _MARK, _NEWLINE, _BLANK = range(11)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _MARK, dtype=np.int64)
    out[textkit.BLANK] = _BLANK
    out[0x0A] = _NEWLINE
    out[0x30:0x3A], out[0x41:0x5B], out[0x61:0x7B] = _DIGIT, _UPPER, _LOWER
    out[0x80:0xC0], out[0xC0:] = _CONTINUED, _WIDE
    for c in SYMBOLS:
        out[ord(c)] = _SYMBOL
    out[ord("|")], out[ord("!")] = _BAR, _EXCLAIM
    return out


_CLASS = _byte_classes()


def _of_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that are equal only if both the hash and the row are."""
    return textkit.mix(hashes + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E6C63D0876A9A47))


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in order of their keys and then their own, and whether each has its predecessor's key."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[1:] = keys[order[1:]] == keys[order[:-1]]
    return order, again


def count(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for each row of a run of texts."""
    rows = len(at) - 1
    kinds = np.bincount(np.repeat(np.arange(rows) * 11, np.diff(at)) + _CLASS[data], minlength=rows * 11).reshape(rows, 11)
    starts, ends, row = textkit.words(data, at)
    hashes = textkit.range_hash(data, starts, ends)
    out = {"n_words": textkit.per_row(rows, row)}
    out["word_chars"] = kinds.sum(axis=1) - kinds[:, _CONTINUED] - kinds[:, _NEWLINE] - kinds[:, _BLANK]
    out["n_symbols"] = kinds[:, _SYMBOL] + kinds[:, _BAR]

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    line_row = np.sort(np.concatenate([np.arange(rows), np.searchsorted(at, breaks, side="right") - 1]), kind="stable")
    line_ends = np.empty_like(line_starts)
    line_ends[:-1] = line_starts[1:] - 1
    last = np.append(line_row[1:] != line_row[:-1], True)[: len(line_row)]
    line_ends[last] = at[1:]
    spoken = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    order, again = _repeated(_of_row(textkit.range_hash(data, line_starts[spoken], line_ends[spoken]), line_row[spoken]))
    out["n_dup_lines"] = textkit.per_row(rows, line_row[spoken][order[again]])
    out["n_lines"] = textkit.per_row(rows, line_row[spoken])

    found, first = textkit.windows(hashes, row, REPEAT_WINDOW)
    order, again = _repeated(_of_row(found, row[first]))
    again[:-1] |= again[1:]  # the first of equal windows counts as well
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, first[order[again]], 1)
    np.add.at(edge, first[order[again]] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = textkit.per_row(rows, row[np.cumsum(edge[:-1]) > 0])

    order, again = _repeated(_of_row(hashes, row))
    out["n_distinct_words"] = out["n_words"] - textkit.per_row(rows, row[order[again]])
    for name, kind in (("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_other_marks", _MARK), ("n_exclamations", _EXCLAIM), ("n_bars", _BAR), ("n_wide_chars", _WIDE)):
        out[name] = kinds[:, kind]
    return out


FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "words_a_line", "upper", "digits", "marks", "exclamations", "bars")


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of each row: rates that are 0 for a text without words."""
    words, chars, lines = (np.maximum(counts[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(counts["n_words"]), counts["word_chars"] / words, counts["n_symbols"] / words, counts["n_dup_lines"] / lines,
        counts["n_repeat_words"] / words, counts["n_distinct_words"] / words ** 0.8, np.log1p(counts["n_words"] / lines), counts["n_upper"] / chars,
        counts["n_digits"] / chars, counts["n_other_marks"] / words, counts["n_exclamations"] / words, counts["n_bars"] / words,
    ])


def per_document(docs: DataFrame, keep: list[str], made: list[T.StructField], work: Callable[[dict[str, np.ndarray]], list[np.ndarray]], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the columns ``made`` that ``work`` makes of the counts, row by row where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [work(count(data, at)) for _, _, data, at in textkit.runs(batch.column(len(keep)))]
            if parts:
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *(f.name for f in made)])

    chosen = small_batches(docs.select(*keep, F.col(text).alias(unused(keep, "text_counted")[0])))
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[: len(keep)], *made]))


def labelled(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 quality of at most ``limit`` labelled documents that aren't held out, in a fixed order.

    Rows without doc_id or quality teach nothing; of several labels of a document the smallest counts.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    made = [T.StructField(name, T.DoubleType()) for name in FEATURES]
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` pairs of numbers
    rows = per_document(known, ["doc_id", "__label"], made, lambda c: list(features(c).T))
    # an id that is repeated gives more rows: then, too, the same ones are taken whatever their order
    rows = rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(limit).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return rows[list(FEATURES)].to_numpy(float), (rows["__label"].to_numpy() > 0).astype(float)
