"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Every stretch of 2**j words of a text gets a name, equal for equal stretches: the names of one level are those of
pairs of names of the level below. For each period q, places on a grid are compared with the places q words on; where
they agree, the names tell, from the highest level to the lowest, how far they agree in both directions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: A run has so many periods and so many words at least.
PERIODS, WORDS = 4, 6
#: Places of the grid that are looked at together.
CHUNK = 1 << 20
#: Words of several short texts that are named together.
TOGETHER = 1 << 17


def levels(word: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words that begin at each place; those that stand once have names under 0.

    The last level is the highest in which some stretch stands twice. Names are exact: a level sorts the pairs of names of
    the level below, of places whose two halves both stand more than once.
    """
    n = len(word)
    out, size = [], 1
    live, key = np.arange(n), word.astype(np.int64)
    while len(live):
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1)[group]
        name = np.full(n, -1, dtype=np.int64)
        name[live[order[several]]] = group[several]
        if not several.any():
            break
        out.append(name)
        live = np.flatnonzero(name[: n - size] >= 0)
        live = live[name[live + size] >= 0]
        key = name[live] * n + name[live + size]
        size *= 2
    return out


def _agree(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """Words that agree from a and b on, or before them if ``back``; a and b differ.

    Where stretches of one level agree, the next level down can add one more of its own, and no two.
    """
    n = len(names[0]) if names else 0
    done = np.zeros(len(a), dtype=np.int64)
    for j in range(len(names) - 1, -1, -1):
        size, name = 1 << j, names[j]
        x, y = (a - done - size, b - done - size) if back else (a + done, b + done)
        fit = np.flatnonzero((x >= 0) & (y >= 0) if back else (x < n) & (y < n))
        left = name[x[fit]]
        done[fit[(left >= 0) & (left == name[y[fit]])]] += size
    return done


def _grid(lengths: np.ndarray, heads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of every second period of every period of every text, in portions of about CHUNK, by text, period and place."""
    k = 0
    while True:
        live = np.flatnonzero(lengths // PERIODS > k)
        if not len(live):
            return
        long = lengths[live]
        # as many periods from k + 1 on as make about CHUNK places
        step = max(1, min(2 * (k + 1) * CHUNK // int(long.sum()), CHUNK // len(live)))
        period = np.arange(k + 1, min(k + step, int(long.max()) // PERIODS) + 1)
        of, q = np.nonzero(long[:, None] // PERIODS >= period)
        q = period[q]
        count = -(-(long[of] - q) // (2 * q))
        first = np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(heads[live[of]], count) + (np.arange(len(first)) - first) * np.repeat(2 * q, count), np.repeat(q, count)
        k += step


def find_runs(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length and period of every run, by text, start and period; text k has the words at[k] .. at[k + 1].

    Words of different texts must have different numbers. A stretch in which places q apart agree for 3 q words or more
    holds a place of the grid of step 2 q with q more words that agree: only such places are extended. A multiple of a
    run's period finds the same stretch, of which the smallest period stays.
    """
    names = levels(word)
    found = []
    for i, q in _grid(np.diff(at), at[:-1]) if names else ():
        level = np.minimum(np.frexp(q)[1] - 1, len(names) - 1)
        for j in np.unique(level):
            mine = level == j
            a, p = i[mine], q[mine]
            left = names[j][a]
            same = (left >= 0) & (left == names[j][a + p])
            a, p = a[same], p[same]
            back, on = _agree(names, a, a + p, True), _agree(names, a, a + p, False)
            start, length = a - back, back + on + p
            # places of one run follow each other
            new = np.ones(len(a), dtype=bool)
            new[1:] = (start[1:] != start[:-1]) | (p[1:] != p[:-1])
            long = new & (length >= np.maximum(WORDS, PERIODS * p))
            found.append(np.stack([start[long], length[long], p[long]]))
    if not found:
        return (np.empty(0, np.int64),) * 4
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(at, start, side="right") - 1
    return text, start - at[text], length, period


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the words of a document begin to repeat and with which period, for the documents that the contract alters."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


_REPORT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType()), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
])


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length by period, compared exactly; the first of equals."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def inspect(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Runs (start, length, period) of each text, given as words, and the words left when a run keeps its first period."""
    number, at = [], [0]
    for words in texts:
        own: dict[bytes, int] = {}
        base = at[-1]  # a text of n words has numbers base .. base + n - 1 at most
        number.append(np.fromiter((own.setdefault(w, len(own)) for w in words), dtype=np.int64, count=len(words)) + base)
        at.append(base + len(words))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, *run in zip(*(c.tolist() for c in find_runs(np.concatenate(number) if number else np.empty(0, np.int64), np.array(at)))):
        found[k].append(tuple(run))
    return [(runs, _collapsed(words, runs)) for words, runs in zip(texts, found)]


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every run of ``text`` cut down to its first period; words are then joined by one blank.

    Texts without a run stay as they are, null and empty ones too; repeated rows are cut alike and all other columns
    pass unchanged. An empty table gives none.
    """
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(at).cast(pa.large_binary()).to_pylist()
            done = []
            for group in _groups(raw):
                words = [(raw[k] or b"").split() for k in group]
                done += [raw[k] if not runs else b" ".join(left) for k, (runs, left) in zip(group, inspect(words))]
            column = pa.array(done, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(batch.columns)], names=names)

    return small_batches(docs).mapInArrow(run, docs.schema)


def _groups(raw: list[bytes | None]) -> Iterator[list[int]]:
    """Numbers of texts that are handled together: some 6 bytes a word."""
    group, held = [], 0
    for k, data in enumerate(raw):
        size = len(data or b"")
        if group and held + size > 6 * TOGETHER:
            yield group
            group, held = [], 0
        group.append(k)
        held += size
    if group:
        yield group


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of its runs, the strongest one, and digests of all runs and of the words left.

    A document chosen by the hash of its doc_id is altered first, as planted() says; one without a doc_id never is. Null
    and empty texts have no words and no runs; repeated rows get equal reports; an empty table gives no rows. A very long text
    is handled alone, in time n log^2 n and some hundred bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw = batch.column(1).cast(pa.large_binary()).to_pylist()
            rows = []
            for group in _groups(raw):
                texts = []
                for k in group:
                    words = (raw[k] or b"").split()
                    altered = planted(ids[k], len(words))
                    if altered:
                        a, p = altered
                        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
                    texts.append(words)
                for k, (runs, left) in zip(group, inspect(texts)):
                    start, length, period = _strongest(runs) if runs else (None,) * 3
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    rows.append((ids[k], len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.string()) for k, c in enumerate(zip(*rows))], names=_REPORT.names)

    return small_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, _REPORT)
