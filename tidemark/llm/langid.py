"""Language identification by interpolated Kneser-Ney character models.

Every language has a model of ORDER characters. Counts, continuation counts, discounts and back-off
weights are estimated in Spark over all n-grams; a model is then a few sorted arrays of 64-bit
n-gram hashes with the discounted probability of each n-gram and the back-off weight of
each context. The language with the lowest cross-entropy per character is chosen; a
temperature and limits of that entropy, fitted on labelled rows that were not counted, make the score and the rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import discard, held_out, settle, small_batches

ORDER = 4
#: One in so many labelled rows is left out of the counts; temperature and rejection are fitted on those, on so many at most.
CALIBRATION_SHARE, CALIBRATION_ROWS = 20, 4000
#: Share of a language's own rows that its rejection limit lets pass, and the slack above that limit.
ACCEPTED_SHARE, SLACK = 0.995, 1.15
#: Characters of a text that are handled in one piece; the next piece starts with the context of the last.
PIECE = 500_000
#: n-grams whose probabilities a worker remembers.
REMEMBERED = 600_000
#: Bytes of the arrays that one broadcast holds; a larger model is cut by the hash of the next to last character, and texts are scored once a part.
MODEL_BYTES = 256 << 20

UNDETERMINED = "und"
_BLANK = 0x20
_BASE = 0xD1342543DE82EF95


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


_LETTER: np.ndarray | None = None


def _stream(parts: list[tuple[int, np.ndarray, np.ndarray]], texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """stream() of (row, the ORDER - 1 characters before, lower-cased characters)."""
    sizes = [len(own) + ORDER - 1 for _, _, own in parts]
    codes = np.concatenate([x for _, lead, own in parts for x in (lead, own)])
    heads = np.cumsum([0, *sizes[:-1]])
    leading = np.zeros(len(codes), dtype=bool)
    for k in range(ORDER - 1):
        leading[heads + k] = True
    letter = _LETTER[codes]
    row = np.repeat([r for r, _, _ in parts], sizes)
    keep = letter | leading
    keep[1:] |= letter[:-1]  # the first character after a letter is the blank of its run
    found = np.bincount(row[letter & ~leading], minlength=texts)
    codes = np.where(letter, codes, np.uint32(_BLANK))[keep]
    at = np.flatnonzero(~leading[keep])
    return codes, at, row[keep][at], found


def streams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Characters of the texts, positions to predict, their rows, and the number of letters of each row, text by text and piece by piece.

    Letters are lower-cased, each run of other characters is one blank, and ORDER - 1 blanks stand before every
    text. A text beyond PIECE comes in several pieces, each of which begins with the last characters of the one before.
    """
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    blank = np.full(ORDER - 1, _BLANK, dtype=np.uint32)
    coded = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    short = []
    for row, text in enumerate(texts):
        if not text:
            continue
        lower = text.lower()
        if len(lower) <= PIECE:
            short.append((row, blank, coded(lower)))
            continue
        before = blank
        for low in range(0, len(lower), PIECE):
            out = _stream([(row, before, coded(lower[low : low + PIECE]))], len(texts))
            before = out[0][-(ORDER - 1) :]
            yield out
    if short:
        yield _stream(short, len(texts))


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams given by the columns of their characters, first to last."""
    h = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for c in columns:
        h = h * np.uint64(_BASE) + c.astype(np.uint64) + np.uint64(1)
    return textkit.mix(h)


@dataclass
class Level:
    """One order of a model: n-grams with their discounted probability, contexts with their back-off weight."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    back_off: np.ndarray

    def apply(self, grams: np.ndarray, contexts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        weight = _look_up(self.contexts, self.back_off, contexts, 1.0)
        return _look_up(self.grams, self.share, grams, 0.0) + weight * lower


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


@dataclass
class Models:
    languages: list[str]
    levels: list[list[Level]]
    alphabet: int
    part: int = 0
    parts: int = 1
    known: np.ndarray | None = None
    costs: np.ndarray | None = None

    def _cost(self, columns: list[np.ndarray]) -> np.ndarray:
        """Negative log-probability, in nats, of each n-gram's last character in each language."""
        out = np.empty((len(columns[0]), len(self.languages)), dtype=np.float32)
        keys = [gram_keys(columns[k:]) for k in range(ORDER - 1, -1, -1)]
        contexts = [np.zeros(len(columns[0]), np.uint64), *(gram_keys(columns[k:-1]) for k in range(ORDER - 2, -1, -1))]
        for k, levels in enumerate(self.levels):
            p = np.full(len(columns[0]), 1 / (self.alphabet + 1))
            for level, grams, context in zip(levels, keys, contexts):
                p = level.apply(grams, context, p)
            out[:, k] = -np.log(np.maximum(p, 1e-12))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters, predicted characters and the sum of costs in each language, for every text; characters outside the model's part cost 0."""
        letters, n, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        for codes, at, row, found in streams(texts):
            letters += found
            if self.parts > 1:
                mine = part_of(codes[at - 1], self.parts) == self.part
                at, row = at[mine], row[mine]
            n += np.bincount(row, minlength=len(texts))
            if not len(at):
                continue
            keys, first, of = np.unique(gram_keys([codes[at - k] for k in range(ORDER - 1, -1, -1)]), return_index=True, return_inverse=True)
            if self.known is None or len(self.known) > REMEMBERED:
                self.known, self.costs = np.empty(0, np.uint64), np.empty((0, len(self.languages)), np.float32)
            place = np.searchsorted(self.known, keys)
            new = np.ones(len(keys), dtype=bool)
            inside = place < len(self.known)
            new[inside] = self.known[place[inside]] != keys[inside]
            if new.any():
                where = at[first[new]]
                cost = self._cost([codes[where - k] for k in range(ORDER - 1, -1, -1)])
                self.costs = np.insert(self.costs, place[new], cost, axis=0)
                self.known = np.insert(self.known, place[new], keys[new])
                place = np.searchsorted(self.known, keys)
            cost = self.costs[place]
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(row, weights=cost[:, k][of], minlength=len(texts))
        return letters, n, sums


def posterior(temperature: float, n: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    z = -temperature * np.sqrt(n)[:, None] * entropy
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def gram_counts(docs: DataFrame, label: str) -> DataFrame:
    """lang, high, low and n: the count of every n-gram of every language, over all rows of ``docs``.

    high and low hold two characters each. Runs of texts are counted where they are read, and
    Spark adds the counts up before and after the shuffle.
    """
    if ORDER != 4:
        raise ValueError("high and low hold four characters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, _, _ in textkit.runs(batch.column(1)):
                names, of = np.unique(batch.column(0).slice(start, stop - start).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                for codes, at, row, _ in streams(batch.column(1).slice(start, stop - start).to_pylist()):
                    columns = [codes[at - k].astype(np.int64) for k in range(ORDER - 1, -1, -1)]
                    _, first, n = np.unique(gram_keys([of[row], *columns]), return_index=True, return_counts=True)
                    a, b, c, d = (x[first] for x in columns)
                    yield pa.RecordBatch.from_arrays([pa.array(names[of[row[first]]].tolist(), pa.string()), pa.array(a << 21 | b), pa.array(c << 21 | d), pa.array(n)], names=["lang", "high", "low", "n"])

    chosen = small_batches(docs.select(F.col(label).cast("string").alias("lang"), "text").filter("lang is not null and text is not null"))
    return chosen.mapInArrow(run, "lang string, high long, low long, n long").groupBy("lang", "high", "low").agg(F.sum("n").alias("n"))


def part_of(code: np.ndarray, parts: int) -> np.ndarray:
    return (code.astype(np.int64) * 40503 >> 3) % parts


def levels_of(counts: DataFrame) -> list[DataFrame]:
    """For 1 to ORDER characters: lang, the n-gram (c0, c1, ...), its share and its context's back_off, from all n-grams counted.

    Below the highest level an n-gram counts once for each character that was seen before it. The discount of a level
    is N1 / (N1 + 2 N2) of its language, over all its n-grams; 0.5 where none was seen once.
    """
    low = (1 << 21) - 1
    split = [F.call_function("shiftright", F.col(half), F.lit(21)) if first else F.col(half).bitwiseAND(low) for half in ("high", "low") for first in (True, False)]
    grams = counts.select("lang", *(c.cast("int").alias(f"c{k}") for k, c in enumerate(split)), F.col("n").cast("double").alias("n"))
    out = []
    for size in range(ORDER, 0, -1):
        names = [f"c{k}" for k in range(size)]
        if size < ORDER:
            longer = [F.col(f"c{k + 1}").alias(f"c{k}") for k in range(size)]
            grams = grams.select("lang", *longer).groupBy("lang", *names).agg(F.count("*").cast("double").alias("n"))
        grams = settle(grams)
        tail = grams.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
        discount = tail.select("lang", F.when(F.col("once") > 0, F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.5).alias("discount"))
        contexts = grams.groupBy("lang", *names[:-1]).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        known = grams.join(contexts, ["lang", *names[:-1]]).join(F.broadcast(discount), "lang")  # a row a language
        share = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        out.insert(0, known.select("lang", *names, share.alias("share"), (F.col("discount") * F.col("types") / F.col("total")).alias("back_off")))
    return out


def _arrays(table: pa.Table, size: int) -> Level:
    """The sorted arrays of one level of a language."""
    columns = [table.column(f"c{k}").to_numpy() for k in range(size)]
    grams, contexts = gram_keys(columns), gram_keys(columns[:-1]) if size > 1 else np.zeros(len(columns[0]), np.uint64)
    order = np.argsort(grams)
    known, first = np.unique(contexts, return_index=True)
    return Level(grams[order], table.column("share").to_numpy()[order].astype(np.float32), known, table.column("back_off").to_numpy()[first].astype(np.float32))


@dataclass
class Fitted:
    """Levels as settled tables, and what has been learned beside them; ``parts`` broadcasts hold the arrays."""

    languages: list[str]
    levels: list[DataFrame]
    alphabet: int
    parts: int
    temperature: float = 1.0
    limits: list[float] = field(default_factory=list)

    def part(self, part: int) -> Models:
        """The arrays of one part, which the driver makes of the finished numbers."""
        code = lambda name: (F.shiftright(F.col(name).cast("long") * 40503, 3)) % self.parts == part
        own = self.levels
        if self.parts > 1:
            # the next to last character of an n-gram decides, so that the part holds its contexts and shorter ends
            own = [t.filter(code(f"c{size - 2}")) if size > 1 else t for size, t in enumerate(own, 1)]
        tables = [t.toArrow() for t in own]
        levels = [[_arrays(t.filter(pc.equal(t.column("lang"), lang)), size) for size, t in enumerate(tables, 1)] for lang in self.languages]
        return Models(self.languages, levels, self.alphabet, part, self.parts)


def fit(docs: DataFrame, label: str = "lang", calibration_rows: int = CALIBRATION_ROWS, model_bytes: int = MODEL_BYTES) -> Fitted | None:
    """Models of all languages of the rows that aren't held out, or None if there is none.

    All those rows but one in CALIBRATION_SHARE, by a hash of doc_id, are counted, and every n-gram counted is in its
    language's model, which grows with the distinct n-grams; ``model_bytes`` bounds what is broadcast at once. Null texts and languages teach nothing, a null
    doc_id is counted, repeated rows count as often as they stand.
    """
    own = docs.filter(~held_out(F.col("doc_id")))
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_SHARE)) == 0
    counts = settle(gram_counts(own.filter(~aside), label))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    levels = [settle(t) for t in levels_of(counts)]
    discard(counts)
    size = sum(t.count() for t in levels) * 24
    fitted = Fitted(languages, levels, levels[0].select("c0").distinct().count(), max(1, -(-size // model_bytes)))
    _calibrate(fitted, own.filter(aside), label, calibration_rows)
    return fitted


def _calibrate(fitted: Fitted, aside: DataFrame, label: str, limit: int) -> None:
    named = aside.filter(F.col(label).isin(fitted.languages)).select("doc_id", F.col(label).cast("string").alias("lang"), "text")
    chosen = named.select(F.col("doc_id").alias("chosen_id")).distinct().orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(limit)
    some = named.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).drop("chosen_id")
    scored = _entropies(some, ["doc_id", "lang"], fitted)
    shown = scored.filter("letters > 0").orderBy(F.xxhash64("doc_id"), "doc_id", "n", "entropy").limit(limit).toPandas()
    fitted.limits = [float("inf")] * len(fitted.languages)
    if len(shown):
        entropy, n = np.array(shown["entropy"].tolist(), dtype=float), shown["n"].to_numpy(float)
        truth = np.array([fitted.languages.index(x) for x in shown["lang"]])
        loss = {}
        for t in np.geomspace(0.05, 50, 31):
            loss[float(t)] = -np.log(np.maximum(posterior(float(t), n, entropy)[np.arange(len(truth)), truth], 1e-9)).mean()
        fitted.temperature = min(loss, key=lambda t: (round(loss[t], 6), t))
        for k in range(len(fitted.languages)):
            if (truth == k).any():
                fitted.limits[k] = SLACK * float(np.quantile(entropy[truth == k, k], ACCEPTED_SHARE))


def _sums(docs: DataFrame, keep: list[str], models: Models) -> DataFrame:
    """The columns ``keep`` with letters, n and sums (one number a language) over a model's part; text is the column after them."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # MODEL_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(len(keep))
            for start, stop, _, _ in textkit.runs(column):
                letters, n, sums = own.entropies(column.slice(start, stop - start).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns[: len(keep)]), pa.array(letters), pa.array(n), lists], names=[*keep, "letters", "n", "sums"])

    fields = docs.select(*keep).schema.fields
    return small_batches(docs).mapInArrow(run, T.StructType([*fields, T.StructField("letters", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DoubleType()))]))


def _entropies(docs: DataFrame, keep: list[str], fitted: Fitted) -> DataFrame:
    """The columns ``keep`` with letters, n and entropy (one number a language) of every row; text is the column after them."""
    each = F.transform("sums", lambda x: x / F.greatest(F.col("n"), F.lit(1)))
    if fitted.parts == 1:
        return _sums(docs, keep, fitted.part(0)).select(*keep, "letters", "n", each.alias("entropy"))
    # every part adds what its characters cost; rows equal in id and text are one row here, and are counted
    keyed = docs.select(*keep, F.xxhash64("text").alias("text_hash"), "text")
    whole = None
    for part in range(fitted.parts):
        own = settle(_sums(keyed, [*keep, "text_hash"], fitted.part(part)))
        whole = own if whole is None else whole.union(own)
    total = F.array(*(F.sum(F.col("sums")[k]) for k in range(len(fitted.languages))))
    added = whole.groupBy(*keep, "text_hash").agg(F.first("letters").alias("letters"), (F.count("*") / fitted.parts).cast("int").alias("copies"), F.sum("n").alias("n"), total.alias("sums"))
    added = added.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return added.select(*keep, "letters", (F.col("n") / F.col("copies")).cast("long").alias("n"), each.alias("entropy"))


def identify(docs: DataFrame, models: Fitted | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted and nats (cross-entropy a character) of every row.

    Null texts and texts without a letter are ``und`` with score 0 and not accepted, and so is
    everything if nothing was learned. Of languages with equal entropy the first by name is chosen. score is the
    calibrated probability of the chosen language; a text whose entropy is over that language's
    limit is not accepted. Repeated rows get equal answers; a null doc_id is not held out; whole texts are read, however
    long; an empty table gives no rows. Only doc_id and text are read.
    """
    hold = held_out(F.col("doc_id")).alias("held_out")
    if models is None:
        return docs.select("doc_id", hold, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("nats"))
    shown = _entropies(docs.select("doc_id", "text"), ["doc_id"], models)
    best = F.array_position("entropy", F.array_min("entropy")).cast("int")
    weights = F.transform("entropy", lambda e: F.exp(-F.lit(models.temperature) * F.sqrt("n") * (e - F.array_min("entropy"))))
    score = 1 / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    limits = F.array(*map(F.lit, models.limits))
    spoken = F.col("letters") > 0
    return shown.select(
        "doc_id", hold, F.when(spoken, F.element_at(F.array(*map(F.lit, models.languages)), best)).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(spoken, score).otherwise(0.0).alias("score"), F.when(spoken, F.array_min("entropy") <= F.element_at(limits, best)).otherwise(False).alias("accepted"),
        F.when(spoken, F.array_min("entropy")).alias("nats"),
    )
