"""Token counts as rollups that signed deltas maintain.

A batch of inserts, deletes and revised counts is reduced to additive totals by source,
language and tokenizer version and committed under its id. A commit is one rename of a
finished folder, so that it takes place once or not at all; a batch that is sent again changes
nothing. The totals of any moment are the sum of the committed batches. Renames must be atomic, as
they are in HDFS and in local file systems; an object store without them needs a committer of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, textkit
from .common import settle, small_batches

KEYS = ("source", "lang", "tokenizer")
INSERT, DELETE, REVISE = "insert", "delete", "revise"
#: What a row of a batch holds: for inserts n_tokens, for deletes old_tokens, for revised counts both.
DELTA = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
#: Bytes from which a piece is merged by replay, pieces whose counts a worker remembers, and bits of a count.
LONG_PIECE, REMEMBERED_PIECES, COUNT_BITS = 500, 400_000, 48
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(deltas: DataFrame) -> DataFrame:
    """The additive totals of a batch.

    Counts that are null add nothing; null keys are keys of their own; an op that isn't known
    fails the job. Repeated rows count as often as they stand.
    """
    added, gone = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("long")
    docs = F.when(F.col("op") == INSERT, 1).when(F.col("op") == DELETE, -1).when(F.col("op") == REVISE, 0).otherwise(unknown)
    tokens = F.when(F.col("op") == INSERT, added).when(F.col("op") == DELETE, -gone).otherwise(added - gone)
    return deltas.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit(spark: SparkSession, root: str, batch: str, deltas: DataFrame) -> bool:
    """Commit a batch under ``root``; False, and no change, if a batch of that id is there already.

    The totals are written to a folder of their own first, which a lost executor or driver leaves
    behind without effect, and then renamed. An empty batch is committed as well.
    """
    if not batch or "/" in batch or batch.startswith((".", "_")):
        raise ValueError(f"not a batch id: {batch!r}")
    final, files = _file_system(spark, f"{root}/batch_id={batch}")
    if files.exists(final):
        return False
    draft, _ = _file_system(spark, f"{root}/_draft-{uuid.uuid4().hex}")
    signed(deltas).repartition(1).write.parquet(draft.toString())  # a row a key, summed before it moves
    done = files.rename(draft, final) if not files.exists(final) else False
    if not done:
        files.delete(draft, True)
    # a commit that raced with another of the same id may have been moved into its folder
    stray, _ = _file_system(spark, f"{final.toString()}/{draft.getName()}")
    if files.exists(stray):
        files.delete(stray, True)
        return False
    return bool(done)


def totals(spark: SparkSession, root: str, among: list[str] | None = None) -> DataFrame:
    """source, lang, tokenizer, n_docs and n_tokens of all committed batches, or of some; keys without documents or tokens are left out."""
    path, files = _file_system(spark, root)
    batches = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("batch_id=")] if files.exists(path) else []
    batches = [b.toString() for b in batches if among is None or b.getName().removeprefix("batch_id=") in among]
    found = spark.read.schema(_TOTALS).parquet(*batches) if batches else spark.createDataFrame([], _TOTALS)
    summed = found.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.filter("n_docs <> 0 or n_tokens <> 0")


class PieceCounts:
    """Token counts of texts under several rank files that share a pattern: a text is split once, and a piece is counted once and then known.

    Pieces are merged by tiktoken one by one, and those over LONG_PIECE bytes, on which its time grows with the square of their
    length, by bpe.MergeReplay. Texts are never handed to tiktoken's own splitter, whose stack a long run of blanks overflows.
    """

    def __init__(self, files: list[bytes], pattern: str):
        import regex
        import tiktoken

        self.files, self.text_pattern = files, pattern
        self.pattern = regex.compile(pattern)
        self.coders = [tiktoken.Encoding(str(k), pat_str=".", mergeable_ranks={t: r for r, t in enumerate(bpe.tokens(raw)) if t}, special_tokens={}) for k, raw in enumerate(files)]
        self.long: dict[int, bpe.MergeReplay] = {}
        self.known: dict[str, int] = {}

    def _count(self, k: int, piece: bytes) -> int:
        if len(piece) <= LONG_PIECE:
            return len(self.coders[k]._encode_single_piece(piece))
        if k not in self.long:
            self.long[k] = bpe.MergeReplay(self.files[k], self.text_pattern)
        return 1 if piece in self.long[k].ranks else len(self.long[k].replay([piece])[0])

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > REMEMBERED_PIECES:
            self.known.clear()
        for piece in pieces - self.known.keys():
            raw = piece.encode("utf-8")
            # one number holds the counts of all files, so that a text is one sum
            self.known[piece] = sum(self._count(k, raw) << COUNT_BITS * k for k in range(len(self.files)))

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pattern.findall(t) for t in texts]
        self._learn(set().union(*split))
        return [sum(map(self.known.__getitem__, pieces)) for pieces in split]

    def count_long(self, text: str) -> int:
        total, found = 0, (m.group() for m in self.pattern.finditer(text))
        while pieces := list(islice(found, bpe.PIECES_AT_ONCE)):
            self._learn(set(pieces))
            total += sum(map(self.known.__getitem__, pieces))
        return total

    def parts(self, total: int) -> list[int]:
        return [total >> COUNT_BITS * k & (1 << COUNT_BITS) - 1 for k in range(len(self.files))]


_counter: dict[bytes, PieceCounts] = {}


def _counts_of(files: list[bytes], pattern: str) -> PieceCounts:
    """The counter of these files, which a worker process keeps between tasks; only the last is kept."""
    key = hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in (*files, pattern.encode()))).digest()
    if key not in _counter:
        _counter.clear()
        _counter[key] = PieceCounts(files, pattern)
    return _counter[key]


def count_tokens(docs: DataFrame, rank_paths: dict[str, str], pattern: str) -> DataFrame:
    """``docs`` without text, and a column of token counts for each tokenizer version; null and empty texts count 0."""
    rest = [c for c in docs.columns if c != "text" and c not in rank_paths]
    files = []
    for path in rank_paths.values():
        with open(path, "rb") as f:
            files.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counts_of(shared.value, pattern)
        for batch in batches:
            column = batch.column(len(rest))
            for start, stop, data, _ in textkit.runs(column):
                texts = [t or "" for t in column.slice(start, stop - start).to_pylist()]
                totals = [counter.count_long(texts[0])] if len(data) > textkit.RUN_BYTES else counter.count(texts)
                counts = [pa.array(c, pa.int64()) for c in zip(*map(counter.parts, totals))]
                yield pa.RecordBatch.from_arrays([*(x.slice(start, stop - start) for x in batch.columns[:-1]), *counts], names=[*rest, *rank_paths])

    fields = docs.select(*rest).schema.fields
    return small_batches(docs.select(*rest, "text")).mapInArrow(run, T.StructType([*fields, *(T.StructField(name, T.LongType()) for name in rank_paths)]))


def deltas(counted: DataFrame, op: str, versions: list[str]) -> DataFrame:
    """A batch that inserts or deletes every row of ``counted`` under every tokenizer version."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("tokenizer"), F.col(v).alias("n")) for v in versions))).alias("v")
    rows = counted.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), each)
    count = F.col("v.n")
    none = F.lit(None).cast("long")
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.col("v.tokenizer").alias("tokenizer"), (count if op != DELETE else none).alias("n_tokens"), (count if op == DELETE else none).alias("old_tokens"))


def revise(counted: DataFrame, version: str, new: str, old: str) -> DataFrame:
    """A batch that revises the counts stored under ``version`` from the column ``old`` to the column ``new``."""
    return counted.select(F.lit(REVISE).alias("op"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer"), F.col(new).alias("n_tokens"), F.col(old).alias("old_tokens"))


def upgrade(counted: DataFrame, old: str, new: str) -> DataFrame:
    """A batch that moves documents from one tokenizer version to another: out under the old name, in under the new one."""
    return deltas(counted, DELETE, [old]).unionByName(deltas(counted, INSERT, [new]))


#: Bytes that a token is taken to have before it is counted.
GUESSED_BYTES = 4


def maintain(spark: SparkSession, docs: DataFrame, root: str, rank_paths: dict[str, str], pattern: str) -> DataFrame:
    """after, source, lang, tokenizer, n_docs and n_tokens: the totals after each of four batches under ``root``.

    ``load`` brings in all documents with guessed counts, a token for each GUESSED_BYTES bytes begun, under
    the first tokenizer; ``count`` revises the guesses to true counts; ``copies`` takes out what copies an earlier document;
    ``upgrade`` moves what is left to the second tokenizer. All batches are then sent again, which changes nothing.
    A copy has the text of a document that comes before it by doc_id, source and lang, nulls first; of rows equal in
    all of these one stays, whatever their order. Null and empty texts are copies of each other and count 0 tokens. An
    empty table gives no rows; very long texts are counted whole.

    Copies go as all rows out and the first of each text in: sums over all rows and one minimum a text, so that a text
    that many rows share is gathered nowhere.
    """
    if len(rank_paths) != 2:
        raise ValueError("two tokenizer versions are needed")
    old, new = rank_paths
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    guess = F.ceil(F.octet_length(text) / GUESSED_BYTES).alias("guess")
    keyed = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), guess, "text", F.sha2(text, 256).alias("content"))
    counted = settle(count_tokens(keyed, rank_paths, pattern))
    order = ("doc_id", "source", "lang", old, new)
    firsts = settle(counted.groupBy("content").agg(F.min(F.struct(*order)).alias("first")).select(*(F.col(f"first.{c}").alias(c) for c in order)))
    guessed = counted.withColumn(old, F.col("guess"))
    batches = {
        "load": deltas(guessed, INSERT, [old]),
        "count": revise(counted, old, old, "guess"),
        "copies": deltas(counted, DELETE, [old]).unionByName(deltas(firsts, INSERT, [old])),
        "upgrade": upgrade(firsts, old, new),
    }
    for _ in range(2):
        for name, batch in batches.items():
            commit(spark, root, name, batch)
    names = list(batches)
    after = [totals(spark, root, names[: k + 1]).select(F.lit(name).alias("after"), "*") for k, name in enumerate(names)]
    return reduce(DataFrame.unionByName, after)
