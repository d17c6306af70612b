"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The pieces of a run of texts are gathered into one corpus of distinct words. An inverted
index maps the rank of every mergeable token pair to the positions where the pair stands;
ranks are replayed in ascending order, each merge is applied to all its positions in every
word, and only the two pairs that touch a merged position enter the index anew.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import small_batches

#: Words in each of the two generations of ids that a worker remembers between runs.
REMEMBERED_WORDS = 200_000
#: Of those, words that it keeps between tasks.
KEPT_WORDS = 60_000
#: Token pairs whose rank a worker remembers.
REMEMBERED_PAIRS = 200_000
#: Pieces of one text that are handled at once.
PIECES_AT_ONCE = 200_000


def tokens(rank_file: bytes) -> list[bytes]:
    """The bytes of every rank; empty where the file has none."""
    pairs = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, rank_file.splitlines())]
    out = [b""] * (max(rank for _, rank in pairs) + 1)
    for token, rank in pairs:
        out[rank] = token
    return out


def decode_ids(token: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(token.__getitem__, memoryview(ids).cast("I")))


class MergeReplay:
    """Encoder for a rank file (lines of base64 token and rank)."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.token = tokens(rank_file)
        self.ranks = {token: rank for rank, token in enumerate(self.token) if token}
        self.byte_rank = [self.ranks[bytes([b])] for b in range(256)]
        self.first_ranks = {(a, b): rank for a in range(256) for b in range(256) if (rank := self.ranks.get(bytes((a, b)))) is not None}
        self.pattern = regex.compile(pattern)
        self.joined: dict[int, int] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pair_rank(self, left: int, right: int) -> int:
        """Rank of the token that two neighbours make, or -1."""
        key = left << 32 | right
        rank = self.joined.get(key)
        if rank is None:
            if len(self.joined) > REMEMBERED_PAIRS:
                self.joined.clear()
            rank = self.joined[key] = self.ranks.get(self.token[left] + self.token[right], -1)
        return rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, all merges of a rank being applied to the whole list at once."""
        ids: list[int] = []
        after: list[int] = []
        before: list[int] = []
        word_of: list[int] = []
        firsts: list[int] = []
        where: dict[int, list[int]] = {}
        joined, pair_rank, byte_rank, first_ranks = self.joined, self._pair_rank, self.byte_rank, self.first_ranks
        for w, word in enumerate(words):
            first, size = len(ids), len(word)
            firsts.append(first)
            if not size:
                continue
            ids += [byte_rank[b] for b in word]
            before += range(first - 1, first + size - 1)
            after += range(first + 1, first + size + 1)
            before[first] = after[-1] = -1
            word_of += [w] * size
            for p, rank in enumerate(map(first_ranks.get, zip(word, word[1:])), first):
                if rank is not None:
                    if rank in where:
                        where[rank].append(p)
                    else:
                        where[rank] = [p]
        waiting = list(where)
        heapify(waiting)
        while waiting:
            rank = heappop(waiting)
            positions = where.pop(rank, None)
            if positions is None:
                continue
            overtaken: set[int] = set()  # words in which a merge has made a pair of lower rank
            positions.sort()
            for p in positions:
                left = ids[p]
                q = after[p]
                if left < 0 or q < 0 or joined.get(left << 32 | ids[q]) != rank and pair_rank(left, ids[q]) != rank:
                    continue
                if overtaken and word_of[p] in overtaken:
                    if rank not in where:
                        where[rank] = []
                        heappush(waiting, rank)
                    where[rank].append(p)
                    continue
                ids[p], ids[q] = rank, -1
                r = after[p] = after[q]
                o = before[p]
                if r >= 0:
                    before[r] = p
                    made = joined.get(rank << 32 | ids[r])
                    if made is None:
                        made = pair_rank(rank, ids[r])
                    if made >= 0:
                        if made in where:
                            where[made].append(p)
                        else:
                            where[made] = [p]
                            heappush(waiting, made)
                        if made < rank:
                            overtaken.add(word_of[p])
                if o >= 0:
                    made = joined.get(ids[o] << 32 | rank)
                    if made is None:
                        made = pair_rank(ids[o], rank)
                    if made >= 0:
                        if made in where:
                            where[made].append(o)
                        else:
                            where[made] = [o]
                            heappush(waiting, made)
                        if made < rank:
                            overtaken.add(word_of[p])
        out = []
        for first, word in zip(firsts, words):
            found, p = [], first if word else -1
            while p >= 0:
                found.append(ids[p])
                p = after[p]
            out.append(found)
        return out

    def rest(self) -> None:
        """Forget all but some frequent words: those that came first after the last change of generations."""
        self.known, self.older, self.joined = dict(islice(self.known.items(), KEPT_WORDS)), {}, {}

    def learn(self, pieces: set[str]) -> None:
        """Make the packed ids of all ``pieces`` known."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known, self.older = {}, self.known
        new = []
        for piece in pieces - self.known.keys():
            ids = self.older.get(piece)
            if ids is None:
                new.append(piece)
            else:
                self.known[piece] = ids
        raw = [x.encode("utf-8") for x in new]
        merge = []
        for piece, word in zip(new, raw):
            rank = self.ranks.get(word)
            if rank is None:
                merge.append((piece, word))
            else:
                self.known[piece] = rank.to_bytes(4, "little")
        for (piece, _), ids in zip(merge, self.replay([word for _, word in merge])):
            self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def encode_long(self, text: str) -> bytes:
        out, found = [], (m.group() for m in self.pattern.finditer(text))
        while pieces := list(islice(found, PIECES_AT_ONCE)):
            self.learn(set(pieces))
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return b"".join(out)


_loaded: dict[tuple[bytes, str], MergeReplay] = {}


def _codec(shared, pattern: str) -> MergeReplay:
    """The codec of a rank file, which a worker process keeps between tasks; only the last is kept."""
    key = (hashlib.sha256(shared.value).digest(), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = MergeReplay(shared.value, pattern)
    return _loaded[key]


def _rank_file(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "token_ids", back: str | None = None) -> DataFrame:
    """``docs`` with a binary column ``ids``: the token ids of ``text`` as little-endian unsigned 32-bit integers.

    With ``back``, a column of that name has the bytes that the ids decode to, made by the same task.

    Null and empty texts get zero ids, without null. Each match of ``pattern`` is encoded
    separately and no special token is known. All other columns, also one named like a
    temporary of ours, pass unchanged; a column already named ``ids`` is replaced. Rows are
    handled where they are read: no shuffle, and one long text takes memory for itself only.
    """
    rest = [c for c in docs.columns if c not in (ids, back)]
    made = [ids, back] if back else [ids]
    shared = _rank_file(docs.sparkSession, rank_path)
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            column = batch.column(at)
            for row, stop, data, _ in textkit.runs(column):
                texts = [t or "" for t in column.slice(row, stop - row).to_pylist()]
                done = [codec.encode_long(texts[0])] if len(data) > textkit.RUN_BYTES else codec.encode(texts)
                part = batch.slice(row, stop - row)
                columns = [done, [decode_ids(codec.token, x) for x in done]] if back else [done]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.binary()) for c in columns)], names=[*rest, *made])
        codec.rest()

    schema = T.StructType([*docs.select(*rest).schema.fields, *(T.StructField(c, T.BinaryType()) for c in made)])
    return small_batches(docs.select(*rest)).mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``out``: the bytes that ``ids`` stands for; null ids give no bytes."""
    rest = [c for c in encoded.columns if c != out]
    shared = _rank_file(encoded.sparkSession, rank_path)
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens(shared.value)
        for batch in batches:
            for row in range(0, batch.num_rows, 500):
                part = batch.slice(row, 500)
                done = [decode_ids(token, x or b"") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.binary())], names=[*rest, out])

    schema = T.StructType([*encoded.select(*rest).schema.fields, T.StructField(out, T.BinaryType())])
    return encoded.select(*rest).mapInArrow(run, schema)


def digest(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, and SHA-256 of the packed ids and of the bytes that they decode to."""
    return encode(docs.select("doc_id", "text"), rank_path, pattern, back="decoded").select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
