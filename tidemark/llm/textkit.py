"""Vectorised word arithmetic over Arrow string columns.

Everything works on the UTF-8 bytes of a run of rows at once: word borders come from a
256-entry byte table, and byte ranges are hashed eight bytes at a time for all ranges
together, so no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer text is one run of its own.
RUN_BYTES = 1 << 20
#: Bytes of a range that are folded in arrays; the rest of a longer one is digested on its own.
LONG = 128
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


#: Bytes that separate words: space and \x09-\x0D. All are ASCII, so UTF-8 bytes can be tested one by one.
BLANK = byte_table((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, all other bytes as they are.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), at


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about ``limit`` bytes."""
    data, at = utf8(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, the same wherever the range stands.

    Ranges are folded eight bytes at a time through a bijection, so that two of equal length up to
    eight bytes never share a hash; what lies beyond LONG bytes enters by its BLAKE2 digest.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    left = np.flatnonzero(size > 0)
    for step in range(0, LONG, 8):
        h[left] = mix(h[left] ^ (eight[starts[left] + step] & _FIRST[np.minimum(size[left] - step, 8)]))
        left = left[size[left] > step + 8]
    rest = [int.from_bytes(hashlib.blake2b(padded[a + LONG : z], digest_size=8).digest(), "little") for a, z in zip(starts[left].tolist(), ends[left].tolist())]
    h[left] = mix(h[left] ^ np.array(rest, dtype=np.uint64))
    return h


def words(data: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of non-blank bytes; no word crosses a row."""
    inside = ~blank[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    before[heads] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def per_row(rows: int, row: np.ndarray) -> np.ndarray:
    return np.bincount(row, minlength=rows).astype(np.int64)


def windows(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of every run of ``size`` hashes that lies in one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(row[:n] == row[size - 1 :])
    h = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0xC6BC279692B5C323) + hashes[first + k]
    return mix(h), first
