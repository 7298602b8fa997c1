"""Vectorised text kernels over Arrow string columns.

A batch of texts is one byte buffer with offsets. Words, hashes and shingles are found by
array operations over the whole buffer; no kernel loops over characters in Python.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower case of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SUB_BYTES = 2 << 20
LONG = 1024
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n at least; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ np.uint64(salt)  # a new array, changed in place from here on
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SUB_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def segments(batch: pa.RecordBatch, text: str = "text", most: int = SUB_BYTES):
    """(rows of the batch, bytes, offsets) in pieces of bounded size."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    for i, j in slices(offsets, most):
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def runs(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross an offset."""
    n = len(keep)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = keep[edges]
    last = keep.copy()
    last[:-1] &= ~keep[1:]
    last[edges - 1] = keep[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; rows are those of offsets."""
    start, end = runs((data != 0x20) & (data - np.uint8(9) > 4), offsets)  # as SPACE has it, by comparisons
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True, lanes: int = 1) -> np.ndarray:
    """64-bit hashes of data[start:end], of any spans; with two lanes, two independent ones as columns.

    Eight bytes at a time go through a bijective mixer that starts from the length. Not a polynomial:
    no text gives equal values by its structure. Spans of more than LONG bytes are hashed by blake2b.
    """
    size = (end - start).astype(np.int64)
    out = [mix(size.astype(np.uint64), salt) for salt in (0x51ED, 0xC3A5)[:lanes]]
    padded = np.concatenate([LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at, step = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(at):
        value = eight[start[at] + step] & _MASK[np.minimum(size[at] - step, 8)]
        out[0][at] = mix(out[0][at] ^ value)
        if lanes > 1:
            out[1][at] = mix((out[1][at] + value) * np.uint64(_BASE), 0x2B)
        step += 8
        at = at[size[at] > step]
    for i in np.flatnonzero(size > LONG):
        whole = np.frombuffer(hashlib.blake2b(padded[start[i] : end[i]], digest_size=16).digest(), "<u8")
        for lane in range(lanes):
            out[lane][i] = whole[lane]
    return out[0] if lanes == 1 else np.stack(out, axis=1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of every word, lower case A-Z."""
    start, end, row = words(data, offsets)
    return start, end, row, span_hashes(data, start, end)


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores after it until no column has it (in any case of letters)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-word shingle; a row with fewer words, but one at least, gives one of all its words."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    out_h, out_r = [], []
    if len(hashes) >= n:
        value = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            value = mix(value + hashes[i : len(hashes) - n + 1 + i], i + 1)
        same = row[: len(value)] == row[n - 1 :]
        out_h.append(value[same])
        out_r.append(row[: len(value)][same])
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            value = np.full(len(short), m, np.uint64)
            for i in range(m):
                value = mix(value + hashes[first[short] + i], 0xABC + i)
            out_h.append(value)
            out_r.append(short)
    if not out_h:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_r), np.concatenate(out_h)


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, by row and value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_mod(ids: list, modulus: int) -> np.ndarray:
    """crc32 of the id as text, modulo; the id null counts as empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % modulus for x in ids], np.int64)
