"""CRC-32 of every window of a byte string, by doubling.

A register that starts at zero is linear: that of two strings end to end is the first one's, moved on
by the length of the second, and the second's. So windows of twice a length come from two of the
length, for all places at once, and any length from powers of two. In long data a register rolls over
each of many lanes instead, all lanes at once. Checksums of what strings end with come, for all lengths,
from one walk back from their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
SEGMENT, LANES = 8 << 20, 256


@lru_cache
def byte_table() -> np.ndarray:
    """The register after each single byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


class Shift:
    """Moves registers on over `length` zero bytes, by four tables, one for each byte of a register."""

    def __init__(self, tables: np.ndarray, length: int):
        self.tables, self.length = tables, length

    def __call__(self, r: np.ndarray) -> np.ndarray:
        t = self.tables
        return t[0][r & np.uint32(255)] ^ t[1][(r >> np.uint32(8)) & np.uint32(255)] ^ t[2][(r >> np.uint32(16)) & np.uint32(255)] ^ t[3][r >> np.uint32(24)]

    @staticmethod
    def one() -> Shift:
        single = byte_table()
        v = np.arange(256, dtype=np.uint32)
        return Shift(np.stack([single, v, v << np.uint32(8), v << np.uint32(16)]), 1)

    def then(self, other: Shift) -> Shift:
        return Shift(np.stack([other(t) for t in self.tables]), self.length + other.length)


@lru_cache(maxsize=256)
def _over(length: int) -> Shift:
    """Over any length, from powers of two."""
    if length == 1:
        return Shift.one()
    half = _over(length // 2)
    return half.then(half).then(_over(1)) if length % 2 else half.then(half)


def _registers(data: np.ndarray, size: int) -> np.ndarray:
    block, step = byte_table()[data], _over(1)
    out, have, rest = None, 0, size
    while True:
        if rest & 1:
            out = block if out is None else step(out[: len(block) - have]) ^ block[have : have + len(out)]
            have += step.length
        rest >>= 1
        if not rest:
            return out[: len(data) - size + 1]
        n = step.length
        block = step(block[: len(block) - n]) ^ block[n:] if len(block) > n else block[:0]
        step = _over(2 * n)


def _rolled(data: np.ndarray, size: int) -> np.ndarray:
    """The same for lanes as long as a window: a lane's register, then a byte in and a byte out at a time."""
    table, low, byte = byte_table(), np.uint32(255), np.uint32(8)
    gone, m = _over(size)(table), -(-len(data) // size)
    lanes = np.zeros((m + 1) * size, np.uint8)
    lanes[: len(data)] = data
    lanes = np.ascontiguousarray(lanes.reshape(m + 1, size).T)
    r, out = np.zeros(m, np.uint32), np.empty((size, m), np.uint32)
    for row in lanes:
        r = table[(r ^ row[:-1]) & low] ^ (r >> byte)
    for row, told in zip(lanes, out, strict=True):
        told[:] = r
        r = table[(r ^ row[1:]) & low] ^ (r >> byte) ^ gone[row[:-1]]
    return out.T.reshape(-1)[: len(data) - size + 1]


def window_segments(data: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(a, crc32 of data[i : i + size] for each i from a on), of SEGMENT places at most; nothing if data is shorter."""
    if size < 1:
        raise ValueError("a window has one byte at least")
    if len(data) < size:
        return
    full = np.uint32(0xFFFFFFFF)
    turn = _over(size)(np.full(1, full))[0] ^ full
    for a in range(0, len(data) - size + 1, SEGMENT):
        part = data[a : min(len(data), a + SEGMENT + size - 1)]
        yield a, (_rolled if len(part) >= LANES * size else _registers)(part, size) ^ turn


def window_crcs(data: np.ndarray, size: int) -> np.ndarray:
    """crc32 of data[i : i + size] for each i; nothing if data is shorter. A window is one byte at least."""
    return np.concatenate([np.zeros(0, np.uint32), *(found for _, found in window_segments(data, size))])


def end_crcs(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, crc32 of the last n bytes of each string of n bytes or more) for each n up to `most`, while there are such.

    Strings lie in data before `ends`, the longest first, so that those of n bytes or more come first.
    """
    table, low, byte, full = byte_table(), np.uint32(255), np.uint32(8), np.uint32(0xFFFFFFFF)
    # the register of each byte moved on over those after it, and last that of the start over all of them
    moved = np.append(table, table[255] ^ (full >> byte))
    r = np.zeros(len(ends), np.uint32)
    counts = np.searchsorted(-lengths, -np.arange(most + 1), "right")
    for n in range(1, most + 1):
        k = int(counts[n])
        if not k:
            return
        r = r[:k] ^ moved[data[ends[:k] - n]]
        yield n, r ^ (moved[256] ^ full)
        moved = table[moved & low] ^ (moved >> byte)
