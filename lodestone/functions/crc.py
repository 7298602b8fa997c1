"""CRC-32 algebra: the checksum of joined and of shortened data, without the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the reflected CRC-32 polynomial.
POLY = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def _product(a: list[int], b: list[int]) -> list[int]:
    return [_times(a, column) for column in b]


def _inverse(matrix: list[int]) -> list[int]:
    """Over bits, by elimination on columns."""
    rows = [(sum(((matrix[c] >> r) & 1) << c for c in range(32)), 1 << r) for r in range(32)]
    for i in range(32):
        pivot = next(r for r in range(i, 32) if rows[r][0] >> i & 1)
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for r in range(32):
            if r != i and rows[r][0] >> i & 1:
                rows[r] = (rows[r][0] ^ rows[i][0], rows[r][1] ^ rows[i][1])
    return [sum(((rows[r][1] >> c) & 1) << r for r in range(32)) for c in range(32)]


def _zero_byte() -> list[int]:
    """What one zero byte does to the register, as columns."""
    bit = [POLY] + [1 << i for i in range(31)]
    two = _product(bit, bit)
    four = _product(two, two)
    return _product(four, four)


_AHEAD: list[list[int]] = [_zero_byte()]
_BACK: list[list[int]] = [_inverse(_AHEAD[0])]


def _shift(crc: int, n: int, steps: list[list[int]]) -> int:
    """crc's register after n zero bytes, by squaring."""
    i = 0
    while n:
        if i == len(steps):
            steps.append(_product(steps[-1], steps[-1]))
        if n & 1:
            crc = _times(steps[i], crc)
        n >>= 1
        i += 1
    return crc


def combine(first: int, second: int, second_length: int) -> int:
    """CRC-32 of data of two parts."""
    return _shift(first, second_length, _AHEAD) ^ second


def uncombine(whole: int, second: int, second_length: int) -> int:
    """CRC-32 of the first part, from that of the whole and of the second part."""
    return _shift(whole ^ second, second_length, _BACK)


def zeros(n: int) -> int:
    """CRC-32 of n zero bytes."""
    return _shift(0xFFFFFFFF, n, _AHEAD) ^ 0xFFFFFFFF


def unpad(crc: int, padding: int) -> int:
    """CRC-32 of data, from that of the data and `padding` zero bytes."""
    return uncombine(crc, zeros(padding), padding)


def fold(crcs: list[int], size: int, length: int) -> int:
    """CRC-32 of a file from those of its zero-padded slices in order."""
    out, left = 0, length
    for crc in crcs:
        n = min(size, left)
        out = combine(out, unpad(crc, size - n) if n < size else crc, n)
        left -= n
    return out


@F.pandas_udf(T.LongType())
def crc32_fold(crcs: pd.Series, size: pd.Series, length: pd.Series) -> pd.Series:
    """A column of ordered slice checksums to file checksums."""
    return pd.Series([None if c is None else fold([int(x) for x in c], int(s), int(n)) for c, s, n in zip(crcs, size, length, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def crc32_combine(first: pd.Series, second: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([combine(int(a), int(b), int(n)) for a, b, n in zip(first, second, length, strict=True)], dtype=np.int64)


@F.pandas_udf(T.LongType())
def crc32_uncombine(whole: pd.Series, second: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([uncombine(int(a), int(b), int(n)) for a, b, n in zip(whole, second, length, strict=True)], dtype=np.int64)
