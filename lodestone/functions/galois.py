"""The field of 2**16 elements and the field of 2**8 elements, by log tables made from their polynomials."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The polynomials of the two fields.
POLY16, POLY8 = 0x1100B, 0x11D
#: The prime factors of 2**16 - 1.
FACTORS = (3, 5, 17, 257)


class Field:
    def __init__(self, bits: int, poly: int):
        self.order = (1 << bits) - 1
        self.exp, self.log = np.zeros(2 * self.order + 1, np.int64), np.zeros(self.order + 1, np.int64)
        x = 1
        for i in range(self.order):
            self.exp[i], self.log[x] = x, i
            x <<= 1
            if x > self.order:
                x ^= poly
        self.exp[self.order : 2 * self.order] = self.exp[: self.order]

    def mul(self, a, b):
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        return np.where((a == 0) | (b == 0), 0, self.exp[self.log[a] + self.log[b]])

    def inv(self, a):
        a = np.asarray(a, np.int64)
        if (a == 0).any():
            raise ZeroDivisionError("zero has no inverse")
        return self.exp[self.order - self.log[a]]

    def pow(self, a, n):
        """a ** n; anything to the power 0 is 1, zero too."""
        a, n = np.broadcast_arrays(np.asarray(a, np.int64), np.asarray(n, np.int64))
        return np.where(n == 0, 1, np.where(a == 0, 0, self.exp[self.log[a] * n % self.order]))

    def matmul(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums are exclusive ors; one column of a at a time."""
        out = np.zeros((a.shape[0], b.shape[1]), np.int64)
        for k in range(a.shape[1]):
            out ^= self.mul(a[:, k : k + 1], b[k : k + 1])
        return out

    def invert(self, m: np.ndarray) -> np.ndarray:
        """Gauss-Jordan elimination; a singular matrix is an error."""
        n = len(m)
        a = np.concatenate([np.asarray(m, np.int64), np.eye(n, dtype=np.int64)], axis=1)
        for i in range(n):
            pivots = np.flatnonzero(a[i:, i])
            if not len(pivots):
                raise np.linalg.LinAlgError(f"singular at row {i}")
            p = i + int(pivots[0])
            if p != i:
                a[[i, p]] = a[[p, i]]
            a[i] = self.mul(a[i], self.inv(a[i, i]))
            rows = np.flatnonzero(a[:, i])
            rows = rows[rows != i]
            a[rows] ^= self.mul(a[rows, i : i + 1], a[i : i + 1])
        return a[:, n:]


@lru_cache(2)
def field(bits: int = 16) -> Field:
    return Field(bits, POLY16 if bits == 16 else POLY8)


def constants(n: int) -> np.ndarray:
    """2 ** e for the first n exponents e that no factor of the group's order divides."""
    e = np.arange(1, 65535)
    good = e[np.all([e % f != 0 for f in FACTORS], axis=0)]
    if n > len(good):
        raise ValueError(f"at most {len(good)} input slices")
    return field().exp[good[:n]]


def constant_exponents(spark: SparkSession) -> DataFrame:
    """(index, exponent): the rule of `constants` in SQL."""
    e = spark.range(1, 65535).withColumnRenamed("id", "exponent")
    for f in FACTORS:
        e = e.where(F.col("exponent") % f != 0)
    return e.select((F.row_number().over(Window.orderBy("exponent")) - 1).cast("long").alias("index"), "exponent")


def _udf(name: str):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(getattr(field(), name)(a.to_numpy(), b.to_numpy()))

    return F.pandas_udf(run, T.LongType())


gf_mul, gf_pow = _udf("mul"), _udf("pow")


@F.pandas_udf(T.LongType())
def gf_inv(a: pd.Series) -> pd.Series:
    return pd.Series(field().inv(a.to_numpy()))
