"""Times of file systems as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: 100 ns steps from 1601 to 1970.
EPOCH_1601 = 116444736000000000


def from_dos(packed: Column) -> Column:
    """A packed local date and time of two-second steps; null if a part is out of range."""
    bits = lambda at, n: F.shiftright(packed.cast("long"), at).bitwiseAND(F.lit((1 << n) - 1))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", bits(25, 7) + 1980, bits(21, 4), bits(16, 5), bits(11, 5), bits(5, 6), bits(0, 5) * 2)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def from_windows(ticks: Column) -> Column:
    """100 ns since 1601, to whole microseconds."""
    return F.timestamp_micros(F.floor((ticks - EPOCH_1601) / 10).cast("long"))


def windows_nanos(ticks: Column) -> Column:
    return (ticks - EPOCH_1601) * 100


def from_unix(seconds: Column, nanos: Column) -> Column:
    return F.timestamp_micros(seconds * 1000000 + F.floor(nanos / 1000).cast("long"))


def to_nanos(time: Column) -> Column:
    return F.unix_micros(time) * 1000
