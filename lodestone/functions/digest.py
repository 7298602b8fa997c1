"""Content slices and digests as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUICK_BYTES = 16 * 1024


def content(text: str | Column) -> Column:
    """UTF-8 bytes of a text."""
    return F.encode(F.col(text) if isinstance(text, str) else text, "utf-8")


def slice_count(length: Column, size: int) -> Column:
    """ceil(length / size); nothing has no slices."""
    return F.when(length <= 0, F.lit(0).cast("long")).otherwise(F.floor((length + (size - 1)) / size))


def slice_at(data: Column, index: Column, size: int) -> Column:
    return F.substring(data, (index * size + 1).cast("int"), F.lit(size))


def padded(data: Column, size: int) -> Column:
    """Zero-padded to size bytes."""
    return F.rpad(data, F.lit(size), F.lit(b"\x00"))


def quick_md5(data: Column) -> Column:
    """md5 of the first 16 KiB."""
    return F.md5(F.substring(data, 1, QUICK_BYTES))


def slices(df: DataFrame, data: str, size: int, index: str = "slice_index") -> DataFrame:
    """One row per slice of the binary column; empty content gives none (a sequence to -1 would run down)."""
    n = slice_count(F.octet_length(data), size)
    return df.where(F.octet_length(data) > 0).withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("slice", slice_at(F.col(data), F.col(index), size))
