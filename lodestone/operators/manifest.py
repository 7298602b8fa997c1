"""Manifests of protected files: identities, slices and damage by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digest


def protected(docs: DataFrame, set_col: str = "source") -> DataFrame:
    """Documents as files: file_id, set_id, data."""
    return docs.select(F.col("doc_id").alias("file_id"), F.col(set_col).alias("set_id"), digest.content("text").alias("data"))


def file_manifest(files: DataFrame, size: int) -> DataFrame:
    """Length, full and quick md5, and number of slices."""
    n = F.octet_length("data").cast("long")
    return files.select("set_id", "file_id", n.alias("length"), F.md5("data").alias("md5_full"), digest.quick_md5(F.col("data")).alias("md5_16k"), digest.slice_count(n, size).cast("long").alias("n_slices"))


def slice_manifest(files: DataFrame, size: int, pad: bool = False) -> DataFrame:
    """md5 and crc32 of each slice; pad: of the slice with zeros up to size."""
    piece = digest.padded(F.col("slice"), size) if pad else F.col("slice")
    return digest.slices(files, "data", size).select("set_id", "file_id", "slice_index", F.octet_length("slice").cast("long").alias("length"), F.md5(piece).alias("md5"), F.crc32(piece).alias("crc32"))


def damaged(files: DataFrame, lost: Column, hit: Column, size: int) -> DataFrame:
    """A copy of the files: those of `lost` are gone, those of `hit` have their first slice overwritten with 0xA5."""
    first = F.least(F.octet_length("data"), F.lit(size))
    junk = F.rpad(F.lit(b"\xa5"), first, F.lit(b"\xa5"))
    bad = F.concat(junk, F.substring(F.col("data"), F.lit(size + 1), F.greatest(F.octet_length("data") - size, F.lit(0))))
    return files.where(~lost).withColumn("data", F.when(hit & (F.octet_length("data") > 0), bad).otherwise(F.col("data")))


def expected_crc32(slices: DataFrame, files: DataFrame, size: int) -> DataFrame:
    """A file's crc32 from those of its padded slices."""
    from ..functions.crc import crc32_fold

    ordered = slices.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("slice_index", "crc32"))).alias("s"))
    return ordered.join(files.select("file_id", F.octet_length("data").cast("long").alias("length")), "file_id").select("file_id", crc32_fold(F.transform("s", lambda x: x["crc32"]), F.lit(size).cast("long"), "length").alias("crc32"))
