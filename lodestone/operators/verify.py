"""Verification: slices against a manifest, the status ladder of files, and what sets can repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verify_slices(expected: DataFrame, actual: DataFrame, by: tuple[str, ...] = ("md5", "crc32")) -> DataFrame:
    """Every expected slice with `valid`: all digests of `by` agree; a slice that isn't there is not valid."""
    a = actual.select("file_id", "slice_index", *(F.col(c).alias(f"_{c}") for c in by))
    good = F.lit(True)
    for c in by:
        good = good & (F.col(c) == F.col(f"_{c}"))
    joined = expected.join(a, ["file_id", "slice_index"], "left")
    return joined.select("set_id", "file_id", "slice_index", F.coalesce(good, F.lit(False)).alias("valid"))


def file_status(manifest: DataFrame, present: DataFrame, slices: DataFrame) -> DataFrame:
    """The ladder, first match wins: missing, empty, truncated, damaged by length, complete by digest, damaged.

    manifest and present: file_manifest frames; slices: verify_slices. missing_slices counts bad ones,
    which is 0 for a file whose digest fails though no slice does.
    """
    p = present.select("file_id", F.col("length").alias("_length"), F.col("md5_16k").alias("_quick"), F.col("md5_full").alias("_full"))
    bad = slices.groupBy("file_id").agg(F.count_if(~F.col("valid")).alias("bad"))
    j = manifest.join(p, "file_id", "left").join(bad, "file_id", "left")
    bad_n = F.coalesce("bad", F.lit(0))
    status = (
        F.when(F.col("_length").isNull(), "missing")
        .when((F.col("length") == 0) & (F.col("_length") == 0), "complete")
        .when(F.col("_length") == 0, "damaged")
        .when(F.col("_length") != F.col("length"), "damaged")
        .when((F.col("_quick") == F.col("md5_16k")) & (F.col("_full") == F.col("md5_full")), "complete")
        .otherwise("damaged")
    )
    lost = F.when(F.col("_length").isNull() | ((F.col("_length") == 0) & (F.col("length") > 0)), F.col("n_slices")).when(F.col("_status") == "complete", 0).otherwise(bad_n)
    j = j.withColumn("_status", status)
    return j.select("set_id", "file_id", F.col("_status").alias("status"), "n_slices", lost.cast("long").alias("missing_slices"))


def repairable(missing: Column, available: Column) -> Column:
    return F.when(missing == 0, "not_needed").when(missing <= available, "repairable").otherwise("insufficient")


def set_status(files: DataFrame, recovery: Column) -> DataFrame:
    """By set: counts of files by status, missing slices, and repairability with `recovery` slices (of n_slices)."""
    g = files.groupBy("set_id").agg(
        F.count("*").alias("n_files"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("complete", "damaged", "missing")),
        F.sum("n_slices").cast("long").alias("n_slices"),
        F.sum("missing_slices").cast("long").alias("missing_slices"),
    )
    g = g.withColumn("recovery_slices", recovery.cast("long"))
    return g.withColumn("repairability", repairable(F.col("missing_slices"), F.col("recovery_slices"))).withColumn("deficit", F.greatest(F.col("missing_slices") - F.col("recovery_slices"), F.lit(0))).withColumn("needs_repair", (F.col("missing_slices") > 0) | (F.col("n_complete") < F.col("n_files")))


def merge(base: DataFrame, updated: DataFrame, key: str = "file_id") -> DataFrame:
    """base with the rows of updated laid over it; ids that only updated has are dropped."""
    rest = [c for c in base.columns if c != key]
    u = updated.select(key, F.struct(*rest).alias("_new"))
    return base.join(u, key, "left").select(key, *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in rest))
