"""A retained assessment of sets: evidence that is added, overtaken and withdrawn, as one fold over a log.

The log has a row for each piece of evidence: set_id, file_id, slice_index, path, valid, generation. Of
a slice the last row counts that stands. Withdrawing a path or a file takes what was said before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import verify


def standing(log: DataFrame, paths: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Evidence that was not withdrawn. paths: path, generation; files: file_id, generation: what is older or as old goes."""
    out = log
    for gone, key in ((paths, "path"), (files, "file_id")):
        if gone is not None:
            last = gone.groupBy(key).agg(F.max("generation").alias("_until"))
            out = out.join(last, key, "left").where(F.col("_until").isNull() | (F.col("generation") > F.col("_until"))).drop("_until")
    return out.select(log.columns)


def latest(log: DataFrame) -> DataFrame:
    """Of each slice the row of the last generation; between rows of one generation a valid one counts, then the least path."""
    order = F.struct("generation", "valid", F.struct(F.lit(0)))
    best = log.groupBy("set_id", "file_id", "slice_index").agg(F.max(order).alias("b"))
    return best.select("set_id", "file_id", "slice_index", F.col("b.generation").alias("generation"), F.col("b.valid").alias("valid"))


def assess(log: DataFrame, slices: DataFrame, recovery: DataFrame) -> DataFrame:
    """By set: slices in all, known good ones, missing ones, distinct recovery exponents, and what they can repair.

    slices: set_id, file_id, slice_index of the manifest; recovery: set_id, exponent, of any number of files, repeated
    ones too. A slice without evidence is missing.
    """
    good = latest(log).where("valid").select("file_id", "slice_index").withColumn("_good", F.lit(True))
    g = slices.join(good, ["file_id", "slice_index"], "left").groupBy("set_id").agg(F.count("*").alias("n_slices"), F.count("_good").alias("n_good"))
    r = recovery.groupBy("set_id").agg(F.count_distinct("exponent").alias("recovery_slices"))
    j = g.join(r, "set_id", "left").withColumn("recovery_slices", F.coalesce("recovery_slices", F.lit(0))).withColumn("missing_slices", F.col("n_slices") - F.col("n_good"))
    return j.select("set_id", "n_slices", "n_good", "missing_slices", "recovery_slices", verify.repairable(F.col("missing_slices"), F.col("recovery_slices")).alias("repairability"))


def merged_recovery(have: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all recovery slices by set and exponent, once each; counts by set of new and repeated ones in what came later)."""
    h = have.select("set_id", "exponent").distinct()
    m = more.groupBy("set_id", "exponent").agg(F.count("*").alias("n"))
    j = m.join(h.withColumn("_had", F.lit(True)), ["set_id", "exponent"], "left")
    fresh = F.col("_had").isNull()
    counts = j.groupBy("set_id").agg(F.count_if(fresh).alias("n_new"), F.sum(F.col("n") - F.when(fresh, 1).otherwise(0)).cast("long").alias("n_repeated"))
    return h.unionByName(m.select("set_id", "exponent")).distinct(), counts


def carried(log: DataFrame, stats: DataFrame, now: DataFrame) -> DataFrame:
    """Evidence of files whose fingerprint is what it was: path, length and time of change. What has changed since says nothing."""
    same = stats.join(now, ["path", "length", "changed"], "left_semi").select("path").distinct()
    return log.join(same, "path", "left_semi").select(log.columns)
