"""Objects stored in parts over volumes: offsets, order, gaps, overlaps and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part_offsets(parts: DataFrame, member: str = "member", volume: str = "volume", size: str = "size") -> DataFrame:
    """Offset of each part: the sum of the sizes before it in volume order; null from the first missing volume on.

    One row per (member, volume) is expected. Only a member's parts meet in one task.
    """
    w = Window.partitionBy(member).orderBy(volume)
    gap = F.when(F.coalesce(F.lag(volume).over(w), F.col(volume) - 1) != F.col(volume) - 1, 1).otherwise(0)
    df = parts.withColumn("_gap", gap)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    broken = F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0
    return df.withColumn("logical_offset", F.when(~broken, before).cast("long")).drop("_gap")


def chain_status(parts: DataFrame, member: str = "member", volume: str = "volume") -> DataFrame:
    """By member: parts, repeated volumes, missing ones between first and last, and a status by the first fault."""
    g = parts.groupBy(member, volume).agg(F.count("*").alias("n")).groupBy(member).agg(F.sum("n").cast("long").alias("n_parts"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.min(volume).cast("long").alias("first_volume"), F.max(volume).cast("long").alias("last_volume"), F.count("*").alias("_d"))
    missing = F.col("last_volume") - F.col("first_volume") + 1 - F.col("_d")
    status = F.when(F.col("n_repeated") > 0, "repeated").when(F.col("first_volume") > 1, "no_start").when(missing > 0, "hole").otherwise("whole")
    return g.withColumn("n_missing", missing.cast("long")).withColumn("status", status).drop("_d")


def frontier(present: DataFrame, member: str = "member", volume: str = "volume", first: int = 0) -> DataFrame:
    """The largest n such that all volumes first..n are there; null if the first isn't."""
    w = Window.partitionBy(member).orderBy(volume)
    d = present.select(member, volume).distinct().withColumn("_i", F.row_number().over(w) - 1 + first)
    return d.groupBy(member).agg(F.max(F.when(F.col(volume) == F.col("_i"), F.col(volume))).cast("long").alias("frontier"))


def missing_volumes(present: DataFrame, member: str = "member", volume: str = "volume", first: int = 1) -> DataFrame:
    """Volumes that are not there between first and the last one seen, as an ordered array."""
    g = present.groupBy(member).agg(F.collect_set(F.col(volume).cast("int")).alias("have"), F.max(volume).cast("int").alias("last"))
    return g.select(member, F.array_sort(F.array_except(F.sequence(F.lit(first), F.greatest(F.col("last"), F.lit(first))), F.col("have"))).alias("missing"))


def overlaps(extents: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Extents that start before the largest end so far; empty ones are skipped."""
    w = Window.partitionBy(key).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    return extents.where(F.col(end) > F.col(start)).withColumn("covered_to", F.max(end).over(w)).where(F.col("covered_to") > F.col(start))


def map_range(extents: DataFrame, ranges: DataFrame, key: str, grain: int) -> DataFrame:
    """Range join of requests to extents: (range_id, extent id, start, end of the common part).

    Both sides are cut into buckets of `grain`, which join by equality; a pair counts in the bucket
    where its common part starts. extents: key, extent_id, start, end; ranges: key, range_id, start, end.
    """
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / grain), F.floor((F.col("end") - 1) / grain))))
    e = spread(extents.where("`end` > `start`")).select(key, "extent_id", F.col("start").alias("_s"), F.col("end").alias("_e"), "_b")
    r = spread(ranges.where("`end` > `start`"))
    j = r.join(e, [key, "_b"]).where((F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")))
    low, high = F.greatest("start", "_s"), F.least("end", "_e")
    return j.where(F.floor(low / grain) == F.col("_b")).select(key, "range_id", "extent_id", low.cast("long").alias("start"), high.cast("long").alias("end"))


def coalesce_runs(rows: DataFrame, key: str, start: str, length: str, kind: str) -> DataFrame:
    """Neighbours of one kind that touch, as one run."""
    w = Window.partitionBy(key).orderBy(start)
    new = F.when((F.lag(kind).over(w) == F.col(kind)) & (F.lag(F.col(start) + F.col(length)).over(w) == F.col(start)), 0).otherwise(1)
    d = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, kind, "_run").agg(F.min(start).cast("long").alias("start"), F.sum(length).cast("long").alias("length"), F.count("*").alias("n_pieces")).drop("_run")


def extractable(split_before: Column, split_after: Column, missing: Column) -> Column:
    """A member whose parts are all there and that no volume goes on with."""
    return (F.size(missing) == 0) & ~split_after & ~split_before


def eligibility(encrypted: Column, store: Column, directory: Column, link: Column, missing: Column, size: Column) -> Column:
    """How a member can be read straight from its volumes; the first reason wins."""
    return (
        F.when(directory, "directory").when(link, "link").when(size.isNull(), "unknown_size").when(~store, "compressed").when(encrypted, "encrypted").when(missing > 0, "incomplete").otherwise("direct")
    )
