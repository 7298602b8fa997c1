"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _stars(sym: DataFrame) -> DataFrame:
    """Every directed edge with the least label around its first end; aggregated before it is joined back."""
    least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return sym.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges to (node, comp): comp is the least node reachable. Nodes without edges do not appear.

    Nulls, loops and repeated edges are dropped. Only a checksum reaches the driver.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e = scratch.write(e.distinct(), "edges")
    mark = None
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(sym).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        before, e = e, scratch.write(small, "edges")
        scratch.drop(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
