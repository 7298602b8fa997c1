"""Runs of streams over what there is now, with their results as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: under spark.checkpoint.dir, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def settle(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs an update-mode stream to its present end; of each key the row of the last batch."""
    spark = stream.sparkSession
    out = folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/_b={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").drop("_b")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
