"""Written tables that cut lineage: they live in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
SLOTS = 1 << 25
_ROOTS: dict[str, SparkSession] = {}
_TABLES: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder; where none is set (tests, local mode) a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    if not _ROOTS:
        atexit.register(_clean)
    _ROOTS[path] = spark
    return path


def bucketed(df: DataFrame, name: str, buckets: int, by: str, append: bool = False) -> DataFrame:
    """Writes df as a bucketed table of the session's catalog whose files lie in the shared folder, not in the warehouse."""
    spark = df.sparkSession
    path = _TABLES.setdefault(name, folder(spark, name))
    _ROOTS[f"table:{name}"] = spark
    df.write.mode("append" if append else "errorifexists").bucketBy(buckets, by).option("compression", "uncompressed").option("path", path).saveAsTable(name)
    return spark.table(name)


def table(prefix: str) -> str:
    """A new name for a bucketed table; dropped, files and all, when the driver ends."""
    return f"{prefix}_{uuid.uuid4().hex}"


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _ROOTS.pop(f"table:{name}", None)
    if name in _TABLES:
        remove(spark, _TABLES.pop(name))


def session(df: DataFrame) -> SparkSession:
    """The session of a frame, its Arrow batches bounded to BATCH_BYTES: long texts make them large, and each task
    of an executor holds some at a time, outside the heap."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    if conf.arrowMaxBytesPerBatch() > BATCH_BYTES or conf.arrowMaxBytesPerBatch() <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def col(name: str):
    """The column of this very name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def flagged(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with a boolean column: false where the key is surely none of keys'. By a bitmap of SLOTS bits: a table of
    SLOTS / 64 rows at most, whatever the input, is all that is broadcast. It only spares what need not move to the join
    after it; with more than some ten million keys it flags most rows, and all are moved once."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    bitmap = keys.select(F.shiftright(slot, 6).alias("_word"), slot.alias("_slot")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, cast(_slot % 64 as int)))").alias("_bits"))
    asked = rows.withColumn("_at", slot).join(F.broadcast(bitmap), F.shiftright("_at", 6) == F.col("_word"), "left")
    hit = F.coalesce(F.expr("(_bits & shiftleft(1L, cast(_at % 64 as int))) <> 0"), F.lit(False))
    return asked.select(*rows.columns, hit.alias(flag))


def write(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes the folders of written frames, and of what is read from them nothing may be asked after that."""
    for df in frames:
        remove(df.sparkSession, df.scratch_path)


def trim() -> None:
    """Gives freed memory of this process back, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Lets the context cleaner drop the shuffle files of steps whose results are written."""
    trim()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _ROOTS.pop(path, None)


def _clean() -> None:
    for path, spark in list(_ROOTS.items()):
        try:
            if spark.sparkContext._jsc is None:
                continue
            if path.startswith("table:"):
                drop_table(spark, path[6:])
            elif path in _ROOTS:
                remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing is left to ask
            return


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame: file sizes for scans. Only to choose partition counts."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size))
