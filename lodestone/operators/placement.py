"""Where files are against where they belong, by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matches(wanted: DataFrame, disk: DataFrame) -> DataFrame:
    """Disk files of the same length and digests, the cheap digest first; a disk file takes the least id.

    wanted: file_id, name, length, md5_16k, md5_full; disk: path, length, md5_16k, md5_full.
    """
    w = wanted.select("file_id", F.col("name").alias("correct_name"), "length", "md5_16k", "md5_full")
    j = disk.join(w, ["length", "md5_16k"]).where(disk["md5_full"] == w["md5_full"])
    return j.groupBy("path").agg(F.min(F.struct("file_id", "correct_name")).alias("m")).select("path", "m.file_id", "m.correct_name")


def plan(wanted: DataFrame, disk: DataFrame) -> DataFrame:
    """(file_id, class, current_name, correct_name) for each wanted file.

    exact: it is where it belongs; conflict: several disk files have its content, none at the place;
    swap: two files lie at each other's names; rename: it lies elsewhere; unresolved: it is nowhere.
    """
    m = matches(wanted, disk)
    per = m.groupBy("file_id").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.max(F.col("path") == F.col("correct_name")).alias("home"))
    j = wanted.select("file_id", F.col("name").alias("correct_name")).join(per, "file_id", "left")
    single = j.where((F.col("n") == 1) & ~F.col("home")).select(F.col("path").alias("_p"), F.col("correct_name").alias("_c"))
    j = j.join(single, (j["path"] == single["_c"]) & (j["correct_name"] == single["_p"]), "left")
    kind = F.when(F.col("n").isNull(), "unresolved").when((F.col("n") > 1) & ~F.col("home"), "conflict").when(F.col("home"), "exact").when(F.col("_p").isNotNull(), "swap").otherwise("rename")
    now = F.when(F.col("home"), F.col("correct_name")).when(F.col("n") == 1, F.col("path"))
    return j.select("file_id", kind.alias("class"), now.alias("current_name"), "correct_name")


def rename_suggestions(wanted: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, suggested): disk files whose name is nobody's, by their first 16 KiB alone; ties to the least id."""
    stray = disk.join(wanted.select(F.col("name").alias("path")), "path", "left_anti")
    least = wanted.groupBy("md5_16k").agg(F.min(F.struct("file_id", "name")).alias("w"))
    return stray.join(least, "md5_16k").select("path", F.col("w.name").alias("suggested"))


def split_groups(files: DataFrame) -> DataFrame:
    """(base, n_parts, contiguous) of names base.NNN with two parts at least; contiguous: 1 to n, each once."""
    ext = F.regexp_extract("name", r"\.(\d{3})$", 1)
    p = files.where(F.col("name").rlike(r"\.\d{3}$")).select(F.regexp_replace("name", r"\.\d{3}$", "").alias("base"), ext.cast("long").alias("part"))
    g = p.groupBy("base").agg(F.count("*").alias("n_parts"), F.min("part").alias("low"), F.max("part").alias("high"))
    return g.where("n_parts > 1").select("base", "n_parts", ((F.col("low") == 1) & (F.col("high") == F.col("n_parts"))).alias("contiguous"))


def volume_sets(volumes: DataFrame) -> DataFrame:
    """Volumes by folder and label, ordered by (sort_index, path), index unknown last."""
    order = F.struct(F.col("sort_index").isNull().alias("unknown"), "sort_index", "path")
    return volumes.groupBy("folder", "label").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["path"]).alias("paths"), F.min("sort_index").alias("first_index"))


def present_first(candidates: DataFrame) -> DataFrame:
    """The first folder that has a file: (file_id, folder) of the least rank."""
    w = Window.partitionBy("file_id").orderBy("rank")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "rank")


def canonical(placed: DataFrame) -> DataFrame:
    """By set: whether all its files lie where they belong, and how many don't. placed: set_id, class."""
    return placed.groupBy("set_id").agg(F.bool_and(F.col("class") == "exact").alias("canonical"), F.count_if(F.col("class") != "exact").alias("n_elsewhere"))
