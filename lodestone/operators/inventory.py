"""Sets of files as a whole: presence, relations, plans, and findings of what differs from lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def presence(volumes: DataFrame, key: str, volume: str, last: Column, first: int = 0) -> DataFrame:
    """By key: the volumes there, whether the last one was seen, and how many there are in all if so."""
    g = volumes.groupBy(key).agg(F.array_sort(F.collect_set(volume)).alias("present"), F.bool_or(last).alias("last_seen"), F.max(volume).alias("_max"))
    return g.select(key, "present", "last_seen", F.when(F.col("last_seen"), F.col("_max") - first + 1).cast("long").alias("expected"))


def members(segments: DataFrame, key: str, volume: str, first: int = 0) -> DataFrame:
    """Members with their number of segments; those that are one continuation alone are dropped."""
    g = segments.groupBy(key).agg(F.count("*").alias("n_segments"), F.min(volume).alias("_first"))
    g = g.withColumn("split_before", F.col("_first") > first)
    return g.where(~F.col("split_before") | (F.col("n_segments") > 1)).drop("_first")


def readiness(segments: DataFrame, key: str, volume: str, present: DataFrame) -> DataFrame:
    """By member the volumes it needs that are not there (present: one column, the same name), and whether it is ready."""
    p = present.select(volume).distinct().withColumn("_there", F.lit(True))
    g = segments.join(p, volume, "left").groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("_there").isNull(), F.col(volume)))).alias("waiting_for"))
    return g.withColumn("ready", F.size("waiting_for") == 0)


def selected(profiles: DataFrame, chosen: list[str], files: DataFrame, path: str = "path") -> DataFrame:
    """Files that are in one of the chosen profiles at least, once each. profiles: profile, members (array of paths)."""
    wanted = profiles.where(F.col("profile").isin(chosen)).select(F.explode("members").alias(path)).distinct()
    return files.join(wanted, path)


def related(archives: DataFrame, recovery: DataFrame) -> DataFrame:
    """(set_id, recovery_id) of sets in one folder of which one protects the other: a volume's name is protected, or a
    protected name is of the set's label; a recovery set without such names counts by its own file's name.

    archives: set_id, folder, label, volumes (names); recovery: recovery_id, folder, protected (names), first_name.
    """
    j = archives.join(recovery, "folder")
    by_name = F.exists("protected", lambda n: F.array_contains(F.col("volumes"), n) | names.related_label(F.col("label"), n))
    hit = F.when(F.size("protected") > 0, by_name).otherwise(names.related_label(F.col("label"), F.col("first_name")))
    return j.where(hit).select("set_id", "recovery_id")


def summary(archives: DataFrame, recovery: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, n_volumes, n_recovery_files): archive sets with the files of their recovery sets, then recovery sets of none."""
    n = pairs.join(recovery.select("recovery_id", "n_files"), "recovery_id").groupBy("set_id").agg(F.sum("n_files").alias("n"))
    own = archives.join(n, "set_id", "left").select(F.col("set_id").alias("id"), F.size("volumes").cast("long").alias("n_volumes"), F.coalesce("n", F.lit(0)).cast("long").alias("n_recovery_files"))
    alone = recovery.join(pairs, "recovery_id", "left_anti").select(F.col("recovery_id").alias("id"), F.lit(0).cast("long").alias("n_volumes"), F.col("n_files").cast("long").alias("n_recovery_files"))
    return own.unionByName(alone)


def actions(archives: DataFrame, recovery: DataFrame) -> DataFrame:
    """(stage, id, action): verify recovery sets first, then restore volumes of sets that have recovery ones, then extract.
    archives: set_id, volumes, n_restore; a plan is ordered by stage and id, and has no order of its own."""
    row = lambda df, stage, key, what: df.select(F.lit(stage).alias("stage"), F.col(key).alias("id"), F.lit(what).alias("action"))
    return row(recovery, 0, "recovery_id", "verify_repair").unionByName(row(archives.where("n_restore > 0"), 1, "set_id", "restore_volumes")).unionByName(row(archives.where(F.size("volumes") > 0), 2, "set_id", "extract"))


def first_fault(listed: DataFrame, there: DataFrame, key: str, checks: dict[str, str]) -> DataFrame:
    """(key, fault): the first fault of each listed row: missing, or the first of checks (fault: column) that differs.
    Rows that only `there` has don't count; null in a list's column is not checked."""
    t = there.select(key, F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in checks.values()))
    j = listed.join(t, key, "left")
    fault = F.when(F.col("_there").isNull(), "missing")
    for name, c in checks.items():
        fault = fault.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), name)
    return j.select(key, fault.alias("fault")).where("fault is not null")


def findings(listed: DataFrame, there: DataFrame, key: str, checks: dict[str, str]) -> DataFrame:
    """(key, fault): all faults of each listed row; a missing one has no other."""
    t = there.select(key, F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in checks.values()))
    j = listed.join(t, key, "left")
    each = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), name) for name, c in checks.items())))
    return j.select(key, F.explode(F.when(F.col("_there").isNull(), F.array(F.lit("missing"))).otherwise(each)).alias("fault"))


def dangling(rows: DataFrame, key: list[str], references: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """(key, fault): rows whose reference is to nothing. references: fault: (column, frame, its column); null refers to nothing and is none."""
    out = None
    for fault, (column, target, target_column) in references.items():
        t = target.select(F.col(target_column).alias(column)).distinct()
        lost = rows.where(F.col(column).isNotNull()).join(t, column, "left_anti").select(*key, F.lit(fault).alias("fault"))
        out = lost if out is None else out.unionByName(lost)
    return out


def paths_apart(listed: DataFrame, there: DataFrame, path: str, suffix: str) -> DataFrame:
    """(path, side) of paths that are in one only; hidden names and other suffixes on disk are not looked at."""
    d = there.where(~names.base_name(F.col(path)).startswith(".") & F.col(path).endswith(suffix)).select(path).distinct()
    a = listed.select(path).distinct()
    return a.join(d, path, "left_anti").withColumn("side", F.lit("list")).unionByName(d.join(a, path, "left_anti").withColumn("side", F.lit("disk")))


def comparable(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, comparable): whether all rows of a group agree in the fields, nulls included."""
    h = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.groupBy(group).agg((F.min(h) == F.max(h)).alias("comparable"))


def united(left: Column, right: Column) -> Column:
    """Two lists of paths as one, in order, each once."""
    return F.array_sort(F.array_union(left, right))


def first_with(sets: DataFrame, paths: str, path: Column, order: str) -> DataFrame:
    """The first set, in order, that has a path."""
    return sets.where(F.array_contains(F.col(paths), path)).orderBy(order).limit(1)
