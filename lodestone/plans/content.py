"""Queries of the rolling scan: slices found at any byte of shifted and foreign files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifest, parity, scan, verify
from .queries import _SLICES, PERCENT, SIZE, copy, files, query

#: every 7th file has got some bytes before its own, and no file of another set is looked at
_SHIFTED = "SELECT source AS set_id, doc_id AS file_id, unhex(repeat('A5', CAST(doc_id % 13 + 1 AS INTEGER))) || encode(text) AS b FROM documents WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0"
_HITS = f"""
SELECT w.set_id, w.file_id AS path, w."offset", w."length", w.md5 FROM (
  SELECT set_id, file_id, i AS "offset", CAST({SIZE} AS BIGINT) AS "length", md5(array_slice(b, i + 1, i + {SIZE})) AS md5 FROM ({_SHIFTED}), unnest(range(0, octet_length(b) - {SIZE} + 1)) AS t(i)) w
JOIN (SELECT DISTINCT set_id, md5 FROM ({_SLICES}) WHERE n = {SIZE}) k ON k.set_id = w.set_id AND k.md5 = w.md5
UNION
SELECT f.set_id, f.file_id, octet_length(f.b) - k.n, k.n, k.md5 FROM ({_SHIFTED}) f JOIN (SELECT DISTINCT set_id, n, md5 FROM ({_SLICES}) WHERE n < {SIZE}) k
  ON k.set_id = f.set_id AND k.n <= octet_length(f.b) AND md5(array_slice(f.b, octet_length(f.b) - k.n + 1, octet_length(f.b))) = k.md5"""
_RANKED = f"""
SELECT set_id, path, "offset", file_id, slice_index, rank FROM (SELECT *, row_number() OVER (PARTITION BY set_id, path, "offset" ORDER BY rank, file_id, slice_index) AS k FROM (
  SELECT h.set_id, h.path, h."offset", s.file_id, s.slice_index, CASE WHEN h.path = s.file_id AND s.slice_index * {SIZE} = h."offset" THEN 0 WHEN h.path = s.file_id THEN 1 ELSE 2 END AS rank
  FROM ({_HITS}) h JOIN ({_SLICES}) s ON s.set_id = h.set_id AND s.md5 = h.md5)) WHERE k = 1"""
#: of a set's files those of the damaged copy that keep their place, and the shifted ones
_FOUND = f"SELECT s.file_id, s.slice_index FROM ({_HITS}) h JOIN ({_SLICES}) s ON s.set_id = h.set_id AND s.md5 = h.md5"
_HARVEST = f"""
SELECT s.set_id, count(*) AS n_slices, count(*) FILTER (WHERE NOT (s.file_id % 11 <> 0 AND s.file_id % 7 <> 0)) AS lost_in_place,
  count(*) FILTER (WHERE NOT (s.file_id % 11 <> 0 AND s.file_id % 7 <> 0) AND f.file_id IS NULL) AS missing_slices
FROM ({_SLICES}) s LEFT JOIN (SELECT DISTINCT * FROM ({_FOUND})) f ON f.file_id = s.file_id AND f.slice_index = s.slice_index GROUP BY s.set_id"""


def _known(spark, d):
    return manifest.slice_manifest(files(spark, d), SIZE)


def _shifted(spark, d):
    f = files(spark, d).where("file_id % 7 = 0 and file_id % 11 <> 0")
    front = F.rpad(F.lit(b"\xa5"), (F.col("file_id") % 13 + 1).cast("int"), F.lit(b"\xa5"))
    return f.select("set_id", F.col("file_id").alias("path"), F.concat(front, "data").alias("data"))


def _hits(spark, d):
    return scan.hits(_shifted(spark, d), _known(spark, d), SIZE)


@query(_HITS)
def scan_shifted(spark, d):
    """Places of shifted files that hold slices of their set."""
    return _hits(spark, d)


@query(_RANKED)
def scan_ranked(spark, d):
    """The slice that each place counts as."""
    return scan.ranked(_hits(spark, d), _known(spark, d), SIZE)


@query(f"""SELECT set_id, path, run, min("offset") AS "start", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY set_id, path ORDER BY "offset") AS run FROM (
SELECT *, CASE WHEN lag("offset") OVER (PARTITION BY set_id, path ORDER BY "offset") + {SIZE} = "offset" THEN 0 ELSE 1 END AS new FROM ({_RANKED}))) GROUP BY set_id, path, run""")
def scan_runs(spark, d):
    """Runs of slices that follow each other in a shifted file."""
    chosen = scan.chained(scan.ranked(_hits(spark, d), _known(spark, d), SIZE), SIZE)
    return chosen.groupBy("set_id", "path", "run").agg(F.min("offset").alias("start"), F.count("*").alias("n"))


@query(_HARVEST)
def scan_harvest(spark, d):
    """What sets miss in place, and after the scan."""
    known = _known(spark, d)
    moved = copy(spark, d).where("file_id % 7 <> 0")
    v = verify.verify_slices(known, manifest.slice_manifest(moved, SIZE))
    after = scan.harvested(v, scan.held(_shifted(spark, d), known, SIZE), known)
    return after.groupBy("set_id").agg(F.count("*").alias("n_slices"), F.count_if(~F.col("in_place")).alias("lost_in_place"), F.count_if(~F.col("valid")).alias("missing_slices"))


@query(f"""SELECT *, CASE WHEN missing_slices = 0 THEN 'not_needed' WHEN missing_slices <= recovery_slices THEN 'repairable' ELSE 'insufficient' END AS repairability FROM (
SELECT set_id, missing_slices, greatest(CAST(floor((n_slices*{PERCENT}+50)/100) AS BIGINT), 1) AS recovery_slices FROM ({_HARVEST}))""")
def scan_repairability(spark, d):
    """What a tenth of recovery slices can mend after the scan."""
    h = scan_harvest(spark, d).withColumn("recovery_slices", parity.recovery_count(F.col("n_slices"), PERCENT).cast("long"))
    return h.select("set_id", "missing_slices", "recovery_slices", verify.repairable(F.col("missing_slices"), F.col("recovery_slices")).alias("repairability"))
