"""Queries of sets as a whole: inventories, relations, findings, header facts and retained evidence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import names, scalars
from ..operators import evidence, inventory, placement
from ..sources import headers
from .queries import _PARTS, _VERIFIED, _parts, _verified, query, table

# ---------------------------------------------------------------- members and volumes


@query("""SELECT member, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS present, bool_or(closed) AS last_seen, CASE WHEN bool_or(closed) THEN CAST(max(v) AS BIGINT) END AS expected
FROM (SELECT l_orderkey AS member, l_linenumber AS v, bool_or(l_linestatus = 'F') AS closed FROM lineitem GROUP BY ALL) GROUP BY member""")
def volume_presence(spark, d):
    """Volumes there by member, and how many there are where the last one was seen."""
    out = inventory.presence(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_linestatus") == "F", first=1)
    return out.select(F.col("l_orderkey").alias("member"), F.array_join(F.transform("present", lambda v: v.cast("string")), ",").alias("present"), "last_seen", "expected")


@query(f"SELECT member, n_segments, split_before FROM (SELECT member, count(*) AS n_segments, min(volume) > 1 AS split_before FROM ({_PARTS}) WHERE volume <> member % 4 + 1 GROUP BY member) WHERE NOT split_before OR n_segments > 1")
def archive_members(spark, d):
    """Members but those of which one continuation alone is there."""
    return inventory.members(_parts(spark, d).where("volume <> member % 4 + 1"), "member", "volume", first=1)


@query(f"""SELECT member, coalesce(string_agg(CAST(volume AS VARCHAR), ',' ORDER BY volume) FILTER (WHERE volume IN (3, 6)), '') AS waiting_for, count(*) FILTER (WHERE volume IN (3, 6)) = 0 AS ready FROM ({_PARTS}) GROUP BY member""")
def member_readiness(spark, d):
    """Members and the volumes they wait for, with volumes 3 and 6 away."""
    here = spark.range(1, 8).where("id not in (3, 6)").select(F.col("id").cast("int").alias("volume"))
    out = inventory.readiness(_parts(spark, d), "member", "volume", here)
    return out.select("member", F.array_join(F.transform("waiting_for", lambda v: v.cast("string")), ",").alias("waiting_for"), "ready")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#55') ORDER BY 1")
def manifest_select(spark, d):
    """Parts of some brands, by lists of members."""
    p = table(spark, d, "part")
    profiles = p.groupBy(F.col("p_brand").alias("profile")).agg(F.collect_list("p_partkey").alias("members"))
    return inventory.selected(profiles, ["Brand#11", "Brand#23", "Brand#55"], p, "p_partkey").select("p_partkey", "p_name")


# ---------------------------------------------------------------- relations between sets

#: folders of eight names; archive sets at 0, 2 and 4 of each, recovery sets at 1 and 5, which protect what is listed
_ARCHIVES = "SELECT p_partkey AS k, 'f' || p_partkey // 8 AS folder, CASE p_partkey % 8 WHEN 0 THEN 'set' || p_partkey WHEN 2 THEN 'x' || p_partkey ELSE 'z' || p_partkey END AS label, CASE p_partkey % 8 WHEN 0 THEN 'set' || p_partkey || '.part01.rar' WHEN 2 THEN 'x' || p_partkey || '.r07' ELSE 'z' || p_partkey || '.rar' END AS volume FROM part WHERE p_partkey % 8 IN (0, 2, 4)"
_RECOVERY = "SELECT p_partkey AS k, 'f' || p_partkey // 8 AS folder, p_partkey % 8 = 1 AS protects, CASE WHEN p_partkey % 8 = 1 THEN 'set' || (p_partkey - 1) || '.part01.rar' END AS protected, 'z' || (p_partkey - 1) || '.vol0+1.par2' AS first_name, p_size % 3 + 1 AS n_files FROM part WHERE p_partkey % 8 IN (1, 5)"
_RELATED = f"SELECT a.k AS set_id, r.k AS recovery_id FROM ({_ARCHIVES}) a JOIN ({_RECOVERY}) r ON a.folder = r.folder AND CASE WHEN r.protects THEN a.volume = r.protected OR starts_with(r.protected, a.label) ELSE starts_with(r.first_name, a.label) END"


def _archives(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").where("p_partkey % 8 in (0, 2, 4)")
    name = F.when(k % 8 == 0, F.concat(F.lit("set"), k, F.lit(".part01.rar"))).when(k % 8 == 2, F.concat(F.lit("x"), k, F.lit(".r07"))).otherwise(F.concat(F.lit("z"), k, F.lit(".rar")))
    label = F.when(k % 8 == 2, F.concat(F.lit("x"), k)).otherwise(names.set_hint(name))
    return p.select(k.alias("set_id"), F.concat(F.lit("f"), F.floor(k / 8)).alias("folder"), label.alias("label"), F.array(name).alias("volumes"), (k % 3 == 0).cast("int").alias("n_restore"))


def _recovery(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").where("p_partkey % 8 in (1, 5)")
    protected = F.when(k % 8 == 1, F.array(F.concat(F.lit("set"), k - 1, F.lit(".part01.rar")))).otherwise(F.array().cast("array<string>"))
    return p.select(k.alias("recovery_id"), F.concat(F.lit("f"), F.floor(k / 8)).alias("folder"), protected.alias("protected"), F.concat(F.lit("z"), k - 1, F.lit(".vol0+1.par2")).alias("first_name"), (F.col("p_size") % 3 + 1).alias("n_files"))


def _pairs(spark, d):
    return inventory.related(_archives(spark, d), _recovery(spark, d))


@query(_RELATED)
def set_relations(spark, d):
    """Recovery sets and the archives of their folder that they protect."""
    return _pairs(spark, d)


@query(f"""SELECT a.k AS id, 1 AS n_volumes, CAST(coalesce(sum(r.n_files), 0) AS BIGINT) AS n_recovery_files FROM ({_ARCHIVES}) a LEFT JOIN ({_RELATED}) x ON x.set_id = a.k LEFT JOIN ({_RECOVERY}) r ON r.k = x.recovery_id GROUP BY a.k
UNION ALL SELECT k, 0, CAST(n_files AS BIGINT) FROM ({_RECOVERY}) WHERE k NOT IN (SELECT recovery_id FROM ({_RELATED}))""")
def set_summary(spark, d):
    """Archive sets with their recovery files, and recovery sets of none."""
    return inventory.summary(_archives(spark, d), _recovery(spark, d), _pairs(spark, d))


@query(f"""SELECT 0 AS stage, k AS id, 'verify_repair' AS action FROM ({_RECOVERY}) UNION ALL SELECT 1, k, 'restore_volumes' FROM ({_ARCHIVES}) WHERE k % 3 = 0 UNION ALL SELECT 2, k, 'extract' FROM ({_ARCHIVES})""")
def set_actions(spark, d):
    """What is to be done, in stages."""
    return inventory.actions(_archives(spark, d), _recovery(spark, d))


# ---------------------------------------------------------------- findings

#: outputs of parts: some are missing, some of another kind, size or digest, and some are nobody's
_OUT = "SELECT p_partkey AS k, CASE WHEN p_partkey % 23 = 0 THEN 'link' ELSE 'file' END AS kind, p_size + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN p_partkey % 19 = 0 THEN 'x' ELSE p_name END AS content FROM part WHERE p_partkey % 13 <> 0"
_BOTH = f"FROM part LEFT JOIN ({_OUT}) o ON o.k = p_partkey"


def _listed(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit("file").alias("kind"), F.col("p_size").alias("size"), F.col("p_name").alias("content"))


def _outputs(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").where("p_partkey % 13 <> 0")
    out = p.select(k.alias("k"), F.when(k % 23 == 0, "link").otherwise("file").alias("kind"), (F.col("p_size") + F.when(k % 17 == 0, 1).otherwise(0)).alias("size"), F.when(k % 19 == 0, "x").otherwise(F.col("p_name")).alias("content"))
    return out.unionByName(out.withColumn("k", -F.col("k")))


_CHECKS = {"kind": "kind", "size": "size", "digest": "content"}


@query(f"SELECT * FROM (SELECT p_partkey AS k, CASE WHEN o.k IS NULL THEN 'missing' WHEN o.kind <> 'file' THEN 'kind' WHEN o.size <> p_size THEN 'size' WHEN o.content <> p_name THEN 'digest' END AS fault {_BOTH}) WHERE fault IS NOT NULL")
def output_faults(spark, d):
    """The first fault of each expected output; extra ones don't count."""
    return inventory.first_fault(_listed(spark, d), _outputs(spark, d), "k", _CHECKS)


@query(f"""SELECT p_partkey AS k, 'missing' AS fault {_BOTH} WHERE o.k IS NULL UNION ALL SELECT p_partkey, 'kind' {_BOTH} WHERE o.kind <> 'file'
UNION ALL SELECT p_partkey, 'size' {_BOTH} WHERE o.size <> p_size UNION ALL SELECT p_partkey, 'digest' {_BOTH} WHERE o.content <> p_name""")
def tree_findings(spark, d):
    """All faults of a list against a tree."""
    return inventory.findings(_listed(spark, d), _outputs(spark, d), "k", _CHECKS)


@query("""SELECT l_orderkey, l_linenumber, 'no_part' AS fault FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT l_orderkey, l_linenumber, 'no_supplier' FROM lineitem WHERE l_suppkey + 3 NOT IN (SELECT s_suppkey FROM supplier)""")
def dangling_references(spark, d):
    """Rows that refer to nothing, with references moved."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("part"), (F.col("l_suppkey") + 3).alias("supplier"))
    return inventory.dangling(rows, ["l_orderkey", "l_linenumber"], {"no_part": ("part", table(spark, d, "part"), "p_partkey"), "no_supplier": ("supplier", table(spark, d, "supplier"), "s_suppkey")})


@query("""WITH a AS (SELECT 'd/' || p_partkey || '.bin' AS path FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT 'd/' || CASE WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END || p_partkey || CASE WHEN p_partkey % 11 = 0 THEN '.txt' ELSE '.bin' END AS path FROM part),
c AS (SELECT path FROM b WHERE NOT starts_with(path, 'd/.') AND path LIKE '%.bin') SELECT path, 'list' AS side FROM a WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, 'disk' FROM c WHERE path NOT IN (SELECT path FROM a)""")
def paths_apart(spark, d):
    """Paths of a list and of a disk that the other has not."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    disk = p.select(F.concat(F.lit("d/"), F.when(k % 7 == 0, ".").otherwise(""), k.cast("string"), F.when(k % 11 == 0, ".txt").otherwise(".bin")).alias("path"))
    return inventory.paths_apart(p.where("p_partkey % 5 <> 0").select(F.concat(F.lit("d/"), k.cast("string"), F.lit(".bin")).alias("path")), disk, "path", ".bin")


@query("SELECT l_orderkey AS case_id, count(DISTINCT l_linestatus || '|' || l_returnflag) = 1 AS comparable FROM lineitem GROUP BY l_orderkey")
def comparable_groups(spark, d):
    """Groups whose rows agree in two fields."""
    return inventory.comparable(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "case_id"), "case_id", ["l_linestatus", "l_returnflag"])


@query("""SELECT set_id, bool_and(class = 'exact') AS canonical, count(*) FILTER (WHERE class <> 'exact') AS n_elsewhere FROM (SELECT doc_id % 10 AS set_id, doc_id % 50 AS p, CASE WHEN bool_or(n % 10 = doc_id % 10) THEN 'exact' ELSE 'other' END AS class
FROM (SELECT doc_id, doc_id + CASE WHEN doc_id % 10 > 7 AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM documents) GROUP BY ALL) GROUP BY set_id""")
def canonical_sets(spark, d):
    """Sets all of whose files lie where they belong."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select((i % 10).alias("set_id"), (i % 50).alias("p"), F.when(F.pmod(i + F.when((i % 10 > 7) & (i % 3 == 0), 1).otherwise(0), F.lit(10)) == i % 10, "exact").otherwise("other").alias("class"))
    each = rows.groupBy("set_id", "p").agg(F.min("class").alias("class"))
    return placement.canonical(each)


# ---------------------------------------------------------------- numbers and texts


@query("""SELECT p_partkey AS k, length(CAST(n AS VARCHAR)) AS width, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(log2(n)) AS INTEGER) + 1 END AS bits, CAST((n + 15) // 16 * 16 AS DECIMAL(20,0)) AS aligned, CASE WHEN n > 0 AND n % 4 = 0 THEN n END AS block,
n % 65536 AS mode, n % 2 = 1 AS read_only, n // 16 % 2 = 1 AS directory FROM (SELECT p_partkey, p_partkey * p_size - p_partkey AS n FROM part)""")
def scalar_numbers(spark, d):
    n = F.col("n")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * F.col("p_size") - F.col("p_partkey")).cast("long").alias("n"))
    return p.select("k", scalars.decimal_width(n).alias("width"), scalars.bit_length(n).alias("bits"), scalars.align16(n).alias("aligned"), scalars.checked_block_size(n).alias("block"), scalars.unix_mode(n).alias("mode"), scalars.has_attribute(n, scalars.READ_ONLY).alias("read_only"), scalars.has_attribute(n, scalars.DIRECTORY).alias("directory"))


@query("""SELECT o_orderkey AS k, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, CAST(day(t) AS INTEGER) AS day, CAST(hour(t) AS INTEGER) AS hour, CAST(minute(t) AS INTEGER) AS minute, CAST(second(t) AS INTEGER) AS second
FROM (SELECT o_orderkey, make_timestamp(CAST(o_orderkey AS BIGINT) * 86399 * 1000000) AS t FROM orders)""")
def scalar_times(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey").cast("long") * 86399).alias("s"))
    return o.select("k", *scalars.utc_parts(F.col("s")))


@query("""SELECT p_partkey AS k, CASE WHEN length(p_name) <= 12 THEN p_name ELSE left(p_name, 9) || '...' END AS short, 'a' || p_partkey || '.r' || CASE WHEN p_size - 1 < 10 THEN '0' ELSE '' END || (p_size - 1) AS following,
'{"k":' || p_partkey || ',"brand":"' || p_brand || '","none":null}' AS json, CASE p_partkey % 5 WHEN 0 THEN 'x' || p_partkey WHEN 1 THEN 'b/c' WHEN 2 THEN 'dir/f' || p_partkey WHEN 3 THEN '' ELSE 'a..b/c' END AS cleaned,
CAST(p_partkey AS DOUBLE) AS cycles, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS misses FROM part""")
def scalar_texts(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    path = F.when(k % 5 == 0, F.concat(F.lit("C:\\..\\x"), k)).when(k % 5 == 1, "//host/share/./a/../b/c").when(k % 5 == 2, F.concat(F.lit("//h/s/../../dir/f"), k)).when(k % 5 == 3, "a/b/..").otherwise("/./a..b/c")
    perf = F.concat(k.cast("string"), F.lit(",,cycles:u,1,100.00,,\n"), F.when(k % 2 == 0, size.cast("string")).otherwise("<not counted>"), F.lit(",,misses,1,100.00,,\n"))
    p = table(spark, d, "part").withColumn("path", path).withColumn("perf", scalars.perf_counters(perf))
    return p.select(
        k.alias("k"), scalars.truncated(F.col("p_name"), 12).alias("short"), names.old_next_volume(F.concat(F.lit("a"), k, F.lit(".rar")), size).alias("following"),
        scalars.canonical_json(k.alias("k"), F.col("p_brand").alias("brand"), F.lit(None).cast("string").alias("none")).alias("json"), names.after_traversal(F.col("path")).alias("cleaned"),
        scalars.recorded(F.col("perf"), "cycles").alias("cycles"), scalars.recorded(F.col("perf"), "misses").alias("misses"),
    )


# ---------------------------------------------------------------- header facts


def _archive(key, table_):
    order = key[0].as_py()
    rows = sorted(zip(*(table_.column(c).to_pylist() for c in ("line", "part", "size", "crc")), strict=True))
    out = headers.containers.SIGNATURES["archive5"] + headers.record(headers.MAIN, headers.main_fields(order % 5, solid=order % 3 == 0))
    for line, part, size, crc in rows:
        flags = (headers.SPLIT_BEFORE if line == 1 and order % 5 else 0) | (headers.SPLIT_AFTER if line == rows[-1][0] else 0)
        extra = headers.extra_record(headers.EXTRA_ENCRYPTION, b"\0\0\x0f" + bytes(32)) if part % 7 == 0 else b""
        out += headers.record(headers.FILE, headers.file_fields(f"item {part}", None if part % 9 == 0 else size, attributes=line, mtime=size * 1000, crc=crc, method=part % 6, directory=part % 11 == 0), flags, extra, bytes(size))
    out += headers.record(headers.END, headers.number(order % 2))
    return pa.table({"path": [f"v{order}"], "content": pa.array([out], pa.binary())})


def _volumes(spark, d):
    """Archives of an order's lines, written record by record."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").cast("long").alias("part"), F.col("l_quantity").cast("long").alias("size"), F.crc32(F.col("l_returnflag").cast("binary")).alias("crc"))
    return rows.groupBy("l_orderkey").applyInArrow(_archive, "path string, content binary")


_LINES = "SELECT 'v' || l_orderkey AS path, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey AS BIGINT) AS part, CAST(l_quantity AS BIGINT) AS size, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem"


@query(f"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY line, part, size) AS place, 'item ' || part AS name, CASE WHEN part % 9 <> 0 THEN size END AS unpacked_size, size AS data_size, line AS attributes, size * 1000 AS mtime, part % 6 AS method,
part % 11 = 0 AS directory, line = 1 AND o % 5 <> 0 AS split_before, line = last AS split_after, part % 7 = 0 AS encrypted FROM ({_LINES})""")
def member_facts(spark, d):
    """Members as their headers tell them."""
    f = headers.header_facts(_volumes(spark, d)).where("kind = 'file'")
    return f.select("path", "place", "name", "unpacked_size", "data_size", "attributes", "mtime", "method", "directory", "split_before", "split_after", "encrypted")


@query(f"""SELECT path, o % 5 AS volume, true AS is_volume, o % 3 = 0 AS solid, count(*) FILTER (WHERE NOT (line = 1 AND o % 5 <> 0)) AS n_started, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS data_bytes, bool_or(part % 7 = 0) AS encrypted, true AS closed, o % 2 = 1 AS more_volumes FROM ({_LINES}) GROUP BY path, o""")
def volume_facts(spark, d):
    """Volumes as their headers tell them."""
    return headers.volume_facts(headers.header_facts(_volumes(spark, d)))


# ---------------------------------------------------------------- retained evidence

#: three generations: the damaged copy, one in three files mended elsewhere, and one in five of these found bad again
_LOG = f"""SELECT set_id, file_id, slice_index, valid, 0 AS generation, 'old' AS path FROM ({_VERIFIED}) UNION ALL SELECT set_id, file_id, slice_index, true, 1, 'new' || file_id % 2 FROM ({_VERIFIED}) WHERE file_id % 3 = 0
UNION ALL SELECT set_id, file_id, slice_index, false, 2, 'new' || file_id % 2 FROM ({_VERIFIED}) WHERE file_id % 15 = 0"""
_ASSESSED = """SELECT set_id, n_slices, n_good, n_slices - n_good AS missing_slices, recovery_slices, CASE WHEN n_slices = n_good THEN 'not_needed' WHEN n_slices - n_good <= recovery_slices THEN 'repairable' ELSE 'insufficient' END AS repairability FROM (
SELECT s.set_id, count(*) AS n_slices, count(*) FILTER (WHERE coalesce(g.valid, false)) AS n_good, {recovery} AS recovery_slices FROM ({slices}) s
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, slice_index ORDER BY generation DESC) AS k FROM ({log})) WHERE k = 1) g ON g.file_id = s.file_id AND g.slice_index = s.slice_index GROUP BY s.set_id)"""


def _log(spark, d):
    v = _verified(spark, d)
    path = F.concat(F.lit("new"), (F.col("file_id") % 2).cast("string"))
    say = lambda df, valid, generation: df.select("set_id", "file_id", "slice_index", F.lit(valid).alias("valid"), F.lit(generation).alias("generation"), path.alias("path"))
    first = v.select("set_id", "file_id", "slice_index", "valid", F.lit(0).alias("generation"), F.lit("old").alias("path"))
    return first.unionByName(say(v.where("file_id % 3 = 0"), True, 1)).unionByName(say(v.where("file_id % 15 = 0"), False, 2))


def _exponents(spark, d, n: int):
    return table(spark, d, "documents").select(F.col("source").alias("set_id")).distinct().withColumn("exponent", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _manifest(spark, d):
    return _verified(spark, d).select("set_id", "file_id", "slice_index")


@query(_ASSESSED.format(recovery=50, slices=_VERIFIED, log=_LOG))
def session_assess(spark, d):
    """Sets by their last evidence and fifty recovery slices, some of which came twice."""
    r = _exponents(spark, d, 50)
    return evidence.assess(_log(spark, d), _manifest(spark, d), r.unionByName(r.where("exponent < 20")))


@query(_ASSESSED.format(recovery=50, slices=_VERIFIED, log=f"SELECT * FROM ({_LOG}) WHERE NOT (path = 'new1' AND generation <= 1) AND NOT (file_id % 10 = 4 AND generation <= 0)"))
def session_retract(spark, d):
    """The same after one place and some files were withdrawn."""
    paths = spark.createDataFrame([("new1", 0), ("new1", 1)], "path string, generation int")
    files = _manifest(spark, d).where("file_id % 10 = 4").select("file_id", F.lit(0).alias("generation")).distinct()
    return evidence.assess(evidence.standing(_log(spark, d), paths, files), _manifest(spark, d), _exponents(spark, d, 50))


@query("SELECT source AS set_id, 30 AS n_new, 25 AS n_repeated FROM documents GROUP BY source")
def late_recovery(spark, d):
    """Recovery slices that came later: new ones, and those that were there or came twice."""
    more = _exponents(spark, d, 50).where("exponent >= 10")
    return evidence.merged_recovery(_exponents(spark, d, 20), more.unionByName(more.where("exponent < 25")))[1]


@query(f"SELECT set_id, count(*) AS n FROM ({_LOG}) WHERE path = 'new0' GROUP BY set_id")
def carried_evidence(spark, d):
    """Evidence of places that have not changed since."""
    stats = spark.createDataFrame([("old", 10, 1), ("new0", 20, 2), ("new1", 30, 3)], "path string, length long, changed long")
    now = spark.createDataFrame([("old", 10, 9), ("new0", 20, 2), ("new1", 31, 3)], "path string, length long, changed long")
    return evidence.carried(_log(spark, d), stats, now).groupBy("set_id").agg(F.count("*").alias("n"))
