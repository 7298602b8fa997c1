"""Queries over the tables of an input folder, and their equals in DuckDB's SQL.

Roles of the tables: documents are protected files (set: source), lineitem the parts of objects
(member: order key, volume: line number), events repeated measurements (case: event type, role:
user id mod 2), pages name files by their URLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, galois, names
from ..operators import layout, manifest, parity, placement, report, verify

SIZE, PERCENT, REPEATS, SEED = 1024, 10, 1000, "lodestone"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark, d) -> DataFrame:
    return manifest.protected(table(spark, d, "documents"))


def copy(spark, d) -> DataFrame:
    """The damaged copy: every 11th file is lost, every 7th has its first slice overwritten."""
    return manifest.damaged(files(spark, d), F.col("file_id") % 11 == 0, F.col("file_id") % 7 == 0, SIZE)


# ---------------------------------------------------------------- digests and verification

_SLICES = f"""
SELECT source AS set_id, doc_id AS file_id, i AS slice_index, octet_length(b) AS n, md5(b) AS md5 FROM (
  SELECT source, doc_id, i, array_slice(encode(text), i*{SIZE}+1, (i+1)*{SIZE}) AS b
  FROM documents, unnest(range(0, CAST(ceil(octet_length(encode(text))/{SIZE}.0) AS BIGINT))) AS t(i))"""
#: slice 0 of a damaged file is as long as it was, of bytes 0xA5
_ACTUAL = f"""
SELECT set_id, file_id, slice_index, CASE WHEN file_id % 7 = 0 AND slice_index = 0 THEN md5(unhex(repeat('A5', CAST(n AS INTEGER)))) ELSE md5 END AS md5
FROM ({_SLICES}) WHERE file_id % 11 <> 0"""
_VERIFIED = f"""
SELECT e.set_id, e.file_id, e.slice_index, coalesce(e.md5 = a.md5, false) AS valid
FROM ({_SLICES}) e LEFT JOIN ({_ACTUAL}) a USING (file_id, slice_index)"""
_STATUS = f"""
SELECT source AS set_id, doc_id AS file_id,
  CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN n = 0 THEN 'complete' WHEN doc_id % 7 = 0 THEN 'damaged' ELSE 'complete' END AS status,
  slices AS n_slices,
  CASE WHEN doc_id % 11 = 0 THEN slices WHEN n = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS missing_slices
FROM (SELECT source, doc_id, octet_length(encode(text)) AS n, CAST(ceil(octet_length(encode(text))/{SIZE}.0) AS BIGINT) AS slices FROM documents)"""


@query(f"SELECT set_id, file_id, slice_index, CAST(n AS BIGINT) AS length, md5 FROM ({_SLICES})")
def slice_manifest(spark, d):
    """Slices of all files with their md5."""
    return manifest.slice_manifest(files(spark, d), SIZE).drop("crc32")


#: CRC-32 by its table, a byte a step: the register begins and ends inverted
_CRC_TABLE = "SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(0, 256) AS r(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, {n}), lambda k: CAST('0x' || substr({h}, CAST(k * 2 + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"
_BLOCKS = f"""SELECT source AS set_id, doc_id AS file_id, i AS slice_index, octet_length(b) AS n, b || unhex(repeat('00', CAST({SIZE} - octet_length(b) AS INTEGER))) AS p FROM (
  SELECT source, doc_id, i, array_slice(encode(text), i*{SIZE}+1, (i+1)*{SIZE}) AS b FROM documents, unnest(range(0, CAST(ceil(octet_length(encode(text))/{SIZE}.0) AS BIGINT))) AS t(i))"""


@query(f"SELECT set_id, file_id, slice_index, CAST(n AS BIGINT) AS length, md5(p) AS md5, {_CRC.format(n=SIZE, h='h')} AS crc32 FROM (SELECT *, hex(p) AS h FROM ({_BLOCKS})), ({_CRC_TABLE})")
def slice_crc32(spark, d):
    """md5 and crc32 of zero-padded slices."""
    return manifest.slice_manifest(files(spark, d), SIZE, pad=True)


@query(f"SELECT file_id, {_CRC.format(n='n', h='h')} AS crc32, true AS agrees FROM (SELECT doc_id AS file_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) > 0), ({_CRC_TABLE})")
def file_crc32(spark, d):
    """File checksums folded from padded slice checksums, against the direct ones."""
    f = files(spark, d)
    folded = manifest.expected_crc32(manifest.slice_manifest(f, SIZE, pad=True), f, SIZE)
    return folded.join(f.select("file_id", F.crc32("data").alias("direct")), "file_id").select("file_id", "crc32", (F.col("crc32") == F.col("direct")).alias("agrees"))


@query(f"""SELECT source AS set_id, doc_id AS file_id, CAST(octet_length(b) AS BIGINT) AS length, md5(b) AS md5_full, md5(array_slice(b, 1, 16384)) AS md5_16k,
 CAST(ceil(octet_length(b)/{SIZE}.0) AS BIGINT) AS n_slices FROM (SELECT source, doc_id, encode(text) AS b FROM documents)""")
def file_manifest(spark, d):
    """Identity of all files."""
    return manifest.file_manifest(files(spark, d), SIZE)


@query("""SELECT md5_16k, count(*) AS n_files, count(DISTINCT md5_full) AS n_contents, min(doc_id) AS first_file
FROM (SELECT doc_id, md5(encode(text)) AS md5_full, md5(array_slice(encode(text), 1, 16384)) AS md5_16k FROM documents) GROUP BY md5_16k HAVING count(*) > 1""")
def file_quick16k(spark, d):
    """Files that the first 16 KiB don't tell apart."""
    m = manifest.file_manifest(files(spark, d), SIZE)
    return m.groupBy("md5_16k").agg(F.count("*").alias("n_files"), F.count_distinct("md5_full").alias("n_contents"), F.min("file_id").alias("first_file")).where("n_files > 1")


def _verified(spark, d) -> DataFrame:
    expected = manifest.slice_manifest(files(spark, d), SIZE)
    return verify.verify_slices(expected, manifest.slice_manifest(copy(spark, d), SIZE))


@query(_VERIFIED)
def verify_slices(spark, d):
    """Every slice of the manifest against the damaged copy."""
    return _verified(spark, d)


@query(f"""SELECT e.set_id, e.file_id, count(*) AS n_slices, count(*) FILTER (WHERE valid) AS n_valid FROM ({_VERIFIED}) e GROUP BY ALL""")
def verify_slices_from_crcs(spark, d):
    """The same by checksum alone, counted by file."""
    expected = manifest.slice_manifest(files(spark, d), SIZE)
    v = verify.verify_slices(expected, manifest.slice_manifest(copy(spark, d), SIZE), by=("crc32",))
    return v.groupBy("set_id", "file_id").agg(F.count("*").alias("n_slices"), F.count_if("valid").alias("n_valid"))


def _status(spark, d) -> DataFrame:
    return verify.file_status(manifest.file_manifest(files(spark, d), SIZE), manifest.file_manifest(copy(spark, d), SIZE), _verified(spark, d))


@query(_STATUS)
def verify_files(spark, d):
    """Status of every file by the ladder."""
    return _status(spark, d)


_SET = f"""
SELECT *, CASE WHEN missing_slices = 0 THEN 'not_needed' WHEN missing_slices <= recovery_slices THEN 'repairable' ELSE 'insufficient' END AS repairability,
  greatest(missing_slices - recovery_slices, 0) AS deficit, missing_slices > 0 OR n_complete < n_files AS needs_repair FROM (
SELECT set_id, count(*) AS n_files, count(*) FILTER (WHERE status='complete') AS n_complete, count(*) FILTER (WHERE status='damaged') AS n_damaged,
  count(*) FILTER (WHERE status='missing') AS n_missing, CAST(sum(n_slices) AS BIGINT) AS n_slices, CAST(sum(missing_slices) AS BIGINT) AS missing_slices,
  CASE WHEN sum(n_slices) = 0 THEN 0 ELSE greatest(CAST(floor((sum(n_slices)*{PERCENT}+50)/100) AS BIGINT), 1) END AS recovery_slices FROM ({_STATUS}) GROUP BY set_id)"""


@query(_SET)
def verify_set(spark, d):
    """Repairability of every set with a tenth of recovery slices."""
    return verify.set_status(_status(spark, d), parity.recovery_count(F.col("n_slices"), PERCENT))


@query(f"""SELECT file_id, set_id, CASE WHEN status='damaged' THEN 'complete' ELSE status END AS status, n_slices,
  CASE WHEN status='damaged' THEN 0 ELSE missing_slices END AS missing_slices FROM ({_STATUS})""")
def merge_verification(spark, d):
    """The verdicts with those of mended files laid over them."""
    base = _status(spark, d)
    mended = base.where("status = 'damaged'").withColumn("status", F.lit("complete")).withColumn("missing_slices", F.lit(0).cast("long"))
    return verify.merge(base, mended)


# ---------------------------------------------------------------- measurements

_RUNS = """SELECT event_type AS c, CAST(user_id % 2 AS INTEGER) AS role, CAST(round(value*1000) AS BIGINT) AS wall, props,
  row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY event_id) - 1 AS run FROM events"""
_Q = "CAST(round(quantile_cont({v}, {p})) AS BIGINT)"
_SUMMARY = f"""SELECT c AS case_id, role, count(wall) AS n, {_Q.format(v='wall', p=0.5)} AS median_nanos, min(wall) AS min_nanos, max(wall) AS max_nanos,
  {_Q.format(v='wall', p=0.75)} - {_Q.format(v='wall', p=0.25)} AS iqr_nanos FROM ({_RUNS}) WHERE run > 0 GROUP BY c, role"""
_COMPARE = f"""SELECT case_id, reference_nanos, candidate_nanos, round(reference_nanos / candidate_nanos, 6) AS ratio FROM (
  SELECT case_id, max(CASE WHEN role=0 THEN median_nanos END) AS reference_nanos, max(CASE WHEN role=1 THEN median_nanos END) AS candidate_nanos FROM ({_SUMMARY}) GROUP BY case_id)
  WHERE reference_nanos IS NOT NULL AND candidate_nanos > 0"""


def _measured(spark, d, warm: bool = False) -> DataFrame:
    """Runs numbered by role and case; the first of each is a warm-up."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    w = Window.partitionBy("event_type", F.col("user_id") % 2).orderBy("event_id")
    m = e.select(F.col("event_type").alias("case_id"), (F.col("user_id") % 2).cast("int").alias("role"), F.round(F.col("value") * 1000).cast("long").alias("wall"), "props", (F.row_number().over(w) - 1).alias("run"))
    return m if warm else m.where("run > 0")


def _compared(spark, d) -> DataFrame:
    c = report.compare(report.summary(_measured(spark, d), ["case_id", "role"], "wall"), "case_id", "role", 0, 1)
    return c.withColumn("ratio", F.round("ratio", 6))


@query(_SUMMARY)
def exec_summary(spark, d):
    return report.summary(_measured(spark, d), ["case_id", "role"], "wall")


@query(_COMPARE)
def exec_compare(spark, d):
    return _compared(spark, d)


@query(f"""SELECT case_id, concat_ws('; ', CASE WHEN a <> {REPEATS} THEN '0: ' || a || ' of {REPEATS} samples' END, CASE WHEN b <> {REPEATS} THEN '1: ' || b || ' of {REPEATS} samples' END) AS reason
FROM (SELECT c AS case_id, count(*) FILTER (WHERE role=0) AS a, count(*) FILTER (WHERE role=1) AS b FROM ({_RUNS}) WHERE run > 0 GROUP BY c) WHERE a <> {REPEATS} OR b <> {REPEATS}""")
def exec_omitted(spark, d):
    return report.omissions(_measured(spark, d), "case_id", "role", [0, 1], REPEATS)


@query("""SELECT r_name AS class, count(*) AS n, round(exp(avg(ln(o_totalprice))), 4) AS geomean FROM orders JOIN customer ON o_custkey=c_custkey
JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE o_totalprice > 0 GROUP BY r_name""")
def class_geomean(spark, d):
    """Geometric means by class, over a chain of joins to labels."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.where("o_totalprice > 0").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy(F.col("r_name").alias("class")).agg(F.count("*").alias("n"), F.round(report.geometric_mean("o_totalprice"), 4).alias("geomean"))


@query(f"SELECT case_id, row_number() OVER (ORDER BY sha256('{SEED}' || chr(0) || case_id)) AS place FROM (SELECT DISTINCT event_type AS case_id FROM events)")
def case_order(spark, d):
    return report.hash_order(table(spark, d, "events").select(F.col("event_type").alias("case_id")).distinct(), SEED, "case_id")


@query("SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) ELSE 'mixed' END AS backend, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'mixed' END AS capability FROM lineitem GROUP BY l_orderkey")
def consistent_backend(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(report.consistent("l_returnflag").alias("backend"), report.consistent("l_linestatus").alias("capability"))


@query(f"""SELECT c AS case_id, CAST(run % 3 AS INTEGER) AS phase, count(v) AS n_samples, count(*) - count(v) AS n_missing, {_Q.format(v='v', p=0.5)} AS median_nanos
FROM (SELECT c, run, CASE WHEN wall % 5 = 0 THEN NULL ELSE wall END AS v FROM ({_RUNS}) WHERE run > 0) GROUP BY ALL""")
def phase_summary(spark, d):
    """Phases whose samples may be missing."""
    m = _measured(spark, d).withColumn("v", F.when(F.col("wall") % 5 != 0, F.col("wall"))).withColumn("phase", (F.col("run") % 3).cast("int"))
    return m.groupBy("case_id", "phase").agg(F.count("v").alias("n_samples"), (F.count("*") - F.count("v")).alias("n_missing"), report.quantile("v", 0.5).alias("median_nanos"))


@query(f"SELECT case_id, ratio, row_number() OVER (ORDER BY ratio DESC, case_id) AS place FROM ({_COMPARE})")
def speed_rank(spark, d):
    from pyspark.sql import Window

    return _compared(spark, d).select("case_id", "ratio", F.row_number().over(Window.orderBy(F.desc("ratio"), "case_id")).cast("long").alias("place"))


@query(f"SELECT case_id, round(log2(least(greatest(ratio, 0.125), 8.0)), 6) AS log_ratio, CASE WHEN ratio >= 1 THEN 'faster' ELSE 'slower' END AS bar FROM ({_COMPARE})")
def ratio_bucket(spark, d):
    return _compared(spark, d).select("case_id", F.round(report.ratio_bucket("ratio"), 6).alias("log_ratio"), report.bar_class(F.col("ratio"), F.lit("cpu")).alias("bar"))


@query(f"SELECT c AS case_id, role, count(*) AS n_warm, min(wall) AS wall FROM ({_RUNS}) WHERE run = 0 GROUP BY ALL")
def exec_warmups(spark, d):
    return _measured(spark, d, warm=True).where("run = 0").groupBy("case_id", "role").agg(F.count("*").alias("n_warm"), F.min("wall").alias("wall"))


@query(f"""SELECT c AS case_id, CAST(sum(wall) AS BIGINT) AS total_nanos, bool_and(wall > 0) AS ok, count(*) FILTER (WHERE run % 2 = 1) AS n_reference_first FROM ({_RUNS}) GROUP BY c""")
def exec_rollup(spark, d):
    """Totals, an all-good flag, and the runs in which the reference goes first."""
    m = _measured(spark, d, warm=True)
    return m.groupBy("case_id").agg(F.sum("wall").cast("long").alias("total_nanos"), F.bool_and(F.col("wall") > 0).alias("ok"), F.count_if(F.col("run") % 2 == 1).alias("n_reference_first"))


# ---------------------------------------------------------------- placement

#: where a file lies: ids 3 and 4 of each five are at each other's names, those divisible by 13 elsewhere, by 17 nowhere
_PATH = "CASE WHEN {i} % 13 = 0 THEN 'moved_' || {i} WHEN {i} % 5 = 3 AND ({i} + 1) % 13 <> 0 AND ({i} + 1) % 17 <> 0 THEN 'doc_' || ({i} + 1) WHEN {i} % 5 = 4 AND ({i} - 1) % 13 <> 0 AND ({i} - 1) % 17 <> 0 THEN 'doc_' || ({i} - 1) ELSE 'doc_' || {i} END"
_DISK = f"SELECT {_PATH.format(i='doc_id')} AS path, md5(encode(text)) AS m FROM documents WHERE doc_id % 17 <> 0"
_PLAN = f"""
WITH w AS (SELECT doc_id AS file_id, 'doc_' || doc_id AS correct_name, md5(encode(text)) AS m FROM documents),
k AS (SELECT path, min(file_id) AS file_id FROM ({_DISK}) d JOIN w USING (m) GROUP BY path),
p AS (SELECT k.file_id, count(*) AS n, min(path) AS path, bool_or(path = correct_name) AS home FROM k JOIN w USING (file_id) GROUP BY k.file_id),
j AS (SELECT w.file_id, w.correct_name, n, path, home FROM w LEFT JOIN p USING (file_id)),
s AS (SELECT path AS sp, correct_name AS sc FROM j WHERE n = 1 AND NOT home)
SELECT file_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 AND NOT home THEN 'conflict' WHEN home THEN 'exact' WHEN sp IS NOT NULL THEN 'swap' ELSE 'rename' END AS class,
  CASE WHEN home THEN correct_name WHEN n = 1 THEN path END AS current_name, correct_name
FROM j LEFT JOIN s ON j.path = s.sc AND j.correct_name = s.sp"""


def _wanted(spark, d) -> DataFrame:
    f = manifest.file_manifest(files(spark, d), SIZE)
    return f.select("file_id", F.concat(F.lit("doc_"), F.col("file_id").cast("string")).alias("name"), "length", "md5_16k", "md5_full")


def _disk(spark, d) -> DataFrame:
    path = F.expr(_PATH.format(i="file_id"))
    return manifest.file_manifest(files(spark, d).where("file_id % 17 <> 0"), SIZE).select(path.alias("path"), "length", "md5_16k", "md5_full")


def _placement(kind: str):
    def run(spark, d):
        return placement.plan(_wanted(spark, d), _disk(spark, d)).where(F.col("class") == kind)

    run.__name__ = f"placement_{kind}"
    return query(f"SELECT * FROM ({_PLAN}) WHERE class = '{kind}'")(run)


for _kind in ("exact", "swap", "rename", "conflict", "unresolved"):
    _placement(_kind)


@query(f"""SELECT path, min_by('doc_' || doc_id, doc_id) AS suggested FROM (SELECT {_PATH.format(i='doc_id')} AS path, md5(array_slice(encode(text), 1, 16384)) AS q FROM documents WHERE doc_id % 17 <> 0) d
JOIN (SELECT doc_id, md5(array_slice(encode(text), 1, 16384)) AS q FROM documents) w USING (q) WHERE path NOT IN (SELECT 'doc_' || doc_id FROM documents) GROUP BY path""")
def rename_suggestions(spark, d):
    return placement.rename_suggestions(_wanted(spark, d), _disk(spark, d))


@query("""SELECT base, count(*) AS n_parts, min(part) = 1 AND max(part) = count(*) AS contiguous FROM (SELECT 'order_' || l_orderkey AS base, l_linenumber AS part FROM lineitem) GROUP BY base HAVING count(*) > 1""")
def split_groups(spark, d):
    n = table(spark, d, "lineitem").select(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit("."), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")).alias("name"))
    return placement.split_groups(n)


# ---------------------------------------------------------------- names

#: names made of part keys, with the extensions of sets
_NAME = "CASE {i} % 8 WHEN 0 THEN 'a b' || {i} || '.part01.rar' WHEN 1 THEN 's' || {i} || '.vol3+4.par2' WHEN 2 THEN 'x' || {i} || '.r07' WHEN 3 THEN 'y' || {i} || '.s00' WHEN 4 THEN 'z' || {i} || '.rar' WHEN 5 THEN 'q' || {i} || '.par2' WHEN 6 THEN 'w' || {i} || '.004' ELSE 'v' || {i} || '.txt' END"
_NAMED = f"SELECT p_partkey AS k, {_NAME.format(i='p_partkey')} AS name FROM part"


def _names(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr(_NAME.format(i="p_partkey")).alias("name"))


@query(f"""SELECT k, name, CASE WHEN instr(name, '.part') > 1 THEN substr(name, 1, instr(name, '.part') - 1) WHEN instr(name, '.vol') > 1 THEN substr(name, 1, instr(name, '.vol') - 1)
WHEN instr(name, '.par2') > 1 THEN substr(name, 1, instr(name, '.par2') - 1) WHEN instr(name, '.rev') > 1 THEN substr(name, 1, instr(name, '.rev') - 1)
WHEN instr(name, '.rar') > 1 THEN substr(name, 1, instr(name, '.rar') - 1) ELSE name END AS hint, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS label FROM ({_NAMED})""")
def set_hint(spark, d):
    return _names(spark, d).select("k", "name", names.set_hint(F.col("name")).alias("hint"), names.safe_label(F.col("name")).alias("label"))


@query(f"""SELECT k, name, CASE k % 8 WHEN 0 THEN 0 WHEN 2 THEN 8 WHEN 3 THEN 101 WHEN 4 THEN 0 WHEN 6 THEN 3 END::BIGINT AS volume, CASE WHEN k % 8 = 0 THEN 1 END::BIGINT AS part,
CASE k % 8 WHEN 0 THEN replace(name, '.part01.', '.part02.') END AS following FROM ({_NAMED})""")
def volume_index(spark, d):
    n = F.col("name")
    return _names(spark, d).select("k", "name", names.old_volume_index(n).alias("volume"), names.part_number(n).alias("part"), names.next_volume(n).alias("following"))


@query(f"SELECT k, name, name LIKE '%.par2' AS parity, regexp_matches(name, '^.[0-9]+\\.r..$') AS volume, regexp_replace(regexp_replace(name, '\\.par2$', ''), '\\.vol[0-9]+\\+[0-9]+$', '') AS base FROM ({_NAMED}) WHERE NOT name LIKE '%.txt'")
def glob_filter(spark, d):
    n = F.col("name")
    out = _names(spark, d).where(~names.glob(n, "*.TXT", ignore_case=True))
    return out.select("k", "name", n.rlike(names.first_fit_regex("*.par2")).alias("parity"), (names.glob(n, "?*.r??", paths=True) & n.rlike(r"^.\d")).alias("volume"), names.recovery_base(n).alias("base"))


@query("""SELECT page_id, parse AS path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS parse FROM pages)
WHERE (parse LIKE 'en/%' OR parse LIKE 'fr/%') AND NOT parse LIKE '%.html'""")
def profile_resolve(spark, d):
    """Paths that some pattern includes and none excludes."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    x = F.col("path")
    return p.where((names.glob(x, "en/**", paths=True) | names.glob(x, "fr/**", paths=True)) & ~names.glob(x, "**.html", paths=True))


_HOSTS = "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) AS label FROM pages"


@query(f"SELECT DISTINCT a.host, a.label, b.label AS related FROM ({_HOSTS}) a JOIN ({_HOSTS}) b ON a.host = b.host WHERE a.label <> b.label AND (starts_with(b.label, substr(a.label, 1, 1)) OR length(a.label) = length(b.label))")
def related_sets(spark, d):
    """Sets in one folder whose labels are related: theta join after an equality on the folder."""
    h = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)", 1).alias("label")).distinct()
    b = h.withColumnRenamed("label", "related")
    return h.join(b, "host").where((F.col("label") != F.col("related")) & (F.startswith("related", F.substring("label", 1, 1)) | (F.length("label") == F.length("related"))))


@query(f"SELECT host, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(DISTINCT label) AS n FROM ({_HOSTS}) GROUP BY host")
def cleanup_union(spark, d):
    """Distinct union of names by folder, in order."""
    h = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)", 1).alias("label"))
    return h.groupBy("host").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.count_distinct("label").alias("n"))


# ---------------------------------------------------------------- layout

_PARTS = "SELECT l_orderkey AS member, l_linenumber AS volume, CAST(max(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY ALL"


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("member"), F.col("l_linenumber").alias("volume")).agg(F.max("l_quantity").cast("long").alias("size"))


@query(f"""SELECT member, volume, size, CASE WHEN broken = 0 THEN coalesce(before, 0) END::BIGINT AS logical_offset FROM (SELECT *, sum(gap) OVER (PARTITION BY member ORDER BY volume) AS broken FROM (
SELECT *, sum(size) OVER (PARTITION BY member ORDER BY volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, CASE WHEN lag(volume, 1, volume - 1) OVER (PARTITION BY member ORDER BY volume) <> volume - 1 THEN 1 ELSE 0 END AS gap FROM ({_PARTS})))""")
def part_offsets(spark, d):
    return layout.part_offsets(_parts(spark, d))


@query("""SELECT *, CASE WHEN n_repeated > 0 THEN 'repeated' WHEN first_volume > 1 THEN 'no_start' WHEN n_missing > 0 THEN 'hole' ELSE 'whole' END AS status FROM (
SELECT member, CAST(sum(n) AS BIGINT) AS n_parts, count(*) FILTER (WHERE n > 1) AS n_repeated, CAST(min(volume) AS BIGINT) AS first_volume, CAST(max(volume) AS BIGINT) AS last_volume, CAST(max(volume) - min(volume) + 1 - count(*) AS BIGINT) AS n_missing
FROM (SELECT l_orderkey AS member, l_linenumber AS volume, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY member)""")
def chain_status(spark, d):
    return layout.chain_status(table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "member", "l_linenumber": "volume"}))


@query(f"SELECT member, CAST(max(CASE WHEN volume = i THEN volume END) AS BIGINT) AS frontier FROM (SELECT member, volume, row_number() OVER (PARTITION BY member ORDER BY volume) AS i FROM ({_PARTS})) GROUP BY member")
def header_frontier(spark, d):
    return layout.frontier(_parts(spark, d), first=1)


_EXTENTS = "SELECT l_suppkey AS store, l_orderkey * 8 + l_linenumber AS extent_id, min(l_orderkey) AS \"start\", min(l_orderkey) + CAST(max(l_quantity) AS BIGINT) AS \"end\" FROM lineitem GROUP BY ALL"


def _extents(spark, d) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("store"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("extent_id"))
    return g.agg(F.min("l_orderkey").alias("start"), (F.min("l_orderkey") + F.max("l_quantity").cast("long")).alias("end"))


@query(f"""SELECT * FROM (SELECT *, max("end") OVER (PARTITION BY store ORDER BY "start", extent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_to FROM ({_EXTENTS}) WHERE "end" > "start") WHERE covered_to > "start\"""")
def extent_overlap(spark, d):
    return layout.overlaps(_extents(spark, d), "store", "start", "end", "extent_id")


@query(f"""SELECT e.store, s_nationkey AS range_id, extent_id, greatest(e."start", r.a) AS "start", least(e."end", r.b) AS "end" FROM ({_EXTENTS}) e
JOIN (SELECT s_suppkey AS store, s_nationkey, s_suppkey * 10 AS a, s_suppkey * 10 + 500 AS b FROM supplier) r ON e.store = r.store AND e."start" < r.b AND r.a < e."end" """)
def range_map(spark, d):
    """Requested ranges to extents: an interval join by buckets."""
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("store"), F.col("s_nationkey").alias("range_id"), (F.col("s_suppkey") * 10).alias("start"), (F.col("s_suppkey") * 10 + 500).alias("end"))
    return layout.map_range(_extents(spark, d), r, "store", 128)


_TOUCH = f"SELECT member, volume AS \"start\", 1 AS \"length\", CASE WHEN size >= 25 THEN 'copy' ELSE 'fill' END AS kind FROM ({_PARTS})"


@query(f"""SELECT member, kind, CAST(min("start") AS BIGINT) AS "start", CAST(sum("length") AS BIGINT) AS "length", count(*) AS n_pieces FROM (SELECT *, sum(n) OVER (PARTITION BY member ORDER BY "start") AS run FROM (
SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY member ORDER BY "start") = kind AND lag("start" + "length") OVER (PARTITION BY member ORDER BY "start") = "start" THEN 0 ELSE 1 END AS n FROM ({_TOUCH}))) GROUP BY member, kind, run""")
def coalesce_runs(spark, d):
    p = _parts(spark, d).select("member", F.col("volume").alias("start"), F.lit(1).alias("length"), F.when(F.col("size") >= 25, "copy").otherwise("fill").alias("kind"))
    return layout.coalesce_runs(p, "member", "start", "length", "kind")


@query(f"""SELECT m.member, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (WHERE p.volume IS NULL), '') AS missing FROM (SELECT member, max(volume) AS last FROM ({_PARTS}) GROUP BY member) m, unnest(range(1, m.last + 1)) AS t(i)
LEFT JOIN ({_PARTS}) p ON p.member = m.member AND p.volume = i GROUP BY m.member""")
def missing_volumes(spark, d):
    return layout.missing_volumes(_parts(spark, d)).select("member", F.array_join(F.transform("missing", lambda v: v.cast("string")), ",").alias("missing"))


@query("""SELECT o_orderkey AS member, o_orderdate AS d, CASE WHEN o_orderpriority = '1-URGENT' THEN 'directory' WHEN o_orderstatus = 'P' THEN 'link' WHEN o_totalprice < 1000 THEN 'unknown_size' WHEN o_custkey % 3 = 0 THEN 'compressed' WHEN o_custkey % 5 = 0 THEN 'encrypted' WHEN coalesce(n, 0) > 0 THEN 'incomplete' ELSE 'direct' END AS route
FROM orders LEFT JOIN (SELECT member, max(volume) - min(volume) + 1 - count(*) AS n FROM (SELECT DISTINCT l_orderkey AS member, l_linenumber AS volume FROM lineitem) GROUP BY member) ON member = o_orderkey""")
def eligibility(spark, d):
    o, c = table(spark, d, "orders"), layout.chain_status(_parts(spark, d)).select(F.col("member").alias("m"), "n_missing")
    j = o.join(c, o["o_orderkey"] == c["m"], "left")
    size = F.when(F.col("o_totalprice") >= 1000, F.col("o_totalprice"))
    route = layout.eligibility(F.col("o_custkey") % 5 == 0, F.col("o_custkey") % 3 != 0, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P", F.coalesce("n_missing", F.lit(0)), size)
    return j.select(F.col("o_orderkey").alias("member"), F.col("o_orderdate").alias("d"), route.alias("route"))


@query(f"""SELECT m.member, first_part > 1 AS split_before, last_part < 4 AS split_after, first_part = 1 AND last_part >= 4 AND n = last_part AS extractable FROM (SELECT member, min(volume) AS first_part, max(volume) AS last_part, count(*) AS n FROM ({_PARTS}) GROUP BY member) m""")
def extractable(spark, d):
    """Members whose chain starts at 1, ends at 4 or later and has no hole."""
    p = _parts(spark, d)
    g = p.groupBy("member").agg(F.min("volume").alias("a"), F.max("volume").alias("b")).join(layout.missing_volumes(p), "member")
    return g.select("member", (F.col("a") > 1).alias("split_before"), (F.col("b") < 4).alias("split_after"), layout.extractable(F.col("a") > 1, F.col("b") < 4, F.col("missing")).alias("extractable"))


@query("SELECT l_orderkey AS member, count(*) AS n, min(l_linenumber) AS first_volume, max(l_linenumber) AS last_volume, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def member_listing(spark, d):
    """Members with their spans and sizes."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("member")).agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first_volume"), F.max("l_linenumber").alias("last_volume"), F.sum(F.col("l_quantity").cast("long")).alias("total"))


# ---------------------------------------------------------------- parity


@query("SELECT row_number() OVER (ORDER BY e) - 1 AS \"index\", e AS exponent FROM range(1, 65535) AS t(e) WHERE e % 3 <> 0 AND e % 5 <> 0 AND e % 17 <> 0 AND e % 257 <> 0")
def gf_constants(spark, d):
    return galois.constant_exponents(spark)


@query("""SELECT source AS set_id, CAST(sum(n) AS BIGINT) AS total_bytes, CAST(max(n) AS BIGINT) AS largest, CAST(ceil(greatest(ceil(sum(n)/2000.0), ceil(sum(n)/32768.0), 4)/4)*4 AS BIGINT) AS block_size
FROM (SELECT source, octet_length(encode(text)) AS n FROM documents) WHERE n > 0 GROUP BY source""")
def block_sizing(spark, d):
    f = files(spark, d).select("set_id", F.octet_length("data").cast("long").alias("length"))
    return parity.block_size(f, "set_id", "length")


@query("""SELECT min(b) AS block_size FROM (SELECT b, sum(ceil(n/CAST(b AS DOUBLE))) AS s FROM (SELECT octet_length(encode(text)) AS n FROM documents), range(64, 65537, 64) AS t(b) WHERE n > 0 GROUP BY b) WHERE s <= (SELECT count(*)*2 FROM documents)""")
def smallest_block(spark, d):
    """The least block size (in steps of 64) with two slices a file on average."""
    docs = table(spark, d, "documents")
    lengths = files(spark, d).where(F.octet_length("data") > 0).groupBy(F.octet_length("data").cast("long").alias("n")).agg(F.count("*").alias("c"))
    sizes = spark.range(64, 65537, 64).withColumnRenamed("id", "b")
    total = lengths.crossJoin(F.broadcast(sizes)).groupBy("b").agg(F.sum(F.ceil(F.col("n") / F.col("b")) * F.col("c")).alias("s"))
    most = docs.agg((F.count("*") * 2).alias("most"))
    return total.join(F.broadcast(most), F.col("s") <= F.col("most")).agg(F.min("b").alias("block_size"))


@query("""SELECT volume, CAST(coalesce(sum(c) OVER (ORDER BY volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_exponent, CAST(c AS BIGINT) AS count FROM (SELECT volume, 100 // 7 + CASE WHEN volume < 100 % 7 THEN 1 ELSE 0 END AS c FROM range(0, 7) AS t(volume))""")
def volume_allocation(spark, d):
    return parity.allocate(spark, 100, 7)


@query(f"""SELECT set_id, exponent FROM (SELECT set_id, exponent, row_number() OVER (PARTITION BY set_id ORDER BY exponent) AS place, missing_slices FROM (SELECT set_id, missing_slices, recovery_slices FROM ({_SET})) s, unnest(range(0, recovery_slices)) AS t(exponent)
WHERE exponent % 3 <> 1) WHERE place <= missing_slices""")
def exponent_topk(spark, d):
    """The least usable exponents of each set, as many as slices are missing."""
    from pyspark.sql import Window

    s = verify_set(spark, d).where("recovery_slices > 0").select("set_id", "missing_slices", F.explode(F.sequence(F.lit(0).cast("long"), F.col("recovery_slices") - 1)).alias("exponent"))
    w = Window.partitionBy("set_id").orderBy("exponent")
    return s.where("exponent % 3 <> 1").withColumn("place", F.row_number().over(w)).where("place <= missing_slices").select("set_id", "exponent")


def _parity_slices(spark, d) -> DataFrame:
    """All slices of all files, numbered over files and slices in sets of 200 file ids: as few as coders take."""
    from pyspark.sql import Window

    s = digest.slices(files(spark, d).withColumn("set_id", F.floor(F.col("file_id") / 200)), "data", SIZE)
    return s.withColumn("index", (F.row_number().over(Window.partitionBy("set_id").orderBy("file_id", "slice_index")) - 1).cast("long")).select("set_id", "index", F.col("slice").alias("data"))


@query()
def recovery_encode(spark, d):
    """Eight recovery slices of every set."""
    out = parity.encode(_parity_slices(spark, d), list(range(8)), SIZE)
    return out.select("set_id", "exponent", F.md5("data").alias("md5"))


@query(f"""SELECT set_id, "index", true AS "right" FROM (SELECT doc_id // 200 AS set_id, row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id, i) - 1 AS "index" FROM (
SELECT doc_id, unnest(range(0, CAST(ceil(octet_length(encode(text))/{SIZE}.0) AS BIGINT))) AS i FROM documents)) WHERE "index" IN (1, 4, 7)""")
def repair_roundtrip(spark, d):
    """Slices 1, 4 and 7 of every set are lost and restored; `right` compares them with what was lost."""
    s = _parity_slices(spark, d)
    counts = s.groupBy("set_id").agg(F.count("*").alias("n_inputs"))
    found = parity.repair(s.where(~F.col("index").isin(1, 4, 7)), parity.encode(s, list(range(4)), SIZE), counts, SIZE)
    return found.withColumnRenamed("data", "restored").join(s, ["set_id", "index"]).select("set_id", "index", (F.col("restored") == digest.padded(F.col("data"), SIZE)).alias("right"))


# ---------------------------------------------------------------- events as a stream of evidence


@query(f"""SELECT set_id, file_id, slice_index, valid FROM (SELECT *, row_number() OVER (PARTITION BY file_id, slice_index ORDER BY generation DESC) AS k FROM (
SELECT *, 0 AS generation FROM ({_VERIFIED}) UNION ALL SELECT set_id, file_id, slice_index, true, 1 FROM ({_VERIFIED}) WHERE file_id % 3 = 0)) WHERE k = 1""")
def evidence_generation(spark, d):
    """Verdicts of two generations; of each slice the last one counts."""
    from pyspark.sql import Window

    v = _verified(spark, d)
    both = v.withColumn("generation", F.lit(0)).unionByName(v.where("file_id % 3 = 0").withColumn("valid", F.lit(True)).withColumn("generation", F.lit(1)))
    w = Window.partitionBy("file_id", "slice_index").orderBy(F.desc("generation"))
    return both.withColumn("k", F.row_number().over(w)).where("k = 1").select("set_id", "file_id", "slice_index", "valid")


def _feed(spark, d) -> DataFrame:
    """documents as a stream of overlapping byte ranges; every 7th file has a wrong byte, every 9th comes twice, every 11th is cut short."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    docs = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")  # a pattern may be a file or a folder
    data = digest.content("text")
    data = F.when((F.col("doc_id") % 7 == 0) & (F.octet_length(data) > 0), F.concat(F.lit(b"\xff"), F.substring(data, F.lit(2), F.octet_length(data)))).otherwise(data)
    f = docs.select(F.col("doc_id").alias("file_id"), data.alias("whole")).where(F.octet_length("whole") > 0)
    f = f.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("whole").cast("long") - 1, F.lit(700).cast("long"))))
    f = f.where((F.col("file_id") % 11 != 0) | (F.col("offset") < 700))
    f = f.withColumn("again", F.explode(F.when(F.col("file_id") % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return f.select("file_id", "offset", F.substring(F.col("whole"), (F.col("offset") + 1).cast("int"), F.lit(764)).alias("data"))


def _settled(spark, d) -> DataFrame:
    from ..streaming import run, session

    expected = manifest.slice_manifest(files(spark, d), SIZE).select("file_id", "slice_index", "md5", "length")
    return run.settle(session.verdicts(_feed(spark, d), expected, SIZE), ["file_id", "slice_index"], "verdicts")


#: by the feed's rule every range of a file comes but of each 11th file, of which the first alone does
_SETTLED = f"""SELECT doc_id AS file_id, i AS slice_index, CASE WHEN doc_id % 11 = 0 AND n > 764 THEN 'buffered' ELSE 'verified' END AS disposition, NOT (doc_id % 11 = 0 AND n > 764) AND NOT (doc_id % 7 = 0 AND i = 0) AS valid,
  CAST(CASE WHEN doc_id % 11 = 0 AND n > 764 THEN 764 ELSE 0 END AS BIGINT) AS buffered
FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(range(0, CAST(ceil(octet_length(encode(text))/{SIZE}.0) AS BIGINT))) AS i FROM documents) WHERE doc_id % 11 <> 0 OR i = 0"""


@query(_SETTLED)
def stream_verdicts(spark, d):
    """Slices settled by a stream of ranges."""
    return _settled(spark, d).drop("n_duplicates")


@query(f"""SELECT file_id, n_slices, n_valid, CASE WHEN begun THEN n_bad ELSE n_slices END AS running_missing, n_slices - n_valid AS final_missing, n_valid = n_slices AS complete FROM (
SELECT doc_id AS file_id, any_value(CAST(ceil(octet_length(encode(text))/{SIZE}.0) AS BIGINT)) AS n_slices, count(*) FILTER (WHERE s.valid) AS n_valid, count(*) FILTER (WHERE NOT s.valid AND s.disposition <> 'buffered') AS n_bad, count(s.file_id) > 0 AS begun
FROM documents LEFT JOIN ({_SETTLED}) s ON s.file_id = doc_id GROUP BY doc_id)""")
def stream_status(spark, d):
    """Both views of the files after the stream: the running one and the final one."""
    from ..streaming import session

    m = manifest.file_manifest(files(spark, d), SIZE).select("file_id", "n_slices")
    return session.status(_settled(spark, d), m)


@query()
def stream_duplicates(spark, d):
    """Ranges that brought nothing new, by file."""
    return _settled(spark, d).groupBy("file_id").agg(F.sum("n_duplicates").alias("n_duplicates"), F.count_if(F.col("disposition") == "conflict").alias("n_conflicts"))


from . import content, sets  # noqa: E402, F401  they register their queries
