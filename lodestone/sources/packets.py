"""Recovery packets: scanning them out of files, folding them into sets, and writing them.

A packet is a magic, its length (a multiple of four), the md5 of what follows, its set and type,
and a body. A damaged one is skipped: the scan goes on at the next magic.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the open format: the magic and the packet types.
MAGIC = b"PAR2\0PKT"
TYPES = {b"PAR 2.0\0Main\0\0\0\0": "main", b"PAR 2.0\0FileDesc": "file", b"PAR 2.0\0IFSC\0\0\0\0": "slices", b"PAR 2.0\0RecvSlic": "recovery", b"PAR 2.0\0Creator\0": "creator"}
HEAD = struct.Struct("<8sQ16s16s16s")
SCHEMA = "path string, offset long, length long, set_id string, type string, file_id string, name string, file_length long, md5_full string, md5_16k string, slice_size long, ids array<string>, other_ids array<string>, checksums array<struct<md5:string,crc32:long>>, exponent long, body_offset long, body_length long, creator string"


def encode(kind: str, set_id: bytes, body: bytes) -> bytes:
    tag = next(t for t, k in TYPES.items() if k == kind)
    body += b"\0" * (-len(body) % 4)
    rest = set_id + tag + body
    return MAGIC + struct.pack("<Q", 32 + len(rest)) + hashlib.md5(rest).digest() + rest


def main_body(slice_size: int, ids: list[bytes], others: list[bytes] = ()) -> bytes:
    return struct.pack("<QI", slice_size, len(ids)) + b"".join(ids) + b"".join(others)


def file_id(md5_16k: bytes, length: int, name: str) -> bytes:
    return hashlib.md5(md5_16k + struct.pack("<Q", length) + name.encode()).digest()


def file_body(own_id: bytes, md5_full: bytes, md5_16k: bytes, length: int, name: str) -> bytes:
    return own_id + md5_full + md5_16k + struct.pack("<Q", length) + name.encode()


def slices_body(own_id: bytes, sums: list[tuple[bytes, int]]) -> bytes:
    return own_id + b"".join(m + struct.pack("<I", c) for m, c in sums)


def _parsed(kind: str, body: bytes, at: int) -> dict | None:
    """The fields of a body; None if it is malformed. Recovery data stays where it is: only its place is told."""
    if kind == "main":
        if len(body) < 12 or (len(body) - 12) % 16:
            return None
        size, n = struct.unpack_from("<QI", body)
        ids = [body[i : i + 16].hex() for i in range(12, len(body), 16)]
        return {"slice_size": size, "ids": ids[:n], "other_ids": ids[n:]} if size and size % 4 == 0 and n <= len(ids) else None
    if kind == "file":
        if len(body) < 56:
            return None
        return {"file_id": body[:16].hex(), "md5_full": body[16:32].hex(), "md5_16k": body[32:48].hex(), "file_length": min(struct.unpack_from("<Q", body, 48)[0], 2**63 - 1), "name": body[56:].rstrip(b"\0").decode("utf-8", "replace")}
    if kind == "slices":
        if len(body) < 16 or (len(body) - 16) % 20:
            return None
        return {"file_id": body[:16].hex(), "checksums": [{"md5": body[i : i + 16].hex(), "crc32": struct.unpack_from("<I", body, i + 16)[0]} for i in range(16, len(body), 20)]}
    if kind == "recovery":
        return {"exponent": struct.unpack_from("<I", body)[0], "body_offset": at + 4, "body_length": len(body) - 4} if len(body) >= 4 else None
    return {"creator": body.rstrip(b"\0").decode("utf-8", "replace")}


def scan(data: bytes, most: int | None = None) -> Iterator[dict]:
    """Good packets in order; `most` examined ones at most, more are an error."""
    at, seen = data.find(MAGIC), 0
    while at >= 0:
        seen += 1
        if most is not None and seen > most:
            raise ValueError(f"more than {most} packets")
        if at + HEAD.size <= len(data):
            _, length, digest, set_id, tag = HEAD.unpack_from(data, at)
            end = at + length
            if length >= HEAD.size and length % 4 == 0 and end <= len(data) and hashlib.md5(data[at + 32 : end]).digest() == digest:
                kind = TYPES.get(tag, "unknown")
                fields = _parsed(kind, data[at + HEAD.size : end], at + HEAD.size) if kind != "unknown" else {}
                if fields is not None:
                    yield {"offset": at, "length": length, "set_id": set_id.hex(), "type": kind, **fields}
                at = data.find(MAGIC, end)
                continue
        at = data.find(MAGIC, at + 1)


def packets(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Packets of all files under path; files are read by Spark, one in a task at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [{"path": p.as_py(), **r} for r in scan(content.as_py(), most)]
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in kind.names} for r in rows], kind)

    return files.mapInArrow(run, SCHEMA)


def sets(found: DataFrame) -> dict[str, DataFrame]:
    """Sets, files and slices of scanned packets: of each key the first packet counts, in order of path and offset.

    Ids that the set's main packet doesn't list, and slice lists of the wrong length, are left out.
    Two different main packets of one set are an error row: `conflict`.
    """
    first = lambda df, *k: df.withColumn("_n", F.row_number().over(Window.partitionBy(*k).orderBy("path", "offset"))).where("_n = 1").drop("_n")
    main = found.where("type = 'main'")
    clash = main.groupBy("set_id").agg((F.count_distinct(F.struct("slice_size", "ids", "other_ids")) > 1).alias("conflict"))
    one = first(main, "set_id").select("set_id", "slice_size", "ids", "other_ids").join(clash, "set_id")
    listed = one.select("set_id", "slice_size", F.posexplode("ids").alias("pos", "file_id"))
    files = first(found.where("type = 'file'"), "set_id", "file_id").select("set_id", "file_id", "name", "file_length", "md5_full", "md5_16k")
    files = listed.join(files, ["set_id", "file_id"]).withColumn("n_slices", F.ceil(F.col("file_length") / F.col("slice_size")))
    sums = first(found.where("type = 'slices'"), "set_id", "file_id").select("set_id", "file_id", "checksums")
    sums = files.join(sums, ["set_id", "file_id"]).where(F.size("checksums") == F.col("n_slices"))
    slices = sums.select("set_id", "file_id", F.posexplode("checksums").alias("slice_index", "c")).select("set_id", "file_id", "slice_index", "c.md5", "c.crc32")
    recovery = first(found.where("type = 'recovery'").drop("slice_size"), "set_id", "exponent").join(one.select("set_id", "slice_size"), "set_id").where(F.col("body_length") == F.col("slice_size"))
    return {"sets": one, "files": files, "slices": slices, "recovery": recovery.select("set_id", "exponent", "path", "body_offset", "body_length")}
