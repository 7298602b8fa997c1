"""Media columns in content-defined chunks.

A payload is cut where a gear hash of its last 32 bytes has enough zero bits. Chunk digests are
deduplicated by joins: each digest has one owner, the payload with the least digest of those
that hold the chunk. A stored record is an ordered chunk list; an owner's entries carry the
chunk's bytes, other entries only its digest. Reading back joins the missing chunks to their
records, rebuilds the payload in order and verifies every chunk and the whole.

Record: magic, number of chunks, then by chunk one byte (0 here, 1 here and wanted elsewhere,
2 elsewhere), the length and the digest, then the bytes held here, compressed without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textkit

MAGIC = b"LCDC1\n"
HERE, GIVEN, AWAY = 0, 1, 2
LEAST, MOST, BITS = 512, 16384, 11
_ENTRY = struct.Struct("<BI16s")


def gear() -> np.ndarray:
    """256 pseudo-random words, from a rule."""
    return (textkit.mix(np.arange(256, dtype=np.uint64), 0x6EA7) >> np.uint64(32)).astype(np.uint32)


_GEAR = gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each place: the sum of gear(byte) << distance."""
    h = _GEAR[data]
    step = 1
    while step < 32:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step)
        h = h + older
        step *= 2
    return h


def cuts(data: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks. A chunk has `least` bytes at least (the last one excepted), `most` at most."""
    marks = np.flatnonzero((rolling(data) >> np.uint32(32 - bits)) == 0) + 1
    out, at, n = [], 0, len(data)
    for mark in marks.tolist():
        while mark - at > most:
            at += most
            out.append(at)
        if mark - at >= least:
            out.append(mark)
            at = mark
    while n - at > most:
        at += most
        out.append(at)
    if at < n:
        out.append(n)
    return out


def digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def payload_of(text: bytes, unit: int) -> bytes:
    return text + b"\xff" * ((-len(text)) % unit if text else unit)


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) in order."""
    ends = cuts(np.frombuffer(payload, np.uint8))
    parts = [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return [(digest(p), p) for p in parts]


def pack(chunks: list[tuple[bytes, bytes]], away: set[bytes], given: set[bytes]) -> bytes:
    """The record of a payload; a chunk that recurs in it is held once."""
    head, body, held = [MAGIC, struct.pack("<I", len(chunks))], [], set()
    for d, data in chunks:
        kind = AWAY if d in away else GIVEN if d in given else HERE
        head.append(_ENTRY.pack(kind, len(data), d))
        if kind != AWAY and d not in held:
            held.add(d)
            body.append(data)
    return b"".join(head) + zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def entries(record: bytes) -> tuple[list[tuple[int, int, bytes]], int]:
    if record[: len(MAGIC)] != MAGIC:
        raise ValueError("not a chunk record")
    n = struct.unpack_from("<I", record, len(MAGIC))[0]
    at = len(MAGIC) + 4
    return [_ENTRY.unpack_from(record, at + i * _ENTRY.size) for i in range(n)], at + n * _ENTRY.size


def held(record: bytes) -> dict[bytes, bytes]:
    """The chunks whose bytes a record holds."""
    list_, at = entries(record)
    body, out, here = zstandard.ZstdDecompressor().decompress(record[at:]), {}, 0
    for kind, n, d in list_:
        if kind != AWAY and d not in out:
            out[d] = body[here : here + n]
            here += n
    return out


def unpack(record: bytes, others: dict[bytes, bytes]) -> bytes:
    """The payload; raises if a chunk is missing or doesn't match its digest."""
    have = others | held(record)
    parts = []
    for _, n, d in entries(record)[0]:
        part = have.get(d)
        if part is None or len(part) != n or digest(part) != d:
            raise ValueError(f"chunk {d.hex()} is missing or damaged")
        parts.append(part)
    return b"".join(parts)


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    q = p[p > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"{x.mean():.4f},{x.std():.4f},{-(q * np.log2(q)).sum():.4f},{step:.4f}"


def _texts(batches, unit):
    for batch in batches:
        for part, data, offsets in textkit.segments(batch):
            yield part, [payload_of(data[a:b].tobytes(), unit) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.diff(offsets)


def _list(unit: int):
    def run(batches):
        for part, payloads, sizes in _texts(batches, unit):
            found = [[d for d, _ in chunks_of(p)] for p in payloads]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array([digest(p) for p in payloads], pa.binary()), pa.array(found, pa.list_(pa.binary()))], ["id", "n_bytes", "p", "chunks"])

    return run


def _bytes(unit: int, turn: int, turns: int):
    """Compressed payloads whose digest falls to this turn."""

    def run(batches):
        pack_ = zstandard.ZstdCompressor(level=3).compress
        for _, payloads, _ in _texts(batches, unit):
            mine = [(d, pack_(p)) for p in payloads if (d := digest(p))[0] % turns == turn]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in mine], pa.binary()), pa.array([x[1] for x in mine], pa.binary())], ["p", "z"])

    return run


def _records(batches):
    for batch in batches:
        out = []
        for z, away, given in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("z", "away", "given")), strict=True):
            payload = zstandard.ZstdDecompressor().decompress(z.as_py())
            out.append(pack(chunks_of(payload), set(away.as_py() or ()), set(given.as_py() or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["p", "media"])


def _given(batches):
    for batch in batches:
        rows = []
        for media in batch.column(batch.schema.get_field_index("media")):
            record = media.as_py()
            wanted = {d for kind, _, d in entries(record)[0] if kind == GIVEN}
            if wanted:
                have = held(record)
                rows += [(d, have[d]) for d in sorted(wanted)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "data"])


def _away(batches):
    for batch in batches:
        p, d = [], []
        for key, media in zip(batch.column(batch.schema.get_field_index("p")), batch.column(batch.schema.get_field_index("media")), strict=True):
            found = {x for kind, _, x in entries(media.as_py())[0] if kind == AWAY}
            p += [key.as_py()] * len(found)
            d += sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()), pa.array(d, pa.binary())], ["p", "chunk"])


def _facts(batches):
    for batch in batches:
        rows = []
        for key, media, data in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("p", "media", "data")), strict=True):
            p, record = key.as_py(), media.as_py()
            payload = unpack(record, {digest(x): x for x in data.as_py() or ()})
            if digest(payload) != p:
                raise ValueError(f"payload {p.hex()} differs from what was stored")
            rows.append((p, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(record), hashlib.sha256(record).hexdigest(), feature(payload)))
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["p", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store(docs: DataFrame, table: str, id_col: str = "doc_id", text_col: str = "text", unit: int = 576, turns: int = 2) -> DataFrame:
    """Writes the records of all distinct payloads to a bucketed table (p, media); returns (id, n_bytes, p, n_chunks).

    A payload is the text's UTF-8 bytes (null: none) and bytes 255 up to a positive multiple of unit. Equal
    payloads are one record; repeated rows and null ids stay; other columns are ignored; an empty table
    gives no rows and an empty table.
    turns: payloads are written in so many parts, by digest, so that less is shuffled at a time.
    """
    spark = scratch.session(docs)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    listed = scratch.write(base.mapInArrow(_list(unit), f"id {kind}, n_bytes long, p binary, chunks array<binary>"), "media-list")
    held_by = listed.select("p", F.explode(F.array_distinct("chunks")).alias("chunk")).distinct()
    owner = held_by.groupBy("chunk").agg(F.min("p").alias("owner"), F.max("p").alias("other")).where("owner <> other").select("chunk", "owner")
    flags = held_by.join(owner, "chunk").groupBy("p").agg(
        F.collect_list(F.when(F.col("p") != F.col("owner"), F.col("chunk"))).alias("away"),
        F.collect_list(F.when(F.col("p") == F.col("owner"), F.col("chunk"))).alias("given"),
    )
    flags = scratch.write(flags, "media-flags")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(turns):  # a turn's shuffle goes before the next begins
        whole = base.mapInArrow(_bytes(unit, turn, turns), "p binary, z binary").groupBy("p").agg(F.first("z").alias("z"))
        records = whole.join(flags, "p", "left").mapInArrow(_records, "p binary, media binary")
        scratch.bucketed(records, table, buckets, "p", append=bool(turn))
        scratch.release(spark)
    return listed.select("id", "n_bytes", "p", F.size("chunks").alias("n_chunks"))


def read_back(spark, table: str) -> DataFrame:
    """Rebuilt and verified payloads of a stored table: p and the facts of payload and record.

    A payload that differs from its digest, or misses a chunk, is an error. An empty table gives no rows.
    """
    records = spark.table(table)
    given = records.mapInArrow(_given, "chunk binary, data binary")
    missing = records.mapInArrow(_away, "p binary, chunk binary").join(given, "chunk").groupBy("p").agg(F.collect_list("data").alias("data"))
    full = records.join(missing, "p", "left").select("p", "media", "data")
    return full.mapInArrow(_facts, "p binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576) -> DataFrame:
    """One row per document: id, n_bytes, n_chunks, and the facts of the payload read back from the store.

    Null and empty texts are one unit of padding. Equal texts share a record; repeated rows and
    null ids stay; other columns are ignored; an empty table gives no rows.
    """
    spark = scratch.session(docs)
    table = scratch.table("media")
    listed = store(docs, table, id_col, text_col, unit)
    facts = scratch.write(read_back(spark, table), "media-facts")
    scratch.drop_table(spark, table)
    return listed.join(facts, "p").drop("p").withColumnRenamed("id", id_col)
