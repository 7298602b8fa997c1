"""Known slices at every byte of damaged, shifted or foreign files.

Each file of a set is scanned against the set's slices: the checksum of every window, looked up among
the known ones; what hits is joined with the slices by its digest. Files and tables of checksums meet in
blocks: a table has TABLE slices at most, and a block of files has FILE_BYTES, or more if its table is
large, so that tables move no more bytes than files do. A set of any size is many tasks; files of a set
of more than TABLE slices are scanned once for each of its tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows

TABLE, FILE_BYTES, PIECE, HELD = 1 << 23, 8 << 20, 4 << 20, 1 << 20
#: Shares of a set, of slices by checksum, of files by path: a large set is many tasks where it meets what is known
#: of it. A table is some shares, so a set has as many tables at most; beyond TABLE * SHARES slices they are larger.
SHARES = 16
#: Bytes of a table for each slice: a checksum, and for one that is short its length too.
ENTRY = 6
HITS = "set_id {set}, path {path}, offset long, length long, md5 string, crc32 long"
HELD_ROWS = "set_id {set}, length long, md5 string, crc32 long"
#: Hits that are Python objects at once: in a run of one byte every place is a hit.
ROWS = 1 << 16


def _packed(size: int):
    """Slices to pieces of a set's tables: checksums of whole ones, length and checksum of short ones, as bytes."""

    def run(batches):
        held: dict[tuple, list] = {}
        n = 0

        def told():
            keys = [np.concatenate(x) for x in held.values()]
            whole = [k[k >> np.uint64(32) == size].astype("<u4").tobytes() for k in keys]
            short = [k[k >> np.uint64(32) < size].astype("<u8").tobytes() for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in held], kind), pa.array([x for _, x in held], pa.int32()), pa.array(whole, pa.binary()), pa.array(short, pa.binary())], names=["set_id", "_share", "whole", "short"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("set_id").type
            sets = batch.column("set_id").dictionary_encode()
            keys = (np.asarray(batch.column("length")).astype(np.uint64) << np.uint64(32)) | np.asarray(batch.column("crc32")).astype(np.uint64)
            place = np.asarray(sets.indices).astype(np.int64) * SHARES + (keys % np.uint64(SHARES)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            groups, first = np.unique(place[order], return_index=True)
            names = sets.dictionary.to_pylist()
            for g, part in zip(groups.tolist(), np.split(keys[order], first[1:]), strict=True):
                held.setdefault((names[g // SHARES], g % SHARES), []).append(part)
            n += len(keys)
            if n >= HELD:
                yield told()
                held, n = {}, 0
        if held:
            yield told()

    return run


def _pieces(files: list[tuple]) -> Iterator[list[tuple]]:
    """(path, data) by some PIECE bytes; a larger file is alone."""
    some, n = [], 0
    for f in files:
        if some and n + len(f[1]) > PIECE:
            yield some
            some, n = [], 0
        some.append(f)
        n += len(f[1])
    if some:
        yield some


def _find(size: int, places: bool):
    """Rows of HITS, or without `places` of HELD_ROWS: what is held at some place, once a block."""

    def run(key, left, right):
        at_place = [("path", left.schema.field("path").type), ("offset", pa.int64())] if places else []
        schema = pa.schema([("set_id", left.schema.field("set_id").type), *at_place, ("length", pa.int64()), ("md5", pa.string()), ("crc32", pa.int64())])
        out: list[tuple] = []
        batches: list[pa.RecordBatch] = []
        last: dict[tuple, tuple] = {}  # where bytes of a length and checksum were met last
        met: set[tuple] = set()
        whole, short = (np.unique(np.frombuffer(b"".join(right.column(c).to_pylist()), d)) for c, d in (("whole", "<u4"), ("short", "<u8")))
        bits = min(24, len(whole).bit_length() + 4)
        shift, flags = np.uint32(32 - bits), np.zeros(1 << bits, bool)
        flags[whole >> shift] = True
        most = int(short[-1] >> np.uint64(32)) if len(short) else 0
        edges = np.searchsorted(short, np.arange(most + 2, dtype=np.uint64) << np.uint64(32))

        def told():
            if out:
                batches.append(pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema))
                out.clear()

        def add(f, at, n, crc):
            data = f[1][at : at + n]
            if not places:
                d, x = last.get((n, crc), (b"", 0))
                if d[x : x + n] == data:
                    return
                last[n, crc] = f[1], at
            row = (n, hashlib.md5(data).hexdigest(), crc)
            if places:
                out.append((set_id, f[0], at, *row))
            elif row not in met:
                met.add(row)
                out.append((set_id, *row))
            if len(out) >= ROWS:
                told()

        files = [(p, d) for p, d in zip(left.column("path").to_pylist(), left.column("data").to_pylist(), strict=True) if d]
        set_id = left.column("set_id")[0].as_py() if files else None
        for piece in _pieces(sorted(files, key=lambda f: -len(f[1]))):
            flat = np.frombuffer(b"".join(d for _, d in piece) if len(piece) > 1 else piece[0][1], np.uint8)
            lengths = np.array([len(d) for _, d in piece])
            ends = np.cumsum(lengths)
            starts = ends - lengths
            for a, found in windows.window_segments(flat, size) if len(whole) and lengths[0] >= size else ():
                at = np.flatnonzero(flags[found >> shift])
                at = at[whole[np.minimum(np.searchsorted(whole, found[at]), len(whole) - 1)] == found[at]]
                for b in range(0, len(at), ROWS):
                    crcs, some = found[at[b : b + ROWS]], at[b : b + ROWS] + a
                    f = np.searchsorted(starts, some, "right") - 1
                    inside = some + size <= ends[f]  # not over the end of a file
                    for i, x, c in zip(f[inside].tolist(), (some - starts[f])[inside].tolist(), crcs[inside].tolist(), strict=True):
                        add(piece[i], x, size, c)
            for n, found in windows.end_crcs(flat, ends, lengths, most):  # short slices count at the end of a file only
                known = short[edges[n] : edges[n + 1]]
                if len(known):
                    for i in np.flatnonzero(np.isin(found, known.astype(np.uint32))).tolist():
                        add(piece[i], int(lengths[i]) - n, n, int(found[i]))
        told()
        return pa.Table.from_batches(batches, schema)

    return run


def _scanned(files: DataFrame, known: DataFrame, size: int, places: bool) -> tuple[DataFrame, DataFrame]:
    """What has a known slice's checksum, and the known slices."""
    k = known.where((F.col("length") > 0) & (F.col("length") <= size)).select("set_id", "length", "md5", "crc32").distinct()
    tables = k.groupBy("set_id").agg(F.count("*").alias("slices")).withColumn("tables", F.least(F.ceil(F.col("slices") / TABLE), F.lit(SHARES)).cast("int"))
    extent = files.groupBy("set_id").agg(F.sum(F.octet_length("data")).alias("bytes"))
    block = F.greatest(F.lit(FILE_BYTES).cast("double"), ENTRY * F.col("slices") / F.col("tables"))
    both = tables.join(extent, "set_id").withColumn("blocks", F.ceil(F.col("bytes") / block).cast("int")).where("blocks > 0").select("set_id", "tables", "blocks")
    both = both.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    kind, path = (files.schema[c].dataType.simpleString() for c in ("set_id", "path"))
    left = files.withColumn("_share", F.pmod(F.xxhash64("path"), F.lit(SHARES)).cast("int")).join(both, ["set_id", "_share"])
    left = left.withColumn("fb", F.pmod(F.xxhash64(F.lit(1), "path"), "blocks").cast("int")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tables") - 1)))
    right = k.where("set_id is not null").select("set_id", "length", "crc32").mapInArrow(_packed(size), f"set_id {kind}, _share int, whole binary, short binary")
    right = right.join(both, ["set_id", "_share"]).withColumn("tb", F.pmod("_share", "tables")).withColumn("fb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ("set_id", "tb", "fb")
    schema = (HITS if places else HELD_ROWS).format(set=kind, path=path)
    return left.select(*key, "path", "data").groupBy(*key).cogroup(right.select(*key, "whole", "short").groupBy(*key)).applyInArrow(_find(size, places), schema), k


def hits(files: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(set_id, path, offset, length, md5): every place of `files` that holds a known slice's bytes.

    files: set_id, path, data; known: set_id, length, md5, crc32, of slices as they are, not padded.
    Slices of `size` bytes are found at any byte, shorter ones at a file's end. Null contents and files
    shorter than a slice give none; a repeated path is scanned each time and its hits are one.
    """
    found, k = _scanned(files, known, size, True)
    found = found.join(k, ["set_id", "length", "md5", "crc32"], "left_semi")
    return found.select("set_id", "path", "offset", "length", "md5").distinct()


def held(files: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(set_id, length, md5): what `hits` finds, without its places: a row for each slice's bytes, not one for each
    place. Every byte is looked at all the same."""
    found, k = _scanned(files, known, size, False)
    return found.distinct().join(k, ["set_id", "length", "md5", "crc32"], "left_semi").select("set_id", "length", "md5").distinct()


def ranked(found: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(set_id, path, offset, file_id, slice_index): of the slices with a place's bytes the first by rank, 0 the one that
    belongs there, 1 another of the same file, 2 any; then the least file and index. path is a file's id."""
    by_file = known.groupBy("set_id", "md5", F.col("file_id").alias("_file")).agg(F.min("slice_index").alias("_index"))
    first = by_file.groupBy("set_id", "md5").agg(F.min(F.struct(F.col("_file").isNull().alias("_null"), F.col("_file").alias("file_id"), F.col("_index").alias("slice_index"))).alias("_first"))
    own = by_file.where("_file is not null").withColumnRenamed("_file", "path")
    here = known.select("set_id", "md5", F.col("file_id").alias("path"), (F.col("slice_index") * size).alias("offset")).distinct().withColumn("_here", F.lit(True))
    # a row for each place throughout: slices of the same bytes never meet all places that hold them
    j = found.join(first, ["set_id", "md5"]).join(own, ["set_id", "md5", "path"], "left").join(here, ["set_id", "md5", "path", "offset"], "left")
    rank = F.when(F.col("_here"), 0).when(F.col("_index").isNotNull(), 1).otherwise(2)
    file_id = F.when(rank < 2, F.col("path")).otherwise(F.col("_first.file_id"))
    index = F.when(rank == 0, F.floor(F.col("offset") / size)).when(rank == 1, F.col("_index")).otherwise(F.col("_first.slice_index"))
    j = j.select("set_id", "path", "offset", file_id.alias("file_id"), index.cast("long").alias("slice_index"), rank.alias("rank"))
    w = Window.partitionBy("set_id", "path", "offset").orderBy("rank", F.asc_nulls_last("file_id"), "slice_index")  # files of one path
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chained(chosen: DataFrame, size: int) -> DataFrame:
    """(set_id, path, offset) with run: hits that follow each other without a gap are one run, numbered by file from its start."""
    w = Window.partitionBy("set_id", "path").orderBy("offset")
    new = F.when(F.lag("offset").over(w) + size == F.col("offset"), 0).otherwise(1)
    return chosen.withColumn("_new", new).withColumn("run", F.sum("_new").over(w).cast("long")).drop("_new")


def harvested(slices: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """verify_slices rows, valid also where some file of the set holds the slice's bytes at any place (found: of `held`, or
    of `hits`); in_place: valid before."""
    mended = known.join(found.select("set_id", "md5").distinct(), ["set_id", "md5"], "left_semi")
    there = mended.select("file_id", "slice_index").distinct().withColumn("_found", F.lit(True))
    j = slices.join(there, ["file_id", "slice_index"], "left")
    return j.select("set_id", "file_id", "slice_index", (F.col("valid") | F.coalesce("_found", F.lit(False))).alias("valid"), F.col("valid").alias("in_place"))
