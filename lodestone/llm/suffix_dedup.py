"""Exact removal of byte strings that occur twice, by sorting suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Comparing all
suffixes would move every byte `length` times. Instead each window of that length elects an
anchor: its k-byte gram with the least hash. Equal windows elect anchors at the same place, so
only suffixes that start at anchors with the same gram need comparing, with what lies before them.

1. Grams that occur once are dropped (counted with map-side sums). A gram's occurrences with equal
   whole contexts (all windows around the anchor) are repeats as they stand.
2. What is left, one of each distinct context, is sorted by deep-shallow sorting: the suffix from
   the anchor on, and what lies before it, read backwards. Neighbours' common prefixes give the
   classes of equal beginnings at every depth, and a window repeats if another context has the
   same class on both sides. A gram with more contexts than `hot` is split by its windows' hashes.
3. Windows become spans, spans go back to their documents.

Texts lie in a table bucketed by row, so they are shuffled once and joins leave them in place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import deep_shallow, scratch, textkit

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for every i that has w values."""
    done, size = x, 1
    while size * 2 <= w:
        done = op(done[: len(done) - size], done[size:])
        size *= 2
    rest = w - size
    return op(done[: len(done) - rest], done[rest:]) if rest else done


class Anchors:
    """The anchors of texts for windows of `length` bytes with grams of k."""

    def __init__(self, length: int, k: int):
        if not 1 <= k <= length:
            raise ValueError("a gram must fit into a window")
        self.length, self.k, self.w = length, k, length - k + 1

    def find(self, data: np.ndarray, offsets: np.ndarray):
        """(row, place in the row, gram hash, context hash) of every anchor."""
        n = len(data)
        if n < self.length:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        power, inverse = textkit.powers(_BASE, n + 1), textkit.powers(_INVERSE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        gram = (total[self.k :] - total[: n + 1 - self.k]) * inverse[: n + 1 - self.k]
        pick = (textkit.mix(gram, 0x77) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
        least = _slide(pick, self.w, np.minimum)  # by window start
        size = np.diff(offsets)
        good = np.zeros(n + 1, np.int8)
        fit = size >= self.length
        np.add.at(good, offsets[:-1][fit], 1)
        np.add.at(good, (offsets[1:] - self.length + 1)[fit], -1)
        least = np.where(np.cumsum(good)[: len(least)] > 0, least, 0)
        padded = np.concatenate([np.zeros(self.w - 1, np.uint32), least, np.zeros(self.w - 1, np.uint32)])
        chosen = np.flatnonzero(_slide(padded, self.w, np.maximum)[: len(pick)] == pick)
        row = np.searchsorted(offsets, chosen, "right") - 1
        a = np.maximum(chosen - (self.w - 1), offsets[row])
        b = np.minimum(chosen + self.length, offsets[row + 1])
        around = textkit.mix(textkit.span_hashes(data, a, b, lower=False) + (chosen - a).astype(np.uint64), 0x99)
        return row, chosen - offsets[row], textkit.mix(gram[chosen], 0x55), around


def _pack(batches):
    at = TaskContext.get().partitionId() << 32
    zip_ = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part, data, offsets in textkit.segments(batch):
            n = len(offsets) - 1
            z = [zip_(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), part.column(0), pa.array(np.diff(offsets)), pa.array(z, pa.binary())], ["uid", "id", "n_bytes", "z"])
            at += n


def _unpack(batch: pa.RecordBatch):
    """(rows, bytes, offsets) of compressed texts in pieces of bounded size."""
    unzip = zstandard.ZstdDecompressor().decompress
    z, sizes = batch.column(batch.schema.get_field_index("z")), np.asarray(batch.column(batch.schema.get_field_index("n_bytes")))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for i, j in textkit.slices(offsets):
        data = b"".join(unzip(z[r].as_py()) for r in range(i, j))
        yield i, j, np.frombuffer(data, np.uint8), offsets[i : j + 1] - offsets[i]


def _anchors(length: int, k: int):
    finder = Anchors(length, k)

    def run(batches):
        for batch in batches:
            uid = np.asarray(batch.column(batch.schema.get_field_index("uid")))
            for i, _, data, offsets in _unpack(batch):
                row, at, key, ctx = finder.find(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(uid[row + i]), pa.array(at.astype(np.int32)), pa.array(textkit.signed(key)), pa.array(textkit.signed(ctx))], ["uid", "at", "key", "ctx"])

    return run


def _contexts(length: int, k: int):
    """The bytes around each wanted anchor: from it on, and before it, backwards."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            out = []
            uid = batch.column(batch.schema.get_field_index("uid"))
            for i, j, data, offsets in _unpack(batch):
                for r in range(i, j):
                    text = data[offsets[r - i] : offsets[r - i + 1]].tobytes()
                    for w in wanted[r].as_py():
                        at = w["at"]
                        out.append((w["key"], w["ctx"], uid[r].as_py(), at, w["n"], text[at : at + length], text[max(0, at - (length - k)) : at][::-1]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["key", "ctx", "uid", "at", "n", "right", "left"])

    return run


def repeated_windows(right: list[bytes], left: list[bytes], length: int, k: int) -> np.ndarray:
    """contexts x (length - k + 1): whether the window with a bytes before the anchor is in another context too."""
    n = len(right)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    order_r, lcp_r = deep_shallow.sort(right)
    order_l, lcp_l = deep_shallow.sort(left)
    rank_r[order_r], rank_l[order_l] = np.arange(n), np.arange(n)
    size_r, size_l = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    out = np.zeros((n, length - k + 1), bool)
    for a in range(length - k + 1):
        rows = np.flatnonzero((size_r >= length - a) & (size_l >= a))
        if len(rows) < 2:
            continue
        class_r, class_l = np.cumsum(lcp_r < length - a), np.cumsum(lcp_l < a)
        pair = class_l[rank_l[rows]] * (n + 1) + class_r[rank_r[rows]]
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        same = np.zeros(len(p), bool)
        same[1:] = p[1:] == p[:-1]
        same[:-1] |= same[1:]
        out[rows[order[same]], a] = True
    return out


def _spans(hit: np.ndarray, uid: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of runs of repeated windows."""
    n, w = hit.shape
    start, end = textkit.runs(hit.reshape(-1), np.arange(n + 1) * w)
    row, low, high = start // w, start % w, (end - 1) % w
    return pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array((at[row] - high).astype(np.int64)), pa.array((at[row] - low + length).astype(np.int64))], ["uid", "start", "end"])


def _sorted(length: int, k: int, batch_rows: int = 20_000):
    """Partitions sorted by gram: spans of contexts that occur once but share windows with others."""

    def emit(table: pa.Table):
        right, left = table.column("right").to_pylist(), table.column("left").to_pylist()
        hit = repeated_windows(right, left, length, k)
        hit &= (np.asarray(table.column("n").combine_chunks()) == 1)[:, None]
        return _spans(hit, np.asarray(table.column("uid").combine_chunks()), np.asarray(table.column("at").combine_chunks()), length)

    def run(batches):
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            key = np.asarray(rest.column("key").combine_chunks())
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut >= batch_rows:
                yield emit(rest.slice(0, cut).combine_chunks())
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield emit(rest.combine_chunks())

    return run


def _hashes(length: int, k: int):
    """A hash of each window of a context with its gram and place: for grams with very many contexts."""

    def run(batches):
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name))
            rows = []
            for key, uid, at, n, right, left in zip(*(col(c).to_pylist() for c in ("key", "uid", "at", "n", "right", "left")), strict=True):
                text = left[::-1] + right
                for a in range(min(len(left), length - k) + 1):
                    s = text[len(left) - a : len(left) - a + length]
                    if len(s) == length:
                        rows.append((hashlib.blake2b(b"%d %d " % (key, a) + s, digest_size=16).digest(), uid, at - a, n))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["h", "uid", "start", "n"])

    return run


def _finish(batches):
    for batch in batches:
        ids, spans = batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("spans"))
        removed, count, digest, kept = [], [], [], []
        for i, j, data, offsets in _unpack(batch):
            for r in range(i, j):
                text = data[offsets[r - i] : offsets[r - i + 1]].tobytes()
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in spans[r].as_py() or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                parts, here = [], 0
                for a, b in merged:
                    parts.append(text[here:a])
                    here = b
                parts.append(text[here:])
                rest = b"".join(parts)
                removed.append([{"start": a, "end": b} for a, b in merged])
                count.append(len(text) - len(rest))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column(batch.schema.get_field_index("n_bytes")), pa.array(count, pa.int64()), pa.array(removed, span), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = 32, hot: int = 200_000) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (start, end), kept_sha256, kept (bytes).

    Spans are the maximal removed runs, in bytes of the text's UTF-8. Matches count anywhere in the
    table, in the same text too, never across texts. Null texts are empty; texts shorter than
    `length` keep everything. Repeated rows repeat each other and go as a whole; null ids stay;
    other columns are ignored; an empty table gives no rows.
    """
    spark = scratch.session(docs)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = base.mapInArrow(_pack, f"uid long, id {kind}, n_bytes long, z binary")
    texts = scratch.bucketed(packed.repartition(buckets, "uid"), scratch.table("texts"), buckets, "uid")
    scratch.release(spark)

    anchors = texts.where(F.col("n_bytes") >= length).select("uid", "n_bytes", "z").mapInArrow(_anchors(length, k), "uid long, at int, key long, ctx long")
    keys = anchors.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("c"), F.max("ctx").alias("d")).where("n > 1")
    keys = scratch.write(keys.select("key", (F.col("c") == F.col("d")).alias("alike")), "suffix-keys")
    scratch.release(spark)
    shared = scratch.write(anchors.join(keys, "key"), "suffix-anchors")
    scratch.release(spark)

    whole = shared.where("alike").select("uid", "at")
    mixed = shared.where("not alike")
    alone = scratch.write(mixed.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("x")).select("key", "ctx", "n", "x.uid", "x.at"), "suffix-contexts")
    again = mixed.join(alone.where("n > 1").select("key", "ctx"), ["key", "ctx"], "left_semi").select("uid", "at")
    wanted = alone.groupBy("uid").agg(F.collect_list(F.struct("at", "key", "ctx", "n")).alias("wanted"))
    contexts = texts.join(wanted, "uid").select("uid", "n_bytes", "z", "wanted").mapInArrow(_contexts(length, k), "key long, ctx long, uid long, at int, n long, right binary, left binary")
    crowd = alone.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("key")
    crowded = not crowd.isEmpty()
    calm = contexts.join(crowd, "key", "left_anti") if crowded else contexts
    found = calm.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(_sorted(length, k), "uid long, start long, end long")
    if crowded:
        windows = contexts.join(F.broadcast(crowd) if crowd.count() < 100_000 else crowd, "key", "left_semi").mapInArrow(_hashes(length, k), "h binary, uid long, start long, n long")
        twice = windows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
        found = found.unionByName(windows.where("n = 1").join(twice, "h", "left_semi").select("uid", "start", (F.col("start") + length).alias("end")))
    around = whole.unionByName(again).select("uid", F.greatest(F.col("at") - (length - k), F.lit(0)).cast("long").alias("start"), (F.col("at") + length).cast("long").alias("stop"))
    spans = found.select("uid", "start", F.col("end").alias("stop")).unionByName(around)
    by_row = spans.groupBy("uid").agg(F.collect_set(F.struct("start", F.col("stop").alias("end"))).alias("spans"))
    joined = texts.join(by_row, "uid", "left").withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], F.col("n_bytes")).alias("end"))))
    out = joined.select("id", "n_bytes", "z", "spans").mapInArrow(_finish, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
