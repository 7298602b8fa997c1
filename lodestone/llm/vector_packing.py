"""Vector best-fit packing of documents into sequences.

A sequence has three capacities: tokens, pieces, and attention cost (the sum of squared piece
lengths). Only piece lengths matter, so the plan is made on their histogram: at most max_tokens
rows, whatever the number of documents. Lengths are placed from long to short; an item goes to
the feasible class of open sequences that scores best, by the norm of what would be left in all
three capacities or by the weighted dot product of demand and residual. Sequences with equal
residuals form one class and take equal items together. The plan's intervals of item ranks map
to intervals of sequences; a piece's rank within its length comes from counts by task.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, tokens


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence; weights of tokens, pieces and attention; rule "norm" or "dot"."""

    tokens: int = 1024
    pieces: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    @property
    def longest(self) -> int:
        return min(self.tokens, math.isqrt(self.attention))


def plan(histogram: dict[int, int], cap: Capacity) -> dict[int, np.ndarray]:
    """length -> rows (first rank, items, first sequence, items a sequence, offset), in rank order."""
    size = (cap.tokens, cap.pieces, cap.attention)
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
    opened = 0

    def score(left: tuple[int, int, int], need: tuple[int, int, int]) -> float:
        if cap.rule == "dot":
            return -sum(w * n / s * x / s for w, n, x, s in zip(cap.weights, need, left, size, strict=True))
        return sum(w * ((x - n) / s) ** 2 for w, n, x, s in zip(cap.weights, need, left, size, strict=True))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = (length, 1, length * length)
        out = rows.setdefault(length, [])
        while left:
            fit = [c for c in open_ if all(x >= n for x, n in zip(c, need, strict=True))]
            best = min(fit, key=lambda c: (score(c, need), c)) if fit else size
            each = min(x // n for x, n in zip(best, need, strict=True))
            if fit:
                spans = open_.pop(best)
            else:
                spans = [(opened, -(-left // each))]
                opened += spans[0][1]
            while spans:
                first, count = spans.pop()
                if not left:
                    open_[best].append((first, count))
                    continue
                full = min(count, left // each)
                if full:
                    out.append((rank, full * each, first, each, cap.tokens - best[0]))
                    open_[tuple(x - n * each for x, n in zip(best, need, strict=True))].append((first, full))
                    rank, left = rank + full * each, left - full * each
                first, count = first + full, count - full
                if count and 0 < left < each:
                    out.append((rank, left, first, left, cap.tokens - best[0]))
                    open_[tuple(x - n * left for x, n in zip(best, need, strict=True))].append((first, 1))
                    rank, left, first, count = rank + left, 0, first + 1, count - 1
                if count:
                    open_[best].append((first, count))
        for spent in [c for c in open_ if c[0] == 0 or c[1] == 0]:
            del open_[spent]
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _pieces(path: str, end_id: int, longest: int, kind: pa.DataType):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = tokens.Encoder(path).encode
        pid = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1), strict=True):
                ids_bytes = encode(text.as_py() or "") + tail
                n = len(ids_bytes) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n % longest or longest) if piece == 0 else longest
                    out.append((doc, piece, at, length, zlib.crc32(memoryview(ids_bytes)[4 * at : 4 * (at + length)]), pid, seen[length]))
                    seen[length] += 1
                    at, piece = at + length, piece + 1
                if len(out) > 20_000:
                    yield _batch(out, kind)
                    out = []
            if out:
                yield _batch(out, kind)

    return run


def _batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "piece", "start", "length", "crc", "task", "turn"])


def _place(book: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                rows = book[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                turn = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + turn // row[:, 3]
                offset[mine] = row[:, 4] + turn % row[:, 3] * x
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, cap: Capacity | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id. Longer ones than a sequence holds are cut; the first piece
    takes the remainder. Null and empty texts are end_id alone. Repeated rows are packed each,
    null ids stay, other columns are ignored; an empty table gives no rows.
    tokenizer: the path of the vocabulary file, the same on every machine.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    scratch.session(docs)
    cap = cap or Capacity()
    if cap.longest < 1 or cap.pieces < 1:
        raise ValueError("a sequence must hold one piece of one token at least")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "crc", "task", "turn"))])
    pieces = scratch.write(base.mapInArrow(_pieces(tokenizer, end_id, cap.longest, to_arrow_type(kind)), schema), "pack-pieces")
    count = pieces.groupBy("length", "task").agg(F.count("*").alias("items"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = count.select("length", "task", F.coalesce(F.sum("items").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["items"] for r in count.groupBy("length").agg(F.sum("items").alias("items")).collect()}
    ranked = pieces.join(first, ["length", "task"]).select("id", "piece", "start", "length", "crc", (F.col("first") + F.col("turn")).alias("rank"))
    placed = T.StructType([*schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = ranked.mapInArrow(_place(plan(histogram, cap)), placed)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
