"""Repeated runs of lines, by winnowing over line hashes.

A text is the sequence of its lines that are not blank, trimmed. In each window of `run` lines
the line with the least hash is a fingerprint, so every run of that many lines holds one at the
same place wherever it occurs. Fingerprints that occur once are dropped; at the others, joined
back to their positions, matches are extended both ways: every window of `run` lines around one
is compared by its own hash, of 128 bits, as that of a line. A line goes if such a window that covers it started before, in an
earlier document (by id, then by row) or earlier in its own; the first occurrence stays. On
demand a line of enough words is a run by itself, whatever its neighbours: it is its own window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, textkit

_LINE_END = 10


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """Start, end (trimmed), row and number of words of the lines that are not blank."""
    w_start, w_end, row = textkit.words(data, offsets)
    if not len(w_start):
        return w_start, w_start, w_start, w_start
    breaks = np.flatnonzero(data == _LINE_END)
    new = np.ones(len(w_start), bool)
    new[1:] = (row[1:] != row[:-1]) | (np.searchsorted(breaks, w_start[1:]) > np.searchsorted(breaks, w_end[:-1]))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(w_start)) - 1
    return w_start[head], w_end[tail], row[head], tail - head + 1


def winnow(h: np.ndarray, row: np.ndarray, run: int) -> np.ndarray:
    """Which lines have the least hash of a window of `run` lines of their text."""
    out = np.zeros(len(h), bool)
    if len(h) < run:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(h, run)
    inside = row[: len(windows)] == row[run - 1 :]
    at = np.flatnonzero(inside)
    least = windows[at].min(axis=1)
    for i in range(run):
        out[at[windows[at, i] == least] + i] = True
    return out


def _profile(run: int, alone: int | None):
    def go(batches):
        for batch in batches:
            for part, data, offsets in textkit.segments(batch):
                rows = len(offsets) - 1
                start, end, row, words = line_spans(data, offsets)
                both = textkit.span_hashes(data, start, end, lower=False, lanes=2)
                h = both[:, 0]
                pick = winnow(h, row, run)
                long = words >= alone if alone is not None else np.zeros(len(h), bool)
                index = np.arange(len(h)) - np.searchsorted(row, row)
                ends = lambda r: pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        *(pa.ListArray.from_arrays(ends(row), pa.array(textkit.signed(np.ascontiguousarray(both[:, i])))) for i in (0, 1)),
                        pa.ListArray.from_arrays(ends(row[pick]), pa.array(index[pick].astype(np.int32))),
                        *([] if alone is None else [pa.ListArray.from_arrays(ends(row[long]), pa.array(index[long].astype(np.int32)))]),
                    ],
                    ["uid", "id", "lines", "more", "picks", *([] if alone is None else ["long"])],
                )

    return go


def _windows(run: int):
    """(uid, start, gram, more): the windows of `run` lines around the shared fingerprints of a text, by two hashes."""

    def go(batches):
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("lines", "more", "at")}
            h, more, at = (np.asarray(c.flatten()) for c in columns.values())
            n, size = np.asarray(columns["at"].value_lengths()), np.asarray(columns["lines"].value_lengths())
            row = np.repeat(np.arange(len(n)), n)
            start = (at.astype(np.int64)[:, None] - np.arange(run)).reshape(-1)
            row, start = textkit.distinct(np.repeat(row, run)[start >= 0], start[start >= 0].astype(np.uint64))
            start = start.astype(np.int64)
            inside = start + run <= size[row]
            row, start = row[inside], start[inside]
            first = np.concatenate([[0], np.cumsum(size)])[row] + start
            grams = []
            for lane in (h, more):
                gram = np.zeros(len(start), np.uint64)
                for i in range(run):
                    gram = textkit.mix(gram + lane.view(np.uint64)[first + i], i + 1)
                grams.append(pa.array(textkit.signed(gram)))
            uid = np.asarray(batch.column(batch.schema.get_field_index("uid")))
            yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(start.astype(np.int32)), *grams], ["uid", "start", "gram", "more"])

    return go


def cut_lines(text: str, gone: list[int]) -> str:
    """The text without the given lines (counted over those that are not blank)."""
    lost, out, index = set(gone), [], -1
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            index += 1
            if index in lost:
                continue
        out.append(line)
    return "\n".join(out)


def _rewrite(batches):
    """(d, text, gone, lines): the text without its lost lines, and how many lines it had."""
    for batch in batches:
        d, text, gone = (batch.column(batch.schema.get_field_index(c)) for c in ("d", "text", "gone"))
        new = [t.as_py() if g.as_py() is None or t.as_py() is None else cut_lines(t.as_py(), g.as_py()) for t, g in zip(text, gone, strict=True)]
        count = [np.bincount(line_spans(data, offsets)[2], minlength=len(offsets) - 1) for _, data, offsets in textkit.segments(batch)]
        lines = np.concatenate(count).astype(np.int32) if count else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([d, pa.array(new, text.type), gone, pa.array(lines)], ["d", "text", "gone", "lines"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, gone: str = "_gone", lines: str = "_lines", alone: int | None = None) -> DataFrame:
    """docs with later repeated runs of `run` lines or more taken from the text.

    alone: a line of so many words is a run by itself; it goes if the same line came before, whatever
    stands around either. None: no line is, so that a passage of one line between new neighbours stays.

    Adds `gone`, the removed lines' numbers (null if none), and `lines`, how many there were; a name
    that docs has already gets underscores after it (textkit.free). Blank lines don't count and stay.
    Null and empty texts and those with fewer lines stay as they are; null ids come first in order. Of
    repeated rows the first keeps its lines. Other columns stay, whatever their names. An empty table
    gives no rows.
    """
    if run < 1:
        raise ValueError("a run has one line at least")
    if alone is not None and alone < 1:
        raise ValueError("a line that is a run by itself has one word at least")
    scratch.session(docs)
    gone = textkit.free(gone, docs.columns)
    lines = textkit.free(lines, [*docs.columns, gone])
    rest = [c for c in docs.columns if c != text_col]
    whole = scratch.write(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*map(scratch.col, rest)).alias("d"), F.col(text_col).cast("string").alias("text")), "lines-docs")
    base = whole.select("uid", F.col(f"d.{id_col}").alias("id"), "text")
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("uid", T.LongType()), base.schema["id"], T.StructField("lines", longs), T.StructField("more", longs), T.StructField("picks", ints)])
    if alone is not None:
        schema = schema.add("long", ints)
    rows = scratch.write(base.mapInArrow(_profile(run, alone), schema), "lines-hashes")
    prints = rows.select("uid", "lines", F.explode("picks").alias("at")).select("uid", "at", F.expr("lines[at]").alias("print"))
    shared = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    marked = prints.join(shared, "print").groupBy("uid").agg(F.collect_list("at").alias("at"))
    near = rows.join(marked, "uid").select("uid", "lines", "more", "at").mapInArrow(_windows(run), "uid long, start int, gram long, more long").withColumn("width", F.lit(run))
    if alone is not None:
        near = near.unionByName(rows.select("uid", "lines", "more", F.explode("long").alias("start")).select("uid", "start", F.expr("lines[start]").alias("gram"), F.expr("more[start]").alias("more"), F.lit(1).alias("width")))
    grams = scratch.write(near.join(rows.select("uid", "id"), "uid"), "lines-grams")
    key = ("gram", "more", "width")
    first = grams.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("id", "uid", "start")).alias("first")).where("n > 1")
    later = grams.join(first, [*key]).where(~((F.col("uid") == F.col("first.uid")) & (F.col("start") == F.col("first.start"))))
    lost = later.groupBy("uid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("width") - 1))))).alias("gone"))
    lost = scratch.write(lost, "lines-lost")
    scratch.drop(rows, grams)
    del rows, grams, base, prints, shared, marked, near, first, later
    scratch.release(docs.sparkSession)
    asked = scratch.flagged(whole, lost, "uid", "hit")  # texts that lose nothing stay where they are
    both = asked.where("hit").drop("hit").join(lost, "uid", "left").unionByName(asked.where("not hit").drop("hit").withColumn("gone", F.lit(None).cast(ints)))
    both = both.drop("uid")
    out = both.mapInArrow(_rewrite, T.StructType([*both.schema.fields, T.StructField("lines", T.IntegerType())]))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in docs.columns), F.col("gone").alias(gone), F.col("lines").alias(lines))
