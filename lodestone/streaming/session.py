"""Slice verdicts from byte ranges that arrive in any order, overlap and repeat.

A stream of (file_id, offset, data) is cut at slice borders and joined to the expected slices; the
state of a slice is its bytes so far. A slice is settled once, when it is full; what comes later is
a duplicate. Bytes that contradict those held settle it as a conflict.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERDICT = "file_id long, slice_index long, disposition string, valid boolean, buffered long, n_duplicates long"
STATE = "data binary, mask binary, verdict int, duplicates long"
MOST_BUFFERED = 64 << 20


def pieces(feed: DataFrame, size: int) -> DataFrame:
    """Ranges cut at slice borders: (file_id, slice_index, at, piece)."""
    n = F.octet_length("data")
    index = F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + n - 1) / size)))
    cut = feed.where(n > 0).withColumn("slice_index", index)
    low = F.greatest(F.col("offset"), F.col("slice_index") * size)
    high = F.least(F.col("offset") + n, (F.col("slice_index") + 1) * size)
    return cut.select("file_id", "slice_index", (low - F.col("slice_index") * size).cast("long").alias("at"), F.substring(F.col("data"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("piece"))


def _settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """verdict: 0 open, 1 valid, 2 invalid, 3 conflict, 4 over budget."""
    held, told, verdict, repeats = state.get if state.exists else (b"", b"", 0, 0)
    data, mask = (np.frombuffer(x, np.uint8).copy() for x in (held, told))
    for pdf in frames:
        for at, piece, wanted, length in zip(pdf["at"], pdf["piece"], pdf["md5"], pdf["length"], strict=True):
            if verdict:
                repeats += 1
                continue
            if not len(data):
                if length > MOST_BUFFERED:
                    verdict = 4
                    continue
                data, mask = np.zeros(int(length), np.uint8), np.zeros(int(length), np.uint8)
            a = int(at)
            new = np.frombuffer(bytes(piece), np.uint8)[: len(data) - a]
            own, there = data[a : a + len(new)], mask[a : a + len(new)]
            if ((own != new) & (there == 1)).any():
                verdict = 3
            elif there.all():
                repeats += 1
            else:
                own[:], there[:] = new, 1
                if mask.all():
                    verdict = 1 if hashlib.md5(data).hexdigest() == wanted else 2
    open_ = not verdict
    state.update((data.tobytes() if open_ else b"", mask.tobytes() if open_ else b"", verdict, repeats))
    said = ("buffered", "verified", "verified", "conflict", "budget")[verdict]
    yield pd.DataFrame({"file_id": [key[0]], "slice_index": [key[1]], "disposition": [said], "valid": [verdict == 1], "buffered": [int(mask.sum()) if open_ else 0], "n_duplicates": [repeats]})


def verdicts(feed: DataFrame, expected: DataFrame, size: int) -> DataFrame:
    """A row for each slice touched in a batch; its last row stands. expected: file_id, slice_index, md5, length."""
    joined = pieces(feed, size).join(expected.select("file_id", "slice_index", "md5", "length"), ["file_id", "slice_index"])
    return joined.groupBy("file_id", "slice_index").applyInPandasWithState(_settle, VERDICT, STATE, "update", GroupStateTimeout.NoTimeout)


def status(settled: DataFrame, files: DataFrame) -> DataFrame:
    """Two views of each file: `pending` slices count as fine in the running one, as missing in the final one."""
    good = settled.where("disposition = 'verified' and valid").groupBy("file_id").agg(F.count("*").alias("good"))
    bad = settled.where("not (disposition = 'verified' and valid) and disposition <> 'buffered'").groupBy("file_id").agg(F.count("*").alias("bad"))
    begun = settled.select("file_id").distinct().withColumn("begun", F.lit(True))
    j = files.select("file_id", "n_slices").join(good, "file_id", "left").join(bad, "file_id", "left").join(begun, "file_id", "left").fillna(0, ["good", "bad"])
    running = F.when(F.col("begun").isNull(), F.col("n_slices")).otherwise(F.col("bad"))
    return j.select("file_id", "n_slices", F.col("good").alias("n_valid"), running.alias("running_missing"), (F.col("n_slices") - F.col("good")).alias("final_missing"), (F.col("good") == F.col("n_slices")).alias("complete"))
