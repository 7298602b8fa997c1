"""Parity over finite fields: sizes, volumes, encoding, planning and solving."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import galois

#: The format's limits of input slices and the sizing rules' targets.
MOST_SLICES, TARGET_SLICES, ALIGN = 32768, 2000, 4


def rounded(n: Column) -> Column:
    return (F.ceil(n / ALIGN) * ALIGN).cast("long")


def block_size(files: DataFrame, group: str, length: str) -> DataFrame:
    """By group: the block size that gives some TARGET_SLICES slices and MOST_SLICES at most, a multiple of four."""
    g = files.where(F.col(length) > 0).groupBy(group).agg(F.sum(length).cast("long").alias("total_bytes"), F.max(length).cast("long").alias("largest"))
    size = rounded(F.greatest(F.ceil(F.col("total_bytes") / TARGET_SLICES), F.ceil(F.col("total_bytes") / MOST_SLICES), F.lit(ALIGN)))
    return g.withColumn("block_size", size)


def recovery_count(slices: Column, percent: int) -> Column:
    """Slices * percent, rounded; one at least if any are asked for."""
    n = F.floor((slices * percent + 50) / 100)
    return F.when(slices == 0, 0).otherwise(F.greatest(n, F.lit(1 if percent else 0))).cast("long")


def smallest_block(files: DataFrame, target: int, length: str, most: int) -> DataFrame:
    """The least multiple of four with `target` slices at most in all, among candidates up to `most`."""
    sizes = files.sparkSession.range(ALIGN, most + 1, ALIGN).withColumnRenamed("id", "block_size")
    lengths = files.where(F.col(length) > 0).groupBy(F.col(length).alias("_n")).agg(F.count("*").alias("_c"))
    n = lengths.crossJoin(F.broadcast(sizes)).groupBy("block_size").agg(F.sum(F.ceil(F.col("_n") / F.col("block_size")) * F.col("_c")).alias("slices"))
    return n.where(F.col("slices") <= target).agg(F.min("block_size").alias("block_size"))


def allocate(spark: SparkSession, count: int, volumes: int, first: int = 0, scheme: str = "uniform", largest: int | None = None) -> DataFrame:
    """(volume, first_exponent, count). uniform: even, the rest to the first; variable: doubling, the last takes the
    rest; limited: doubling up to `largest`. A volume is a row, so the plan is as small as their number."""
    if scheme == "uniform":
        sizes = [count // volumes + (i < count % volumes) for i in range(volumes)]
    else:
        sizes, left, step = [], count, 1
        while left > 0:
            last = scheme == "variable" and volumes and len(sizes) == volumes - 1
            n = left if last else min(left, step if largest is None else min(step, largest))
            sizes.append(n)
            left, step = left - n, step * 2
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1] + first if sizes else np.zeros(0)
    return spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(at, sizes, strict=True))], "volume long, first_exponent long, count long")


def words(data: bytes, size: int) -> np.ndarray:
    """Little-endian words of 16 bits, zero-padded."""
    return np.frombuffer(data.ljust(size, b"\0")[:size], "<u2").astype(np.int64)


def encode(slices: DataFrame, exponents: list[int], size: int) -> DataFrame:
    """Recovery slices of a set: (set_id, exponent, data). slices: set_id, index (0 on), data.

    Each input adds its words times constant ** exponent. Partial sums are made per batch and
    joined by exclusive or, so an input slice moves nowhere; only partial recovery slices do.
    """
    if size % 2:
        raise ValueError("slices hold whole words")

    def partial(batches):
        field = galois.field()
        for pdf in batches:
            for set_id, group in pdf.groupby("set_id", dropna=False):
                base = galois.constants(int(group["index"].max()) + 1)[group["index"].to_numpy()]
                data = np.stack([words(d, size) for d in group["data"]])
                for e in exponents:
                    out = np.bitwise_xor.reduce(field.mul(field.pow(base, e)[:, None], data), axis=0)
                    yield pd.DataFrame({"set_id": [set_id], "exponent": [e], "data": [out.astype("<u2").tobytes()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.bitwise_xor.reduce(np.stack([words(d, size) for d in pdf["data"]]), axis=0)
        return pd.DataFrame({"set_id": pdf["set_id"].iloc[:1], "exponent": pdf["exponent"].iloc[:1], "data": [out.astype("<u2").tobytes()]})

    kind = slices.schema["set_id"].dataType.simpleString()
    schema = f"set_id {kind}, exponent int, data binary"
    parts = slices.select("set_id", "index", "data").mapInPandas(partial, schema)
    return parts.groupBy("set_id", "exponent").applyInPandas(total, schema)


def plan(n_inputs: int, missing: list[int], exponents: list[int]) -> tuple[list[int], np.ndarray]:
    """The least exponents that can restore the missing inputs, and the inverse of their matrix.

    A singular choice is mended by leaving out its last row and taking the next exponent."""
    field, c = galois.field(), galois.constants(n_inputs)
    chosen: list[int] = []
    for e in sorted(set(exponents)):
        if len(chosen) == len(missing):
            break
        rows = np.stack([field.pow(c[missing], x) for x in [*chosen, e]])
        if _rank(field, rows) == len(chosen) + 1:
            chosen.append(e)
    if len(chosen) < len(missing):
        raise ValueError(f"{len(missing) - len(chosen)} recovery slices too few")
    if not missing:
        return [], np.zeros((0, 0), np.int64)
    return chosen, field.invert(np.stack([field.pow(c[missing], x) for x in chosen]))


def _rank(field: galois.Field, m: np.ndarray) -> int:
    m, r = m.copy(), 0
    for c in range(m.shape[1]):
        p = np.flatnonzero(m[r:, c])
        if not len(p):
            continue
        m[[r, r + int(p[0])]] = m[[r + int(p[0]), r]]
        m[r] = field.mul(m[r], field.inv(m[r, c]))
        rows = np.flatnonzero(m[:, c])
        rows = rows[rows != r]
        m[rows] ^= field.mul(m[rows, c : c + 1], m[r : r + 1])
        r += 1
        if r == len(m):
            break
    return r


def repair(slices: DataFrame, recovery: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Missing slices of each set: (set_id, index, data). counts: set_id, n_inputs.

    What is there is taken out of the recovery slices as in encode(), and each set's small system
    is solved in one group: its rows are the missing slices, never the present ones.
    """
    have = slices.groupBy("set_id").agg(F.collect_set("index").alias("have"))
    sets = counts.join(have, "set_id", "left").join(recovery.groupBy("set_id").agg(F.sort_array(F.collect_set("exponent")).alias("exponents")), "set_id")
    sets = sets.withColumn("missing", F.array_sort(F.array_except(F.sequence(F.lit(0), F.col("n_inputs") - 1), F.coalesce("have", F.array().cast("array<bigint>")))))
    sets = sets.where((F.size("missing") > 0) & (F.size("missing") <= F.size("exponents"))).select("set_id", "n_inputs", "missing", "exponents")
    used = [r["e"] for r in recovery.select(F.col("exponent").alias("e")).distinct().orderBy("e").collect()]
    known = encode(slices.join(sets.select("set_id"), "set_id", "left_semi"), used, size).withColumnRenamed("data", "known")
    left = recovery.join(known, ["set_id", "exponent"], "left").join(sets, "set_id")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        missing, field = [int(x) for x in pdf["missing"].iloc[0]], galois.field()
        chosen, inverse = plan(int(pdf["n_inputs"].iloc[0]), missing, [int(e) for e in pdf["exponents"].iloc[0]])
        rows = pdf.set_index("exponent").loc[chosen]
        rest = np.stack([words(d, size) ^ (words(k, size) if isinstance(k, bytes) else 0) for d, k in zip(rows["data"], rows["known"], strict=True)])
        found = field.matmul(inverse, rest)
        return pd.DataFrame({"set_id": [pdf["set_id"].iloc[0]] * len(missing), "index": missing, "data": [x.astype("<u2").tobytes() for x in found]})

    kind = slices.schema["set_id"].dataType.simpleString()
    return left.groupBy("set_id").applyInPandas(solve, f"set_id {kind}, index long, data binary")


def cauchy_decode(n_data: int, shards: dict[int, bytes], size: int) -> list[bytes]:
    """Data units from any n_data units of a Cauchy code: row r has 1 / (r ^ column) for r from n_data on."""
    field = galois.field()
    picked = sorted(shards)[:n_data]
    if len(picked) < n_data:
        raise ValueError("too few units")
    m = np.stack([np.eye(n_data, dtype=np.int64)[i] if i < n_data else field.inv(i ^ np.arange(n_data)) for i in picked])
    out = field.matmul(field.invert(m), np.stack([words(shards[i], size) for i in picked]))
    return [x.astype("<u2").tobytes() for x in out]
