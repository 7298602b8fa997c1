"""Mixing sources to target weights by temperature.

Weights are token shares to a power between 0 and 1, normalised. The exponent is bisected to meet
a target entropy, or the flattest mix whose most repeated source stays within a limit. A source
with budget r times its tokens gives floor(r) whole epochs and a budgeted part of one more. An
epoch is a permutation of blocks, by a hash of seed, source, epoch and block; documents belong to
blocks by their own hash. The part takes whole blocks in order while they fit, then the next
block's documents in hash order while they fit. As the order is one of hashes, the part is known
by three numbers a source, which is all that documents are compared with: they are neither
shuffled nor sorted while those numbers are few enough to be broadcast, and joined to them otherwise.
The numbers come from block sums, added up in two levels. Sources of equal size share an exponent's
effect, so the driver solves for the distinct sizes, of which there are at most the root of twice the
tokens, however many sources there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, textkit

BLOCK_DOCS, SUPER_BLOCKS = 1024, 4096
MOST_BROADCAST = 100_000  # sources; the numbers of more are joined as any table is


def weights(tokens: np.ndarray, exponent: float, times: np.ndarray | None = None) -> np.ndarray:
    """Of each size the weight of one source. times: how many sources have it; None: one each."""
    times = np.ones(len(tokens)) if times is None else times
    w = (tokens / (times * tokens).sum()) ** exponent
    return w / (times * w).sum()


def entropy(w: np.ndarray, times: np.ndarray | None = None) -> float:
    """In shares of the largest possible one; a single source has 1."""
    times = np.ones(len(w)) if times is None else times
    return float(-(times * w * np.log(w)).sum() / np.log(times.sum())) if times.sum() > 1 else 1.0


def repeats(tokens: np.ndarray, exponent: float, budget: float | None, times: np.ndarray | None = None) -> np.ndarray:
    """Epochs by source. Without a budget, the least repeated source has exactly one."""
    total = tokens.sum() if times is None else (times * tokens).sum()
    r = weights(tokens, exponent, times) / (tokens / total)
    return r / r.min() if budget is None else r * (budget / total)


def solve(tokens: np.ndarray, target_entropy: float | None, max_repeats: float | None, budget: float | None, times: np.ndarray | None = None) -> float:
    """The exponent, by bisection: entropy and the largest repeat both fall as it rises."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a limit of repeats")

    def flat_enough(x: float) -> bool:  # still at or above the target, or over the limit
        if target_entropy is not None:
            return entropy(weights(tokens, x, times), times) >= target_entropy
        return repeats(tokens, x, budget, times).max() > max_repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    if not flat_enough(low):
        return low
    if flat_enough(high):
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if flat_enough(mid) else (low, mid)
    return low if target_entropy is not None else high


@dataclass(frozen=True)
class Names:
    epoch: str = "epoch"
    position: str = "position"
    repeats: str = "repeats"


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", *, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: int = 17, tokens: str | None = None, names: Names = Names(), block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows of docs, once for each epoch that takes them, with `epoch`, `position` (0 to 1: sorting by it
    interleaves the sources) and `repeats` (the source's epochs); names that docs has already get
    underscores after them (textkit.free).

    budget: tokens in all; None: as many as give every source one whole epoch at least, so that no
    document is lost. tokens: SQL for a document's tokens; by default UTF-8 bytes / 4, and one.
    Null is a source of its own, null and empty texts count one token, repeated rows count each.
    Rows alike in id and text are taken together. Columns may have any names. An empty table gives no rows.
    """
    epoch_col = textkit.free(names.epoch, docs.columns)
    position_col = textkit.free(names.position, [*docs.columns, epoch_col])
    repeats_col = textkit.free(names.repeats, [*docs.columns, epoch_col, position_col])
    spark = scratch.session(docs)
    count = F.expr(tokens) if tokens else F.floor(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) / 4) + 1
    own = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    keyed = docs.select(F.col(source_col).alias("s"), count.cast("long").alias("t"), own.alias("h"))
    totals = scratch.write(keyed.groupBy("s").agg(F.sum("t").alias("t"), F.count("*").alias("n")).where("t > 0"), "mix-totals")
    sizes = sorted(totals.groupBy("t").agg(F.count("*").alias("m")).collect())
    if not sizes:
        return docs.limit(0).withColumns({epoch_col: F.lit(0), position_col: F.lit(0.0), repeats_col: F.lit(0.0)})
    tok, times = (np.array(x, float) for x in zip(*sizes, strict=True))
    r = repeats(tok, solve(tok, target_entropy, max_repeats, budget, times), budget, times)
    whole = np.floor(r + 1e-9)
    part = np.maximum(0, np.floor((r - whole) * tok + 1e-6))
    small = (lambda df: F.broadcast(df)) if times.sum() <= MOST_BROADCAST else (lambda df: df)
    by_size = spark.createDataFrame([(x[0], int(e), int(p), float(q)) for x, e, p, q in zip(sizes, whole, part, r, strict=True)], "pt long, whole long, part long, r double")
    plan = totals.join(small(by_size), F.col("t") == F.col("pt")).select(F.col("s").alias("ps"), F.ceil(F.col("n") / block_docs).alias("blocks"), "whole", "part", "r")
    table = scratch.write(plan, "mix-plan")

    def place(df: DataFrame, p: DataFrame) -> DataFrame:
        """Adds each document's block and the block's place in the last, partial epoch."""
        j = df.join(small(p), df["s"].eqNullSafe(p["ps"]))
        j = j.withColumn("b", F.pmod(F.col("h"), F.col("blocks")))
        return j.withColumn("u", F.xxhash64(F.lit(seed), F.col("s"), F.col("whole"), F.col("b")))

    sums = place(keyed, table.where("part > 0")).groupBy("s", "b", "u", "part", "blocks").agg(F.sum("t").alias("t"))
    sums = sums.withColumn("super", F.floor((F.col("u") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("blocks") / SUPER_BLOCKS)))
    upper = sums.groupBy("s", "super").agg(F.sum("t").alias("ts"))
    before = lambda *k: Window.partitionBy(*k)
    upper = upper.withColumn("base", F.coalesce(F.sum("ts").over(before("s").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumnRenamed("s", "us")
    inside = sums.withColumn("run", F.coalesce(F.sum("t").over(before("s", "super").orderBy("u", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cum = inside.join(upper, inside["s"].eqNullSafe(upper["us"]) & (inside["super"] == upper["super"])).select("s", "b", "u", "t", "part", (F.col("base") + F.col("run")).alias("start"))
    edge = cum.where((F.col("start") <= F.col("part")) & (F.col("start") + F.col("t") > F.col("part")))
    edge = edge.groupBy("s").agg(F.min(F.struct("u", "b", (F.col("part") - F.col("start")).alias("room"))).alias("e"))
    edges = scratch.write(edge.select(F.col("s").alias("es"), F.col("e.u").alias("eu"), F.col("e.b").alias("eb"), "e.room"), "mix-edges")
    cut = place(keyed, table.where("part > 0"))
    cut = cut.join(small(edges), cut["s"].eqNullSafe(edges["es"]) & (cut["b"] == edges["eb"])).groupBy("s", "h", "room").agg(F.sum("t").alias("t"))
    last = cut.withColumn("end", F.sum("t").over(before("s").orderBy("h"))).where("end <= room").groupBy(F.col("s").alias("ls")).agg(F.max("h").alias("_last"))
    final = table.join(small(edges), table["ps"].eqNullSafe(edges["es"]), "left")
    final = final.join(last, final["ps"].eqNullSafe(last["ls"]), "left")
    final = scratch.write(final.select(F.col("ps").alias("_ps"), F.col("blocks").alias("_blocks"), F.col("whole").alias("_whole"), F.col("part").alias("_part"), F.col("r").alias("_r"), F.col("eu").alias("_eu"), F.col("eb").alias("_eb"), "_last"), "mix-final")
    scratch.drop(totals, table, edges)

    out = docs.select(F.struct("*").alias("d"), F.col(source_col).alias("s"), own.alias("h"))
    out = out.join(small(final), out["s"].eqNullSafe(final["_ps"]))
    out = out.withColumn("b", F.pmod("h", "_blocks"))
    at = lambda epoch: F.xxhash64(F.lit(seed), F.col("s"), epoch, F.col("b"))
    u = at(F.col("_whole"))
    taken = (F.col("_part") > 0) & (F.col("_eu").isNull() | (u < F.col("_eu")) | ((u == F.col("_eu")) & ((F.col("b") < F.col("_eb")) | ((F.col("b") == F.col("_eb")) & (F.col("h") <= F.col("_last"))))))
    times = F.col("_whole") + F.when(taken, 1).otherwise(0)
    out = out.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    spot = (F.col("epoch") + at(F.col("epoch").cast("long")) / F.lit(2.0**64) + 0.5) / F.greatest(F.ceil("_r"), F.lit(1))
    return out.select("d.*", F.col("epoch").alias(epoch_col), spot.cast("double").alias(position_col), F.col("_r").alias(repeats_col))
