"""Largest inner products by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every vector is then assigned to a leaf. A query walks
the tree through a priority queue of nodes, best first by the inner product with the node's
centre plus a multiple of its radius, until it has visited as many leaves as calibration asks:
on the sample, visits are widened until recall against brute force reaches the target. Shards of
neighbouring leaves meet the queries that visit them, both in blocks, so a leaf that holds a
third of all rows is many tasks. Scores are exact, in double precision.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

BLOCK, SHARD = 4096, 8192


@dataclass
class Tree:
    """Nodes by number; centres and radii of all; children of inner nodes; leaf numbers of leaves."""

    centres: np.ndarray
    radii: np.ndarray
    children: list[np.ndarray | None]
    leaf: np.ndarray
    beta: float = 0.0
    visits: int = 1
    leaves: int = field(default=0)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers: from each node to the nearest child's centre."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if kids is None:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = np.argmin((c * c).sum(axis=1) - 2 * (x[rows] @ c.T), axis=1)
            for i in np.unique(near):
                stack.append((int(kids[i]), rows[near == i]))
        return out

    def walk(self, q: np.ndarray):
        """Leaf numbers, best bin first."""
        length = float(np.sqrt(q @ q))
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if kids is None:
                yield int(self.leaf[node])
                continue
            for s, k in zip(self.centres[kids] @ q + self.beta * length * self.radii[kids], kids, strict=True):
                heapq.heappush(heap, (-float(s), int(k)))

    def visit(self, q: np.ndarray, population: np.ndarray, least: int) -> list[int]:
        """The leaves a query visits: `visits` filled ones, more until `least` vectors are seen."""
        out, seen = [], 0
        for leaf in self.walk(q):
            if population[leaf]:
                out.append(leaf)
                seen += int(population[leaf])
                if len(out) >= self.visits and seen >= least:
                    break
        return out


def _split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's steps; the cluster of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return near


def build(x: np.ndarray, leaf_size: int, branch: int = 12, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    centres, radii, children, leaf = [], [], [], []
    todo = [(np.arange(len(x)), None)]
    at = 0
    while at < len(todo):
        rows, _ = todo[at]
        own = x[rows]
        c = own.mean(axis=0)
        centres.append(c)
        radii.append(float(np.sqrt(((own - c) ** 2).sum(axis=1).mean())))
        kids = None
        if len(rows) > leaf_size:
            near = _split(own, min(branch, max(2, len(rows) // leaf_size)), rng)
            groups = [rows[near == i] for i in np.unique(near)]
            if len(groups) > 1:
                kids = np.arange(len(todo), len(todo) + len(groups))
                todo += [(g, None) for g in groups]
        children.append(kids)
        leaf.append(-1 if kids is not None else sum(v >= 0 for v in leaf))
        at += 1
    t = Tree(np.array(centres), np.array(radii), children, np.array(leaf))
    t.leaves = int(t.leaf.max()) + 1
    return t


def calibrate(t: Tree, x: np.ndarray, k: int, target: float, queries: int = 300, seed: int = 11) -> Tree:
    """Chooses beta and the least number of visits whose recall on the sample reaches the target."""
    rng = np.random.default_rng(seed)
    own = rng.choice(len(x), min(queries, len(x)), replace=False)
    home = t.assign(x)
    s = x[own] @ x.T
    s[np.arange(len(own)), own] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return t
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    choice = (t.leaves, 0.0)
    for beta in (0.0, 0.5, 1.0):
        t.beta = beta
        need = np.zeros((len(own), k), np.int64)
        for i, row in enumerate(own):
            order = np.empty(t.leaves, np.int64)
            order[list(t.walk(x[row]))] = np.arange(t.leaves)
            need[i] = order[home[best[i]]] + 1
        visits = int(np.sort(need, axis=None)[int(np.ceil(target * need.size)) - 1])
        choice = min(choice, (visits, beta))
    t.visits, t.beta = choice
    return t


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray | pa.LargeListArray) else column.combine_chunks().flatten()
    return np.asarray(flat, np.float64).reshape(-1, dim)


def _assign(t: Tree, dim: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = t.assign(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], ["id", "v", "leaf"])

    return run


def _walk(t: Tree, dim: int, population: np.ndarray, least: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                visits = [t.visit(q, population, least) for q in _matrix(batch.column(1), dim)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(visits, pa.list_(pa.int64()))], ["qid", "q", "leaves"])

    return run


def _scan(dim: int, k: int):
    """The k best of each query in one block of a shard, over the leaves it visits there."""

    def run(key, left, right):
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        ids, leaf, v = np.asarray(left.column("id")), np.asarray(left.column("leaf")), _matrix(left.column("v"), dim)
        order = np.lexsort((ids, leaf))
        new = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(leaf[order]) != 0))  # repeated rows count once
        order = order[new]
        ids, leaf, v = ids[order], leaf[order], v[order]
        qid, q, leaves = np.asarray(right.column("qid")), _matrix(right.column("q"), dim), right.column("leaves").combine_chunks()
        wanted, asker = np.asarray(leaves.flatten()), np.repeat(np.arange(len(qid)), np.asarray(leaves.value_lengths()))
        take = min(k + len(ids) - len(np.unique(ids)), len(ids))  # an id of several vectors may take several places
        out = []
        for first in range(0, len(qid), 512):
            mine = (asker >= first) & (asker < first + 512)
            rows, of = asker[mine] - first, wanted[mine]
            some, own = q[first : first + 512], qid[first : first + 512]
            s = np.full((len(some), len(ids)), -np.inf)
            for x in np.unique(of):
                a, b = np.searchsorted(leaf, [x, x + 1])
                who = rows[of == x]
                s[who, a:b] = some[who] @ v[a:b].T
            s[own[:, None] == ids[None]] = -np.inf
            edge = np.partition(s, len(ids) - take, axis=1)[:, len(ids) - take]
            limit = np.where(np.isfinite(edge), edge - 1e-9 * (1 + np.abs(edge)), -np.finfo(float).max)
            row, at = np.nonzero(s >= limit[:, None])
            exact = (v[at] * some[row]).sum(axis=1)
            order = np.lexsort((-exact, ids[at], row))
            order = order[np.append(True, (np.diff(ids[at][order]) != 0) | (np.diff(row[order]) != 0))[: len(order)]]
            order = order[np.lexsort((ids[at][order], -exact[order], row[order]))]
            row, at, exact = row[order], at[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((own[row[best]], ids[at[best]], exact[best]))
        return pa.table(dict(zip(kinds, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return run


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors that take part: not null, finite in every component, not zero, and not of another length than most."""
    x = F.col("v")
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    df = df.where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0))
    return df


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, sample: int = 32768, target: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of df with the largest inner product with each query found.

    Ties go to smaller ids; rows with the query's id are not its candidates. Null ids, and vectors
    that are null, empty, zero, of another length than most, or with null or non-finite components
    take no part. Repeated rows count once. sample bounds the rows the tree is fitted on, and its leaves
    (of 16 sampled rows at least), which are all that the driver counts; target is the recall that
    calibration asks for. Other columns are ignored, whatever their names. Empty tables give no rows.
    """
    spark = scratch.session(df)
    rows = usable(df, id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = int(common[0]["dim"]), int(common[0]["count"])
    rows = rows.where(F.size("v") == dim)
    asked = usable(queries, id_col, vec_col).where(F.size("v") == dim).withColumnsRenamed({"id": "qid", "v": "q"})
    x = _matrix(rows.orderBy(F.xxhash64("id")).limit(sample).select("v").toArrow().column(0), dim)
    tree = calibrate(build(x, max(16, len(x) // max(16, 4 * int(np.sqrt(total))))), x, k, target)
    homed = rows.mapInArrow(_assign(tree, dim), "id long, v array<double>, leaf long")
    population = np.zeros(tree.leaves, np.int64)
    for r in homed.groupBy("leaf").agg(F.countDistinct("id").alias("n")).collect():  # a row for each leaf
        population[r["leaf"]] = r["n"]
    shards = min(tree.leaves, max(1, -(-total // SHARD)))
    shard = lambda leaf: F.floor(leaf * shards / tree.leaves).cast("long")  # noqa: E731  siblings have neighbouring numbers
    walked = asked.mapInArrow(_walk(tree, dim, population, k + 1), "qid long, q array<double>, leaves array<long>").select("qid", "q", F.explode("leaves").alias("leaf"))
    guests = np.zeros(shards, np.int64)
    for r in walked.select(shard(F.col("leaf")).alias("s"), "qid").distinct().groupBy("s").count().collect():
        guests[r["s"]] = r["count"]
    v_parts, q_parts = np.maximum(1, -(-population // BLOCK)), np.maximum(1, -(-guests // BLOCK))

    def parts(of: np.ndarray, column: str):
        return F.element_at(F.array(*(F.lit(int(n)) for n in of)), (F.col(column) + 1).cast("int")) if of.max() > 1 else F.lit(1)

    left = homed.withColumn("shard", shard(F.col("leaf"))).withColumn("vb", F.pmod(F.xxhash64("id"), parts(v_parts, "leaf")).cast("long"))
    left = left.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), (parts(q_parts, "shard") - 1).cast("long"))))
    right = walked.withColumn("shard", shard(F.col("leaf"))).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), (parts(v_parts, "leaf") - 1).cast("long"))))
    right = right.groupBy("qid", "q", "shard", "vb").agg(F.collect_set("leaf").alias("leaves")).withColumn("qb", F.pmod(F.xxhash64("qid"), parts(q_parts, "shard")).cast("long"))
    key = ("shard", "vb", "qb")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_scan(dim, k), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
