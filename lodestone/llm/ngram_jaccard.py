"""N-gram Jaccard join by PartEnum signatures.

Sets are the distinct word shingles of whole texts. Equal sets collapse to one class first, known by
two 64-bit hashes. Sizes are cut into bands so that two similar sets lie in the same band or in
neighbours; a band fixes how many features two similar sets can differ in (k). The feature domain is
partitioned by hash, and enumerated subsets of the partitions give signatures such that two
sets with at most k differences share one at least:

* k = 0: the whole set is the signature;
* k <= 3: n2 parts, every subset of n2 - k parts;
* larger: n1 = k + a parts, each a signature of its own; k differences leave a of them equal.

A part without features says nothing, and would gather unrelated sets. Such ones are left out, and a
set with e of them shares a - e signatures at least with each partner. Where that is less than one,
the set emits the empty parts too. No link is lost.

Passages that many texts share make many of them agree on a few parts. So signatures are counted
first, and a set that must share t of its L shared ones looks only at its L - t + 1 rarest: the
rarest one that two partners share is among these for both. What is left ties sets into families (a star
around the least member of each signature, then connected components), so edges stay linear in
the rows. A family's texts meet once, in blocks of bounded count and size and in every pair of
blocks, where an inverted index counts all intersections: exact links, degrees and a spanning forest,
and no pair is emitted but the forest's. Every link is verified on the exact sets.

Signatures travel as bytes: a task gathers some, collapses copies, and sends each part of the
signature space one message. A signature that very many sets of a task have is sent there once, with
its count; its members travel to any part, and meet the count in a join that can be split.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, scratch, textkit

FLUSH, HOT = 1 << 20, 256  # signatures that a task gathers before it sends them; members of one among them that make it hot


def bands(num: int, den: int, most: int) -> list[tuple[int, int]]:
    """(least, largest) sizes; a set's partners lie in its band or a neighbour."""
    out, low = [], 1
    while low <= most:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return out


class Scheme:
    """The signature scheme of one threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low: np.ndarray = np.zeros(0, np.int64)
        self.k: np.ndarray = np.zeros(0, np.int64)

    def grow(self, most: int) -> None:
        if len(self.low) and self.high >= most and len(self.low) > 1:
            return
        found = bands(self.num, self.den, 2 * most + 16)
        self.low = np.array([a for a, _ in found])
        self.k = np.array([2 * b * (self.den - self.num) // (self.den + self.num) for _, b in found])
        self.high = found[-2][1]

    def signatures(self, row: np.ndarray, feature: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, signature) of distinct features by row."""
        r, _, s, _ = self.counted(row, feature, rows)
        return r, s

    def counted(self, row: np.ndarray, feature: np.ndarray, rows: int):
        """(row, band step, signature) of distinct features by row, and by row and step how many a partner shares at least."""
        size = np.bincount(row, minlength=rows)
        self.grow(int(size.max(initial=1)))
        own = np.searchsorted(self.low, np.maximum(size, 1), "right") - 1
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        need = np.ones((rows, 2), np.int64)
        for step in (0, 1):
            band = own + step
            for r, s in self._emit(row, feature, rows, size, band, self.k[band], need[:, step]):
                out.append((r, np.full(len(r), step), s))
        return *(np.concatenate(x) for x in zip(*out, strict=True)), need

    def _emit(self, row, feature, rows, size, band, k, need):
        for level in (0, 1, 2, 3):
            mine = (k == level) & (size > 0)
            if mine.any():
                parts = (1, 3, 5, 6)[level]
                subsets = [(0,)] if level == 0 else list(itertools.combinations(range(parts), parts - level))
                yield from self._cells(row, feature, rows, band, mine, parts, subsets, np.ones(rows, np.int64), np.ones(rows, np.int64), need)
        mine = (k > 3) & (size > 0)
        if mine.any():
            agree = 3 + k // 6
            yield from self._cells(row, feature, rows, band, mine, 1, [(0,)], k + agree, agree, need)

    @staticmethod
    def _cells(row, feature, rows, band, mine, n2, subsets, n1, agree, need):
        """Signatures over n1 parts of n2 cells; agree: the parts at least that two similar sets agree on."""
        who = np.flatnonzero(mine)
        width = n1[who] * n2
        base = np.zeros(rows, np.int64)
        base[who] = np.concatenate([[0], np.cumsum(width)[:-1]])
        use = mine[row]
        r, f = row[use], feature[use]
        salted = textkit.mix(f, 0x7A3)
        cell = base[r] + (salted % (n1[r] * n2).astype(np.uint64)).astype(np.int64)
        total = int(width.sum())
        sums, count = np.zeros(total, np.uint64), np.bincount(cell, minlength=total)
        np.add.at(sums, cell, textkit.mix(f, 0x11F))
        parts = n1[who]
        owner = np.repeat(who, parts)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        sums, count = sums.reshape(-1, n2), count.reshape(-1, n2)
        filled = np.stack([count[:, list(s)].sum(axis=1) for s in subsets], axis=1) > 0
        bare = np.bincount(owner, ~filled.all(axis=1), rows).astype(np.int64)
        special = bare >= agree
        need[who] = np.where(special, 1, agree - bare)[who]
        for number, s in enumerate(subsets):
            value = sums[:, list(s)].sum(axis=1, dtype=np.uint64)
            value = textkit.mix(textkit.mix(value, number + 1) + index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + band[owner].astype(np.uint64))
            keep = filled[:, number] | special[owner]
            yield owner[keep], value[keep]


def _sets(data, offsets, n):
    """Distinct shingles by row: rows, features, sizes, and two hashes of each set."""
    rows = len(offsets) - 1
    _, _, row, h = textkit.word_hashes(data, offsets)
    row, feature = textkit.distinct(*textkit.shingles(h, row, rows, n))
    size = np.bincount(row, minlength=rows)
    hi, lo = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    np.add.at(hi, row, textkit.mix(feature, 0xA1))
    np.add.at(lo, row, textkit.mix(feature, 0xB2))
    return row, feature, size, hi, lo


def _profile(n: int):
    """(id, n, hi, lo): the size and the two hashes of each set."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in textkit.segments(batch):
                _, _, size, hi, lo = _sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(textkit.signed(hi)), pa.array(textkit.signed(lo))], ["id", "n", "hi", "lo"])

    return run


MESSAGE = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("sig", pa.binary()), ("node", pa.binary()), ("need", pa.binary())])
PAIRS, COUNTS, MEMBERS = 0, 1, 2  # kinds of messages


def _place(sig: np.ndarray, parts: int) -> np.ndarray:
    """The part of a signature: in order, by its upper half."""
    return ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _send(sig, node, need, parts: int, somewhere: int):
    """The messages of one task's signatures: six low bytes of each, its node and what its set must share."""
    order = np.argsort(sig, kind="stable")
    sig, node, need = sig[order], node[order], need[order]
    new = np.append(True, sig[1:] != sig[:-1])
    head = np.flatnonzero(new)
    members = np.diff(np.append(head, len(sig)))
    low = lambda x: np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    out = []

    def post(kind, s, v, t):
        part = _place(s, parts)
        ends = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        for p in np.flatnonzero(np.diff(ends)):
            i = slice(ends[p], ends[p + 1])
            out.append((int(p), kind, low(s[i]), v[i].astype("<u8").tobytes(), t[i].astype(np.uint8).tobytes()))

    hot = np.repeat(members >= HOT, members)
    post(PAIRS, sig[~hot], node[~hot], need[~hot])
    if hot.any():
        many = head[members >= HOT]
        post(COUNTS, sig[many], members[members >= HOT].astype(np.uint64), np.zeros(len(many)))
        out.append((somewhere % parts, MEMBERS, sig[hot].astype("<u8").tobytes(), node[hot].astype("<u8").tobytes(), need[hot].astype(np.uint8).tobytes()))
    yield from pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), MESSAGE, strict=True)], schema=MESSAGE).to_batches()


def _signatures(n: int, num: int, den: int, parts: int, turn: int, turns: int):
    """Messages of the signatures of one turn. A node is a set's first hash with the band step in its lowest bit."""

    def run(batches):
        scheme, held, size, somewhere = Scheme(num, den), [], 0, TaskContext.get().partitionId() * 7919
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, data, offsets in textkit.segments(batch):
                row, feature, count, hi, lo = _sets(data, offsets, n)
                fresh = np.zeros(len(count), bool)  # copies of what is held add nothing
                for i, known in enumerate(zip(hi.tolist(), lo.tolist(), strict=True)):
                    if known not in seen:
                        seen.add(known)
                        fresh[i] = True
                use = fresh[row]
                r, step, sig, need = scheme.counted(row[use], feature[use], len(count))
                if turns > 1:
                    mine = textkit.mix(sig, 0x7E) % np.uint64(turns) == turn
                    r, step, sig = r[mine], step[mine], sig[mine]
                held.append((sig, hi[r] & ~np.uint64(1) | step.astype(np.uint64), np.minimum(need[r, step], 255)))
                size += len(sig)
                if size >= FLUSH:
                    yield from _send(*(np.concatenate(x) for x in zip(*held, strict=True)), parts, somewhere)
                    held, size, somewhere = [], 0, somewhere + 1
                    seen.clear()
        if size:
            yield from _send(*(np.concatenate(x) for x in zip(*held, strict=True)), parts, somewhere)

    return run


SHARED = T.StructType([T.StructField("sig", T.LongType()), T.StructField("node", T.LongType()), T.StructField("need", T.IntegerType()), T.StructField("n", T.LongType())])


def _shared(parts: int):
    """The signatures of a part that more than one set has: (sig, node, need, n); hot ones' counts without a node, and
    members that are passed on without a count."""

    def name(part, low):
        return low * np.uint64(parts) + part

    def run(key, table):
        kind = np.asarray(table.column("kind").combine_chunks())
        read = lambda column, k: b"".join(x for x, y in zip(table.column(column).to_pylist(), kind, strict=True) if y == k)

        def six(k):
            got = np.frombuffer(read("sig", k), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(got), 8), np.uint8)
            wide[:, :6] = got
            return wide.view("<u8").reshape(-1)

        part = np.uint64(key[0].as_py())
        sig, node, need = six(PAIRS), np.frombuffer(read("node", PAIRS), "<u8"), np.frombuffer(read("need", PAIRS), np.uint8)
        hot, many = six(COUNTS), np.frombuffer(read("node", COUNTS), "<u8").astype(np.int64)
        order = np.lexsort((node, sig))
        sig, node, need = sig[order], node[order], need[order]
        keep = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))[: len(sig)]  # copies that came from several tasks
        sig, node, need = sig[keep], node[keep], need[keep]
        all_sig, at = np.unique(np.concatenate([sig, hot]), return_inverse=True)
        count = np.bincount(at, np.concatenate([np.ones(len(sig), np.int64), many]), len(all_sig)).astype(np.int64)
        n = count[at[: len(sig)]]
        two = n > 1
        hot = np.unique(hot)
        there = np.frombuffer(read("sig", MEMBERS), "<u8")
        who = np.frombuffer(read("node", MEMBERS), "<u8")
        asks = np.frombuffer(read("need", MEMBERS), np.uint8)
        sigs = np.concatenate([name(part, sig[two]), name(part, hot), name(_place(there, parts), there & np.uint64((1 << 48) - 1))])
        a, b, c = int(two.sum()), len(hot), len(there)
        fact = np.repeat([False, True, False], [a, b, c])
        nodes = np.concatenate([node[two], np.zeros(b, np.uint64), who])
        needs = np.concatenate([need[two], np.zeros(b, np.uint8), asks]).astype(np.int32)
        counts = np.concatenate([n[two], count[np.searchsorted(all_sig, hot)], np.zeros(c, np.int64)])
        passed = np.repeat([False, False, True], [a, b, c])
        return pa.table({"sig": pa.array(textkit.signed(sigs)), "node": pa.array(textkit.signed(nodes), mask=fact), "need": pa.array(needs, mask=fact), "n": pa.array(counts, mask=passed)})

    return run


def _texts(n: int):
    """Set hashes and texts, for the last read."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in textkit.segments(batch):
                _, _, _, hi, lo = _sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(hi)), pa.array(textkit.signed(lo)), part.column(1)], ["hi", "lo", "text"])

    return run


def _features(text: str, n: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return _sets(data, np.array([0, len(data)]), n)[1]


def _block_pair(n: int, num: int, den: int):
    """Links between the members of one block, or of two: forest edges and degrees (in documents)."""

    def run(key, table):
        uid, side, copies = (np.asarray(table.column(c).combine_chunks()) for c in ("uid", "side", "copies"))
        order = np.lexsort((uid, side))
        sets = [_features(table.column("text")[i].as_py(), n) for i in order.tolist()]
        uid, side, copies = uid[order], side[order], copies[order]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        by = np.lexsort((owner, flat))
        value, posting = flat[by], owner[by]
        # where each (feature, member) lies among the feature's members, to count later members only
        place = np.empty(len(flat), np.int64)
        place[by] = np.arange(len(flat))
        first = np.append(True, value[1:] != value[:-1]) if len(value) else np.zeros(0, bool)
        stop = np.append(np.flatnonzero(first)[1:], len(value))[np.cumsum(first) - 1] if len(value) else place
        starts = np.concatenate([[0], np.cumsum(size)])
        links, parent = np.zeros(len(sets), np.int64), np.arange(len(sets))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = int(parent[x])
            return x

        two = key[1].as_py() != key[2].as_py()
        edges = []
        for i in range(len(sets)):
            at = place[starts[i] : starts[i + 1]]
            low, high = at + 1, stop[at]
            count = high - low
            total = int(count.sum())
            if not total:
                continue
            where = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
            common = np.bincount(posting[where], minlength=len(sets))
            linked = np.flatnonzero(den * common >= num * (size[i] + size - common))
            linked = linked[linked > i]
            if two:
                linked = linked[side[linked] != side[i]]
            links[i] += copies[linked].sum()
            links[linked] += copies[i]
            for j in linked.tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    edges.append((int(uid[i]), int(uid[j])))
        u = uid.tolist() + [e[0] for e in edges]
        v = [None] * len(uid) + [e[1] for e in edges]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array(links.tolist() + [0] * len(edges), pa.int64())})

    return run


def _candidates(base: DataFrame, n: int, num: int, den: int, turns: int) -> DataFrame:
    """(u, v) edges between nodes such that every two similar sets lie in one component."""
    spark = base.sparkSession
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    message = "part int, kind byte, sig binary, node binary, need binary"
    found = []
    for turn in range(turns):  # a turn's shuffle goes before the next begins
        sent = base.mapInArrow(_signatures(n, num, den, parts, turn, turns), message)
        found.append(scratch.write(sent.repartition(parts, "part").groupBy("part").applyInArrow(_shared(parts), SHARED), "jaccard-shared"))
        del sent
        scratch.release(spark)
    shared = found[0]
    for more in found[1:]:
        shared = shared.unionByName(more)
    plain = shared.where("node is not null and n is not null")
    hot = shared.where("n is null").drop("n").join(shared.where("node is null").select("sig", "n"), "sig").select(*SHARED.names)
    own = Window.partitionBy("node")
    ranked = plain.unionByName(hot).distinct().withColumn("rank", F.row_number().over(own.orderBy("n", "sig"))).withColumn("all", F.count("*").over(own))
    kept = scratch.write(ranked.where(F.col("rank") <= F.col("all") - F.col("need") + 1).select("sig", F.expr("node & -2L").alias("node")), "jaccard-kept")
    heads = kept.groupBy("sig").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("sig", "u")
    edges = kept.join(heads, "sig").where("u <> node").select("u", F.col("node").alias("v")).distinct()
    edges = scratch.write(edges, "jaccard-edges")
    scratch.drop(*found, kept)
    return edges


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, block_rows: int = 512, block_bytes: int = 32 << 20, turns: int = 1) -> DataFrame:
    """One row per document: id, n_shingles, n_links, component_id.

    Two documents link when den * |A and B| >= num * |A or B|. component_id is the least id that
    links reach, the own one included; n_links is the number of documents it links with. Null,
    empty and blank texts have an empty set, link with nothing and keep their own id. Repeated rows
    are copies. Null ids are kept; they count for a component's least id only if all are null.
    Other columns are ignored, whatever their names. An empty table gives no rows. block_rows,
    block_bytes: of texts that meet in one task. turns: signatures are grouped in so many parts, so
    that less is shuffled at a time; lower similarities have more of them.
    """
    spark = scratch.session(docs)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = T.StructType([base.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n", "hi", "lo"))])
    ids = scratch.write(base.mapInArrow(_profile(n), profile), "jaccard-sets")
    classes = ids.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = scratch.write(classes.withColumn("uid", F.monotonically_increasing_id()), "jaccard-classes")
    edges = _candidates(base, n, num, den, turns)
    scratch.release(spark)

    family = graph.components(edges).withColumnRenamed("comp", "family")
    family = scratch.write(classes.withColumn("node", F.expr("hi & -2L")).join(family, "node").select("node", "uid", "hi", "lo", "family", "copies"), "jaccard-families")
    scratch.drop(edges)
    found = base.mapInArrow(_texts(n), "hi long, lo long, text string").withColumn("node", F.expr("hi & -2L"))
    found = scratch.flagged(found, family, "node", "hit").where("hit").drop("node", "hit")
    text = found.join(family.drop("node"), ["hi", "lo"]).groupBy("uid", "family", "copies").agg(F.first("text").alias("text"))
    text = scratch.write(text, "jaccard-texts")
    scratch.release(spark)
    extent = text.groupBy("family").agg(F.count("*").alias("m"), F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.octet_length("text")) / block_bytes)).cast("int").alias("blocks")).where("m > 1")
    dealt = text.join(extent.select("family", "blocks"), "family").withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "uid", "copies", F.col("mine").alias("side"), "text")
    # few bytes, much work: a fixed number of tasks, which adaptive execution would join to a few
    dealt = dealt.repartition(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), "family", "a", "b")
    links = scratch.write(dealt.groupBy("family", "a", "b").applyInArrow(_block_pair(n, num, den), "u long, v long, links long"), "jaccard-links")
    scratch.drop(text, family)
    comp = graph.components(links.where("v is not null").select("u", "v"))
    degree = links.where("v is null").groupBy(F.col("u").alias("uid")).agg(F.sum("links").alias("degree"))
    labelled = classes.join(comp.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid")).join(degree, "uid", "left")
    least = labelled.groupBy("comp").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(least, "comp").select("n", "hi", "lo", "component_id", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    labelled = scratch.write(labelled, "jaccard-labels")
    scratch.drop(classes, links)
    out = ids.join(labelled, ["n", "hi", "lo"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose id is their group's component_id: one document of each group stays.

    Rows that share an id stay or go together. A document that links with nothing stays, empty
    texts included; rows with a null id go if one of them is in a group that has another id. Columns
    stay as they are, whatever their names; an empty table gives no rows.
    """
    groups = jaccard_groups(docs, id_col, text_col, n, num, den, turns=2)
    lost = groups.where((F.col("n_shingles") > 0) & ~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("lost")).distinct()
    rows = docs.select(F.struct("*").alias("d"))
    return rows.join(lost, F.col("d").getField(id_col).eqNullSafe(F.col("lost")), "left_anti").select("d.*")
