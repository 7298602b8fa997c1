"""A hierarchical Pitman-Yor language model over words.

Restaurants in three levels: one for each word before (or the start of a text), whose parent is one
of `contexts` classes of words (a hash of the last two bytes), whose parent is the root. The root's
base is diffuse: a new dish there is a word not seen in training. Customers are the training tokens;
the tables of a restaurant are its parent's customers. How they sit is sampled by Gibbs sweeps: all
customers of a dish in a restaurant are taken out and seated again, given the tables elsewhere; one
by one up to 31, from then on in leaps of a sixteenth of those seated, whose new tables are one
Poisson or normal draw at the leap's first table count. Words are independent given the
restaurants' totals, so a sweep is one pass over the words' pairs, with totals from the sweep
before. Draws come from hashes of word, context and sweep: a task that runs again sits its customers
alike. Predictive probabilities are averaged over the last sweeps.

A word's number holds its class in the low bits, and a word before is named by its number. Words and
restaurants are dealt into the same parts. In a sweep each part sends the tables of its words to the
parts of their restaurants, added up by restaurant, and gets the restaurants' totals back. Texts are
cut into words once and dealt into chunks of bounded size, which keep numbers and not texts. A chunk
asks each part once, with the pairs it needs, so what moves follows the distinct pairs of chunks and
not tokens. Words of a chunk are in order of class and number: the pairs of a word lie class by class.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, textkit

END = np.uint64(0xE0D0F7E875A11CE5)
CLASS = np.uint64(511)
LINKS = "part int, bucket int, sweep int, a binary, b binary, chunk long, d binary"
CHUNK_BYTES = 9 << 20
TURNS = 4  # in which chunks ask and are answered, so that a quarter of the pairs is on disk at a time


@functools.lru_cache(4)
def _classes(contexts: int) -> np.ndarray:
    """The class of a word, from 1 on, by its last two bytes."""
    return np.uint64(1) + textkit.mix(np.arange(1 << 16, dtype=np.uint64), 0xC0) % np.uint64(contexts)


def tokens(data: np.ndarray, offsets: np.ndarray, contexts: int):
    """Words' numbers (a hash; class in the low bits, 0: the end) with an end for each text, and their rows."""
    rows = len(offsets) - 1
    words, owner, tails = [], [], []
    for i, j in textkit.slices(offsets):
        b, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, row, h = textkit.word_hashes(b, o)
        last = textkit.LOWER[b[end - 1]].astype(np.uint16) if len(end) else np.zeros(0, np.uint16)
        before = np.where(end - start > 1, textkit.LOWER[b[np.maximum(end - 2, 0)]], 0).astype(np.uint16) if len(end) else last
        words.append(h)
        owner.append(row + i)
        tails.append(last * np.uint16(256) + before)
    h = np.concatenate(words) if words else np.zeros(0, np.uint64)
    row = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    tail = np.concatenate(tails) if tails else np.zeros(0, np.uint16)
    count = np.bincount(row, minlength=rows)
    n = len(h) + rows
    all_h, all_row = np.full(n, END & ~CLASS), np.repeat(np.arange(rows, dtype=np.int32), count + 1)
    place = np.arange(len(h)) + row
    all_h[place] = (h & ~CLASS) | _classes(contexts)[tail]
    return all_h, all_row


def part_of(word: np.ndarray, parts: int) -> np.ndarray:
    return (textkit.mix(word, 0x9A27) % np.uint64(parts)).astype(np.int64)


def by_part(part: np.ndarray, parts: int) -> np.ndarray:
    """A stable order by part; sixteen bits sort by radix."""
    return np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")


def _bin(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _zip(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_bin(values))


def _unzip(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _planes(values: np.ndarray) -> bytes:
    """Numbers compressed byte by byte: the high bytes are few."""
    size = values.dtype.itemsize
    return _zip(values.view(np.uint8).reshape(-1, size).T)


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(_unzip(data, "u1").reshape(size, -1).T).view(kind).reshape(-1)


def _by_class(word: np.ndarray) -> np.ndarray:
    """A word's number with the class in the high bits."""
    return (word << np.uint64(55)) | (word >> np.uint64(9))


def _by_hash(word: np.ndarray) -> np.ndarray:
    """Back from _by_class."""
    return (word << np.uint64(9)) | (word >> np.uint64(55))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's place among them; by a hash table."""
    at, found = pd.factorize(values)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[at]


CHUNK = pa.schema([("chunk", pa.int64()), ("rows", pa.binary()), ("words", pa.binary()), ("at", pa.binary())])


def _chunks(contexts: int, limit: int):
    """Rows of (chunk, rows, words, at): documents of about `limit` bytes; of each its id, whether it is learnt from and
    its number of tokens, then the distinct words of all in order of class and number, and each token's place there."""

    def run(batches):
        pid, number, held, said, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as out:
                out.write_table(whole)
            rows = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            word, at = _distinct(np.concatenate(said))
            steps = np.diff(word, prepend=np.uint64(0))
            return _rows(CHUNK, [(pid + number, rows, _planes(steps), _planes(at.astype("<u4")))]).to_batches()

        for batch in batches:
            for part, data, offsets in textkit.segments(batch):
                h, row = tokens(data, offsets, contexts)
                said.append(_by_class(h))
                n = pa.array(np.bincount(row, minlength=part.num_rows))
                held.append(pa.RecordBatch.from_arrays([part.column("id"), part.column("train"), n], ["id", "train", "n"]))
                size += len(data) + 16 * part.num_rows
                if size >= limit:
                    yield from flush()
                    number, held, said, size = number + 1, [], [], 0
        if held:
            yield from flush()

    return run


def _open(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows)).read_all()


def _asked(table: pa.Table, words: bytes, places: bytes):
    """The distinct words of a chunk and (word, word before) pairs in order, and where each token's is."""
    word = _by_hash(np.cumsum(_unplanes(words, "<u8"), dtype=np.uint64))
    at = _unplanes(places, "<u4").astype(np.int64)
    n = np.asarray(table.column("n"))
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    before = np.concatenate([[0], at[:-1]])
    before[np.cumsum(n) - n] = 0  # the end of a text is the one word of class 0
    key, pair = np.unique(at * len(word) + before, return_inverse=True)
    owner = key // len(word)
    return word, owner, key - owner * len(word), pair, row


def _new(owner: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Where pairs of another word or class begin, in pairs by word and class."""
    return np.append(True, (owner[1:] != owner[:-1]) | (cls[1:] != cls[:-1]))[: len(owner)]


ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("w", pa.binary()), ("sizes", pa.binary()), ("context", pa.binary()), ("n", pa.binary())])


def _requests(parts: int, counts: bool):
    """One row by chunk and part: its words there, their numbers of pairs, the words before, and
    training counts (of all that have any) or none (of all)."""

    def run(batches):
        for batch in batches:
            for chunk in batch.to_pylist():
                table = _open(chunk["rows"])
                word, owner, before, pair, row = _asked(table, chunk["words"], chunk["at"])
                n = None
                if counts:
                    train = np.asarray(table.column("train").combine_chunks().cast(pa.int8()))[row]
                    n = np.bincount(pair, train, len(owner)).astype("<u4")
                    keep = n > 0
                    owner, before, n = owner[keep], before[keep], n[keep]
                part = part_of(word, parts)[owner]
                order = by_part(part, parts)
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in np.flatnonzero(np.diff(ends)):
                    i = order[ends[p] : ends[p + 1]]
                    head = np.flatnonzero(np.append(True, owner[i[1:]] != owner[i[:-1]]))
                    who, size = owner[i[head]], np.diff(np.append(head, len(i)))
                    out.append((int(p), chunk["chunk"], _bin(word[who]), _bin(size.astype("<i4")), _bin(word[before[i]]), _bin(n[i]) if counts else None))
                yield from _rows(ASK, out).to_batches()

    return run


COUNTS = pa.schema([("part", pa.int32()), ("w", pa.binary()), ("sizes", pa.binary()), ("u", pa.binary()), ("at", pa.binary()), ("n", pa.binary())])


def _merge(parts: int):
    """The counts of a part over all chunks, by word, class and word before; the words before by part and number."""

    def run(table):
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        w, sizes, context, n = read("w", "<u8"), read("sizes", "<i4"), read("context", "<u8"), read("n", "<u4")
        word, at = _distinct(w)
        u, of = _distinct(_by_class(context))
        key = np.repeat(at, sizes) * len(u) + of
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(n[order].astype(np.uint64), head)
        own, of = np.divmod(key[head], len(u))
        u = _by_hash(u)
        by = np.lexsort((u, part_of(u, parts)))
        place = np.empty(len(u), np.int64)
        place[by] = np.arange(len(u))
        size = np.bincount(own, minlength=len(word))
        return _rows(COUNTS, [(table.column("part")[0].as_py(), _bin(word), _zip(size.astype("<i4")), _bin(u[by]), _bin(place[of].astype("<u4")), _zip(total))])

    return run


class Counts:
    """A part's pairs: words, each pair's word, place of its restaurant in u, and customers. ends: where each part's restaurants lie in u."""

    def __init__(self, table: pa.Table, parts: int):
        row = table.to_pylist()[0]
        self.part = row["part"]
        self.word, self.u = np.frombuffer(row["w"], "<u8"), np.frombuffer(row["u"], "<u8")
        self.at = np.frombuffer(row["at"], "<u4").astype(np.int64)
        self.n = _unzip(row["n"], "<u8").astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.word)), _unzip(row["sizes"], "<i4"))
        self.ends = np.searchsorted(part_of(self.u, parts), np.arange(parts + 1))
        has = np.zeros(len(self.u), bool)
        has[self.at[self.n > 1]] = True
        self.moving = np.flatnonzero(has)  # restaurants whose tables may change
        self.moving_ends = np.searchsorted(self.moving, self.ends)

    @property
    def context(self) -> np.ndarray:
        return self.u[self.at]


class Totals:
    """Of all restaurants: customers and tables by context, and those of the root."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, dishes: int, d0: float):
        self.customers, self.tables, self.dishes, self.d0 = customers, tables, dishes, d0

    @property
    def root(self) -> float:
        return float(self.tables.sum())


class Model:
    """Discount and strength of contexts, strength of the root, and the totals before and after each sweep."""

    def __init__(self, d: float, theta: float = 1.0, theta0: float = 1.0):
        self.d, self.theta, self.theta0 = d, theta, theta0
        self.sweeps: list[Totals] = []

    def base(self, t: Totals, c0: np.ndarray) -> np.ndarray:
        """The root's predictive probability of a dish with c0 customers there; 0: a new dish."""
        new = self.theta0 + t.d0 * t.dishes
        return np.where(c0 > 0, c0 - t.d0, new) / (self.theta0 + t.root)

    def back(self, t: Totals) -> np.ndarray:
        """By context: the probability of asking the root."""
        return (self.theta + self.d * t.tables) / (self.theta + t.customers)

    def seat(self, word: np.ndarray, owner: np.ndarray, context: np.ndarray, n: np.ndarray, upto: int):
        """Tables by pair after each of `upto` sweeps. word: hashes; owner: the pair's word."""
        tables = np.ones(len(n), np.int64)
        out = []
        for sweep in range(upto):
            tables = self.sweep(sweep, word, owner, context, n, tables)
            out.append(tables)
        return out

    def sweep(self, sweep: int, word, owner, context, n, tables) -> np.ndarray:
        """A single customer has one table; only the others are seated."""
        t = self.sweeps[sweep]
        out, i = np.ones(len(n), np.int64), np.flatnonzero(n > 1)
        own = np.bincount(owner, tables, len(word))[owner[i]] - tables[i]
        rng = Draws(word[owner[i]] ^ textkit.mix(context[i].astype(np.uint64), sweep + 1))
        out[i] = self._reseat(n[i], self.base(t, own), t.tables[context[i]] - tables[i], rng)
        return out

    def _reseat(self, n, p0, others, rng):
        order = np.argsort(-n, kind="stable")
        size, p, rest = n[order], p0[order], others[order]
        t = np.ones(len(n), np.int64)
        m, step = 1, 0
        while len(size) and m < size[0]:
            leap = max(1, m // 16)
            active = int(np.searchsorted(-size, -m, "left"))
            a = (self.theta + self.d * (rest[:active] + t[:active])) * p[:active]
            new = a / (a + np.maximum(m - self.d * t[:active], 1e-9))
            many = np.minimum(leap, size[:active] - m)
            t[:active] += rng.binomial(order[:active], many, new, step)
            m, step = m + leap, step + 1
        out = np.empty(len(n), np.int64)
        out[order] = t
        return np.minimum(out, n)


class Pairs:
    """The restaurants of words before: their discount, over a Model of classes."""

    def __init__(self, d: float, upper: Model):
        self.own, self.upper = Model(d), upper

    def entries(self, owner, context):
        """The class entries (their words and classes) and each pair's entry."""
        key = owner * 512 + (context & CLASS).astype(np.int64)
        if (key[1:] >= key[:-1]).all():
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            entry, at = key[new], np.cumsum(new) - 1
        else:
            entry, at = np.unique(key, return_inverse=True)
        return entry // 512, entry % 512, at

    def step(self, word, owner, context, n, entries, t, tk, sweep: int, tables):
        """One sweep: tables by pair, customers and tables by entry. tables: of each pair's restaurant before it.
        A single customer has one table, whatever is drawn: only pairs of several are seated."""
        k_owner, k_cls, at = entries
        up, totals, many = self.upper, self.upper.sweeps[sweep], np.flatnonzero(n > 1)
        own, mat, tm = owner[many], at[many], t[many]
        mcls = k_cls[mat]
        nk = np.bincount(at, t, len(k_owner)).astype(np.int64)
        alone = nk[mat] == tm  # without this pair the class has no such dish
        others = np.where(alone, 0, np.maximum(nk[mat] - tm - up.d * tk[mat], 0))
        c0 = np.bincount(k_owner, tk, len(word))[own] - np.where(alone, tk[mat], 0)
        p = others / (up.theta + totals.customers[mcls]) + up.back(totals)[mcls] * up.base(totals, c0)
        t = t.copy()
        t[many] = self.own._reseat(n[many], p, tables[many] - tm, Draws(word[own] ^ textkit.mix(context[many], sweep + 1)))
        nk = np.bincount(at, t, len(k_owner)).astype(np.int64)
        return t, nk, up.sweep(sweep, word, k_owner, k_cls, nk, tk)

    def seat(self, word, owner, context, n, links: list[np.ndarray]):
        """The class entries (their words, classes, and each pair's entry), and at the start and after each sweep
        tables by pair, customers and tables by entry. links: by sweep, the tables of each pair's restaurant before it."""
        entries = self.entries(owner, context)
        t, tk = np.ones(len(n), np.int64), np.ones(len(entries[0]), np.int64)
        out = [(t, np.bincount(entries[2], t, len(tk)).astype(np.int64), tk)]
        for sweep, tables in enumerate(links):
            t, nk, tk = self.step(word, owner, context, n, entries, t, tk, sweep, tables)
            out.append((t, nk, tk))
        return *entries, out


class Draws:
    """Uniform and binomial draws from hashes: the same for the same seed, wherever it is drawn."""

    def __init__(self, seed: np.ndarray):
        self.seed = seed

    def binomial(self, at: np.ndarray, n: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
        """n trials: one by one for one, else a rounded normal draw (n is large when p is small or large)."""
        u = (textkit.mix(self.seed[at], 0x5EED + step) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        one = (u < p).astype(np.int64)
        if n.max(initial=0) <= 1:
            return one * (n > 0)
        v = (textkit.mix(self.seed[at], 0xBEEF + step) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        normal = np.sqrt(-2 * np.log(np.maximum(u, 1e-300))) * np.cos(2 * np.pi * v)
        mean = n * p
        # small means by inversion of the Poisson law, large ones by the normal law
        k = np.rint(mean + normal * np.sqrt(mean * (1 - p))).astype(np.int64)
        left = np.flatnonzero((mean < 12) & (n > 1))
        k[left], mean, u = 0, mean[left], u[left]
        term, cum = np.exp(-mean), np.zeros(len(left))
        for i in range(40):
            cum += term
            more = u > cum
            left, mean, u, term, cum = left[more], mean[more], u[more], term[more], cum[more]
            if not len(left):
                break
            k[left] += 1
            term = term * mean / (i + 1)
        return np.where(n <= 1, one * (n > 0), np.clip(k, 0, n))


SENT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("x", pa.list_(pa.float64()))])
LINK = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("sweep", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("chunk", pa.int64()), ("d", pa.binary())])
SELF, ASKED, STATE = -2, -3, -4  # buckets of a part's own restaurants, of chunks' questions, and of how a part's customers sit


def _links(right: pa.Table, x: Counts, sweep: int) -> np.ndarray:
    """The tables of each pair's restaurant before a sweep: those at the start, and what came on top."""
    total, more = np.zeros(len(x.u), np.int64), np.zeros(len(x.moving), np.int64)
    for r in right.select(["bucket", "sweep", "b"]).to_pylist():
        b = r["bucket"]
        if b >= 0 and r["sweep"] == 0:
            total[x.ends[b] : x.ends[b + 1]] = np.frombuffer(r["b"], "<u4")
        elif b >= 0 and r["sweep"] == sweep:
            more[x.moving_ends[b] : x.moving_ends[b + 1]] = np.frombuffer(r["b"], "<u4")
    total[x.moving] += more
    return total[x.at]


def _state(right: pa.Table, x: Counts, sweep: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables by pair and by entry after a sweep; before the first, one each."""
    t, tk = np.ones(len(x.n), np.int64), np.ones(entries, np.int64)
    for r in right.filter(pa.compute.equal(right.column("bucket"), STATE)).to_pylist():
        if r["sweep"] == sweep:
            t[x.n > 1], tk[:] = _unzip(r["a"], "<u4"), _unzip(r["b"], "<u4")
    return t, tk


def _stats(model: Pairs, upto: int, contexts: int, parts: int):
    """The last sweep: how customers sit, tables by restaurant for each part (first all, then what came on top of that
    where any may), and one row (bucket -1) of counts of counts and, by class, customers and tables."""

    def run(key, left, right):
        if left.num_rows == 0:
            return _rows(SENT, [])
        x = Counts(left, parts)
        context = x.context
        entries = model.entries(x.owner, context)
        k_owner, k_cls, at = entries
        t, tk = _state(right, x, upto - 1, len(k_owner))
        nk = np.bincount(at, t, len(tk)).astype(np.int64)
        if upto:
            t, nk, tk = model.step(x.word, x.owner, context, x.n, entries, t, tk, upto - 1, _links(right, x, upto - 1))
        c0 = np.bincount(k_owner, tk, len(x.word))
        numbers = [*(int((v == i).sum()) for v in (x.n, nk, c0) for i in (1, 2)), len(x.word), int(x.n.sum())]
        facts = [float(i) for i in numbers] + np.bincount(k_cls, nk, contexts + 1).tolist() + np.bincount(k_cls, tk, contexts + 1).tolist()
        if upto:
            u, ends, total = x.u[x.moving], x.moving_ends, np.bincount(x.at, t - 1, len(x.u))[x.moving]
        else:
            u, ends, total = x.u, x.ends, np.bincount(x.at, minlength=len(x.u))
        total = total.astype("<u4")
        sent = [(x.part, int(b), _bin(u[ends[b] : ends[b + 1]]), _bin(total[ends[b] : ends[b + 1]]), None) for b in np.flatnonzero(np.diff(ends))]
        state = (x.part, STATE, _zip(t[x.n > 1].astype("<u4")), _zip(tk.astype("<u4")), None)
        return _rows(SENT, [(x.part, -1, None, None, facts), state, *sent])

    return run


def _add(table):
    """The sum of the lists of a group of parts."""
    x = table.column("x").combine_chunks()
    total = np.asarray(x.flatten()).reshape(len(x), -1).sum(axis=0)
    return pa.table({"x": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _totals(sweep: int):
    """Tables of a bucket's restaurants added up: in the order in which each part sent them, and once for the bucket itself."""

    def run(table):
        sent = table.to_pylist()
        each = [np.frombuffer(r["a"], "<u8") for r in sent]
        u, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.frombuffer(r["b"], "<u4") for r in sent])).astype("<u4")
        back, bucket = total[at], sent[0]["bucket"]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        rows = [(r["part"], bucket, sweep, None, _bin(back[ends[i] : ends[i + 1]]), None, None) for i, r in enumerate(sent)]
        return _rows(LINK, [*rows, (bucket, SELF, sweep, _bin(u), _bin(total), None, None)])

    return run


ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("c", pa.binary()), ("tables", pa.binary()), ("own", pa.binary()), ("parent", pa.binary())])


def _find(have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values in a sorted array, and whether they are there."""
    if len(have) == 0:
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    i = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return i, have[i] == want


FINAL = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("w", "c", "sizes", "cls", "nk", "tk", "one", "many", "n", "t", "u", "tables"))])


def _name(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A pair by 48 bits: its part's pairs are few beside that."""
    return textkit.mix(context ^ textkit.mix(word, 0x3A), 0x3B) & np.uint64((1 << 48) - 1)


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def _final(model: Pairs, sweeps: int, keep: int, parts: int):
    """What answers need of a part: its words and entries, names of its pairs (of one customer, and of several with
    theirs), and tables of its words as restaurants, in the sweeps that are kept."""

    def run(key, left, right):
        if left.num_rows == 0:
            return _rows(FINAL, [])
        x = Counts(left, parts)
        context = x.context
        k_owner, k_cls, at = model.entries(x.owner, context)
        states = [_state(right, x, s, len(k_owner)) for s in range(sweeps - keep + 1, sweeps + 1)]
        name = _name(context, x.word[x.owner])
        one, many = name[x.n == 1], np.flatnonzero(x.n > 1)
        one.sort()
        many = many[np.argsort(name[many])]
        mine = {r["sweep"]: (np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<u4")) for r in right.filter(pa.compute.equal(right.column("bucket"), SELF)).to_pylist()}
        u, start = mine.get(0, (np.zeros(0, np.uint64), np.zeros(0, "<u4")))
        tables = np.tile(start.astype("<u4"), (keep, 1))
        for k in range(keep):
            have, more = mine.get(sweeps - keep + 1 + k, (u[:0], start[:0]))
            tables[k, np.searchsorted(u, have)] += more
        nk = np.stack([np.bincount(at, t, len(k_owner)) for t, _ in states]).astype("<u4")
        row = (
            x.part, _bin(x.word), _zip(np.bincount(x.owner, x.n, len(x.word)).astype("<u8")), _zip(np.bincount(k_owner, minlength=len(x.word)).astype("<u4")), _zip(k_cls.astype("<u2")),
            _zip(nk), _zip(np.stack([tk for _, tk in states]).astype("<u4")), _six(one), _six(name[many]), _zip(x.n[many].astype("<u8")), _zip(np.stack([t[many] for t, _ in states]).astype("<u4")), _bin(u), _zip(tables),
        )
        return _rows(FINAL, [row])

    return run


def _answers(model: Pairs, sweeps: int, keep: int, parts: int):
    """To each question of a chunk: of its words the counts and, as words before, the tables by sample; of its pairs
    what their restaurants hold themselves; of its (word, class) entries the class's probability by sample."""
    up, kept = model.upper, model.upper.sweeps[-keep:]
    unseen = np.array([up.base(t, np.zeros(1))[0] for t in kept])
    back = np.stack([up.back(t) for t in kept], axis=1)

    def run(key, left, right):
        if left.num_rows:
            r = left.to_pylist()[0]
            word, one, many = np.frombuffer(r["w"], "<u8"), _unsix(r["one"]), _unsix(r["many"])
            c, k_cls = _unzip(r["c"], "<u8").astype(np.float64), _unzip(r["cls"], "<u2").astype(np.int64)
            k_owner = np.repeat(np.arange(len(word)), _unzip(r["sizes"], "<u4"))
            nk, tk = (_unzip(r[x], "<u4").reshape(keep, -1) for x in ("nk", "tk"))
            n, t = _unzip(r["n"], "<u8").astype(np.float64), _unzip(r["t"], "<u4").reshape(keep, -1)
            u, u_tables = np.frombuffer(r["u"], "<u8"), _unzip(r["tables"], "<u4").reshape(keep, -1)
        else:  # no word of this part was learnt
            word = one = many = u = np.zeros(0, np.uint64)
            c, n, k_owner, k_cls = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
            nk = tk = t = u_tables = np.zeros((keep, 0), np.int64)
        own = np.maximum(n - model.own.d * t, 0).mean(axis=0)
        k_own = np.stack([np.maximum(nk[i] - up.d * tk[i], 0) / (up.theta + v.customers[k_cls]) for i, v in enumerate(kept)], axis=1)
        p0 = np.stack([up.base(v, np.bincount(k_owner, tk[i], len(word))) for i, v in enumerate(kept)], axis=1)
        entry = k_owner * 512 + k_cls
        place = np.searchsorted(one, many)
        have, value = np.insert(one, place, many), np.insert(np.full(len(one), 1 - model.own.d, "<f4"), place, own)
        out = []
        for r in right.filter(pa.compute.equal(right.column("bucket"), ASKED)).to_pylist():
            w, size, asked = np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<i4"), np.frombuffer(r["d"], "<u8")
            who = np.repeat(np.arange(len(w)), size)
            i, known = _find(word, w)
            count, root = np.zeros(len(w)), np.tile(unseen, (len(w), 1))
            count[known], root[known] = c[i[known]], p0[i[known]]
            tables = np.zeros((len(w), keep), "<f4")
            j, there = _find(u, w)
            tables[there] = u_tables[:, j[there]].T
            j, there = _find(have, _name(asked, w[who]))
            pair = np.zeros(len(who), "<f4")
            pair[there] = value[j[there]]
            cls = (asked & CLASS).astype(np.int64)
            ask = np.flatnonzero(_new(who, cls))
            a, cls = who[ask], cls[ask]
            parent = back[cls] * root[a]
            j, there = _find(entry, i[a] * 512 + cls)
            there &= known[a]
            parent[there] += k_own[j[there]]
            out.append((r["chunk"], r["part"], _bin(count), _bin(tables), _bin(pair), _bin(parent.astype("<f4"))))
        return _rows(ANSWER, out)

    return run


def _score(model: Pairs, keep: int, parts: int, n_train: int, n_types: int, kind: pa.DataType):
    d, theta = model.own.d, model.own.theta

    def run(key, left, right):
        done = []
        answers = right.to_pylist()
        for chunk in left.to_pylist():
            table = _open(chunk["rows"])
            word, owner, before, pair, row = _asked(table, chunk["words"], chunk["at"])
            new = _new(owner, (word & CLASS)[before])
            w_part = part_of(word, parts)
            part = w_part[owner]
            order_w, order = by_part(w_part, parts), by_part(part, parts)
            ends_w, ends = np.searchsorted(w_part[order_w], np.arange(parts + 1)), np.searchsorted(part[order], np.arange(parts + 1))
            if sorted(r["part"] for r in answers) != np.flatnonzero(np.diff(ends_w)).tolist():
                raise ValueError("the answers do not match the chunk's words")
            c, tables, own, parent = np.zeros(len(word)), np.zeros((len(word), keep)), np.zeros(len(owner)), np.zeros((len(owner), keep))
            for r in answers:
                p = r["part"]
                i, j = order_w[ends_w[p] : ends_w[p + 1]], order[ends[p] : ends[p + 1]]
                c[i], tables[i] = np.frombuffer(r["c"]), np.frombuffer(r["tables"], "<f4").reshape(-1, keep)
                own[j] = np.frombuffer(r["own"], "<f4")
                parent[j] = np.frombuffer(r["parent"], "<f4").reshape(-1, keep)[np.cumsum(new[j]) - 1]
            p = (own + ((theta + d * tables[before]) * parent).mean(axis=1)) / (theta + c[before])
            value, base, known = np.log10(p), np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1))), c > 0
            rows = table.num_rows
            done.append(
                pa.table(
                    {
                        "id": table.column("id").cast(kind),
                        "train": table.column("train"),
                        "n_tokens": pa.array(np.bincount(row, minlength=rows)),
                        "n_known": pa.array(np.bincount(row, known[owner][pair], rows).astype(np.int64)),
                        "train_tokens": pa.array(np.full(rows, n_train)),
                        "base_score": pa.array(np.bincount(row, base[owner][pair], rows)),
                        "score": pa.array(np.bincount(row, value[pair], rows)),
                    }
                )
            )
        return pa.concat_tables(done)

    return run


def score_texts(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", contexts: int = 256, sweeps: int = 3, keep: int = 2) -> DataFrame:
    """One row per document: id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    train: the boolean column (or SQL expression) of the texts to learn from; null counts as false.
    base_score is that of additively smoothed single words, score that of the model, both log10 of
    the whole text with its end. A word not seen in training has the probability of a new dish.
    Null and empty texts are an end alone; with nothing to learn from, every word is a new dish.
    Repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    contexts: 1 to 510 classes between the words before and the root. keep: of the sweeps, the last ones that are averaged.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if not 1 <= contexts <= 510 or not 1 <= keep <= sweeps:
        raise ValueError("contexts must lie in 1..510 and keep in 1..sweeps")
    spark = scratch.session(docs)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    kind = base.schema["id"].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.mapInArrow(_chunks(contexts, CHUNK_BYTES), "chunk long, rows binary, words binary, at binary").repartition(parts, "chunk")
    chunks = scratch.bucketed(dealt, scratch.table("chunks"), parts, "chunk")  # the answers come to the texts
    del dealt  # a frame that is held keeps its shuffle files
    scratch.release(spark)
    ask = "part int, chunk long, w binary, sizes binary, context binary, n binary"
    name = scratch.table("counts")
    said = chunks.mapInArrow(_requests(parts, True), ask).repartition(parts, "part").groupBy("part")
    said = said.applyInArrow(_merge(parts), "part int, w binary, sizes binary, u binary, at binary, n binary")
    counts = scratch.bucketed(said, name, parts, "part").groupBy("part")  # totals come to the counts
    del said
    scratch.release(spark)

    rate = lambda a, b: min(0.95, max(0.05, (a + 0.5) / (a + 2 * b + 1.0)))
    links = spark.createDataFrame([], LINKS)
    model, n_types, n_train = Pairs(0.5, Model(0.5)), 0, 0
    for sweep in range(sweeps + 1):
        sent = counts.cogroup(links.groupBy("part")).applyInArrow(_stats(model, sweep, contexts, parts), "part int, bucket int, a binary, b binary, x array<double>")
        path = scratch.folder(spark, f"lm-sent-{sweep}")
        sent.write.option("compression", "zstd").parquet(path)
        sent = spark.read.schema(sent.schema).parquet(path)
        facts = sent.where("bucket = -1").select("x", F.pmod("part", F.lit(16)).alias("k")).groupBy("k").applyInArrow(_add, "x array<double>")
        x = np.zeros(8 + 2 * (contexts + 1))
        for r in facts.collect():
            x += np.array(r["x"])
        if sweep == 0:
            model, n_types, n_train = Pairs(rate(x[0], x[1]), Model(rate(x[2], x[3]))), int(x[6]), int(x[7])
        model.upper.sweeps.append(Totals(x[8 : 9 + contexts].copy(), x[9 + contexts :].copy(), n_types, rate(x[4], x[5])))
        totals = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(_totals(sweep), LINKS)
        state = sent.where(F.col("bucket") == STATE).select("part", "bucket", F.lit(sweep).alias("sweep"), "a", "b", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("d"))
        links = links.unionByName(scratch.write(totals.unionByName(state), f"lm-totals-{sweep}"))
        scratch.remove(spark, path)
        del sent, totals, state, facts
        scratch.release(spark)

    out = T.StructType([*(T.StructField(c, base.schema[c].dataType) for c in ("id", "train")), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    score = _score(model, keep, parts, n_train, n_types, to_arrow_type(kind))
    final = counts.cogroup(links.groupBy("part")).applyInArrow(_final(model, sweeps, keep, parts), ", ".join(f"{f.name} {'int' if f.name == 'part' else 'binary'}" for f in FINAL))
    final = scratch.bucketed(final, scratch.table("model"), parts, "part").groupBy("part")  # questions come to the model
    scratch.drop_table(spark, name)
    scratch.release(spark)
    turns = []
    for turn in range(TURNS):
        mine = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(TURNS)) == turn)
        asked = mine.mapInArrow(_requests(parts, False), ask)
        asked = asked.select("part", F.lit(ASKED).alias("bucket"), F.lit(0).alias("sweep"), F.col("w").alias("a"), F.col("sizes").alias("b"), "chunk", F.col("context").alias("d"))
        answers = final.cogroup(asked.groupBy("part")).applyInArrow(_answers(model, sweeps, keep, parts), "chunk long, part int, c binary, tables binary, own binary, parent binary")
        turns.append(scratch.write(mine.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, out), f"lm-scores-{turn}"))
        del asked, answers
        scratch.release(spark)
    scored = functools.reduce(DataFrame.unionByName, turns)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("id", id_col)
