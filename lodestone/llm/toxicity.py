"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are tagged toxic or not. Their features are hashes of the word and of its first and last
letters; sentences are the chains. Documents carry labels, tokens don't, so token tags come from
the labelled sample: in toxic documents, words or word beginnings that are far more frequent
there than in clean ones are toxic; every token of a clean document is not. The field is trained
by its conditional likelihood (forward-backward gradients). Marginals of a document's tokens give
its score by a logistic regression, fitted on labelled documents that the field has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, textkit

#: Bounds of the training sample: bytes of its texts, and tokens the field is trained on.
FIT_BYTES = 64 << 20
FIT_TOKENS = 400_000
BITS = 20
PREFIXES = (3, 4, 5, 6)
SUFFIXES = (3, 4)
N_FEATURES = 1 + len(PREFIXES) + len(SUFFIXES)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def features(data: np.ndarray, offsets: np.ndarray):
    """Start, end, row, first-of-sentence flag and hashed features (tokens x N_FEATURES)."""
    start, end = textkit.runs(_WORD[data], offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    n = len(start)
    if n == 0:
        return start, end, row, np.zeros(0, bool), np.zeros((0, N_FEATURES), np.int32)
    low = textkit.LOWER[data]
    size = end - start
    power = textkit.powers(textkit._BASE, max(*PREFIXES, *SUFFIXES))
    out = np.empty((n, N_FEATURES), np.int32)
    mask = np.uint64((1 << BITS) - 1)
    out[:, 0] = (textkit.mix(textkit.span_hashes(data, start, end), 1) & mask).astype(np.int32)
    acc, column = np.zeros(n, np.uint64), 1
    for i in range(max(PREFIXES)):
        acc += np.where(size > i, low[np.minimum(start + i, len(data) - 1)].astype(np.uint64) + np.uint64(1), 0).astype(np.uint64) * power[i]
        if i + 1 in PREFIXES:
            out[:, column] = (textkit.mix(acc, 100 + i) & mask).astype(np.int32)
            column += 1
    acc = np.zeros(n, np.uint64)
    for i in range(max(SUFFIXES)):
        acc += np.where(size > i, low[np.maximum(end - 1 - i, 0)].astype(np.uint64) + np.uint64(1), 0).astype(np.uint64) * power[i]
        if i + 1 in SUFFIXES:
            out[:, column] = (textkit.mix(acc, 200 + i) & mask).astype(np.int32)
            column += 1
    stops = np.flatnonzero(_STOP[data])
    first = np.ones(n, bool)
    first[1:] = (row[1:] != row[:-1]) | (np.searchsorted(stops, start[1:]) > np.searchsorted(stops, end[:-1]))
    return start, end, row, first, out


@dataclass
class Field:
    """weights: of a feature for the toxic tag; step: 2 x 2 log transition weights; begin, bias: of the toxic tag."""

    weights: np.ndarray
    step: np.ndarray
    begin: float = 0.0
    bias: float = 0.0

    def unary(self, feats: np.ndarray) -> np.ndarray:
        s = np.full(len(feats), self.bias)
        for i in range(feats.shape[1]):
            s += self.weights[feats[:, i]]
        return np.clip(s, -30, 30)

    def chains(self, unary: np.ndarray, first: np.ndarray):
        """Forward and backward ratios (toxic over clean) of all chains at once, long chains first."""
        e = np.exp(unary)
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(unary)))
        order = np.argsort(-length, kind="stable")
        at, length = at[order], length[order]
        t = np.exp(self.step)
        r, q = np.empty_like(e), np.ones_like(e)
        if len(at) == 0:
            return e, r, q
        active = np.searchsorted(-length, -np.arange(length[0]), "left")
        now = e[at] * np.exp(self.begin)
        r[at] = now
        for i in range(1, length[0]):
            n = active[i]
            here = at[:n] + i
            now = e[here] * (t[0, 1] + now[:n] * t[1, 1]) / (t[0, 0] + now[:n] * t[1, 0])
            r[here] = now
        now = np.ones(len(at))
        for i in range(length[0] - 2, -1, -1):
            n = active[i + 1]
            x = e[at[:n] + i + 1] * now[:n]
            now[:n] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
            q[at[:n] + i] = now[:n]
        return e, r, q

    def marginals(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of the toxic tag, by token."""
        _, r, q = self.chains(self.unary(feats), first)
        return r * q / (1 + r * q)


def train_field(feats: np.ndarray, first: np.ndarray, tag: np.ndarray, rounds: int = 70, l2: float = 1e-4) -> Field:
    """Conditional likelihood by AdaGrad over all chains; the gradient is observed less expected counts."""
    f = Field(np.zeros(1 << BITS), np.zeros((2, 2)), 0.0, -2.0)
    n = max(1, len(tag))
    grad_w, grad_s, grad_b = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tag[inner - 1], tag[inner]), 1.0)
    for _ in range(rounds):
        e, r, q = f.chains(f.unary(feats), first)
        p = r * q / (1 + r * q)
        miss = tag - p
        t = np.exp(f.step)
        back, x = r[inner - 1], e[inner] * q[inner]
        z = t[0, 0] + t[0, 1] * x + back * (t[1, 0] + t[1, 1] * x)
        expect = np.array([[np.sum(t[0, 0] / z), np.sum(t[0, 1] * x / z)], [np.sum(back * t[1, 0] / z), np.sum(back * t[1, 1] * x / z)]])
        g = np.zeros(1 << BITS)
        for i in range(feats.shape[1]):
            g += np.bincount(feats[:, i], miss, 1 << BITS)
        g = g / n - l2 * f.weights
        grad_w += g * g
        f.weights += 0.5 * g / np.sqrt(grad_w)
        gs = (seen - expect) / n - l2 * f.step
        grad_s += gs * gs
        f.step += 0.2 * gs / np.sqrt(grad_s)
        gb = np.array([miss.sum(), miss[first].sum()]) / n
        grad_b += gb * gb
        move = 0.2 * gb / np.sqrt(grad_b)
        f.bias, f.begin = f.bias + move[0], f.begin + move[1]
    f.weights = f.weights.astype(np.float32)
    return f


def document_features(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Most, expected number (log), and share of toxic tokens, by document."""
    most, total, count = np.zeros(rows), np.bincount(row, p, rows), np.bincount(row, minlength=rows)
    np.maximum.at(most, row, p)
    return np.stack([np.ones(rows), most, np.log1p(total), np.sqrt(total / np.maximum(count, 1))], axis=1)


def train_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton steps. weight: of rows, brought to a mean of 1."""
    w = np.zeros(x.shape[1])
    of = np.ones(len(y)) if weight is None else weight / weight.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (of * p * (1 - p))[:, None]).T @ x / max(1, len(y)) + l2 * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (of * (y - p)) / max(1, len(y)) - l2 * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    field: Field
    logistic: np.ndarray

    def score(self, p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(p, row, rows) @ self.logistic, -30, 30)))


def fit(texts: list[str | None], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), odds: float = 20.0, least: int = 3, tokens: int = FIT_TOKENS) -> Model:
    """The model of a labelled sample; without both labels, one that gives the share of label 1.

    weights: by label, how many labelled rows each of the sample stands for in the logistic regression.
    odds, least: a feature marks toxic tokens if it is so many times more frequent by document in
    toxic ones, and in so many of them. tokens: of sentences for the field, those with a toxic tag first.
    """
    y = np.array(labels, np.int64)
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1.0) if n else 0.0
        w = np.zeros(4)
        w[0] = np.log(share / (1 - share)) if 0 < share < 1 else -30.0
        return Model(Field(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), 0.0, -30.0), w)
    own = np.arange(n) % 3 != 2  # the others are for the scores
    data, offsets = textkit.buffers(pa.array(texts, pa.string()))

    def parts():
        """Features of the texts, made anew each time: kept, they would be many times the texts."""
        for i, j in textkit.slices(offsets):
            _, _, row, first, feats = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(row):
                yield row + i, first, feats

    docs = np.zeros((2, 1 << BITS))
    for row, _, feats in parts():
        mine = own[row]
        for c in range(1 + len(PREFIXES)):
            r, f = textkit.distinct(row[mine], feats[mine, c].astype(np.uint64))
            for k in (0, 1):
                docs[k] += np.bincount(f[y[r] == k].astype(np.int64), minlength=1 << BITS)
    total = [max(1, int((own & (y == k)).sum())) for k in (0, 1)]
    ratio = (docs[1] + 0.5) / (total[1] + 1) / ((docs[0] + 0.5) / (total[0] + 1))
    marked = (ratio >= odds) & (docs[1] >= least)
    toxic, clean, room = [], [], tokens
    for row, first, feats in parts():
        tag = marked[feats[:, : 1 + len(PREFIXES)]].any(axis=1) & (y[row] == 1)
        chain = np.cumsum(first) - 1
        has = np.bincount(chain, tag, int(chain[-1]) + 1) > 0
        where = np.flatnonzero(own[row] & has[chain])[: room // 2]
        room -= len(where)
        toxic.append((first[where], feats[where], tag[where].astype(np.int64)))
        where = np.flatnonzero(own[row] & ~has[chain] & (y[row] == 0))[: max(0, room - sum(len(x[0]) for x in clean))]
        clean.append((first[where], feats[where], tag[where].astype(np.int64)))
    kept = [np.concatenate(x) for x in zip(*toxic, *clean, strict=True)] if toxic else [np.zeros(0, bool), np.zeros((0, N_FEATURES), np.int32), np.zeros(0, np.int64)]
    first, feats, tag = (x[:tokens] for x in kept)
    del toxic, clean, kept
    if len(first):
        first[0] = True
    field = train_field(feats, first, tag)
    x = np.zeros((n, 4))
    for row, first, feats in parts():
        low, high = int(row[0]), int(row[-1]) + 1
        x[low:high] = document_features(field.marginals(feats, first), row - low, high - low)
    x[:, 0] = 1
    use = ~own if len(set(y[~own])) == 2 else np.ones(n, bool)
    scratch.trim()
    return Model(field, train_logistic(x[use], y[use], weight=np.array(weights, float)[y[use]]))


def _tag(model: Model, least: float, keep_text: bool):
    """(d, text) to (d, [text,] score, spans)."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in textkit.segments(batch):
                rows = len(offsets) - 1
                start, end, row, first, feats = features(data, offsets)
                p = model.field.marginals(feats, first)
                letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                hit = np.flatnonzero(p >= least)
                new = np.ones(len(hit), bool)
                new[1:] = (np.diff(hit) > 1) | first[hit[1:]]
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(hit)) - 1 if len(hit) else head
                owner = row[hit[head]]
                base = letters[offsets[owner]]
                peak = np.maximum.reduceat(p[hit], head) if len(hit) else p[:0]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(letters[start[hit[head]]] - base), pa.array(letters[end[hit[tail]]] - base), pa.array(peak)], ["start", "end", "p"])
                found = [pa.array(model.score(p, row, rows)), pa.ListArray.from_arrays(pa.array(ends), spans)]
                yield pa.RecordBatch.from_arrays([part.column(0), *([part.column(1)] if keep_text else []), *found], ["d", *(["text"] if keep_text else []), "score", "spans"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, most: int = FIT_BYTES) -> tuple[list, list, tuple[float, float]]:
    """Texts and labels of at most `rows` labelled ids of each label, by hash of the id, and at most as many documents each.
    Of any length: they are taken in that order until they have `most` bytes together, the last one whole.
    Also, by label (0, 1), how many labelled ids each of those taken stands for."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    order = F.xxhash64(F.col(id_col).cast("string"))
    picked = known.where("_y = 1").orderBy(order).limit(rows).unionByName(known.where("_y <> 1").orderBy(order).limit(rows))
    ids = picked.collect()
    if not ids:
        return [], [], (1.0, 1.0)
    toxic = sum(r[1] == 1 for r in ids)
    whole = known.agg(F.count(F.when(F.col("_y") == 1, 1)), F.count(F.when(F.col("_y") != 1, 1))).first() if max(toxic, len(ids) - toxic) >= rows else (toxic, len(ids) - toxic)
    weights = (whole[1] / max(1, len(ids) - toxic), whole[0] / max(1, toxic))
    small = docs.sparkSession.createDataFrame([(r[0], int(r[1] == 1)) for r in ids], T.StructType([T.StructField("_id", labels.schema[id_col].dataType), T.StructField("_y", T.IntegerType())]))
    found = docs.join(F.broadcast(small), docs[id_col] == small["_id"]).select(F.col(text_col).alias("t"), "_y", order.alias("o"))
    size = F.coalesce(F.octet_length("t"), F.lit(0)).cast("long")
    before = F.sum(size).over(Window.orderBy("o", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    found = found.where(F.col("t").isNotNull()).orderBy("o", "t").limit(2 * rows).withColumn("before", before).where(F.col("before") < most).orderBy("o", "t").collect()
    return [r["t"] for r in found], [r["_y"] for r in found], weights


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 3000, span_least: float = 0.5, fit_bytes: int = FIT_BYTES, fit_tokens: int = FIT_TOKENS) -> DataFrame:
    """One row per document: id, score, spans (start, end in code points, p: its largest marginal).

    labels: the rows that may be learnt from. fit_rows: the bound of the training sample, by label,
    fit_bytes that of its texts together, fit_tokens that of the tokens the field is trained on (of
    sentences, those with a toxic tag first);
    the score's regression weights it to the rate of all labelled rows; every document is scored, on its whole text. Null and empty texts get the score of a text
    without toxic tokens. Repeated rows stay, null ids stay and are never learnt from; other
    columns are ignored; empty tables give no rows, and no labels the score of no evidence.
    """
    scratch.session(docs)
    model = fit(*training_sample(docs, labels, id_col, text_col, label_col, fit_rows, fit_bytes), tokens=fit_tokens)
    base = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_tag(model, span_least, False), _schema(base, False)).withColumnRenamed("d", id_col)


def _schema(base: DataFrame, text: bool) -> T.StructType:
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
    return T.StructType([base.schema["d"], *([T.StructField("text", T.StringType())] if text else []), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])


def keep_clean(docs: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 3000, fit_bytes: int = FIT_BYTES, fit_tokens: int = FIT_TOKENS) -> DataFrame:
    """The rows of docs, columns as they are, whose score is below `least`.

    Null and empty texts have the score of no evidence, repeated rows stay or go together, null ids
    stay in the table and are never learnt from; columns may have any names; an empty table gives no
    rows. The bounds of what is learnt from are those of score_toxicity.
    """
    scratch.session(docs)
    model = fit(*training_sample(docs, labels, id_col, text_col, label_col, fit_rows, fit_bytes), tokens=fit_tokens)
    rest = [c for c in docs.columns if c != text_col]
    base = docs.select(F.struct(*map(scratch.col, rest)).alias("d"), F.col(text_col).cast("string").alias("text"))
    scored = base.mapInArrow(_tag(model, 0.5, True), _schema(base, True)).where(F.col("score") < least)
    return scored.select(*(F.col("text").alias(c) if c == text_col else F.col("d").getField(c).alias(c) for c in docs.columns))
