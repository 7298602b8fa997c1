"""Main text of web pages by a recurrent block labeller.

A bidirectional LSTM in numpy reads the page's blocks in order, each a tag-path and hashed-word
vector, and gives every block a label from the context of the whole page. It is trained on pages
made by a rule (html_training), the same for any input, once in a driver process; executors get
its weights, some tens of kilobytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import html_blocks, html_training, scratch, textkit

HIDDEN = 24
MARK = ""


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Lstm:
    """One direction: gates in the order input, forget, output, candidate."""

    def __init__(self, width: int, hidden: int, rng: np.random.Generator):
        self.w = (rng.standard_normal((width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1
        self.hidden = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: steps x pages x width; mask: steps x pages. States of every step."""
        steps, n, _ = x.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, memory = np.zeros((steps, n, k), np.float32), []
        flat = x.reshape(steps * n, -1) @ self.w + self.b
        flat = flat.reshape(steps, n, -1)
        for t in range(steps):
            z = flat[t] + h @ self.u
            gates, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                memory.append((h, c, gates, g, tanh))
            h, c = np.where(m, o * tanh, h), np.where(m, new, c)
            out[t] = h
        return out, memory

    def backward(self, x: np.ndarray, mask: np.ndarray, memory: list, grad: np.ndarray):
        """Gradients of w, u and b from those of the states."""
        steps, n, _ = x.shape
        k = self.hidden
        dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        dz, du = np.zeros((steps, n, 4 * k), np.float32), np.zeros_like(self.u)
        for t in range(steps - 1, -1, -1):
            before, c, gates, g, tanh = memory[t]
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            m = mask[t][:, None].astype(np.float32)
            dh = dh + grad[t]
            live = dh * m
            cell = dc * m + live * o * (1 - tanh * tanh)
            z = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), live * tanh * o * (1 - o), cell * i * (1 - g * g)], axis=1)
            dz[t] = z
            du += before.T @ z
            dh = dh * (1 - m) + z @ self.u.T
            dc = dc * (1 - m) + cell * f
        flat = dz.reshape(steps * n, -1)
        return x.reshape(steps * n, -1).T @ flat, du, flat.sum(axis=0)


class Labeller:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(html_blocks.WIDTH, HIDDEN, rng), Lstm(html_blocks.WIDTH, HIDDEN, rng)
        self.v = (rng.standard_normal(2 * HIDDEN) / 7).astype(np.float32)
        self.v0 = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.v0]

    def _states(self, x, mask, keep=False):
        a, ma = self.ahead.forward(x, mask, keep)
        b, mb = self.back.forward(x[::-1], mask[::-1], keep)
        return np.concatenate([a, b[::-1]], axis=2), ma, mb

    def step(self, x, mask, y) -> list[np.ndarray]:
        """Gradients of the mean cross entropy over blocks."""
        s, ma, mb = self._states(x, mask, True)
        p = _sigmoid(s @ self.v + self.v0[0])
        d = (np.where(mask, p - y, 0) / max(1, mask.sum())).astype(np.float32)
        grad = d[:, :, None] * self.v
        ga = self.ahead.backward(x, mask, ma, grad[:, :, :HIDDEN])
        gb = self.back.backward(x[::-1], mask[::-1], mb, grad[::-1, :, HIDDEN:])
        return [*ga, *gb, (s * d[:, :, None]).sum(axis=(0, 1)), np.array([d.sum()], np.float32)]

    def label(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of main text for the blocks of pages, whose rows follow each other in x."""
        out = np.zeros(len(x), np.float32)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            longest = int(sizes[order[at]])
            many = max(1, min(256, 40_000 // longest))
            rows = order[at : at + many]
            at += many
            xs, mask = _pad(x, first[rows], sizes[rows])
            p = _sigmoid(self._states(xs, mask)[0] @ self.v + self.v0[0])
            step, page = np.nonzero(mask)
            out[first[rows][page] + step] = p[step, page]
        return out


def _pad(x: np.ndarray, first: np.ndarray, sizes: np.ndarray):
    steps = int(sizes.max())
    index = np.minimum(np.arange(steps)[:, None], sizes - 1) + first
    mask = np.arange(steps)[:, None] < sizes
    return np.where(mask[:, :, None], x[index], 0).astype(np.float32), mask


@lru_cache(2)
def trained(n: int = 1600, rounds: int = 220, seed: int = 3) -> Labeller:
    """Adam over made pages."""
    parsed = [html_blocks.blocks(p) for p in html_training.pages(n)]
    y = np.array([MARK in b.text for p in parsed for b in p], np.float32)
    for p in parsed:
        for b in p:
            b.text = b.text.replace(MARK, "") or "x"
    x, sizes = html_blocks.vectors(parsed), np.array([len(p) for p in parsed])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    model, rng = Labeller(seed), np.random.default_rng(seed)
    m = [np.zeros_like(w) for w in model.weights()]
    v = [np.zeros_like(w) for w in model.weights()]
    usable = np.flatnonzero(sizes > 0)
    for t in range(1, rounds + 1):
        rows = rng.choice(usable, 48, replace=False)
        xs, mask = _pad(x, first[rows], sizes[rows])
        target = np.where(mask, y[np.minimum(np.arange(mask.shape[0])[:, None], sizes[rows] - 1) + first[rows]], 0)
        rate = 0.01 if t < rounds * 2 // 3 else 0.003
        for w, g, a, b in zip(model.weights(), model.step(xs, mask, target), m, v, strict=True):
            g = np.clip(g, -1, 1)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return model


def extract(pages: list[str | None], model: Labeller, least: float = 0.5) -> tuple[list[str], list[int], list[int]]:
    """Main texts, and how many blocks were kept and seen."""
    parsed = [html_blocks.blocks(p) for p in pages]
    sizes = np.array([len(p) for p in parsed], np.int64)
    p = model.label(html_blocks.vectors(parsed), sizes)
    texts, kept, at = [], [], 0
    for page in parsed:
        mine = [b.text for b, q in zip(page, p[at : at + len(page)], strict=True) if q >= least]
        at += len(page)
        texts.append("\n\n".join(mine))
        kept.append(len(mine))
    return texts, kept, sizes.tolist()


def _run(model: Labeller, least: float, names: list[str], rows: int = 200):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                texts, kept, seen = extract(part.column(part.num_columns - 1).to_pylist(), model, least)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.int64()), pa.array(seen, pa.int64())], [*part.schema.names[:-1], *names])

    return run


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html", least: float = 0.5) -> DataFrame:
    """The columns `keep`, then text, n_chars (code points), n_kept and n_blocks, by page.

    A name among these that is in `keep` gets underscores after it. Blocks are joined in page order by two line ends; white space inside one is a single space.
    Null, empty and tagless blank pages have an empty text. Repeated rows and null ids stay,
    other columns are ignored; an empty table gives no rows.
    """
    scratch.session(pages)
    names, result = list(keep), []
    for name in ("text", "n_chars", "n_kept", "n_blocks"):
        result.append(textkit.free(name, [*names, *result]))
    base = pages.select(*map(scratch.col, keep), F.col(html_col).cast("string").alias(textkit.free("_html", [*names, *result])))
    new = [T.StructField(c, T.StringType() if c == result[0] else T.LongType()) for c in result]
    return base.mapInArrow(_run(trained(), least, result), T.StructType([*base.schema.fields[:-1], *new]))
