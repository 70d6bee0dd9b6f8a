"""Operator 4, quality: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other and adds a shallow tree (two cuts, three leaves) on
its bins to that feature's lookup table; then the pairs of features with the largest gain get tables of
their own from trees of one cut on either side. A text is scored by adding table entries of its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import WordHashes, bytes_of, shingles, texts_of

FEATURES = (
    "log_words", "word_bytes", "symbols", "upper", "exclaims", "digits", "distinct_words", "same_as_before", "repeated_windows",
    "repeated_lines", "line_words", "stops", "bars", "byte_entropy", "top_word", "high_bytes", "lower_letters",
)
BINS, COARSE = 32, 8


def _set(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8).astype(np.int64)


SYMBOLS, LOWER, UPPER, DIGITS = _set("#*$%&<>@^~{}[]=+"), _set("abcdefghijklmnopqrstuvwxyz"), _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("0123456789")


def features(text: bytes, words: WordHashes) -> list[float]:
    """Measurements of a whole text; an empty text has zeros throughout."""
    w = words.of(text)
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    lines = [x for x in (x.strip() for x in text.split(b"\n")) if x]
    _, counts = np.unique(w, return_counts=True)
    windows = shingles(w, 5)
    low, up = int(b[LOWER].sum()), int(b[UPPER].sum())
    p = b[b > 0] / size
    return [
        np.log1p(n), size / n, b[SYMBOLS].sum() / n, up / max(1, low + up), b[33] / n, b[DIGITS].sum() / size,
        len(counts) / n ** 0.9, np.count_nonzero(w[1:] == w[:-1]) / n, 1 - len(np.unique(windows)) / len(windows),
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), (b[46] + b[44]) / n, b[124] / n, float(-(p * np.log2(p)).sum()),
        counts.max() / n, b[128:].sum() / size, low / size,
    ]


@dataclass
class Model:
    """Bin edges and lookup tables; ``pairs`` holds (i, j, table over coarse bins)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            total += t[at[i]]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _leaf(g, h):
    return -g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of the bins by the best tree of at most two cuts."""
    cuts = [0, len(g)]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of cuts, one on either side."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gain, parts = 0.0, []
    for c in (cg, ch):
        a = c[:-1, :-1]
        top, left = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append((a, top, left, c[-1, -1] - a - top - left))
    total = sum(_gain(x, y) for x, y in zip(*parts)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    gain = float(total[i, j])
    v = [_leaf(x[i, j], y[i, j]) for x, y in zip(*parts)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return gain, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.15) -> Model:
    """Fit on a bounded sample; without rows, or with one class only, the model is its base rate."""
    n = len(y)
    mean = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for c in x.T]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    model.coarse = [np.arange(len(e) + 1) * COARSE // (len(e) + 1) for e in edges]
    if n == 0 or y.min() == y.max():
        return model
    at, total = model.bins(x), np.full(n, base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for i in range(x.shape[1]):
            g, h = slopes()
            size = len(model.tables[i])
            step = rate * _tree(np.bincount(at[i], g, size), np.bincount(at[i], h, size))
            model.tables[i] += step
            total += step[at[i]]
    cells = [c[a] for c, a in zip(model.coarse, at)]
    grid = lambda i, j, v: np.bincount(cells[i] * COARSE + cells[j], v, COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = slopes()
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((COARSE, COARSE))) for _, i, j in ranked[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[cells[i], cells[j]]
    return model


def _measured(docs: DataFrame, text: str, carry: dict[str, str]) -> DataFrame:
    """The carried columns (name: type) and ``x``, the features of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for a, texts in texts_of(batch.column(0)):
                flat = np.array([features(t, words) for t in texts], np.float64).reshape(-1)
                ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES))
                kept = [c.slice(a, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, pa.array(flat))], [*carry, "x"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in carry.items()), "x array<double>"])
    return docs.select(bytes_of(F.col(f"`{text}`")).alias("__t"), *[F.col(f"`{c}`") for c in carry]).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Fit on at most ``max_rows`` labelled ids (the smallest by hash of the id, so the choice is stable).

    The sample of ids is the only thing broadcast, bounded by ``max_rows``. Null ids and labels are left
    out; an id that is labelled twice counts twice.
    """
    ids = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("double").alias("y")).filter("k IS NOT NULL AND y IS NOT NULL")
    ids = ids.orderBy(F.xxhash64("k"), "k", "y").limit(max_rows)
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("text"))
    rows = _measured(texts.join(F.broadcast(ids), "k"), "text", {"k": "long", "y": "double"}).select("x", "y").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["y"].to_numpy()))  # sums do not depend on the order of arrival
    return fit(x[order], rows["y"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the probability of the label 1; null texts count as empty.

    A column named as ``into`` is replaced.
    """
    docs = docs.drop(into)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for a, texts in texts_of(batch.column(0)):
                x = np.array([features(t, words) for t in texts], np.float64).reshape(-1, len(FEATURES))
                kept = [c.slice(a, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(x))], [*names, into])

    schema = docs.schema.add(into, "double")
    return docs.select(bytes_of(F.col(f"`{text}`")).alias("__t"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
