"""Operator 5, decontamination: SimHash of item-sized windows, Hamming blocks, weighted shingles.

For every benchmark item, the windows of a text with as many words as the item are candidates; a text with
fewer words is one window as a whole. A window
has a 64-bit SimHash of its words. A multi-index of the items' fingerprints over ``RADIUS + 1`` blocks of
bits finds every item within ``RADIUS`` bits: fingerprints that differ in so few bits agree in one block at
least. Candidates are verified by the exact similarity of weighted five-word shingles (weight: occurrences;
similarity: sum of minima over sum of maxima), at least 0.8 by default.

A window that shares no shingle with any item has similarity 0, so fingerprints are only computed for
windows around words where a shingle of the benchmark begins, and of these only for windows that hold as
many such shingles as the threshold takes; this bound loses nothing. The benchmark is taken in blocks of at most
``BLOCK`` items, each compared with all texts in a scan without a shuffle; the block is what tasks hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import WordHashes, bytes_of, mix, shingles, texts_of

#: At similarity 0.8 to 0.84 (last words replaced; evenly used or Zipf words; 15 to 200 words), 0 of 30,000 pairs were over 22 bits, 0.013 % over 20, 4.2 % over 12.
RADIUS = 24
BLOCK = 20_000
SMALL = 1 << 20


def _signs(words: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each word hash."""
    return ((mix(words)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def simhash(words: np.ndarray) -> np.uint64:
    """Fingerprint of a sequence of word hashes."""
    return _fingerprints(_signs(words).sum(axis=0)[None, :])[0]


class Index:
    """Multi-index of one block of items: sizes, shingle weights, fingerprints by blocks of bits."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, radius: int):
        words = WordHashes()
        self.size, self.radius = size, radius
        self.ids, self.weights, prints, lengths = [], [], [], []
        for i, text in items:
            w = words.of(text)
            if len(w):
                self.ids.append(i)
                self.weights.append(Counter(shingles(w, size).tolist()))
                prints.append(simhash(w))
                lengths.append(len(w))
        self.prints, self.lengths = np.array(prints, np.uint64), np.array(lengths, np.int64)
        self.anchors = np.array(sorted({h for c in self.weights for h in c}), np.uint64)
        self.short = sorted({n for n in lengths if n < size})
        self.edges = np.linspace(0, 64, radius + 2).astype(int)
        self.masks = [np.uint64(((1 << int(b - a)) - 1) << int(a)) for a, b in zip(self.edges, self.edges[1:])]
        self.sizes = np.unique(self.lengths).tolist()
        self.sized = {n: np.flatnonzero(self.lengths == n) for n in self.sizes}
        self.blocks = []
        for a, b in zip(self.edges, self.edges[1:]):
            table: dict[tuple[int, int], list[int]] = {}
            for k, v in enumerate(self._bits(self.prints, a, b).tolist()):
                table.setdefault((int(self.lengths[k]), v), []).append(k)
            self.blocks.append(table)

    @staticmethod
    def _bits(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return (prints >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)

    def within(self, length: int, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, item, distance) of all items of this length within the radius."""
        items = self.sized[length]
        if len(items) * len(prints) <= SMALL:  # few items of this length: all blocks side by side
            x = prints[:, None] ^ self.prints[items][None, :]
            agree = np.logical_or.reduce([(x & m) == 0 for m in self.masks])
            at, k = np.nonzero(agree & (np.bitwise_count(x) <= self.radius))
            return list(zip(at.tolist(), items[k].tolist(), np.bitwise_count(x[at, k]).tolist()))
        found = set()
        for table, a, b in zip(self.blocks, self.edges, self.edges[1:]):
            for at, v in enumerate(self._bits(prints, a, b).tolist()):
                found.update((at, k) for k in table.get((length, v), ()))
        if not found:
            return []
        at, k = np.array(sorted(found)).T
        far = np.bitwise_count(prints[at] ^ self.prints[k])
        return [(int(x), int(y), int(d)) for x, y, d in zip(at, k, far) if d <= self.radius]

    def hits(self, words: np.ndarray, threshold: float = 0.0) -> list[tuple[int, int, int]]:
        """(first word, item, distance) of all windows of a text near an item that may reach the threshold."""
        if not len(self.ids) or not len(words):
            return []
        starts: dict[int, np.ndarray] = {}
        for n in {self.size, *self.short}:
            if len(words) >= n:
                h = shingles(words, n)
                at = np.searchsorted(self.anchors, h).clip(max=len(self.anchors) - 1)
                starts[n] = np.flatnonzero(self.anchors[at] == h)
        total, found = None, []
        for length in self.sizes:
            marks = starts.get(min(length, self.size))
            if marks is None or not len(marks):
                continue
            # Of a + b shingles, threshold / (1 + threshold) of them at least are common at the threshold.
            part = min(length, self.size) - 1
            need = max(1, math.ceil(threshold / (1 + threshold) * (min(length, len(words)) + length - 2 * part) - 1e-9))
            if len(marks) < need:
                continue
            if length > len(words):  # the whole text is the one window; its similarity to a longer item may still reach the threshold
                near = self.within(length, simhash(words)[None])
                found += [(0, k, d) for _, k, d in near]
                continue
            # Windows of this length that hold enough of the marked shingles.
            cover = np.zeros(len(words) - length + 2, np.int64)
            np.add.at(cover, np.maximum(0, marks - length + min(length, self.size)), 1)
            np.add.at(cover, np.minimum(marks, len(words) - length) + 1, -1)
            at = np.flatnonzero(np.cumsum(cover[:-1]) >= need)
            if not len(at):
                continue
            if total is None:
                total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(words), axis=0, dtype=np.int32)])
            near = self.within(length, _fingerprints(total[at + length] - total[at]))
            found += [(int(at[x]), k, d) for x, k, d in near]
        return found

    def similarity(self, window: np.ndarray, k: int) -> float:
        mine, item = Counter(shingles(window, self.size).tolist()), self.weights[k]
        low = sum(min(n, item.get(h, 0)) for h, n in mine.items())
        return low / (sum(mine.values()) + sum(item.values()) - low)


def leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8, radius: int = RADIUS,
    text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): the best window of each text and item, the first of equals.

    Null and empty texts or items match nothing; items of fewer than ``size`` words are one shingle.
    Rows of equal ids give rows of their own. Null ids are kept.
    """
    ids = benchmark.select(F.col(f"`{item}`").cast("long").alias("i"), bytes_of(F.col(f"`{item_text}`")).alias("t"))
    schema = f"{key} long, item_id long, first_word long, n_words long, distance int, similarity double"
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("k"), bytes_of(F.col(f"`{text}`")).alias("t"))

    def scan(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = WordHashes()
            for batch in batches:
                for a, rows in texts_of(batch.column(1)):
                    keys, out = batch.column(0).slice(a, len(rows)).to_pylist(), []
                    for k, t in zip(keys, rows):
                        w, best = words.of(t), {}
                        for at, i, d in index.hits(w, threshold):
                            n = min(int(index.lengths[i]), len(w))
                            s = index.similarity(w[at : at + n], i)
                            if s >= threshold and (s, -at) > best.get(i, (0.0, 0))[:2]:
                                best[i] = (s, -at, d)
                        out += [(k, index.ids[i], -at, min(int(index.lengths[i]), len(w)), d, s) for i, (s, at, d) in sorted(best.items())]
                    if out:
                        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(zip(*out), kinds)], [c.split(" ")[0] for c in schema.split(", ")])

        return run

    found, block, many = None, [], ids.orderBy("i", "t").toLocalIterator()
    for row in many:
        block.append((row["i"], bytes(row["t"])))
        if len(block) == BLOCK:
            part = texts.mapInArrow(scan(Index(block, size, radius)), schema)
            found, block = part if found is None else found.union(part), []
    if block or found is None:
        part = texts.mapInArrow(scan(Index(block, size, radius)), schema)
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; rows without id stay."""
    hit = leaks(docs, benchmark, text=text, key=key, **options).select(F.col(key).alias("__hit")).distinct()
    return docs.join(hit, F.col(f"`{key}`") == F.col("__hit"), "left_anti")
