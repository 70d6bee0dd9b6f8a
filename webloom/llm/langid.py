"""Operator 9, language: nearest centroid of TF-IDF vectors of hashed byte n-grams.

Every language has several centroids, from spherical k-means over a bounded sample; document
frequencies are counted over all training texts. A text gets the language of the centroid with the
largest cosine, and is marked as rejected if that cosine is below what nearly all texts of the cluster reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import bytes_of, mix, texts_of

DIMS = 1 << 13
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are not letters of a text become spaces; all bytes of multi-byte characters stay.
PLAIN = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint64)


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, counts) of the hashed one-, two- and three-byte grams of a whole text; none without a letter."""
    u = text.decode("utf-8", "replace")
    if not LETTER.search(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = PLAIN[np.frombuffer(b" " + u.lower().encode("utf-8", "replace") + b" ", np.uint8)]
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]  # runs of spaces are one
    two = (b[:-1] << np.uint64(8)) | b[1:]
    three = (two[:-1] << np.uint64(8)) | b[2:]
    grams = np.concatenate([b, two | np.uint64(1 << 24), three | np.uint64(1 << 25)])
    n = np.bincount((mix(grams) & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of unit length
    of: np.ndarray  # language of each centroid
    least: np.ndarray  # cosine below which a text is too far from the centroid

    def weigh(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _weigh(at, n, self.idf)

    def nearest(self, text: bytes) -> tuple[str, float, bool]:
        """(language, cosine, rejected); ``und``, 0 and rejected without a letter or without any language."""
        at, n = counts(text)
        if not len(at) or not len(self.of):
            return "und", 0.0, True
        cosines = self.centroids[:, at] @ _weigh(at, n, self.idf)
        k = int(cosines.argmax())
        return self.languages[self.of[k]], float(min(max(cosines[k], 0.0), 1.0)), bool(cosines[k] < self.least[k])


def _weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * idf[at]
    return w / max(np.sqrt((w * w).sum()), 1e-12)


def _clusters(v: np.ndarray, k: int, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart seeds: (centroids, cluster of each row)."""
    seeds = [int((v @ v.mean(0)).argmax())]
    while len(seeds) < min(k, len(v)):
        seeds.append(int((v @ v[seeds].T).max(1).argmin()))
    c = v[seeds]
    for _ in range(turns):
        near = (v @ c.T).argmax(1)
        sums = np.stack([v[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, (v @ c.T).argmax(1)


def train(
    docs: DataFrame, per_language: int = 400, most: int = 4_000, clusters: int = 3, text: str = "text", lang: str = "lang", key: str = "doc_id"
) -> Model:
    """Learn from all texts whose language is not null.

    Document frequencies cover every text (a task sends one row per dimension). The centroids come from
    a sample chosen by hash of the id: about ``per_language`` texts of each language, and about
    ``most`` in all, are what reaches the driver.
    """
    known = docs.filter(F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)  # the last one counts texts
        for batch in batches:
            for _, texts in texts_of(batch.column(0)):
                for t in texts:
                    total[counts(t)[0]] += 1
                    total[DIMS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["d", "n"])

    rows = known.select(bytes_of(F.col("text")).alias("t")).mapInArrow(frequencies, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIMS + 1)
    df[rows["d"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 0.1

    each = min(per_language, most // max(1, len(sizes)))
    share = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, each / n))).otherwise(share)
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / (1 << 20)
    picked = known.filter(place < share)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in texts_of(batch.column(0)):
                both = [counts(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(a, len(texts)),
                        pa.array([at.astype("<u2").tobytes() for at, _ in both], pa.binary()),
                        pa.array([n.astype("<u4").tobytes() for _, n in both], pa.binary()),
                    ],
                    ["lang", "at", "n"],
                )

    sample = picked.select(bytes_of(F.col("text")).alias("t"), "lang").mapInArrow(vectors, "lang string, at binary, n binary").collect()
    names = sorted({r["lang"] for r in sample if len(r["at"])})
    centroids, of, least = [], [], []
    for i, name in enumerate(names):
        rows = sorted((bytes(r["at"]), bytes(r["n"])) for r in sample if r["lang"] == name and len(r["at"]))
        v = np.zeros((len(rows), DIMS), np.float32)
        for row, (at, n) in zip(v, rows):
            at = np.frombuffer(at, "<u2").astype(np.int64)
            row[at] = _weigh(at, np.frombuffer(n, "<u4"), idf)
        c, near = _clusters(v, clusters)
        cosines = (v * c[near]).sum(1)
        for k in range(len(c)):
            mine = cosines[near == k]
            centroids.append(c[k])
            of.append(i)
            least.append(0.5 * float(np.quantile(mine, 0.01)) if len(mine) else 0.0)
    return Model(names, idf, np.array(centroids, np.float32).reshape(-1, DIMS), np.array(of, np.int64), np.array(least))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score (the cosine) and rejected; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in texts_of(batch.column(0)):
                found = [model.nearest(t) for t in texts]
                kept = [c.slice(a, len(texts)) for c in batch.columns[1:]]
                made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "lang_pred", "score", "rejected"])

    schema = docs.schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(bytes_of(F.col(f"`{text}`")).alias("__t"), *[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
