"""Quality of documents by histogram gradient-boosted trees over text statistics.

Statistics are taken from whole texts in numpy. The trees are grown on a bounded sample of labelled rows, level by level on
binned features, and kept as flat arrays (a complete tree by depth), which a task walks for all its documents at once.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm import hashing
from kerbline.llm.common import map_batches

#: Labelled rows that the trees are grown on, at most: they and their statistics fit the driver many times over.
MOST_LABELS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN, RIDGE = 120, 4, 0.1, 64, 2.0, 1.0

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9), "newline": (10,), "stop": (46, 33, 63), "comma": (44, 58, 59),
    "quote": (34, 39, 40, 41, 45), "symbol": (35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126), "wide": range(128, 256), "shout": (33,), "bar": (124,),
}
_KIND = np.zeros((256, len(_KINDS)))
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes), _i] = 1

Batches = Iterator[pa.RecordBatch]


class Trees(NamedTuple):
    """Trees as arrays of shape (trees, inner nodes) and, for ``value``, (trees, leaves); node k has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float


def statistics(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text; zeros for an empty one."""
    rows = []
    for start, stop in hashing.slices(column):
        part = column.slice(start, stop - start)
        words = hashing.split_words(part)
        texts = [(t.as_py() or "").encode() for t in part]
        size = (words.end - words.start).astype(np.float64)
        for i, text in enumerate(texts):
            a, b = words.first[i], words.first[i + 1]
            counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            n, m = max(len(text), 1), max(b - a, 1)
            share = counts[counts > 0] / n
            own = words.hashes[a:b]
            _, times = np.unique(own, return_counts=True)
            pairs = np.unique(own[1:] ^ (own[:-1] * np.uint64(3)))
            lines = [x for x in text.split(b"\n") if x.strip()]
            length = size[a:b]
            rows.append(
                [
                    np.log1p(len(text)), np.log1p(b - a), *(counts @ _KIND / n), -(share * np.log2(share)).sum(),
                    length.mean() if b > a else 0, length.std() if b > a else 0, length.max() if b > a else 0,
                    len(times) / m, times.max() / m if b > a else 0, (own[1:] == own[:-1]).sum() / m, len(pairs) / m,
                    np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(len(lines), 1),
                ]
            )
    return np.array(rows).reshape(len(column), -1)


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for labels y in {0, 1}, by the logistic loss. Without rows, or with rows of one label only, a constant."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    mean = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])  # bin k: values up to edge k
    margin = np.full(len(y), base)
    out = ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            width = 1 << depth
            best, split = np.zeros(width), np.full((width, 2), -1)
            for f, b in enumerate(bins):
                at = node * BINS + b
                left_g, left_h = (np.bincount(at, v, width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g, h))
                total_g, total_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(left_h < LEAST_HESSIAN) | (total_h - left_h < LEAST_HESSIAN)] = 0
                gain[:, len(edges[f]) :] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-9
                best[better] = top[better]
                split[better] = np.c_[np.full(width, f), k][better]
            for k, (f, b) in enumerate(split):
                if f >= 0:
                    feature[width - 1 + k], threshold[width - 1 + k] = f, edges[f][b]
            at = width - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[at]] > threshold[at])
        sum_g, sum_h = (np.bincount(node, v, leaves) for v in (g, h))
        value = RATE * sum_g / (sum_h + RIDGE)
        margin += value[node]
        for kept, new in zip(out, (feature, threshold, value)):
            kept.append(new)
    return Trees(*(np.array(k) for k in out), base)


def scores(trees: Trees, x: np.ndarray) -> np.ndarray:
    margin, rows = np.full(len(x), trees.base), np.arange(len(x))
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        margin += value[node - len(feature)]
    return 1 / (1 + np.exp(-margin))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 modulo 3, or it has no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def _measured(batches: Batches) -> Batches:
    for batch in filter(len, batches):
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from at most ``MOST_LABELS`` rows of ``labels (doc_id, quality)`` outside the held-out fold, in hash order.

    Labels other than 0 and 1 and labels of absent documents are left out; without any the trees give 0.5 throughout.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MOST_LABELS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = map_batches(texts.join(F.broadcast(sample), "doc_id").select("quality", "text"), _measured, "quality int, x array<double>").limit(2 * MOST_LABELS).collect()
    rows.sort()
    x, y = np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows], float)
    return grow(x.reshape(len(rows), -1) if rows else np.zeros((0, 1)), y)


def _scored(trees: Trees):
    def run(batches: Batches) -> Batches:
        for batch in filter(len, batches):
            value = scores(trees, statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs (doc_id, text, ...)``; a null text is empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_batches(texts, _scored(trees), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _good(trees: Trees):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(scores(trees, statistics(batch.column("text"))) >= 0.5))

    return run


def accepted(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the trees predict as good."""
    return map_batches(docs, _good(trees), docs.schema)
