"""Nearest neighbours by largest inner product with an inverted multi-index.

Vectors are cut into two halves, each quantised by its own centroids; a cell is a pair of centroids. A query walks the pairs by
falling sum of its inner products with both centroids, a heap over the two sorted lists yielding them one by one, until the
cells seen hold enough vectors. The cells' vectors are then ranked by their exact inner products.

How many are enough is measured on the sample that the centroids are fitted on: the share of vectors in falling order of their
cells' sums that holds ``TARGET`` of the true neighbours of some of its vectors. It is small for clustered vectors and large for
ones spread evenly, whose neighbours are hardly nearer than other vectors; a larger table needs no larger share.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.common import find_package, map_batches, written

NEIGHBOURS, EVERY = 20, 20
#: Vectors that the centroids are fitted on, in hash order, at most.
SAMPLE = 20_000
ROUNDS = 12
#: Recall aimed at, vectors of the sample that it is measured with, and the fewest candidates of a query.
TARGET, PROBES, LEAST = 0.96, 200, 1_000
#: Vectors and queries of a first centroid that one task multiplies at once, about 2 MB each.
BLOCK = 4_096

Batches = Iterator[pa.RecordBatch]


def centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's k-means from distinct rows; fewer centroids if there are fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.Generator(np.random.PCG64(seed)).permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        near = nearest(x, c)
        counts = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, column, len(c)) for column in x.T], axis=1)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells, as ``i * len(second) + j``, by falling ``first[i] + second[j]`` until their counts add up to ``enough``; empty ones aside."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, cells, held, row_at = [(-(first[a[0]] + second[b[0]]), 0, 0)], [], 0, {0}
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        if i + 1 < len(a) and i + 1 not in row_at:  # a row opens when the row above is first entered
            row_at.add(i + 1)
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
    return cells


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of vectors in double precision that have a length, only finite components and the usual dimension."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return v.where(F.size("v") == (usual["d"] if usual else 0))


def _celled(one: np.ndarray, two: np.ndarray):
    half = one.shape[1]

    def run(batches: Batches) -> Batches:
        for batch in filter(len, batches):
            x = np.asarray(batch.column("v").flatten()).reshape(len(batch), -1)
            cells = [nearest(x[:, :half], one), nearest(x[:, half:], two)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cells), batch.column("vec_id"), pa.array([row.tobytes() for row in x], pa.binary())], ["first", "second", "vec_id", "v"])

    return run


def share_needed(x: np.ndarray, one: np.ndarray, two: np.ndarray, most: int) -> float:
    """Share of the rows of x, in the walk's order of cells, that holds ``TARGET`` of the nearest rows of some of them."""
    half = one.shape[1]
    asked = np.arange(0, len(x), max(1, len(x) // PROBES))
    near = x[asked] @ x.T
    walked = (x[asked][:, :half] @ one.T)[:, nearest(x[:, :half], one)] + (x[asked][:, half:] @ two.T)[:, nearest(x[:, half:], two)]
    near[np.arange(len(asked)), asked] = walked[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-near, axis=1, kind="stable")[:, :most]
    # Rows of equal sums lie in one cell and are seen together.
    places = np.stack([np.searchsorted(np.sort(-w), -w[t], "right") for w, t in zip(walked, top)])
    return float(np.quantile(places, TARGET)) / len(x)


def _walked(one: np.ndarray, two: np.ndarray, counts: np.ndarray, enough: int):
    half = one.shape[1]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                x = _matrix(part.column("v"))
                first, second = x[:, :half] @ one.T, x[:, half:] @ two.T
                row, group, seen = [], [], []
                for k, (f, s) in enumerate(zip(first, second)):
                    cells = np.sort(np.array(walk(f, s, counts, enough), np.int64))
                    groups, heads = np.unique(cells // len(two), return_index=True)
                    row += [k] * len(groups)
                    group += groups.tolist()
                    seen += [c.astype(np.int32).tobytes() for c in np.split(cells % len(two), heads[1:])]
                again = pa.array(row, pa.int64())
                columns = [pa.array(group, pa.int64()), part.column("vec_id").take(again), part.column("v").take(again), pa.array(seen, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["first", "query_id", "v", "seen"])

    return run


def _ranked(most: int, seconds: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if queries.num_rows and vectors.num_rows:
            vectors = vectors.sort_by("vec_id")
            ids, cells, v, q = np.asarray(vectors.column("vec_id")), np.asarray(vectors.column("second")), _matrix(vectors.column("v")), _matrix(queries.column("v"))
            slack = 1e-9 * (np.abs(q).max() * np.abs(v).max() * v.shape[1] + 1e-300)
            for query, vector, seen in zip(queries.column("query_id").to_pylist(), q, queries.column("seen").to_pylist()):
                open_ = np.zeros(seconds, bool)
                open_[np.frombuffer(seen, np.int32)] = True
                at = np.flatnonzero(open_[cells] & (ids != query))
                near = v[at] @ vector
                if len(at) > most:
                    at = at[near >= np.partition(near, len(at) - most)[len(at) - most] - slack]
                # Summed alike for every pair, so equal vectors have equal scores.
                exact = (v[at] * vector).sum(axis=1)
                best = np.argsort(-exact, kind="stable")[:most]
                out_q.append(np.full(len(best), query))
                out_v.append(ids[at[best]])
                out_s.append(exact[best])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"query_id": pa.array(join(out_q, np.int64), pa.int64()), "vec_id": pa.array(join(out_v, np.int64), pa.int64()), "score": pa.array(join(out_s, np.float64), pa.float64())})

    return run


def neighbours(vectors: DataFrame, every: int = EVERY, most: int = NEIGHBOURS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector whose id is divisible by ``every`` the ``most`` nearest others found.

    ``vectors`` has vec_id and embedding. Ties go to the smaller vec_id. Vectors that are null, zero, of another than the most
    frequent dimension, or that hold null or non-finite components take no part, neither do rows without vec_id. Rows that
    repeat a vec_id with another vector are candidates each, of repeated equal rows one is. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    usable = written(_usable(vectors).distinct(), "vectors")
    size = usable.count()
    rows = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.array([r["v"] for r in rows])
    half, k = max(1, x.shape[1] // 2), int(np.clip(4 * size**0.25, 4, 256))
    one = centroids(x[:, :half], k, 1)
    two = centroids(x[:, half:], k, 2) if x.shape[1] > half else np.zeros((1, 0))
    cells = written(map_batches(usable, _celled(one, two), "first long, second long, vec_id long, v binary"), "cells")
    counts = np.zeros((len(one), len(two)), np.int64)
    for row in cells.groupBy("first", "second").count().collect():  # as many as pairs of centroids at most
        counts[row["first"], row["second"]] = row["count"]
    enough = max(LEAST, int(np.ceil(share_needed(x, one, two, most) * size)))
    asked = cells.where(F.col("vec_id") % every == 0)
    visits = written(map_batches(asked, _walked(one, two, counts.ravel(), enough), "first long, query_id long, v binary, seen binary"), "visits")
    # A first centroid with many vectors or queries is multiplied in blocks of both.
    blocks = cells.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).alias("vs")).join(visits.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).alias("qs")), "first")
    part = lambda of, n: F.pmod(F.xxhash64(of), F.col(n))
    key = ["first", "qb", "vb"]
    left = visits.join(blocks, "first").withColumn("qb", part("query_id", "qs")).withColumn("vb", F.explode(F.expr("sequence(0L, vs - 1)"))).select(*key, "query_id", "v", "seen")
    right = cells.join(blocks, "first").withColumn("vb", part("vec_id", "vs")).withColumn("qb", F.explode(F.expr("sequence(0L, qs - 1)"))).select(*key, "second", "vec_id", "v")
    find_package(spark)
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_ranked(most, len(two)), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
