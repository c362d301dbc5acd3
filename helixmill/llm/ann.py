"""Approximate nearest neighbours with balanced posting lists (operator 8).

Centroids come from balanced halving of a bounded sample: a set is split by two centres at the median, until as many
cells as lists are left; a cell's centroid is its vector nearest to the mean. Every vector goes to the lists of its
nearest centroids, found by best-first search in an in-memory neighbour graph of the centroids: the nearest one, and
those that are almost as near (boundary vectors) unless a list already chosen lies closer to that centroid than the
vector does. A query reads the lists whose distance is within a ratio of its nearest one's, and the exact distances of
the original vectors rank what they hold.

Equal vectors are one entry with its smallest ids: of a group of copies no more than TOP + 1 can be among the nearest,
so the rest can't change a result. Lists and the queries that read them are cut into blocks of bounded size, and each
pair of blocks is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from helixmill.llm.common import prepare, written

TOP, QUERY_STEP = 10, 100
#: The fit: vectors of the sample, and the floats of all centroids (the bound of what is broadcast). There are 3 sqrt(n) lists
#: as far as these go: to 40,000, which is to 178 million vectors; beyond, lists get longer.
SAMPLE, MAX_FLOATS = 40_000, 1 << 24
REPLICAS, BOUNDARY = 4, 1.12
#: Lists that a query reads: within the ratio, at least and at most so many; of very many lists one in PROBED at most.
MIN_PROBES, MAX_PROBES, PROBED, RATIO = 12, 96, 64, 1.6
DEGREE, BEAM = 24, 128
BLOCK = 4096


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, size (its length): one row for each vec_id that takes part. Rows with a null id, or a vector that is null, zero, or holds
    null or non-finite components, don't. Repeated rows count once; of an id with different vectors the smallest counts."""
    fine = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    return vectors.where(fine).groupBy("vec_id").agg(F.min("embedding").alias("vector")).withColumn("size", F.size("vector"))


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Balanced halving: 2-means, then a cut at the share of lists each side is to have."""
    out, todo, rng = [], [(np.arange(len(sample)), lists)], np.random.default_rng(7)
    while todo:
        own, k = todo.pop()
        x = sample[own]
        if k <= 1 or len(own) <= 1:
            out.append(own[((x - x.mean(0)) ** 2).sum(1).argmin()])
            continue
        a, b = x[rng.choice(len(own), 2, replace=False)].astype(np.float64)
        for _ in range(8):
            lean = x @ (b - a) - (b @ b - a @ a) / 2
            far = lean > np.median(lean)
            if far.all() or not far.any():
                break
            a, b = x[~far].mean(0), x[far].mean(0)
        by = np.argsort(x @ (b - a), kind="stable")
        half = k // 2
        at = min(max(1, len(own) * half // k), len(own) - 1)
        todo += [(own[by[:at]], half), (own[by[at:]], k - half)]
    return sample[np.array(out)]


class Graph:
    """The centroids and for each its DEGREE nearest ones, some of them a random far one."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float32)
        self.norms = (self.points**2).sum(1)
        n = len(points)
        degree = min(DEGREE, n)
        self.edges = np.empty((n, degree), np.int32)
        rng = np.random.default_rng(11)
        for at in range(0, n, 512):
            d = self.norms - 2 * self.points[at : at + 512] @ self.points.T
            self.edges[at : at + 512] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        if n > degree:
            self.edges[:, -2:] = rng.integers(0, n, (n, 2))
        self.entries = np.sort(rng.choice(n, min(n, 64), replace=False)).astype(np.int32)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids found for each row of x, nearest first, and their distances."""
        x = x.astype(np.float32)
        width = min(width, len(self.points))
        own = (x.astype(np.float64) ** 2).sum(1)
        ids = np.repeat(self.entries[None], len(x), 0)
        near = self.norms[ids] - 2 * x @ self.points[self.entries].T
        done = np.zeros(ids.shape, bool)
        rows = np.arange(len(x))[:, None]
        while True:
            waits = np.where(done, np.inf, near)
            take = min(4, waits.shape[1])
            pick = np.argpartition(waits, take - 1, axis=1)[:, :take]
            live = np.isfinite(waits[rows, pick])
            if not live.any():
                break
            done[rows, pick] = True
            new = self.edges[ids[rows, pick]].reshape(len(x), -1)
            d = self.norms[new] - 2 * np.einsum("bkd,bd->bk", self.points[new], x)
            d[np.repeat(~live, self.edges.shape[1], axis=1)] = np.inf
            ids, near, done = np.concatenate([ids, new], 1), np.concatenate([near, d], 1), np.concatenate([done, np.zeros(new.shape, bool)], 1)
            by = np.argsort(ids.astype(np.int64) * 2 + ~done, axis=1)
            ids, near, done = ids[rows, by], near[rows, by], done[rows, by]
            near[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
            keep = np.argpartition(near, width - 1, axis=1)[:, :width] if near.shape[1] > width else np.argsort(near, axis=1)
            ids, near, done = ids[rows, keep], near[rows, keep], done[rows, keep] | ~np.isfinite(near[rows, keep])
        by = np.argsort(near, axis=1)
        return ids[rows, by], np.sqrt(np.maximum(near[rows, by] + own[:, None], 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _sized(df: DataFrame, key: str) -> DataFrame:
    """The number of blocks for each list: a table of a row a list."""
    return df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(key))


def nearest(vectors: DataFrame, top: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each usable vec_id divisible by `step`, its `top` nearest found among all other
    usable vectors of its length by Euclidean distance in double precision, nearest first, ties to the smaller vec_id. Vectors of different lengths
    have no distance; each length has an index of its own, one after the other. Fewer than `top` others give as many rows; no vectors give none."""
    spark = vectors.sparkSession
    prepare(spark)
    base = written(usable(vectors), "vectors")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size, n in sorted(tuple(r) for r in base.groupBy("size").count().collect()):
        if n > 1:
            out = out.unionByName(_nearest(base.where(F.col("size") == size).select("vec_id", "vector"), size, top, step))
    return out


def _nearest(base: DataFrame, dimension: int, top: int, step: int) -> DataFrame:
    """nearest() of a table of usable vectors of one length."""
    spark = base.sparkSession
    # equal vectors: one entry with its smallest ids; the limit applies before the shuffle too
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    entries = written(base.withColumn("k", copy).where(F.col("k") <= top + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    share = min(1.0, SAMPLE / n)
    picked = entries.where(F.xxhash64("vector") / F.lit(2.0**64) + 0.5 <= share).select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    sample = _matrix(picked.column(0).combine_chunks())
    if not len(sample):
        sample = _matrix(entries.select("vector").limit(64).toArrow().column(0).combine_chunks())
    lists = max(1, min(MAX_FLOATS // dimension, len(sample), round(3 * math.sqrt(n))))
    shared = spark.sparkContext.broadcast(Graph(centroids(sample, lists)))
    most = max(MAX_PROBES, lists // PROBED)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = _matrix(part.column(0))
                ids, d = g.search(x, 32)
                chosen = [[int(i[0])] for i in ids]
                for row, i, far in zip(chosen, ids, d):
                    for c, dist in zip(i[1:], far[1:]):
                        if len(row) >= REPLICAS or not dist <= BOUNDARY * far[0]:
                            break
                        if (((g.points[row] - g.points[c]) ** 2).sum(1) > dist * dist).all():
                            row.append(int(c))
                again = np.repeat(np.arange(part.num_rows), [len(r) for r in chosen])
                yield pa.RecordBatch.from_arrays([pa.array([c for r in chosen for c in r], pa.int32()), *(c.take(pa.array(again)) for c in part.columns)], ["list", "vector", "ids"])

    kind = dict(base.dtypes)["vector"]
    posted = written(entries.select("vector", "ids").mapInArrow(assigned, f"list int, vector {kind}, ids array<long>"), "posted")

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, d = g.search(_matrix(part.column(1)), max(BEAM, most + most // 3))
                within = (d <= RATIO * d[:, :1]) & (np.arange(ids.shape[1]) < most)
                within[:, :MIN_PROBES] = np.isfinite(d[:, :MIN_PROBES])
                again = np.nonzero(within)[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[within].astype(np.int32)), *(c.take(pa.array(again)) for c in part.columns)], ["list", "query_id", "vector"])

    asked = written(base.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "vector").mapInArrow(probing, f"list int, query_id long, vector {kind}"), "asked")
    sizes = written(_sized(posted, "vb").join(_sized(asked, "qb"), "list"), "list-sizes")  # a row a list
    own = lambda df, mine, other, key: df.join(F.broadcast(sizes), "list").withColumns({mine: F.pmod(F.xxhash64(key), F.col(mine)).cast("int"), other: F.explode(F.expr(f"sequence(0, {other} - 1)"))})
    left = own(posted, "vb", "qb", "vector").select("list", "vb", "qb", "vector", "ids")
    right = own(asked, "qb", "vb", "query_id").select("list", "vb", "qb", "query_id", "vector")

    def ranked(held: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(queries):
            v = np.stack(held["vector"].to_numpy()).astype(np.float64)
            members = held["ids"].to_list()
            for q, x in zip(queries["query_id"], queries["vector"]):
                d = np.sqrt(((v - np.asarray(x, np.float64)) ** 2).sum(1))
                k = min(len(d), top + 1)
                limit = np.partition(d, k - 1)[k - 1]  # ties with the last stay
                found = sorted((d[i], m) for i in np.flatnonzero(d <= limit) for m in members[i] if m != q)[:top]
                out += [(q, m, s) for s, m in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    made = left.groupBy("list", "vb", "qb").cogroup(right.groupBy("list", "vb", "qb")).applyInPandas(ranked, "query_id long, vec_id long, score double")
    made = made.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return made.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
