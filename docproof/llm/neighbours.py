"""Approximate nearest neighbours: an inverted multi-index.

Each half of a vector is quantised by its own codebook (k-means on a bounded sample), so K centroids
a half make K*K cells. A query walks centroid pairs in ascending sum of the two half distances with
a heap until the visited cells hold a given share of the entries; every entry of those cells is
reranked by the exact inner product of the original vectors in double precision.

The share is calibrated: on bounded samples of queries and entries it is the smallest at which the
brute-force neighbours are found with `recall`. Structured vectors need a small share, vectors
without structure a large one.

Every usable row is indexed. Cells are cut into salted blocks, so a cell that holds a third of all
rows is spread over many tasks, and each block answers each query with at most k rows.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither as queries nor as candidates; a null vec_id takes no part; of
rows that share a vec_id the smallest vector, component by component, counts; with fewer candidates than k all are returned; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docproof.llm._common import saved, shuffle_parts, small_batches, table

#: Centroids a half, by the number of rows: as many as give cells of about CELL_ROWS rows, within these bounds; the upper one keeps
#: some 40 rows of the sample for each. Rows of the samples the codebooks and the share are fitted on.
CENTROIDS, CELL_ROWS, FIT_ROWS, PROBE_QUERIES, PROBE_ROWS = (32, 256), 64, 10_000, 200, 10_000
#: Aimed at in calibration; the promised recall is 0.9.
RECALL = 0.96
#: Entries are dealt by their first half's centroid and cut into blocks: of a 12th of all rows, within
#: these bounds, whatever one cell holds. Queries come in blocks of at most so many.
BLOCK_ROWS, QUERY_ROWS = (500, 50_000), 8192


@dataclass
class Index:
    books: tuple[np.ndarray, np.ndarray]  # centroids of the halves
    counts: np.ndarray  # entries by cell, [K, K]
    share: float
    ids: np.ndarray  # the sample's ids and vectors
    sample: np.ndarray
    sample_cells: np.ndarray

    def bound(self, query_id: int, query: np.ndarray, visited: np.ndarray, k: int) -> float:
        """The query's k-th best score among the visited cells' part of the sample: that of all their rows is no smaller."""
        scores = (self.sample @ query)[(self.ids != query_id) & (visited[self.sample_cells] > 0)]
        return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        first, second = halves(x)
        return distances(first, self.books[0]).argmin(1) * self.books[1].shape[0] + distances(second, self.books[1]).argmin(1)

    def walk(self, query: np.ndarray) -> list[int]:
        """Cells in ascending summed distance until they hold the share of all entries."""
        a, b = (distances(h, book)[0] for h, book in zip(halves(query[None]), self.books, strict=True))
        i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        need, found, out = self.share * self.counts.sum(), 0, []
        heap, seen = [(a[i_order[0]] + b[j_order[0]], 0, 0)], {(0, 0)}
        while heap and found < need:
            _, i, j = heapq.heappop(heap)
            cell_i, cell_j = i_order[i], j_order[j]
            if self.counts[cell_i, cell_j]:
                found += int(self.counts[cell_i, cell_j])
                out.append(int(cell_i) * len(b) + int(cell_j))
            for at in ((i + 1, j), (i, j + 1)):
                if at[0] < len(a) and at[1] < len(b) and at not in seen:
                    seen.add(at)
                    heapq.heappush(heap, (a[i_order[at[0]]] + b[j_order[at[1]]], *at))
        return out


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    book = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = distances(x, book).argmin(1)
        for c in range(k):
            own = x[at == c]
            book[c] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    return book


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in component order, so that equal vectors get equal scores."""
    return np.cumsum(vectors * query, axis=1)[:, -1] if vectors.shape[1] else np.zeros(len(vectors))


def calibrated(index: Index, queries: np.ndarray, rows: np.ndarray, k: int, recall: float) -> float:
    """The share of entries to visit: by bisection on the samples."""
    if len(rows) <= k or not len(queries):
        return 1.0
    cells = index.cells(rows)
    own = Index(index.books, np.bincount(cells, minlength=index.counts.size).reshape(index.counts.shape), 1.0, index.ids, index.sample, index.sample_cells)
    ranks = []
    cell_at = np.zeros(index.counts.size)
    for q in queries:
        order = own.walk(q)
        sizes = np.array([own.counts.reshape(-1)[c] for c in order])
        cell_at[order] = np.cumsum(sizes) - sizes  # entries visited before the cell
        score = rows @ q
        best = np.argpartition(-score, k)[: k + 1]
        best = best[np.argsort(-score[best])][1:]  # without the query itself
        ranks.append(cell_at[cells[best]] / len(rows))
    share = float(np.quantile(np.concatenate(ranks), recall))
    return min(1.0, share + 2.0 / len(rows))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and its vector in doubles, for the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = (
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    )
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").select("d").first()
    return rows.where(F.size("v") == (width[0] if width else 0))


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def build(rows: DataFrame, k: int, centroids: int | None = None, recall: float = RECALL) -> tuple[Index, DataFrame] | None:
    """Fits codebooks and share on bounded samples and assigns every row its cell."""
    spark = rows.sparkSession
    order = F.xxhash64("vec_id")
    sample = rows.orderBy(order, "vec_id").limit(FIT_ROWS).collect()
    if not sample:
        return None
    x = np.array([r.v for r in sample])
    if centroids is None:
        n = len(sample) if len(sample) < FIT_ROWS else rows.count()
        centroids = min(CENTROIDS[1], max(CENTROIDS[0], round((n / CELL_ROWS) ** 0.5)))
    index = Index(tuple(kmeans(h, centroids) for h in halves(x)), np.zeros(1, int), 1.0, np.array([r.vec_id for r in sample]), x, np.zeros(0, int))
    index.counts, index.sample_cells = np.zeros((len(index.books[0]), len(index.books[1])), int), index.cells(x)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = matrix(b.column(1))
                yield pa.record_batch([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(shared.value.cells(x), pa.int32())], names=["vec_id", "v", "cell"])

    celled = saved(rows.mapInArrow(assign, "vec_id long, v binary, cell int"), "cells")
    counts = index.counts.reshape(-1)
    for r in celled.groupBy("cell").count().collect():  # at most centroids**2 rows
        counts[r[0]] = r[1]
    index.share = calibrated(index, x[:PROBE_QUERIES], x[:PROBE_ROWS], k, recall)
    return index, celled


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of `queries`."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    small_batches(spark, 2000)
    built = build(usable(vectors), k, recall=recall)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, celled = built
    shared = spark.sparkContext.broadcast(index)
    second, total = index.counts.shape[1], int(index.counts.sum())
    block = min(max(BLOCK_ROWS[0], total // 12), BLOCK_ROWS[1])
    salts = np.maximum(1, -(-index.counts.sum(1) // block))
    salt_of = F.get(F.array(*[F.lit(int(n)) for n in salts]), F.col("part"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, q in zip(b.column(0).to_pylist(), matrix(b.column(1)), strict=True):
                cells = np.array(shared.value.walk(q), np.int64)
                mask = np.zeros(index_cells, np.uint8)
                mask[cells] = 1
                raw, bound = q.tobytes(), shared.value.bound(i, q, mask, k)
                # a part is told of its own cells alone
                rows += [(i, raw, np.packbits(mask[p * second : (p + 1) * second]).tobytes(), bound, int(p), s) for p in np.unique(cells // second).tolist() for s in range(int(salts[p]))]
            for first in range(0, len(rows), 5000):
                cols = list(zip(*rows[first : first + 5000], strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["query_id", "q", "mask", "bound", "part", "salt"])

    def rerank(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        order = np.argsort(np.asarray(left["cell"]), kind="stable")
        cells, ids = np.asarray(left["cell"])[order], np.asarray(left["vec_id"])[order]
        x = np.frombuffer(b"".join(left["v"].to_pylist()), np.float64).reshape(len(ids), -1)[order]
        firsts = np.flatnonzero(np.diff(cells, prepend=-1))
        lasts = np.append(firsts[1:], len(cells))
        asked, q = np.asarray(right["query_id"]), np.frombuffer(b"".join(right["q"].to_pylist()), np.float64).reshape(len(right), -1)
        masks = np.unpackbits(np.frombuffer(b"".join(right["mask"].to_pylist()), np.uint8).reshape(len(right), -1), axis=1)
        bounds = np.asarray(right["bound"])
        found: list[tuple] = []
        for at in range(0, len(asked), 256):
            some = slice(at, at + 256)
            scores = np.full((len(asked[some]), len(ids)), -np.inf)
            for first, last in zip(firsts, lasts, strict=True):
                who = np.flatnonzero(masks[some, cells[first] % second])
                scores[who, first:last] = q[some][who] @ x[first:last].T
            for query_id, vector, score, bound in zip(asked[some], q[some], scores, bounds[some], strict=True):
                score[ids == query_id] = -np.inf
                least = max(bound, np.partition(score, len(score) - k)[len(score) - k] if len(ids) > k else -np.inf)
                # all within rounding of the k-th best
                near = np.flatnonzero((score >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else score > -np.inf))
                exact = products(x[near], vector)
                best = top(exact, ids[near], k)
                found += zip([int(query_id)] * len(best), ids[near][best].tolist(), exact[best].tolist(), strict=True)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    index_cells = index.counts.size
    wanted = usable(queries)
    blocks = max(1, -(-wanted.count() // QUERY_ROWS))
    entries = (
        celled.withColumn("part", F.expr(f"cell div {second}").cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64("vec_id"), salt_of).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    asked = wanted.repartition(shuffle_parts(spark)).mapInArrow(visit, "query_id long, q binary, mask binary, bound double, part int, salt int")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    keys = ["part", "salt", "block"]
    found = entries.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rerank, out)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), 20)
