"""Approximate nearest neighbours with an inverted multi-index.

Vectors are split into two halves, each quantised to K centroids; a cell is a
pair of centroids, and the index holds every row in the list of its first
centroid, in order of the second. For each query a heap walks the pairs by
growing summed distance until the cells seen hold a share of all rows. The
cells seen are those up to one summed distance, so a query goes to the lists
that have some of them, and there meets the rows of just these cells, which are
reranked by exact distance on the original vectors. All queries are searched in
one pass.

The centroids are fitted on at most ``SAMPLE`` rows (low hashes of vec_id), and
so is the share: of ``PROBES`` rows of the sample the nearest within it are
found by brute force, and the share is what a walk must see to meet ``FOUND`` of
them. It is small where vectors lie in clusters and large where they are spread
like noise. All rows are indexed. K follows the number of rows up to ``MOST``,
so the table of cell sizes has a fixed bound.

Lists are dealt into blocks of ``ROWS`` rows and ``QUERIES`` queries, so a full
cell meets in no single task. Of equal vectors only the ``TOP`` + 1 smallest ids
can be among the nearest of any query, so the others are left out of the lists;
they are still queries.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, as rows without vec_id; of
repeated vec_ids the row with the smallest vector counts; ties go to the
smaller vec_id; an empty table gives no rows; a query for which the cells seen
hold too few rows goes on to all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import at_most, small_batches, stored

SAMPLE, ROUNDS, LEAST_K, MOST = 20_000, 8, 8, 256
PROBES, FOUND, TOP, EVERY = 256, 0.97, 10, 100
#: Rows and queries of a block of a list.
ROWS, QUERIES = 1 << 16, 1 << 14
#: Candidates that a task holds before it keeps the nearest of them.
HELD = 1 << 18


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    zero = F.lit(0.0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != zero)
    )
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres, by differences."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    centres = x[np.random.default_rng(1).choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        mine = ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
        count = np.bincount(mine, minlength=k)
        for j in range(x.shape[1]):
            total = np.bincount(mine, weights=x[:, j], minlength=k)
            centres[count > 0, j] = total[count > 0] / count[count > 0]
    return centres


def cells(x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = first.shape[1]
    near = lambda y, c: ((c**2).sum(axis=1)[None] - 2 * y @ c.T).argmin(axis=1)
    return near(x[:, :half], first), near(x[:, half:], second)


def walk(one: np.ndarray, two: np.ndarray, sizes: np.ndarray, enough: int) -> float:
    """Summed distance of the last pair that a walk over all pairs, nearest
    first, visits until the cells hold ``enough`` rows (infinite if never)."""
    rows, columns = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    one, two = one[rows].tolist(), two[columns].tolist()
    sizes = sizes[np.ix_(rows, columns)].tolist()
    reached = [0] * len(one)  # columns taken of each row; a row opens when the one above has begun
    heap = [(one[0] + two[0], 0)]
    held = 0
    while heap:
        total, i = heapq.heappop(heap)
        j = reached[i]
        held += sizes[i][j]
        if held >= enough:
            return total
        reached[i] = j + 1
        if j + 1 < len(two):
            heapq.heappush(heap, (one[i] + two[j + 1], i))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (one[i + 1] + two[0], i + 1))
    return float("inf")


def fitted_share(x: np.ndarray, first: np.ndarray, second: np.ndarray, top: int, probes: int = PROBES, found: float = FOUND) -> float:
    """Share of the sample that walks must see to meet ``found`` of the nearest."""
    half = first.shape[1]
    a, b = cells(x, first, second)
    sizes = np.bincount(a * len(second) + b, minlength=len(first) * len(second))
    needs = []
    for i in np.random.default_rng(2).permutation(len(x))[:probes]:
        apart = ((x - x[i]) ** 2).sum(axis=1)
        apart[i] = np.inf
        near = np.argsort(apart, kind="stable")[: min(top, len(x) - 1)]
        total = (squared(x[i : i + 1, :half], first)[0][:, None] + squared(x[i : i + 1, half:], second)[0][None]).ravel()
        order = np.argsort(total, kind="stable")
        seen = np.empty(len(total))
        seen[order] = np.cumsum(sizes[order])
        needs.append(seen[a[near] * len(second) + b[near]])
    return float(np.quantile(np.concatenate(needs), found)) / len(x) if needs else 1.0


def _indexed(first: np.ndarray, second: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = cells(matrix(batch.column("embedding"), width), first, second)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["vec_id", "embedding", "a", "b"])

    return run


def _visits(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int, blocks: np.ndarray, width: int):
    """A row for each query and block of a list that has some of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = first.shape[1]
        for batch in batches:
            x = matrix(batch.column("embedding"), width)
            one, two = squared(x[:, :half], first), squared(x[:, half:], second)
            reach = np.array([walk(p, q, sizes, enough) for p, q in zip(one, two, strict=True)])
            query, a = np.nonzero((one + two.min(axis=1)[:, None] <= reach[:, None]) & (blocks > 0)[None])
            times = blocks[a]
            query, a = np.repeat(query, times), np.repeat(a, times)
            block = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(query)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(take), batch.column("embedding").take(take), pa.array(a.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(reach[query])],
                names=["vec_id", "embedding", "a", "block", "reach"],
            )

    return run


class _Search:
    """The queries of one block of a list, and the nearest rows so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, reach: np.ndarray, a: int, first: np.ndarray, second: np.ndarray, top: int):
        half = first.shape[1]
        self.ids, self.queries, self.top = ids, queries, top
        self.left = reach - ((queries[:, :half] - first[a]) ** 2).sum(axis=1)
        self.to_second = squared(queries[:, half:], second)
        # Distances to be compared are measured from the middle of the list: less is lost.
        self.middle = queries.mean(axis=0)
        self.moved = queries - self.middle
        self.norm = (self.moved**2).sum(axis=1)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        self.seen = 0

    def add(self, b: int, vec: np.ndarray, x: np.ndarray) -> None:
        """Rows of one cell, for the queries that see it."""
        mine = np.flatnonzero(self.to_second[:, b] <= self.left * (1 + 1e-12) + 1e-300)
        if not len(mine):
            return
        moved = x - self.middle
        norm = (moved**2).sum(axis=1)
        for at in range(0, len(mine), 2048):
            q = mine[at : at + 2048]
            near = self.norm[q][:, None] + norm[None] - 2 * self.moved[q] @ moved.T
            near[self.ids[q][:, None] == vec[None]] = np.inf
            # What rounding may have added or taken away.
            slip = 1e-13 * (self.norm[q] + norm.max())
            if len(vec) > self.top:
                bound = np.partition(near, self.top - 1, axis=1)[:, self.top - 1] + 2 * slip
                i, j = np.nonzero((near <= bound[:, None]) & np.isfinite(near))
            else:
                i, j = np.nonzero(np.isfinite(near))
            self.found.append((q[i], vec[j], np.sqrt(((self.queries[q[i]] - x[j]) ** 2).sum(axis=1))))
            self.held += len(i)
            self.seen += len(q) * len(vec)
        if self.held >= HELD:
            self.found = [self.best()]
            self.held = len(self.found[0][0])

    def best(self) -> tuple[np.ndarray, ...]:
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, vec, score = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((vec, score, q))
        q, vec, score = q[order], vec[order], score[order]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        return q[rank < self.top], vec[rank < self.top], score[rank < self.top]


def _rerank(first: np.ndarray, second: np.ndarray, top: int, width: int):
    """Rows in order of part; in each the queries, then the list's rows by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                part, b = batch.column("part").to_numpy(), batch.column("b").to_numpy()
                edge = np.flatnonzero((np.diff(part, prepend=part[:1] - 1) != 0) | (np.diff(b, prepend=b[:1] - 1) != 0))
                x = matrix(batch.column("embedding"), width)
                for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True):
                    yield int(part[lo]), int(b[lo]), int(batch.column("a")[lo].as_py()), batch.column("vec_id").to_numpy()[lo:hi], x[lo:hi], batch.column("reach").to_numpy(zero_copy_only=False)[lo:hi]

        for _, group in groupby(pieces(), key=lambda p: p[0]):
            search, waiting = None, []
            for _, b, a, vec, x, reach in group:
                if b < 0:
                    waiting.append((vec, x, reach))
                    continue
                if search is None:
                    if not waiting:
                        break
                    search = _Search(*(np.concatenate(c) for c in zip(*waiting, strict=True)), a, first, second, top)
                search.add(b, vec, x)
            for _ in group:
                pass
            if search is not None:
                q, vec, score = search.best()
                yield pa.RecordBatch.from_arrays([pa.array(search.ids[q]), pa.array(vec), pa.array(score), pa.array(np.where(np.arange(len(q)) == 0, search.seen, 0))], names=["query_id", "vec_id", "score", "seen"])

    return run


def candidates(spark: SparkSession, vectors: DataFrame, every: int = EVERY, top: int = TOP, share: float | None = None) -> DataFrame | None:
    """(query_id, vec_id, score, seen): the nearest of each block of a list;
    ``seen`` sums to the rows that queries met. None if no vector takes part."""
    small_batches(spark)
    rows = stored(spark, usable(vectors))
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return None
    width, n = widths[0]["w"], widths[0]["count"]
    rows = rows.where(F.size("embedding") == width)
    k = int(np.clip(2 ** np.ceil(np.log2(np.sqrt(n / 4))), LEAST_K, MOST))
    sample = at_most(rows, SAMPLE, n, "vec_id").select("vec_id", "embedding").toPandas()
    x = np.array(sample.sort_values("vec_id")["embedding"].tolist(), dtype=float)
    half = width // 2
    first, second = k_means(x[:, :half], k), k_means(x[:, half:], k)
    share = fitted_share(x, first, second, top) if share is None else share
    lone = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    listed = rows.withColumn("nth", lone).where(F.col("nth") <= top + 1).select("vec_id", "embedding")
    index = stored(spark, listed.mapInArrow(_indexed(first, second, width), "vec_id long, embedding array<double>, a int, b int"))
    sizes = np.zeros((k, k), np.int64)
    for row in index.groupBy("a", "b").count().collect():  # at most MOST squared
        sizes[row["a"], row["b"]] = row["count"]
    blocks = -(-sizes.sum(axis=1) // ROWS)
    enough = min(int(sizes.sum()), max(top + 1, int(np.ceil(share * sizes.sum()))))
    asked = rows.where(F.col("vec_id") % every == 0)
    deals = max(1, -(-asked.count() // QUERIES))
    visits = asked.mapInArrow(_visits(first, second, sizes, enough, blocks, width), "vec_id long, embedding array<double>, a int, block int, reach double")
    of_list = F.element_at(F.array(*[F.lit(int(max(1, c))) for c in blocks]), F.col("a") + 1)
    part = F.xxhash64("a", "block", "deal")
    queries = visits.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(deals)).cast("int")).select(part.alias("part"), F.lit(-1).alias("b"), "a", "vec_id", "embedding", "reach")
    dealt = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), of_list).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    lists = dealt.select(part.alias("part"), "b", "a", "vec_id", "embedding", F.lit(0.0).alias("reach"))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    both = queries.unionByName(lists).repartition(n_parts, "part").sortWithinPartitions("part", "b")
    return both.mapInArrow(_rerank(first, second, top, width), "query_id long, vec_id long, score double, seen long")


def nearest(spark: SparkSession, vectors: DataFrame, every: int = EVERY, top: int = TOP, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id ``every`` divides."""
    found = candidates(spark, vectors, every, top, share)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
