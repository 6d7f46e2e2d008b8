"""Nearest neighbours by collision-counting hashing.

Every projection is one sorted array of the vectors' projections. A query counts, for all vectors, in how many
projections they fall in the window around its own projection. Virtual rehashing widens all windows together; vectors that
reach the collision threshold are verified by the exact measure, until the windows are so wide that a vector as near
as the k-th verified one would have reached the threshold with a margin of Z standard deviations.

Inner product becomes distance by an extra coordinate sqrt(M**2 - |x|**2), where M is the largest norm of a block, for
queries scaled to norm M; so the nearest vectors have the largest inner products. Blocks hold a narrow range of norms,
longest first, and the best found so far counts in the next: it ends a block's windows early, and a block whose norm times the
query's can't reach it is not looked at. The arrays of several blocks, a part, are built once in the task that holds them, and
queries stream past them; the best of each part merge by rank. Where there are fewer parts than cores, a part is held by
several tasks, each for a stripe of the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged

#: Vectors of a part and of a block, and the largest ratio of norms in a block.
PART_ROWS, BLOCK_ROWS, NORMS = 65_536, 16_384, 2**0.25
#: Projections; the half-width of windows over a distance at which they are wide enough, in standard deviations of a
#: projection, and the chance that a vector at that distance falls into one; margin of the threshold.
PROJECTIONS, WIDTH, CHANCE, Z = 130, 1.44, 0.8501, 1.0
THRESHOLD = int(np.floor(PROJECTIONS * CHANCE - Z * np.sqrt(PROJECTIONS * CHANCE * (1 - CHANCE))))
#: Half-width at which a block's first queries begin, for vectors of length 1; each step widens the windows by GROWTH. Later
#: ones begin at what half of those before them needed.
START, GROWTH = 0.05, 1.15
#: Queries whose windows are found together.
TOGETHER = 64
#: Tasks of the search for each core, at least.
TASKS_PER_CORE = 1
RESULT = "query_id long, vec_id long, score double"


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def norms_of(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms without overflow."""
    largest = np.abs(vectors).max(axis=1)
    scale = np.where(largest > 0, largest, 1)
    return np.sqrt(((vectors / scale[:, None]) ** 2).sum(axis=1)) * largest


class Block:
    """One block's sorted projections. Vectors are scaled so that their largest norm is 1; so are queries."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, rows: np.ndarray, lines: np.ndarray):
        self.rows, self.largest, self.start = rows, float(norms[rows].max()), START
        self.few = len(rows) <= PROJECTIONS or not self.largest  # not worth arrays: all are verified
        if self.few:
            return
        unit = vectors[rows] / self.largest
        extra = np.sqrt(np.maximum(0, 1 - (norms[rows] / self.largest) ** 2))
        values = np.column_stack([unit, extra]) @ lines
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=0).T.copy()
        self.order = order.T.astype(np.uint16)  # BLOCK_ROWS is below 2**16

    def windows(self, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place in every sorted projection of the windows around the queries' projections."""
        low = np.stack([s.searchsorted(x - width) for s, x in zip(self.sorted, at.T)], axis=1)
        return low, np.stack([s.searchsorted(x + width, "right") for s, x in zip(self.sorted, at.T)], axis=1)

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which vectors stand in THRESHOLD windows; wide windows are counted by what stands outside."""
        n, m = len(self.rows), len(self.order)
        if 2 * (high - low).sum() < n * m:
            return np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, low, high)]), minlength=n) >= THRESHOLD
        outside = [x for o, a, b in zip(self.order, low, high) for x in (o[:a], o[b:])]
        return np.bincount(np.concatenate(outside), minlength=n) <= m - THRESHOLD


class Part:
    """A task's vectors as blocks, longest first."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, exponent: int, seed: int):
        self.vectors, self.ids, self.exponent = vectors, ids, exponent
        dims = vectors.shape[1]
        lines = np.random.default_rng(seed).normal(size=(-(-PROJECTIONS // (dims + 1)), dims + 1, dims + 1))
        self.lines = np.concatenate([np.linalg.qr(x)[0] for x in lines], axis=1)[:, :PROJECTIONS]
        scaled = np.ldexp(vectors, -exponent)
        norms = norms_of(scaled)
        order = np.argsort(-norms, kind="stable")
        self.blocks, at = [], 0
        while at < len(order):
            end = int(np.searchsorted(-norms[order], -norms[order[at]] / NORMS, "right"))
            end = min(max(end, at + 1), at + BLOCK_ROWS)
            self.blocks.append(Block(scaled, norms, order[at:end], self.lines))
            at = end
        self.verified = 0

    def products(self, rows: np.ndarray, query: np.ndarray, scaled: np.ndarray) -> np.ndarray:
        """Inner products of the original vectors; where a term overflows, the scaled product tells which infinity it is."""
        with np.errstate(over="ignore", invalid="ignore"):
            out = (self.vectors[rows] * query).sum(axis=1)
            wild = np.flatnonzero(~np.isfinite(out))
            out[wild] = np.ldexp(np.ldexp(self.vectors[rows[wild]], -self.exponent) @ scaled, 2 * self.exponent)
        return out

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query, the places of the best k found, by score, then id, and their scores."""
        scaled = np.ldexp(queries, -self.exponent)
        norms = norms_of(scaled)
        directions = scaled / np.where(norms > 0, norms, 1)[:, None]
        at, root = directions @ self.lines[:-1], np.sqrt(queries.shape[1] + 1)
        found = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        reach = np.full(len(queries), -np.inf)  # scaled product of the k-th best found

        def verify(q: int, rows: np.ndarray) -> None:
            rows = rows[self.ids[rows] != query_ids[q]]
            self.verified += len(rows)
            rows, scores = np.concatenate([found[q][0], rows]), np.concatenate([found[q][1], self.products(rows, queries[q], scaled[q])])
            best = np.lexsort((self.ids[rows], -scores))[:k]
            found[q] = rows[best], scores[best]
            if len(best) == k:
                reach[q] = np.ldexp(self.vectors[rows[best[-1]]], -self.exponent) @ directions[q]

        for block in self.blocks:
            waiting = np.flatnonzero(reach < block.largest)
            if not len(waiting):
                break  # neither this block nor a shorter one has a larger product
            # The width that is enough, by the distance at which a vector would equal the k-th best.
            needed = lambda q: WIDTH * np.sqrt(np.maximum(0, 2 - 2 * reach[q] / block.largest)) / root if block.largest else np.full(len(q), np.inf)  # noqa: E731, B023
            for asked in np.split(waiting, range(TOGETHER, len(waiting), TOGETHER)):
                if block.few:
                    for q in asked:
                        verify(q, block.rows)
                    continue
                width = needed(asked)
                width[np.isinf(width)] = block.start
                seen = np.zeros((len(asked), len(block.rows)), bool)
                active = np.arange(len(asked))
                while len(active):
                    low, high = block.windows(at[asked[active]], width[active])
                    for i, a, b in zip(active, low, high):
                        over = block.over(a, b)
                        verify(asked[i], block.rows[over & ~seen[i]])
                        seen[i] |= over
                    enough = needed(asked[active])
                    whole = (high - low).sum(axis=1) == block.order.size
                    more = ~whole & (width[active] < enough * (1 - 1e-12))
                    active, enough = active[more], enough[more]
                    width[active] = np.minimum(width[active] * GROWTH, np.where(np.isinf(enough), np.inf, enough))
                used = needed(asked)
                block.start = float(np.median(used[np.isfinite(used)])) if np.isfinite(used).any() else block.start
        return found


def best_of_part(part: Part, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    """Each query's k best in the part, ties to the smaller id."""
    found = part.nearest(query_ids, queries, k)
    columns = [np.repeat(query_ids, [len(rows) for rows, _ in found]), np.concatenate([part.ids[rows] for rows, _ in found]), np.concatenate([scores for _, scores in found])]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "vec_id", "score"])


def search(batches: Iterator[pa.RecordBatch], k: int, dims: int, exponent: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, asks, id, embedding), each part's vectors before the queries that ask it. Holds one part at a time."""
    current, ids, vectors, held = None, [], [], None
    for batch in batches:
        part, asks, row_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "asks", "id"))
        embedding = matrix(batch.column("embedding"), dims)
        starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])]) if len(part) else []
        for a, b in zip(starts, [*starts[1:], len(part)]):
            if part[a] != current:
                current, ids, vectors, held = part[a], [], [], None
            if not asks[a]:
                ids.append(row_ids[a:b])
                vectors.append(embedding[a:b])
            elif ids:
                if held is None:
                    held, vectors = Part(np.concatenate(vectors), np.concatenate(ids), exponent, seed), []
                yield best_of_part(held, row_ids[a:b], embedding[a:b], k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: the k found vectors of largest inner product with each query, itself excluded.

    vectors, queries: vec_id, embedding. Rows whose embedding is null, empty, zero, or holds a null or non-finite
    component, or whose id is null, take no part; nor do those whose length isn't the commonest one (the longer on a
    tie). Of rows that share an id one takes part, the one of the smallest embedding. Ties go to the smaller vec_id. With
    fewer than k candidates all are found. Large finite components take part: lengths are compared after scaling by a power
    of two, and a score too large for a double is infinite. Other columns, whatever their names, are ignored. Empty
    tables give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)

    def sound(rows: DataFrame) -> DataFrame:
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
        rows = rows.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
        return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    rows = staged(sound(vectors), "vectors")
    largest = F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x)))).alias("largest")
    shapes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"), largest).orderBy(F.desc("n"), F.desc("dims")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if shapes is None:
        return spark.createDataFrame([], result)
    dims, n, exponent = shapes.dims, shapes.n, int(np.frexp(shapes.largest)[1])
    asked = sound(queries).where(F.size("embedding") == dims)
    n_parts = -(-n // PART_ROWS)
    stripes = -(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // n_parts)
    hashed = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    held = rows.where(F.size("embedding") == dims).select(hashed(n_parts).alias("of"), every(stripes).alias("stripe"), F.lit(False).alias("asks"), "vec_id", "embedding")
    asking = asked.select(every(n_parts).alias("of"), hashed(stripes).alias("stripe"), F.lit(True).alias("asks"), "vec_id", "embedding")
    parts = held.unionAll(asking).select((F.col("of") * stripes + F.col("stripe")).alias("part"), "asks", F.col("vec_id").alias("id"), "embedding")
    parts = parts.repartitionById(n_parts * stripes, F.col("part").cast("int")).sortWithinPartitions("part", "asks", "id")
    found = parts.mapInArrow(lambda batches: search(batches, k, dims, exponent, seed), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
