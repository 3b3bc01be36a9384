"""Nearest neighbours by collision counting over single projections.

Each vector is projected on many random lines; a line's projections form one sorted array. A query
opens a window centred on its own projection in every array; virtual rehashing widens all windows by
a common factor, and only what is newly covered is counted. A vector that has collided in enough
arrays is verified by its true distance. The search ends when the k-th distance found is within the
radius that the windows stand for, or when the windows cover everything. Windows and threshold are set
between the collision rates of near and far vectors, so that few of the far ones are verified.

Vectors are dealt into shards of bounded size, queries into blocks of bounded size; each pair of a
block and a shard is searched by itself and the best k of all shards are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from paperloom.llm.common import load, query

# The share of lines on which two vectors collide tells their distance to within about 3 in 100, so
# that vectors a third farther than the neighbours seldom reach the threshold.
LINES = 256
# A window of radius r reaches r * HALF to both sides: a vector at distance r falls into it with
# probability P(|N(0, 1)| <= HALF) = 0.83, on 212 of LINES lines with a standard deviation of 6.
# THRESHOLD asks for a little less; nearer vectors collide more often. At 1.3 r only 181 are expected.
HALF = 1.37
THRESHOLD = 205
# Radii grow by this factor, from the corpus' spread times START.
GROW = 1.06
START = 0.05
SHARD_ROWS = 20_000
BLOCK_QUERIES = 1_000
SEED = 11


def lines(dim: int, count: int = LINES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, count))


class Shard:
    """Sorted projections of some vectors; verified counts the distances computed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.lines = lines(vectors.shape[1])
        flat = np.ascontiguousarray((vectors @ self.lines).T)
        self.order = np.argsort(flat, axis=1, kind="stable")
        self.sorted = np.take_along_axis(flat, self.order, axis=1)
        # Spread: the root mean square distance from the mean.
        self.spread = float(np.sqrt(((vectors - vectors.mean(0)) ** 2).sum(1).mean()))
        self.verified = 0

    def _radii(self, at: np.ndarray) -> np.ndarray:
        """Radii of the rounds; the last stands for windows over everything."""
        start = self.spread * START
        if not np.isfinite(start):
            return np.array([np.inf])
        start = max(start, 1e-12)
        farthest = max(np.abs(self.sorted[:, 0] - at).max(), np.abs(self.sorted[:, -1] - at).max()) / HALF
        rounds = int(np.ceil(np.log(farthest / start) / np.log(GROW))) if start < farthest < np.inf else 0
        return np.r_[start * GROW ** np.arange(rounds), np.inf]

    def nearest(self, own: int, vector: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest found, as (distance, id): nearest first, ties to the smaller id."""
        n = len(self.ids)
        at = vector @ self.lines
        radii = self._radii(at)
        wide = radii[:-1] * HALF
        # Where the window of each round begins and ends in each line, the last one over all of it.
        low, high = np.zeros((LINES, len(radii)), np.int64), np.full((LINES, len(radii)), n)
        for j, (row, x) in enumerate(zip(self.sorted, at)):
            low[j, :-1], high[j, :-1] = np.searchsorted(row, x - wide, "left"), np.searchsorted(row, x + wide, "right")
        count = np.zeros(n, np.int64)
        seen = self.ids == own
        wanted = min(k, n - int(seen.sum()))
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        before = None
        for t, radius in enumerate(radii):
            if wanted == 0:
                break
            a, b = low[:, t].tolist(), high[:, t].tolist()
            if before is None:
                fresh = [row[x:y] for row, x, y in zip(self.order, a, b) if x < y]
            else:
                fresh = [row[x:y] for row, x, y in zip(self.order, a, before[0]) if x < y]
                fresh += [row[x:y] for row, x, y in zip(self.order, before[1], b) if x < y]
            before = a, b
            if not fresh:
                continue
            count += np.bincount(np.concatenate(fresh), minlength=n)
            found = np.flatnonzero((count >= THRESHOLD) & ~seen)
            if len(found):
                self.verified += len(found)
                seen[found] = True
                ids = np.concatenate([ids, self.ids[found]])
                dist = np.concatenate([dist, np.sqrt(((self.vectors[found] - vector) ** 2).sum(1))])
                # Only the best k, and what ties with the last of them, can matter.
                if len(ids) > k:
                    keep = dist <= np.partition(dist, k - 1)[k - 1]
                    ids, dist = ids[keep], dist[keep]
            if len(ids) >= wanted and np.partition(dist, wanted - 1)[wanted - 1] <= radius:
                break
        best = np.lexsort((ids, dist))[:k]
        return [(float(dist[i]), int(ids[i])) for i in best]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows of (_id, _vector as doubles, _dim): no null, zero, or non-finite vectors, one per id."""
    v = F.col("_vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
        .filter(F.col("_id").isNotNull() & v.isNotNull())
        .filter(finite & F.exists(v, lambda x: x != 0))
        .withColumn("_dim", F.size("_vector"))
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Rows of (query_id, rank, vec_id, score): each query's k nearest by Euclidean distance.

    score is the distance in double precision on the vectors as given. Vectors that are null, empty
    or zero, or hold null, NaN or infinite components, take no part, nor do rows with a null id, nor
    vectors of another dimension than the query's. Rows that repeat an id are one vector, the
    smallest by components. A query is never its own neighbour; ties go to the smaller id; with
    fewer than k candidates all are returned; empty tables give an empty table; other columns are
    not read.
    """
    every, asked = _usable(vectors, id_col, vector_col), _usable(queries, id_col, vector_col)
    sizes = {r["_dim"]: r["n"] for r in every.groupBy("_dim").agg(F.count("*").alias("n")).collect()}
    blocks_of = {r["_dim"]: r["n"] for r in asked.groupBy("_dim").agg(F.count("*").alias("n")).collect()}
    parts = lambda counts, size: F.coalesce(*[F.when(F.col("_dim") == d, -(-n // size)) for d, n in sorted(counts.items())], F.lit(1))
    shards, blocks = parts(sizes, shard_rows), parts(blocks_of, block_queries)
    shard = F.pmod(F.xxhash64("_id", F.lit(1)), shards).cast("int")
    block = F.pmod(F.xxhash64("_id", F.lit(2)), blocks).cast("int")
    # A block goes to every shard of its dimension and a shard to every block.
    left = every.withColumn("_shard", shard).withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = asked.withColumn("_block", block).withColumn("_shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    key = ["_dim", "_block", "_shard"]

    def search(own: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(some):
            ids, table = _distinct(own)
            index = Shard(ids, table)
            for qid, vector in zip(*_distinct(some)):
                out += [(int(qid), d, i) for d, i in index.nearest(int(qid), vector, k)]
        return pd.DataFrame(out, columns=["query_id", "score", "vec_id"]).astype({"query_id": "int64", "score": "float64", "vec_id": "int64"})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, score double, vec_id long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _distinct(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = rows["_id"].to_numpy()
    table = np.array(rows["_vector"].tolist(), np.float64)
    order = np.lexsort((*table.T[::-1], ids))
    ids, table = ids[order], table[order]
    first = np.r_[True, ids[1:] != ids[:-1]]
    return ids[first], table[first]


@query("op6_collision_search")
def op6_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
