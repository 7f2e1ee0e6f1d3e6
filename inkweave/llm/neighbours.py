"""Approximate nearest neighbours by collision counting over query-centred windows.

Every vector is projected on ``PROJECTIONS`` random directions, and each projection of a shard is a sorted array. A query puts
a window around its own projection in every array and widens all of them step by step (virtual rehashing: a wider
window stands for a coarser bucket). The windows' ends come from binary searches, and a vector lies in a window if its place in that array does. A vector found in ``NEEDED`` windows or
more is verified: its true distance is computed. Widening ends when a vector as near as the k-th verified one would have been
found with a probability of ``FOUND``, or when the windows hold everything: the difference of two projections is normal with the distance
as its deviation, so the number of windows that hold it is binomial. Steps go to where the counts say that the next vectors come to the threshold, the last one to just that width. No cap is put on candidates.

How sharply the threshold parts near from far depends on the number of projections alone. Of 2,000 evenly spread unit vectors of 64 dimensions,
whose tenth neighbour is at 0.82 of the middle distance, 256 projections verify 7 % at a recall of 0.96, 96 verified 49 %; the farther the
neighbours stand out, the fewer. A window covers most of an array on such data, so counts are kept where the arrays are: a row for each
collision would be some two hundred times as many rows as there are pairs.

Shards and blocks of queries are cut by bytes (``SHARD_BYTES``, ``BLOCK_BYTES``), so a task's memory is bounded whatever the table
holds; a vector travels once for each block of some 65,000 queries of 64 dimensions. How a vector is placed depends on its id alone, so one vector that is
common costs no task more. Each task gives k rows a query at most, which are then ranked.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part. Vectors of other lengths than the query's aren't its
candidates. Ties go to the smaller vec_id. A vec_id that stands in several rows is a query once (with its smallest
vector), and none of its rows is its own candidate. Directions are drawn from a fixed seed, so reruns agree.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, erf, sqrt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PROJECTIONS, NEEDED, FOUND = 256, 228, 0.85
SHARD_BYTES, BLOCK_BYTES, MOST_ROWS = 48 << 20, 32 << 20, 60_000
FOUND_ROWS = "query_id bigint, vec_id bigint, score double, verified bigint"


@lru_cache
def reach(m: int = PROJECTIONS, needed: int = NEEDED, found: float = FOUND) -> float:
    """The half-width of a window, in distances, at which ``needed`` of ``m`` windows hold a vector with probability ``found``."""
    low, high = 0.0, 10.0
    for _ in range(60):
        z = (low + high) / 2
        p = erf(z / sqrt(2))
        tail = sum(comb(m, j) * p**j * (1 - p) ** (m - j) for j in range(needed, m + 1))
        low, high = (z, high) if tail < found else (low, z)
    return high


def _half_width(share: float) -> float:
    """How many deviations to either side hold that share of a normal distribution."""
    low, high = 0.0, 10.0
    for _ in range(40):
        z = (low + high) / 2
        low, high = (z, high) if erf(z / sqrt(2)) < share else (low, z)
    return high


class Index:
    """The sorted projections of a shard, and each vector's place in each."""

    def __init__(self, ids, vectors, m: int = PROJECTIONS, seed: int = 7):
        import numpy as np

        if len(ids) > MOST_ROWS:
            raise ValueError("places have 16 bits")
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.directions = np.random.default_rng(seed).normal(size=(vectors.shape[1], m))
        h = np.ascontiguousarray((self.vectors @ self.directions).T)
        self.spread, self.middle = float(h.std()) or 1.0, float(h.mean())
        #: The arrays one after the other; each is moved beyond the one before it, so that one search serves all.
        self.apart = 4 * float(np.abs(h - self.middle).max()) + 1.0
        order = np.argsort(h, axis=1, kind="stable")
        self.sorted = (np.take_along_axis(h, order, axis=1) - self.middle + self.apart * np.arange(m)[:, None]).ravel()
        self.places = np.empty(h.shape, dtype=np.uint16)
        np.put_along_axis(self.places, order, np.arange(h.shape[1], dtype=np.uint16)[None, :], axis=1)

    def collisions(self, at, width: float):
        """In how many windows around ``at`` each vector lies, and whether these hold everything."""
        import numpy as np

        m, n = self.places.shape
        reached, starts = min(width, self.apart / 2), np.arange(m) * n
        low, high = (np.clip(np.searchsorted(self.sorted, at + way, side=side) - starts, 0, n) for way, side in ((-reached, "left"), (reached, "right")))
        first, size = low.astype(np.uint16)[:, None], (high - low).astype(np.uint16)[:, None]
        counts = np.zeros(n, dtype=np.uint16)
        for j in range(0, m, 32):  # a place before the window becomes a large number
            counts += ((self.places[j : j + 32] - first[j : j + 32]) < size[j : j + 32]).sum(axis=0, dtype=np.uint16)
        return counts, int((high - low).min()) >= n

    def nearest(self, queries, query_ids, k: int, needed: int = NEEDED, found: float = FOUND):
        """For each query the ids and distances of the k nearest that were found, and how many were verified."""
        import numpy as np

        m, n = self.places.shape
        z, there = reach(m, needed, found), _half_width(needed / m)
        for q in range(len(queries)):
            at = np.clip(queries[q] @ self.directions - self.middle, -self.apart / 4, self.apart / 4) + self.apart * np.arange(m)
            known, distance, verified = self.ids == query_ids[q], np.full(n, np.inf), 0
            width, last = 0.1 * self.spread, np.inf
            while True:
                counts, whole = self.collisions(at, width)
                new = np.flatnonzero((counts >= needed) & ~known)
                if len(new):
                    known[new] = True
                    distance[new] = np.sqrt(((self.vectors[new] - queries[q]) ** 2).sum(axis=1))
                    verified += len(new)
                if verified >= k:
                    last = z * np.partition(distance, k - 1)[k - 1]
                if width >= last or whole:
                    break
                #: Where the k-th most frequent vector, that isn't verified, would come to the threshold, were its distance what its count says.
                rest = counts[~known]
                share = float(np.partition(rest, max(0, len(rest) - k))[max(0, len(rest) - k)]) / m if len(rest) else 0.0
                wanted = width * there / max(0.05, _half_width(share)) if share > 0.2 else 2 * width
                width = min(max(1.04 * width, min(0.95 * wanted, 2 * width)) if verified < k else 1.08 * width, last)
            best = np.lexsort((self.ids, distance))[: min(k, verified)]
            yield self.ids[best], distance[best], verified


def usable(vector: str) -> F.Column:
    finite = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return F.expr(f"coalesce({vector} IS NOT NULL AND size({vector}) > 0 AND {finite} AND exists({vector}, x -> x <> 0), false)")


def _search(k: int):
    def run(_key, vectors, queries):
        import numpy as np
        import pyarrow as pa

        def matrix(t, column):
            v = t.column(column).combine_chunks()
            return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

        out = [[], [], [], []]
        if vectors.num_rows and queries.num_rows:
            ids, asked = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            for q, (found, score, n) in zip(asked, Index(ids, matrix(vectors, "v")).nearest(matrix(queries, "q"), asked, k)):
                for column, values in zip(out, (np.full(len(found), q), found, score, np.where(np.arange(len(found)) == 0, n, 0))):
                    column.append(values)
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)], names=["query_id", "vec_id", "score", "verified"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int | None = None, block: int | None = None, report: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` found for each row of ``queries``; both have
    vec_id and embedding. ``shard`` and ``block`` are rows. A ``report`` adds verified: how many vectors the query was compared with."""
    clean = lambda df: df.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows, asked = clean(vectors), clean(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = vectors.select(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    wide = max(1, sizes.d or 1)
    shard, block = shard or min(MOST_ROWS // 2, max(1, SHARD_BYTES // (8 * wide + 20 * PROJECTIONS))), block or max(1, BLOCK_BYTES // (8 * wide))
    shards, blocks = max(1, -(-sizes.n // shard)), max(1, -(-queries.select("vec_id").count() // block))
    dealt = lambda parts: F.pmod(F.xxhash64("vec_id", F.lit(parts)), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    d = F.size("v").alias("d")
    left = rows.select("vec_id", "v", d, dealt(shards).cast("int").alias("shard"), every(blocks).alias("block"))
    right = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), d, every(shards).alias("shard"), dealt(blocks).cast("int").alias("block"))
    key = ("d", "shard", "block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_search(k), FOUND_ROWS)
    if report:  # a task tells it on one row
        found = found.withColumn("verified", F.sum("verified").over(Window.partitionBy("query_id")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *["verified"] * report)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))
