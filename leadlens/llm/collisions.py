"""Nearest neighbours by collision counting over sorted single projections.

Distinct vectors are dealt over shards. A shard keeps, for each of ``PROJECTIONS`` random
directions, its vectors' projections in one sorted array. Around a query's projection a window of
half-width ``HALF`` x R is open in every array, and the windows that hold a vector are counted; a
vector at distance R from the query is in a window with probability p = P(|N(0, 1)| <= HALF). What
reaches ``threshold`` counts (p times the windows, less ``SLACK`` standard deviations) is verified:
its distance is taken on the original vectors in double precision. While the k-th verified distance
exceeds R, R grows by ``GROWTH`` and the windows take in what lies beyond their old ends (virtual
rehashing: the arrays stay as they are). No number of candidates ends a search early; a query whose
windows are used up verifies all that is left.

The answers of all shards are merged, k at most from each. Equal vectors are one point with its
k + 1 smallest ids, which is all that k neighbours can show of it, and equal queries search once.
Every shard meets every query, in blocks; a shard is built once, in one task, of bounded bytes.

Rows with null vec_id, null or empty vectors, zero vectors, or null or non-finite components take
no part. Of rows that repeat a vec_id the smallest vector counts. Vectors meet only those of their
own length. Ties go to the smaller vec_id. A query without candidates has no rows; an empty table
gives none. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import Scratch, prepare, shuffle_partitions, table

PROJECTIONS, HALF, SLACK, GROWTH = 64, 1.1, 0.7, 1.12
#: Bytes of the vectors of a shard; a shard also has sixteen bytes for each vector and projection.
SHARD_BYTES = 1 << 26
#: Smaller tables are dealt over the session's partitions, so many vectors each at least.
SHARD_LEAST = 4096
_ROUNDS = 100


def threshold(m: int = PROJECTIONS) -> int:
    """Least count of a candidate."""
    p = math.erf(HALF / math.sqrt(2))
    return math.floor(m * p - SLACK * math.sqrt(m * p * (1 - p)))


def directions(dim: int, m: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    """``m`` Gaussian directions as columns, orthogonal to each other within every ``dim`` of them."""
    rng = np.random.default_rng([seed, dim])
    blocks = []
    for _ in range(-(-m // dim)):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        blocks.append(q * np.sign(np.diag(r)) * np.sqrt(rng.chisquare(dim, dim)))
    return np.concatenate(blocks, 1)[:, :m]


class Shard:
    """Sorted projections of vectors (rows of equal length) and their search."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, n = vectors, len(vectors)
        self.unit = float(np.abs(vectors).max()) or 1.0  # projections are of vectors in these units
        self.axes = directions(vectors.shape[1])
        keys = (vectors / self.unit) @ self.axes
        self.orders = [np.argsort(keys[:, j], kind="stable") for j in range(keys.shape[1])]
        self.sorted = [keys[o, j] for j, o in enumerate(self.orders)]
        widest = 2 * math.sqrt(vectors.shape[1])  # no two vectors are farther apart, in these units
        self.radii = widest / GROWTH ** np.arange(_ROUNDS - 1, -1, -1)
        self.least = min(threshold(), n * len(self.orders))
        self.verified = 0

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (places, distances) of the vectors found: the k nearest at least."""
        keys = (queries / self.unit) @ self.axes
        reach = HALF * self.radii
        low = np.stack([np.searchsorted(s, keys[:, j, None] - reach, side="left") for j, s in enumerate(self.sorted)], 2)
        high = np.stack([np.searchsorted(s, keys[:, j, None] + reach, side="right") for j, s in enumerate(self.sorted)], 2)
        k = min(k, len(self.vectors))
        for q, lo, hi in zip(queries, low, high, strict=True):
            yield self._one(q, lo, hi, k)

    def _one(self, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.vectors)
        counts, fresh = np.zeros(n, np.int64), np.ones(n, bool)
        places, distances = np.empty(0, np.int64), np.empty(0)
        # k candidates need k x threshold counts: rounds with fewer can find no end. Those with less
        # than a count a vector are passed over too: at most n / threshold vectors qualify there
        first = min(int(np.searchsorted((hi - lo).sum(1), max(k * self.least, n))), _ROUNDS - 1)
        a, b = lo[first], lo[first]  # the windows so far; empty
        for r in range(first, _ROUNDS):
            parts = [o[x:y] for o, x, y in zip(self.orders, lo[r], a, strict=True) if y > x]
            parts += [o[x:y] for o, x, y in zip(self.orders, b, hi[r], strict=True) if y > x]
            a, b = lo[r], hi[r]
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((counts >= self.least) & fresh)
            places, distances = self._verify(query, new, fresh, places, distances)
            if len(distances) >= k and np.partition(distances, k - 1)[k - 1] <= self.radii[r] * self.unit:
                return places, distances
        return self._verify(query, np.flatnonzero(fresh), fresh, places, distances)

    def _verify(self, query, new, fresh, places, distances):
        if len(new):
            fresh[new] = False
            self.verified += len(new)
            with np.errstate(over="ignore"):
                d = np.sqrt(((self.vectors[new] - query) ** 2).sum(1))
            places, distances = np.concatenate((places, new)), np.concatenate((distances, d))
        return places, distances


def nearest_of(places: np.ndarray, distances: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The k smallest (distance, id) of the points found, each with the ids of its rows."""
    if len(distances) > k:  # points that lie beyond the k-th have no row among the k nearest
        near = distances <= np.partition(distances, k - 1)[k - 1]
        places, distances = places[near], distances[near]
    return sorted((d, i) for d, p in zip(distances.tolist(), places.tolist(), strict=True) for i in ids[p])[:k]


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def points(df: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """(vec_id, vec, h1, h2): one row for each id; equal vectors have equal hashes."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda c: c != 0))
    rows = rows.withColumn("vec", F.transform("vec", lambda c: c + F.lit(0.0)))  # no negative zeros
    return (rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
            .select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")))


def neighbours(df: DataFrame, k: int = 10, every: int = 100, vec_col: str = "embedding", id_col: str = "vec_id",
               shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id ``every`` divides."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "collisions")
    rows = scratch.keep(points(df, vec_col, id_col), "rows")
    keep = k + 1
    place = Window.partitionBy("h1", "h2").orderBy("vec_id")
    distinct = scratch.keep(
        rows.withColumn("at", F.row_number().over(place)).where(F.col("at") <= keep)  # cut before the exchange, too
        .groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    n, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    shards = max(1, -(-8 * size // shard_bytes), min(shuffle_partitions(spark), n // SHARD_LEAST))

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asked.dropDuplicates(["h1", "h2"]).select(
        "h1", "h2", "vec", F.lit(None).cast("array<long>").alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    dealt = (distinct.select("h1", "h2", "vec", "ids", F.pmod("h1", F.lit(shards)).cast("int").alias("shard")).union(queries)
             .repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("ids").isNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's vectors come first, then the queries."""
        held: dict[int, tuple[list, list]] = {}
        built: dict[int, Shard] = {}
        for b in batches:
            vecs, ids = _vectors(b.column(2)), b.column(3).to_pylist()
            asked = [i for i, x in enumerate(ids) if x is None]
            for v, x in zip(vecs, ids, strict=True):
                if x is not None:
                    mine = held.setdefault(len(v), ([], []))
                    mine[0].append(v)
                    mine[1].append(x)
            out: list[tuple[int, float, int]] = []
            for dim in sorted({len(vecs[i]) for i in asked}):
                if dim not in held:
                    continue
                if dim not in built:
                    built[dim] = Shard(np.stack(held[dim][0]))
                    held[dim][0].clear()
                own = [i for i in asked if len(vecs[i]) == dim]
                for i, found in zip(own, built[dim].search(np.stack([vecs[i] for i in own]), keep), strict=True):
                    out += [(i, d, v) for d, v in nearest_of(*found, held[dim][1], keep)]
            if out:
                at, score, vec_id = zip(*out, strict=True)
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(score, pa.float64()), pa.array(vec_id, pa.int64())],
                                                 names=["h1", "h2", "score", "found"])

    found = dealt.select("h1", "h2", "vec", "ids").mapInArrow(run, "h1 long, h2 long, score double, found long")
    order = Window.partitionBy("h1", "h2").orderBy("score", "found")
    lists = (found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep)
             .groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("score", "found"))).alias("near")))
    # rows of one vector are many if it is common: its list is dealt to sixteen places
    salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    mine = asked.select("vec_id", "h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int").alias("salt"))
    near = mine.join(salted, ["h1", "h2", "salt"]).select(
        F.col("vec_id").alias("query_id"),
        F.posexplode(F.slice(F.filter("near", lambda x: x["found"] != F.col("vec_id")), 1, k)).alias("place", "hit"))
    return near.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.found").alias("vec_id"), F.col("hit.score").alias("score"))


def op11_collisions(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth embedding among all others."""
    return neighbours(table(spark, sf_dir, "embeddings"))
