"""Uniform shuffle into shards of exact sizes (hypergeometric communication matrix).

The rows sent from source partition p to target block t follow the multivariate hypergeometric
law: the P x T matrix is a uniform contingency table with the partitions' row counts and the
blocks' sizes as margins. It is drawn by halving the range of partitions, every split seeded by
its place in the tree, so a task finds its own row in log2(P) draws and no P x T matrix exists
anywhere. Each task permutes its labels, the rows are exchanged once, and every block is
permuted again by a random key. Block sizes are known beforehand, so a row's slot in its shard
needs no further pass.

Nulls, repeated rows, empty and long texts are rows like any other. An empty table gives no
rows. Columns named like the result's (shard, slot) are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.common import mix64, shuffle_partitions, table, text_of

_NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric number; ratio of uniforms where numpy's own sampler stops (10^9)."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    if not good or not draws:
        return 0
    if not bad or draws == good + bad:
        return min(good, draws)
    n = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mean = draws * good / n
    var = mean * (bad / n) * ((n - draws) / (n - 1))
    mode = math.floor((draws + 1) * (good + 1) / (n + 2))
    lg = math.lgamma

    def weight(k: int) -> float:
        return -(lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1))

    top = weight(min(max(mode, low), high))
    half = 1.7155277699214135 * math.sqrt(var + 0.5) + 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + half * (v - 0.5) / u) if u > 0 else low - 1
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def split_counts(rng: np.random.Generator, totals: np.ndarray, draws: int) -> np.ndarray:
    """How many of each kind are among ``draws`` rows taken without replacement."""
    if totals.sum() < _NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(totals, draws, method="marginals")
    out = np.zeros(len(totals), np.int64)
    rest = int(totals.sum())
    for i, n in enumerate(totals.tolist()):
        rest -= n
        out[i] = hypergeometric(rng, n, rest, draws)
        draws -= int(out[i])
    return out


def matrix_row(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix."""
    before = np.concatenate(([0], np.cumsum(counts)))
    low, high, here = 0, len(counts), np.asarray(sizes, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split_counts(rng, here, int(before[mid] - before[low]))
        if part < mid:
            high, here = mid, left
        else:
            low, here = mid, here - left
    return here


def even_sizes(n: int, parts: int) -> np.ndarray:
    return n // parts + (np.arange(parts) < n % parts).astype(np.int64)


def reshard(df: DataFrame, n_shards: int, seed: int = 7, blocks_per_shard: int | None = None) -> DataFrame:
    """``df`` with shard (0 to n_shards - 1, sizes at most one apart) and slot (gapless from 0
    in the shard): a uniform random permutation of the rows.

    ``df`` must come straight from files or a written table, whose partitions hold the same rows
    whenever they are read; a task that finds another row count than the one counted fails.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    found = dict(df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    counts = np.zeros(max(found, default=0) + 1, np.int64)
    counts[list(found)] = list(found.values())
    per = blocks_per_shard or max(1, -(-shuffle_partitions(spark) // n_shards))
    shard_sizes = even_sizes(int(counts.sum()), n_shards)
    sizes = np.concatenate([even_sizes(int(n), per) for n in shard_sizes])
    starts = np.concatenate([np.cumsum(even_sizes(int(n), per)) - even_sizes(int(n), per) for n in shard_sizes])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        mine = int(counts[part]) if part < len(counts) else 0
        rng = np.random.default_rng([seed, part, 1])
        blocks = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(counts, sizes, part, seed)) if mine else np.empty(0, np.int32)
        rng.shuffle(blocks)
        done = 0
        for b in batches:
            to = done + b.num_rows
            if to > mine:
                raise RuntimeError(f"partition {part} holds more than the {mine} rows counted")
            got = blocks[done:to]
            key = mix64(np.arange(done, to, dtype=np.uint64) + np.uint64((seed * 1_000_003 + part) * 0x9E3779B97F4A7C15 % (1 << 64)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(got), pa.array(starts[got]), pa.array(key.view(np.int64))],
                names=[*b.schema.names, "__block", "__start", "__key"])
            done = to
        if done != mine:
            raise RuntimeError(f"partition {part} holds {done} rows, not the {mine} counted")

    schema = T.StructType([*df.schema.fields, T.StructField("__block", T.IntegerType()),
                           T.StructField("__start", T.LongType()), T.StructField("__key", T.LongType())])
    moved = df.mapInArrow(label, schema).repartitionById(len(sizes), F.col("__block"))
    place = F.row_number().over(Window.partitionBy("__block").orderBy("__key")) - 1
    return (moved.withColumn("slot", F.col("__start") + place)
            .withColumn("shard", F.floor(F.col("__block") / per).cast("int"))
            .drop("__block", "__start", "__key"))


def op10_reshard(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards, law ``rows``; text_crc32 of the texts that arrived there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = reshard(docs, 8)
    return out.select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
