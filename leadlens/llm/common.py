"""Helpers shared by the operators: scratch tables, worker caches, vectorised hashing."""

from __future__ import annotations

import atexit
import contextlib
import sys
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import shared_dir

#: Rows and bytes of an Arrow batch sent to a Python worker: they bound its memory when texts are
#: long (a single longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that Spark's readers open."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings of these operators: small Arrow batches; shuffle files go with their query.
    They hold when the lazy results run, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def text_of(col: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


class Scratch:
    """Tables written under the cluster's shared folder (``spark.checkpoint.dir``).

    ``keep`` writes a DataFrame as Parquet and reads it back, which cuts the lineage and
    survives lost executors. ``drop`` removes a table no later step reads; the rest goes when
    the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = shared_dir(spark, f"llm-{name}-{uuid.uuid4().hex[:12]}")
        atexit.register(self._clean)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone when the interpreter ends
            self.drop()


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker. Kernels travel by value, so their module
    globals are new in every task; interpreter state is not."""
    return sys.__dict__.setdefault("_leadlens_worker_cache", {})


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- vectorised 64-bit hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element (uint64, wraps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at a time; tables of powers are as long, whatever the texts.
SLICE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _power_table(base: int) -> np.ndarray:
    """Powers 0 to SLICE of ``base``, modulo 2^64."""
    cache = worker_cache()
    have = cache.get(("pow", base))
    if have is None:
        have = np.empty(2 * SLICE, np.uint64)
        have[0] = 1
        filled = 1
        while filled < len(have):
            have[filled:2 * filled] = have[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        have = cache[("pow", base)] = have[:SLICE + 1].copy()
    return have


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]] for each i (in ascending order, apart): polynomial
    prefix sums over mixed bytes, moved to a common origin, then finalised with the length. Words
    are taken in slices of SLICE bytes; a longer word is summed up over several."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    mixed = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    powers, inverse = _power_table(_BASE), _power_table(_BASE_INVERSE)
    prefix = np.zeros(SLICE + 1, np.uint64)
    i = 0
    while i < len(starts):
        begin = int(starts[i])
        j = int(np.searchsorted(ends, begin + SLICE, side="right"))
        if j > i:
            size = int(ends[j - 1]) - begin
            np.cumsum(mixed[data[begin:begin + size]] * powers[:size], out=prefix[1:size + 1])
            a = starts[i:j] - begin
            out[i:j] = (prefix[ends[i:j] - begin] - prefix[a]) * inverse[a]
        else:
            j, total = i + 1, 0
            for at in range(begin, int(ends[i]), SLICE):
                part = mixed[data[at:min(at + SLICE, int(ends[i]))]]
                total += int((part * powers[:len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - begin, 1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


#: Bytes that separate words: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes that belong to words where punctuation does not: letters, digits, all of UTF-8's others.
ALNUM = np.arange(256) >= 128
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def words_of(texts: list[bytes], in_word: np.ndarray = ~SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, words before each text) of texts whose words are runs of
    ``in_word`` bytes (default: all but space and 0x09-0x0D), with A-Z lowered. Texts are joined
    by a separating space."""
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    solid = in_word[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(starts, begins)
