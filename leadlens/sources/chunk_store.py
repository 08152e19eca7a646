"""Chunk store: versioned chunk tables plus one small state per version (fingerprint + version).

A build writes a new version folder, then a new numbered state; readers take the newest complete
state, so the chunks and the fingerprint are always published together, no state is ever missing
in between, and a failed build leaves the previous version in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.operators.chunks import chunk_table
from leadlens.operators.fingerprint import fingerprint
from leadlens.sources.numbered import complete, publish


def read_state(spark: SparkSession, base: str):
    """The newest complete state row, or None before the first build."""
    folder = f"{base.rstrip('/')}/_state"
    states = complete(spark, folder)
    return spark.read.parquet(f"{folder}/{states[-1]}").first() if states else None


def read_chunks(spark: SparkSession, base: str) -> DataFrame | None:
    st = read_state(spark, base)
    if st is None:
        return None
    return spark.read.parquet(f"{base.rstrip('/')}/{st['version']}")


def chunk_count(spark: SparkSession, base: str) -> int:
    ch = read_chunks(spark, base)
    return 0 if ch is None else ch.count()


def build_context(scored: DataFrame, base: str, force_rebuild: bool = False, compat: bool = False) -> bool:
    """Rebuild the chunk table unless the scored table's fingerprint is unchanged.
    Returns True when a new version was written."""
    spark = scored.sparkSession
    key = ":".join(str(v) for v in fingerprint(scored).first())
    st = read_state(spark, base)
    if not force_rebuild and st is not None and st["fingerprint"] == key:
        return False
    version = f"v-{uuid.uuid4().hex}"
    chunk_table(scored, compat).write.partitionBy("type").parquet(f"{base.rstrip('/')}/{version}")
    publish(spark.range(1).select(F.lit(key).alias("fingerprint"), F.lit(version).alias("version")), f"{base.rstrip('/')}/_state")
    return True
