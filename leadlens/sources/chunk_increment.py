"""A chunk store that takes changed leads without writing everything again.

Leads are dealt over ``buckets`` by their id. The manifest has one row per bucket: the fingerprint
of its leads and the folder that holds its chunks. A build takes the fingerprints of all buckets in
one pass, writes the chunks of changed buckets to a new folder, and publishes a new manifest that
names old folders for the rest. Summary sentences depend on all leads: they are a bucket of their
own, written whenever any other changed. Readers take the newest complete manifest, so they never
see a mix of two builds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.operators.chunks import lead_chunks, summary_chunks
from leadlens.operators.ordering import materialize
from leadlens.sources.numbered import complete, publish

SUMMARY = -1


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.col(key), F.lit(buckets)).cast("int")


def bucket_fingerprints(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, fingerprint): changes with any cell of the bucket's rows and does not depend on
    their order; one partially aggregated pass, one row per bucket."""
    mask = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "0").otherwise("1") for c in df.columns])
    cols = [F.col(c) for c in df.columns]
    hashed = df.select(bucket_of(key, buckets).alias("bucket"), F.xxhash64(F.lit(1), mask, *cols).alias("h1"),
                       F.xxhash64(F.lit(2), mask, *cols).alias("h2"))
    wide = "decimal(38,0)"
    parts = [F.count(F.lit(1)), F.bit_xor("h1"), F.sum(F.col("h1").cast(wide)), F.sum(F.col("h2").cast(wide))]
    return hashed.groupBy("bucket").agg(F.concat_ws(":", *[p.cast("string") for p in parts]).alias("fingerprint"))


def manifest(spark: SparkSession, base: str) -> DataFrame | None:
    """(bucket, fingerprint, folder) of the newest complete build."""
    numbers = complete(spark, f"{base.rstrip('/')}/_manifest")
    return spark.read.parquet(f"{base.rstrip('/')}/_manifest/{numbers[-1]}") if numbers else None


def read(spark: SparkSession, base: str) -> DataFrame | None:
    """The chunks of the newest complete build."""
    now = manifest(spark, base)
    if now is None:
        return None
    paths = [f"{base.rstrip('/')}/{r.folder}/bucket={r.bucket}" for r in now.select("folder", "bucket").collect()]  # one a bucket
    return spark.read.parquet(*paths) if paths else None


def build(scored: DataFrame, base: str, buckets: int = 64, key: str = "lead_id") -> dict[str, int]:
    """Bring the store up to ``scored``; counts of lead buckets kept, rewritten, added and removed."""
    spark, base = scored.sparkSession, base.rstrip("/")
    old = manifest(spark, base)
    before = {} if old is None else {r.bucket: (r.fingerprint, r.folder) for r in old.collect()}        # one row a bucket
    after = {r.bucket: r.fingerprint for r in materialize(bucket_fingerprints(scored, key, buckets)).collect()}
    changed = [b for b, f in after.items() if before.get(b, (None,))[0] != f]
    gone = [b for b in before if b != SUMMARY and b not in after]
    counts = {"kept": len(after) - len(changed), "rewritten": sum(b in before for b in changed),
              "added": sum(b not in before for b in changed), "removed": len(gone)}
    if old is not None and not changed and not gone:
        return counts
    folder = f"v-{uuid.uuid4().hex}"
    fresh = lead_chunks(scored.where(bucket_of(key, buckets).isin(changed)))
    fresh = fresh.withColumn("bucket", F.pmod(F.col("index").cast("long"), F.lit(buckets)).cast("int"))
    rows = fresh.unionByName(summary_chunks(scored).withColumn("bucket", F.lit(SUMMARY)))
    # rows of one bucket over eight files at most, whatever the number of tasks
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(8))
    rows.repartition("bucket", spread).write.partitionBy("bucket").parquet(f"{base}/{folder}")
    now = [(b, f, folder if b in set(changed) else before[b][1]) for b, f in after.items()] + [(SUMMARY, "", folder)]
    publish(spark.createDataFrame(now, "bucket int, fingerprint string, folder string").coalesce(1), f"{base}/_manifest")
    return counts
