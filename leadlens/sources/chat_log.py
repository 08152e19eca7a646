"""A stored chat log: batches of turns, each appended once.

A batch is written to a folder of its own and then published by one commit row under its name.
Readers see committed batches only. Running a job again finds its commit and appends nothing; a
run that failed in between left files that no commit names. Two runs of a batch that race: one
commit is written, the other run fails to publish and its files stay unread.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _commits(spark: SparkSession, base: str) -> dict[str, str]:
    """Committed batches and their folders: one small row a batch."""
    try:
        rows = spark.read.option("recursiveFileLookup", True).parquet(f"{base.rstrip('/')}/_commits").collect()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return {}
    return {r.batch: r.folder for r in rows}


def append(turns: DataFrame, base: str, batch: str) -> bool:
    """Append ``turns`` as ``batch`` unless it is there already; True if it was written."""
    spark, base = turns.sparkSession, base.rstrip("/")
    if batch in _commits(spark, base):
        return False
    folder = f"turns-{uuid.uuid4().hex}"
    turns.write.parquet(f"{base}/{folder}")
    (spark.createDataFrame([(batch, folder)], "batch string, folder string").coalesce(1)
     .write.mode("errorifexists").parquet(f"{base}/_commits/{uuid.uuid5(uuid.NAMESPACE_URL, batch).hex}"))
    return True


def read(spark: SparkSession, base: str) -> DataFrame | None:
    """All committed turns with their ``batch``, or None before the first."""
    done = _commits(spark, base)
    if not done:
        return None
    names = spark.createDataFrame([(f, b) for b, f in done.items()], "__folder string, batch string")
    turns = spark.read.option("mergeSchema", True).parquet(*[f"{base.rstrip('/')}/{f}" for f in done.values()])
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return turns.withColumn("__folder", folder).join(F.broadcast(names), "__folder").drop("__folder")   # one row a batch
