"""Numbered states: small tables ``<folder>/1``, ``<folder>/2``, ... of which the newest complete one counts.

What a state names is written before it, so readers never find half of a build, and a failed one
leaves the last state in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete states, ascending: one listing. Only a folder that does not exist
    means "no state"; other errors are raised."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = fs.globStatus(sc._jvm.org.apache.hadoop.fs.Path(path, "*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName()) for s in done or [])


def publish(state: DataFrame, folder: str) -> int:
    """Write ``state`` under the next number. Of two jobs that race for one number the second fails
    and publishes nothing."""
    number = (complete(state.sparkSession, folder) or [0])[-1] + 1
    state.write.mode("errorifexists").parquet(f"{folder}/{number}")
    return number
