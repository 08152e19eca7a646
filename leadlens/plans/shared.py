"""Derived tables written once per application and input folder.

Several registered queries read the same derived tables (lead table, scored table, chunk
table, chunk index). Each is written once, as a reliable checkpoint in the cluster's shared
checkpoint folder, and reused while its input files are unchanged. The key holds the
application id, the folder, the table name and a signature of the input tables (path, total
length, file count and modification time of each), so replaced input data is not answered from an
old table. The written tables go when the application ends (``session.ensure_checkpoint_dir``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadlens.operators.ordering import materialize

_SHARED: dict[tuple[str, str, str, str], object] = {}


def input_signature(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """MD5 over the path, total length, number of files and modification time of every named
    table: two metadata calls per table, however many files it has; no data is read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            parts.append(f"{t}:missing")
            continue
        total = fs.getContentSummary(path)
        parts.append(f"{path}:{total.getLength()}:{total.getFileCount()}:{fs.getFileStatus(path).getModificationTime()}")
    return hashlib.md5("\n".join(parts).encode()).hexdigest()


def shared(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build: Callable[[], object]):
    """``build()`` once per (application, folder, name, input signature); ``build`` writes
    what it returns (tables through ``materialize``), so reuse never recomputes lineage."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name, input_signature(spark, sf_dir, tables))
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def written(spark: SparkSession, sf_dir: str, name: str, tables: list[str],
            build: Callable[[], DataFrame]) -> DataFrame:
    """The derived table ``name``, written on first use and read back afterwards."""
    return shared(spark, sf_dir, name, tables, lambda: materialize(build()))
