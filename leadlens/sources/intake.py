"""Folders of uploaded CSV files: files of any header side by side, bad records set apart.

Files are grouped by their header line; each group is read by its own schema and the groups are
united by column name, so another column order, other spellings and extra columns in one folder
all work. Every cell is read as text and cast by its declared type; a record with a number that
does not parse, or with more or fewer cells than its header, goes to the reject table with its
file and reasons. Nothing turns into NULL unseen.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens import schema as S
from leadlens.sources.leads_csv import nan_to_null, snake, validate

_BAD = "__bad_record"


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """All data files below ``path`` (hidden and underscore names are Spark's own)."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    found, files = fs.listFiles(root, True), []
    while found.hasNext():
        p = found.next().getPath()
        if not any(part[:1] in "._" for part in p.toString()[len(root.toString()):].split("/") if part):
            files.append(p.toString())
    return sorted(files)


def header_of(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names of a file's first line; empty for an empty file. Reads that line only."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(file)
    conf = sc._jsc.hadoopConfiguration()
    stream = p.getFileSystem(conf).open(p)
    try:
        codec = sc._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        plain = codec.createInputStream(stream) if codec is not None else stream
        line = sc._jvm.java.io.BufferedReader(sc._jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([line]))) if line else ()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _typed(raw: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """Cells of one group by name and type, with the reasons against each record."""
    types = {f.name: f.dataType for f in S.LEAD_SCHEMA.fields}
    cells, reasons = [], [F.when(F.col(_BAD).isNotNull(), F.lit("wrong number of cells"))]
    for c in header:
        name, text = snake(c), F.col(_quoted(c))
        kind = types.get(name, T.StringType())
        cell = text if isinstance(kind, T.StringType) else F.expr(f"try_cast({_quoted(c)} AS {kind.simpleString()})")
        cells.append(cell.alias(name))
        if not isinstance(kind, T.StringType):
            reasons.append(F.when(text.isNotNull() & cell.isNull(), F.concat(F.lit(f"{name}: "), text)))
    id_text = next((F.col(_quoted(c)) for c in header if snake(c) == "lead_id"), F.lit(None).cast("string"))
    return raw.select(*cells, id_text.alias("__id"), F.array_compact(F.array(*reasons)).alias("reasons"), F.col("_metadata.file_path").alias("file"),
                      F.coalesce(_BAD, F.to_csv(F.struct(*[F.col(_quoted(c)) for c in header]))).alias("record"))


def read_folder(spark: SparkSession, path: str, threads: int = 16) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): typed lead rows, and (file, lead_id as text, record, reasons) of the records
    set apart.

    A column that a file lacks is NULL in its rows; required columns that no file has raise. Rows
    without ``lead_id`` get the hash of their content, as in ``read_leads``."""
    files = csv_files(spark, path)
    with ThreadPoolExecutor(max_workers=threads) as pool:
        headers = list(pool.map(inheritable_thread_target(spark)(lambda f: header_of(spark, f)), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers, strict=True):
        if header:
            groups.setdefault(header, []).append(file)
    if not groups:
        raise ValueError(f"no files with a header in {path}")
    parts = []
    for header, own in groups.items():
        if len({snake(c) for c in header}) < len(header):
            raise ValueError(f"columns of one name in {own[0]}")
        schema = T.StructType([*(T.StructField(c, T.StringType()) for c in header), T.StructField(_BAD, T.StringType())])
        raw = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", _BAD).csv(own))
        parts.append(_typed(raw, header))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lead_columns = [c for c in rows.columns if c not in ("__id", "reasons", "file", "record")]
    good = rows.where(F.size("reasons") == 0).select(*lead_columns)
    validate(good)
    good = nan_to_null(good)
    content = F.xxhash64(*good.columns)
    good = good.withColumn("lead_id", F.coalesce("lead_id", content) if "lead_id" in good.columns else content)
    return good, rows.where(F.size("reasons") > 0).select("file", F.col("__id").alias("lead_id"), "record", "reasons")
