"""Lead files: read (CSV or parquet, explicit schema), preview, validate, export."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens import schema as S
from leadlens.operators.features import missing_columns


def snake(name: str) -> str:
    """'Company_Size' / 'Company Size' -> 'company_size'."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN -> NULL at ingestion (Spark orders NaN above every number)."""
    return df.select(*[F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def csv_schema(header: list[str]) -> T.StructType:
    """Schema of a CSV file with this header: known lead columns by name (in any order and
    spelling) with their declared types, other columns as strings."""
    typed = {f.name: f.dataType for f in S.LEAD_SCHEMA.fields}
    return T.StructType([T.StructField(c, typed.get(snake(c), T.StringType())) for c in header])


def read_leads(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read lead files. Header names are normalised to snake case; the known lead columns get
    their declared types by name (no inference pass over the data); other columns stay strings.
    Files of one path share a header: one with another header fails instead of being misread
    (read it on its own; any column order will do). Missing required columns raise. Rows without
    a ``lead_id`` get the hash of their content, which does not depend on how files are split;
    equal rows share it."""
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        header = spark.read.option("header", True).csv(path).columns   # reads the header only
        raw = (spark.read.schema(csv_schema(header)).option("header", True).option("enforceSchema", False)
               .option("mode", "PERMISSIVE").csv(path))
    df = raw.select(*[F.col(f"`{c}`").alias(snake(c)) for c in raw.columns])
    validate(df)
    df = nan_to_null(df)
    if "lead_id" not in df.columns:
        df = df.withColumn("lead_id", F.xxhash64(*df.columns))
    return df


def validate(df: DataFrame) -> None:
    missing = missing_columns(df)
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


def preview(df: DataFrame, n: int = 10) -> tuple[DataFrame, int, int]:
    """(first n rows, row count, column count)."""
    return df.limit(n), df.count(), len(df.columns)


def export_scored(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "predicted_lead_score"):
    """Write scored leads (with rank score, without the display rank). CSV gets a header and every
    column; only parquet is partitioned, as a partition column is left out of the files."""
    out = df.drop("rank") if "rank" in df.columns else df
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif partition_by and partition_by in out.columns:
        w.partitionBy(partition_by).parquet(path)
    else:
        w.parquet(path)
