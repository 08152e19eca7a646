"""Order-independent table fingerprints for change detection."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TWO53 = float(1 << 53)
_TWO60 = float(1 << 60)


def _schema_md5(df: DataFrame) -> str:
    return hashlib.md5(",".join(f"{c}:{t}" for c, t in df.dtypes).encode()).hexdigest()


def _totals(hashes: DataFrame, names: list[str], schema_md5: str) -> DataFrame:
    """XOR alone cancels duplicate rows, hence the exact decimal sums and the count; none depends
    on row order. One partially-aggregated pass."""
    wide = "decimal(38,0)"
    return hashes.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor(names[0]), F.lit(0).cast("bigint")).alias("xor_hash"),
        *[F.coalesce(F.sum(F.col(n).cast(wide)), F.lit(0).cast(wide)).cast("string").alias(f"sum_{n}") for n in names],
        F.lit(schema_md5).alias("schema_md5"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with any cell of ``df``: two 64-bit hashes of the typed values of each
    row (doubles by all their bits; columns hashed one after another, with a mask of the NULLs, so
    neither moved text nor a text like a NULL's can hide a change)."""
    mask = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "0").otherwise("1") for c in df.columns])
    cols = [F.col(c) for c in df.columns]
    rows = df.select(F.xxhash64(F.lit(1), mask, *cols).alias("hash"), F.xxhash64(F.lit(2), mask, *cols).alias("hash2"))
    return _totals(rows, ["hash", "hash2"], _schema_md5(df))


def canonical_cell(col: str, dtype: str) -> Column:
    """Engine-neutral text of a value, length first ('-' for NULL, so no text equals it). Doubles
    below 2^53 as whole part and 2^60ths, larger ones by their shortest text."""
    c = F.col(col)
    text = c.cast("string")
    if dtype in ("double", "float"):
        x = c.cast("double")
        small = F.abs(x) < F.lit(_TWO53)
        whole = F.floor(F.when(small, x).otherwise(F.lit(0.0)))
        part = F.floor((F.when(small, x).otherwise(F.lit(0.0)) - whole) * F.lit(_TWO60))
        text = F.when(small, F.concat(whole.cast("string"), F.lit("+"), part.cast("string"))).otherwise(x.cast("string"))
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def text_fingerprint(df: DataFrame) -> DataFrame:
    """The same from the MD5 of each row's canonical text (two 60-bit parts): any SQL engine can
    compute it."""
    md5 = F.md5(F.concat(*[canonical_cell(c, t) for c, t in df.dtypes]))
    part = lambda k: F.conv(F.substring(md5, k, 15), 16, 10).cast("bigint")
    return _totals(df.select(part(1).alias("hash"), part(16).alias("hash2")), ["hash", "hash2"], _schema_md5(df))
