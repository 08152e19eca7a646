"""Feature preparation: imputation, one-hot, population standardisation, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.operators.quantiles import quantile_row
from leadlens.operators.rollups import modes_row


def missing_columns(df: DataFrame, required: list[str] = S.REQUIRED) -> list[str]:
    """Required columns absent from ``df``, in declared order (categorical, then numeric)."""
    present = {c.lower() for c in df.columns}
    return [c for c in required if c.lower() not in present]


def require_columns(df: DataFrame, required: list[str] = S.REQUIRED) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


def imputation_row(df: DataFrame) -> DataFrame:
    """One row (m: medians of the numerics, c: modes of the categoricals) of a table: the values
    for NULLs. Two passes: one numbering for all medians, one count for all modes."""
    med = quantile_row(df, {c: (c, 0.5) for c in S.NUMERIC})
    modes = modes_row(df, S.CATEGORICAL)
    return med.crossJoin(modes).select(F.struct(*med.columns).alias("m"), F.struct(*modes.columns).alias("c"))   # 1 x 1 row


def impute_alongside(df: DataFrame, stats: Column) -> DataFrame:
    """Adds ``x_<col>`` next to every raw column: numeric NULL -> median (double, like a float
    frame), categorical NULL -> mode, or 'Unknown' without one. ``stats``: struct (m, c)."""
    out = df.withColumn("__imp", stats)
    return out.select(
        "*",
        *[F.coalesce(F.col(c), F.col(f"__imp.c.{c}"), F.lit("Unknown")).alias(f"x_{c}") for c in S.CATEGORICAL],
        *[F.coalesce(F.col(c).cast("double"), F.col(f"__imp.m.{c}")).alias(f"x_{c}") for c in S.NUMERIC]).drop("__imp")


def impute(df: DataFrame) -> DataFrame:
    """Batch imputation with the batch's own medians and modes, evaluated once as a scalar
    subquery attached to the rows as one struct column."""
    stats = imputation_row(df)
    out = impute_alongside(df, stats.select(F.struct("m", "c")).scalar())
    return out.select(*[F.col(f"x_{c}").alias(c) if c in S.REQUIRED else F.col(c) for c in df.columns])


def standardized(df: DataFrame, cols: list[str] = S.NUMERIC, prefix: str = "z_") -> DataFrame:
    """Add ``z_<col>`` = (x - mean) / population std; a constant column divides by 1."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    out = df.withColumn("__zst", st.select(F.struct(*st.columns)).scalar())
    zs = []
    for c in cols:
        sd = F.col(f"__zst.s_{c}")
        zs.append(((F.col(c) - F.col(f"__zst.m_{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).alias(f"{prefix}{c}"))
    return out.select("*", *zs).drop("__zst")


def feature_long(imputed: DataFrame) -> DataFrame:
    """Sparse feature rows (lead_id, feature, value): 6 standardised numerics and the
    one-hot entries that are 1 (``<column>_<value>``). Zeros are implicit, as in a sparse
    vector; the vocabulary is whatever the batch holds."""
    z = standardized(imputed)
    numeric = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"z_{c}").cast("double").alias("value"))
                        for c in S.NUMERIC])
    onehot = F.array(*[F.struct(F.concat(F.lit(f"{c}_"), F.col(c)).alias("feature"),
                                F.lit(1.0).alias("value")) for c in S.CATEGORICAL])
    return (z.select("lead_id", F.explode(F.concat(numeric, onehot)).alias("f"))
            .select("lead_id", "f.feature", "f.value"))


def aligned_features(imputed: DataFrame, names: list[str]) -> DataFrame:
    """(lead_id, values): each row's features in the order of a model's own list ``names``. A
    feature the batch lacks is 0, one the model lacks is dropped."""
    z = standardized(imputed)
    have = F.map_from_arrays(
        F.array(*[F.lit(c) for c in S.NUMERIC], *[F.concat(F.lit(f"{c}_"), F.col(c)) for c in S.CATEGORICAL]),
        F.array(*[F.col(f"z_{c}").cast("double") for c in S.NUMERIC], *[F.lit(1.0) for _ in S.CATEGORICAL]))
    wanted = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return (z.withColumn("__have", have)
            .select("lead_id", F.transform(wanted, lambda n: F.coalesce(F.element_at(F.col("__have"), n), F.lit(0.0))).alias("values")))
