"""Lead rollups: counts, shares, modes, means, extremes, the dashboard row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.functions.fmt import money0, one_decimal
from leadlens.operators.quantiles import quantile_row


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n) for non-null values, largest first; ties alphabetical."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value")))


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) for several string columns in one partially-aggregated pass."""
    long = df.select(*[F.col(c).cast("string") for c in cols]).unpivot(
        [], cols, "column", "value")
    return (long.where(F.col("value").isNotNull()).groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def top_k_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent non-null values with their rank (1..k)."""
    return (value_counts(df, col).limit(k)
            .withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("value")))))


def modes_row(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row ``{col: most frequent non-null value}`` (ties: smallest; NULL if none), from one
    count over all columns."""
    def rank(c: str) -> Column:   # NULL for the other columns, which min_by leaves out
        return F.when(F.col("column") == c, F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))
    return value_counts_long(df, cols).agg(*[F.min_by("value", rank(c)).alias(c) for c in cols])


def class_share(df: DataFrame, class_col: str, by: list[str] | None = None) -> DataFrame:
    """Count per class and its percentage of the group (of all rows when ``by`` is empty)."""
    by = by or []
    counts = df.groupBy(*by, class_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(F.col("n") * F.lit(100.0) / total, 6))


def lead_stats(leads: DataFrame) -> DataFrame:
    """One row: count, revenue mean/min/max/p50/p75, engagement mean, medians, modes, pop std."""
    q = quantile_row(leads, {**{f"median_{c}": (c, 0.5) for c in S.NUMERIC},
                             "p75_annual_revenue": ("annual_revenue", 0.75)})
    qs = q.select(F.struct(*q.columns)).scalar()
    base = leads.agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.avg("annual_revenue").alias("avg_revenue"),
        F.min("annual_revenue").alias("min_revenue"),
        F.max("annual_revenue").alias("max_revenue"),
        F.avg("engagement_score").alias("avg_engagement"),
        F.min("engagement_score").alias("min_engagement"),
        F.max("engagement_score").alias("max_engagement"),
        F.count_if(F.col("engagement_score") > S.HIGH_ENGAGEMENT).alias("high_engagement"),
        *[F.stddev_pop(c).alias(f"std_{c}") for c in S.NUMERIC],
    )
    modes = modes_row(leads, S.CATEGORICAL)
    ms = modes.select(F.struct(*modes.columns)).scalar()
    out = base.select(
        "*",
        *[qs[f"median_{c}"].alias(f"median_{c}") for c in S.NUMERIC],
        qs["p75_annual_revenue"].alias("p75_annual_revenue"),
        *[F.coalesce(ms[c], F.lit("Unknown")).alias(f"mode_{c}") for c in S.CATEGORICAL],
    )
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in out.columns])


def abm_dashboard(scored: DataFrame) -> DataFrame:
    """The dashboard row: top industry and region, mean revenue, class counts, engagement."""
    agg = scored.agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.avg("annual_revenue").alias("avg_revenue"),
        F.avg("engagement_score").alias("avg_engagement"),
        F.count_if(F.col("engagement_score") > S.HIGH_ENGAGEMENT).alias("high_engagement_leads"),
        *[F.count_if(F.col("predicted_lead_score") == lbl).alias(f"n_{lbl.lower()}")
          for lbl in S.CLASS_LABELS.values()],
    )
    modes = modes_row(scored, ["industry", "region"])
    ms = modes.select(F.struct(*modes.columns)).scalar()
    return agg.select(
        "total_leads",
        ms["industry"].alias("top_industry"),
        ms["region"].alias("top_region"),
        F.round("avg_revenue", 6).alias("avg_revenue"),
        F.concat(F.lit("$"), money0(F.col("avg_revenue"))).alias("avg_revenue_text"),
        F.round("avg_engagement", 6).alias("avg_engagement"),
        F.concat(one_decimal(F.col("avg_engagement")), F.lit("/100")).alias("avg_engagement_text"),
        "high_engagement_leads", "n_high", "n_medium", "n_low",
    )
