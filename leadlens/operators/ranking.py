"""Ranking: full 1..N ranking and top-N reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.functions.fmt import no_decimal, percent1
from leadlens.operators.ordering import with_global_row_number
from leadlens.operators.scoring import priority_band

def rank_order():
    """Rank score descending (NULL last), lead_id ascending: a total order."""
    return [F.col("lead_rank_score").desc_nulls_last(), F.col("lead_id").asc()]

TOP_COLUMNS = ["rank", "company_size", "industry", "lead_source", "region", "annual_revenue",
               "engagement_score", "predicted_lead_score", "probability_high", "confidence"]


def rank_leads(scored: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Dense positions 1..N by rank score (NULL last), lead_id breaking ties; distributed."""
    return with_global_row_number(scored, rank_order(), "rank", num_partitions)


def top_leads(scored: DataFrame, n: int = S.DEFAULT_TOP_N) -> DataFrame:
    """Top-N report: existing display columns, formatted values and the priority band.
    ``limit`` after ``orderBy`` plans as TakeOrderedAndProject (per-partition top-N, then
    merge), so no full sort and no global rank are needed."""
    if n < 1:
        raise ValueError("n must be positive")
    top = scored.orderBy(*rank_order()).limit(n)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))   # n rows
    cols = [c for c in TOP_COLUMNS if c in top.columns]
    out = top.select("lead_id", *cols, F.col("lead_rank_score"))
    fmt = {"annual_revenue": no_decimal, "engagement_score": no_decimal,
           "probability_high": percent1, "confidence": percent1}
    for c, f in fmt.items():
        if c in out.columns:
            out = out.withColumn(f"{c}_text", f(F.col(c)))
    return out.withColumn("band", priority_band(F.col("predicted_lead_score")))
