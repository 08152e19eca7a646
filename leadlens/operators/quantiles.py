"""Exact quantiles with linear interpolation, by one distributed method at every size.

The values of all columns are reduced to distinct (column, value) counts, numbered once in
(column, value) order by distributed prefix sums, and the two values around each wanted position
are picked. Interpolation is ``lo + (hi - lo) * d`` (from ``hi`` downwards for d >= 0.5), so a
position between equal values is that value to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.operators.ordering import with_prefix_sums


def quantile_row(df: DataFrame, spec: dict[str, tuple[str, float]]) -> DataFrame:
    """One-row DataFrame ``{name: quantile p of column}``; nulls and NaN ignored; NULL when empty."""
    cols = sorted({c for c, _ in spec.values()})
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
    counts = long.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = with_prefix_sums(counts, [F.col("column").asc(), F.col("v").asc()], {"before": "n"})
    totals = placed.groupBy("column").agg(F.min("before").alias("start"), F.sum("n").alias("total"))   # a row per column
    wanted = df.sparkSession.createDataFrame([(k, c, float(p)) for k, (c, p) in spec.items()], "name string, column string, p double")
    position = F.col("p") * (F.col("total") - 1)
    targets = wanted.join(totals, "column").select(
        "name", "column", F.floor(position).alias("lo"), F.ceil(position).alias("hi"),
        (position - F.floor(position)).alias("d"), "start")
    first = F.col("before") - F.col("start")

    def at(k: str):
        return F.max(F.when((first <= F.col(k)) & (F.col(k) < first + F.col("n")), F.col("v")))

    # a row per wanted quantile on the small side
    picked = placed.join(F.broadcast(targets), "column").groupBy("name", "d").agg(at("lo").alias("a"), at("hi").alias("b"))
    span = F.col("b") - F.col("a")
    value = F.when(F.col("d") < 0.5, F.col("a") + span * F.col("d")).otherwise(F.col("b") - span * (F.lit(1.0) - F.col("d")))
    values = picked.select("name", value.alias("q"))
    return values.agg(*[F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in spec])


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float]) -> DataFrame:
    return quantile_row(df, {k: (col, p) for k, p in probs.items()})
