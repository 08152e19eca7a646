"""Synthetic lead generator: ``spark.range(n)`` plus column expressions.

Distributions of the surveyed generator: weighted categorical draws, lognormal revenue,
Poisson counts (inverse CDF on one uniform), Beta(2,5) engagement (2nd smallest of 6
uniforms), 2-decimal rounding; then the points rule with a uniform jitter in [-10, 9].
``rand`` is re-evaluated on recompute, so write the table before reusing it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.operators.labeling import label_leads

# Category probabilities and distribution parameters of the generator.
SIZES = [("Small", 0.5), ("Medium", 0.3), ("Large", 0.2)]
INDUSTRIES = [("Tech", 0.25), ("Finance", 0.15), ("Healthcare", 0.15), ("Manufacturing", 0.15),
              ("Retail", 0.1), ("Education", 0.1), ("Consulting", 0.05), ("Energy", 0.05)]
SOURCES = [("Organic", 0.3), ("Paid Ads", 0.25), ("Referral", 0.2), ("Social Media", 0.15), ("Email Campaign", 0.1)]
REGIONS = [("North America", 0.4), ("Europe", 0.3), ("Asia", 0.2), ("Others", 0.1)]
REVENUE_MU, REVENUE_SIGMA = 12.0, 1.5
VISITS_LAMBDA, OPENS_LAMBDA, CLICKS_LAMBDA, PURCHASES_LAMBDA = 25, 8, 5, 2


def weighted_choice(u: Column, choices: list[tuple[str, float]]) -> Column:
    out, cum = None, 0.0
    for value, p in choices[:-1]:
        cum += p
        out = (F.when(u < cum, value) if out is None else out.when(u < cum, value))
    return out.otherwise(choices[-1][0])


def poisson(u: Column, lam: float) -> Column:
    """Inverse CDF (u must be a column, not a rand() call): number of CDF points below u (support truncated where the tail < 1e-16)."""
    cdf, p, k = [], math.exp(-lam), 0
    acc = p
    while acc < 1 - 1e-16 and k < 10 * lam + 50:
        cdf.append(acc)
        k += 1
        p = p * lam / k
        acc += p
    return F.size(F.filter(F.array(*[F.lit(c) for c in cdf]), lambda c: c < u))


def generate_leads(spark: SparkSession, n: int = 2000, seed: int = 42, num_partitions: int | None = None) -> DataFrame:
    base = spark.range(0, n, 1, num_partitions) if num_partitions else spark.range(n)
    names = ["size", "ind", "src", "reg", "v", "o", "a", "p"]
    # each uniform is drawn once into a column: a rand() referenced by several CASE branches
    # or inside a lambda would be evaluated again and give different numbers
    draws = base.select(F.col("id").alias("lead_id"),
                        *[F.rand(seed + i * 17).alias(f"u_{nm}") for i, nm in enumerate(names)],
                        F.randn(seed + 500).alias("z_rev"),
                        F.array_sort(F.array(*[F.rand(seed + 900 + i) for i in range(6)]))[1].alias("beta"))
    u = {nm: F.col(f"u_{nm}") for nm in names}
    df = draws.select(
        "lead_id",
        weighted_choice(u["size"], SIZES).alias("company_size"),
        weighted_choice(u["ind"], INDUSTRIES).alias("industry"),
        F.round(F.exp(F.lit(REVENUE_MU) + F.lit(REVENUE_SIGMA) * F.col("z_rev")), 2).alias("annual_revenue"),
        poisson(u["v"], VISITS_LAMBDA).cast("bigint").alias("website_visits"),
        poisson(u["o"], OPENS_LAMBDA).cast("bigint").alias("email_opens"),
        poisson(u["a"], CLICKS_LAMBDA).cast("bigint").alias("ad_clicks"),
        F.round(F.col("beta") * 100, 2).alias("engagement_score"),
        weighted_choice(u["src"], SOURCES).alias("lead_source"),
        weighted_choice(u["reg"], REGIONS).alias("region"),
        poisson(u["p"], PURCHASES_LAMBDA).cast("bigint").alias("previous_purchases"),
        F.rand(seed + 1000).alias("u_jit"),
    )
    jitter = F.floor(F.col("u_jit") * 20).cast("int") - 10
    return label_leads(df, jitter=jitter).drop("lead_class", "u_jit")
