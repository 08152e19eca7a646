"""Points rule (tiers -> score -> class) on a lead table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.operators.quantiles import exact_quantiles


def class_label(idx: Column) -> Column:
    """Class index -> 'Low' / 'Medium' / 'High'."""
    out = F.lit(None).cast("string")
    for k, label in S.CLASS_LABELS.items():
        out = F.when(idx == k, F.lit(label)).otherwise(out)
    return out


def hash_jitter(lead_id: Column) -> Column:
    """Deterministic integer in [-10, 9] per lead (reproducible in any SQL engine)."""
    return (lead_id * S.JITTER_MUL + S.JITTER_ADD) % S.JITTER_MOD - S.JITTER_SHIFT


def random_jitter(seed: int) -> Column:
    """Uniform integer in [-10, 9]; non-deterministic on recompute: write before reuse."""
    return F.floor(F.rand(seed) * S.JITTER_MOD).cast("int") - S.JITTER_SHIFT


def revenue_cuts(leads: DataFrame) -> Column:
    """Struct column (p50, p75) of annual revenue, evaluated once as a scalar subquery."""
    q = exact_quantiles(leads, "annual_revenue", {"p50": 0.5, "p75": 0.75})
    return q.select(F.struct("p50", "p75")).scalar()


def rule_points(leads: DataFrame, jitter: Column | None = None, cuts: Column | None = None) -> Column:
    """Points of the rule; comparisons are strict, nulls score nothing."""
    cuts = cuts if cuts is not None else revenue_cuts(leads)
    jitter = jitter if jitter is not None else hash_jitter(F.col("lead_id"))
    size = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in S.SIZE_POINTS.items() for x in kv]),
                                   F.col("company_size")), F.lit(0))
    rev = (F.when(F.col("annual_revenue") > cuts["p75"], S.REVENUE_POINTS[0])
           .when(F.col("annual_revenue") > cuts["p50"], S.REVENUE_POINTS[1]).otherwise(0))
    (e_hi, p_hi), (e_mid, p_mid) = S.ENGAGEMENT_POINTS
    eng = (F.when(F.col("engagement_score") > e_hi, p_hi)
           .when(F.col("engagement_score") > e_mid, p_mid).otherwise(0))
    visits = F.when(F.col("website_visits") > S.VISITS_POINTS[0], S.VISITS_POINTS[1]).otherwise(0)
    opens = F.when(F.col("email_opens") > S.OPENS_POINTS[0], S.OPENS_POINTS[1]).otherwise(0)
    purch = F.when(F.col("previous_purchases") > S.PURCHASES_POINTS[0], S.PURCHASES_POINTS[1]).otherwise(0)
    return size + rev + eng + visits + opens + purch + jitter


def points_to_class(points: Column) -> Column:
    (hi_cut, hi_cls), (mid_cut, mid_cls) = S.CLASS_CUTS
    return F.when(points >= hi_cut, hi_cls).when(points >= mid_cut, mid_cls).otherwise(0)


def label_leads(leads: DataFrame, jitter: Column | None = None) -> DataFrame:
    """Add ``points``, ``lead_score`` (0/1/2) and ``lead_class`` ('Low'/'Medium'/'High')."""
    # the (p50, p75) subquery is attached once as a column, so it is planned and run once
    with_cuts = leads.withColumn("__cuts", revenue_cuts(leads))
    pts = rule_points(with_cuts, jitter=jitter, cuts=F.col("__cuts"))
    return (with_cuts.withColumn("points", pts.cast("int")).drop("__cuts")
            .withColumn("lead_score", points_to_class(F.col("points")).cast("int"))
            .withColumn("lead_class", class_label(F.col("lead_score"))))
