"""Scoring: class probabilities, predicted label, confidence, rank score.

``frozen_scores`` is a multinomial logistic scorer with fixed coefficients: it makes the
whole score -> rank -> summary -> evaluation -> text chain checkable against a second SQL
engine without training. Trained ``pyspark.ml`` models give the same columns through
``models.model_scores``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.operators.features import imputation_row, impute_alongside
from leadlens.operators.labeling import class_label

# Fixed coefficients of the frozen scorer (ours, not learned): class c gets
# intercept[c] + (c - 1) * sum(weight[f] * x[f]) over standardised numerics and size dummies.
FROZEN_NUMERIC_WEIGHTS = {"annual_revenue": 0.9, "website_visits": 0.5, "email_opens": 0.3,
                          "ad_clicks": 0.1, "engagement_score": 0.8, "previous_purchases": 0.6}
FROZEN_SIZE_WEIGHTS = {"Large": 1.5, "Medium": 0.5, "Small": -0.5}
FROZEN_INTERCEPTS = (0.2, 0.5, -0.7)


def argmax3(p0: Column, p1: Column, p2: Column) -> Column:
    """Index of the largest probability; ties go to the lower index."""
    return F.when((p0 >= p1) & (p0 >= p2), 0).when(p1 >= p2, 1).otherwise(2)


def scorer_statistics(reference: DataFrame) -> DataFrame:
    """One row with what the frozen scorer needs of a table: (m, c) for NULLs and (mean, sd) of
    the imputed numerics."""
    fill = imputation_row(reference)
    x = impute_alongside(reference, fill.select(F.struct("m", "c")).scalar())
    moments = x.agg(F.struct(*[F.avg(f"x_{c}").alias(c) for c in S.NUMERIC]).alias("mean"),
                    F.struct(*[F.stddev_pop(f"x_{c}").alias(c) for c in S.NUMERIC]).alias("sd"))
    return fill.crossJoin(moments)   # 1 x 1 row


def frozen_scores(leads: DataFrame, stats: Column | None = None) -> DataFrame:
    """Lead columns + prediction columns, one row out per row in: imputed and scaled copies stand
    on the row itself, so repeated or NULL ids are scored like any other row and nothing is
    joined. ``stats``: the struct of ``scorer_statistics`` (default: of the batch itself)."""
    if stats is None:
        st = scorer_statistics(leads)
        stats = st.select(F.struct(*st.columns)).scalar()
    x = impute_alongside(leads.withColumn("__st", stats), F.col("__st"))
    s = F.lit(0.0)
    for c, w in FROZEN_NUMERIC_WEIGHTS.items():
        sd = F.col(f"__st.sd.{c}")
        z = (F.col(f"x_{c}") - F.col(f"__st.mean.{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        s = s + F.lit(w) * z
    size_w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FROZEN_SIZE_WEIGHTS.items() for x in kv]),
                                     F.col("x_company_size")), F.lit(0.0))
    b0, b1, b2 = FROZEN_INTERCEPTS
    lin = x.select(*leads.columns, (s + size_w).alias("__s"))
    logits = lin.select(*leads.columns, (F.lit(b0) - F.col("__s")).alias("__l0"), F.lit(b1).alias("__l1"),
                        (F.lit(b2) + F.col("__s")).alias("__l2"))
    m = F.greatest("__l0", "__l1", "__l2")   # shifted for stability
    ex = logits.select(*leads.columns, *[F.exp(F.col(f"__l{i}") - m).alias(f"__e{i}") for i in range(3)])
    tot = F.col("__e0") + F.col("__e1") + F.col("__e2")
    return with_predictions(ex, leads.columns, [F.col(f"__e{i}") / tot for i in range(3)])


def with_predictions(df: DataFrame, keep: list[str], probs: list[Column]) -> DataFrame:
    """``keep`` columns + probability_low/medium/high, predicted_index, predicted_lead_score and
    confidence: the columns of every scorer."""
    out = df.select(*keep, *[p.alias(f"probability_{n}") for p, n in zip(probs, ("low", "medium", "high"), strict=True)])
    idx = argmax3(F.col("probability_low"), F.col("probability_medium"), F.col("probability_high"))
    return (out.withColumn("predicted_index", idx.cast("int"))
            .withColumn("predicted_lead_score", class_label(F.col("predicted_index")))
            .withColumn("confidence", F.greatest("probability_low", "probability_medium", "probability_high")))


def with_rank_score(scored: DataFrame) -> DataFrame:
    """Class weight + 100 P(High) + 50 confidence for High/Medium + 30 min-max revenue
    + 20 min-max engagement (each min-max term only when max > min; raw values, so a
    NULL revenue or engagement gives a NULL score that sorts last)."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in S.RANK_CLASS_WEIGHT.items() for x in kv]),
                                F.col("predicted_lead_score")), F.lit(0)).cast("double")
    score = (w + F.lit(float(S.RANK_P_HIGH)) * F.col("probability_high")
             + F.lit(float(S.RANK_CONFIDENCE)) * F.col("confidence")
             * F.col("predicted_lead_score").isin("High", "Medium").cast("int"))
    st = scored.agg(F.min("annual_revenue").alias("rlo"), F.max("annual_revenue").alias("rhi"),
                    F.min("engagement_score").alias("elo"), F.max("engagement_score").alias("ehi"))
    out = scored.withColumn("__mm", st.select(F.struct(*st.columns)).scalar())   # one pass, once
    for col, lo, hi, weight in (("annual_revenue", "rlo", "rhi", S.RANK_REVENUE),
                                ("engagement_score", "elo", "ehi", S.RANK_ENGAGEMENT)):
        lo, hi = F.col(f"__mm.{lo}"), F.col(f"__mm.{hi}")
        term = F.lit(float(weight)) * (F.col(col) - lo) / (hi - lo)
        score = F.when(F.coalesce(hi > lo, F.lit(False)), score + term).otherwise(score)
    return out.withColumn("lead_rank_score", score).drop("__mm")


def priority_band(label: Column) -> Column:
    """High -> green, Medium -> amber, Low -> no band."""
    return F.when(label == "High", "green").when(label == "Medium", "amber")
