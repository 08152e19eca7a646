"""Model training queries (no SQL equivalent: checked rows-only and by property tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlens.operators.models import compare_models, feature_importance, model_scores
from leadlens.operators.ordering import materialize
from leadlens.operators.ranking import rank_leads
from leadlens.operators.scoring import with_rank_score
from leadlens.plans.lead_queries import LEAD_INPUTS, labeled_df
from leadlens.plans.oracle import LABELED, LEADS, with_ctes
from leadlens.plans.registry import register
from leadlens.plans.shared import shared


def training_table(spark, sf_dir):
    """Rule-labelled raw leads with a double label; imputation is part of the pipeline."""
    return labeled_df(spark, sf_dir).withColumn("label", F.col("lead_score").cast("double"))


def _holdout(spark, sf_dir):
    """(best model name, best package) by the holdout: all five learners with the surveyed settings,
    fitted once per application and state of the input files. Nothing of the cross-validation
    enters them, so it is not run for them."""
    return shared(spark, sf_dir, "model_holdout", LEAD_INPUTS, lambda: compare_models(training_table(spark, sf_dir), cv_folds=0)[1:])


def _compare(spark, sf_dir):
    """The comparison table: holdout metrics and 5-fold cross-validation. Its holdout fits serve
    the other two queries of the application."""
    def build():
        table, best, model = compare_models(training_table(spark, sf_dir), cv_folds=5)
        shared(spark, sf_dir, "model_holdout", LEAD_INPUTS, lambda: (best, model))
        return materialize(table.coalesce(1))
    return shared(spark, sf_dir, "model_comparison", LEAD_INPUTS, build)


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    return _compare(spark, sf_dir).orderBy(F.desc("f1"))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    best, model = _holdout(spark, sf_dir)
    return feature_importance(model, training_table(spark, sf_dir), top=15).withColumn("model", F.lit(best))


@register("model_score_checks", with_ctes(LEADS, LABELED, body="""
SELECT 'rows' AS what, COUNT(*) AS n FROM labeled
UNION ALL SELECT 'distinct ids', COUNT(DISTINCT lead_id) FROM labeled
UNION ALL SELECT 'probabilities off 1', 0
UNION ALL SELECT 'class not the largest', 0
UNION ALL SELECT 'label support ' || lead_score, COUNT(*) FROM labeled GROUP BY lead_score
UNION ALL SELECT 'smallest rank', 1
UNION ALL SELECT 'largest rank', COUNT(*) FROM labeled
UNION ALL SELECT 'distinct ranks', COUNT(*) FROM labeled"""))
def q_model_score_checks(spark, sf_dir):
    """The trained package on the raw leads (NULLs included), counted from the scored rows."""
    _, model = _holdout(spark, sf_dir)
    scored = with_rank_score(model_scores(model, labeled_df(spark, sf_dir)))
    ranked = materialize(rank_leads(scored.select(
        "lead_id", "lead_score", "lead_rank_score", "predicted_index", "probability_low", "probability_medium", "probability_high", "confidence")))
    p = [F.col(f"probability_{c}") for c in ("low", "medium", "high")]
    chosen = F.element_at(F.array(*p), F.col("predicted_index") + 1)
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(True)))
    sums = ranked.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("lead_id").alias("distinct ids"),
        count(F.abs(p[0] + p[1] + p[2] - 1) > 1e-9).alias("probabilities off 1"),
        count((chosen < F.greatest(*p)) | (F.col("confidence") != chosen)).alias("class not the largest"),
        F.min("rank").alias("smallest rank"), F.max("rank").alias("largest rank"), F.countDistinct("rank").alias("distinct ranks"))
    support = ranked.groupBy(F.concat(F.lit("label support "), F.col("lead_score")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return sums.unpivot([], sums.columns, "what", "n").union(support)
