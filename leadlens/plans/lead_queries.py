"""Lead table, labels, rollups, features, scoring, ranking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.functions.fmt import one_decimal
from leadlens.operators import evaluate as E
from leadlens.operators.features import aligned_features, feature_long, impute
from leadlens.operators.labeling import label_leads
from leadlens.operators.ranking import rank_leads, top_leads
from leadlens.operators.split import stratified_folds, stratified_split
from leadlens.operators.rollups import abm_dashboard, class_share, lead_stats, top_k_values, value_counts_long
from leadlens.operators.scoring import frozen_scores, with_rank_score
from leadlens.plans.oracle import IMPUTED, LABELED, LEADS, SCORED, with_ctes
from leadlens.plans.registry import register
from leadlens.plans.shared import written
from leadlens.session import shared_dir
from leadlens.sources.leads_csv import export_scored, read_leads
from leadlens.sources.tables import lead_table


def _r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LEAD_INPUTS = ["customer", "nation", "region", "orders", "lineitem"]


def leads_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead table, written once (reliable checkpoint) because every batch statistic
    (quantiles, modes, moments, extremes) reads it again, and shared by the queries of
    one application while the input files are unchanged."""
    return written(spark, sf_dir, "leads", LEAD_INPUTS, lambda: lead_table(spark, sf_dir))


def labeled_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-labelled leads, written once: the revenue quantiles behind the labels are
    computed once for every report, split and evaluation that reads the labels."""
    return written(spark, sf_dir, "labeled", LEAD_INPUTS, lambda: label_leads(leads_df(spark, sf_dir)))


def scored_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored leads with rank score, written once for the reports that read it repeatedly."""
    return written(spark, sf_dir, "scored", LEAD_INPUTS,
                   lambda: with_rank_score(frozen_scores(leads_df(spark, sf_dir))))


def scored_leads_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_df(spark, sf_dir)


@register("leads", with_ctes(LEADS, body="SELECT * FROM leads"))
def q_leads(spark, sf_dir):
    # the written lead table: the reports that follow read the same write
    return leads_df(spark, sf_dir)


@register("rule_labels", with_ctes(LEADS, LABELED, body="SELECT lead_id, points, lead_score, lead_class FROM labeled"))
def q_rule_labels(spark, sf_dir):
    return labeled_df(spark, sf_dir).select("lead_id", "points", "lead_score", "lead_class")


@register("class_share_by_region", with_ctes(LEADS, LABELED, body="""
SELECT region, lead_class, COUNT(*) AS n,
       round(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY region), 6) AS pct
FROM labeled GROUP BY region, lead_class"""))
def q_class_share_by_region(spark, sf_dir):
    return class_share(labeled_df(spark, sf_dir), "lead_class", ["region"])


@register("class_distribution", with_ctes(LEADS, LABELED, body="""
SELECT lead_class, COUNT(*) AS n, round(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS pct
FROM labeled GROUP BY lead_class"""))
def q_class_distribution(spark, sf_dir):
    return class_share(labeled_df(spark, sf_dir), "lead_class")


@register("value_counts", with_ctes(LEADS, body="""
SELECT "column", value, COUNT(*) AS n FROM (
  UNPIVOT (SELECT company_size, industry, lead_source, region FROM leads)
  ON company_size, industry, lead_source, region INTO NAME "column" VALUE value)
WHERE value IS NOT NULL GROUP BY "column", value"""))
def q_value_counts(spark, sf_dir):
    return value_counts_long(leads_df(spark, sf_dir), S.CATEGORICAL)


@register("industry_top10", with_ctes(LEADS, body="""
SELECT industry AS value, COUNT(*) AS n,
       CAST(row_number() OVER (ORDER BY COUNT(*) DESC, industry) AS INTEGER) AS pos
FROM leads WHERE industry IS NOT NULL GROUP BY industry ORDER BY n DESC, value LIMIT 10"""))
def q_industry_top10(spark, sf_dir):
    return top_k_values(leads_df(spark, sf_dir), "industry", S.CHART_TOP_INDUSTRIES)


_STATS_SQL = with_ctes(LEADS, body="""
SELECT COUNT(*) AS total_leads,
  round(avg(annual_revenue), 6) AS avg_revenue, round(min(annual_revenue), 6) AS min_revenue,
  round(max(annual_revenue), 6) AS max_revenue, round(avg(engagement_score), 6) AS avg_engagement,
  round(min(engagement_score), 6) AS min_engagement, round(max(engagement_score), 6) AS max_engagement,
  COUNT(*) FILTER (WHERE engagement_score > 70) AS high_engagement,
  {stds},
  {meds},
  round(percentile_cont(0.75) WITHIN GROUP (ORDER BY annual_revenue), 6) AS p75_annual_revenue,
  {modes}
FROM leads""".format(
    stds=", ".join(f"round(stddev_pop({c}), 6) AS std_{c}" for c in S.NUMERIC),
    meds=", ".join(f"round(median({c}), 6) AS median_{c}" for c in S.NUMERIC),
    modes=", ".join(f"COALESCE((SELECT {c} FROM leads WHERE {c} IS NOT NULL GROUP BY {c} "
                    f"ORDER BY COUNT(*) DESC, {c} LIMIT 1), 'Unknown') AS mode_{c}" for c in S.CATEGORICAL)))


@register("lead_stats", _STATS_SQL)
def q_lead_stats(spark, sf_dir):
    return lead_stats(leads_df(spark, sf_dir))


@register("imputed_leads", with_ctes(LEADS, IMPUTED, body="SELECT * FROM imputed"))
def q_imputed_leads(spark, sf_dir):
    return _r6(impute(leads_df(spark, sf_dir)))


_FEATURE_SQL = with_ctes(LEADS, IMPUTED, """
zst AS (SELECT {st} FROM imputed)""".format(
    st=", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in S.NUMERIC)), body="""
SELECT lead_id, feature, round(value, 6) AS value FROM (
{nums}
UNION ALL
{cats})""".format(
    nums="\nUNION ALL\n".join(
        f"SELECT lead_id, '{c}' AS feature, ({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS value "
        f"FROM imputed, zst" for c in S.NUMERIC),
    cats="\nUNION ALL\n".join(
        f"SELECT lead_id, '{c}_' || {c} AS feature, 1.0::DOUBLE AS value FROM imputed" for c in S.CATEGORICAL)))


@register("feature_matrix", _FEATURE_SQL)
def q_feature_matrix(spark, sf_dir):
    return _r6(feature_long(impute(leads_df(spark, sf_dir))))


#: A model's own feature list: an order of its own, a feature no batch has, industries left out.
MODEL_FEATURES = ["region_ASIA", "engagement_score", "annual_revenue", "company_size_Large", "company_size_Giant",
                  "lead_source_Referral", "region_EUROPE", "previous_purchases", "company_size_Small"]


def _aligned(name: str) -> str:
    if name in S.NUMERIC:
        return f"({name} - m_{name}) / CASE WHEN s_{name} = 0 THEN 1 ELSE s_{name} END"
    col = next(c for c in S.CATEGORICAL if name.startswith(f"{c}_"))
    return f"CASE WHEN {col} = '{name[len(col) + 1:]}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@register("aligned_features", with_ctes(LEADS, IMPUTED, """
zst AS (SELECT {st} FROM imputed)""".format(
    st=", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in S.NUMERIC)), body="\nUNION ALL\n".join(
    f"SELECT lead_id, {i} AS pos, '{n}' AS feature, round({_aligned(n)}, 6) AS value FROM imputed, zst"
    for i, n in enumerate(MODEL_FEATURES))))
def q_aligned_features(spark, sf_dir):
    out = aligned_features(impute(leads_df(spark, sf_dir)), MODEL_FEATURES)
    names = F.array(*[F.lit(n) for n in MODEL_FEATURES])
    return _r6(out.select("lead_id", F.posexplode("values").alias("pos", "value"))
               .select("lead_id", "pos", F.element_at(names, F.col("pos") + 1).alias("feature"), "value"))


@register("csv_round_trip", with_ctes(LEADS, IMPUTED, SCORED, body="""
SELECT lead_id, company_size, industry, lead_source, region, round(annual_revenue, 6) AS annual_revenue, website_visits,
  email_opens, ad_clicks, round(engagement_score, 6) AS engagement_score, previous_purchases, predicted_lead_score,
  round(probability_high, 6) AS probability_high, round(lead_rank_score, 6) AS lead_rank_score FROM ranked_base"""))
def q_csv_round_trip(spark, sf_dir):
    """Scored leads exported as CSV (every column, in another order and spelling) and read again."""
    import uuid

    path = shared_dir(spark, f"export-{uuid.uuid4().hex}")
    scored = scored_df(spark, sf_dir)
    mixed = scored.select(*[F.col(c).alias(c.title()) for c in reversed(scored.columns)])
    export_scored(mixed, path, fmt="csv", partition_by="Predicted_Lead_Score")
    back = read_leads(spark, path)
    return _r6(back.select(*S.LEAD_SCHEMA.names, "predicted_lead_score",
                           *[F.col(c).cast("double").alias(c) for c in ("probability_high", "lead_rank_score")]))


_SCORE_COLS = ("lead_id, predicted_index, predicted_lead_score, probability_low, probability_medium, "
               "probability_high, confidence, lead_rank_score")


@register("scored_leads", with_ctes(LEADS, IMPUTED, SCORED, body=f"""
SELECT lead_id, predicted_index, predicted_lead_score, round(probability_low, 6) AS probability_low,
  round(probability_medium, 6) AS probability_medium, round(probability_high, 6) AS probability_high,
  round(confidence, 6) AS confidence, round(lead_rank_score, 6) AS lead_rank_score FROM ranked_base"""))
def q_scored_leads(spark, sf_dir):
    return _r6(scored_leads_df(spark, sf_dir).select(*[c.strip() for c in _SCORE_COLS.split(",")]))


@register("lead_ranking", with_ctes(LEADS, IMPUTED, SCORED, body="""
SELECT lead_id, row_number() OVER (ORDER BY lead_rank_score DESC NULLS LAST, lead_id) AS rank,
       round(lead_rank_score, 6) AS lead_rank_score FROM ranked_base"""))
def q_lead_ranking(spark, sf_dir):
    return _r6(rank_leads(scored_leads_df(spark, sf_dir).select("lead_id", "lead_rank_score")).select(
        "lead_id", "rank", "lead_rank_score"))


@register("top_leads", with_ctes(LEADS, IMPUTED, SCORED, body="""
SELECT lead_id, CAST(row_number() OVER (ORDER BY lead_rank_score DESC NULLS LAST, lead_id) AS INTEGER) AS rank,
  company_size, industry, lead_source, region, round(annual_revenue, 6) AS annual_revenue,
  round(engagement_score, 6) AS engagement_score, predicted_lead_score,
  round(probability_high, 6) AS probability_high, round(confidence, 6) AS confidence,
  round(lead_rank_score, 6) AS lead_rank_score,
  format('{:.0f}', annual_revenue) AS annual_revenue_text, format('{:.0f}', engagement_score) AS engagement_score_text,
  format('{:.1f}%', probability_high * 100.0::DOUBLE) AS probability_high_text,
  format('{:.1f}%', confidence * 100.0::DOUBLE) AS confidence_text,
  CASE predicted_lead_score WHEN 'High' THEN 'green' WHEN 'Medium' THEN 'amber' END AS band
FROM ranked_base ORDER BY lead_rank_score DESC NULLS LAST, lead_id LIMIT 10"""))
def q_top_leads(spark, sf_dir):
    return _r6(top_leads(scored_leads_df(spark, sf_dir), S.DEFAULT_TOP_N))


@register("abm_dashboard", with_ctes(LEADS, IMPUTED, SCORED, body="""
SELECT COUNT(*) AS total_leads,
  (SELECT industry FROM scored WHERE industry IS NOT NULL GROUP BY industry ORDER BY COUNT(*) DESC, industry LIMIT 1) AS top_industry,
  (SELECT region FROM scored WHERE region IS NOT NULL GROUP BY region ORDER BY COUNT(*) DESC, region LIMIT 1) AS top_region,
  round(avg(annual_revenue), 6) AS avg_revenue, '$' || format('{:,.0f}', avg(annual_revenue)) AS avg_revenue_text,
  round(avg(engagement_score), 6) AS avg_engagement, format('{:.1f}', avg(engagement_score)) || '/100' AS avg_engagement_text,
  COUNT(*) FILTER (WHERE engagement_score > 70) AS high_engagement_leads,
  COUNT(*) FILTER (WHERE predicted_lead_score = 'High') AS n_high,
  COUNT(*) FILTER (WHERE predicted_lead_score = 'Medium') AS n_medium,
  COUNT(*) FILTER (WHERE predicted_lead_score = 'Low') AS n_low
FROM scored"""))
def q_abm_dashboard(spark, sf_dir):
    return abm_dashboard(scored_df(spark, sf_dir))


@register("score_distribution", with_ctes(LEADS, IMPUTED, SCORED, body="""
SELECT predicted_lead_score AS lead_class, COUNT(*) AS n,
  round(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS pct,
  format('{:.1f}', COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER ()) || '%' AS delta
FROM scored GROUP BY predicted_lead_score"""))
def q_score_distribution(spark, sf_dir):
    scored = scored_df(spark, sf_dir)
    share = class_share(scored.withColumnRenamed("predicted_lead_score", "lead_class"), "lead_class")
    total = scored.agg(F.count(F.lit(1))).scalar()
    return share.withColumn("delta", F.concat(one_decimal(F.col("n") * F.lit(100.0) / total), F.lit("%")))


# ---- evaluation: rule label (truth) vs frozen scorer prediction -------------------------

def _eval_input(spark, sf_dir) -> DataFrame:
    """Label and prediction of the same row: the labelled leads, scored in place and written once."""
    return written(spark, sf_dir, "evaluated", LEAD_INPUTS, lambda: frozen_scores(labeled_df(spark, sf_dir)).select(
        "lead_id", F.col("lead_score").alias("label"), F.col("predicted_index").alias("prediction"),
        "probability_low", "probability_medium", "probability_high"))


_EVAL_CTE = """
ev AS (SELECT labeled.lead_id, lead_score AS label, predicted_index AS prediction,
              probability_low, probability_medium, probability_high
       FROM labeled JOIN scored USING (lead_id)),
cm AS (SELECT a.label, b.prediction, COALESCE(c.n, 0) AS n
       FROM (VALUES (0), (1), (2)) a(label) CROSS JOIN (VALUES (0), (1), (2)) b(prediction)
       LEFT JOIN (SELECT label, prediction, COUNT(*) AS n FROM ev GROUP BY 1, 2) c
         ON c.label = a.label AND c.prediction = b.prediction),
rep AS (
  SELECT t.label AS class, CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS recall, support
  FROM (SELECT label, SUM(n) AS support, SUM(CASE WHEN label = prediction THEN n END) AS tp FROM cm GROUP BY label) t
  JOIN (SELECT prediction AS label, SUM(n) AS n_pred FROM cm GROUP BY prediction) p USING (label)),
rep2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall)
                        ELSE 0.0 END AS f1 FROM rep)"""


@register("confusion_matrix", with_ctes(LEADS, LABELED, IMPUTED, SCORED, _EVAL_CTE, body="""
SELECT CAST(label AS INTEGER) AS label, CAST(prediction AS INTEGER) AS prediction, CAST(n AS BIGINT) AS n FROM cm"""))
def q_confusion_matrix(spark, sf_dir):
    return E.confusion_counts(_eval_input(spark, sf_dir))


@register("classification_report", with_ctes(LEADS, LABELED, IMPUTED, SCORED, _EVAL_CTE, body="""
SELECT CASE class WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS "row",
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
FROM rep2
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(SUM(support) AS BIGINT) FROM rep2
UNION ALL
SELECT 'weighted avg', round(SUM(precision * support) / SUM(support), 6), round(SUM(recall * support) / SUM(support), 6),
       round(SUM(f1 * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM rep2"""))
def q_classification_report(spark, sf_dir):
    return E.classification_report(_eval_input(spark, sf_dir), names=S.CLASS_LABELS)


@register("eval_summary", with_ctes(LEADS, LABELED, IMPUTED, SCORED, _EVAL_CTE, body="""
SELECT CAST(SUM(support) AS BIGINT) AS n, round(SUM(recall * support) / SUM(support), 6) AS accuracy,
       round(SUM(precision * support) / SUM(support), 6) AS precision,
       round(SUM(recall * support) / SUM(support), 6) AS recall,
       round(SUM(f1 * support) / SUM(support), 6) AS f1 FROM rep2"""))
def q_eval_summary(spark, sf_dir):
    return E.summary_metrics(_eval_input(spark, sf_dir))


def _auc_sql(cls: int, col: str) -> str:
    return f"""
SELECT {cls} AS class, CASE WHEN SUM(npos) > 0 AND SUM(nneg) > 0
         THEN SUM(npos * (neg_below + nneg / 2.0::DOUBLE)) / (SUM(npos) * SUM(nneg)) END AS auc,
       COALESCE(SUM(npos), 0) AS support
FROM (SELECT s, npos, nneg, COALESCE(SUM(nneg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT {col} AS s, SUM(CASE WHEN label = {cls} THEN 1 ELSE 0 END) AS npos,
                   SUM(CASE WHEN label = {cls} THEN 0 ELSE 1 END) AS nneg
            FROM ev WHERE {col} IS NOT NULL GROUP BY {col}))"""


_AUC_SQL = with_ctes(LEADS, LABELED, IMPUTED, SCORED, _EVAL_CTE,
                     "per AS (" + "\nUNION ALL\n".join(
                         _auc_sql(c, col) for c, col in
                         ((0, "probability_low"), (1, "probability_medium"), (2, "probability_high"))) + ")",
                     body="""
SELECT CAST(class AS INTEGER) AS class, round(auc, 6) AS auc, CAST(support AS BIGINT) AS support FROM per
UNION ALL
SELECT -1, round(CASE WHEN COUNT(*) FILTER (WHERE auc IS NULL) = 0 THEN SUM(auc * support) / SUM(support) END, 6),
       CAST(SUM(support) AS BIGINT) FROM per""")


@register("roc_auc_ovr", _AUC_SQL)
def q_roc_auc_ovr(spark, sf_dir):
    return E.ovr_auc(_eval_input(spark, sf_dir), "label",
                     {0: "probability_low", 1: "probability_medium", 2: "probability_high"})


# ---- split and folds -----------------------------------------------------------------

_SPLIT_CTE = """
sp AS (
  SELECT lead_id, lead_score AS label, COUNT(*) OVER (PARTITION BY lead_score) AS class_n,
         row_number() OVER (PARTITION BY lead_score ORDER BY (lead_id * 7919) % 1000003, lead_id) AS class_pos
  FROM labeled),
sp2 AS (SELECT *, CAST(round(class_n * 0.2::DOUBLE) AS BIGINT) AS n_test FROM sp)"""


@register("stratified_split", with_ctes(LEADS, LABELED, _SPLIT_CTE, body="""
SELECT lead_id, label, CASE WHEN class_pos <= n_test THEN 'test' ELSE 'train' END AS split FROM sp2"""))
def q_stratified_split(spark, sf_dir):
    lab = labeled_df(spark, sf_dir).select("lead_id", F.col("lead_score").alias("label"))
    return stratified_split(lab, "label", "lead_id").select("lead_id", "label", "split")


@register("cv_folds", with_ctes(LEADS, LABELED, _SPLIT_CTE, body="""
SELECT lead_id, label, CAST((class_pos - n_test - 1) % 5 AS INTEGER) AS fold FROM sp2 WHERE class_pos > n_test"""))
def q_cv_folds(spark, sf_dir):
    lab = labeled_df(spark, sf_dir).select("lead_id", F.col("lead_score").alias("label"))
    return stratified_folds(lab, "label", "lead_id", 5).select("lead_id", "label", "fold")


# ---- streaming scorer (ST1): same numbers as the batch scorer on the same table ------

@register("stream_scores", with_ctes(LEADS, IMPUTED, SCORED, body="""
SELECT lead_id, predicted_index, predicted_lead_score, round(probability_low, 6) AS probability_low,
  round(probability_medium, 6) AS probability_medium, round(probability_high, 6) AS probability_high,
  round(confidence, 6) AS confidence FROM scored"""))
def q_stream_scores(spark, sf_dir):
    import uuid

    from leadlens.streaming.score_stream import capture_stats, start_scoring_stream

    leads = leads_df(spark, sf_dir)
    run = uuid.uuid4().hex
    src, sink, ckpt = (shared_dir(spark, f"stream-{run}/{p}") for p in ("in", "out", "ckpt"))
    leads.write.parquet(src)                 # the arriving files
    stats = capture_stats(leads)             # training-time statistics, one small row
    start_scoring_stream(spark, src, sink, ckpt, stats).awaitTermination()
    out = spark.read.parquet(sink)
    return _r6(out.select("lead_id", "predicted_index", "predicted_lead_score", "probability_low",
                          "probability_medium", "probability_high", "confidence"))
