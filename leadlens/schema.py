"""Lead schema, column groups and the fixed values the pipeline must reproduce."""

from __future__ import annotations

from pyspark.sql import types as T

# Lead columns, in the order the scoring app declares them (categorical first, then numeric).
CATEGORICAL = ["company_size", "industry", "lead_source", "region"]
NUMERIC = ["annual_revenue", "website_visits", "email_opens", "ad_clicks",
           "engagement_score", "previous_purchases"]
REQUIRED = CATEGORICAL + NUMERIC

# Column order of the training frame (numerics first, then one-hot blocks in CATEGORICAL order).
FEATURE_NUMERIC = ["annual_revenue", "website_visits", "email_opens", "ad_clicks",
                   "engagement_score", "previous_purchases"]

LEAD_SCHEMA = T.StructType([
    T.StructField("lead_id", T.LongType()),
    T.StructField("company_size", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("annual_revenue", T.DoubleType()),
    T.StructField("website_visits", T.LongType()),
    T.StructField("email_opens", T.LongType()),
    T.StructField("ad_clicks", T.LongType()),
    T.StructField("engagement_score", T.DoubleType()),
    T.StructField("lead_source", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("previous_purchases", T.LongType()),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the surveyed application's for equal results.
# ---------------------------------------------------------------------------
# Class index -> label.
CLASS_LABELS = {0: "Low", 1: "Medium", 2: "High"}
# Points rule: company size points; revenue above p75 / above p50; engagement above 70 / above 50;
# website visits above 30; email opens above 10; previous purchases above 2; class cuts 80 and 50.
SIZE_POINTS = {"Large": 40, "Medium": 20}
REVENUE_POINTS = (30, 15)            # > p75, > p50
ENGAGEMENT_POINTS = ((70, 20), (50, 10))
VISITS_POINTS = (30, 10)
OPENS_POINTS = (10, 5)
PURCHASES_POINTS = (2, 15)
CLASS_CUTS = ((80, 2), (50, 1))
# Rank score: class weight + 100 * P(High) + 50 * confidence for High/Medium
# + 30 * min-max revenue + 20 * min-max engagement.
RANK_CLASS_WEIGHT = {"High": 1000, "Medium": 500, "Low": 0}
RANK_P_HIGH, RANK_CONFIDENCE, RANK_REVENUE, RANK_ENGAGEMENT = 100, 50, 30, 20
# Engagement threshold of the dashboard tile.
HIGH_ENGAGEMENT = 70
# Top-k sizes: industries in the summary text, industries in the chart, default top-N, retrieval.
SUMMARY_TOP_INDUSTRIES, CHART_TOP_INDUSTRIES, DEFAULT_TOP_N, DEFAULT_TOP_K = 5, 10, 10, 5
# Lead source names by first order priority (test-data mapping).
PRIORITY_TO_SOURCE = {"1-URGENT": "Organic", "2-HIGH": "Paid Ads", "3-MEDIUM": "Referral",
                      "4-NOT SPECIFIED": "Social Media", "5-LOW": "Email Campaign"}
# Deterministic jitter in [-10, 9]: (lead_id * 7919 + 13) % 20 - 10.
JITTER_MUL, JITTER_ADD, JITTER_MOD, JITTER_SHIFT = 7919, 13, 20, 10
