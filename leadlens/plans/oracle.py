"""DuckDB SQL equivalents of the registered queries (tables are pre-registered views)."""

from __future__ import annotations

# ---- shared CTEs -----------------------------------------------------------
_LEADS = """
o AS (
  SELECT o_custkey, COUNT(*) AS n_orders,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS rev,
         SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_done,
         min_by(o_orderpriority, o_orderkey) AS first_prio
  FROM orders GROUP BY o_custkey),
l AS (
  SELECT o_custkey, COUNT(*) AS n_items,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r,
         SUM(CASE WHEN l_returnflag = 'A' AND l_discount >= 0.05 THEN 1 ELSE 0 END) AS n_a
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
leads AS (
SELECT c_custkey AS lead_id,
  CASE WHEN n_orders >= 13 THEN 'Large' WHEN n_orders >= 10 THEN 'Medium' ELSE 'Small' END AS company_size,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS industry,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE rev END AS annual_revenue,
  CAST(COALESCE(n_items, 0) AS BIGINT) AS website_visits,
  CAST(COALESCE(n_r, 0) AS BIGINT) AS email_opens,
  CAST(COALESCE(n_a, 0) AS BIGINT) AS ad_clicks,
  CASE WHEN c_custkey % 17 = 0 THEN NULL
       ELSE CAST(CAST(ROUND((CAST(c_acctbal AS DECIMAL(12,2)) + 1000) * 100, 0) AS BIGINT) AS DOUBLE) / 11000
  END AS engagement_score,
  CASE first_prio WHEN '1-URGENT' THEN 'Organic' WHEN '2-HIGH' THEN 'Paid Ads' WHEN '3-MEDIUM' THEN 'Referral'
       WHEN '4-NOT SPECIFIED' THEN 'Social Media' WHEN '5-LOW' THEN 'Email Campaign' END AS lead_source,
  r_name AS region,
  CAST(COALESCE(n_done, 0) AS BIGINT) AS previous_purchases
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey)"""

_LABELED = """
rq AS (SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY annual_revenue) AS p50,
              percentile_cont(0.75) WITHIN GROUP (ORDER BY annual_revenue) AS p75 FROM leads),
pts AS (
  SELECT leads.*, CAST(
      CASE company_size WHEN 'Large' THEN 40 WHEN 'Medium' THEN 20 ELSE 0 END
    + CASE WHEN annual_revenue > p75 THEN 30 WHEN annual_revenue > p50 THEN 15 ELSE 0 END
    + CASE WHEN engagement_score > 70 THEN 20 WHEN engagement_score > 50 THEN 10 ELSE 0 END
    + CASE WHEN website_visits > 30 THEN 10 ELSE 0 END
    + CASE WHEN email_opens > 10 THEN 5 ELSE 0 END
    + CASE WHEN previous_purchases > 2 THEN 15 ELSE 0 END
    + ((lead_id * 7919 + 13) % 20 - 10) AS INTEGER) AS points
  FROM leads, rq),
labeled AS (
  SELECT pts.*, CAST(CASE WHEN points >= 80 THEN 2 WHEN points >= 50 THEN 1 ELSE 0 END AS INTEGER) AS lead_score,
         CASE WHEN points >= 80 THEN 'High' WHEN points >= 50 THEN 'Medium' ELSE 'Low' END AS lead_class
  FROM pts)"""


def _mode(col: str, table: str = "leads") -> str:
    return (f"(SELECT {col} FROM {table} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY COUNT(*) DESC, {col} LIMIT 1)")


_NUM = ["annual_revenue", "website_visits", "email_opens", "ad_clicks", "engagement_score", "previous_purchases"]
_CAT = ["company_size", "industry", "lead_source", "region"]

_IMPUTED = """
med AS (SELECT {meds} FROM leads),
imputed AS (
  SELECT lead_id, {cats}, {nums}
  FROM leads, med)""".format(
    meds=", ".join(f"median({c}) AS m_{c}" for c in _NUM),
    cats=", ".join(f"COALESCE({c}, {_mode(c)}, 'Unknown') AS {c}" for c in _CAT),
    nums=", ".join(f"COALESCE(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in _NUM))

_Z = {c: f"(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)" for c in _NUM}
_FROZEN_W = {"annual_revenue": 0.9, "website_visits": 0.5, "email_opens": 0.3,
             "ad_clicks": 0.1, "engagement_score": 0.8, "previous_purchases": 0.6}
_S = " + ".join(f"{w!r} * {_Z[c]}" for c, w in _FROZEN_W.items()) + \
    " + COALESCE(CASE company_size WHEN 'Large' THEN 1.5 WHEN 'Medium' THEN 0.5 WHEN 'Small' THEN -0.5 END, 0.0)"

_SCORED = f"""
zst AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _NUM)} FROM imputed),
lg AS (SELECT lead_id, 0.2 - ({_S}) AS l0, 0.5 AS l1, -0.7 + ({_S}) AS l2 FROM imputed, zst),
ex AS (SELECT lead_id, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1,
              exp(l2 - greatest(l0, l1, l2)) AS e2 FROM lg),
pr AS (SELECT lead_id, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex),
scored AS (
  SELECT leads.*, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INTEGER) AS predicted_index,
         CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Low' WHEN p1 >= p2 THEN 'Medium' ELSE 'High' END AS predicted_lead_score,
         p0 AS probability_low, p1 AS probability_medium, p2 AS probability_high, greatest(p0, p1, p2) AS confidence
  FROM leads JOIN pr USING (lead_id)),
mm AS (SELECT min(annual_revenue) AS rlo, max(annual_revenue) AS rhi,
              min(engagement_score) AS elo, max(engagement_score) AS ehi FROM scored),
ranked_base AS (
  SELECT scored.*,
    (CASE predicted_lead_score WHEN 'High' THEN 1000 WHEN 'Medium' THEN 500 ELSE 0 END
     + 100.0::DOUBLE * probability_high
     + 50.0::DOUBLE * confidence * CASE WHEN predicted_lead_score IN ('High', 'Medium') THEN 1 ELSE 0 END
     + CASE WHEN rhi > rlo THEN 30.0::DOUBLE * (annual_revenue - rlo) / (rhi - rlo) ELSE 0 END
     + CASE WHEN ehi > elo THEN 20.0::DOUBLE * (engagement_score - elo) / (ehi - elo) ELSE 0 END) AS lead_rank_score
  FROM scored, mm)"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


LEADS, LABELED, IMPUTED, SCORED = _LEADS, _LABELED, _IMPUTED, _SCORED
