"""Reading the driver's parquet tables and deriving the lead table from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.schema import PRIORITY_TO_SOURCE

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _source_of_priority(col):
    expr = F.lit(None).cast("string")
    for prio, source in reversed(list(PRIORITY_TO_SOURCE.items())):
        expr = F.when(col == prio, F.lit(source)).otherwise(expr)
    return expr


def customer_activity(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Per-customer order and line-item counters in one aggregation.

    Line items are first reduced to one row per order (partial aggregation before the
    shuffle), so the orders-lineitem join is 1:1 on the order key and the customer
    aggregation reads one row per order. A customer holding a large share of the orders
    is combined map-side; no group is ever collected.
    """
    items = (lineitem
             .select("l_orderkey", "l_returnflag", "l_discount")
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n_items"),
                  F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_r"),
                  F.sum(F.when((F.col("l_returnflag") == "A") & (F.col("l_discount") >= 0.05), 1)
                        .otherwise(0)).alias("n_a")))
    per_order = (orders
                 .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
                 .join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    return (per_order
            .groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("n_orders"),
                 F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("rev"),
                 F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_done"),
                 F.min_by("o_orderpriority", "o_orderkey").alias("first_prio"),
                 F.sum("n_items").alias("n_items"),
                 F.sum("n_r").alias("n_r"),
                 F.sum("n_a").alias("n_a")))


def lead_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lead per customer, with the lead columns of the scoring application.

    Size from order count, industry from market segment, revenue from order totals
    (exact decimal sum), activity counters from line items, engagement from the
    account balance, source from the first order's priority, region through nation.
    Nulls are injected on fixed key residues so that imputation and null ordering are
    exercised (industry every 23rd key, revenue every 29th, engagement every 17th).
    """
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    activity = customer_activity(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))
    # nation and region are fixed-size dimensions; the planner broadcasts them by their
    # measured size (autoBroadcastJoinThreshold), no hint needed.
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = (customer
              .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(activity, F.col("o_custkey") == F.col("c_custkey"), "left"))
    n_orders = F.col("n_orders")
    return joined.select(
        F.col("c_custkey").alias("lead_id"),
        F.when(n_orders >= 13, "Large").when(n_orders >= 10, "Medium").otherwise("Small").alias("company_size"),
        F.when(F.col("c_custkey") % 23 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("industry"),
        F.when(F.col("c_custkey") % 29 == 0, F.lit(None)).otherwise(F.col("rev")).alias("annual_revenue"),
        F.coalesce(F.col("n_items"), F.lit(0)).cast("bigint").alias("website_visits"),
        F.coalesce(F.col("n_r"), F.lit(0)).cast("bigint").alias("email_opens"),
        F.coalesce(F.col("n_a"), F.lit(0)).cast("bigint").alias("ad_clicks"),
        F.when(F.col("c_custkey") % 17 == 0, F.lit(None)).otherwise(
            F.expr("CAST(CAST(ROUND((CAST(c_acctbal AS DECIMAL(12,2)) + 1000) * 100, 0) AS BIGINT)"
                   " AS DOUBLE) / 11000")).alias("engagement_score"),
        _source_of_priority(F.col("first_prio")).alias("lead_source"),
        F.col("r_name").alias("region"),
        F.coalesce(F.col("n_done"), F.lit(0)).cast("bigint").alias("previous_purchases"),
    )
