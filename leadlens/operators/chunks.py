"""Leads and summary statistics rendered as text chunks with metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.functions.fmt import money0, one_decimal
from leadlens.operators.ordering import materialize, with_global_row_number

CHUNK_COLUMNS = ["chunk_id", "type", "index", "industry", "company_size", "lead_score", "text"]


def _part(label: str, value: Column, rendered: Column | None = None) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(label), rendered if rendered is not None else value.cast("string")))


def lead_parts(df: DataFrame) -> list[Column]:
    """The sentence parts of one lead (fixed wording), NULL where the value is missing or the column absent."""
    has = set(df.columns)
    c = lambda name: F.col(name) if name in has else F.lit(None)
    pred = c("predicted_lead_score")
    return [
        _part("Company Size: ", c("company_size")),
        _part("Industry: ", c("industry")),
        _part("Region: ", c("region")),
        _part("Annual Revenue: $", c("annual_revenue"), money0(c("annual_revenue"))),
        _part("Engagement Score: ", c("engagement_score"),
              F.concat(one_decimal(c("engagement_score")), F.lit("/100"))),
        _part("Website Visits: ", c("website_visits")),
        _part("Email Opens: ", c("email_opens")),
        _part("Ad Clicks: ", c("ad_clicks")),
        _part("Lead Source: ", c("lead_source")),
        _part("Previous Purchases: ", c("previous_purchases")),
        _part("Predicted Lead Score: ", pred, F.concat(pred, F.lit(" quality"))),
        F.when(pred.isNotNull(), _part("Prediction Confidence: ", c("confidence"),
                                       F.concat(one_decimal(c("confidence") * F.lit(100.0)), F.lit("%")))),
        _part("Probability of High Quality: ", c("probability_high"),
              F.concat(one_decimal(c("probability_high") * F.lit(100.0)), F.lit("%"))),
    ]


def lead_text(df: DataFrame, compat: bool = False) -> Column:
    """'This lead is a {size} company in the {industry} industry. ' + remaining parts.

    Default: size and industry parts are dropped by name and NULLs print as 'company' /
    'unknown'. ``compat=True`` keeps the original positional skip of the first two present
    parts and prints a NULL as 'nan'."""
    parts = lead_parts(df)
    has = set(df.columns)
    if compat:
        size = F.coalesce(F.col("company_size"), F.lit("nan")) if "company_size" in has else F.lit("company")
        ind = F.coalesce(F.col("industry"), F.lit("nan")) if "industry" in has else F.lit("unknown")
        rest = F.array_join(F.slice(F.array_compact(F.array(*parts)), 3, len(parts)), " ")
    else:
        size = F.coalesce(F.col("company_size"), F.lit("company")) if "company_size" in has else F.lit("company")
        ind = F.coalesce(F.col("industry"), F.lit("unknown")) if "industry" in has else F.lit("unknown")
        rest = F.concat_ws(" ", *parts[2:])
    return F.concat(F.lit("This lead is a "), size, F.lit(" company in the "), ind, F.lit(" industry. "), rest)


def lead_chunks(scored: DataFrame, compat: bool = False) -> DataFrame:
    """One chunk per lead: id 'lead_<lead_id>', metadata columns NULL when absent."""
    has = set(scored.columns)
    meta = lambda name: (F.col(name).cast("string") if name in has else F.lit(None).cast("string"))
    return scored.select(
        F.concat(F.lit("lead_"), F.col("lead_id").cast("string")).alias("chunk_id"),
        F.lit("lead").alias("type"),
        F.col("lead_id").cast("string").alias("index"),
        meta("industry").alias("industry"),
        meta("company_size").alias("company_size"),
        meta("predicted_lead_score").alias("lead_score"),
        lead_text(scored, compat).alias("text"),
    )


def summary_figures(scored: DataFrame) -> DataFrame:
    """(column, value, n, and for column 'all' avg_revenue, max_revenue, avg_engagement): everything
    the summary says, from one scan of the table. NULLs have no value and stand for no row."""
    has = set(scored.columns)
    cols = [c for c in ("predicted_lead_score", "industry", "region") if c in has]
    figure = lambda c: F.col(c).cast("double") if c in has else F.lit(None).cast("double")
    base = scored.select(*[F.col(c).cast("string").alias(c) for c in cols], figure("annual_revenue").alias("revenue"),
                         figure("engagement_score").alias("engagement"))
    grouped = base.groupingSets([[], *[[F.col(c)] for c in cols]], *cols) if cols else base.groupBy()
    out = grouped.agg(
        F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in cols], F.lit("all")).alias("column"),
        F.coalesce(*cols, F.lit(None).cast("string")).alias("value"), F.count(F.lit(1)).alias("n"),
        F.avg("revenue").alias("avg_revenue"), F.max("revenue").alias("max_revenue"), F.avg("engagement").alias("avg_engagement"))
    return out.where("column = 'all' or value is not null").select("column", "value", "n", "avg_revenue", "max_revenue", "avg_engagement")


def summary_sentences(scored: DataFrame) -> DataFrame:
    """(section, n, value, text) rows of the summary; reading order is section, falling n, value.
    Counts drop NULLs, shares divide by all rows. The wording is fixed."""
    has = set(scored.columns)
    figures = materialize(summary_figures(scored))   # one row per value; every section reads it
    whole = figures.where("column = 'all'").agg(*[F.max(c).alias(c) for c in ("n", "avg_revenue", "max_revenue", "avg_engagement")])
    total = whole.select(F.coalesce("n", F.lit(0))).scalar()
    counted = lambda col: figures.where(F.col("column") == col)

    def section(number: int, rows: DataFrame, text: Column, n: Column | None = None, value: Column | None = None) -> DataFrame:
        return rows.select(F.lit(number).alias("section"), (F.lit(0) if n is None else n).cast("long").alias("n"),
                           (F.lit("") if value is None else value).alias("value"), text.alias("text"))

    share = one_decimal(F.col("n") * F.lit(100.0) / total)
    sections = [section(0, whole, F.concat(F.lit("Total leads analyzed: "), F.coalesce("n", F.lit(0)).cast("string")))]
    if "predicted_lead_score" in has:
        sections.append(section(1, counted("predicted_lead_score"), F.concat(
            F.col("n").cast("string"), F.lit(" leads ("), share, F.lit("%) are predicted as "), F.col("value"), F.lit(" quality")),
            F.col("n"), F.col("value")))
    if "industry" in has:
        top = counted("industry").orderBy(F.desc("n"), "value").limit(S.SUMMARY_TOP_INDUSTRIES)
        items = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "value", F.concat(
            F.col("value"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("s"))))
        sections.append(section(2, top.agg(items.alias("items")), F.concat(
            F.lit("Top industries: "), F.array_join(F.transform("items", lambda x: x["s"]), ", "))))
    if "annual_revenue" in has:
        sections.append(section(3, whole, F.concat(F.lit("Average annual revenue: $"), money0(F.col("avg_revenue")),
                                                   F.lit(", Maximum: $"), money0(F.col("max_revenue")))))
    if "engagement_score" in has:
        sections.append(section(4, whole, F.concat(F.lit("Average engagement score: "), one_decimal(F.col("avg_engagement")), F.lit("/100"))))
    if "region" in has:
        sections.append(section(5, counted("region"), F.concat(share, F.lit("% of leads are from "), F.col("value")),
                                F.col("n"), F.col("value")))
    return reduce(DataFrame.unionByName, sections)


def summary_chunks(scored: DataFrame) -> DataFrame:
    """Summary sentences numbered in reading order: id 'summary_<i>'."""
    sent = with_global_row_number(summary_sentences(scored), [F.col("section"), F.desc("n"), F.col("value")], "i")
    index = (F.col("i") - 1).cast("string")
    return sent.select(
        F.concat(F.lit("summary_"), index).alias("chunk_id"),
        F.lit("summary").alias("type"), index.alias("index"),
        F.lit(None).cast("string").alias("industry"), F.lit(None).cast("string").alias("company_size"),
        F.lit(None).cast("string").alias("lead_score"), "text")


def chunk_table(scored: DataFrame, compat: bool = False) -> DataFrame:
    """Lead chunks followed by summary chunks."""
    return lead_chunks(scored, compat).unionByName(summary_chunks(scored))
