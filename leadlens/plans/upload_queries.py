"""Uploads that keep coming: folders of files, growing stores, states that merge."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.operators import answer as A
from leadlens.operators import hashed, merged
from leadlens.operators.chunks import lead_chunks
from leadlens.operators.models import compare_models, feature_names, model_scores
from leadlens.operators.ordering import materialize
from leadlens.operators.split import CLASS_STEP, SHUFFLE_MOD, SHUFFLE_MUL, hash_split
from leadlens.plans.lead_queries import labeled_df, leads_df, scored_df
from leadlens.plans.model_queries import training_table
from leadlens.plans.oracle import IMPUTED, LABELED, LEADS, SCORED, with_ctes
from leadlens.plans.registry import ORACLE, register
from leadlens.plans.text_queries import _CHUNK_CTES, _QUESTIONS, _TEMPLATE, _TFIDF, answers_df
from leadlens.session import shared_dir
from leadlens.sources import chat_log, chunk_increment
from leadlens.sources.intake import read_folder
from leadlens.sources.leads_csv import preview, read_leads
from leadlens.sources.model_store import load_model, model_versions, save_model
from leadlens.sources.tables import load


@register("csv_rejects", with_ctes(LEADS, body="""
SELECT CAST(lead_id AS VARCHAR) AS lead_id, CASE WHEN lead_id % 11 = 0 OR lead_id % 13 = 0 THEN 'rejected' ELSE 'good' END AS status,
  array_to_string(list_filter([CASE WHEN lead_id % 11 = 0 THEN 'annual_revenue: n/a' END,
                               CASE WHEN lead_id % 13 = 0 THEN 'website_visits: 3.5x' END], lambda x: x IS NOT NULL), '; ') AS reasons,
  CASE WHEN lead_id % 11 > 0 AND lead_id % 13 > 0 THEN website_visits END AS website_visits,
  CASE WHEN lead_id % 11 > 0 AND lead_id % 13 > 0 AND lead_id % 2 = 0 THEN 'note ' || CAST(lead_id AS VARCHAR) END AS note
FROM leads"""))
def q_csv_rejects(spark, sf_dir):
    """One folder of CSV files with two headers (another order and spelling, an extra column) and
    planted faults, read back: every record is either good or set apart with its reasons."""
    path = shared_dir(spark, f"uploads-{uuid.uuid4().hex}")
    text = leads_df(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in S.LEAD_SCHEMA.names])
    every = lambda n: F.col("lead_id").cast("long") % n == 0
    text = (text.withColumn("annual_revenue", F.when(every(11), "n/a").otherwise(F.col("annual_revenue")))
            .withColumn("website_visits", F.when(every(13), "3.5x").otherwise(F.col("website_visits"))))
    text.where(~every(2)).write.option("header", True).csv(f"{path}/one")
    other = text.where(every(2)).withColumn("note", F.concat(F.lit("note "), "lead_id"))
    other.select(*[F.col(c).alias(c.replace("_", " ").title()) for c in reversed(other.columns)]).write.option("header", True).csv(f"{path}/two")
    good, bad = read_folder(spark, path)
    kept = good.select(F.col("lead_id").cast("string").alias("lead_id"), F.lit("good").alias("status"), F.lit("").alias("reasons"), "website_visits", "note")
    return kept.unionByName(bad.select("lead_id", F.lit("rejected").alias("status"), F.array_join(F.array_sort("reasons"), "; ").alias("reasons"),
                                       F.lit(None).cast("bigint").alias("website_visits"), F.lit(None).cast("string").alias("note")))


@register("chat_log", with_ctes(*_CHUNK_CTES, _TFIDF, _QUESTIONS, f"""
appended AS (
  SELECT conv_id, turn, role, text, NULL::INTEGER AS contexts_used, 'history' AS batch FROM conversations
  UNION ALL
  SELECT b.conv_id, mx.last_turn + row_number() OVER (PARTITION BY b.conv_id ORDER BY b.turn), 'assistant', {_TEMPLATE}, b.contexts_used, 'answers'
  FROM blocks b JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) mx USING (conv_id))""",
    body="SELECT * FROM appended"))
def q_chat_log(spark, sf_dir):
    """The stored log after the history and the answers were appended, the answers by a job that
    ran twice."""
    base = shared_dir(spark, f"chat-log-{uuid.uuid4().hex}")
    conversations = load(spark, sf_dir, "conversations")
    turns = A.append_answers(conversations, answers_df(spark, sf_dir))
    chat_log.append(turns.where("contexts_used is null"), base, "history")
    for _ in range(2):
        chat_log.append(turns.where("contexts_used is not null"), base, "answers")
    return chat_log.read(spark, base)


_BUCKETS = 64


@register("chunk_store_increment", with_ctes(LEADS, body=f"""
SELECT * FROM (
  SELECT 1 AS step, 'first' AS what, 0 AS kept, 0 AS rewritten, COUNT(DISTINCT lead_id % {_BUCKETS}) AS added, 0 AS removed, COUNT(*) AS n_lead_chunks FROM leads
  UNION ALL SELECT 2, 'unchanged', COUNT(DISTINCT lead_id % {_BUCKETS}), 0, 0, 0, COUNT(*) FROM leads
  UNION ALL SELECT 3, 'changed', COUNT(DISTINCT lead_id % {_BUCKETS}) - COUNT(DISTINCT lead_id % {_BUCKETS}) FILTER (WHERE lead_id % {_BUCKETS} IN (5, 9)),
    COUNT(DISTINCT lead_id % {_BUCKETS}) FILTER (WHERE lead_id % {_BUCKETS} IN (5, 9)), 0, 0, COUNT(*) FROM leads
  UNION ALL SELECT 4, 'removed', COUNT(DISTINCT lead_id % {_BUCKETS}) FILTER (WHERE lead_id % {_BUCKETS} <> 7), 0, 0,
    COUNT(DISTINCT lead_id % {_BUCKETS}) FILTER (WHERE lead_id % {_BUCKETS} = 7), COUNT(*) FILTER (WHERE lead_id % {_BUCKETS} <> 7) FROM leads)"""))
def q_chunk_store_increment(spark, sf_dir):
    """Buckets kept, rewritten, added and removed by builds after known changes."""
    base = shared_dir(spark, f"chunk-increment-{uuid.uuid4().hex}")
    scored = scored_df(spark, sf_dir)
    bucket = chunk_increment.bucket_of("lead_id", _BUCKETS)
    changed = scored.withColumn("ad_clicks", F.when(bucket.isin(5, 9), F.col("ad_clicks") + 1).otherwise(F.col("ad_clicks")))
    rows = []
    for step, (what, table) in enumerate([("first", scored), ("unchanged", scored), ("changed", changed), ("removed", changed.where(bucket != 7))], 1):
        n = chunk_increment.build(table, base, _BUCKETS)
        rows.append((step, what, n["kept"], n["rewritten"], n["added"], n["removed"],
                     chunk_increment.read(spark, base).where("type = 'lead'").count()))
    return spark.createDataFrame(rows, "step int, what string, kept long, rewritten long, added long, removed long, n_lead_chunks long")


_SHARES = {0: 0.2, 1: 0.25, 2: 0.5}


@register("hash_split", with_ctes(LEADS, LABELED, body=f"""
SELECT lead_id, lead_score AS label,
  CASE WHEN (lead_id * {SHUFFLE_MUL} % {SHUFFLE_MOD} + lead_score * {CLASS_STEP}) % {SHUFFLE_MOD}
            < CASE lead_score WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END * {SHUFFLE_MOD}
       THEN 'test' ELSE 'train' END AS split
FROM labeled"""))
def q_hash_split(spark, sf_dir):
    lab = labeled_df(spark, sf_dir).select("lead_id", F.col("lead_score").alias("label"))
    return hash_split(lab, "label", "lead_id", by_class=_SHARES)


@register("hashed_vectors", with_ctes(LEADS, IMPUTED, SCORED, _CHUNK_CTES[3], f"""
htok AS (SELECT chunk_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM lead_chunks),
htf AS (SELECT chunk_id, ('0x' || substr(md5(term), 1, 7))::BIGINT % {hashed.PLACES} AS place, COUNT(*) AS tf FROM htok WHERE term <> '' GROUP BY ALL),
hdf AS (SELECT place, ln((1.0::DOUBLE + (SELECT COUNT(*) FROM lead_chunks)) / (1.0::DOUBLE + COUNT(*))) AS idf FROM htf GROUP BY place),
hw AS (SELECT chunk_id, place, tf * idf AS w FROM htf JOIN hdf USING (place) WHERE idf <> 0),
hn AS (SELECT chunk_id, sqrt(SUM(w * w)) AS norm FROM hw GROUP BY chunk_id)""",
    body="SELECT chunk_id, CAST(place AS INTEGER) AS place, round(w / norm, 6) AS weight FROM hw JOIN hn USING (chunk_id)"))
def q_hashed_vectors(spark, sf_dir):
    """Lead chunks by the saved and loaded embedder."""
    chunks = materialize(lead_chunks(scored_df(spark, sf_dir)).select("chunk_id", "text"))
    path = shared_dir(spark, f"embedder-{uuid.uuid4().hex}")
    hashed.save_embedder(hashed.fit_embedder(chunks), path)
    vectors = hashed.embed(hashed.load_embedder(path), chunks, ["chunk_id"])
    return hashed.weights_long(vectors, ["chunk_id"]).withColumn("weight", F.round("weight", 6))


def _uploads(table):
    """Three uploads of one table, by id."""
    return [(f"upload {i}", table.where(F.pmod("lead_id", F.lit(3)) == i)) for i in range(3)]


@register("merged_dashboard", ORACLE["abm_dashboard"])
def q_merged_dashboard(spark, sf_dir):
    """The dashboard from the states of three uploads, each kept when it arrived."""
    path = shared_dir(spark, f"dashboard-{uuid.uuid4().hex}")
    for name, part in _uploads(scored_df(spark, sf_dir)):
        merged.dashboard_state(part, name).write.mode("append").parquet(path)
    return merged.merged_dashboard(spark.read.parquet(path))


@register("merged_quantiles", with_ctes(LEADS, body=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS n, {q}::DOUBLE AS at, TRUE AS within_bound FROM leads"
    for c in S.NUMERIC for q in (0.25, 0.5, 0.75))))
def q_merged_quantiles(spark, sf_dir):
    """Quantiles from merged sketches of three uploads, each held against the exact ranks: within
    the stated bound of 1.5 % of the rows."""
    leads, path, at = leads_df(spark, sf_dir), shared_dir(spark, f"quantiles-{uuid.uuid4().hex}"), [0.25, 0.5, 0.75]
    for name, part in _uploads(leads):
        merged.quantile_state(part, S.NUMERIC, name).write.mode("append").parquet(path)
    found = materialize(merged.merged_quantiles(spark.read.parquet(path), at))
    rows = {r.column: r for r in found.collect()}   # one row per column
    checks = [F.struct(F.lit(c).alias("column"), F.lit(rows[c].n).alias("n"), F.lit(q).alias("at"),
                       F.count_if(F.col(c) < rows[c].quantiles[i]).alias("below"), F.count_if(F.col(c) <= rows[c].quantiles[i]).alias("upto"))
              for c in S.NUMERIC if c in rows for i, q in enumerate(at)]
    ranks = leads.agg(F.array(*checks).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return ranks.select("column", "n", "at", ((F.col("below") <= (F.col("at") + 0.015) * F.col("n")) & (F.col("upto") >= (F.col("at") - 0.015) * F.col("n"))).alias("within_bound"))


@register("upload_preview", with_ctes(LEADS, body=f"""
SELECT lead_id, company_size, industry, round(annual_revenue, 6) AS annual_revenue, website_visits, region,
  (SELECT COUNT(*) FROM leads) AS n_rows, {len(S.LEAD_SCHEMA.names)} AS n_columns FROM leads ORDER BY lead_id LIMIT 10"""))
def q_upload_preview(spark, sf_dir):
    """The first ten leads of an upload in the order of their ids, with its size."""
    path = shared_dir(spark, f"preview-{uuid.uuid4().hex}")
    leads_df(spark, sf_dir).select(*S.LEAD_SCHEMA.names).write.option("header", True).csv(path)
    first, rows, columns = preview(read_leads(spark, path).orderBy("lead_id"))
    return first.select("lead_id", "company_size", "industry", F.round("annual_revenue", 6).alias("annual_revenue"), "website_visits", "region",
                        F.lit(rows).cast("long").alias("n_rows"), F.lit(columns).alias("n_columns"))


#: Uploads by the columns they leave out.
_LEFT_OUT = {"complete": [], "without region": ["region"], "without two": ["ad_clicks", "industry"], "without id": ["lead_id"]}


@register("upload_checks", with_ctes(LEADS, body="""
SELECT 'complete' AS upload, '' AS refused, COUNT(*) AS n_rows FROM leads
UNION ALL SELECT 'without region', 'Missing required columns: region', 0
UNION ALL SELECT 'without two', 'Missing required columns: industry, ad_clicks', 0
UNION ALL SELECT 'without id', '', COUNT(*) FROM leads"""))
def q_upload_checks(spark, sf_dir):
    """Uploads with and without required columns: what the reader refuses, and the rows it takes."""
    path, rows = shared_dir(spark, f"checks-{uuid.uuid4().hex}"), []
    for i, (upload, left_out) in enumerate(_LEFT_OUT.items()):
        kept = [c for c in S.LEAD_SCHEMA.names if c not in left_out]
        leads_df(spark, sf_dir).select(*kept).write.option("header", True).csv(f"{path}/{i}")
        try:
            rows.append((upload, "", read_leads(spark, f"{path}/{i}").where("lead_id is not null").count()))
        except ValueError as e:
            rows.append((upload, str(e), 0))
    return spark.createDataFrame(rows, "upload string, refused string, n_rows long")


@register("model_package", with_ctes(LEADS, body="""
SELECT 'rows' AS what, COUNT(*) AS n FROM leads
UNION ALL SELECT 'scores unlike the fitted model', 0
UNION ALL SELECT 'feature names unlike the fitted model', 0
UNION ALL SELECT 'versions', 2
UNION ALL SELECT 'version loaded as newest', 2
UNION ALL SELECT 'version loaded by number', 1"""))
def q_model_package(spark, sf_dir):
    """One learner fitted on the leads, saved as two versions and loaded: every lead has the fitted
    model's score, and each version its own name."""
    data = training_table(spark, sf_dir)
    _, _, fitted = compare_models(data, cv_folds=0, models=["Logistic Regression"])
    path, names = shared_dir(spark, f"package-{uuid.uuid4().hex}"), feature_names(fitted, data)
    for n in (1, 2):
        save_model(spark, fitted, path, str(n), names)
    loaded, newest, loaded_names = load_model(spark, path)
    older = load_model(spark, path, 1)[1]
    figures = ["probability_low", "probability_medium", "probability_high", "predicted_index"]
    of = lambda model: model_scores(model, data).select("lead_id", *figures)
    unlike = materialize(of(fitted).exceptAll(of(loaded)).agg(F.count(F.lit(1)).alias("n"))).first()["n"]
    rows = [("rows", of(loaded).count()), ("scores unlike the fitted model", unlike),
            ("feature names unlike the fitted model", sum(a != b for a, b in zip(names, loaded_names, strict=True))),
            ("versions", len(model_versions(spark, path))), ("version loaded as newest", int(newest)), ("version loaded by number", int(older))]
    return spark.createDataFrame(rows, "what string, n long")
