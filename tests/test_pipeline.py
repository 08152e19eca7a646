"""Sources, sinks, split, generator, streaming, models: property tests."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.operators.features import aligned_features, missing_columns
from leadlens.operators.generator import generate_leads
from leadlens.operators.labeling import label_leads
from leadlens.operators.ranking import rank_leads
from leadlens.operators.scoring import frozen_scores, with_rank_score
from leadlens.operators.split import stratified_folds, stratified_split
from leadlens.sources import chunk_store
from leadlens.sources.leads_csv import export_scored, read_leads
from leadlens.sources.tables import lead_table
from tests.conftest import SF_SMALL

HEADER = ["Company_Size", "Industry", "Annual_Revenue", "Website_Visits", "Email_Opens", "Ad_Clicks",
          "Engagement_Score", "Lead_Source", "Region", "Previous_Purchases"]


def _write_csv(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEADER)
        w.writerows(rows)


def test_csv_read_validate_score_export(spark, tmp_dir):
    p = os.path.join(tmp_dir, "leads.csv")
    _write_csv(p, [["Large", "Tech", "54321.5", "30", "8", "5", "82.25", "Organic", "Europe", "2"],
                   ["Small", "", "", "12", "3", "1", "NaN", "Referral", "Asia", "0"],
                   ["Medium", "Energy", "1000", "40", "12", "7", "60", "Paid Ads", "Others", "4"]])
    df = read_leads(spark, p)
    assert missing_columns(df) == []
    assert dict(df.dtypes)["annual_revenue"] == "double" and dict(df.dtypes)["website_visits"] == "bigint"
    assert df.where(F.col("engagement_score").isNull()).count() == 1        # NaN -> NULL
    scored = with_rank_score(frozen_scores(df))
    ranked = rank_leads(scored).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3]
    assert ranked[-1]["lead_rank_score"] is None                             # NULL revenue ranks last
    out = os.path.join(tmp_dir, "export")
    export_scored(scored, out, fmt="csv")
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 3 and "rank" not in back.columns
    assert set(scored.columns) == set(back.columns)                          # the predicted class too
    again = {r["lead_id"] for r in read_leads(spark, p).collect()}
    assert {r["lead_id"] for r in df.repartition(3).collect()} == again      # ids do not depend on splits


def test_csv_with_another_header_fails_and_order_does_not_matter(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "b.csv")
    row = ["Large", "Tech", "54321.5", "30", "8", "5", "82.25", "Organic", "Europe", "2"]
    _write_csv(a, [row])
    with open(b, "w", newline="") as f:
        csv.writer(f).writerows([HEADER[::-1], row[::-1]])
    one, two = read_leads(spark, a).drop("lead_id").first(), read_leads(spark, b).drop("lead_id").first()
    assert one.asDict() == two.asDict() and one["annual_revenue"] == 54321.5
    with pytest.raises(Exception):                                           # never read by position
        read_leads(spark, tmp_dir).collect()
    with open(b, "w") as f:
        f.write("Region,Industry\nAsia,Tech\n")
    with pytest.raises(ValueError, match="company_size"):
        read_leads(spark, b)


def test_scoring_keeps_one_row_per_row(spark):
    leads = lead_table(spark, SF_SMALL)
    some = leads.limit(5)
    odd = leads.unionByName(some).unionByName(some.withColumn("lead_id", F.lit(None).cast("long")))
    scored = frozen_scores(odd)
    assert scored.count() == odd.count() == leads.count() + 10
    assert scored.where("lead_id is null and probability_high is not null").count() == 5


def test_preview(spark, tmp_dir):
    from leadlens.sources.leads_csv import preview
    rows, n, width = preview(lead_table(spark, SF_SMALL), 3)
    assert rows.count() == 3 and n == 150 and width == 11


def test_missing_columns_in_declared_order(spark):
    df = spark.createDataFrame([(1, "x")], "lead_id long, region string")
    assert missing_columns(df)[:3] == ["company_size", "industry", "lead_source"]


def test_probabilities_and_rank(spark):
    scored = with_rank_score(frozen_scores(lead_table(spark, SF_SMALL)))
    bad = scored.where(F.abs(F.col("probability_low") + F.col("probability_medium") + F.col("probability_high") - 1)
                       > 1e-9).count()
    assert bad == 0
    ranks = sorted(r["rank"] for r in rank_leads(scored).select("rank").collect())
    assert ranks == list(range(1, scored.count() + 1))


def test_split_and_folds_properties(spark):
    lab = label_leads(lead_table(spark, SF_SMALL)).select("lead_id", F.col("lead_score").alias("label"))
    sp = stratified_split(lab, "label", "lead_id")
    per = {(r["label"], r["split"]): r["n"] for r in sp.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    for c in (0, 1, 2):
        n = per.get((c, "test"), 0) + per.get((c, "train"), 0)
        assert per.get((c, "test"), 0) == round(n * 0.2)
    folds = stratified_folds(lab, "label", "lead_id", 5)
    assert folds.count() == sp.where(F.col("split") == "train").count()
    sizes = [r["n"] for r in folds.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()]
    by_label = folds.groupBy("label", "fold").agg(F.count("*").alias("n")).groupBy("label").agg(
        (F.max("n") - F.min("n")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in by_label) and sum(sizes) == folds.count()


def test_generator_marginals(spark):
    g = generate_leads(spark, 20000, seed=42).cache()
    n = g.count()
    share = lambda col, v: g.where(F.col(col) == v).count() / n
    for col, v, p in (("company_size", "Small", 0.5), ("industry", "Tech", 0.25), ("region", "Others", 0.1)):
        assert abs(share(col, v) - p) < 4 * (p * (1 - p) / n) ** 0.5
    m = g.agg(F.avg("website_visits"), F.variance("email_opens"), F.avg("engagement_score")).first()
    assert abs(m[0] - 25) < 0.2 and abs(m[1] - 8) < 0.4 and abs(m[2] - 100 * 2 / 7) < 0.5
    assert set(r[0] for r in g.select("lead_score").distinct().collect()) <= {0, 1, 2}


def test_chunk_store_build_skip_rebuild(spark, tmp_dir):
    scored = frozen_scores(lead_table(spark, SF_SMALL))
    base = os.path.join(tmp_dir, "store")
    assert chunk_store.chunk_count(spark, base) == 0
    assert chunk_store.build_context(scored, base) is True
    n = chunk_store.chunk_count(spark, base)
    assert n > scored.count()
    assert chunk_store.build_context(scored, base) is False                  # unchanged -> skipped
    assert chunk_store.build_context(scored, base, force_rebuild=True) is True
    assert chunk_store.chunk_count(spark, base) == n


def test_stream_equals_batch(spark, tmp_dir):
    from leadlens.streaming.score_stream import capture_stats, start_scoring_stream
    leads = lead_table(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "in")
    leads.repartition(3).write.parquet(src)
    stats = capture_stats(leads)
    start_scoring_stream(spark, src, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), stats).awaitTermination()
    got = spark.read.parquet(os.path.join(tmp_dir, "out")).select("lead_id", "probability_high")
    ref = frozen_scores(leads).select("lead_id", F.col("probability_high").alias("ref"))
    diff = got.join(ref, "lead_id").agg(F.max(F.abs(F.col("probability_high") - F.col("ref")))).first()[0]
    assert got.count() == leads.count() and diff < 1e-12


def test_stream_reads_csv_by_header(spark, tmp_dir):
    from leadlens.streaming.score_stream import capture_stats, lead_stream, start_scoring_stream
    stats = capture_stats(lead_table(spark, SF_SMALL))
    row = ["Large", "Tech", "54321.5", "30", "8", "5", "NaN", "Organic", "Europe", "2"]
    got = []
    for k, step in enumerate((1, -1)):                                       # the ten columns, in two orders
        src = os.path.join(tmp_dir, f"in{k}")
        os.makedirs(src)
        with open(f"{src}/x.csv", "w", newline="") as f:
            csv.writer(f).writerows([HEADER[::step], row[::step]])
        out = os.path.join(tmp_dir, f"out{k}")
        start_scoring_stream(spark, src, out, os.path.join(tmp_dir, f"ck{k}"), stats, fmt="csv").awaitTermination()
        got.append(spark.read.parquet(out).first().asDict())
    assert got[0] == got[1] and got[0]["industry"] == "Tech" and got[0]["annual_revenue"] == 54321.5
    assert got[0]["engagement_score"] is None and got[0]["probability_high"] is not None
    bad = os.path.join(tmp_dir, "bad")
    os.makedirs(bad)
    with open(f"{bad}/x.csv", "w") as f:
        f.write("Region,Industry\nAsia,Tech\n")
    with pytest.raises(ValueError):
        lead_stream(spark, bad, "csv")


def test_chunk_store_state_is_never_missing(spark, tmp_dir):
    scored = frozen_scores(lead_table(spark, SF_SMALL)).limit(20)
    base = os.path.join(tmp_dir, "store")
    chunk_store.build_context(scored, base)
    first = chunk_store.read_state(spark, base)
    os.makedirs(f"{base}/_state/7")                                          # a state that is still being written
    assert chunk_store.read_state(spark, base) == first
    os.makedirs(f"{base}/_state/8")
    open(f"{base}/_state/8/_SUCCESS", "w").close()                           # a broken store is not "no data"
    with pytest.raises(Exception):
        chunk_store.read_state(spark, base)


def test_aligned_features(spark):
    df = spark.createDataFrame([(1, "Large", "Tech", "Web", "Asia", *[1.0] * 6), (2, "Small", "Bank", "Mail", "Asia", *[3.0] * 6)],
                               "lead_id long, company_size string, industry string, lead_source string, region string, "
                               + ", ".join(f"{c} double" for c in S.NUMERIC))
    got = {r["lead_id"]: r["values"] for r in aligned_features(df, ["region_Mars", "industry_Tech", "ad_clicks", "company_size_Small"]).collect()}
    assert got == {1: [0.0, 1.0, -1.0, 0.0], 2: [0.0, 0.0, 1.0, 1.0]}


@pytest.mark.slow
def test_models_train_save_load(spark, tmp_dir):
    from leadlens.operators.models import ModelParams, compare_models, feature_importance, model_scores
    from leadlens.sources.model_store import load_model, model_versions, save_model
    from leadlens.streaming.score_stream import start_scoring_stream
    raw = label_leads(lead_table(spark, SF_SMALL))
    data = raw.withColumn("label", F.col("lead_score").cast("double"))       # NULLs stay
    params = ModelParams(rf_trees=5, rf_depth=4, gbt_rounds=2, gbt_depth=2, lr_max_iter=20)   # small settings for the test run
    table, best, model = compare_models(data, params, cv_folds=2)
    rows = table.collect()
    assert len(rows) == 5 and rows[0]["model"] == best
    assert all(0 <= r["f1"] <= 1 and 0 <= r["cv_f1"] <= 1 and r["cv_std"] >= 0 for r in rows)
    imp = feature_importance(model, data).collect()
    assert 0 < len(imp) <= 15
    path = os.path.join(tmp_dir, "model")
    save_model(spark, model, path, best, [r["feature"] for r in imp])
    loaded, name, _ = load_model(spark, path)
    some = raw.limit(4)
    leads = raw.unionByName(some).unionByName(some.withColumn("lead_id", F.lit(None).cast("long"))
                                              .withColumn("region", F.lit("Nowhere")).withColumn("annual_revenue", F.lit(float("nan"))))
    a, b = model_scores(model, leads), model_scores(loaded, leads)
    assert a.columns == with_rank_score(frozen_scores(raw)).drop("lead_rank_score").columns
    assert name == best and a.count() == raw.count() + 8
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    ranked = rank_leads(with_rank_score(b)).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, raw.count() + 9))
    assert all(abs(r["probability_low"] + r["probability_medium"] + r["probability_high"] - 1) < 1e-9 for r in ranked)
    src = os.path.join(tmp_dir, "in")
    raw.select(*S.LEAD_SCHEMA.names).write.parquet(src)
    start_scoring_stream(spark, src, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), loaded).awaitTermination()
    assert spark.read.parquet(os.path.join(tmp_dir, "out")).count() == raw.count()
    with pytest.raises(FileNotFoundError):
        load_model(spark, os.path.join(tmp_dir, "absent"))
    # a save that fails before its state is published changes nothing; the next one is version 2
    loaded.save(os.path.join(path, "v-unpublished"))
    assert model_versions(spark, path) == [1] and load_model(spark, path)[1] == best
    assert save_model(spark, loaded, path, "second", ["x"]) == 2
    assert load_model(spark, path)[1:] == ("second", ["x"]) and load_model(spark, path, 1)[1] == best
    with pytest.raises(FileNotFoundError):
        load_model(spark, path, 3)
