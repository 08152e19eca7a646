"""Folders of uploads, growing stores, states that merge."""

import math
import os

import pytest
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.operators import hashed, merged
from leadlens.operators.ordering import with_prefix_sums
from leadlens.operators.rollups import abm_dashboard
from leadlens.operators.split import hash_split
from leadlens.sources import chat_log, chunk_increment
from leadlens.sources.intake import csv_files, read_folder
from leadlens.sources.leads_csv import read_leads

HEADER = "lead_id,company_size,industry,annual_revenue,website_visits,email_opens,ad_clicks,engagement_score,lead_source,region,previous_purchases"
ROWS = [f"{i},Large,Tech,{1000.5 * i},{i},2,3,{10 + i},Organic,ASIA,1" for i in range(1, 7)]


def put(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_mixed_headers_equal_one_file(spark, tmp_dir):
    put(f"{tmp_dir}/one", "all.csv", HEADER, *ROWS)
    order = [10, 0, 3, 1, 2, 4, 5, 6, 7, 8, 9]
    turned = lambda line: ",".join(line.split(",")[i] for i in order)
    put(f"{tmp_dir}/many", "a.csv", HEADER, *ROWS[:2])
    put(f"{tmp_dir}/many/deeper", "b.csv", turned(HEADER).replace("_", " ").title(), *map(turned, ROWS[2:4]))
    put(f"{tmp_dir}/many", "c.csv", HEADER + ",Sales Note", *[r + ",hello" for r in ROWS[4:]])
    put(f"{tmp_dir}/many", "_SUCCESS")
    put(f"{tmp_dir}/many", "empty.csv")
    good, bad = read_folder(spark, f"{tmp_dir}/many")
    want = sorted(map(tuple, read_leads(spark, f"{tmp_dir}/one").select(*S.LEAD_SCHEMA.names).collect()))
    assert sorted(map(tuple, good.select(*S.LEAD_SCHEMA.names).collect())) == want and bad.count() == 0
    assert sorted((r.lead_id, r.sales_note) for r in good.collect()) == [(i, "hello" if i > 4 else None) for i in range(1, 7)]
    assert len(csv_files(spark, f"{tmp_dir}/many")) == 4


def test_bad_records_are_set_apart_with_reasons(spark, tmp_dir):
    put(tmp_dir, "x.csv", HEADER, ROWS[0], ROWS[1].replace("2001.0", "lots"), ROWS[2] + ",extra", "4,Small", ROWS[4].replace(",5,", ",5.5,"),
        "6,,,,,,,,,,", ROWS[5].replace("6003.0", "NaN").replace("6,Large", "7,Large"))
    good, bad = read_folder(spark, tmp_dir)
    assert sorted(r.lead_id for r in good.collect()) == [1, 6, 7]           # empty cells are NULL, not faults
    assert good.where("lead_id = 7").first().annual_revenue is None
    reasons = {r.lead_id: r.reasons for r in bad.collect()}
    assert reasons == {"2": ["annual_revenue: lots"], "3": ["wrong number of cells"], "4": ["wrong number of cells"], "5": ["website_visits: 5.5"]}
    assert {r.file.rsplit("/", 1)[1] for r in bad.collect()} == {"x.csv"}
    assert bad.where("lead_id = '3'").first().record == ROWS[2] + ",extra"


def test_folder_without_required_columns_or_files(spark, tmp_dir):
    with pytest.raises(ValueError, match="no files"):
        os.makedirs(f"{tmp_dir}/none")
        read_folder(spark, f"{tmp_dir}/none")
    put(f"{tmp_dir}/few", "x.csv", "lead_id,industry", "1,Tech")
    with pytest.raises(ValueError, match="Missing required columns"):
        read_folder(spark, f"{tmp_dir}/few")
    put(f"{tmp_dir}/twice", "x.csv", "Lead ID,lead_id", "1,2")
    with pytest.raises(ValueError, match="one name"):
        read_folder(spark, f"{tmp_dir}/twice")


def test_chat_log_takes_a_batch_once(spark, tmp_dir):
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "hi")], "conv_id long, turn long, role string, text string")
    base = f"{tmp_dir}/log"
    assert chat_log.read(spark, base) is None
    assert chat_log.append(turns, base, "a") and not chat_log.append(turns, base, "a")
    # a run that failed before its commit leaves files that nobody reads
    turns.write.parquet(f"{base}/turns-lost")
    assert chat_log.append(turns.limit(1).withColumn("contexts_used", F.lit(5)), base, "b/with odd ' name")
    got = sorted((r.batch, r.turn, r.contexts_used) for r in chat_log.read(spark, base).collect())
    assert got == [("a", 0, None), ("a", 1, None), ("b/with odd ' name", 0, 5)]


def scored(spark, n=200):
    return spark.createDataFrame([
        (i, "Large", "Tech" if i % 3 else "Retail", None if i % 7 == 0 else float(i), i, 1, 1, float(i % 100), "Organic", "ASIA" if i % 2 else None, 1,
         ("High", "Medium", "Low")[i % 3], 0.5, 0.9) for i in range(n)],
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.LEAD_SCHEMA.fields) + ", predicted_lead_score string, confidence double, probability_high double")


def test_increment_equals_a_build_from_nothing(spark, tmp_dir):
    a, b = f"{tmp_dir}/a", f"{tmp_dir}/b"
    first = scored(spark)
    assert chunk_increment.read(spark, a) is None
    assert chunk_increment.build(first, a, 8) == {"kept": 0, "rewritten": 0, "added": 8, "removed": 0}
    before = {r.bucket: r.folder for r in chunk_increment.manifest(spark, a).collect()}
    assert chunk_increment.build(first.repartition(5), a, 8) == {"kept": 8, "rewritten": 0, "added": 0, "removed": 0}
    second = first.where("lead_id % 8 <> 6").withColumn("ad_clicks", F.when(F.col("lead_id") == 11, 99).otherwise(F.col("ad_clicks")).cast("long"))
    assert chunk_increment.build(second, a, 8) == {"kept": 6, "rewritten": 1, "added": 0, "removed": 1}
    after = {r.bucket: r.folder for r in chunk_increment.manifest(spark, a).collect()}
    assert {k for k in after if after[k] == before.get(k)} == {0, 1, 2, 4, 5, 7} and 6 not in after
    chunk_increment.build(second, b, 8)
    rows = lambda base: sorted(map(str, chunk_increment.read(spark, base).collect()))
    assert rows(a) == rows(b) and len(rows(a)) > 175
    # a build that fails before its manifest changes nothing for readers
    spark.range(1).write.parquet(f"{a}/_manifest/9/part")
    assert rows(a) == rows(b)


def test_hash_split_stays_put_as_the_table_grows(spark):
    rows = spark.range(20_000).select(F.col("id").alias("lead_id"), (F.col("id") % 3).cast("int").alias("label"))
    some, all_ = hash_split(rows.where("lead_id < 5000")), hash_split(rows)
    moved = some.join(all_.withColumnRenamed("split", "later"), "lead_id").where("split <> later")
    assert moved.count() == 0
    shares = {r.label: r.share for r in hash_split(rows, by_class={2: 0.5}).groupBy("label").agg(F.avg((F.col("split") == "test").cast("int")).alias("share")).collect()}
    assert all(abs(shares[c] - want) < 0.02 for c, want in {0: 0.2, 1: 0.2, 2: 0.5}.items())
    assert "Exchange" not in all_._jdf.queryExecution().executedPlan().toString()


def test_loaded_embedder_equals_the_fitted_one(spark, tmp_dir):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "Beta gamma!"), (3, None), (4, "")], "id long, text string")
    model = hashed.fit_embedder(docs, places=64)
    hashed.save_embedder(model, f"{tmp_dir}/m")
    later = spark.createDataFrame([(9, "gamma alpha unseen")], "id long, text string")
    for df in (docs, later):
        one, two = (sorted(map(str, hashed.embed(m, df, ["id"]).collect())) for m in (model, hashed.load_embedder(f"{tmp_dir}/m")))
        assert one == two
    norms = {r.id: math.sqrt(sum(x * x for x in r.embedding)) for r in hashed.embed(model, docs, ["id"]).collect()}
    assert abs(norms[1] - 1) < 1e-12 and norms[3] == norms[4] == 0


def test_merged_states_equal_one_pass(spark):
    table = scored(spark, 500)
    parts = [table.where(F.col("lead_id") % 4 == i) for i in range(4)] + [table.where("false")]
    states = None
    for i, p in enumerate(parts):
        s = merged.dashboard_state(p, str(i))
        states = s if states is None else states.unionByName(s)
    assert merged.merged_dashboard(states).first() == abm_dashboard(table).first()
    states = None
    for i, p in enumerate(parts):
        s = merged.quantile_state(p, ["annual_revenue"], str(i))
        states = s if states is None else states.unionByName(s)
    r = merged.merged_quantiles(states, [0.5]).first()
    values = sorted(float(i) for i in range(500) if i % 7)
    assert r.n == len(values) and abs(sum(v <= r.quantiles[0] for v in values) / len(values) - 0.5) <= 0.015


def test_prefix_sums_need_no_exchange_after_the_sort(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("x"))
    out = with_prefix_sums(df.repartition(6), [F.col("id").asc()], {"before_k": "k", "before_x": "x"}, 4)
    assert "hashpartitioning(__pid" not in out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    k = x = 0
    for r in out.orderBy("id").collect():
        assert r.before_k == k and abs(r.before_x - x) < 1e-9
        k, x = k + r.k, x + (r.x or 0)
