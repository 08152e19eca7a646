"""Distributed ordering helpers against one-partition windows and brute force."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadlens.operators.ordering import with_global_row_number, with_prefix_sums
from leadlens.operators.quantiles import exact_quantiles, quantile_row


def test_global_row_number_equals_window(spark):
    rnd = random.Random(7)
    data = [(i, rnd.choice([None, 1.0, 2.0, 2.0, 3.5, rnd.random()])) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, s double")
    order = [F.col("s").desc_nulls_last(), F.col("id").asc()]
    got = with_global_row_number(df, order, "rk", num_partitions=7).select("id", "rk")
    ref = df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rk"))
    assert sorted(got.collect()) == sorted(ref.collect())


def test_prefix_sums_exclusive(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "k long, v long")
    out = with_prefix_sums(df, [F.col("k")], {"before": "v"}, num_partitions=5).orderBy("k").collect()
    run = 0
    for r in out:
        assert r["before"] == run
        run += r["v"]


def test_quantiles_equal_numpy_to_the_last_bit(spark):
    rnd = random.Random(3)
    for n in (1, 2, 50, 2001):
        x = [rnd.choice([None, float("nan"), 7.25, rnd.random() * 100]) for _ in range(n)]
        y = [round(rnd.random() * 1e7, 2) for _ in range(n)]
        df = spark.createDataFrame(list(zip(x, y)), "x double, y double").repartition(5)
        spec = {f"{c}{p}": (c, p) for c in "xy" for p in (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)}
        got = quantile_row(df, spec).first().asDict()
        for name, (c, p) in spec.items():
            vals = [v for v in (x if c == "x" else y) if v is not None and v == v]
            assert got[name] == (float(np.quantile(vals, p)) if vals else None)


def test_quantile_between_equal_values_is_that_value(spark):
    df = spark.createDataFrame([(0.1,)] * 7 + [(0.3,)], "x double")
    assert exact_quantiles(df, "x", {"p33": 0.33, "p75": 0.75}).first() == (0.1, 0.1)


def test_quantile_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, "x", {"p50": 0.5}).first()["p50"] is None
