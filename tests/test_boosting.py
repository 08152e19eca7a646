"""Boosted trees: the same trees as Spark's GBTClassifier, in a number of jobs that does not grow with the models."""

import os

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from leadlens import schema as S
from leadlens.operators import boosting as B
from leadlens.operators.boosting import Boosting, BoostedModel, fit_boosted, numeric_cuts
from leadlens.operators.models import ModelParams, compare_models, fit_features, learners

SETTINGS = {"A": {}, "B": {"rate": 0.8}, "C": {"bins": 64, "onehot": False}}
SPARK = {"A": {}, "B": {"subsamplingRate": 0.8}, "C": {"maxBins": 64}}


def _leads(spark, n=400):
    rng = np.random.default_rng(5)
    kinds = {"company_size": ["Small", "Medium", "Large"], "industry": ["Tech", "Bank", "Shop", "Farm"], "lead_source": ["Web", "Mail"], "region": ["Asia", "Europe"]}
    rows = []
    for i in range(n):
        cats, nums = [str(rng.choice(kinds[c])) for c in S.CATEGORICAL], [float(x) for x in np.round(rng.gamma(2.0, 10.0, len(S.NUMERIC)), 2)]
        points = nums[0] + 12 * (cats[0] == "Large") + 6 * (cats[1] in ("Tech", "Farm")) + rng.normal(0, 6)
        rows.append((i, *cats, *nums, float(points > 20) + float(points > 32)))
    return spark.createDataFrame(rows, ", ".join(["lead_id long", *[f"{c} string" for c in S.CATEGORICAL], *[f"{c} double" for c in S.NUMERIC], "label double"]))


def _vectors(leads, partitions):
    return fit_features(leads).transform(leads).select("lead_id", "label", "features", "features_idx").repartition(partitions, "lead_id").cache()


def _raw(model, v):
    return np.array([r[0] for r in model.transform(v).orderBy("lead_id").select(vector_to_array("rawPrediction")).collect()])


@pytest.mark.parametrize("partitions", [1, 3])
def test_same_margins_as_spark_boosting(spark, partitions):
    """Small depth: in large nodes no two splits part the rows alike. In C two columns do in one small node, with the same
    margins; rounding decides which of them has the gain."""
    v = _vectors(_leads(spark), partitions)
    v.count()
    got = fit_boosted([v], {k: Boosting(rounds=3, depth=3, **kw) for k, kw in SETTINGS.items()})
    for name, kw in SPARK.items():
        spark_gbt = OneVsRest(classifier=GBTClassifier(maxIter=3, maxDepth=3, stepSize=0.1, seed=42, **kw))
        want = spark_gbt.setFeaturesCol("features" if name != "C" else "features_idx").fit(v)
        a, b = _raw(want, v), _raw(got[0, name], v)
        assert np.abs(a - b).max() < 1e-9, name
        imp = sum(m.featureImportances.toArray() for m in want.models) / 3
        assert np.abs(imp - got[0, name].featureImportances.toArray()).max() < (0.05 if name == "C" else 1e-9), name
    v.unpersist()


def test_thresholds_are_spread_over_all_rows(spark):
    """More distinct values than bins, one value with a third of the rows: thresholds at equal counts, found from positions."""
    x = np.concatenate([np.arange(1000) / 7.0, np.full(500, 30.0)])
    v = spark.createDataFrame([(float(a), float(a > 40), 1.0) for a in x], "a double, b double, c double")
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features_idx").transform(v).repartition(3)
    cuts = numeric_cuts([v], 3, [8, 32], [len(x)])
    values, counts = np.unique(x, return_counts=True)
    for bins in (8, 32):     # Spark's walk over the distinct values
        stride, upto, want = len(x) / bins, counts[0], []
        target = stride
        for i in range(1, len(values)):
            before, upto = upto, upto + counts[i]
            if abs(before - target) < abs(upto - target):
                want.append((values[i - 1] + values[i]) / 2)
                target += stride
        assert np.array_equal(cuts[0, bins][0], want)
        assert cuts[0, bins][1].tolist() == [0.5] and cuts[0, bins][2].tolist() == []


def test_jobs_do_not_grow_with_the_models(spark):
    """Nine boosting models a training part grow in the same jobs: rounds x depth and a fixed number besides."""
    leads, jobs = _leads(spark, 150).cache(), {}
    p = ModelParams(gbt_rounds=12, gbt_depth=2)
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    for folds in (0, 3):
        sc.setJobGroup(f"boost-{folds}", "boost")
        table, best, model = compare_models(leads, p, cv_folds=folds, models=["Gradient Boosting A", "Gradient Boosting B", "Gradient Boosting C"])
        jobs[folds] = len(tracker.getJobIdsForGroup(f"boost-{folds}"))
    sc.setJobGroup("rest", "rest")
    assert table.count() == 3
    # 27 more models with 12 rounds of two levels each would be 648 more
    assert jobs[3] - jobs[0] < 400, jobs


def test_whole_models_grow_in_a_task(spark, monkeypatch):
    """Up to WHOLE_ROWS rows the jobs do not grow with the rounds; the trees are those of the distributed rounds, also
    where rows are passed in pieces and columns counted together."""
    v = _vectors(_leads(spark), 1)
    v.count()
    sc, tracker, jobs, raw = spark.sparkContext, spark.sparkContext.statusTracker(), {}, {}
    specs = lambda rounds: {k: Boosting(rounds=rounds, depth=3, **kw) for k, kw in SETTINGS.items()}
    for rounds in (3, 20):
        sc.setJobGroup(f"whole-{rounds}", "whole")
        models = fit_boosted([v], specs(rounds))
        jobs[rounds] = len(tracker.getJobIdsForGroup(f"whole-{rounds}"))
        raw[rounds] = {k: _raw(models[0, k], v) for k in SETTINGS}
    sc.setJobGroup("rest", "rest")
    assert jobs[3] == jobs[20], jobs
    monkeypatch.setattr(B, "WHOLE_ROWS", 0)
    spread = fit_boosted([v], specs(3))
    assert all(np.array_equal(_raw(spread[0, k], v), raw[3][k]) for k in SETTINGS)
    monkeypatch.setattr(B, "WHOLE_ROWS", 1000)
    binned, sizes, slots = np.asfortranarray(np.random.default_rng(1).integers(0, 5, (700, 4)).astype(np.uint8)), [5, 5, 5, 5], [4, 5]
    y = np.where(binned[:, 0] + 2 * (binned[:, 2] == 3) + np.random.default_rng(2).random(700) > 3, 1, -1).astype(np.int8)
    drawn = np.random.default_rng(3).integers(0, 1 << 50, (700, 1))
    for spec in (Boosting(rounds=4, depth=3), Boosting(rounds=4, depth=3, rate=0.8), Boosting(rounds=4, depth=4, onehot=False)):
        monkeypatch.setattr(B, "_PASS", 1 << 16)
        one = B.grow(binned, drawn, y, spec, 2, sizes, slots)
        monkeypatch.setattr(B, "_PASS", 90)
        monkeypatch.setattr(B, "_CELL_ROWS", 1)
        assert [len(g) for g in B._together(sizes, 700)] == [4] and len(one) == 4
        for a, b in zip(one, B.grow(binned, drawn, y, spec, 2, sizes, slots), strict=True):
            assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and np.allclose(a[2], b[2], atol=1e-9)
    v.unpersist()


def test_forest_keeps_the_nodes_of_its_rows(spark):
    """The same trees, without the way from the root at every level."""
    v = _vectors(_leads(spark), 2)
    forest = learners(ModelParams(rf_trees=7, rf_depth=6), 400)["Random Forest"][0]
    assert forest.getCacheNodeIds()
    trees = [m.fit(v).toDebugString.split("\n", 1)[1] for m in (forest, forest.copy().setCacheNodeIds(False))]
    assert trees[0] == trees[1]
    v.unpersist()


def test_save_and_load(spark, tmp_dir):
    leads = _leads(spark, 120)
    v = _vectors(leads, 1)
    for name, kw in SETTINGS.items():
        model = fit_boosted([v], {name: Boosting(rounds=2, depth=3, **kw)})[0, name]
        path = os.path.join(tmp_dir, name)
        model.save(path)
        loaded = BoostedModel.load(path)
        assert loaded.uid == model.uid and loaded.getFeaturesCol() == model.getFeaturesCol()
        assert np.array_equal(_raw(model, v), _raw(loaded, v))
        assert np.array_equal(model.featureImportances.toArray(), loaded.featureImportances.toArray())
    v.unpersist()


def test_one_class_and_no_rows_to_part(spark):
    """A class without rows, and columns with one value: every tree is a leaf."""
    leads = _leads(spark, 30).withColumn("label", F.lit(0.0)).withColumn(S.NUMERIC[0], F.lit(1.0))
    v = _vectors(leads, 1)
    model = fit_boosted([v], {"A": Boosting(rounds=2, depth=2)})[0, "A"]
    raw = _raw(model, v)
    assert (raw[:, 0] > 1).all() and (raw[:, 1:] < -1).all()
    v.unpersist()
