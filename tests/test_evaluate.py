"""Relational metrics against hand-computed and brute-force values."""

import itertools
import random

from leadlens.operators import evaluate as E


def _brute_auc(labels, scores, cls):
    pos = [s for l, s in zip(labels, scores) if l == cls]
    neg = [s for l, s in zip(labels, scores) if l != cls]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_matches_pairs(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 2), rnd.choice([0.1, 0.2, 0.2, 0.5, 0.9]), rnd.random(), rnd.random()) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, p0 double, p1 double, p2 double")
    got = {r["class"]: r["auc"] for r in E.ovr_auc(df, "label", {0: "p0", 1: "p1", 2: "p2"}).collect()}
    labels = [r[0] for r in rows]
    for cls, idx in ((0, 1), (1, 2), (2, 3)):
        assert abs(got[cls] - _brute_auc(labels, [r[idx] for r in rows], cls)) < 1e-6


def test_auc_null_when_one_class(spark):
    df = spark.createDataFrame([(0, 0.5, 0.3, 0.2)] * 5, "label int, p0 double, p1 double, p2 double")
    got = {r["class"]: r["auc"] for r in E.ovr_auc(df, "label", {0: "p0", 1: "p1", 2: "p2"}).collect()}
    assert got[0] is None and got[-1] is None


def test_report_and_summary(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 4 + [(2, 2)] * 3 + [(2, 0)] * 1
    df = spark.createDataFrame(pairs, "label int, prediction int")
    cm = {(r["label"], r["prediction"]): r["n"] for r in E.confusion_counts(df).collect()}
    assert len(cm) == 9 and sum(cm.values()) == len(pairs) and cm[(1, 0)] == 0
    s = E.summary_metrics(df).first()
    assert abs(s["accuracy"] - 12 / 15) < 1e-6
    assert abs(s["recall"] - s["accuracy"]) < 1e-6      # weighted recall equals accuracy
    rep = {r["row"]: r for r in E.classification_report(df, names={0: "Low", 1: "Medium", 2: "High"}).collect()}
    assert abs(rep["Low"]["precision"] - 5 / 6) < 1e-6 and rep["Medium"]["support"] == 4
    assert rep["weighted avg"]["support"] == 15
