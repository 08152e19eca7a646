"""Relational classification metrics over (label, prediction[, class probabilities]).

All metrics are aggregates of the confusion counts, so the data is read once with a
partially aggregated group-by; everything after that works on at most k x k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.operators.ordering import with_prefix_sums


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction",
                     classes: list[int] = (0, 1, 2)) -> DataFrame:
    """Dense k x k confusion matrix (label, prediction, n) including zero cells."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(label).cast("int").alias("label"),
                        F.col(pred).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    cells = spark.createDataFrame([(a, b) for a in classes for b in classes], "label int, prediction int")
    return (cells.join(counts, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def per_class_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                     classes: list[int] = (0, 1, 2)) -> DataFrame:
    """precision, recall, f1, support per class; 0 where undefined.

    The input is aggregated once to the cells that occur (k x k at most); each cell then counts
    for its label's row and its prediction's row, so no join reads the input again."""
    cells = df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    known = lambda c: F.col(c).isin(list(classes))
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)
    part = lambda c, support, tp, n_pred: F.struct(c.alias("class"), support.alias("support"), tp.alias("tp"), n_pred.alias("n_pred"))
    sides = F.array(part(F.col("label"), n, hit, zero), part(F.col("prediction"), zero, zero, n))
    every = F.array(*[part(F.lit(c), zero, zero, zero) for c in classes])
    rows = cells.where(known("label") & known("prediction")).select(F.explode(sides).alias("r"))
    none = df.sparkSession.range(1).select(F.explode(every).alias("r"))   # classes that do not occur
    rep = rows.union(none).select("r.*").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "n_pred")])
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    rep = rep.select("class", prec.alias("precision"), rec.alias("recall"), F.col("support").cast("bigint").alias("support"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    return rep.withColumn("f1", f1)


def _rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                          classes: list[int] = (0, 1, 2), names: dict[int, str] | None = None) -> DataFrame:
    """Per-class rows + 'macro avg' + 'weighted avg' (row, precision, recall, f1, support): one
    aggregate of the per-class rows, exploded."""
    rep = per_class_report(df, label, pred, classes)
    names = names or {c: str(c) for c in classes}
    cols = ("precision", "recall", "f1")

    def of(c: int):
        one = lambda k: F.max(F.when(F.col("class") == c, F.col(k)))
        return F.struct(F.lit(names[c]).alias("row"), *[one(k).alias(k) for k in cols], one("support").alias("support"))

    total = F.sum("support").cast("bigint").alias("support")
    macro = F.struct(F.lit("macro avg").alias("row"), *[F.avg(k).alias(k) for k in cols], total)
    weighted = F.struct(F.lit("weighted avg").alias("row"),
                        *[(F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(k) for k in cols], total)
    out = rep.agg(F.array(*[of(c) for c in classes], macro, weighted).alias("rows")).select(F.inline("rows"))
    return out.select("row", *[F.round(c, 6).alias(c) for c in cols], "support")


def summary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                    classes: list[int] = (0, 1, 2), digits: int | None = 6) -> DataFrame:
    """One row: n, accuracy, weighted precision / recall / f1 (``digits`` None: not rounded)."""
    rep = per_class_report(df, label, pred, classes)
    wavg = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    acc = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return rep.agg(F.sum("support").cast("bigint").alias("n"), _rounded(acc, digits).alias("accuracy"),
                   _rounded(wavg("precision"), digits).alias("precision"),
                   _rounded(wavg("recall"), digits).alias("recall"), _rounded(wavg("f1"), digits).alias("f1"))


def ovr_auc(df: DataFrame, label: str, score_cols: dict[int, str], digits: int | None = 6) -> DataFrame:
    """One-vs-rest ROC AUC per class with mid-ranks for ties (Mann-Whitney U), plus the
    support-weighted average. Rows: (class, auc, support); class -1 is the weighted average.
    AUC is NULL for a class without positives or negatives.

    Scores are first reduced to distinct values with positive/negative counts (partial
    aggregation); the negatives below each score come from distributed prefix sums, so no
    window ever holds all rows in one task.
    """
    each = F.array(*[F.struct(F.lit(cls).alias("class"), F.col(col).cast("double").alias("s"),
                              (F.col(label).cast("int") == cls).cast("int").alias("pos")) for cls, col in score_cols.items()])
    long = df.select(F.inline(each))   # one pass over the input for all classes
    d = (long.where(F.col("s").isNotNull()).groupBy("class", "s")
         .agg(F.sum("pos").alias("npos"), F.sum(F.lit(1) - F.col("pos")).alias("nneg")))
    # one distributed prefix sum over (class, score); each class' start is removed with the
    # per-class totals (one row per class)
    d = with_prefix_sums(d, [F.col("class").asc(), F.col("s").asc()], {"neg_before": "nneg"})
    starts = d.groupBy("class").agg(F.min("neg_before").alias("class_start"))
    d = d.join(F.broadcast(starts), "class").withColumn("neg_below", F.col("neg_before") - F.col("class_start"))
    u = d.groupBy("class").agg(F.sum(F.col("npos") * (F.col("neg_below") + F.col("nneg") / F.lit(2.0))).alias("u"),
                               F.sum("npos").alias("p"), F.sum("nneg").alias("q"))
    classes = df.sparkSession.createDataFrame([(c,) for c in score_cols], "class int")
    per = classes.join(u, "class", "left").select(
        "class", F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).alias("auc"),
        F.coalesce(F.col("p"), F.lit(0)).cast("bigint").alias("support"))
    weighted = per.agg(F.lit(-1).alias("class"),
                       F.when(F.count_if(F.col("auc").isNull()) == 0,
                              F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"),
                       F.sum("support").cast("bigint").alias("support"))
    out = per.unionByName(weighted)
    return out.select("class", _rounded(F.col("auc"), digits).alias("auc"), "support")
