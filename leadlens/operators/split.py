"""Stratified holdout split and stratified K folds.

A window partitioned by class would put a whole class (possibly a third of the rows) in
one task. Instead rows get a global position in (class, shuffle key, id) order from the
distributed row numbering; a class' first position comes from the per-class counts (one
row per class). Shuffle key: ``(id * 7919) % 1000003``, reproducible in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.operators.ordering import with_global_row_number

SHUFFLE_MUL, SHUFFLE_MOD = 7919, 1000003
#: Moves the classes' test ranges apart in ``hash_split``.
CLASS_STEP = 104729


def shuffle_key(id_col: Column) -> Column:
    return (id_col * SHUFFLE_MUL) % SHUFFLE_MOD


def stratified_positions(df: DataFrame, label: str, key: str) -> DataFrame:
    """Adds ``class_pos`` (1-based rank inside its class) and ``class_n`` (class size)."""
    ordered = with_global_row_number(
        df.withColumn("__sk", shuffle_key(F.col(key))),
        [F.col(label).asc(), F.col("__sk").asc(), F.col(key).asc()], "__gpos")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))
    before = F.coalesce(F.sum("class_n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    starts = counts.select(label, "class_n", before.alias("__start"))     # one row per class
    return (ordered.join(F.broadcast(starts), label)
            .withColumn("class_pos", F.col("__gpos") - F.col("__start"))
            .drop("__gpos", "__start", "__sk"))


def _split(df: DataFrame, label: str, key: str, test_fraction: float) -> DataFrame:
    pos = stratified_positions(df, label, key)
    n_test = F.round(F.col("class_n") * F.lit(float(test_fraction))).cast("bigint")
    return (pos.withColumn("split", F.when(F.col("class_pos") <= n_test, "test").otherwise("train"))
            .withColumn("__n_test", n_test))


def stratified_split(df: DataFrame, label: str = "label", key: str = "lead_id",
                     test_fraction: float = 0.2) -> DataFrame:
    """Adds ``split``: 'test' for the first round(test_fraction * class size) rows of each class
    in shuffle order, else 'train'."""
    return _split(df, label, key, test_fraction).drop("__n_test")


def stratified_folds(df: DataFrame, label: str = "label", key: str = "lead_id", k: int = 5,
                     test_fraction: float = 0.2, keep_test: bool = False) -> DataFrame:
    """Training rows of the split with ``fold`` in 0..k-1, dealt round-robin in shuffle order
    inside each class, so every fold keeps the class ratios within one row. ``keep_test``: also
    the test rows, with a NULL fold."""
    sp = _split(df, label, key, test_fraction)
    train = F.col("split") == "train"
    fold = F.when(train, ((F.col("class_pos") - F.col("__n_test") - 1) % k).cast("int"))
    return (sp if keep_test else sp.where(train)).withColumn("fold", fold).drop("__n_test")


def hash_split(df: DataFrame, label: str = "label", key: str = "lead_id", test_fraction: float = 0.2,
               by_class: dict[int, float] | None = None) -> DataFrame:
    """Adds ``split`` by the row's own shuffle key and class alone: 'test' below the class's share
    of the key range (``by_class``; else ``test_fraction``). Nothing is numbered, counted or
    shuffled, and rows that come later move no earlier row to the other side. Class shares hold in
    expectation; ``stratified_split`` gives them exactly."""
    share = F.lit(float(test_fraction))
    for cls, fraction in (by_class or {}).items():
        share = F.when(F.col(label) == cls, F.lit(float(fraction))).otherwise(share)
    place = F.pmod(shuffle_key(F.col(key)) + F.coalesce(F.col(label).cast("bigint"), F.lit(0)) * CLASS_STEP, F.lit(SHUFFLE_MOD))
    return df.withColumn("split", F.when(place < share * F.lit(SHUFFLE_MOD), "test").otherwise("train"))
