"""Classifier training, comparison and feature importance with ``pyspark.ml``.

Features: 6 numerics imputed with the training part's median and standardised with its mean and
*population* std, 4 categoricals imputed with its mode (all persisted as a SQLTransformer with
literals), indexed alphabetically with an extra slot for unseen values and one-hot encoded with
that slot dropped (so an unseen category is the zero vector). A fitted package therefore scores
raw leads (``model_scores``). Five learners, one cached feature table:
multinomial logistic regression, random forest, and three gradient-boosting
configurations (Spark's GBT learner is binary only, so each runs one-vs-rest, in
``boosting``; probabilities are sigmoid(2 * margin) per class, normalised).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from leadlens import schema as S
from leadlens.operators import evaluate as E
from leadlens.operators.boosting import Boosting, fit_boosted
from leadlens.operators.ordering import materialize
from leadlens.operators.scoring import scorer_statistics, with_predictions
from leadlens.operators.split import stratified_folds

MODEL_ORDER = ["Logistic Regression", "Random Forest", "Gradient Boosting A", "Gradient Boosting B",
               "Gradient Boosting C"]


@dataclass
class ModelParams:
    """Learner settings of the surveyed training script (100 trees/rounds, depth 10/6, lr 0.1)."""
    lr_max_iter: int = 1000
    rf_trees: int = 100
    rf_depth: int = 10
    gbt_rounds: int = 100
    gbt_depth: int = 6
    gbt_step: float = 0.1
    seed: int = 42
    fit_parallelism: int = 8


def preparer(train: DataFrame) -> SQLTransformer:
    """Imputation and scaling learned from the training rows, kept in the pipeline as literals:
    z_<col> = (x - mean) / population std of the numerics with the median for NULL and NaN (1 for
    a constant column), x_<col> = the categorical with the mode ('Unknown' without one)."""
    clean = train.select(*S.CATEGORICAL, *[_number(c).alias(c) for c in S.NUMERIC])
    st = scorer_statistics(clean).first()
    exprs = []
    for c in S.NUMERIC:
        med, m, s = st["m"][c], st["mean"][c] or 0.0, st["sd"][c] or 0.0
        x = f"CAST({c} AS DOUBLE)"
        x = f"COALESCE(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, {0.0 if med is None else med!r}D)"
        exprs.append(f"({x} - ({m!r}D)) / ({(s if s else 1.0)!r}D) AS z_{c}")
    for c in S.CATEGORICAL:
        mode = (st["c"][c] or "Unknown").replace("\\", "\\\\").replace("'", "\\'")
        exprs.append(f"COALESCE({c}, '{mode}') AS x_{c}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def _number(c: str):
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def encoding_stages() -> list:
    """Category indices and one-hot vectors of the imputed categoricals."""
    idx = [StringIndexer(inputCol=f"x_{c}", outputCol=f"{c}_idx", stringOrderType="alphabetAsc", handleInvalid="keep")
           for c in S.CATEGORICAL]
    enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in S.CATEGORICAL], outputCols=[f"{c}_vec" for c in S.CATEGORICAL],
                        dropLast=True, handleInvalid="keep")
    return idx + [enc]


def assembler(onehot: bool = True) -> VectorAssembler:
    """Scaled numerics and the categoricals as one-hot vectors or as indices."""
    cats = [f"{c}_vec" for c in S.CATEGORICAL] if onehot else [f"{c}_idx" for c in S.CATEGORICAL]
    return VectorAssembler(inputCols=[f"z_{c}" for c in S.NUMERIC] + cats, outputCol="features")


def learners(p: ModelParams, n_train: int) -> dict[str, tuple[object, bool]]:
    """name -> (estimator, uses one-hot features)."""
    gbt = lambda **kw: Boosting(rounds=p.gbt_rounds, depth=p.gbt_depth, step=p.gbt_step, seed=p.seed, **kw)
    return {
        # sklearn's C=1 L2 penalty on a summed loss equals regParam = 1/n on Spark's mean loss
        "Logistic Regression": (LogisticRegression(family="multinomial", maxIter=p.lr_max_iter,
                                                   regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                                   standardization=False), True),
        # the same trees; a row's node in every tree is kept from level to level, not found again from the root
        "Random Forest": (RandomForestClassifier(numTrees=p.rf_trees, maxDepth=p.rf_depth, seed=p.seed, cacheNodeIds=True,
                                                 checkpointInterval=-1), True),
        "Gradient Boosting A": (gbt(), True),
        "Gradient Boosting B": (gbt(rate=0.8), True),
        "Gradient Boosting C": (gbt(bins=64, onehot=False), False),
    }


def fit_features(train: DataFrame) -> PipelineModel:
    """The stages before a learner, fitted once: imputation, scaling, encoding and both vectors
    (``features``: one-hot, ``features_idx``: category indices)."""
    return Pipeline(stages=[preparer(train), *encoding_stages(), assembler(True),
                            assembler(False).setOutputCol("features_idx")]).fit(train)


def fit_pipeline(train: DataFrame, estimator, onehot: bool) -> PipelineModel:
    """Feature stages and learner on raw leads with ``label``: a package that scores raw leads."""
    features = fit_features(train)
    vectors = features.transform(train).select("label", "features", "features_idx")
    vectors = vectors.repartition(_vector_partitions(train.sparkSession, train)).cache()
    try:
        return _package(features, _fit(vectors, estimator, onehot))
    finally:
        vectors.unpersist()


def _fit(vectors: DataFrame, estimator, onehot: bool):
    if isinstance(estimator, Boosting):
        return fit_boosted([vectors], {"": estimator})[0, ""]
    return estimator.copy().setFeaturesCol("features" if onehot else "features_idx").fit(vectors)


def _package(features: PipelineModel, learner) -> PipelineModel:
    return PipelineModel(stages=[*features.stages, learner])


def _probabilities(df: DataFrame) -> list:
    if "probability" in df.columns:
        arr = vector_to_array("probability")
        return [arr[i] for i in range(3)]
    # one-vs-rest GBT: margins -> sigmoid(2m), normalised
    raw = vector_to_array("rawPrediction")
    sig = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * raw[i])) for i in range(3)]
    return [s / (sig[0] + sig[1] + sig[2]) for s in sig]


def model_scores(model: PipelineModel, leads: DataFrame) -> DataFrame:
    """Raw leads scored by a trained package: the columns of ``leads`` and of the frozen scorer
    (probabilities, predicted_index, predicted_lead_score, confidence), one row out per row in.
    NULLs take the training part's median or mode, unseen categories the zero vector."""
    out = model.transform(leads)
    return with_predictions(out, leads.columns, _probabilities(out))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds p0, p1, p2 and prediction (argmax, ties to the lower class)."""
    out = model_scores(model, df)
    return out.select(*df.columns, F.col("probability_low").alias("p0"), F.col("probability_medium").alias("p1"),
                      F.col("probability_high").alias("p2"), F.col("predicted_index").alias("prediction"))


def _metrics(pred: DataFrame) -> dict:
    """Unrounded holdout metrics of (label, prediction, p0, p1, p2)."""
    row = E.summary_metrics(pred, "label", "prediction", digits=None).first()
    auc = E.ovr_auc(pred, "label", {0: "p0", 1: "p1", 2: "p2"}, digits=None).where(F.col("class") == -1).first()
    return {"accuracy": row["accuracy"], "precision": row["precision"], "recall": row["recall"],
            "f1": row["f1"], "roc_auc": auc["auc"] if auc else None}


def _f1(scored: DataFrame) -> float:
    return E.summary_metrics(scored, "label", "prediction", digits=None).first()["f1"] or 0.0


def compare_models(data: DataFrame, params: ModelParams | None = None, cv_folds: int = 5,
                   models: list[str] | None = None):
    """Train every learner on the stratified 80 % part, evaluate on the 20 % holdout, and
    (cv_folds > 1) cross-validate weighted F1 on the training part.

    ``data``: raw lead rows with ``label``. Feature stages are fitted once per training part (in
    cross-validation on the fold's own training rows only) and their vectors cached, so the
    learners share them. Returns (comparison DataFrame sorted by F1 descending, best model name,
    best PipelineModel). Best = highest unrounded holdout F1, strictly greater wins, so the first
    listed model wins ties."""
    spark = data.sparkSession
    params = params or ModelParams()
    names = list(models or MODEL_ORDER)
    pos = materialize(stratified_folds(data, "label", "lead_id", max(cv_folds, 1), keep_test=True))
    cached = []

    def vectors(features: PipelineModel, part: DataFrame) -> DataFrame:
        # a few thousand vectors do not need a task per core of every small boosting job
        v = features.transform(part).select("label", "features", "features_idx")
        v = v.repartition(_vector_partitions(spark, part)).cache()
        cached.append(v)
        return v

    def prepare(train: DataFrame, held: DataFrame):
        features = fit_features(train)
        v, w = vectors(features, train), vectors(features, held)
        return features, v, w, v.count()

    boosted = {name: est for name, (est, _) in learners(params, 0).items() if name in names and isinstance(est, Boosting)}

    def boost():
        return fit_boosted([v for _, v, _, _ in sets], boosted) if boosted else {}

    def run(name, k):
        features, v, w, n = sets[k]
        learner = boosting.result()[k, name] if name in boosted else _fit(v, *learners(params, n)[name])
        out = learner.transform(w)
        scored = with_predictions(out, ["label"], _probabilities(out))
        return features, learner, scored.select("label", F.col("predicted_index").alias("prediction"), F.col("probability_low").alias("p0"),
                                                F.col("probability_medium").alias("p1"), F.col("probability_high").alias("p2")).cache()

    train = pos.where(F.col("split") == "train")
    pairs = [(train, pos.where(F.col("split") == "test"))]
    for k in range(cv_folds if cv_folds > 1 else 0):
        pairs.append((train.where(F.col("fold") != k), train.where(F.col("fold") == k)))

    # fits run concurrently (as CrossValidator's ``parallelism``): each is a sequence of small
    # distributed jobs, and the scheduler interleaves the sequences. All boosting models grow in the
    # same jobs, and what waits for them comes last
    tasks = [(name, k) for late in (False, True) for k in range(len(pairs)) for name in names if (name in boosted) == late]

    def evaluated(task):
        name, k = task
        features, learner, scored = run(name, k)
        try:
            return (_package(features, learner), _metrics(scored)) if k == 0 else (None, _f1(scored))
        finally:
            scored.unpersist()

    own = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=max(1, params.fit_parallelism)) as pool, ThreadPoolExecutor(max_workers=1) as side:
        sets = list(pool.map(own(lambda pair: prepare(*pair)), pairs))
        boosting = side.submit(own(boost))
        done = dict(zip(tasks, pool.map(own(evaluated), tasks), strict=True))
    for v in cached:
        v.unpersist()
    rows, fitted, best, best_f1 = [], {}, None, 0.0
    for name in names:
        fitted[name], m = done[name, 0]
        scores = [done[name, k][1] for k in range(1, len(sets))]
        mean = sum(scores) / len(scores) if scores else None
        std = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5 if scores else None
        rows.append((name, *[_r6(m[k]) for k in ("accuracy", "precision", "recall", "f1")], _r6(mean), _r6(std), _r6(m["roc_auc"] or 0.0)))
        if (m["f1"] or 0.0) > best_f1:
            best, best_f1 = name, m["f1"]
    table = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, "
                                        "cv_f1 double, cv_std double, roc_auc double")
    order = {n: i for i, n in enumerate(MODEL_ORDER)}
    table = table.withColumn("list_order", F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]),
                                                        F.col("model")))
    return table.orderBy(F.desc("f1"), "list_order").drop("list_order"), best, fitted.get(best)


def _r6(x):
    return None if x is None else round(x, 6)


#: Training rows per task of a fit. A fit is hundreds of small jobs, each with as many tasks again for
#: its sums: with few rows a task, the tasks' own cost outgrows that of the rows.
ROWS_PER_TASK = 200_000


def _vector_partitions(spark, part: DataFrame) -> int:
    return max(1, -(-part.count() // ROWS_PER_TASK))


def feature_names(model: PipelineModel, sample: DataFrame) -> list[str]:
    """Slot names of the vector the learner reads (from the column metadata)."""
    meta = model.transform(sample.limit(1)).schema[model.stages[-1].getFeaturesCol()].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    return [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]


def feature_importance(model: PipelineModel, sample: DataFrame, top: int = 15) -> DataFrame:
    """(feature, importance) of the fitted learner, largest first, top ``top``.
    Trees: featureImportances (one-vs-rest: mean over the binary models). Linear:
    mean |coefficient| over classes. Otherwise uniform 1/n."""
    spark = sample.sparkSession
    names = feature_names(model, sample)
    last = model.stages[-1]
    n = len(names)
    if hasattr(last, "featureImportances"):
        imp = list(last.featureImportances.toArray())
    elif hasattr(last, "coefficientMatrix"):
        cm = last.coefficientMatrix.toArray()
        imp = [float(abs(cm[:, i]).mean()) for i in range(n)]
    else:
        imp = [1.0 / n] * n
    df = spark.createDataFrame(list(zip(names, [float(x) for x in imp])), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)
