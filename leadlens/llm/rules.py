"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on labelled rows; every path from a root to a node is one
conjunctive rule over statistics. Rules and the (winsorised, scaled) statistics themselves enter a
logistic model with an L1 penalty, which keeps few of them. The kept rules are compiled into Spark
column expressions, so scoring runs inside the scan, without Python.

Training reads at most ``max_rows`` labelled rows (those with the smallest hash of the id); all
else covers every row. A null text counts as empty; empty texts get a score as well. Labels
other than 0 and 1 and null ids are not learned from; repeated labels count as often as they
stand. Without labels every score is 0.5, with one class it is that class's smoothed share. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import table, text_of

#: Bound on the labelled rows that training collects (a row is some 20 numbers).
MAX_ROWS = 20_000
THRESHOLD = 0.3
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def statistics(text: Column) -> dict[str, Column]:
    """Text statistics as JVM expressions; shares are of characters or words, 0 for empty texts."""
    n = F.length(text)
    words = F.filter(F.split(text, "[ \n\t\r]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n_words, n_lines = F.size(words), F.size(lines)

    def share(chars: str) -> Column:
        return (n - F.length(F.translate(text, chars, ""))) / F.greatest(n, F.lit(1))

    return {
        "chars": F.log1p(n),
        "words": F.log1p(n_words),
        "word_length": n / F.greatest(n_words, F.lit(1)),
        "upper": share(_LETTERS.upper()),
        "lower": share(_LETTERS),
        "digits": share("0123456789"),
        "stops": share(".,;:"),
        "marks": share("!?"),
        "symbols": share("#$%&*+/<=>@[\\]^_`{|}~"),
        "quotes": share("\"'()-"),
        "breaks": share("\n"),
        "multibyte": (F.octet_length(text) - n) / F.greatest(n, F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(n_lines, F.lit(1)),
        "line_length": F.log1p(n / F.greatest(n_lines, F.lit(1))),
    }


FEATURES = ["chars", "words", "word_length", "upper", "lower", "digits", "stops", "marks", "symbols", "quotes", "breaks",
            "multibyte", "distinct_words", "distinct_lines", "line_length"]

Condition = tuple[int, bool, float]  # statistic, above (True) or at most (False), cut


@dataclass
class RuleModel:
    """intercept + sum of weights of the rules that hold + linear terms -> log-odds."""

    intercept: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)  # statistic, low, high, weight

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for conditions, w in self.rules:
            out += w * holds(x, conditions)
        for f, low, high, w in self.linear:
            out += w * np.clip(x[:, f], low, high)
        return out

    def expression(self, columns: list[Column]) -> Column:
        """Probability of label 1 as a Spark expression over the statistics."""
        z = F.lit(float(self.intercept))
        for conditions, w in self.rules:
            test = None
            for f, above, cut in conditions:
                one = columns[f] > F.lit(float(cut)) if above else columns[f] <= F.lit(float(cut))
                test = one if test is None else test & one
            z = z + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
        for f, low, high, w in self.linear:
            z = z + F.least(F.greatest(columns[f], F.lit(float(low))), F.lit(float(high))) * F.lit(float(w))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in conditions:
        out &= x[:, f] > cut if above else x[:, f] <= cut
    return out


def _grow(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
    """One regression tree by histograms: its nodes but the root (path, rows), its leaves (rows, value)."""
    nodes = []

    def gain(g, h):
        return g * g / (h + 1.0)

    def split(rows: np.ndarray, path: tuple[Condition, ...], left: int) -> list[tuple[np.ndarray, float]]:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if left and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                b = bins[rows, f]
                n = np.cumsum(np.bincount(b, minlength=size))[:-1]
                gl = np.cumsum(np.bincount(b, grad[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, hess[rows], size))[:-1]
                score = np.where((n >= least) & (len(rows) - n >= least), gain(gl, hl) + gain(g - gl, h - hl) - gain(g, h), 0)
                k = int(score.argmax())
                if score[k] > best[0]:
                    best = (score[k], (f, k))
        if best[1] is None:
            return [(rows, -g / (h + 1.0))]
        f, k = best[1]
        low = bins[rows, f] <= k
        out = []
        for above, part in ((False, rows[low]), (True, rows[~low])):
            here = (*path, (f, above, float(cuts[f][k])))
            nodes.append((here, part))
            out += split(part, here, left - 1)
        return out

    leaves = split(np.arange(len(bins)), (), depth)
    return nodes, leaves


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 20) -> list[tuple[Condition, ...]]:
    """Distinct rules of boosted trees, as conjunctions of at most one bound per statistic and side."""
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, 64) / 64)) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    score = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes, leaves = _grow(bins, cuts, p - y, p * (1 - p), depth, least)
        for rows, value in leaves:
            score[rows] += rate * value
        for path, _ in nodes:
            bound: dict[tuple[int, bool], float] = {}
            for f, above, cut in path:
                old = bound.get((f, above))
                bound[f, above] = cut if old is None else max(old, cut) if above else min(old, cut)
            rules[tuple((f, a, c) for (f, a), c in sorted(bound.items()))] = None
    return list(rules)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) minimising mean log-loss + penalty * |weights|, by FISTA."""
    n, d = x.shape
    step = 4.0 / max(np.linalg.norm(np.column_stack([np.ones(n), x]), 2) ** 2 / n, 1e-9)
    w = v = np.zeros(d + 1)
    w[0] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(v[0] + x @ v[1:])))
        new = v - step * np.concatenate(([np.mean(p - y)], x.T @ (p - y) / n))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (old - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> RuleModel:
    """Rules and weights from statistics (rows, FEATURES) and labels 0/1."""
    if not len(y):
        return RuleModel()
    if y.min() == y.max():
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rules = tree_rules(x, y)
    low, high = np.quantile(x, 0.025, 0), np.quantile(x, 0.975, 0)
    scale = np.where(high > low, np.clip(x, low, high).std(0), 0)
    used = np.flatnonzero(scale > 1e-12)
    r = np.stack([holds(x, c) for c in rules], 1).astype(float) if rules else np.empty((len(y), 0))
    support = r.mean(0)
    spread = np.sqrt(np.maximum(support * (1 - support), 1e-12))
    z = np.column_stack([(r - support) / spread, (np.clip(x, low, high)[:, used] - np.clip(x, low, high)[:, used].mean(0)) / scale[used] * 0.4])
    intercept, w = lasso_logistic(z, y, penalty)
    wr, wl = w[:len(rules)] / spread, w[len(rules):] / scale[used] * 0.4
    intercept -= float((wr * support).sum() + (wl * np.clip(x, low, high)[:, used].mean(0)).sum())
    return RuleModel(intercept, [(c, float(a)) for c, a in zip(rules, wr, strict=True) if a],
                     [(int(f), float(low[f]), float(high[f]), float(a)) for f, a in zip(used, wl, strict=True) if a])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fit on at most ``max_rows`` ids of ``labels``; the caller has taken out what must be held out.
    Each id counts once, whatever the order of the rows: of repeated labels the smallest, of repeated
    documents the one with the smallest statistics."""
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # max_rows pairs of numbers at most, so this side is small at any size of the corpus
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    stats = F.struct("label", *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    rows = texts.groupBy("doc_id").agg(F.min(stats).alias("s")).select("doc_id", "s.*").toPandas().sort_values("doc_id")
    return fit_rules(rows[FEATURES].to_numpy(float), rows["label"].to_numpy(float))


def score(df: DataFrame, model: RuleModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 in column ``name``."""
    stats = {f"__stat_{k}": c for k, c in statistics(text_of(text_col)).items()}
    return (df.withColumns(stats).withColumn(name, model.expression([F.col(f"__stat_{k}") for k in FEATURES]))
            .drop(*stats))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def quality_model(spark, docs: DataFrame, sf_dir: str) -> RuleModel:
    """The model for ``labels.quality``, learned outside the held-out fifth."""
    return train(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op9_rules(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_model(spark, docs, sf_dir)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
