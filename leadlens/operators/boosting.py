"""Gradient-boosted trees, one-vs-rest, for many training parts and settings in the same jobs.

The learner of Spark's ``GBTClassifier`` (log loss, variance gain, histograms over binned features, the
same sampling draws), run otherwise: there every binary model runs its own job per tree level, so
54 models of 100 rounds are tens of thousands of small jobs. Here up to ``WHOLE_ROWS`` training rows (a bound on
a task's memory) a binary model grows whole in one task, all models of a call in one job: its binned columns cross the
network once and only its trees leave it. With more rows all models of a call grow their trees side by side, so a call
has rounds x depth jobs however many models it has. Rows are then dealt over
tasks as blocks of binned columns with the margins so far; a level sums one histogram per model and
node, per block and then over blocks by ``reduceByKey``, and only the chosen splits reach the driver.

Two differences from Spark's learner: thresholds come from all rows (Spark takes some 10,000 of more), and
one-hot columns are read from their category index, one histogram for all slots of a column.
NULL margins do not occur: features are imputed before. A class without rows is learned as such.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from leadlens import schema as S
from leadlens.operators.ordering import with_prefix_sums

N_CLASSES = len(S.CLASS_LABELS)
#: Rounds after which the margins are checkpointed (Spark's boosting: 10); rows of a task, at most and (of several) at
#: least: with few rows a task's own cost outgrows that of the rows.
CHECKPOINT_ROUNDS, TASK_ROWS, LEAST_ROWS = 20, 1_000_000, 20_000
#: Rounds whose draws are kept in one long.
_DRAWS = 50
#: Rows of a model that grows in one task (some 50 bytes each); rows passed at once in it, so that what a step makes stays
#: in the cache; cells of the columns that are counted together there, and rows a cell from which that is less work.
WHOLE_ROWS, _PASS, _CELLS, _CELL_ROWS = 4_500_000, 1 << 16, 4096, 32


@dataclass(frozen=True)
class Boosting:
    """Settings of one learner; ``onehot``: a split parts one category from the rest (as on one-hot
    columns), else sets of categories in the order of their mean."""
    rounds: int = 100
    depth: int = 6
    step: float = 0.1
    bins: int = 32
    rate: float = 1.0
    seed: int = 42
    onehot: bool = True


@dataclass
class Layout:
    """Columns of ``features_idx``: the first ``len(cuts)`` are numeric with these thresholds, the others category
    indices with ``arity`` values; ``slots``: one-hot slots of each category column."""
    cuts: list[np.ndarray]
    arity: list[int]
    slots: list[int]

    @property
    def sizes(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts] + self.arity


# ---------------------------------------------------------------- thresholds


def numeric_cuts(parts: list[DataFrame], n_numeric: int, bins: list[int], counts: list[int]) -> dict[tuple[int, int], list[np.ndarray]]:
    """(part, bins) -> thresholds of each numeric column: midpoints between neighbouring distinct values,
    all of them if they are fewer than ``bins``, else those nearest to equal counts. Distinct values are
    counted and numbered once for all parts and columns; a few rows per threshold reach the driver."""
    spark = parts[0].sparkSession
    long = None
    for k, part in enumerate(parts):
        x = part.select(F.posexplode(F.slice(vector_to_array("features_idx"), 1, n_numeric)).alias("column", "v"))
        one = x.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "column", "v", "n", F.lit(1).alias("one"))
        long = one if long is None else long.unionAll(one)
    placed = with_prefix_sums(long, [F.col("part").asc(), F.col("column").asc(), F.col("v").asc()], {"before": "n", "place": "one"})
    first = {(r.part, r.column): r for r in placed.groupBy("part", "column").agg(
        F.min("before").alias("before"), F.min("place").alias("place"), F.count(F.lit(1)).alias("distinct")).collect()}
    targets = {}
    for (k, c), r in first.items():
        for b in bins:
            m = min(b, counts[k]) - 1
            if r.distinct - 1 > m:
                targets[k, c, b] = np.cumsum(np.full(m, counts[k] / (m + 1))).tolist()
    picks = {(k, c, b): list(range(1, r.distinct)) for (k, c), r in first.items() for b in bins if (k, c, b) not in targets}
    if targets:
        starts = spark.createDataFrame([(*key, first[key[:2]].before, first[key[:2]].place, t) for key, t in targets.items()],
                                       "part int, column int, bins int, b0 long, p0 long, targets array<double>")
        middle = F.col("before") - F.col("b0") + F.col("n") / 2
        passed = placed.join(F.broadcast(starts), ["part", "column"]).groupBy(   # a row per column and bins
            "part", "column", "bins", F.size(F.filter("targets", lambda t: t < middle)).alias("passed")).agg(F.min(F.col("place") - F.col("p0")).alias("place"))
        at = {}
        for r in passed.collect():
            at.setdefault((r.part, r.column, r.bins), []).append((r.passed, r.place))
        for key, t in targets.items():
            chosen, last = [], 0
            for i in range(1, len(t) + 1):
                beyond = [p for passed_, p in at[key] if passed_ >= i]
                last = max([last + 1, *([min(beyond)] if beyond else [first[key[:2]].distinct])])
                if last >= first[key[:2]].distinct:
                    break
                chosen.append(last)
            picks[key] = chosen
    wanted = sorted({(k, c, first[k, c].place + p + d) for (k, c, _), ps in picks.items() for p in ps for d in (-1, 0)})
    values = {}
    if wanted:
        rows = spark.createDataFrame(wanted, "part int, column int, place long")
        values = {(r.part, r.column, r.place): r.v for r in placed.join(F.broadcast(rows), ["part", "column", "place"]).select("part", "column", "place", "v").collect()}
    out = {}
    for k in range(len(parts)):
        for b in bins:
            out[k, b] = []
            for c in range(n_numeric):
                ps = picks.get((k, c, b), [])
                out[k, b].append(np.array([(values[k, c, first[k, c].place + p - 1] + values[k, c, first[k, c].place + p]) / 2.0 for p in ps]))
    return out


# ---------------------------------------------------------------- kernels (numpy, inside tasks)


def codes(x: np.ndarray, cuts: list[np.ndarray], arity: list[int]) -> np.ndarray:
    """Bin numbers (rows x columns, laid out by column): numerics by their thresholds (x <= threshold is left), categories
    as they are."""
    out = np.empty(x.shape, np.uint8 if max([len(c) for c in cuts] + arity + [0]) < 256 else np.int32, order="F")
    for c, t in enumerate(cuts):
        out[:, c] = np.searchsorted(t, x[:, c], side="left")
    for i, a in enumerate(arity):
        out[:, len(cuts) + i] = np.clip(x[:, len(cuts) + i], 0, a - 1)
    return out


def route(binned: np.ndarray, column: np.ndarray, left: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row after ``levels`` steps; children of i are 2i + 1 and 2i + 2, a leaf (column -1) keeps its rows."""
    node = np.zeros(len(binned), np.int64)
    if not len(binned):
        return node
    flat, base = binned.T.ravel(), np.arange(len(binned), dtype=np.int64)
    table, width = left.ravel(), left.shape[1]
    start, split = np.maximum(column, 0).astype(np.int64) * len(binned), column >= 0
    for _ in range(levels):
        code = flat.take(base + start.take(node))
        down = 2 * node + 2 - table.take(node * width + code)
        node = np.where(split.take(node), down, node)
    return node


def _rows(binned: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return binned.T.take(rows, 1).T


def histogram(binned: np.ndarray, sizes: list[int], target: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
    """(2, nodes of the level, all bins): number of rows and sum of targets; rows of earlier leaves do not count."""
    nodes, first = 1 << level, (1 << level) - 1
    live = np.flatnonzero(node >= first)
    if len(live) < len(node):
        binned, target, node = _rows(binned, live), target[live], node[live]
    node = node - first
    out = np.empty((2, nodes, sum(sizes)))
    at = 0
    for c, size in enumerate(sizes):
        key = node * size + binned[:, c]
        out[0, :, at:at + size] = np.bincount(key, minlength=nodes * size).reshape(nodes, size)
        out[1, :, at:at + size] = np.bincount(key, target, nodes * size).reshape(nodes, size)
        at += size
    return out


def best_splits(hist: np.ndarray, n_numeric: int, sizes: list[int], slots: list[int], onehot: bool):
    """Per node: column (-1: a leaf), bins that go left, mean, gain, rows, place of the split in its column and the means
    of both sides. The largest variance gain wins, the first of equal ones in the order of the columns and thresholds."""
    nodes = hist.shape[1]
    n, s = hist[0, :, :sizes[0]].sum(1), hist[1, :, :sizes[0]].sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, s / n, 0.0)
        counts, sums, owner, order = [], [], [], {}
        at = 0
        for c, size in enumerate(sizes):
            hn, hs = hist[0, :, at:at + size], hist[1, :, at:at + size]
            at += size
            if c < n_numeric:
                ln, ls = np.cumsum(hn, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
            elif onehot:
                ln, ls = hn[:, :slots[c - n_numeric]], hs[:, :slots[c - n_numeric]]
            else:
                order[c] = np.argsort(np.where(hn > 0, hs / hn, np.inf), 1, kind="stable")
                ln = np.cumsum(np.take_along_axis(hn, order[c], 1), 1)[:, :-1]
                ls = np.cumsum(np.take_along_axis(hs, order[c], 1), 1)[:, :-1]
            counts.append(ln)
            sums.append(ls)
            owner += [(c, j) for j in range(ln.shape[1])]
        column, left = np.full(nodes, -1, np.int16), np.zeros((nodes, max(sizes)), bool)
        gain, place, sides = np.zeros(nodes), np.zeros(nodes, np.int16), np.stack([mean, mean], 1)
        if not owner:
            return column, left, mean, gain, n, place, sides
        ln, ls = np.concatenate(counts, 1), np.concatenate(sums, 1)
        rn, rs = n[:, None] - ln, s[:, None] - ls
        gains = (ls * ls / ln + rs * rs / rn - (s * s / n)[:, None]) / n[:, None]
        gains = np.where((ln >= 1) & (rn >= 1), gains, -np.inf)
    best = np.argmax(gains, 1)
    for i in range(nodes):
        j = best[i]
        if not gains[i, j] > 1e-13 * mean[i] ** 2:    # nothing to gain but rounding
            continue
        c, k = owner[j]
        lm, rm = ls[i, j] / ln[i, j], rs[i, j] / rn[i, j]
        if c < n_numeric:
            left[i, :k + 1] = True
        elif not onehot:
            left[i, order[c][i, :k + 1]] = True
        else:    # the side with the smaller mean is left; on a tie that without the category
            inside = lm < rm
            left[i, :sizes[c]] = not inside
            left[i, k] = inside
            if not inside:
                lm, rm = rm, lm
        column[i], gain[i], place[i], sides[i] = c, gains[i, j], k, (lm, rm)
    return column, left, mean, gain, n, place, sides


def residuals(y: np.ndarray, margin: np.ndarray, turn: int) -> np.ndarray:
    """What the next tree learns: the labels (-1, 1) first, then the negative gradient of the log loss."""
    if turn == 0:
        return y.astype(np.float64)
    with np.errstate(over="ignore"):
        return 4.0 * y / (1.0 + np.exp(2.0 * y * margin))


# ---------------------------------------------------------------- fitting


def layout_of(vectors: DataFrame) -> tuple[int, list[int], list[int]]:
    """(number of numerics, values of each category index, one-hot slots of each) from the columns' metadata."""
    attrs = lambda c: vectors.schema[c].metadata["ml_attr"]
    nominal = sorted(attrs("features_idx")["attrs"].get("nominal", []), key=lambda a: a["idx"])
    numeric = int(attrs("features_idx")["num_attrs"]) - len(nominal)
    arity = [len(a["vals"]) for a in nominal]
    over = sum(arity) + numeric - int(attrs("features")["num_attrs"])   # slots that were dropped, one a column
    return numeric, arity, [a - (1 if over else 0) for a in arity]


def _drawn(spec: Boosting) -> list[Column]:
    """The rows each round draws, a bit per round: ``rand`` of seed + round + 1 makes the draws of Spark's own boosting."""
    if spec.rate >= 1.0:
        return []
    return [sum((F.when(F.rand(spec.seed + m + 1) < spec.rate, F.lit(1 << (m - at))).otherwise(F.lit(0)).cast("long")
                 for m in range(at, min(at + _DRAWS, spec.rounds))), F.lit(0).cast("long")) for at in range(0, spec.rounds, _DRAWS)]


def _blocks(vectors: DataFrame, specs: list[Boosting], layouts: list[Layout]):
    """RDD with one (binned columns and drawn bits of each learner, class labels) per partition of ``vectors``."""
    draws = [_drawn(s) for s in specs]
    width = [len(d) for d in draws]
    df = vectors.select(F.col("label").cast("int").alias("label"), vector_to_array("features_idx").alias("x"),
                        F.array(*[c for d in draws for c in d]).cast("array<long>").alias("drawn"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, per = [], [([], []) for _ in specs]
        for b in batches:
            if not b.num_rows:
                continue
            y.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int8))
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            d = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            at = 0
            for (binned, drawn), lay, w in zip(per, layouts, width, strict=True):
                binned.append(codes(x, lay.cuts, lay.arity))
                drawn.append(d[:, at:at + w])
                at += w
        if y:
            block = [(np.concatenate([b.T for b in binned], 1).T, np.concatenate(drawn)) for binned, drawn in per], np.concatenate(y)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

    return df.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


def fit_boosted(parts: list[DataFrame], specs: dict[str, Boosting]) -> dict[tuple[int, str], BoostedModel]:
    """(part, learner name) -> model. ``parts``: cached (label, features, features_idx), dealt over partitions of bounded
    rows, each with its own encoding. All learners need the same rounds and depth."""
    spark = parts[0].sparkSession
    sc = spark.sparkContext
    names, settings = list(specs), list(specs.values())
    rounds, depth = {s.rounds for s in settings}, {s.depth for s in settings}
    if len(rounds) != 1 or len(depth) != 1:
        raise ValueError("the learners of a call need the same rounds and depth")
    rounds, depth = rounds.pop(), depth.pop()
    shapes = [layout_of(v) for v in parts]
    counts = [v.count() for v in parts]
    cuts = numeric_cuts(parts, shapes[0][0], sorted({s.bins for s in settings}), counts)
    layouts = {(k, i): Layout(cuts[k, s.bins], shapes[k][1], shapes[k][2]) for k in range(len(parts)) for i, s in enumerate(settings)}
    if max(counts) <= WHOLE_ROWS:
        grown = _grown_whole(parts, settings, layouts, shapes)
        return _models(parts, names, settings, layouts, grown)
    n_parts = [v.rdd.getNumPartitions() for v in parts]
    part_of = [k for k, n in enumerate(n_parts) for _ in range(n)]
    cores = sc.defaultParallelism
    # few blocks: the classes are dealt apart, too, so that all cores have work
    groups = [list(range(N_CLASSES))] if len(part_of) * len(settings) >= 4 * cores else [[c] for c in range(N_CLASSES)]
    n_records = len(part_of) * len(settings) * len(groups)
    rows = sum(counts) * len(settings) * len(groups)
    n_tasks = min(n_records, max(min(cores, -(-rows // LEAST_ROWS)), -(-rows // TASK_ROWS), 1))

    def records(i: int, blocks):
        for learned, y in blocks:
            for li, (binned, drawn) in enumerate(learned):
                for gi, classes in enumerate(groups):
                    signs = np.stack([np.where(y == c, 1, -1).astype(np.int8) for c in classes])
                    yield (i * len(settings) + li) * len(groups) + gi, (part_of[i], li, classes, binned, drawn, signs, np.zeros(signs.shape))

    blocks = sc.union([_blocks(v, settings, [layouts[k, i] for i in range(len(settings))]) for k, v in enumerate(parts)])
    state = blocks.mapPartitionsWithIndex(records).partitionBy(n_tasks, lambda key: key).values().persist(StorageLevel.MEMORY_AND_DISK_DESER)
    shape = {key: (len(lay.cuts), lay.sizes, lay.slots) for key, lay in layouts.items()}
    spread, inner = max(n_parts) > 1, (1 << depth) - 1
    models = [(k, i, c) for k in range(len(parts)) for i in range(len(settings)) for c in range(N_CLASSES)]
    grown: dict[tuple, list] = {m: [] for m in models}
    older, saved, sent = None, None, []
    for turn in range(rounds):
        trees = {(k, i, c): (np.full(inner, -1, np.int16), np.zeros((inner, max(shape[k, i][1])), bool), np.zeros(2 * inner + 1),
                             np.zeros(inner), np.zeros(inner, np.int16)) for k, i, c in models}   # column, left, value, worth, place
        for level in range(depth):
            partial = sc.broadcast({key: t[:2] for key, t in trees.items()})
            found = state.flatMap(_level_kernel(shape, settings, partial, turn, level))
            if spread:
                found = found.reduceByKey(np.add, min(len(models), max(cores, n_tasks)))
            for key, (column, left, mean, gain, n, place, sides) in found.map(_choose(shape, settings)).collect():
                at, t = (1 << level) - 1, trees[key]
                size = slice(at, at + len(column))
                t[0][size], t[1][size], t[3][size], t[4][size] = column, left, gain * n, place
                if level == 0:
                    t[2][0] = mean[0]
                for j in np.flatnonzero(column >= 0):
                    t[2][2 * (at + j) + 1], t[2][2 * (at + j) + 2] = sides[j]
            partial.destroy()
            if level == 0 and older is not None:
                older.unpersist()      # this round's state has been computed from it
                older = None
            if not any((t[0][(1 << level) - 1:(2 << level) - 1] >= 0).any() for t in trees.values()):
                break
        for key, t in trees.items():
            grown[key].append(t)
        if turn + 1 < rounds:
            whole = sc.broadcast({key: t[:3] for key, t in trees.items()})
            sent.append(whole)
            older, state = state, state.map(_margins(settings, whole, turn, depth)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
            if (turn + 1) % CHECKPOINT_ROUNDS == 0:
                state.checkpoint()
                state.count()
                _forget(sc, saved)
                saved = state.getCheckpointFile()
                for b in sent[:-1]:    # the last one still stands in the checkpointed step
                    b.destroy()
                sent = sent[-1:]
    state.unpersist()
    _forget(sc, saved)
    for b in sent:
        b.destroy()
    return _models(parts, names, settings, layouts, grown)


def _models(parts, names, settings, layouts, grown) -> dict[tuple[int, str], BoostedModel]:
    out = {}
    for k in range(len(parts)):
        for i, name in enumerate(names):
            out[k, name] = BoostedModel(_ensemble([grown[k, i, c] for c in range(N_CLASSES)], layouts[k, i], settings[i]))
            out[k, name].setFeaturesCol("features" if settings[i].onehot else "features_idx")
    return out


def _grown_whole(parts: list[DataFrame], settings: list[Boosting], layouts: dict, shapes: list) -> dict[tuple, list]:
    """(part, learner, class) -> trees, each model grown by one task from all its blocks."""
    models = [(k, i, c) for k in range(len(parts)) for i in range(len(settings)) for c in range(N_CLASSES)]
    number = {m: j for j, m in enumerate(models)}
    sent = []
    for k, v in enumerate(parts):
        def deal(place: int, blocks, k=k):
            for learned, y in blocks:
                for i, (binned, drawn) in enumerate(learned):
                    for c in range(N_CLASSES):
                        yield number[k, i, c], (place, binned, drawn, y == c)
        sent.append(_blocks(v, settings, [layouts[k, i] for i in range(len(settings))]).mapPartitionsWithIndex(deal))

    def run(j: int, records):
        held = sorted((r for _, r in records), key=lambda r: r[0])
        k, i, c = models[j]
        lay, spec = layouts[k, i], settings[i]
        if not held:
            held = [(0, np.empty((0, len(lay.sizes)), np.uint8), np.empty((0, len(_drawn_places(spec))), np.int64), np.empty(0, bool))]
        binned = np.concatenate([b.T for _, b, _, _ in held], 1).T
        drawn, y = np.concatenate([d for _, _, d, _ in held]), np.concatenate([t for _, _, _, t in held])
        held.clear()
        yield models[j], grow(binned, drawn, np.where(y, 1, -1).astype(np.int8), spec, len(lay.cuts), lay.sizes, lay.slots)

    sc = parts[0].sparkSession.sparkContext
    return dict(sc.union(sent).partitionBy(len(models), lambda j: j).mapPartitionsWithIndex(run).collect())   # trees: bounded by rounds and depth


def _drawn_places(spec: Boosting) -> range:
    return range(0, spec.rounds if spec.rate < 1.0 else 0, _DRAWS)


def _together(sizes: list[int], rows: int) -> list[list[int]]:
    """Columns that are counted by one joint code. With few rows each stands alone (and its sums are those of the
    distributed rounds to the last bit): summing up the cells would cost more than it saves."""
    out, cells = [], 1
    for c, size in enumerate(sizes):
        if out and rows > _PASS and cells * size <= min(_CELLS, rows // _CELL_ROWS):
            out[-1].append(c)
            cells *= size
        else:
            out.append([c])
            cells = size
    return out


def grow(binned: np.ndarray, drawn: np.ndarray, y: np.ndarray, spec: Boosting, n_numeric: int, sizes: list[int], slots: list[int]) -> list[tuple]:
    """All trees of a binary model (column, left, value, worth, place) from all its rows: the steps of the distributed
    rounds, with the node of every row kept from level to level."""
    n, inner = len(y), (1 << spec.depth) - 1
    parts = [slice(a, min(a + _PASS, n)) for a in range(0, n, _PASS)]
    columns = binned.T if binned.T.flags.c_contiguous else np.ascontiguousarray(binned.T)
    codes_of = [np.ascontiguousarray(columns[:, p]).ravel() for p in parts]
    # joint codes of columns that are counted together
    groups = _together(sizes, n)
    joint = []
    for cols in groups:
        key = columns[cols[0]].astype(np.uint16 if max(_CELLS, *sizes) <= 1 << 16 else np.int64)
        for c in cols[1:]:
            key *= sizes[c]
            key += columns[c]
        joint.append(key)
    del columns
    margin, target, node = np.zeros(n), np.empty(n), np.zeros(n, np.int16 if spec.depth < 14 else np.int64)
    trees = []
    for turn in range(spec.rounds):
        column, left = np.full(inner, -1, np.int16), np.zeros((inner, max(sizes)), bool)
        value, worth, place = np.zeros(2 * inner + 1), np.zeros(inner), np.zeros(inner, np.int16)
        node[:] = 0
        for level in range(spec.depth):
            first, nodes = (1 << level) - 1, 1 << level
            hist = [np.zeros((2, nodes, int(np.prod([sizes[c] for c in cols])))) for cols in groups]
            alive = np.ones(nodes, bool)      # inner nodes have children; a leaf keeps its rows
            if level:
                above = column[first >> 1:first] >= 0
                alive = np.repeat(above, 2)
            slot_of = np.where(alive, np.arange(nodes), nodes)
            for p, flat in zip(parts, codes_of, strict=True):
                if level:
                    node[p] = _down(flat, node[p], column, left)
                else:
                    target[p] = residuals(y[p], margin[p], turn)
                slot = slot_of.take(node[p] - first)
                if spec.rate < 1.0:
                    slot = np.where((drawn[p, turn // _DRAWS] >> (turn % _DRAWS)) & 1, slot, nodes)
                for h, key in zip(hist, joint, strict=True):
                    cells = h.shape[2]
                    at = slot * cells
                    at += key[p]
                    h[0] += np.bincount(at, minlength=(nodes + 1) * cells)[:nodes * cells].reshape(nodes, cells)
                    h[1] += np.bincount(at, target[p], (nodes + 1) * cells)[:nodes * cells].reshape(nodes, cells)
            whole = np.concatenate([_marginal(h, [sizes[c] for c in cols]) for h, cols in zip(hist, groups, strict=True)], 2)
            size = slice(first, first + nodes)
            column[size], left[size], mean, gain, rows, place[size], sides = best_splits(whole, n_numeric, sizes, slots, spec.onehot)
            worth[size] = gain * rows
            if level == 0:
                value[0] = mean[0]
            for j in np.flatnonzero(column[size] >= 0):
                value[2 * (first + j) + 1], value[2 * (first + j) + 2] = sides[j]
            if not (column[size] >= 0).any():
                break
        else:
            first = inner
        w, reached = (1.0 if turn == 0 else spec.step), value.copy()
        for j in np.flatnonzero(column < 0):      # what lies below a leaf has its value
            reached[2 * j + 1] = reached[2 * j + 2] = reached[j]
        for p, flat in zip(parts, codes_of, strict=True):
            if first == inner:
                node[p] = _down(flat, node[p], column, left)
            margin[p] += w * reached.take(node[p])
        trees.append((column, left, value, worth, place))
    return trees


def _down(flat: np.ndarray, node: np.ndarray, column: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The child of every row's node; rows of a leaf go to its right, where there is nothing. ``flat``: codes by column."""
    node = node.astype(np.int64)
    at = (np.maximum(column, 0).astype(np.int64) * len(node)).take(node)
    at += np.arange(len(node))
    code = node * left.shape[1]
    code += flat.take(at)
    node *= 2
    node += 2
    node -= left.ravel().take(code)
    return node


def _marginal(hist: np.ndarray, sizes: list[int]) -> np.ndarray:
    """(2, nodes, all bins of the columns) from the cells of their joint code."""
    if len(sizes) == 1:
        return hist
    cells = hist.reshape(*hist.shape[:2], *sizes)
    return np.concatenate([cells.sum(tuple(a + 2 for a in range(len(sizes)) if a != c)) for c in range(len(sizes))], 2)


def _forget(sc, path: str | None) -> None:
    """Delete a checkpoint that a later one replaces."""
    if path:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _level_kernel(shape, settings, partial, turn: int, level: int):
    def run(record):
        k, i, classes, binned, drawn, signs, margins = record
        use = None
        if settings[i].rate < 1.0:
            use = np.flatnonzero((drawn[:, turn // _DRAWS] >> (turn % _DRAWS)) & 1)
            binned = _rows(binned, use)
        for j, c in enumerate(classes):
            y, m = (signs[j], margins[j]) if use is None else (signs[j][use], margins[j][use])
            node = route(binned, *partial.value[k, i, c], level)
            yield (k, i, c), histogram(binned, shape[k, i][1], residuals(y, m, turn), node, level)
    return run


def _choose(shape, settings):
    def run(pair):
        (k, i, c), hist = pair
        numeric, sizes, slots = shape[k, i]
        return (k, i, c), best_splits(hist, numeric, sizes, slots, settings[i].onehot)
    return run


def _margins(settings, whole, turn: int, depth: int):
    def run(record):
        k, i, classes, binned, drawn, signs, margins = record
        w = 1.0 if turn == 0 else settings[i].step
        added = np.stack([whole.value[k, i, c][2].take(route(binned, *whole.value[k, i, c][:2], depth)) for c in classes])
        return k, i, classes, binned, drawn, signs, margins + w * added
    return run


# ---------------------------------------------------------------- the model


@dataclass
class Ensemble:
    """Trees of every class over the slots of the learner's own vector: thresholds of the numerics, values of the
    other slots, and per class (trees x nodes) column, bins that go left, means, and gain x rows of each split."""
    cuts: list[np.ndarray]
    arity: list[int]
    weights: np.ndarray
    column: np.ndarray      # class, tree, node
    left: np.ndarray        # class, tree, node, bin
    value: np.ndarray       # class, tree, node and leaf
    worth: np.ndarray       # class, tree, node

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows x classes) sums of the weighted trees."""
        binned, levels = codes(x, self.cuts, self.arity), (self.value.shape[2] + 1).bit_length() - 2
        out = np.zeros((len(x), len(self.column)))
        for c in range(len(self.column)):
            for t, w in enumerate(self.weights):
                out[:, c] += w * self.value[c, t].take(route(binned, self.column[c, t], self.left[c, t], levels))
        return out

    def importances(self) -> np.ndarray:
        """Gain x rows of the splits of each slot, normalised per class, mean over the classes."""
        size = len(self.cuts) + len(self.arity)
        per = np.stack([np.bincount(self.column[c][self.column[c] >= 0], self.worth[c][self.column[c] >= 0], size) for c in range(len(self.column))])
        return (per / np.maximum(per.sum(1, keepdims=True), 1e-300)).mean(0)


def _ensemble(classes: list[list], lay: Layout, spec: Boosting) -> Ensemble:
    column, left, value, worth, place = (np.stack([np.stack([t[j] for t in trees]) for trees in classes]) for j in range(5))
    arity = lay.arity
    if spec.onehot:    # a split on a category becomes one on its slot (bin 0: not this category, 1: this one)
        numeric, first, arity = len(lay.cuts), np.cumsum([0, *lay.slots]), [2] * sum(lay.slots)
        own, slotted = column.copy(), np.zeros((*left.shape[:3], max([len(c) + 1 for c in lay.cuts] + [2])), bool)
        width = min(left.shape[3], slotted.shape[3])
        slotted[..., :width] = left[..., :width]
        for at in zip(*np.nonzero(column >= numeric), strict=True):
            inside = left[at][place[at]]
            own[at] = numeric + first[column[at] - numeric] + place[at]
            slotted[at] = False
            slotted[at][:2] = (not inside, inside)
        column, left = own, slotted
    weights = np.full(column.shape[1], spec.step)
    weights[0] = 1.0
    return Ensemble(lay.cuts, arity, weights, column, left, value, worth)


class BoostedModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """Adds ``rawPrediction``: the margin of each class' binary model. It is saved and loaded like any stage."""

    def __init__(self, ensemble: Ensemble | None = None):
        super().__init__()
        self.ensemble = ensemble

    def setFeaturesCol(self, value: str) -> BoostedModel:
        return self._set(featuresCol=value)

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.ensemble.importances())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ensemble = self.ensemble

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            return pd.Series(list(ensemble.margins(np.stack(x.to_numpy()))) if len(x) else [])

        return dataset.withColumn("rawPrediction", array_to_vector(margins(vector_to_array(self.getFeaturesCol()))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: BoostedModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        e = self.instance.ensemble
        rows = [(c, t, float(e.weights[t]), e.column[c, t].astype(int).tolist(), bytearray(np.packbits(e.left[c, t]).tobytes()),
                 e.value[c, t].tolist(), e.worth[c, t].tolist()) for c in range(len(e.column)) for t in range(len(e.weights))]
        trees = "class int, tree int, weight double, column array<int>, left binary, value array<double>, worth array<double>"
        self.sparkSession.createDataFrame(rows, trees).coalesce(1).write.parquet(f"{path}/trees")
        self.sparkSession.createDataFrame([([c.tolist() for c in e.cuts], [int(a) for a in e.arity], int(e.left.shape[3]))],
                                          "cuts array<array<double>>, arity array<int>, bins int").coalesce(1).write.parquet(f"{path}/slots")


class _Reader(MLReader):
    def load(self, path: str) -> BoostedModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        slots = spark.read.parquet(f"{path}/slots").first()
        rows = spark.read.parquet(f"{path}/trees").orderBy("class", "tree").collect()    # a row per tree
        n, nodes = rows[-1]["class"] + 1, len(rows[0]["column"])
        stacked = lambda values: np.stack(values).reshape(n, len(rows) // n, *np.shape(values[0]))
        left = [np.unpackbits(np.frombuffer(r["left"], np.uint8), count=nodes * slots["bins"]).astype(bool).reshape(nodes, slots["bins"]) for r in rows]
        model = BoostedModel(Ensemble([np.array(c, float) for c in slots["cuts"]], list(slots["arity"]),
                                      np.array([r["weight"] for r in rows[:len(rows) // n]]), stacked([np.array(r["column"], np.int16) for r in rows]),
                                      stacked(left), stacked([np.array(r["value"]) for r in rows]), stacked([np.array(r["worth"]) for r in rows])))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
