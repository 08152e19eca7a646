"""N-gram Jaccard join with a count-vector R-tree.

Every text is its set of distinct word shingles; two texts link from 80 shared to 100 united ones
on. Shingles are hashed into groups; a set's counts per group are a point, and two sets share at
most the sum over the groups of the smaller count. Boxes of an R-tree carry the largest count per
group, so that sum bounds the overlap with every set below.

A tree over all sets alone would compare most sets of like length with each other, as counts of
long sets are alike. So sets are dealt out first: a linked pair shares at least one of the first
n - ceil(0.8 n) + 1 shingles of each set in any common order, and each of these is a key under
which the set's point is filed. Frequent shingles, counted over all texts, come last in the order,
which keeps files small. A set's place in the order bounds the overlap, too: a pair whose first
shared key stands at places i and j shares at most min(n - i, m - j), so points that cannot match
any other in a file leave it. Per key, small files are one leaf and compared by the bounds; in larger
files every set is first held against a pivot, then, once components are known, against the tree
of all sets of other components, in blocks. What survives is bounded once more by points of many
groups, then verified on the whole sets. No link between different components is lost, and no pairs within a group of copies are
made: equal sets are one point, and a subtree of the set's own component is skipped. Files of one
family of texts hold much the same sets, so they are dealt to the same tasks, by their least set,
and a task hands a pair on once.

Rows with null or empty text, or without words, link with nothing. Rows without doc_id get a null
component. Rows of the same doc_id are judged by their own texts. Repeated rows share their set.
An empty table gives no rows. Only the named columns are read; ``drop_near_copies`` returns all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import Scratch, prepare, shuffle_partitions, table, text_of
from leadlens.llm.components import components
from leadlens.llm.shingles import set_hash, shingle_sets

GROUPS = 8
#: Groups of the fine points, by which candidate pairs are bounded once more before verification.
FINE = 512
#: Sets in a leaf; files of at most so many are compared at once.
LEAF = 16
#: Sets of a file in one block of the tree join.
BLOCK = 4096
#: Frequent shingles that the common order puts last (two numbers each, sent to every task).
#: The order is one and the same for all texts whatever it holds, so no link depends on it.
FREQUENT = 1 << 17
_RECORD = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<i4"), ("place", "<i4"), ("unit", "<i4"), ("vec", "u1", GROUPS)])
#: Files of so many sets are dealt over so many tasks more (one per SALT).
SALT = 256
#: Bits of the map of ids whose sets are wanted for verification (2 MB, sent to every task).
MARKS = 1 << 24
#: Records held in a task before they are handed on.
_FLUSH = 1 << 19


def need(a, b):
    """Least overlap of linked sets of sizes a and b: 100 * shared >= 80 * (a + b - shared)."""
    return (4 * (a + b) + 8) // 9


def count_vector(s: np.ndarray, groups: int = GROUPS) -> tuple[int, np.ndarray]:
    """(unit, counts per group in units, rounded up): unit * counts bounds the true counts."""
    counts = np.bincount((s >> np.uint64(32) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    unit = max(1, -(-int(counts.max()) // 255))
    return unit, (-(-counts // unit)).astype(np.uint8)


class RTree:
    """Bulk-loaded tree over points (size, counts per group) that carry a component label."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((sizes, labels))
        self.sizes, self.counts, self.labels = sizes[self.order], counts[self.order], labels[self.order]
        n = len(sizes)
        level = {"low": self.sizes, "high": self.sizes, "top": self.counts, "first": self.labels, "last": self.labels,
                 "end": np.arange(n)}
        self.levels = [level]  # from the points up to the root's children
        while len(level["low"]) > LEAF:
            at = np.arange(0, len(level["low"]), LEAF)
            level = {"low": np.minimum.reduceat(level["low"], at), "high": np.maximum.reduceat(level["high"], at),
                     "top": np.maximum.reduceat(level["top"], at), "first": np.minimum.reduceat(level["first"], at),
                     "last": np.maximum.reduceat(level["last"], at), "end": level["end"][np.append(at[1:], len(level["end"])) - 1]}
            self.levels.append(level)

    def pairs(self, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (places in the input) of different labels that the bound lets through."""
        n = len(self.sizes)
        for begin in range(0, n, chunk):
            queries = np.arange(begin, min(begin + chunk, n))
            width = len(self.levels[-1]["low"])
            q, node = np.repeat(queries, width), np.tile(np.arange(width), len(queries))
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                size = self.sizes[q]
                keep = ((level["end"][node] > q) & (5 * level["high"][node] >= 4 * size) & (4 * level["low"][node] <= 5 * size)
                        & ~((level["first"][node] == self.labels[q]) & (level["last"][node] == self.labels[q])))
                q, node = q[keep], node[keep]
                least = np.maximum(level["low"][node], (4 * self.sizes[q] + 4) // 5)
                keep = np.minimum(self.counts[q], level["top"][node]).sum(1) >= need(self.sizes[q], least)
                q, node = q[keep], node[keep]
                if depth:
                    below = len(self.levels[depth - 1]["low"])
                    child = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
                    q = np.repeat(q, LEAF)
                    q, node = q[child < below], child[child < below]
            if len(q):
                yield self.order[q], self.order[node]


def _frequent(local: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.nulls(len(local), pa.int64()), "n": pa.array(list(local.values()), pa.int64()),
        "node": pa.array(list(local), pa.int64()), "shingle": [True] * len(local),
        "unit": pa.nulls(len(local), pa.int32()), "fine": pa.nulls(len(local), pa.binary())})


def _sets_and_frequent(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n, node, shingle, unit, fine): one row per text with its set's size, hash and fine
    point, and, with shingle = true, each task's frequent shingles (node) with their counts (n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [], 0
        for b in batches:
            sets = list(shingle_sets(b.column(1).to_pylist()))
            fine = [count_vector(s, FINE) if len(s) else (1, np.empty(0, np.uint8)) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "n": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()), "shingle": [False] * len(sets),
                "unit": pa.array([u for u, _ in fine], pa.int32()), "fine": pa.array([v.tobytes() for _, v in fine], pa.binary())})
            texts += len(sets)
            held.append(np.concatenate(sets))
            if sum(map(len, held)) > 4 * _FLUSH:
                yield _frequent(_count(held, texts))
                held, texts = [], 0
        if held:
            yield _frequent(_count(held, texts))

    return scratch.keep(rows.mapInArrow(run, "doc_id long, n long, node long, shingle boolean, unit int, fine binary"), "sets")


def _count(held: list[np.ndarray], texts: int) -> dict[int, int]:
    """Shingles in more than one of 2000 of the texts (and in three at least), with their counts."""
    s = np.sort(np.concatenate(held))
    if not len(s):
        return {}
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    n = np.diff(np.append(at, len(s)))
    many = n >= max(3, texts / 2000)
    return dict(zip(s[at[many]].view(np.int64).tolist(), n[many].tolist(), strict=True))


def _ordered(s: np.ndarray, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the common order: by frequency class, then hash."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    cls = np.where(frequent[at] == s, classes[at], 0)
    return s[np.argsort(cls, kind="stable")]


def _file_points(rows: DataFrame, frequent, n_parts: int) -> DataFrame:
    """Files of points, as binary records dealt by key (part)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = frequent.value
        held, n, seen = [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            records = np.concatenate(held)
            part = (records["key"] % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            records, part = records[order], part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(at[1:], len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[at].astype(np.int32)), pa.array([records[a:e].tobytes() for a, e in zip(at, ends, strict=True)], pa.binary())],
                names=["part", "records"])

        for b in batches:
            for s in shingle_sets(b.column(0).to_pylist()):
                if not len(s):
                    continue
                node = set_hash(s)
                if node in seen:
                    continue
                seen.add(node)
                keys = _ordered(s, known, classes)[:len(s) - (4 * len(s) + 4) // 5 + 1]
                record = np.empty(len(keys), _RECORD)
                record["key"], record["node"], record["n"], record["place"] = keys, node, len(s), np.arange(len(keys))
                record["unit"], record["vec"] = count_vector(s)
                held.append(record)
                n += len(keys)
                if n >= _FLUSH:
                    yield from flush()
                    held, n, seen = [], 0, set()
        if held:
            yield from flush()

    return rows.select("text").mapInArrow(run, "part int, records binary")


_PAIRS = "a long, b long, key long, n int, place int, file long, least long"


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
        names=["a", "b", "key", "n", "place", "file", "least"])


def _pairable(r: np.ndarray) -> np.ndarray:
    """Records (sorted by key, then size) that the places let match some other record of their file,
    in files of two or more. A set's need is least with the smallest partner, so the file's smallest
    set, or four fifths of the set's own size, decides."""
    while len(r):
        at = np.flatnonzero(np.concatenate(([True], r["key"][1:] != r["key"][:-1])))
        sizes = np.diff(np.append(at, len(r)))
        n = r["n"].astype(np.int64)
        partner = np.maximum(np.repeat(n[at], sizes), (4 * n + 4) // 5)
        keep = (np.repeat(sizes, sizes) > 1) & (n - r["place"] >= need(n, partner))
        if keep.all():
            break
        r = r[keep]
    return r


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a task's files (a < b), and the points of its large files (key, n, place;
    a = node; file = how many; least = the smallest node)."""
    got = [np.frombuffer(x, _RECORD) for b in batches for x in b.column(1).to_pylist()]
    if not got:
        return
    r = np.concatenate(got)
    del got
    r = r[np.lexsort((r["node"], r["n"], r["key"]))]
    same = np.concatenate(([False], (r["key"][1:] == r["key"][:-1]) & (r["node"][1:] == r["node"][:-1])))
    r = _pairable(r[~same])
    if not len(r):
        return
    at = np.flatnonzero(np.concatenate(([True], r["key"][1:] != r["key"][:-1])))
    sizes = np.diff(np.append(at, len(r)))
    size, least = np.repeat(sizes, sizes), np.repeat(np.minimum.reduceat(r["node"], at), sizes)
    small = r[size <= LEAF]
    large, large_size, least = r[size > LEAF], size[size > LEAF], least[size > LEAF]
    out_a, out_b = [], []

    def add(x: np.ndarray, y: np.ndarray) -> None:
        """Pairs of records that sizes and summed minima let through."""
        ok = 5 * np.minimum(x["n"], y["n"]) >= 4 * np.maximum(x["n"], y["n"])
        x, y = x[ok], y[ok]
        shared = np.minimum(x["vec"].astype(np.int64) * x["unit"][:, None], y["vec"].astype(np.int64) * y["unit"][:, None]).sum(1)
        shared = np.minimum(shared, np.minimum(x["n"] - x["place"], y["n"] - y["place"]))
        ok = shared >= need(x["n"].astype(np.int64), y["n"])
        out_a.append(np.minimum(x["node"][ok], y["node"][ok]))
        out_b.append(np.maximum(x["node"][ok], y["node"][ok]))

    for d in range(1, LEAF):
        if len(small) > d:
            pair = np.flatnonzero(small["key"][d:] == small["key"][:-d])
            add(small[pair], small[pair + d])
    at = np.flatnonzero(np.concatenate(([True], large["key"][1:] != large["key"][:-1]))) if len(large) else []
    for begin, end in zip(at, np.append(at[1:], len(large)) if len(large) else [], strict=True):
        while begin < end:  # bands of sizes that can match the smallest
            stop = begin + int(np.searchsorted(large["n"][begin:end], 5 * int(large["n"][begin]) // 4, side="right"))
            band = large[begin:stop]
            pivot = int(band["node"].argmin())
            rest = np.delete(band, pivot)
            add(rest, np.repeat(band[pivot:pivot + 1], len(rest)))
            begin = stop
    pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0) if out_a else np.empty((0, 2), np.int64)
    for i in range(0, len(pairs), 1 << 16):
        yield _pairs_batch(pairs[i:i + (1 << 16), 0], pairs[i:i + (1 << 16), 1])
    for i in range(0, len(large), 1 << 16):
        x = large[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x["node"].copy()), pa.nulls(len(x), pa.int64()), pa.array(x["key"].copy().view(np.int64)), pa.array(x["n"].copy()),
             pa.array(x["place"].copy()), pa.array(large_size[i:i + (1 << 16)]), pa.array(least[i:i + (1 << 16)])],
            names=["a", "b", "key", "n", "place", "file", "least"])


def _shared(points: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bound on the overlap of sets x[i] and y[i]: summed minima of their points, in slices."""
    out, step = np.empty(len(x), np.int64), (1 << 21) // points.shape[1]
    for i in range(0, len(x), step):
        out[i:i + step] = np.minimum(points[x[i:i + step]], points[y[i:i + step]]).sum(1, dtype=np.int64)
    return out


def _file_pairs(group: pa.Table) -> np.ndarray:
    """Candidate pairs (a < b) of different components between two blocks of a file (or within one):
    what the tree and the places let through is bounded again by the fine points."""
    node, n, place, label, block, units = (group.column(c).to_numpy() for c in ("node", "n", "place", "label", "block", "unit"))
    fine = np.frombuffer(b"".join(group.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
    if units.max() > 1:
        fine = fine.astype(np.int32) * units[:, None].astype(np.int32)
    middle = fine.reshape(-1, FINE // 8, 8).sum(2, dtype=np.int32)  # cheaper, and rids most pairs
    coarse = middle.reshape(len(middle), GROUPS, -1).sum(2, dtype=np.int64)
    room, n = n.astype(np.int64) - place, n.astype(np.int64)
    a, b = [], []
    both = group.column("b1")[0].as_py() != group.column("b2")[0].as_py()
    for x, y in RTree(n, coarse, label).pairs():
        if both:
            x, y = x[block[x] != block[y]], y[block[x] != block[y]]
        near = np.minimum(room[x], room[y]) >= need(n[x], n[y])
        x, y = x[near], y[near]
        for points in (middle, fine):
            near = _shared(points, x, y) >= need(n[x], n[y])
            x, y = x[near], y[near]
        a.append(np.minimum(node[x], node[y]))
        b.append(np.maximum(node[x], node[y]))
    return np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.empty((0, 2), np.int64)


def _tree_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of files sorted by (key, b1, b2): their candidate pairs, each once while it is remembered."""
    held, now, seen = [], None, set()

    def close() -> Iterator[pa.RecordBatch]:
        pairs = _file_pairs(pa.Table.from_batches(held))
        new = [p for p in map(tuple, pairs.tolist()) if p not in seen]
        seen.update(new)
        if new:
            a, b = zip(*new, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if len(seen) > _FLUSH:
            seen.clear()

    for b in batches:
        files = np.stack([b.column(c).to_numpy() for c in ("key", "b1", "b2")], 1)
        at = np.flatnonzero(np.concatenate(([True], (files[1:] != files[:-1]).any(1)))) if len(files) else np.empty(0, np.int64)
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(files)], strict=True):
            if held and now != tuple(files[i]):
                yield from close()
                held = []
            now = tuple(files[i])
            held.append(b.slice(i, j - i))
    if held:
        yield from close()


def _mark(column: str):
    return F.pmod(F.xxhash64(column), F.lit(MARKS))


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of MARKS bits, with those of the hashed ids set: of fixed size however many ids."""
    at = ids.where("doc_id is not null").select(_mark("doc_id").alias("m"))
    words = (at.groupBy((F.col("m") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m % 64 as int))")).alias("bits"))
             .collect())  # MARKS / 64 rows at most
    out = np.zeros(MARKS // 64, np.int64)
    out[[r.w for r in words]] = [r.bits for r in words]
    return out.view(np.uint8)


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The candidate pairs (a, b; set hashes) that link, as links of smallest doc_ids."""
    def nodes(of: DataFrame) -> DataFrame:
        return of.select(F.col("a").alias("node")).union(of.select(F.col("b").alias("node"))).distinct()

    def side(of: DataFrame, key: str, *columns: str) -> DataFrame:
        return of.select(F.col("node").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in columns])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_a, u_a, n_b, u_b = (b.column(i).to_numpy() for i in (2, 3, 5, 6))
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, FINE).astype(np.int64) for i in (4, 7))
            shared = np.minimum(x * u_a[:, None], y * u_b[:, None]).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(shared >= need(n_a, n_b)))

    known = (sets.join(nodes(pairs), "node").groupBy("node")
             .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("unit").alias("unit"), F.first("fine").alias("fine")))
    reps = scratch.keep(known, f"{name}-reps")
    points = ("n", "unit", "fine")
    near = pairs.join(side(reps, "a", *points), "a").join(side(reps, "b", *points), "b")
    pairs = scratch.keep(near.select("a", "b", "n_a", "unit_a", "fine_a", "n_b", "unit_b", "fine_b").mapInArrow(bound, "a long, b long"), f"{name}-near")
    asked = rows.sparkSession.sparkContext.broadcast(_marks(reps.join(nodes(pairs), "node").select("doc_id")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the texts whose ids are marked: those asked for and a few more, which no pair joins."""
        seen = set()
        for b in batches:
            new, places = {}, b.column(1).to_numpy()
            marked = asked.value[places >> 3] >> (places & 7).astype(np.uint8) & 1
            for s in shingle_sets(b.column(0).filter(pa.array(marked == 1)).to_pylist()):
                node = set_hash(s) if len(s) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    new[node] = s.tobytes()
            yield pa.RecordBatch.from_pydict({"node": pa.array(list(new), pa.int64()), "shingles": pa.array(list(new.values()), pa.binary())})

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(v, "<u8") for v in b.column(2).to_pylist()]
            y = [np.frombuffer(v, "<u8") for v in b.column(3).to_pylist()]
            ok = []
            for s, t in zip(x, y, strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= 80 * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    texts = rows.where("doc_id is not null").select("text", _mark("doc_id").alias("mark"))
    full = scratch.keep(texts.mapInArrow(build, "node long, shingles binary"), f"{name}-full")
    with_a = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = with_a.join(full.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    good = both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")
    rep = reps.where("doc_id is not null")
    links = (good.join(rep.select(F.col("node").alias("a"), F.col("doc_id").alias("da")), "a")
             .join(rep.select(F.col("node").alias("b"), F.col("doc_id").alias("db")), "b"))
    out = scratch.keep(links.select(F.col("da").alias("a"), F.col("db").alias("b")), f"{name}-links")
    for done in ("full", "reps", "near"):
        scratch.drop(f"{name}-{done}")
    return out


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "rtree")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = _sets_and_frequent(rows, scratch)
    sets = found.where(~F.col("shingle")).select("doc_id", "n", "node", "unit", "fine")

    often = (found.where("shingle").groupBy("node").agg(F.sum("n").alias("n"))
             .orderBy(F.desc("n"), "node").limit(FREQUENT).collect())  # FREQUENT rows at most
    keys = np.array([r.node for r in often], np.int64).view(np.uint64)
    by = np.argsort(keys)
    classes = np.array([max(1, int(r.n).bit_length()) for r in often], np.int64)
    frequent = spark.sparkContext.broadcast((keys[by], classes[by]))

    n_parts = shuffle_partitions(spark)
    first = scratch.keep(_file_points(rows, frequent, n_parts).repartitionById(n_parts, F.col("part")).mapInArrow(_first_pairs, _PAIRS), "first")
    pairs = scratch.keep(first.where("b is not null").select("a", "b").distinct(), "pairs")
    known = scratch.keep(sets.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "known")
    links = _verified(pairs, rows, sets, scratch, "v1")
    groups = scratch.keep(components(links, scratch, "c1"), "groups1")

    # large files again: sets of different components, by the tree
    large = first.where("b is null").select(F.col("a").alias("node"), "key", "n", "place", "file", "least")
    if not large.isEmpty():
        labels = known.join(groups, F.col("rep") == F.col("v"), "left").select("node", F.coalesce("c", "rep").alias("label"))
        labelled = scratch.keep(large.join(labels, "node"), "labelled")
        mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        mixed = scratch.keep(labelled.join(mixed, "key"), "mixed")
        scratch.drop("labelled")
        points = (sets.join(mixed.select("node").distinct(), "node").groupBy("node")
                  .agg(F.first("unit").alias("unit"), F.first("fine").alias("fine")))
        dealt = (mixed.join(points, "node").withColumn("blocks", F.ceil(F.col("file") / BLOCK).cast("int"))
                 .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other"))
                 .withColumn("salt", F.pmod(F.xxhash64("key"), F.ceil(F.col("file") / SALT)).cast("int"))
                 .select("key", "b1", "b2", "salt", "least", "block", "node", "n", "place", "label", "unit", "fine"))
        more = (dealt.repartition(n_parts, "least", "b1", "b2", "salt").sortWithinPartitions("key", "b1", "b2")
                .mapInArrow(_tree_pairs, "a long, b long").distinct())
        more = scratch.keep(more.join(pairs, ["a", "b"], "left_anti"), "more")
        links2 = _verified(more, rows, sets, scratch, "v2")
        groups = scratch.keep(components(links.union(links2), scratch, "c2"), "groups2")
    return (sets.select("doc_id", "n", "node").join(known, "node", "left").join(groups, F.col("rep") == F.col("v"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "rep", "doc_id")).alias("component_id")))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each group: the one with the smallest id."""
    gone = (near_groups(df, id_col, text_col).where("component_id <> doc_id")
            .select(F.col("doc_id").alias(id_col)).distinct())
    return df.join(gone, id_col, "left_anti")


def op7_rtree(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_groups(table(spark, sf_dir, "documents"))
