"""Exact k-nearest retrieval by squared L2 distance.

Items are dealt over shards of bounded bytes by a hash of their id; questions are packed into blocks
of ``_QUESTIONS`` rows, and every block goes to every shard (a stated set of questions against all
items) as one row. An item crosses the network once, and the plan holds no block numbers. A task
builds its shard's index from the rows that come first and then answers the blocks that follow: at
most k rows per question leave it. The final ``row_number() <= k`` per question plans as a partial
WindowGroupLimit before the shuffle.

Sparse vectors are answered from inverted lists: each term has its postings, cut by blocks of
items, and the largest weight of each block and of each group of blocks. Summed over a question's
terms these weights bound the dot product of any item of a block. All questions of a block are answered
together, group by group: each question's most promising group first, then those that can still reach
its k-th pair of distance and id. In a group either the blocks are bounded in turn and their postings summed
(few terms a question), or all its items are scored, with the terms that many of the questions and items have as
a product of matrices and the others from their postings.
Nothing is left out: a block is passed over only if its bound is beyond that distance or, at that
distance (told apart at 9 decimals), all its ids are larger. So a question whose terms are in nearly
every item, and all whose distances are equal at 9 decimals, scores a few blocks, not all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of dense and of sparse vectors in a shard. Smaller sets of items are dealt over the tasks that can run, with
#: SHARD_LEAST items each at least.
SHARD_BYTES, SPARSE_BYTES, SHARD_LEAST = 64 << 20, 96 << 20, 1024
#: What a sparse vector and each of its entries count as.
ITEM_BYTES, ENTRY_BYTES = 64, 32
#: Items in a block of the inverted lists, and blocks in a group.
BLOCK, GROUP = 32, 32
_SUB_ROWS = 1024            # items scored at once inside a task (at most)
_SUB_CELLS = 1 << 21        # item x question distances held at once (16 MB of doubles)


def _top_k(pairs: DataFrame, qkey: list[str], ckey: str, k: int) -> DataFrame:
    # ulp noise between engines must not reorder equal distances: order on 9 decimals
    w = Window.partitionBy(*qkey).orderBy(F.round("distance", 9), F.col(ckey))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sub_rows(n_questions: int) -> int:
    """Items per scoring block, so the block's distance matrix stays within _SUB_CELLS."""
    return max(1, min(_SUB_ROWS, _SUB_CELLS // max(1, n_questions)))


def _smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest distances, rounded to 9 decimals, of every column; ties go
    to the earlier row; at most k rows per column, even when all tie."""
    n = len(d)
    if n <= k:
        rows, cols = np.nonzero(np.ones_like(d, bool))
        return rows, cols
    rd = np.round(d, 9)
    kth = np.partition(rd, k - 1, axis=0)[k - 1]
    less, same = rd < kth, rd == kth
    room = k - less.sum(axis=0)
    return np.nonzero(less | (same & (np.cumsum(same, axis=0) <= room)))


class _Best:
    """The k nearest items of every question of a block, over the item blocks seen so far."""

    def __init__(self, k: int):
        self.k, self.q, self.d, self.ids = k, np.empty(0, np.int64), np.empty(0), []

    def add(self, q: np.ndarray, d: np.ndarray, ids: list) -> None:
        q, d, ids = np.concatenate((self.q, q)), np.concatenate((self.d, d)), np.array(self.ids + ids, dtype=object)
        order = sorted(range(len(q)), key=lambda i: (q[i], round(d[i], 9), ids[i])) if len(q) < 64 else \
            np.lexsort((np.unique(ids, return_inverse=True)[1], np.round(d, 9), q))
        q, d, ids = q[order], d[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = place < self.k
        self.q, self.d, self.ids = q[keep], d[keep], ids[keep].tolist()


# ---- dealing ---------------------------------------------------------------------------

def _nearest(items: DataFrame, questions: DataFrame, qkey: list[str], ckey: str, k: int, width: Column, shard_of,
             shard_bytes: int, size_of: tuple[int, int] | None = None) -> DataFrame:
    """(qkey..., ckey, distance, rank). ``items`` (ckey, vec) and ``questions`` (qkey..., vec);
    ``width``: bytes of an item's vector; ``shard_of(ids, vecs)`` gives an object whose
    ``search(vecs, k)`` yields (question places, item places, distances). It also gets the
    questions' ``norm2``, if they have that column. ``size_of``: number and bytes of the items, if
    they are known; else the items are read for them. Sparse vectors cross the network as their
    joined terms and their weights, which takes less than a struct an entry."""
    spark = items.sparkSession
    n, size = size_of or items.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    shards = max(1, -(-size // shard_bytes), min(tasks, n // SHARD_LEAST))   # more would answer every question once more each
    keys = [f"__q{i}" for i in range(len(qkey))]
    left = items.select(F.pmod(F.xxhash64(ckey), F.lit(shards)).cast("int").alias("__shard"), F.lit(False).alias("__asked"),
                        F.col(ckey).alias("__c"), *_packed(items))
    right = _in_blocks(questions, qkey).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("__shard"),
                                               F.lit(True).alias("__asked"), "__block")
    dealt = (left.unionByName(right, allowMissingColumns=True).repartitionById(shards, F.col("__shard"))
             .sortWithinPartitions("__asked", "__c").select("__asked", "__c", "__terms", "__w", "__block"))
    schema = T.StructType([*(questions.schema[c] for c in qkey), items.schema[ckey], T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for b in batches:
            own = b.num_rows - pc.sum(b.column(0)).as_py()   # items come first
            if own:
                held.append(b.slice(0, own).select([1, 2, 3]))
            if own == b.num_rows or not held:
                continue
            if shard is None:
                t = pa.Table.from_batches(held)
                ids, vecs = t.column(0).combine_chunks(), _unpacked(t.column(1).combine_chunks(), t.column(2).combine_chunks())
                held, t = [None], None      # what was read is not kept beside the index
                shard = shard_of(ids, vecs)
                del ids, vecs
            for block in b.column(4).slice(own):
                with pa.ipc.open_stream(block.as_buffer()) as stream:
                    asked = stream.read_next_batch()
                q, c, d = shard.search(asked.column("vec"), k, *[asked.column("norm2") for _ in ("norm2",) if "norm2" in asked.schema.names])
                if len(q):
                    at = pa.array(q)
                    yield pa.RecordBatch.from_arrays([*(asked.column(x).take(at) for x in keys),
                                                      shard.ids.take(pa.array(c)), pa.array(d)], schema=arrow)

    arrow = _arrow_schema(schema)
    return _top_k(dealt.mapInArrow(run, schema), qkey, ckey, k)


def _in_blocks(questions: DataFrame, qkey: list[str]) -> DataFrame:
    """(__block): the questions of a task in blocks of ``_QUESTIONS`` rows, each one Arrow stream of (__q0..., vec,
    [norm2]). A block's terms stand in it once, as a dictionary."""
    more = ["norm2"] if "norm2" in questions.columns else []
    keys = [f"__q{i}" for i in range(len(qkey))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            for i in range(0, b.num_rows, _QUESTIONS):
                part = b.slice(i, _QUESTIONS)
                if rows + part.num_rows > _QUESTIONS:
                    yield block(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        vec = _unpacked(t.column(0).combine_chunks(), t.column(1).combine_chunks())
        if pa.types.is_struct(vec.type.value_type):
            flat = vec.flatten()
            entries = pa.StructArray.from_arrays([flat.field("term").dictionary_encode(), flat.field("w")], ["term", "w"])
            vec = pa.ListArray.from_arrays(vec.offsets, entries)
        out = pa.RecordBatch.from_arrays([*(t.column(2 + j).combine_chunks() for j in range(len(keys) + len(more))), vec], names=[*keys, *more, "vec"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(out)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["__block"])

    return questions.select(*_packed(questions), *[F.col(c).alias(q) for c, q in zip(qkey, keys, strict=True)], *more).mapInArrow(run, "__block binary")


_APART = "\0"               # between the terms of a vector: no term holds it


def _packed(df: DataFrame) -> tuple[Column, Column]:
    """(__terms, __w) of the column ``vec``; dense vectors have no terms."""
    if df.schema["vec"].dataType == T.ArrayType(T.DoubleType()):
        return F.lit(None).cast("string").alias("__terms"), F.col("vec").alias("__w")
    return F.array_join("vec.term", _APART).alias("__terms"), F.col("vec.w").cast("array<double>").alias("__w")


def _unpacked(terms: pa.Array, w: pa.Array) -> pa.Array:
    """The vectors again, as list columns of structs or (without terms) of doubles."""
    if terms.null_count == len(terms) and pc.max(pc.fill_null(pc.list_value_length(w), 0)).as_py():
        return w
    w = pc.fill_null(w, pa.scalar([], w.type)) if w.null_count else w
    lens = pc.list_value_length(w).to_numpy(zero_copy_only=False)
    flat = pc.split_pattern(terms.filter(pa.array(lens > 0)), _APART).flatten()
    entries = pa.StructArray.from_arrays([flat.cast(pa.string()), w.flatten()], ["term", "w"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), entries)


#: Questions answered at once in a task, and of these in a product of matrices.
_QUESTIONS, _TOGETHER = 4096, 1024


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# ---- sparse vectors --------------------------------------------------------------------

def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (counts[i] of them), one after another."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def _flat(vecs: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(entries per vector, terms, weights) of a list column; a null vector has none."""
    lens = pc.fill_null(pc.list_value_length(vecs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vecs.flatten()
    return lens, flat.field("term"), flat.field("w").to_numpy(zero_copy_only=False).astype(np.float64)


class InvertedShard:
    """Inverted lists of sparse vectors (ids ascending), cut by blocks of ``BLOCK`` items, with the
    largest weight of each term in each block and in each group of ``GROUP`` blocks. Weights must not
    be negative. ``scored`` counts the pairs of question and item whose distance was taken."""

    def __init__(self, ids: pa.Array, vecs: pa.Array, block: int = BLOCK, group: int = GROUP):
        self.block, self.size, self.scored = block, block * group, 0
        lens, terms, w = _flat(vecs)
        if len(w) and w.min() < 0:
            raise ValueError("negative weights")
        n = len(ids)
        coded = terms.dictionary_encode() if len(terms) else pa.array([], pa.string()).dictionary_encode()
        self.terms = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
        term, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), lens)
        del coded, terms
        cn = np.bincount(row, w * w, minlength=n)
        order = _alike(term, row, w, lens, len(self.terms))
        self.ids, self.n, self.by_id, self.cn = ids.take(pa.array(order)), n, order, cn[order]
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        row = place[row]
        self.groups = -(-n // self.size)
        # postings by group, term and row
        key = ((row // self.size).astype(np.int64) * max(1, len(self.terms)) + term) * self.size
        key += row % self.size
        by = np.argsort(key, kind="stable").astype(np.int32)
        term, row, w = term[by], row[by], w[by]
        same, _ = _runs(key[by])                  # an item's entries of one term are one posting
        del key, by
        term, self.row, self.w = term[same], row[same], np.add.reduceat(w, same) if len(w) else w
        del row, w, same
        at = np.arange(0, n, block)
        self.least_cn = np.minimum.reduceat(self.cn, at) if n else np.empty(0)
        self.least_id = np.minimum.reduceat(self.by_id, at) if n else np.empty(0, np.int64)
        at = np.arange(0, n, self.size)
        self.group_cn = np.minimum.reduceat(self.cn, at) if n else np.empty(0)
        self.group_id = np.minimum.reduceat(self.by_id, at) if n else np.empty(0, np.int64)
        # a cell: the postings of a term in a block; a lot: its cells in a group of blocks
        lot = (self.row // self.size).astype(np.int64) * max(1, len(self.terms)) + term
        self.start, self.count = (x.astype(np.int32) for x in _runs(lot * group + self.row % self.size // block))
        self.top = np.maximum.reduceat(self.w, self.start) if len(term) else np.empty(0)
        self.of_block = self.row[self.start] // block
        self.lot_start, self.lot_cells = _runs(lot[self.start])
        del lot
        self.lot_top = np.maximum.reduceat(self.top, self.lot_start) if len(term) else np.empty(0)
        self.lot_post = self.start[self.lot_start]
        self.lot_count = np.diff(np.append(self.lot_post, len(self.row)))
        self.lot_term = term[self.lot_post]
        self.first_lot = np.searchsorted(self.row[self.lot_post] // self.size, np.arange(self.groups + 1))
        self.plain = np.lexsort((order, np.round(self.cn, 9)))   # nearest first to what shares no term

    def search(self, vecs: pa.Array, k: int, norms: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question places, item places, distances), nearest first. ``norms``: squared norms of the
        questions, if ``vecs`` leave out terms that no item has."""
        lens, terms, w = _flat(vecs)
        if len(w) and w.min() < 0:
            raise ValueError("negative weights")
        nq, k = len(lens), min(k, self.n)
        if not k or not nq:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        coded = terms if pa.types.is_dictionary(terms.type) else terms.dictionary_encode()
        known = np.array([self.terms.get(t, -1) for t in coded.dictionary.to_pylist()] or [-1], np.int64)
        term, q = known[coded.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(nq), lens)
        qn = np.bincount(q, w * w, minlength=nq)
        if norms is not None:
            own = norms.to_numpy(zero_copy_only=False).astype(np.float64)
            qn = np.where(np.isnan(own), qn, own)
        here = term >= 0
        by = np.lexsort((term[here], q[here]))
        q, term, w = q[here][by], term[here][by], w[here][by]
        one, _ = _runs(q * max(1, len(self.terms)) + term)    # a question's entries of one term count together
        asked = _Asked(q[one], term[one], np.add.reduceat(w, one) if len(w) else w, qn, k)
        # without common terms the distance is qn + cn: k of these are known, and bound the k-th
        asked.places[:] = self.plain[:k]
        asked.distances[:] = qn[:, None] + self.cn[self.plain[:k]]
        asked.ids[:] = self.by_id[self.plain[:k]]
        bound, lots = np.zeros((self.groups, nq)), np.full(max(1, len(self.terms)), -1)
        for g in range(self.groups):
            e, lot = self._lots(g, asked, None, lots)
            bound[g] = np.bincount(asked.q[e], asked.w[e] * self.lot_top[lot], minlength=nq)
        near = np.round(qn + self.group_cn[:, None] - 2 * bound - _SLACK, 9)
        near[bound <= 0] = np.inf
        best = np.argmin(near, 0)
        for first in (True, False):       # each question's nearest group, then all that can reach its k-th pair
            for g in range(self.groups):
                left = _reach(near[g], self.group_id[g], asked.kth()) & (near[g] < np.inf) & ((best == g) == first)
                left = np.flatnonzero(left)
                for i in range(0, len(left), _TOGETHER):
                    self._group(g, left[i:i + _TOGETHER], asked, lots)
        return np.repeat(np.arange(nq), k), asked.places.ravel(), asked.distances.ravel()

    def _lots(self, g: int, asked: _Asked, those: np.ndarray | None, lots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, lots) of the entries (of the questions ``those``) whose term the group has."""
        a, b = self.first_lot[g], self.first_lot[g + 1]
        lots[self.lot_term[a:b]] = np.arange(a, b)
        e = np.arange(len(asked.q)) if those is None else _spread(asked.first[those], asked.first[those + 1] - asked.first[those])
        lot = lots[asked.term[e]]
        lots[self.lot_term[a:b]] = -1
        has = lot >= 0
        return e[has], lot[has]

    def _group(self, g: int, those: np.ndarray, asked: _Asked, lots: np.ndarray) -> None:
        """The items of a group for the questions ``those`` (ascending), which take what comes before their k-th pair."""
        e, lot = self._lots(g, asked, those, lots)
        weight, place = asked.w[e], np.searchsorted(those, asked.q[e])
        used, at = np.unique(lot, return_inverse=True)
        often, rows = np.bincount(at, minlength=len(used)), self.lot_count[used]
        many = often * rows > self.size * len(those) * _PRODUCT
        if (often * self.lot_cells[used]).sum() < _CELLS * len(those) * self.size:
            self._by_blocks(g, those, asked, lot, weight, place)
        else:
            self._at_once(g, those, asked, (used, at, many), lot, weight, place)

    def _by_blocks(self, g, those, asked, lot, weight, place):
        """Blocks that reach the k-th pair, a question's nearest first: their postings are summed."""
        group = self.size // self.block
        many = self.lot_cells[lot]
        cells, weight, place = _spread(self.lot_start[lot], many), np.repeat(weight, many), np.repeat(place, many)
        at = place * group + self.of_block[cells] - g * group
        bound = np.bincount(at, weight * self.top[cells], minlength=len(those) * group)
        real = np.flatnonzero(bound > 0)
        q, block = those[real // group], g * group + real % group
        near = np.round(asked.norms[q] + self.least_cn[block] - 2 * bound[real] - _SLACK, 9)
        distance, last = asked.kth()
        left = np.flatnonzero(_reach(near, self.least_id[block], (distance[q], last[q])))
        left = left[np.lexsort((self.least_id[block[left]], near[left], q[left]))]
        first, counts = _runs(q[left])
        rank = np.arange(len(left)) - np.repeat(first, counts)
        slot = np.full(len(bound), -1)
        for a, b in _STEPS:
            now = left[(rank >= a) & (rank < b)]
            now = now[_reach(near[now], self.least_id[block[now]], (distance[q[now]], last[q[now]]))]
            if not len(now):
                continue
            slot[real[now]] = np.arange(len(now))
            mine = np.flatnonzero(slot[at] >= 0)
            many = self.count[cells[mine]]
            post = _spread(self.start[cells[mine]], many)
            dots = np.bincount(np.repeat(slot[at[mine]], many) * self.block + self.row[post] % self.block,
                               np.repeat(weight[mine], many) * self.w[post], minlength=len(now) * self.block)
            slot[real[now]] = -1
            rows, of = (block[now][:, None] * self.block + np.arange(self.block)).ravel(), np.repeat(q[now], self.block)
            inside = rows < self.n
            rows, of, dots = rows[inside], of[inside], dots[inside]
            self.scored += len(rows)
            asked.take(of, rows, asked.norms[of] + self.cn[rows] - 2.0 * dots, self.by_id[rows])

    def _at_once(self, g, those, asked, terms, lot, weight, place):
        """Items of the whole group that may come before the k-th pair: all are scored."""
        used, at, many = terms
        n = min(self.size, self.n - g * self.size)
        dense, column = used[many], np.cumsum(many) - 1
        x, y = np.zeros((len(those), len(dense))), np.zeros((len(dense), n))
        counts = self.lot_count[dense]
        post = _spread(self.lot_post[dense], counts)
        y[np.repeat(np.arange(len(dense)), counts), self.row[post] - g * self.size] = self.w[post]
        mine = many[at]
        x[place[mine], column[at[mine]]] = weight[mine]
        score = x @ y
        lot, weight, place = lot[~mine], weight[~mine], place[~mine]
        flat, ends = score.ravel(), np.append(0, np.cumsum(self.lot_count[lot]))
        for i in range(0, len(lot), _ENTRIES):      # bounded, whatever the lists' length
            part = slice(i, i + _ENTRIES)
            counts = self.lot_count[lot[part]]
            post = _spread(self.lot_post[lot[part]], counts)
            np.add.at(flat, np.repeat(place[part] * n - g * self.size, counts) + self.row[post], np.repeat(weight[part], counts) * self.w[post])
        self.scored += score.size
        score *= 2.0
        score -= self.cn[g * self.size:g * self.size + n]
        qn = asked.norms[those]
        least = qn - asked.kth()[0][those] - _ROUNDED     # a smaller score is beyond the k-th distance
        part = _GROUPED if n % _GROUPED == 0 else 1
        largest = score.reshape(len(those), part, n // part).max(1)     # of every n / part-th item
        if largest.shape[1] >= asked.k:
            at_kth = largest.shape[1] - asked.k
            least = np.maximum(least, np.partition(largest, at_kth, 1)[:, at_kth] - _ROUNDED)
        q, column = np.nonzero(largest >= least[:, None])
        columns = column[:, None] + np.arange(part) * (n // part)
        values = score[q[:, None], columns]
        i, j = np.nonzero(values >= least[q][:, None])
        q, rows = q[i], g * self.size + columns[i, j]
        asked.take(those[q], rows, qn[q] - values[i, j], self.by_id[rows])


class _Asked:
    """A block of questions: their entries (by question), squared norms, and the k nearest items found so far,
    sorted by (distance at 9 decimals, id)."""

    def __init__(self, q: np.ndarray, term: np.ndarray, w: np.ndarray, norms: np.ndarray, k: int):
        self.q, self.term, self.w, self.norms, self.k = q, term, w, norms, k
        self.first = np.searchsorted(q, np.arange(len(norms) + 1))
        self.places, self.ids = np.empty((len(norms), k), np.int64), np.empty((len(norms), k), np.int64)
        self.distances = np.empty((len(norms), k))

    def kth(self) -> tuple[np.ndarray, np.ndarray]:
        """(distances at 9 decimals, ids) of the k-th pairs; kept up to date."""
        if self._kth is None:
            self._kth = np.round(self.distances[:, -1], 9), self.ids[:, -1].copy()
        return self._kth

    _kth = None

    def take(self, q: np.ndarray, places: np.ndarray, distances: np.ndarray, ids: np.ndarray) -> None:
        """Merges found items into the nearest of their questions. One that is there already, with the distance
        it has without common terms, comes again with its own, which is not larger."""
        distance, last = self.kth()
        rounded = np.round(distances, 9)
        good = (rounded < distance[q]) | ((rounded == distance[q]) & (ids <= last[q]))
        q, places, distances, ids, rounded = q[good], places[good], distances[good], ids[good], rounded[good]
        if not len(q):
            return
        touched = np.unique(q)
        q = np.concatenate((q, np.repeat(touched, self.k)))
        places, ids = (np.concatenate((new, old[touched].ravel())) for new, old in ((places, self.places), (ids, self.ids)))
        distances = np.concatenate((distances, self.distances[touched].ravel()))
        rounded = np.concatenate((rounded, np.round(self.distances[touched], 9).ravel()))
        by = np.lexsort((rounded, ids, q))    # ids are those of places: the nearer of two
        one, _ = _runs(q[by] * (int(ids.max()) + 1) + ids[by])
        by = by[one]
        by = by[np.lexsort((ids[by], rounded[by], q[by]))]
        q = q[by]
        first, counts = _runs(q)
        rank = np.arange(len(q)) - np.repeat(first, counts)
        near = rank < self.k
        by, q, rank = by[near], q[near], rank[near]
        self.places[q, rank], self.distances[q, rank], self.ids[q, rank] = places[by], distances[by], ids[by]
        distance[touched], last[touched] = np.round(self.distances[touched, -1], 9), self.ids[touched, -1]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal keys."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


def _reach(near: np.ndarray, least: np.ndarray, kth: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (near < kth[0]) | ((near == kth[0]) & (least <= kth[1]))


def _alike(term: np.ndarray, row: np.ndarray, w: np.ndarray, lens: np.ndarray, n_terms: int) -> np.ndarray:
    """The rows in an order that puts like vectors side by side, so the bounds of their blocks are
    tight: by their most frequent terms, then by length and by the weights of these terms."""
    n, often = len(lens), np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")
    rank = np.empty(n_terms, np.int32)
    rank[often] = np.arange(n_terms)
    by = np.lexsort((rank[term], row)).astype(np.int32)
    ends = np.cumsum(lens)
    first, weight = np.full((_LEADING, n), n_terms), np.zeros(n)
    for i in range(_LEADING):
        has = np.flatnonzero(lens > i)
        at = by[(ends - lens)[has] + i]
        first[i, has] = rank[term[at]]
        weight[has] += w[at]
    return np.lexsort((np.arange(n), -weight, lens, *first[::-1]))


#: The most frequent terms of an item that place it in the shard.
_LEADING = 24
_SLACK = 1e-12              # above the rounding errors of a bound
_ROUNDED = 2e-9             # scores that differ by more differ at 9 decimals, too
#: Share of question-item pairs with a posting from which a term stands in the product of matrices, and cells a pair
#: up to which bounding the blocks costs less than it saves (both measured).
_PRODUCT, _CELLS = 1 / 256, 5 / 32
_ENTRIES, _GROUPED = 1 << 14, 32   # entries whose postings are summed at once; parts of a group looked at together
_STEPS = ((0, 1), (1, 4), (4, 1 << 62))   # a question's blocks in a group, by rank, scored between two looks at its k-th pair


def nearest_sparse(chunks: DataFrame, qvecs: DataFrame, qkey: list[str], k: int = 5,
                   ckey: str = "chunk_id", shard_bytes: int = SPARSE_BYTES, size_of: tuple[int, int] | None = None) -> DataFrame:
    """(qkey..., chunk_id, distance, rank) for sparse vectors without negative weights; ``chunks``
    is (chunk_id, vec) with zero vectors as empty arrays. distance = |q|^2 + |c|^2 - 2 q.c. With a
    column ``norm2`` (|q|^2) the questions may leave out terms that no chunk has. ``size_of``: number of
    chunks and of their entries, if known."""
    sizes = size_of and (size_of[0], ITEM_BYTES * size_of[0] + ENTRY_BYTES * size_of[1])
    width = F.lit(ITEM_BYTES) + F.lit(ENTRY_BYTES) * F.size(F.coalesce("vec", F.array().cast(chunks.schema["vec"].dataType)))
    return _nearest(chunks.select(ckey, "vec"), qvecs.select(*qkey, "vec", *[c for c in qvecs.columns if c == "norm2"]), qkey, ckey, k, width, InvertedShard, shard_bytes, sizes)


# ---- dense vectors ---------------------------------------------------------------------

def _matrix(vecs: pa.Array) -> np.ndarray:
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), -1)


class DenseShard:
    """Dense vectors (ids ascending), scored by blocks of matrix products."""

    def __init__(self, ids: pa.Array, vecs: pa.Array):
        self.ids, self.x = ids, _matrix(vecs)
        self.cn = (self.x * self.x).sum(axis=1)

    def search(self, vecs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = _matrix(vecs)
        qn, best, sub = (q * q).sum(axis=1), _Best(k), _sub_rows(len(q))
        for start in range(0, len(self.x), sub):
            d = self.cn[start:start + sub, None] + qn[None, :] - 2.0 * (self.x[start:start + sub] @ q.T)
            i, j = _smallest(d, k)
            best.add(j, d[i, j], (start + i).tolist())
        return best.q, np.array(best.ids, np.int64), best.d


def nearest_dense(items: DataFrame, queries: DataFrame, qkey: list[str], k: int = 5, ikey: str = "vec_id",
                  vec: str = "embedding", qvec: str = "qvec", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(qkey..., ikey, distance, rank): exact squared L2 top-k of dense vectors of one length."""
    return _nearest(items.select(ikey, F.col(vec).cast("array<double>").alias("vec")),
                    queries.select(*qkey, F.col(qvec).cast("array<double>").alias("vec")), qkey, ikey, k,
                    F.lit(64) + F.lit(8) * F.size("vec"), DenseShard, shard_bytes)


def centroids(items: DataFrame, group: str, vec: str = "embedding", out: str = "qvec") -> DataFrame:
    """Mean vector per group: per-dimension averages, partially aggregated."""
    per_dim = (items.select(group, F.posexplode(vec).alias("i", "x"))
               .groupBy(group, "i").agg(F.avg("x").alias("m")))
    return per_dim.groupBy(group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias(out))
