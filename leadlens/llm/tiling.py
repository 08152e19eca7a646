"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become sequences of word hashes (letters and digits, lower case). Runs
of ``min_match`` words shared with an item (seeds) are found by Karp-Rabin fingerprints of all
runs of a text, looked up among the items' fingerprints. For each text and item with a seed, the
longest common runs are marked as tiles first, overlapping ones cut to what is still free, down to
``min_match`` words. The tiles cover a share of the item's words however its parts are ordered;
from ``threshold`` on, the text counts as contaminated by the item.

The benchmark is a query set of any size against all texts, in blocks: each block is broadcast
behind a bound on its bytes, and the texts are read once per block.

A null text or item counts as empty and matches nothing. An item with fewer than ``min_match``
words must occur whole. Repeated rows and repeated items are judged one by one. An empty table on
either side gives no pairs. Columns of the same name as the result's do no harm: only the named
id and text columns are read (``decontaminate`` returns all columns as they came).
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import ALNUM, Scratch, mix64, prepare, table, text_of, word_hashes, words_of, worker_cache

MIN_MATCH, THRESHOLD = 4, 0.6
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 4 << 20
_KR = np.uint64(0x9FB21C651E98DF25)


def _word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the number of words before each text."""
    data, starts, ends, first = words_of([(t or "").lower().encode() for t in texts], ALNUM)
    return word_hashes(data, starts, ends), first


def karp_rabin(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprint of every run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _KR + words[j:j + n]
    return mix64(out)


class Block:
    """Items of a block: their words, and where each fingerprint occurs in them, by run length."""

    def __init__(self, items: list[tuple[object, str | None]], min_match: int):
        self.ids = [i for i, _ in items]
        words, first = _word_ids([t for _, t in items])
        self.words = [words[first[i]:first[i + 1]] for i in range(len(items))]
        self.sizes = [min(min_match, len(w)) for w in self.words]
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, (w, k) in enumerate(zip(self.words, self.sizes, strict=True)):
            if k:
                for i, h in enumerate(karp_rabin(w, k).tolist()):
                    self.places.setdefault(k, {}).setdefault(h, []).append((item, i))
        self.sorted = {k: np.array(sorted(p), np.uint64) for k, p in self.places.items()}

    @classmethod
    def of(cls, sent: tuple[str, list, int]) -> Block:
        """The block of a broadcast (key, items, min_match), built once per worker."""
        key, items, min_match = sent
        cache = worker_cache()
        if cache.get("block", (None,))[0] != key:
            cache["block"] = (key, cls(items, min_match))
        return cache["block"][1]

    def seeds(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(place, item, place in the item, run length) of the seeds in a sequence of words."""
        for k, known in self.sorted.items():
            prints = karp_rabin(words, k)
            if not len(prints):
                continue
            at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
            for j in np.flatnonzero(known[at] == prints).tolist():
                for item, i in self.places[k][int(prints[j])]:
                    yield j, item, i, k


def tile(seeds: list[tuple[int, int]], k: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the text, words) from seeds (item place, text
    place) of k words: the longest first, each word of either side in one tile at most."""
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for i, j in seeds:
        by_diagonal[j - i].append(i)
    queue: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for diagonal, places in by_diagonal.items():
        places.sort()
        begin = last = places[0]
        for i in [*places[1:], None]:
            if i is None or i != last + 1:
                queue[last - begin + k].append((begin, begin + diagonal))
                begin = i
            last = i
    tiles, item_used, text_used = [], np.zeros(n_item, bool), set()
    for size in range(max(queue, default=0), k - 1, -1):
        for i, j in sorted(queue.pop(size, ())):
            free = [not item_used[i + x] and j + x not in text_used for x in range(size)]
            if all(free):
                tiles.append((i, j, size))
                item_used[i:i + size] = True
                text_used.update(range(j, j + size))
                continue
            x = 0
            while x < size:  # what is free of an overlapped match waits for its own length's turn
                y = x
                while y < size and free[y]:
                    y += 1
                if y - x >= k:
                    queue[y - x].append((i + x, j + x))
                x = y + 1
        if item_used.all():
            break
    return sorted(tiles)


def _matches(words: np.ndarray, block: Block, threshold: float) -> Iterator[tuple[int, int, list]]:
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for j, item, i, _ in block.seeds(words):
        found[item].append((i, j))
    for item, seeds in sorted(found.items()):
        tiles = tile(seeds, block.sizes[item], len(block.words[item]))
        covered = sum(t[2] for t in tiles)
        if covered >= threshold * len(block.words[item]):
            yield item, covered, tiles


def _blocks(benchmark: DataFrame, min_match: int, block_bytes: int, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """The items, broadcast in blocks of about ``block_bytes`` of text (a longer item is its own)."""
    items = benchmark.select(F.col(id_col).alias("item"), text_of(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in part.collect()], min_match))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH,
                       block_bytes: int = BLOCK_BYTES, doc_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_words and n_covered of the item, coverage, tiles (item_start, doc_start,
    words) of every text and item from ``threshold`` on."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_kind, item_kind = rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = (f"doc_id {doc_kind}, item_id {item_kind}, n_words long, n_covered long, coverage double, "
              "tiles array<struct<item_start:int,doc_start:int,words:int>>")
    out, scratch = None, None
    for sent in _blocks(benchmark, min_match, block_bytes, item_col, item_text_col):
        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Block.of(sent.value)
            for b in batches:
                words, first = _word_ids(b.column(1).to_pylist())
                got = [(d, *m) for d in range(b.num_rows) for m in _matches(words[first[d]:first[d + 1]], block, threshold)]
                if got:
                    docs_, items, covered, tiles = zip(*got, strict=True)
                    n = [len(block.words[i]) for i in items]
                    kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": b.column(0).take(pa.array(docs_)), "item_id": [block.ids[i] for i in items],
                        "n_words": n, "n_covered": list(covered), "coverage": [c / m for c, m in zip(covered, n, strict=True)],
                        "tiles": pa.array([[dict(zip(("item_start", "doc_start", "words"), t, strict=True)) for t in ts] for ts in tiles], kind)})

        got = rows.mapInArrow(match, schema)
        if out is None:
            out = got
            continue
        if scratch is None:
            scratch = Scratch(spark, "tiling")
            out.write.parquet(scratch.path("pairs"))
        got.write.mode("append").parquet(scratch.path("pairs"))
        out = spark.read.schema(schema).parquet(scratch.path("pairs"))
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH,
                  block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an item contaminates."""
    at = docs.columns.index(text_col)
    prepare(docs.sparkSession)
    for sent in _blocks(benchmark, min_match, block_bytes, item_col, item_text_col):
        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = Block.of(sent.value)
            for b in batches:
                words, first = _word_ids(b.column(at).to_pylist())
                clean = [next(_matches(words[first[d]:first[d + 1]], block, threshold), None) is None for d in range(b.num_rows)]
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op4_tiling(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items: one row per document and item, with the tiled share."""
    pairs = contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_words", "n_covered", "coverage", F.size("tiles").cast("long").alias("n_tiles"))
