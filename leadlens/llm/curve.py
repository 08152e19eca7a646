"""Packing along a space-filling curve.

Each text's hashed word vector (a sign per word and dimension, summed) is projected to a few
dimensions and placed on a Hilbert curve. Documents are range-sorted by curve position, so
neighbours have like words, and their ids are laid end to end along the curve and cut every
``length`` ids. What is left at the end of a range is cut into powers of two, so no sequence
needs padding.

Copies share a position; ties are spread by a hash of the id, so a large group of copies is
split between tasks. A null or empty text has the end id only and lies mid-curve. Repeated rows
are packed once each. An empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import mix64, shuffle_partitions, table, text_of, word_hashes, words_of
from leadlens.llm.tokens import Encoder, tokenizer_path

DIMENSIONS, BITS = 4, 8
_TIE_BITS = 63 - DIMENSIONS * BITS


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of a (rows, dimensions) array of integers in
    [0, 2^bits), by Skilling's transpose method."""
    x = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ flip) >> b & 1)
    return out


def curve_keys(texts: list[str]) -> np.ndarray:
    """Curve position of each text (DIMENSIONS x BITS bits)."""
    data, starts, ends, first = words_of([t.encode() for t in texts])
    h = word_hashes(data, starts, ends)
    counts = np.diff(first)
    points = np.empty((len(texts), DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        total = np.concatenate(([0], np.cumsum(((h >> np.uint64(d)) & np.uint64(1)).astype(np.int64))))
        mean = 2 * (total[first[1:]] - total[first[:-1]]) / np.maximum(counts, 1) - 1
        mean[counts == 0] = 0
        points[:, d] = np.minimum((0.5 + 0.5 * np.tanh(4 * mean)) * (1 << BITS), (1 << BITS) - 1)
    return hilbert_index(points, BITS)


def _sort_keys(texts: list[str], ties: np.ndarray) -> np.ndarray:
    return curve_keys(texts) << _TIE_BITS | (mix64(ties.view(np.uint64)) >> np.uint64(64 - _TIE_BITS)).astype(np.int64)


def pack(df: DataFrame, length: int = 1024, tokenizer: str | None = None, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id (unique; ascending along the curve), offset in the sequence.

    The curve positions of all texts are first summarised to range bounds (one number per
    shuffle partition); then every text is encoded once and its ids cross one exchange.
    """
    spark, tokenizer = df.sparkSession, tokenizer or tokenizer_path()
    n_parts = shuffle_partitions(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"),
                     F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("tie"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_sort_keys(b.column(0).to_pylist(), np.array(b.column(1).to_numpy())))], names=["key"])

    at = [float(p) for p in np.arange(1, n_parts) / n_parts]
    found = (rows.select("text", "tie").mapInArrow(keys, "key long")
             .select(F.percentile_approx("key", at, 100 * n_parts)).first()[0] if at else None)
    bounds = np.array(found or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, end_id)
        for b in batches:
            texts = b.column(1).to_pylist()
            key = _sort_keys(texts, np.array(b.column(2).to_numpy()))
            ids = [_narrow(x) for x in encoder.batch(texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.searchsorted(bounds, key, side="right").astype(np.int32)), pa.array(key),
                 pa.array(ids, pa.binary())], names=["doc_id", "range", "key", "ids"])

    ranged = (rows.mapInArrow(encode, "doc_id long, range int, key long, ids binary")
              .repartitionById(n_parts, F.col("range")).sortWithinPartitions("key", "doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_seq = TaskContext.get().partitionId() << 40, 0
        open_, filled, out = [], 0, []  # pieces of the sequence that is being filled

        def batch() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def close(pieces) -> None:
            nonlocal n_seq
            offset = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids) // 4, ids, total, base + n_seq, offset))
                offset += len(ids) // 4
            n_seq += 1

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), map(_widen, b.column(3).to_pylist()), strict=True):
                total, start = len(ids) // 4, 0
                while start < total:
                    n = min(length - filled, total - start)
                    open_.append((doc, start, ids[4 * start:4 * (start + n)], total))
                    start, filled = start + n, filled + n
                    if filled == length:
                        close(open_)
                        open_, filled = [], 0
                if len(out) >= 2048:
                    yield batch()
                    out.clear()
        while open_:  # the rest, as powers of two
            room, pieces = 1 << (filled.bit_length() - 1), []
            filled -= room
            while room:
                doc, start, ids, total = open_.pop(0)
                n = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[:4 * n], total))
                if 4 * n < len(ids):
                    open_.insert(0, (doc, start + n, ids[4 * n:], total))
                room -= n
            close(pieces)
        if out:
            yield batch()

    return ranged.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _narrow(ids: bytes) -> bytes:
    """Ids for the exchange: two bytes each where all fit, told by a last byte."""
    a = np.frombuffer(ids, "<u4")
    return a.astype("<u2").tobytes() + b"\2" if int(a.max()) < 1 << 16 else ids + b"\4"


def _widen(ids: bytes) -> bytes:
    return np.frombuffer(ids, f"<u{ids[-1]}", (len(ids) - 1) // ids[-1]).astype("<u4").tobytes()


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_curve(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 ids along the curve."""
    return piece_digests(pack(table(spark, sf_dir, "documents")))
