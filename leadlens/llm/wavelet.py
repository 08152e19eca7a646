"""Token ids on disk as wavelet matrices: one succinct, compressed file image per shard.

A shard holds the ids of consecutive documents. Level by level, from the highest bit, the ids'
bits are stored as one bit-plane and the ids are stably split into zeros and ones. With a rank
directory per plane, ``access``, ``rank``, ``select``, ``count`` and ``occurrences`` work on the
planes alone. The image (header, document table, planes, directories; each part zstd) is what
``to_bytes`` gives and ``from_bytes`` opens.

``write_shards`` writes a table of shards through Spark's own writer, so lost executors and
retries leave no half-written or doubled shard and any store Spark writes to will do; one row
holds one whole image. ``read_ids`` gives the ids back, ``find`` the occurrences of an id.

Documents are ordered by doc_id (nulls first; equal ids by a hash of the text). A null or empty
text has the end id only. An empty table gives no shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm.common import Scratch, table, text_of
from leadlens.llm.tokens import Encoder, tokenizer_path

#: A shard is closed at the first document end after so many ids.
SHARD_IDS = 1 << 20
_MAGIC = b"LLWM0001"
_BLOCK = 512  # bits per rank entry


class WaveletMatrix:
    """Planes of a sequence of ids: packed bits, number of zeros, ones before each block."""

    def __init__(self, n: int, bits: int, planes: list[tuple[np.ndarray, int, np.ndarray]]):
        self.n, self.bits, self.planes = n, bits, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        rest = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for b in range(bits - 1, -1, -1):
            bit = (rest >> rest.dtype.type(b)) & 1 == 1
            packed = np.packbits(bit)
            ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % 64))).reshape(-1, 64).sum(1, dtype=np.uint32)
            directory = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)
            rest = np.concatenate((rest[~bit], rest[bit]))
            planes.append((packed, n - int(directory[-1]), directory))
        return cls(n, bits, planes)

    def _bit(self, plane: int, i: int) -> int:
        return (int(self.planes[plane][0][i >> 3]) >> (7 - (i & 7))) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones in the first i bits."""
        packed, _, directory = self.planes[plane]
        block = i // _BLOCK
        part = packed[block * 64:(i >> 3)]
        out = int(directory[block]) + int(np.bitwise_count(part).sum())
        if i & 7:
            out += (int(packed[i >> 3]) >> (8 - (i & 7))).bit_count()
        return out

    def access(self, i: int) -> int:
        value = 0
        for k, (_, zeros, _) in enumerate(self.planes):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where ids equal to ``value`` among the first i end up below the last plane."""
        low, high = 0, i
        for k, (_, zeros, _) in enumerate(self.planes):
            a, b = self._ones(k, low), self._ones(k, high)
            if value >> (self.bits - 1 - k) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, value: int, i: int) -> int:
        """Ids equal to ``value`` among the first i."""
        if value >> self.bits or i <= 0:
            return 0
        low, high = self._range(value, min(i, self.n))
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane: a search in the directory, then
        in one block."""
        packed, _, directory = self.planes[plane]
        before = directory.astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * _BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(packed[block * 64:(block + 1) * 64], count=min(_BLOCK, self.n - block * _BLOCK))
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) id equal to ``value``; -1 if there are fewer."""
        if value >> self.bits:
            return -1
        low, high = self._range(value, self.n)
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for plane in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - plane) & 1
            at = self._select_bit(plane, bit, at - self.planes[plane][1] if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def ids(self) -> np.ndarray:
        """All ids, by undoing the splits from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        rest = np.zeros(self.n, kind)
        for b, (packed, zeros, _) in enumerate(reversed(self.planes)):
            bit = np.unpackbits(packed, count=self.n).view(bool)
            out = np.empty(self.n, kind)
            out[~bit] = rest[:zeros]
            out[bit] = rest[zeros:] | kind(1 << b)
            rest = out
        return rest


def to_bytes(matrix: WaveletMatrix, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file image of a shard."""
    press = zstandard.ZstdCompressor(level=1).compress
    null = np.array([d is None for d in doc_ids], bool)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + np.packbits(null).tobytes()
    parts = [press(docs)]
    for packed, _, directory in matrix.planes:
        parts += [press(packed.tobytes()), press(np.diff(directory).astype("<u2").tobytes())]
    head = struct.pack("<8sQII", _MAGIC, matrix.n, matrix.bits, len(doc_ids))
    head += struct.pack(f"<{matrix.bits}Q", *(z for _, z, _ in matrix.planes))
    head += struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return head + b"".join(parts)


def from_bytes(image: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(matrix, doc ids, ids per document) of a file image."""
    magic, n, bits, n_docs = struct.unpack_from("<8sQII", image)
    if magic != _MAGIC:
        raise ValueError("not a wavelet shard")
    at = 24
    zeros = struct.unpack_from(f"<{bits}Q", image, at)
    at += 8 * bits
    sizes = struct.unpack_from(f"<{1 + 2 * bits}Q", image, at)
    at += 8 * len(sizes)
    parts = []
    for s in sizes:
        parts.append(zstandard.ZstdDecompressor().decompress(image[at:at + s]))
        at += s
    docs = np.frombuffer(parts[0], "<i8", n_docs)
    lengths = np.frombuffer(parts[0], "<u8", n_docs, 8 * n_docs).astype(np.int64)
    null = np.unpackbits(np.frombuffer(parts[0], np.uint8, offset=16 * n_docs), count=n_docs)
    planes = []
    for k in range(bits):
        ones = np.frombuffer(parts[2 + 2 * k], "<u2").astype(np.uint32)
        directory = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)
        planes.append((np.frombuffer(parts[1 + 2 * k], np.uint8), zeros[k], directory))
    return WaveletMatrix(n, bits, planes), [None if z else d for d, z in zip(docs.tolist(), null, strict=True)], lengths


def write_shards(df: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0,
                 shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts and write one image per shard, in ascending order of ids.

    One range exchange of the texts; every task encodes its range once and writes its shards.
    """
    tokenizer = tokenizer or tokenizer_path()
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer, end_id), TaskContext.get().partitionId()
        docs, ids, size, seq, before = [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"))
            image = to_bytes(matrix, docs, [len(x) // 4 for x in ids])
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(docs)],
                "n_ids": [matrix.n], "before": [before], "image": pa.array([image], pa.binary())})

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), encoder.batch(b.column(1).to_pylist()), strict=True):
                docs.append(doc)
                ids.append(x)
                size += len(x) // 4
                if size >= shard_ids:
                    yield shard()
                    docs, ids, size, seq, before = [], [], 0, seq + 1, before + size
        if docs:
            yield shard()

    shards = ranged.mapInArrow(build, "part int, seq int, n_docs long, n_ids long, before long, image binary")
    shards.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian uint32)."""
    shards = spark.read.parquet(path)
    # ids per range, one number per task that wrote; a shard knows the ids before it in its range
    totals = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    parts = sorted(totals)
    base = dict(zip(parts, np.cumsum([0, *(totals[p] for p in parts)]).tolist(), strict=False))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, image in zip(*(c.to_pylist() for c in b.columns), strict=True):
                matrix, docs, lengths = from_bytes(image)
                ids = matrix.ids().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                for i in range(0, len(docs), 512):
                    j = min(i + 512, len(docs))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(docs[i:j], pa.int64()), "start": pa.array(starts[i:j] + (base[part] + before)),
                        "ids": pa.array([ids[s:e].tobytes() for s, e in zip(starts[i:j], ends[i:j], strict=True)], pa.binary())})

    return shards.select("part", "before", "image").mapInArrow(decode, "doc_id long, start long, ids binary")


def find(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id and place in the document of every occurrence of an id, looked up in the planes."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image in b.column(0).to_pylist():
                matrix, docs, lengths = from_bytes(image)
                at = np.array(matrix.occurrences(token), np.int64)
                starts = np.cumsum(lengths) - lengths
                doc = np.searchsorted(starts, at, side="right") - 1
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([docs[i] for i in doc], pa.int64()),
                                                  "place": pa.array(at - starts[doc])})

    return spark.read.parquet(path).select("image").mapInArrow(look, "doc_id long, place long")


def op2_wavelet(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as wavelet shards and read back from them."""
    scratch = Scratch(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), scratch.path("shards"))
    return read_ids(spark, scratch.path("shards")).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
