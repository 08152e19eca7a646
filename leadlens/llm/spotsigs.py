"""SpotSigs document fingerprints.

A signature is an anchor with the next ``CHAIN`` content words after it; a text's fingerprint is
its set of signature hashes, written as sorted hexadecimal numbers. Anchors are the common words
and, by its hash, one content word in ``ONE_IN``, so texts in which the common words are rare have
signatures, too; besides, the first words of a text always make one. This holds alike for every
text: one with words has a fingerprint, one without has the empty one. Likeness is the Jaccard
similarity of two fingerprints (two empty ones: 1).

``similar_pairs`` finds all pairs of distinct fingerprints from a threshold on: sets are dealt to
partitions by length, compared with their own partition and the next ones that can still hold a
partner, through an inverted index of the rarest signatures, and given up as soon as the bound on
what is left falls under the threshold.

Nulls count as empty texts. Equal texts have equal fingerprints. Documents follow each other in
descending doc_id (nulls last; equal ids by text). An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import prepare, shuffle_partitions, table, text_of

#: Anchors: frequent short function words of the corpus's four languages.
ANCHORS = frozenset("""
a an and are as at be by for from in is it of on or that the this to was with
au dans de des du elle en est et il la le les ou par pas pour que qui sur un une
auf das dem den der die ein ist mit nicht sich und von zu
con del el los no por se y
""".split())
CHAIN, ONE_IN = 2, 8
_STRIP = ".,;:!?\"'()[]{}#$%&*|<>-"


def signatures(text: str) -> set[int]:
    """The text's signature hashes (32 bits)."""
    words = [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]
    if not words:
        return set()
    crc = zlib.crc32
    content, at, n = [], [], 0
    for w in words:
        if w in ANCHORS:
            at.append((w, n))
        else:
            content.append(w)
            n += 1
            if not crc(w.encode()) % ONE_IN:
                at.append((w, n))
    out = {crc(f"{a} {content[i]} {content[i + 1]}".encode()) for a, i in at if i + 1 < n}
    out.add(crc(" ".join(words[:1 + CHAIN]).encode()))
    return out


def fingerprint(sigs: set[int]) -> str:
    return "".join(f"{s:08x}" for s in sorted(sigs))


def parse(fp: str) -> list[int]:
    return np.frombuffer(bytes.fromhex(fp), ">u4").tolist()


def jaccard(a: set[int], b: set[int], threshold: float = 0.0) -> float:
    """Jaccard similarity; 0 without a comparison where sizes alone keep it under the threshold."""
    if not a or not b:
        return float(not a and not b)
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, extra) by range of descending doc_id, each range sorted and followed by the
    first document of the next range (extra).

    Range bounds are quantiles of the ids alone (one per shuffle partition); the texts cross one
    exchange.
    """
    n = shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    at = [p / n for p in range(1, n)]
    got = rows.select(F.percentile_approx("doc_id", at, 100 * n)).first()[0] if at else None
    bounds = sorted(set(got or []), reverse=True)

    # range 0 holds the ids from the largest bound on; nulls go last
    def search(low: int, high: int):
        """The range of an id as a balanced decision over the bounds."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("doc_id") >= F.lit(bounds[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    ranged = rows.withColumn("range", search(0, len(bounds)) if bounds else F.lit(0))
    first = (ranged.groupBy("range").agg(F.max("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .orderBy("range").collect())  # one row per range
    filled = [r.range for r in first]
    heads = {r.range: r.first for r in first}
    before = {r: filled[i - 1] for i, r in enumerate(filled) if i}
    if not first:
        return ranged.withColumn("extra", F.lit(False))
    before[filled[0]] = filled[-1]  # after the last document comes the first
    pairs = F.create_map(*[F.lit(x) for r in filled for x in (r, before[r])])
    tops = F.create_map(*[F.lit(x) for r in filled for x in (r, heads[r])])
    case = F.when(F.col("doc_id").eqNullSafe(F.element_at(tops, F.col("range"))), F.element_at(pairs, F.col("range")))
    both = ranged.withColumn("to", F.filter(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")),
                                                    F.struct(case.alias("range"), F.lit(True).alias("extra"))),
                                            lambda s: s["range"].isNotNull()))
    dealt = both.select("doc_id", "text", F.inline("to"))
    return (dealt.repartitionById(len(bounds) + 1, F.col("range"))
            .sortWithinPartitions("extra", F.col("doc_id").desc_nulls_last(), "text"))


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its edited text (the last third replaced by the start of the next
    document), both fingerprints, and the likeness to the edited text and to the next document."""
    prepare(df.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[set[int], str]] = {}

        def of(text: str) -> tuple[set[int], str]:
            if text not in memo:
                if len(memo) > 4:
                    memo.clear()
                s = signatures(text)
                memo[text] = (s, fingerprint(s))
            return memo[text]

        def row(doc, text: str, follows: str) -> tuple:
            n = len(text)
            k = n // 3
            edited = text[:n - k] + follows[:k]
            (sa, fa), (sn, _) = of(text), of(follows)
            se = sa if edited == text else signatures(edited)
            return (doc, n, edited, fa, fa if se is sa else fingerprint(se), jaccard(sa, se), jaccard(sa, sn))

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        last, tail = None, None
        for b in batches:
            rows = []
            for doc, text, _, extra in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if extra:
                    tail = text if tail is None else tail  # the first of the next range
                    continue
                if last is not None:
                    rows.append(row(*last, text))
                last = (doc, text)
            if rows:
                yield batch(rows)
        if last is not None:
            yield batch([row(*last, last[1] if tail is None else tail)])

    return _in_order(df, id_col, text_col).select("doc_id", "text", "range", "extra").mapInArrow(
        walk, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def similar_pairs(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fp_a, fp_b (the smallest doc_id of each distinct fingerprint), likeness: every pair of
    different fingerprints from ``threshold`` on. Texts without a fingerprint are in no pair."""
    prepare(df.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sorted(signatures(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["doc_id", "sigs"])

    sets = (df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
            .mapInArrow(prints, "doc_id long, sigs array<long>").where(F.size("sigs") > 0)
            .groupBy("sigs").agg(F.min("doc_id").alias("fp")))
    n = F.size("sigs")
    # a set's partition is the power of 1/threshold under its length; partners are there or one on
    part = F.floor(F.log(n.cast("double")) / F.lit(float(-np.log(threshold)))).cast("int")
    freq = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = (sets.select("fp", n.alias("n"), part.alias("part"), F.explode("sigs").alias("sig")).join(freq, "sig")
              .groupBy("fp", "n", "part").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("ranked")))
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")).cast("int") + 1
    prefix = ranked.select("fp", "n", "part", F.posexplode(F.slice("ranked", F.lit(1), keep)).alias("pos", "r"))
    index = prefix.select("fp", "n", "part", F.col("r.sig").alias("sig"), "pos")
    a = index.select(F.col("fp").alias("fp_a"), F.col("n").alias("n_a"), "sig", F.col("pos").alias("pos_a"),
                     F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    b = index.select(F.col("fp").alias("fp_b"), F.col("n").alias("n_b"), "sig", F.col("pos").alias("pos_b"), "part")
    need = F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b"))
    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    found = (a.join(b, ["sig", "part"])
             .where(((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("fp_a") < F.col("fp_b"))))
                    & (F.col("n_a") >= F.lit(threshold) * F.col("n_b")) & (left + F.least("pos_a", "pos_b") >= need))
             .select("fp_a", "fp_b").distinct())
    side = sets.select("fp", "sigs")
    both = (found.join(side.withColumnsRenamed({"fp": "fp_a", "sigs": "sigs_a"}), "fp_a")
            .join(side.withColumnsRenamed({"fp": "fp_b", "sigs": "sigs_b"}), "fp_b"))
    shared = F.size(F.array_intersect("sigs_a", "sigs_b"))
    like = shared / (F.size("sigs_a") + F.size("sigs_b") - shared)
    return both.select("fp_a", "fp_b", like.alias("likeness")).where(F.col("likeness") >= threshold)


def op3_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    out = compare_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")
