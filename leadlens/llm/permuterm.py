"""Spelling variants by permuterm rotations.

Every word w gets an end mark and is rotated to each of its places. Rotated so that a character
comes last, w reads rest + character: all words that differ from it in that character alone share
``rest``, and a word that lacks the character is a whole rotation equal to ``rest``. So after one
range sort of the rotations by ``rest``, each group of equal ones holds at most one shorter word,
followed by one word for each character that can stand in the skipped place: replacements are the
pairs of longer words, indels the pairs with the shorter one. A group has at most 91 members (one
per letter of the alphabet, and the shorter word); each member emits one row, its neighbours in the
group counted and the best of them named, never the pairs. An indel beside an equal character is
the same at either place; only the first place of such a run counts.

Words come from the maximal runs of ``A-Za-z`` and U+00C0 to U+00FF with A-Z lowered, counted per
task and then over all texts. A word's form is its near word of the largest count (ties: the
smallest), if that is ``ratio`` times its own count or more; forms are followed to the last by
pointer doubling (counts grow at each step, so there are no rings).

Null and empty texts have no words. Rows without doc_id count with an empty id. Repeated rows count
each. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import Scratch, prepare, table, text_of

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Divisor of the hashes whose run loses a character.
SLIPS = 199
#: Stands after the last character of a word; sorts before all of them.
END = "$"
#: Distinct words held in a task before they are handed on.
_HELD = 1 << 19


def edited(run: str, h: int) -> str:
    """The run without its character h % length if SLIPS divides h, else the run."""
    if h % SLIPS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(df: DataFrame, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of ``least_length`` characters that occur ``least_count`` times or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs = Counter(_RUN.findall(text.encode().lower().decode()))  # bytes lower A-Z alone
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs.items():
                    if len(run) >= least_length:
                        word = edited(run, zlib.crc32(run.encode(), head))
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) > _HELD:
                    yield flush()
        if held:
            yield flush()

    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def rotations(words: DataFrame) -> DataFrame:
    """(rest, letter, word, n): for each place of a word the rotation that ends in its character
    (``letter``), and each whole rotation (letter empty) as what a longer word may leave."""
    w, size = F.col("word"), F.length("word")
    longer = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        F.concat(F.substr(w, i + 1), F.lit(END), F.substr(w, F.lit(1), i - 1)).alias("rest"), F.substr(w, i, F.lit(1)).alias("letter")))
    whole = F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.struct(
        F.concat(F.substr(w, i), F.lit(END), F.substr(w, F.lit(1), i - 1)).alias("rest"), F.lit("").alias("letter")))
    return words.select("word", "n", F.explode(F.concat(longer, whole)).alias("r")).select("r.rest", "r.letter", "word", "n")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rotations: (word, n_near, best_n, best) for each member of a group of two or more
    that has neighbours there."""
    out: list[tuple[str, int, int, str]] = []
    group: list[tuple[str, str, int]] = []  # letter, word, n; the shorter word first, as '' sorts first
    last = None

    def emit(rest: str) -> None:
        # the shorter word is near to a longer one only at the first place of a run of equal letters
        shorter = group[0] if not group[0][0] else None
        longer = group[1:] if shorter else group
        if shorter:
            apart = [m for m in longer if m[0] != rest[-1]]
            if apart:
                best = min(apart, key=lambda m: (-m[2], m[1]))
                out.append((shorter[1], len(apart), best[2], best[1]))
        if len(longer) > 1:
            first, second = sorted(longer, key=lambda m: (-m[2], m[1]))[:2]
        for m in longer:
            near, best = len(longer) - 1, None
            if near:
                best = second if m is first else first
            if shorter and m[0] != rest[-1]:
                near += 1
                if best is None or (-shorter[2], shorter[1]) < (-best[2], best[1]):
                    best = shorter
            if near:
                out.append((m[1], near, best[2], best[1]))

    def batch() -> pa.RecordBatch:
        word, near, n, best = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(best)],
                                          names=["word", "n_near", "best_n", "best"])

    for b in batches:
        for rest, letter, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rest != last:
                if len(group) > 1:
                    emit(last)
                group, last = [], rest
            group.append((letter, word, n))
        if len(out) > 8192:
            yield batch()
    if len(group) > 1:
        emit(last)
    if out:
        yield batch()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word with near words; best: the one counted most."""
    sorted_ = rotations(words).repartitionByRange("rest").sortWithinPartitions("rest", "letter")
    found = sorted_.mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): from each word along (word, form) to the last, by pointer doubling."""
    k, at = 0, scratch.keep(forms.select("word", F.col("form").alias("root")), "roots-0")
    while True:
        k += 1
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = scratch.keep(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        scratch.drop(f"roots-{k - 1}")
        moved = at.where("moved").isEmpty()
        at = at.drop("moved")
        if moved:
            return at


def variants(df: DataFrame, ratio: int = 5, least_length: int = 6, least_count: int = 5,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    spark = df.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "permuterm")
    words = scratch.keep(word_counts(df, least_length, least_count, id_col, text_col), "words")
    takes = F.col("best_n") >= ratio * F.col("n")
    found = scratch.keep(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "found")
    last = roots(found.where("form is not null"), scratch)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_permuterm(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(table(spark, sf_dir, "documents"))
