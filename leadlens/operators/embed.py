"""Text embedding as sparse TF-IDF vectors, L2-normalised.

A chunk's vector is an ``array<struct<term string, w double>>`` sorted by term, so it
lives on the chunk's row: scoring a question against a chunk needs no join and no
shuffle. Terms are counted inside their row; document frequencies are counted inside the tasks and
then summed per term. The ``HEAD_TERMS`` most frequent terms (a table of bounded size) weigh a chunk's
terms where the chunk is read; only rarer terms are joined to their frequencies and brought back to
their chunk, so a vocabulary that is not larger costs no exchange of vectors at all.
idf = ln((N + 1) / (df + 1)), the smoothing of Spark ML's IDF. A term in every chunk
gets weight 0 and is dropped. Another model plugs in as a function that adds a dense vector
column (``embed_with``), searched by ``retrieve.nearest_dense``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.functions.text import token_text
from leadlens.operators.ordering import materialize


def term_frequencies(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., term, tf) for non-empty tokens, counted inside each row: only distinct terms leave
    it, and nothing is shuffled. ``key`` tells the rows apart."""
    schema = T.StructType([*(docs.schema[c] for c in key), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, _ROWS):
                part = b.slice(start, _ROWS)
                counts = [Counter(t.split(" ")) if t else {} for t in part.column(len(key)).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(len(key))),
                                                  pa.array([t for c in counts for t in c], pa.string()),
                                                  pa.array([n for c in counts for n in c.values()], pa.int64())], names=[*key, "term", "tf"])

    return docs.select(*key, token_text(F.col(text))).mapInArrow(run, schema)


#: Rows counted at once in a task.
_ROWS = 256
#: A term's rows are dealt over so many tasks in the join with the document frequencies.
TERM_SPLITS = 16


def weigh(tf: DataFrame, dfreq: DataFrame, n_docs, key: list[str], *more: str, splits: int = TERM_SPLITS) -> DataFrame:
    """(key..., term, w[, more...]) with w = tf * idf, normalised per key to unit L2 norm.
    Terms unseen in the corpus get df 0. Zero-weight terms are dropped.

    A frequent term stands in most documents, so its rows are split by a hash of the key and the
    vocabulary row repeated for each of the ``splits`` parts."""
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.coalesce(F.col("df"), F.lit(0))))
    rows = tf.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(splits)))
    vocabulary = dfreq.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)).cast("array<bigint>")))
    w = (rows.join(vocabulary, ["term", "__part"], "left")
         .select(*key, "term", (F.col("tf") * idf).alias("w"), *more)
         .where(F.col("w") != 0))
    return w


def packed_vectors(weights: DataFrame, key: list[str], kept=None) -> DataFrame:
    """(key..., vec array<struct<term,w>> sorted by term) with unit-norm weights. With a condition
    ``kept`` the vector has only the entries that meet it, and ``norm2`` is the squared norm of all."""
    entry = F.struct("term", "w") if kept is None else F.when(kept, F.struct("term", "w"))   # the collection drops NULLs
    grouped = weights.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("raw"),
                                        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
    vec = F.transform("raw", lambda e: F.struct(e["term"].alias("term"), (e["w"] / F.col("nrm")).alias("w")))
    norm2 = [] if kept is None else [F.lit(1.0).alias("norm2")]
    return grouped.select(*key, vec.alias("vec"), *norm2)


def tfidf_index(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame, object]:
    """Fit on a chunk table: returns (chunk vectors, document frequencies, N as a column). One row
    per chunk; a chunk whose every term has weight 0, or without a key, gets the zero vector, an empty
    array. Chunks that share a key share one vector of all their terms."""
    # written once: small beside the texts, and every step below reads it
    dfreq = materialize(counted_inside(chunks, text).groupBy("term").agg(F.sum("df").alias("df")))
    counts = chunks.agg(F.count(F.lit(1))).crossJoin(dfreq.agg(F.count(F.lit(1)))).first()
    n_docs = F.lit(counts[0])
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df")))
    head = (dfreq.where(F.length("term") <= HEAD_CHARS).orderBy(F.desc("df"), "term").limit(HEAD_TERMS)
            .select("term", idf.alias("idf")).collect())   # HEAD_TERMS short rows at most
    known = chunks.sparkSession.sparkContext.broadcast({r.term: r.idf for r in head})
    again = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    if counts[1] == len(head) and again.isEmpty():
        return _weighed_inside(chunks, key, text, known), dfreq, n_docs
    # to a chunk's one place go its frequent terms as counts (a few bytes each) and the weights of the
    # others; a term of the tail is rarer than HEAD_TERMS others, so its rows are few
    parts = _split_inside(chunks, key, text, known)
    heads = parts.select(key, "terms", "tfs", F.lit(None).cast("double").alias("w"), F.lit(1).alias("n"))
    rest = parts.select(key, F.inline("rest")).join(dfreq, "term").select(key, F.col("term").alias("terms"), (F.col("tf") * idf).alias("w"))
    tails = rest.where("w <> 0").withColumns({"n": F.lit(0), "tfs": F.lit(None).cast("array<bigint>")})
    grouped = heads.unionByName(tails).groupBy(key).agg(F.collect_list(F.struct("terms", "tfs", "w")).alias("parts"), F.sum("n").alias("n"))
    vecs = _merged(grouped, key, known).select(key, "vec", F.explode(F.sequence(F.lit(1), "n")))
    return vecs.select(key, "vec"), dfreq, n_docs


#: Terms whose weights every task holds, and their length at most; distinct terms a task counts at once.
HEAD_TERMS, HEAD_CHARS, _COUNTED = 1 << 18, 64, 1 << 17
_VECTOR = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType())]))


def counted_inside(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) with the documents that a task has read so far: the sum per term is its df."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])
        for b in batches:
            for part in _pieces(b, 0):
                terms, _, place, _ = _counted(part.column(0))
                found.update(dict(zip(terms.to_pylist(), np.bincount(place, minlength=len(terms)).tolist(), strict=True)))
                if len(found) >= _COUNTED:
                    yield rows()
                    found.clear()
        yield rows()

    return docs.select(token_text(F.col(text))).mapInArrow(run, "term string, df long")


def _pieces(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``_TOGETHER`` rows and some ``_BYTES`` of text (one row at least)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < b.num_rows:
        fits = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _BYTES, side="right"))
        end = max(start + 1, min(fits, start + _TOGETHER))
        yield b.slice(start, end - start)
        start = end


#: Rows and bytes of text counted at once in a task.
_TOGETHER, _BYTES = 1024, 4 << 20


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of every word of texts with one space between words."""
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.string()), " ")
    row, words = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()
    some = pc.not_equal(words, "")
    return row[some.to_numpy(zero_copy_only=False)], words.filter(some)


def _coded(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct terms sorted, place of each term among them)."""
    coded = terms.dictionary_encode()
    by = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(by), np.int64)
    rank[by.to_numpy()] = np.arange(len(by))
    return coded.dictionary.take(by), rank[coded.indices.to_numpy(zero_copy_only=False)]


def _counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, place of the term, count) of the distinct terms of every text, by row and term."""
    row, words = _words(texts)
    terms, place = _coded(words)
    key, n = np.unique(row * max(1, len(terms)) + place, return_counts=True)
    return terms, key // max(1, len(terms)), key % max(1, len(terms)), n


def _of_rows(row: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """A list column from the values of each row, which are in the order of the rows."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=rows))), pa.int32()), values)


def _unit(row: np.ndarray, rows: int, terms: pa.Array, place: np.ndarray, w: np.ndarray) -> pa.Array:
    """A list column with each row's entries other than 0, sorted by term, at unit length."""
    by = np.lexsort((w, place, row))
    by = by[w[by] != 0]
    row, place, w = row[by], place[by], w[by]
    w = w / np.sqrt(np.bincount(row, w * w, minlength=rows))[row]
    return _of_rows(row, rows, pa.StructArray.from_arrays([terms.take(pa.array(place)), pa.array(w)], ["term", "w"]))


def _weighed_inside(docs: DataFrame, key: str, text: str, known) -> DataFrame:
    """(key, vec) where all terms are in ``known`` (a broadcast term -> idf): each row on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = known.value
        for b in batches:
            for part in _pieces(b, 1):
                terms, row, place, n = _counted(part.column(1))
                w = n * np.array([idf[t] for t in terms.to_pylist()], np.float64)[place]
                yield pa.RecordBatch.from_arrays([part.column(0), _unit(row, part.num_rows, terms, place, w)], names=[key, "vec"])

    return docs.select(key, token_text(F.col(text))).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("vec", _VECTOR)]))


def _split_inside(docs: DataFrame, key: str, text: str, known) -> DataFrame:
    """(key, terms, tfs, rest): the terms of a row that are in ``known``, one space apart, with their
    counts, and its other terms with theirs."""
    kind = docs.select(F.col(key)).schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = known.value
        for b in batches:
            for part in _pieces(b, 1):
                terms, row, place, n = _counted(part.column(1))
                mine, rows = np.array([t in idf for t in terms.to_pylist()], bool)[place], part.num_rows
                heads = _of_rows(row[mine], rows, terms.take(pa.array(place[mine])))
                rest = pa.StructArray.from_arrays([terms.take(pa.array(place[~mine])), pa.array(n[~mine], pa.int64())], ["term", "tf"])
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_join(heads, " "), _of_rows(row[mine], rows, pa.array(n[mine], pa.int64())),
                                                  _of_rows(row[~mine], rows, rest)], names=[key, "terms", "tfs", "rest"])

    return docs.select(key, token_text(F.col(text))).mapInArrow(run, f"`{key}` {kind}, terms string, tfs array<bigint>, rest array<struct<term:string,tf:bigint>>")


def _merged(grouped: DataFrame, key: str, known) -> DataFrame:
    """(key, n, vec) of a chunk's parts: counts of terms in ``known``, and weighed terms. A chunk
    without a key has the zero vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = known.value
        for b in batches:
            for start in range(0, b.num_rows, _ROWS):
                part = b.slice(start, _ROWS)
                lists = part.column(2)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                parts = lists.flatten()
                here = pc.is_valid(part.column(0)).to_numpy(zero_copy_only=False)[row]
                head = parts.field("tfs").is_valid().to_numpy(zero_copy_only=False)
                heads, tails = parts.filter(pa.array(head & here)), parts.filter(pa.array(~head & here))
                at, words = _words(heads.field("terms"))
                terms, place = _coded(pa.concat_arrays([words, tails.field("terms").cast(pa.string())]))
                known_terms = np.array([idf.get(t, 0.0) for t in terms.to_pylist()], np.float64)
                w = np.concatenate((heads.field("tfs").flatten().to_numpy(zero_copy_only=False) * known_terms[place[:len(words)]],
                                    tails.field("w").to_numpy(zero_copy_only=False).astype(np.float64)))
                row = np.concatenate((row[head & here][at], row[~head & here]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _unit(row, part.num_rows, terms, place, w)], names=[key, "n", "vec"])

    return grouped.select(key, "n", "parts").mapInArrow(run, T.StructType([grouped.schema[key], T.StructField("n", T.LongType()), T.StructField("vec", _VECTOR)]))


def embed_questions(questions: DataFrame, key: list[str], dfreq: DataFrame, n_docs, text: str = "text") -> DataFrame:
    """Question vectors in the chunk corpus' idf space: (key..., vec)."""
    tf = term_frequencies(questions, key, text)
    return packed_vectors(weigh(tf, dfreq, n_docs, key), key)


def embed_to_search(questions: DataFrame, key: list[str], dfreq: DataFrame, n_docs, text: str = "text") -> DataFrame:
    """Question vectors for a search, (key..., vec, norm2): as ``embed_questions``, but terms that no
    chunk has count in the squared norm only, so they need not go to every shard."""
    # the vocabulary is far larger than the questions: it is not repeated for them
    weights = weigh(term_frequencies(questions, key, text), dfreq, n_docs, key, "df", splits=1)
    return packed_vectors(weights, key, F.col("df").isNotNull())


def weights_long(vecs: DataFrame, key: list[str]) -> DataFrame:
    """Unpack (key..., vec) into (key..., term, weight)."""
    return vecs.select(*key, F.explode("vec").alias("e")).select(*key, F.col("e.term").alias("term"),
                                                                 F.col("e.w").alias("weight"))


def embed_with(docs: DataFrame, embed, key: list[str], text: str = "text", out: str = "embedding") -> DataFrame:
    """(key..., embedding array<float>) by any batch embedder: ``embed`` takes a list of texts and
    returns as many vectors; it runs in the tasks, one Arrow batch at a time."""
    fields = [docs.schema[c] for c in key]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for b in batches:
            vectors = [[float(x) for x in v] for v in embed([t or "" for t in b.column(len(key)).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(key)], pa.array(vectors, pa.list_(pa.float32()))], names=[*key, out])

    return docs.select(*key, F.col(text)).mapInArrow(run, schema)
