"""Masked pseudo-likelihood scores from a bidirectional window network.

The network predicts a word from the ``WINDOW`` words on either side: context embeddings are gated
by position, summed and squashed, and a two-step softmax (class, then word in the class) gives
exact conditional probabilities. A text's score is the sum of the log-probabilities of all its
words, each given its neighbours, and that sum per word.

Counts of all words of all texts give the vocabulary (the ``VOCABULARY`` most frequent; others
share hashed places). A word in a hashed place has the probability of the place times its exact
share of the place: n / (N + 1) for a word counted n times in a place with N words in all, and
1 / (N + 1) for what the corpus does not hold. The table of these counts has every word of the
corpus, grows with it, and is joined to the words of the texts in Spark.

Training is data-parallel. Pieces of the texts are dealt over rounds and, in a round, over copies of
the network by the hash of their row, so that a copy has a fixed number of words; the copies and
their Adagrad memories are averaged after each round, weighted by the words they predicted. The
words are dealt over disjoint masks, whose words are predicted mask by mask: so each word of each
text is predicted once. Neither files nor partitions change the result, but for rounding. The counts
grow with the corpus, and what the driver holds is one network of fixed size.

A null text counts as empty: no words, score 0, per word null. Repeated rows are scored alike. An
empty table gives an empty result, and an untrained network if it is the corpus. Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import ALNUM, Scratch, prepare, table, text_of, word_hashes, words_of

VOCABULARY, HASHED, CLASSES, WIDTH, WINDOW = 4096, 256, 64, 16, 2
_PLACES = VOCABULARY + HASHED  # words to predict; the next id stands for the edge of a text
_PER_CLASS = _PLACES // CLASSES
_OFFSETS = np.array([o for o in range(-WINDOW, WINDOW + 1) if o])
_PIECE = 4096  # words of a text that are dealt together
_SLICE, _ROUNDS, _COPIES = 1 << 20, 16, 4096  # words of a copy and round, most rounds, most copies
_BLOCK = 4096  # parameters per row when copies are averaged
_UNIT = 1 << 24  # logarithms of counts are summed as whole numbers of 1 / _UNIT: alike in any order
_SHAPES = {"embed": (_PLACES + 1, WIDTH), "gate": (len(_OFFSETS), WIDTH), "bias": (WIDTH,),
           "classes": (WIDTH, CLASSES), "class_bias": (CLASSES,), "words": (CLASSES, WIDTH, _PER_CLASS), "word_bias": (CLASSES, _PER_CLASS)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


@dataclass
class Network:
    """Parameters, and the sorted hashes and ids of the vocabulary; besides, the words counted in each
    hashed place, and the table (word, log_n) of the words that share places and occur twice or more."""

    hashes: np.ndarray
    ids: np.ndarray
    params: dict[str, np.ndarray]
    totals: np.ndarray | None = None
    words: DataFrame | None = None
    corpus: int = 0  # words of the corpus

    @classmethod
    def new(cls, by_frequency: np.ndarray, seed: int = 1) -> Network:
        """``by_frequency``: word hashes, most frequent first."""
        rng = np.random.default_rng(seed)
        params = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in _SHAPES.items()}
        params["gate"] += 1
        for k in ("bias", "class_bias", "word_bias"):
            params[k][:] = 0
        order = np.argsort(by_frequency)
        return cls(by_frequency[order], order.astype(np.int64), params)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words with edges around each text, places of the words, words before each text)."""
        return self.read(texts)[:3]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, and the hashes of the words."""
        data, starts, ends, first = words_of([t.encode() for t in texts], ALNUM)
        h = word_hashes(data, starts, ends)
        ids = VOCABULARY + (h % np.uint64(HASHED)).astype(np.int64)
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == h, self.ids[at], ids)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        places = np.arange(len(h)) + WINDOW * (doc + 1)
        x = np.full(len(h) + WINDOW * (len(texts) + 1), _PLACES, np.int64)
        x[places] = ids
        return x, places, first, h

    def forward(self, x: np.ndarray, places: np.ndarray):
        """(log-probability of each place's word, what the gradient needs), places by class."""
        p = self.params
        target = x[places]
        order = np.argsort((target % CLASSES).astype(np.uint8), kind="stable")  # a radix sort
        places, target = places[order], target[order]
        context = p["embed"][x[places[:, None] + _OFFSETS]]
        one = np.ones((len(places), WIDTH + 1), np.float32)  # hidden values, and a 1 for the biases
        hidden = np.einsum("nok,ok->nk", context, p["gate"])
        hidden += p["bias"]
        np.tanh(hidden, out=one[:, :-1])
        cls, word = target % CLASSES, target // CLASSES
        rows = np.arange(len(places))
        class_p, class_sum = _exponentials(one @ np.vstack((p["classes"], p["class_bias"])))
        class_p /= class_sum[:, None]
        logp = np.log(class_p[rows, cls] + 1e-30)
        bounds = np.searchsorted(cls, np.arange(CLASSES + 1))
        weights = np.concatenate((p["words"], p["word_bias"][:, None]), 1)
        word_e = np.empty((len(places), _PER_CLASS), np.float32)
        for c, a, b in zip(range(CLASSES), bounds.tolist(), bounds[1:].tolist(), strict=False):
            if b > a:
                np.matmul(one[a:b], weights[c], out=word_e[a:b])
        word_e = _exponentials(word_e)
        logp += np.log(word_e[0][rows, word] / word_e[1] + 1e-30)
        return logp, (order, places, context, one, cls, word, class_p, word_e, bounds)

    def gradient(self, x: np.ndarray, state) -> dict[str, np.ndarray]:
        """Gradient of the mean negative log-probability."""
        p = self.params
        _, places, context, one, cls, word, class_p, (word_p, word_sum), bounds = state
        n = len(places)
        word_p /= word_sum[:, None]
        rows = np.arange(n)
        class_p[rows, cls] -= 1
        word_p[rows, word] -= 1
        ones = np.ones(n, np.float32)
        flat = np.zeros(_SIZE, np.float32)
        g = _views(flat)
        of_class = one.T @ class_p
        g["classes"][:], g["class_bias"][:] = of_class[:-1], of_class[-1]
        of_words = np.zeros((CLASSES, WIDTH + 1, _PER_CLASS), np.float32)
        back = class_p @ p["classes"].T
        of_word = np.empty_like(back)
        for c, a, b in zip(range(CLASSES), bounds.tolist(), bounds[1:].tolist(), strict=False):
            if b > a:
                np.matmul(one[a:b].T, word_p[a:b], out=of_words[c])
                np.matmul(word_p[a:b], p["words"][c].T, out=of_word[a:b])
        g["words"][:], g["word_bias"][:] = of_words[:, :-1], of_words[:, -1]
        back += of_word
        back *= 1 - one[:, :-1] ** 2
        np.matmul(ones, back, out=g["bias"])
        np.einsum("nk,nok->ok", back, context, out=g["gate"])
        where = x[places + _OFFSETS[:, None]].ravel()
        for k, (gate, flow) in enumerate(zip(p["gate"].T.astype(float), back.T.astype(float), strict=True)):
            g["embed"][:, k] = np.bincount(where, np.outer(gate, flow).ravel(), _PLACES + 1)
        flat /= max(n, 1)
        return g

    def train(self, x: np.ndarray, places: np.ndarray, memory: dict[str, np.ndarray], rate: float = 0.1) -> None:
        """One Adagrad step."""
        _, state = self.forward(x, places)
        for k, g in self.gradient(x, state).items():
            held = g * g
            memory[k] += held
            np.sqrt(memory[k], out=held)
            held += 1e-6
            np.divide(g, held, out=held)
            held *= rate
            self.params[k] -= held

    def scores(self, texts: list[str], step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(words, summed log-probability) of each text; of a word that shares a place, that of the place."""
        x, places, first = self.encode(texts)
        return np.diff(first), self.sums(x, places, first, step)

    def sums(self, x: np.ndarray, places: np.ndarray, first: np.ndarray, step: int = 2048) -> np.ndarray:
        logp = np.empty(len(places))
        for i in range(0, len(places), step):
            part, state = self.forward(x, places[i:i + step])
            logp[i + state[0]] = part
        total = np.concatenate(([0.0], np.cumsum(logp)))
        return total[first[1:]] - total[first[:-1]]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in _SHAPES])

    def with_flat(self, flat: np.ndarray) -> Network:
        return Network(self.hashes, self.ids, _unflat(flat), self.totals, self.words, self.corpus)


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as views of one array."""
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at:at + n].reshape(s)
        at += n
    return out


def _unflat(flat: np.ndarray) -> dict[str, np.ndarray]:
    return _views(flat.astype(np.float32))


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponentials of each row, in place and up to a factor; their sums)."""
    if not z.size:
        return z, np.ones(len(z), z.dtype)
    top = z.max()
    z -= top if top - z.min() < 60 else z.max(1, keepdims=True)  # one shift for all, unless rows could vanish
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): hash and count of every word over all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            word, many = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "n": pa.array(many.astype(np.int64))})

        for b in batches:
            data, starts, ends, _ = words_of([(t or "").encode() for t in b.column(0).to_pylist()], ALNUM)
            held.append(word_hashes(data, starts, ends))
            n += len(starts)
            if n > 1 << 23:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _top(counts: DataFrame, size: int) -> list:
    return counts.orderBy(F.desc("n"), "word").limit(size).collect()  # ``size`` rows


def _hashes(top: list) -> np.ndarray:
    return np.array([r.word for r in top], np.int64).view(np.uint64)


def vocabulary(docs: DataFrame, size: int = VOCABULARY, text_col: str = "text") -> np.ndarray:
    """Hashes of the most frequent words over all texts, most frequent first."""
    return _hashes(_top(word_counts(docs, text_col), size))


def _untrained(docs: DataFrame, seed: int, text_col: str, scratch: Scratch) -> Network:
    """A new network with the vocabulary of ``docs`` and the counts of all its other words."""
    counts = scratch.keep(word_counts(docs, text_col), "counts")
    top = _top(counts, VOCABULARY)
    network = Network.new(_hashes(top), seed)
    network.totals = np.zeros(HASHED)
    network.corpus = counts.agg(F.sum("n")).first()[0] or 0
    if len(top) == VOCABULARY:
        n, word = F.lit(top[-1].n), F.lit(top[-1].word)
        others = counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word)))
        for r in others.groupBy(F.pmod("word", F.lit(HASHED)).alias("place")).agg(F.sum("n").alias("n")).collect():  # HASHED rows
            network.totals[r.place] = r.n
        network.words = others.where("n > 1").select("word", F.round(F.log("n") * _UNIT).cast("long").alias("log_n"))
    return network


def _pieces(docs: DataFrame, network: Network, id_col: str | None, text_col: str) -> DataFrame:
    """(deal, ids): the texts' word ids in pieces of at most ``_PIECE`` words with the ``WINDOW`` ids on
    either side, as 16-bit integers, and a hash of the row and the place of the piece in it."""
    sent = docs.sparkSession.sparkContext.broadcast((network.hashes, network.ids))  # of fixed size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*sent.value, {})
        for b in batches:
            x, places, first = net.encode(b.column(1).to_pylist())
            x = x.astype(np.int16)
            rows, at, ids = [], [], []
            for row, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                for i in range(lo, hi, _PIECE):
                    rows.append(row)
                    at.append(i - lo)
                    ids.append(x[places[i] - WINDOW:places[min(i + _PIECE, hi) - 1] + WINDOW + 1].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int64()),
                                              pa.array(ids, pa.binary())], names=["tag", "at", "ids"])

    text = text_of(text_col)
    rows = docs.select(F.xxhash64(*([id_col] if id_col else []), text).alias("tag"), text.alias("text"))
    return rows.mapInArrow(encode, "tag long, at long, ids binary").select(F.xxhash64("tag", "at").alias("deal"), "ids")


def _plan(words: int, rounds: int | None) -> tuple[int, int]:
    """(rounds, copies of a round) for a corpus of so many words: a copy takes ``_SLICE`` words a round,
    rounds grow with the root of the slices up to ``_ROUNDS``, copies up to ``_COPIES``; beyond, slices
    grow. So neither depends on files or partitions, and no copy learns from a sliver."""
    slices = -(-words // _SLICE)
    rounds = rounds or max(1, min(_ROUNDS, math.isqrt(slices)))
    return rounds, max(1, min(_COPIES, round(slices / rounds)))


def train_network(docs: DataFrame, rounds: int | None = None, masked: float = 0.25, batch: int = 2048, seed: int = 1,
                  text_col: str = "text", id_col: str | None = None) -> Network:
    """Train on all texts of ``docs``. Pieces of the texts are dealt over rounds and copies by the hash of
    their row (``id_col`` sets rows of equal texts apart), and a copy takes them in the order of the hash:
    the result does not depend on files or partitions. A mask has the share ``masked`` of an Arrow batch's
    words; all masks are trained on."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "pseudolik")
    network = _untrained(docs, seed, text_col, scratch)
    rounds, copies = _plan(network.corpus, rounds)
    pieces = scratch.keep(_pieces(docs, network, id_col, text_col), "pieces")
    start = np.concatenate((network.flat(), np.full(len(network.flat()), 1e-8, np.float32)))  # parameters, Adagrad's memory
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((network.hashes, network.ids, start))  # of fixed size

        def fit(batches: Iterator[pa.RecordBatch], r=r, sent=sent) -> Iterator[pa.RecordBatch]:
            hashes, ids, begin = sent.value
            half = len(begin) // 2
            mine, memory = Network(hashes, ids, _unflat(begin[:half])), _unflat(begin[half:])
            rng = np.random.default_rng([seed, r, TaskContext.get().partitionId()])  # the copy's number
            seen = 0
            for b in batches:
                held = [np.frombuffer(v, np.int16) for v in b.column(0).to_pylist()]
                x = np.concatenate(held).astype(np.int64)
                inner = np.ones(len(x), bool)
                ends = np.cumsum([len(v) for v in held])
                for o in range(WINDOW):
                    inner[ends - 1 - o] = False
                    inner[ends - [len(v) for v in held] + o] = False
                places = np.flatnonzero(inner)
                rng.shuffle(places)
                for mask in np.array_split(places, max(1, round(1 / masked))):
                    for i in range(0, len(mask), batch):
                        mine.train(x, mask[i:i + batch], memory)
                seen += len(places)
            if seen:
                flat = np.concatenate((mine.flat(), Network(hashes, ids, memory).flat()))
                blocks = [flat[i:i + _BLOCK] for i in range(0, len(flat), _BLOCK)]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(range(len(blocks)), pa.int32()), "weight": pa.array([float(seen)] * len(blocks)),
                    "values": pa.array([v.astype(np.float64).tolist() for v in blocks], pa.list_(pa.float64()))})

        turn = F.pmod("deal", F.lit(rounds * copies))
        part = (pieces.where(F.pmod(turn, F.lit(rounds)) == r)
                .repartitionById(copies, F.floor(turn / rounds).cast("int")).sortWithinPartitions("deal").select("ids"))
        trained = part.mapInArrow(fit, "block int, weight double, values array<double>")
        mean = (trained.select("block", "weight", array_to_vector("values").alias("v"))
                .groupBy("block").agg(Summarizer.mean(F.col("v"), F.col("weight")).alias("v")).orderBy("block").collect())
        sent.unpersist()
        if mean:
            start = np.concatenate([row.v.toArray() for row in mean]).astype(np.float32)
            network = network.with_flat(start[:len(start) // 2])
    scratch.drop("pieces")
    return network


def score(df: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over all words), per_word (null without words)."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("doc_id", "text"))
    shares = None if network.totals is None else np.log(network.totals + 1)
    sent = spark.sparkContext.broadcast((network.hashes, network.ids, network.params))
    apart = network.words is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text (n_words, log_likelihood) and, if they are joined, for each of its
        words in a hashed place (word, k times). The first are dealt by their tags and add nothing."""
        net = Network(*sent.value)
        for b in batches:
            x, places, first, h = net.read(b.column(1).to_pylist())
            total = net.sums(x, places, first)
            texts, many, word, k = np.arange(b.num_rows), b.num_rows, b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
            if shares is not None:
                ids = x[places]
                at = np.flatnonzero(ids >= VOCABULARY)
                doc = np.repeat(texts, np.diff(first))[at]
                total = total - np.bincount(doc, shares[ids[at] - VOCABULARY], many)
                if apart and len(at):
                    h = h[at]
                    order = np.argsort(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # equal words of a text meet
                    h, doc = h[order], doc[order]
                    begins = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
                    texts = np.concatenate((texts, doc[begins]))
                    word = np.concatenate((word, h[begins].view(np.int64)))
                    k = np.concatenate((k, np.diff(np.append(begins, len(h)))))
            own = np.arange(len(texts)) >= many
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(texts)), b.column(2).take(pa.array(texts)), pa.array(word), pa.array(k),
                 pa.array(np.resize(np.diff(first).astype(np.int64), len(texts)), mask=own) if many else pa.nulls(0, pa.int64()),
                 pa.array(np.resize(total.astype(float), len(texts)), mask=own) if many else pa.nulls(0, pa.float64())],
                names=["doc_id", "tag", "word", "k", "n_words", "log_likelihood"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, tag long, word long, k long, n_words long, log_likelihood double")
    if apart:
        sums = (out.join(network.words, "word", "left").groupBy("doc_id", "tag")
                .agg(F.max("n_words").alias("n_words"), F.max("log_likelihood").alias("log_likelihood"),
                     F.count("n_words").alias("copies"), F.sum(F.col("k") * F.coalesce("log_n", F.lit(0))).alias("logs")))
        # repeated rows are summed as one and dealt out again
        out = (sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
               .withColumn("log_likelihood", F.col("log_likelihood") + F.col("logs") / F.col("copies") / _UNIT))
    return (out.select("doc_id", "n_words", "log_likelihood")
            .withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))))


def op5_pseudolik(spark, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train_network(docs, id_col="doc_id"))
