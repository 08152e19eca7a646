"""Exact top-k retrieval against numpy brute force, including ties and batching."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadlens.operators import answer as A
from leadlens.operators import embed as E
from leadlens.operators import retrieve as R
from leadlens.operators.answer import answer_questions, append_answers, last_messages, retrieve, user_questions
from leadlens.operators.embed import embed_questions, embed_to_search, embed_with, term_frequencies, weigh
from leadlens.operators.retrieve import InvertedShard, nearest_dense, nearest_sparse


def test_dense_topk_matches_bruteforce(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[10] = x[11]                                   # exact tie
    q = rng.normal(size=(7, 8))
    items = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<float>")
    qs = spark.createDataFrame([(j, q[j].tolist()) for j in range(len(q))], "qid long, qvec array<double>")
    got = nearest_dense(items.repartition(4), qs, ["qid"], k=5, shard_bytes=500)   # shards of a few vectors
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in got.collect()}
    for j in range(len(q)):
        d = ((x.astype(np.float64) - q[j]) ** 2).sum(axis=1)
        ref = sorted(range(len(x)), key=lambda i: (round(d[i], 9), i))[:5]
        assert [got[(j, r)] for r in range(1, 6)] == ref


def test_sparse_retrieval_and_answers(spark):
    chunks = spark.createDataFrame([
        ("c1", "Tech industry lead with high revenue"), ("c2", "Retail industry lead"),
        ("c3", "engagement score 50"), ("c4", "revenue revenue revenue"), ("c5", "nothing in common")],
        "chunk_id string, text string")
    qs = spark.createDataFrame([(1, "What is the revenue?"), (2, "top industry"), (3, "ééé")], "qid long, text string")
    hits = retrieve(chunks, qs, ["qid"], k=2).collect()
    by_q = {}
    for h in hits:
        by_q.setdefault(h["qid"], []).append((h["rank"], h["chunk_id"]))
    assert sorted(by_q[1])[0][1] == "c4"
    assert len(by_q[3]) == 2                        # zero vector question still gets k hits
    ans = {r["qid"]: r for r in answer_questions(chunks, qs, ["qid"], k=2).collect()}
    assert ans[1]["response"].startswith("Revenue information:\n")
    assert ans[2]["contexts_used"] == 2


def test_retrieval_empty_corpus(spark):
    chunks = spark.createDataFrame([], "chunk_id string, text string")
    qs = spark.createDataFrame([(1, "revenue?")], "qid long, text string")
    ans = answer_questions(chunks, qs, ["qid"]).first()
    assert ans["contexts_used"] == 0 and ans["response"] == "Please check the 'Annual Revenue' column in the results table for revenue details."


def test_hits_and_answers_carry_metadata(spark):
    chunks = spark.createDataFrame([("c1", "revenue lead", "lead", "7", "Tech", None, "High"), ("c2", "other words", "summary", "0", None, None, None)],
                                   "chunk_id string, text string, type string, index string, industry string, company_size string, lead_score string")
    qs = spark.createDataFrame([(1, "revenue")], "qid long, text string")
    ans = answer_questions(chunks, qs, ["qid"], k=2).first()
    assert ans["source_ids"] == "c1,c2" and [s["type"] for s in ans["sources"]] == ["lead", "summary"]
    assert ans["sources"][0]["industry"] == "Tech" and ans["sources"][0]["lead_score"] == "High"


def test_every_user_turn_is_answered_and_numbered(spark):
    conv = spark.createDataFrame([(1, 0, "user", " \t top leads?\n"), (1, 1, "assistant", "x"), (1, 2, "user", "\u00a0 revenue? \u2003"),
                                  (1, 3, "user", " \n\t "), (2, 5, "user", "industry?"), (3, 0, "assistant", "hello")],
                                 "conv_id long, turn long, role string, text string")
    qs = user_questions(conv)
    assert sorted(map(tuple, qs.collect())) == [(1, 0, "top leads?"), (1, 2, "revenue?"), (2, 5, "industry?")]
    answers = qs.select("conv_id", "turn", F.concat(F.lit("to "), "text").alias("response"), F.lit(1).alias("contexts_used"))
    log = append_answers(conv, answers)
    new = sorted((r["conv_id"], r["turn"], r["text"]) for r in log.where("contexts_used is not null").collect())
    assert new == [(1, 4, "to top leads?"), (1, 5, "to revenue?"), (2, 6, "to industry?")]
    last = {r["conv_id"]: (r["text"], r["n_messages"]) for r in last_messages(log).collect()}
    assert last == {1: ("to revenue?", 6), 2: ("to industry?", 2), 3: ("hello", 1)}


def test_fixed_texts():
    assert A.NO_DATA == "No data available. Please upload and process lead data first."
    assert A.NO_CONTEXT == "No relevant context found."
    assert A.WHITE_SPACE == "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    assert A.FALLBACK_INDUSTRY == "Please check the 'Top Industries' chart in the dashboard for industry breakdown."


def test_any_embedder_plugs_in(spark):
    docs = spark.createDataFrame([(1, "aa b"), (2, None), (3, "b")], "id long, text string")
    vecs = embed_with(docs, lambda texts: [[t.count("a"), t.count("b")] for t in texts], ["id"])
    assert sorted((r["id"], r["embedding"]) for r in vecs.collect()) == [(1, [2.0, 1.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])]


def test_frequent_terms_are_split(spark):
    tf = spark.createDataFrame([(i, t, 1) for i in range(300) for t in ("all", f"t{i}")], "chunk_id long, term string, tf long")
    w = weigh(tf, spark.createDataFrame([("all", 300)] + [(f"t{i}", 1) for i in range(300)], "term string, df long"), F.lit(600), ["chunk_id"])
    assert w.count() == 600
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = weigh(tf, tf.groupBy("term").agg(F.count("*").alias("df")), F.lit(600), ["chunk_id"]).where("term = 'all'")
        assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def sparse(rng, n, vocabulary, most):
    """Unit vectors of few and of many terms, zero vectors, and copies."""
    out = []
    for i in range(n):
        size = int(rng.integers(0, most)) if i % 9 else 0
        terms = sorted(set((rng.zipf(1.3, size) % vocabulary).tolist()))
        w = rng.random(len(terms)) + 0.01
        out.append({f"t{t}": float(x) for t, x in zip(terms, w / max(1e-9, np.sqrt((w * w).sum())), strict=True)})
    for i in range(0, n - 7, 31):
        out[i + 7] = dict(out[i])
    return out


def as_rows(vectors):
    return [(i, [{"term": t, "w": w} for t, w in v.items()]) for i, v in enumerate(vectors)]


def nearest_by_force(items, q, k):
    qn = sum(x * x for x in q.values())
    d = [(round(qn + sum(x * x for x in c.values()) - 2 * sum(w * c.get(t, 0.0) for t, w in q.items()), 9), i) for i, c in enumerate(items)]
    return [i for _, i in sorted(d)[:k]]


def test_inverted_lists_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    items, questions = sparse(rng, 700, 300, 60), sparse(rng, 60, 330, 12)
    kind = "array<struct<term:string,w:double>>"
    left = spark.createDataFrame(as_rows(items), f"chunk_id long, vec {kind}").repartition(3)
    right = spark.createDataFrame([*as_rows(questions), (1000, None)], f"qid long, vec {kind}")
    for shard_bytes in (1 << 26, 100_000):
        got = {}
        for r in sorted(nearest_sparse(left, right, ["qid"], k=6, shard_bytes=shard_bytes).collect(), key=lambda r: (r.qid, r["rank"])):
            got.setdefault(r.qid, []).append(r.chunk_id)
        assert got == {j: nearest_by_force(items, q, 6) for j, q in enumerate(questions)} | {1000: nearest_by_force(items, {}, 6)}
    few = nearest_sparse(left.where("chunk_id < 3"), right, ["qid"], k=6)
    assert few.count() == 3 * 61 and nearest_sparse(left.where("chunk_id < 0"), right, ["qid"]).count() == 0


def test_blocks_that_cannot_reach_the_kth_distance_are_not_scored():
    """Scored pairs fall well below questions x items, and stay exact."""
    rng = np.random.default_rng(9)
    items, questions = sparse(rng, 4000, 3000, 80), sparse(rng, 100, 3000, 12)
    kind = pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())]))
    column = lambda vs: pa.array([v for _, v in as_rows(vs)], kind)
    shard = InvertedShard(pa.array(range(len(items))), column(items))
    q, c, _ = shard.search(column(questions), 5)
    ids = shard.ids.to_numpy()[c]
    for j, v in enumerate(questions):
        assert ids[q == j].tolist() == nearest_by_force(items, v, 5)
    assert shard.scored < 0.25 * len(items) * len(questions)


def test_equal_distances_do_not_score_every_item():
    """A term that nearly every item has puts all distances within 9 decimals of each other: the ids
    decide, and only blocks with small ids are scored. Also with copies and entries that come twice."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())]))
    column = lambda vs: pa.array([v for _, v in as_rows(vs)], kind)
    rng = np.random.default_rng(3)
    own = [rng.choice(500, 3, replace=False) for _ in range(4000)]
    items = [{"the": float(1e-6 * (1 + i % 7))} | {f"n{t}": 0.5773502 for t in own[i // 2]} for i in range(4000)]
    questions = [{"the": 1e-5}, {"the": 0.4}, {"n1": 0.5, "the": 1e-4}, {"n2": 0.3, "n3": 0.3}, {"none": 1.0}, {}]
    shard = InvertedShard(pa.array(range(len(items))), column(items))
    q, c, d = shard.search(column(questions), 5)
    ids = shard.ids.to_numpy()[c]
    for j, v in enumerate(questions):
        assert ids[q == j].tolist() == nearest_by_force(items, v, 5)
    shard.scored, shard.found = 0, {}
    shard.search(column(questions[:2]), 5)
    assert shard.scored < 0.8 * len(items)   # every item, twice, without the ids
    # terms that no item has may stand in the norm alone
    norms = pa.array([sum(x * x for x in v.values()) for v in questions])
    less = [{t: x for t, x in v.items() if t != "none"} for v in questions]
    q2, c2, d2 = InvertedShard(pa.array(range(len(items))), column(items)).search(column(less), 5, norms)
    assert q2.tolist() == q.tolist() and c2.tolist() == c.tolist() and np.allclose(d, d2, atol=1e-14)
    twice = pa.array([[{"term": "a", "w": 0.5}] * 2, [{"term": "a", "w": 0.7}], [{"term": "b", "w": 0.1}]], kind)
    shard = InvertedShard(pa.array([7, 8, 9]), twice, block=1, group=1)
    _, c, d = shard.search(pa.array([[{"term": "a", "w": 1.0}]], kind), 1)
    assert shard.ids.to_numpy()[c].tolist() == [7] and np.allclose(d, [-0.5])


def test_long_questions_are_scored_together():
    """Questions with many terms, vectors of any length, copies, and groups of any size: exact, and a group of items is
    gone through once for the first and once for the other questions of a block, not for every question."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())]))
    column = lambda vs: pa.array([v for _, v in as_rows(vs)], kind)
    for seed, n, nq, vocabulary, most, block, group in ((1, 2500, 300, 400, 90, 32, 32), (2, 300, 90, 60, 40, 4, 8), (3, 300, 90, 60, 40, 3, 5), (4, 40, 20, 9, 9, 1, 1)):
        rng = np.random.default_rng(seed)
        items, questions = sparse(rng, n, vocabulary, most), sparse(rng, nq, vocabulary + 9, most)
        items = [{t: w * (1 + i % 3 / 7) for t, w in v.items()} for i, v in enumerate(items)]
        dense = np.zeros((n + nq, vocabulary + 9))
        for i, v in enumerate(items + questions):
            for t, w in v.items():
                dense[i, int(t[1:])] = w
        shard, calls = InvertedShard(pa.array(range(n)), column(items), block, group), []
        one_group = shard._group
        shard._group = lambda *a: (calls.append(a[0]), one_group(*a))
        q, c, d = shard.search(column(questions), 5)
        ids = shard.ids.to_numpy()[c]
        want = (dense[n:] ** 2).sum(1)[:, None] + (dense[:n] ** 2).sum(1) - 2 * dense[n:] @ dense[:n].T
        for j in range(nq):
            near = np.lexsort((np.arange(n), np.round(want[j], 9)))[:5]
            assert ids[q == j].tolist() == near.tolist() and np.allclose(d[q == j], want[j][near], atol=1e-12)
        assert max(calls.count(g) for g in calls) <= 2


def test_questions_go_to_a_shard_in_blocks(spark, monkeypatch):
    """One row a block of questions, not one a question; and no more shards than the tasks that can run and the bytes ask for."""
    monkeypatch.setattr(R, "_QUESTIONS", 100)
    kind = "array<struct<term:string,w:double>>"
    questions = spark.createDataFrame([(i, [("a", 0.5), (f"t{i}", 0.25)] if i % 3 else []) for i in range(250)], f"qid long, vec {kind}").coalesce(1)
    blocks = [pa.ipc.open_stream(bytes(r[0])).read_all() for r in R._in_blocks(questions, ["qid"]).collect()]
    assert [b.num_rows for b in blocks] == [100, 100, 50] and [x for b in blocks for x in b["__q0"].to_pylist()] == list(range(250))
    assert blocks[0]["vec"].to_pylist()[:2] == [[], [{"term": "a", "w": 0.5}, {"term": "t1", "w": 0.25}]]
    items = spark.range(20 * R.SHARD_LEAST).select(F.col("id").alias("chunk_id"), F.array().cast(kind).alias("vec"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        near = nearest_sparse(items, questions, ["qid"])
        dealt = [e for e in near._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression" in e]
        assert near.count() == 250 * 5 and dealt[0].rstrip().endswith(f", {2 * spark.sparkContext.defaultParallelism}"), dealt
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_questions_leave_out_terms_that_no_chunk_has(spark):
    chunks = spark.createDataFrame([("c1", "red car"), ("c2", "blue car"), ("c3", "blue sky")], "chunk_id string, text string")
    qs = spark.createDataFrame([(1, "red planet far away"), (2, "nowhere")], "qid long, text string")
    _, dfreq, n = A.chunk_index(chunks)
    whole = {r.qid: {e.term: e.w for e in r.vec} for r in embed_questions(qs, ["qid"], dfreq, n).collect()}
    got = {r.qid: r for r in embed_to_search(qs, ["qid"], dfreq, n).collect()}
    assert [e.term for e in got[1].vec] == ["red"] and abs(got[1].vec[0].w - whole[1]["red"]) < 1e-15 and got[2].vec == []
    for i in (1, 2):
        assert abs(got[i].norm2 - sum(w * w for w in whole[i].values())) < 1e-12


def test_index_weighs_frequent_terms_where_they_are_read(spark, monkeypatch):
    """The same vectors whatever the size of the head; without rarer terms nothing is exchanged."""
    rows = [("a", "red car red"), ("b", "blue car"), ("c", None), ("d", "..."), ("e", "sky blue sky x9"), ("f", "car car")]
    more = [("e", "red sky"), (None, "blue moon")]   # a key that comes twice, and none

    def vectors(rows):
        vecs, dfreq, n = E.tfidf_index(spark.createDataFrame(rows, "chunk_id string, text string").repartition(2))
        plan = vecs._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.chunk_id or "", [(e.term, round(e.w, 12)) for e in r.vec]) for r in vecs.collect())
        return got, {r.term: r.df for r in dfreq.collect()}, plan

    def by_force(rows):
        tf, df = {}, {}
        for i, (k, t) in enumerate(rows):
            counts = {w: (t or "").split().count(w) for w in (t or "").replace("...", "").split()}
            tf.setdefault(k, []).extend(counts.items())
            for w in counts:
                df[w] = df.get(w, 0) + 1
        out = []
        for k, _ in rows:
            v = sorted((t, n * np.log((1 + len(rows)) / (1 + df[t]))) for t, n in (tf[k] if k else []))
            size = np.sqrt(sum(w * w for _, w in v))
            out.append((k or "", [(t, round(float(w / size), 12)) for t, w in v]))
        return sorted(out), df

    got, df, plan = vectors(rows)
    assert (got, df) == by_force(rows) and plan.count("Exchange") == plan.count("RoundRobinPartitioning") == 1
    assert vectors(rows + more)[:2] == by_force(rows + more)
    monkeypatch.setattr(E, "HEAD_TERMS", 2)
    assert vectors(rows)[:2] == by_force(rows) and vectors(rows + more)[:2] == by_force(rows + more)


def test_texts_are_counted_in_pieces_of_bounded_bytes(monkeypatch):
    """All terms of a piece are counted together; a piece is as small as its texts are long."""
    texts = ["b a b", None, "", "c", "a " * 40 + "a", "b", "b c"]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["id", "text"])
    monkeypatch.setattr(E, "_BYTES", 8)
    monkeypatch.setattr(E, "_TOGETHER", 3)
    assert [p.column(0).to_pylist() for p in E._pieces(b, 1)] == [[0, 1, 2], [3], [4], [5, 6]]
    terms, row, place, n = E._counted(b.column(1))
    got = [(int(i), terms[int(t)].as_py(), int(x)) for i, t, x in zip(row, place, n, strict=True)]
    assert got == [(0, "a", 1), (0, "b", 2), (3, "c", 1), (4, "a", 41), (5, "b", 1), (6, "b", 1), (6, "c", 1)]
    empty = E._unit(row[:0], 2, terms, place[:0], np.empty(0))
    assert empty.to_pylist() == [[], []] and E._counted(pa.array([None, ""], pa.string()))[1].tolist() == []


def test_negative_weights_are_refused():
    kind = pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())]))
    with pytest.raises(ValueError, match="negative"):
        InvertedShard(pa.array([1]), pa.array([[{"term": "a", "w": -1.0}]], kind))


def test_terms_are_counted_inside_their_row(spark):
    docs = spark.createDataFrame([(1, "A b-a  c9!"), (2, None), (3, " ... "), (4, "Ärger b")], "id long, text string")
    tf = term_frequencies(docs, ["id"])
    assert sorted(map(tuple, tf.collect())) == [(1, "a", 2), (1, "b", 1), (1, "c9", 1), (4, "b", 1), (4, "rger", 1)]
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()
