"""Whitening, collision counting and spelling variants against brute force, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from leadlens.llm import collisions, permuterm, whiten
from leadlens.llm.queries import QUERIES
from tests.conftest import SF_SMALL

VECTORS = ("vec_id long, embedding array<float>, label int, vec string, h1 string, h2 string, ids string, shard string, "
           "component string, n string, cell string, value string, rank string, score string, near string, salt string")


def write(spark, tmp_path, rows, schema, name, pad=0):
    path = str(tmp_path / f"{name}.parquet")
    spark.createDataFrame([(*r, *["x"] * pad) for r in rows], schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def odd_vectors(dim=6, n=230):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)], i % 3) for i in range(n)]
    same = rows[0][1]
    rows += [(1000 + i, same, 0) for i in range(40)]  # copies of a query's own vector
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * dim, 0), (903, [math.nan] + [1.0] * (dim - 1), 0),
             (904, [math.inf] + [1.0] * (dim - 1), 0), (905, [None] + [1.0] * (dim - 1), 0), (None, same, 0),
             (5, rows[5][1], 0), (300, [1.0, 2.0], 0), (301, [1.0, 3.0], 0)]
    return rows


# ---------------------------------------------------------------- operator 12

def brute_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)) + 100000
    z = x - x.mean(0)
    values, axes = np.linalg.eigh(z.T @ z / len(x))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    n, s = len(x), [sum(int(v) for v in c) for c in x.T]
    deviation = [sum((n * int(v) - t) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
    return z @ axes / np.sqrt(values), values / np.trace(z.T @ z / len(x)), deviation


def test_whitening_of_odd_rows(spark, tmp_path):
    df = write(spark, tmp_path, odd_vectors(), VECTORS, "v", 13)
    got = sorted(whiten.whiten(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id, r.component))
    rows = sorted(((i, v) for i, v, _ in odd_vectors() if v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)),
                  key=lambda r: (r[0] is None, r[0]))
    white, share, deviation = brute_whitening([v for _, v in rows])
    at = [i for i, (v, _) in enumerate(rows) if v == 5]
    assert len(at) == 2  # repeated rows are whitened one by one, alike
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in rows for c in range(1, 7))
    got.sort(key=lambda r: (r.vec_id is None, r.vec_id))
    got[6 * at[0]:6 * at[0] + 12] = got[6 * at[0]:6 * at[0] + 12:2] + got[6 * at[0] + 1:6 * at[0] + 12:2]
    assert [r.deviation for r in got[::6]] == deviation and {r.n for r in got} == {len(rows)}
    mine = np.array([r.whitened for r in got]).reshape(-1, 6)
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-9
    assert np.allclose([r.explained for r in got[:6]], share, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_characteristic_polynomial(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-(10 ** (2 + 3 * seed)), 10 ** (2 + 3 * seed), (5, 5 - seed % 2)).astype(object)
    m = a @ a.T
    got = whiten.characteristic_polynomial(spark, m.tolist())
    want, power, c = [1], np.eye(5, dtype=object).astype(int).astype(object), 1  # Faddeev-LeVerrier, in whole numbers
    for k in range(1, 6):
        product = m @ power
        c = -sum(product[i, i] for i in range(5)) // k
        want.append(c)
        power = product + c * np.eye(5, dtype=int).astype(object)
    assert got == want[::-1]


def test_roots_multiple_zero_and_close():
    def poly(*roots):
        c = [1]
        for r in roots:
            c = [(c[k - 1] if k else 0) - r * (c[k] if k < len(c) else 0) for k in range(len(c) + 1)]
        return c

    r = whiten.RealRoots(poly(0, 0, 3, 3, 7, 10**30, 10**30 + 1))
    found = [((2 * a + 1) / 2 ** (bits + 1) if a >= 0 else 0, m) for a, bits, m in r.largest(7, 3 * 10**30)]
    assert [m for _, m in found] == [1, 1, 1, 2, 2]
    assert [round(v) for v, _ in found[2:]] == [7, 3, 0] and round(found[0][0] / 1e30, 6) == 1
    assert r.above(3) == 3 and r.above(2) == 5 and r.above(5, 1) == 5 and r.above(10**30) == 1


def test_components_of_equal_and_close_eigenvalues(spark):
    for m in ([[4, 0, 0], [0, 4, 0], [0, 0, 0]], [[10**12, 1, 0], [1, 10**12, 0], [0, 0, 10**12 + 1]], [[5]], [[0, 0], [0, 0]]):
        values, shares, v = whiten.eigen(m, whiten.characteristic_polynomial(spark, m))
        d, f = len(m), np.array(m, float)
        assert len(values) == d and values == sorted(values, reverse=True)
        assert np.abs(v @ v.T - np.eye(d)).max() < 1e-14
        assert np.abs(f @ v.T - v.T * np.array(values)).max() <= 1e-15 * max(1, np.abs(f).max()) * 4
    # close eigenvalues: vectors to the last bits, where doubles alone would mix them
    values, _, v = whiten.eigen([[10**15, 1], [1, 10**15]], whiten.characteristic_polynomial(spark, [[10**15, 1], [1, 10**15]]))
    assert np.abs(np.abs(v) - math.sqrt(0.5)).max() < 1e-15


def test_whitening_constant_empty_and_wide(spark, tmp_path):
    one = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]
    got = whiten.whiten(write(spark, tmp_path, one, VECTORS, "one", 13)).collect()
    assert len(got) == 4 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in got)
    line = [(i, [float(i), 2.0], 0) for i in range(5)]
    got = whiten.whiten(write(spark, tmp_path, line, VECTORS, "line", 13)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-12
    assert whiten.whiten(write(spark, tmp_path, [], VECTORS, "none")).collect() == []
    wide = [(i, [3e30 * i, 1e9 * i * i], 0) for i in range(-3, 4)]
    got = whiten.whiten(write(spark, tmp_path, wide, VECTORS, "wide", 13)).collect()
    assert len(got) == 14 and got[0].identity_error < 1e-9 and any(r.deviation is None for r in got)


def test_op12_on_the_given_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    got = sorted(QUERIES["op12_whitening"](spark, SF_SMALL).collect(), key=lambda r: (r.vec_id, r.component))
    white, share, deviation = brute_whitening([r.embedding for r in rows])
    mine = np.array([r.whitened for r in got]).reshape(-1, 8)
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-9
    assert [r.deviation for r in got[::8]] == deviation and np.allclose([r.explained for r in got[:8]], share, rtol=1e-9)


# ---------------------------------------------------------------- operator 11

def brute_neighbours(rows, k=10, every=100):
    best = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    out = {}
    for q in best:
        if q % every == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(best[q], v, strict=True))), i)
                          for i, v in best.items() if i != q and len(v) == len(best[q]))[:k]
            out[q] = near
    return out


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 26, 2000])
def test_neighbours_of_odd_rows(spark, tmp_path, shard_bytes):
    """One shard and several; ties, copies of a query, other lengths, rows that take no part."""
    df = write(spark, tmp_path, odd_vectors(), VECTORS, "v", 13)
    got, want = as_lists(collisions.neighbours(df, shard_bytes=shard_bytes)), brute_neighbours(odd_vectors())
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [i for _, i in got[0]] == list(range(1000, 1010)) and [i for _, i in got[1000]] == [0, *range(1001, 1010)]
    assert got[300] == [(1.0, 301)]
    for q in got:
        assert len(got[q]) == len(want[q]) and got[q] == sorted(got[q])


def test_neighbours_few_and_none(spark, tmp_path):
    few = [(100, [1.0, 0.0], 0), (3, [0.0, 1e-3], 0), (0, [-2.0, 5.0], 0)]
    got = as_lists(collisions.neighbours(write(spark, tmp_path, few, VECTORS, "few", 13)))
    want = brute_neighbours(few)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert as_lists(collisions.neighbours(write(spark, tmp_path, [], VECTORS, "none"))) == {}
    assert as_lists(collisions.neighbours(write(spark, tmp_path, [(100, [1.0], 0)], VECTORS, "alone", 13))) == {}


def test_collision_counts_pass_over_most_vectors():
    """Clustered vectors: few of the others are verified, and nothing near is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    vectors = (centres[:, None] + rng.normal(0, 0.05, (60, 40, 24))).reshape(-1, 24)
    shard, hits = collisions.Shard(vectors), 0
    queries = vectors[::24]
    for q, (places, distances) in zip(queries, shard.search(queries, 11), strict=True):
        true = np.argsort(((vectors - q) ** 2).sum(1), kind="stable")[:11]
        hits += len(set(true.tolist()) & set(places[np.argsort(distances, kind="stable")[:11]].tolist()))
    assert hits >= 0.95 * 11 * len(queries) and shard.verified < 0.1 * len(queries) * len(vectors)


def test_op11_recall_on_the_given_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    got, want = as_lists(QUERIES["op11_collisions"](spark, SF_SMALL)), brute_neighbours(rows)
    assert got.keys() == want.keys()
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    scores = {(q, i): s for q, v in want.items() for s, i in v}
    assert all(abs(s - scores.get((q, i), s)) < 1e-12 for q, v in got.items() for s, i in v)


# ---------------------------------------------------------------- operator 13

DOCS = "doc_id long, text string, word string, n string, rest string, letter string, form string, root string, best string"


def brute_variants(rows, ratio=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    close = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, vs in close.items():
        if vs and words[best := min(vs, key=lambda v: (-words[v], v))] >= ratio * words[w]:
            form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(close[w]), words[form[w]] if w in form else None))
    return out


def variant_rows(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_of_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    alphabet = "aabÀéÿz×÷"
    bases = ["".join(rng.choices(alphabet, k=rng.randint(6, 9))) for _ in range(40)]
    words = Counter()
    for w in bases:
        words[w] += 200
        for _ in range(12):
            i = rng.randrange(len(w))
            words[rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1:]])] += rng.choice([5, 6, 30])
    words.update({"aaaaaaa": 200, "aaaaaa": 40, "aaaaaaaa": 7, "baaaaa": 8, "aaaaab": 8, "chainword": 300, "chainwor": 50, "chainwo": 7})  # runs of one letter, a chain
    flat = [w for w, n in words.items() for _ in range(n)]
    rng.shuffle(flat)
    rows = [(i, " ".join(flat[a:a + 50])) for i, a in enumerate(range(0, len(flat), 50))]
    rows += [(7000, None), (7001, ""), (None, "Rotated ROTATED rotated rotatéd"), (7002, "rotated " * 6 + "Rotated_rotaTed1rotated"),
             (7003, "rotatÉd rotatéd rotatéd"), (7004, "rotatĀd rotatéd-rotatéd rotatéd"), rows[0], rows[0], (7005, "x" * 300_000)]
    rows += [(i, "doubleword doubleword") for i in range(8000, 8400)]  # some lose a letter
    df = write(spark, tmp_path, rows, DOCS, "d", 7)
    want = brute_variants(rows)
    assert variant_rows(permuterm.variants(df)) == want
    assert len({r for r in want if r[1]}) > 50 and any(r[2] not in (r[0], r[1]) for r in want)
    assert "doubleword" in {r[0] for r in want}


def test_variants_of_nothing(spark, tmp_path):
    assert permuterm.variants(write(spark, tmp_path, [], DOCS, "none")).collect() == []
    assert permuterm.variants(write(spark, tmp_path, [(1, None), (2, "short words only")], DOCS, "few", 7)).collect() == []


def test_long_chains_and_all_lengths(spark):
    """Forms of forms: every step loses a letter and gains a factor of five."""
    chain = [("a" * 0 + "bcdefghijklmnop"[i:], 5 ** (i + 1)) for i in range(9)]
    words = spark.createDataFrame(chain, "word string, n long")
    near = {r.word: r for r in permuterm.near_words(words).collect()}
    assert all(near[chain[i][0]].best == chain[i + 1][0] for i in range(8)) and near[chain[8][0]].best == chain[7][0]
    from leadlens.llm.common import Scratch
    forms = spark.createDataFrame([(chain[i][0], chain[i + 1][0]) for i in range(8)], "word string, form string")
    assert {r.root for r in permuterm.roots(forms, Scratch(spark, "t")).collect()} == {chain[8][0]}


def test_op13_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = variant_rows(QUERIES["op13_permuterm"](spark, SF_SMALL))
    assert got == brute_variants(rows)
