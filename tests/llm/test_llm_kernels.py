"""Small exact tests of the numeric kernels behind the operators."""

import datetime
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from leadlens.llm import curve, feistel, reshard, rtree, rules, secrets, shingles, spotsigs, tiling, wavelet
from leadlens.llm.common import ALNUM, word_hashes, words_of, worker_cache
from leadlens.llm.pseudolik import Network
from leadlens.llm.tokens import Encoder, tokenizer_path

WEIRD = ["", " ", "a", "A b\tc\n\nd", "it's 'sdf don't", "x y", "é, b", "²³ 12ab, c", "w### \"T\" !!x",
         "<|endoftext|> a", "\x1c a", "日本語 テスト。", " ' 's", "\n\nA\r\n B  ", "a.\u0085b", "ab- -c", "ǅ ª º", "é" * 3000, "the " * 2000]


def test_words_and_hashes_depend_on_the_word_alone():
    texts = [t.encode() for t in WEIRD]
    data, starts, ends, first = words_of(texts)
    h = word_hashes(data, starts, ends)
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen = {}
    for k, t in enumerate(WEIRD):
        words = re.findall(r"[^\x20\x09-\x0D]+", t.translate(fold))
        got = [bytes(data[a:b]).decode() for a, b in zip(starts[first[k]:first[k + 1]], ends[first[k]:first[k + 1]], strict=True)]
        assert got == words
        for w, x in zip(words, h[first[k]:first[k + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(words_of([b"a,b c"], ALNUM)[1]) == 3


def test_encoder_equals_the_library():
    e = Encoder(tokenizer_path())
    texts = WEIRD + [" ".join(random.Random(i).choices(["the", "Öl", "x1", "a,b", "don't", "...", "\n", "(y)"], k=50)) for i in range(30)]
    want = [np.array([*x.ids, 0], "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.batch(texts) == want
    assert e.batch(texts) == want  # all remembered
    small = Encoder(tokenizer_path(), memory_bytes=2000)
    for _ in range(3):  # forgets as it goes
        assert small.batch(texts, step=500) == want
        assert small.memory.size() <= 2000 + 40 * 3000
    long = [" ".join(random.Random(i).choices(texts, k=400)).replace("<|", "< |") for i in range(3)] + ["x" * 300_000]
    assert e.batch(long) == [e.whole(t) for t in long]


def test_memory_keeps_what_was_used_last():
    e = Encoder(tokenizer_path(), memory_bytes=1 << 20)
    often = " of the and barn "
    for i in range(30):
        e.batch([often + " ".join(f"q{i}w{j}" for j in range(3000))])
        assert e.memory.size() <= 1 << 20
    kept = {tuple(e.memory.pool[a:a + m].tolist()) for a, m in zip(e.memory.at.tolist(), e.memory.many.tolist(), strict=True)}
    assert tuple(e.pieces.ids(" barn")) in kept and tuple(e.pieces.ids(" q0w17")) not in kept


def test_hashes_of_long_texts_need_small_tables():
    """Tables of powers do not grow with the batch, and slices give what one sum gives."""
    rng = random.Random(2)
    texts = [" ".join("ab" * rng.randint(1, 9) for _ in range(20_000)).encode() for _ in range(4)] + [b"y" * 250_000 + b" z " + b"y" * 250_000]
    data, starts, ends, _ = words_of(texts)
    h = word_hashes(data, starts, ends).tolist()
    by_word = {}
    for a, b, x in zip(starts.tolist(), ends.tolist(), h, strict=True):
        assert by_word.setdefault(bytes(data[a:b]), x) == x
    assert len(set(h)) == len(by_word) and len(by_word) == 11
    assert all(len(v) <= (1 << 16) + 1 for k, v in worker_cache().items() if k[0] == "pow")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (5, 2), (700, 50257), (3000, 3), (1024, 70000)])
def test_wavelet_matrix_against_lists(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    image = wavelet.to_bytes(wavelet.WaveletMatrix.build(ids), [None, 7], [n, 0])
    m, docs, lengths = wavelet.from_bytes(image)
    assert docs == [None, 7] and lengths.tolist() == [n, 0]
    assert m.ids().astype(np.uint32).tolist() == ids.tolist()
    for i in rng.integers(0, n, 40) if n else []:
        assert m.access(int(i)) == ids[i]
    for v in [0, 1, top, 1 << 20, *ids[:5].tolist()]:
        at = np.flatnonzero(ids == v).tolist()
        assert m.count(v) == len(at) and m.occurrences(v) == at
        assert m.select(v, len(at)) == -1
        for i in (0, n // 3, n):
            assert m.rank(v, i) == int((ids[:i] == v).sum())


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    points = np.stack([g.ravel() for g in np.meshgrid(side, side, side)], 1)
    at = curve.hilbert_index(points, 3)
    assert sorted(at.tolist()) == list(range(512))
    path = points[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    keys = curve.curve_keys(["a b c", "a b c", "", "zz " * 500])
    assert keys[0] == keys[1] and (keys >= 0).all()


def test_communication_matrix_margins_and_law():
    counts, sizes = np.array([7, 0, 5, 8]), np.array([6, 5, 5, 4])
    total = np.zeros((4, 4))
    for seed in range(600):
        m = np.stack([reshard.matrix_row(counts, sizes, p, seed) for p in range(4)])
        assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all() and (m >= 0).all()
        total += m
    assert np.abs(total / 600 - np.outer(counts, sizes) / 20).max() < 0.15


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(3)
    good, bad, draws = 2_000_000_000, 6_000_000_000, 4000
    x = np.array([reshard.hypergeometric(rng, good, bad, draws) for _ in range(2000)])
    assert abs(x.mean() - 1000) < 5 and abs(x.var() / 750 - 1) < 0.15
    big = reshard.split_counts(rng, np.array([3_000_000_000, 1_000_000_000, 0]), 2_000_000_000)
    assert big.sum() == 2_000_000_000 and big[2] == 0


def test_gamma_tail_and_battery():
    assert secrets.gamma_tail(1, 2) == pytest.approx(math.exp(-2))
    assert secrets.gamma_tail(2, 1.5) == pytest.approx(math.exp(-1.5) * 2.5)
    assert secrets.gamma_tail(3, 30) == pytest.approx(math.exp(-30) * 481)
    assert secrets.gamma_tail(0.5, 2) == pytest.approx(math.erfc(math.sqrt(2)))
    rng = random.Random(1)
    p = [secrets.battery("".join(rng.choices(secrets.ENCODINGS["base62"], k=40)), "base62")["p"] for _ in range(400)]
    assert 0.35 < np.mean(p) < 0.65 and np.mean(np.array(p) < 0.05) < 0.12
    for text in ("Internationalization2Internationalization", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "0123456789abcdef0123456789abcdef"):
        assert secrets.battery(text, secrets.infer_encoding(text))["p"] < 0.01
    assert secrets.infer_encoding("justonelongwordofletters") is None


def test_false_discovery_cut():
    half = secrets.EDGES.index(0.5)
    clean = [0] * len(secrets.EDGES)
    assert secrets._cut(clean, 0.1) == 2.0
    words = clean.copy()
    words[0] = 1000
    assert secrets._cut(words, 0.1) == 2.0
    mixed = words.copy()
    for i in range(half, len(mixed)):
        mixed[i] = 10
    for i in range(6, half):
        mixed[i] = 10
    mixed[1] = 300
    assert 0.001 < secrets._cut(mixed, 0.1) <= 0.05


def test_false_discovery_cut_of_few_tokens():
    floor, half = secrets.EDGES.index(secrets.FLOOR), secrets.EDGES.index(0.5)
    for n in (1, 2, 3):
        for where in (floor, half - 1, half, len(secrets.EDGES) - 1):
            for words in (0, 1, 1000):
                cells = [0] * len(secrets.EDGES)
                cells[0], cells[where] = words, n
                assert secrets._cut(cells, 0.1) <= secrets.FLOOR
    for n in (7, 100, 100_000):  # none in the upper half: not random
        cells = [0] * len(secrets.EDGES)
        cells[floor] = n
        assert secrets._cut(cells, 0.1) == 2.0
    cells = [0] * floor + [40] * (len(secrets.EDGES) - floor)
    cells[floor] = 20_000  # an estimate from a large stratum
    assert 0.05 < secrets._cut(cells, 0.1) <= 0.1
    for k, n, p in ((0, 1, 0.5), (30, 100, 0.4), (480, 1000, 0.5)):
        assert secrets._at_most(k, n, p) == pytest.approx(sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert secrets._at_most(520, 1001, 0.52) == pytest.approx(secrets._at_most(519, 1000, 0.52), abs=0.02)


def test_tiles_equal_the_plain_greedy_algorithm():
    def plain(a, b, k):
        """Greedy string tiling as first published: rescan for the longest unmarked match."""
        ua, ub, total = [False] * len(a), [False] * len(b), 0
        while True:
            best, size = None, k - 1
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                        n += 1
                    if n > size:
                        best, size = (i, j), n
            if best is None:
                return total
            for x in range(size):
                ua[best[0] + x] = ub[best[1] + x] = True
            total += size

    rng = random.Random(5)
    for _ in range(60):
        a, b = rng.choices("abcd", k=rng.randint(0, 14)), rng.choices("abcd", k=rng.randint(0, 25))
        for k in (2, 3):
            seeds = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if a[i:i + k] == b[j:j + k]]
            tiles = tiling.tile(seeds, k, len(a)) if seeds else []
            covered = sum(t[2] for t in tiles)
            assert covered <= len(a) and all(a[i:i + n] == b[j:j + n] and n >= k for i, j, n in tiles)
            assert len({i + x for i, _, n in tiles for x in range(n)}) == covered == len({j + x for _, j, n in tiles for x in range(n)})
            # ties between matches of one length may be marked in another order
            assert abs(covered - plain(a, b, k)) <= k


def test_shingle_sets_against_tuples():
    texts = [*WEIRD, "a b c d", "A b c d", "a b c d e", "a b c d e a b c d e", None]
    sizes = []
    for t, s in zip(texts, shingles.shingle_sets(texts), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        want = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
        sizes.append(s)
    by = dict(zip(texts, sizes, strict=True))
    assert by["a b c d"].tolist() == by["A b c d"].tolist() != by["a b c d e"].tolist()
    assert set(by["a b c d e"].tolist()) < set(by["a b c d e a b c d e"].tolist())


def test_tree_gives_every_pair_the_bound_lets_through():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 700):
        counts = rng.poisson(rng.choice([3, 6, 20], n)[:, None], (n, rtree.GROUPS)).astype(np.int64)
        sizes, labels = counts.sum(1), rng.integers(0, 4, n)
        got = set()
        for a, b in rtree.RTree(sizes, counts, labels).pairs(chunk=64):
            got |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if labels[i] != labels[j]
                and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j])
                and np.minimum(counts[i], counts[j]).sum() >= rtree.need(sizes[i], sizes[j])}
        assert want <= got
        assert all(labels[i] != labels[j] for i, j in got)
    for a in range(1, 60):
        for b in range(a, 60):
            least = next((s for s in range(a + 1) if 100 * s >= 80 * (a + b - s)), None)
            assert rtree.need(a, b) == (least if least is not None else rtree.need(a, b)) and (least is None) == (rtree.need(a, b) > a)


def test_count_vector_bounds_counts():
    for n in (1, 300, 5000):
        s = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        s[:] = s << np.uint64(40) if n == 5000 else s  # one group holds all
        unit, v = rtree.count_vector(s)
        true = np.bincount((s >> np.uint64(32) & np.uint64(7)).astype(int), minlength=8)
        assert (v.astype(int) * unit >= true).all()


def test_permutation_and_formats():
    for size in (1, 2, 10, 1000, 4097):
        p = feistel.Permutation(b"k", size)
        assert sorted(map(p.encipher, range(size))) == list(range(size))
        assert all(p.decipher(p.encipher(i)) == i for i in range(size))
    to, back = feistel.Pseudonyms(b"k"), feistel.Pseudonyms(b"k", back=True)
    values = {"card": ["4111 1111 1111 1111", "4845168114407329"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
              "phone": ["+1 (414) 555-1791", "212-555-0100"], "ssn": ["123-45-6789"], "ipv4": ["152.143.123.131", "0.0.0.0"],
              "date": ["2024-02-29", "31/12/1999", "12/31/1999", "04.05.2001"], "email": ["und.34@mail7.example.com", "A.B@x.org"]}
    for kind, list_ in values.items():
        for v in list_:
            new = getattr(to, kind)(v)
            assert new != v and re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))).count("9") == new_digits(new)
            if kind != "ipv4":
                assert [re.sub(r"[a-zA-Z]", "a", re.sub(r"\d", "9", x)) for x in (new,)] == [re.sub(r"[a-zA-Z]", "a", re.sub(r"\d", "9", v))]
            assert getattr(back, kind)(new) == v
    assert to.card("4111111111111112") is None and to.date("2023-02-29") is None and to.iban("DE88 3704 0044 0532 0130 00") is None
    assert to.ssn("000-12-3456") is None and to.ipv4("1.2.3.256") is None


def new_digits(s):
    return sum(ch.isdigit() for ch in s)


def test_text_replacement_links_values_and_leaves_the_rest():
    names = feistel.Pseudonyms(b"k")
    a, spans = feistel.find_and_replace("Call +1 (640) 555-0953 on 2020-01-02, v 1.2.3.", names)
    b, _ = feistel.find_and_replace("+1 (640) 555-0953 again", names)
    assert [k for _, _, k in spans] == ["phone", "date"] and b[:17] in a and a.endswith(", v 1.2.3.")
    assert feistel.find_and_replace("no data: 12 345 6789, 3.14, 1/2", names) == ("no data: 12 345 6789, 3.14, 1/2", [])


def test_rules_learn_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(rules.FEATURES)))
    y = ((x[:, 1] > 0.6) & (x[:, 4] <= 0.5)).astype(float)
    model = rules.fit_rules(x, y)
    new = rng.random((2000, len(rules.FEATURES)))
    truth = (new[:, 1] > 0.6) & (new[:, 4] <= 0.5)
    assert ((model.log_odds(new) > 0) == truth).mean() > 0.97
    assert 0 < len(model.rules) < 60
    assert rules.fit_rules(x[:0], y[:0]).log_odds(x[:3]).tolist() == [0, 0, 0]
    assert (rules.fit_rules(x[:5], np.ones(5)).log_odds(x[:3]) > 1).all()


def test_pseudonyms_of_more_written_forms():
    to, back = feistel.Pseudonyms(b"k"), feistel.Pseudonyms(b"k", back=True)
    forms = {"phone": ["+15551234567", "+4930123456", "+49 30 1234567", "+49 30 123-4567", "+33 1 23 45 67 89", "+44 (20) 7946 0958", "+1 555 123 4567",
                       "+1-555-123-4567", "+1.555.123.4567", "555.123.4567", "555 123 4567"],
             "card": ["3782 822463 10005", "3782-822463-10005"],
             "date": ["3/4/2001", "13/4/2001", "3/25/2001", "1.12.1999", "2001-3-4", "03/4/2001", "9-9-2099"]}
    for kind, values in forms.items():
        for v in values:
            for text in (f"see {v}, and", f"é {v} 2024-01-15 x", f"({v})."):
                new, spans = feistel.find_and_replace(text, to)
                at = text.index(v)
                assert (at, at + len(v), kind) in spans, (v, spans)
                assert new != text and len(new) == len(text) and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text)
                old, again = feistel.find_and_replace(new, back)
                assert old == text and again == spans
    assert feistel.find_and_replace("+49 30 1234567", to)[0].startswith("+49 ") and feistel.find_and_replace("+4930123456", to)[0].startswith("+49")
    for text in ("1 + 2 + 30", "+5 10 20", "v 1.2.3, 10.20.3000", "x+12345678", "+1234567.89", "13/13/2001"):
        assert feistel.find_and_replace(text, to) == (text, [])
    rng = random.Random(8)
    for _ in range(500):
        text = " ".join("".join(rng.choices("0123456789+-./() ", k=rng.randint(3, 25))) for _ in range(3))
        new, spans = feistel.find_and_replace(text, to)
        assert feistel.find_and_replace(new, back) == (text, spans)


def test_network_gradient_and_learning():
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words[(s + i) % 30] for i in range(20)) for s in range(30)] * 4
    data, starts, ends, _ = words_of([t.encode() for t in texts], ALNUM)
    order = [h for h, _ in Counter(word_hashes(data, starts, ends).tolist()).most_common()]
    net = Network.new(np.array(order, np.uint64))
    x, places, _ = net.encode(texts[:3])
    _, state = net.forward(x, places)
    total = state[6].sum(1) - 1
    g = net.gradient(x, state)
    assert np.allclose(total, 0, atol=1e-4)
    for k, i in (("embed", (3, 2)), ("gate", (1, 5)), ("classes", (4, 7)), ("words", (3, 2, 0)), ("bias", (1,))):
        old = net.params[k][i]
        loss = []
        for e in (1e-2, -1e-2):
            net.params[k][i] = old + e
            loss.append(-float(net.forward(x, places)[0].astype(float).mean()))
        net.params[k][i] = old
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(float(g[k][i]), abs=2e-4)
    memory = {k: np.full(v.shape, 1e-8, np.float32) for k, v in net.params.items()}
    x, places, _ = net.encode(texts)
    for _ in range(60):
        net.train(x, places, memory)
    n, good = net.scores(texts[:10])
    shuffled = [" ".join(random.Random(i).sample(t.split(), 20)) for i, t in enumerate(texts[:10])]
    _, bad = net.scores(shuffled)
    assert n.tolist() == [20] * 10 and good.mean() > bad.mean() + 10
    assert [a.tolist() for a in net.scores(["", "  "])] == [[0, 0], [0.0, 0.0]]
    assert np.array_equal(net.with_flat(net.flat()).flat(), net.flat())


def test_spot_signatures():
    s = spotsigs.signatures("The quick brown fox is in the red barn with a big dog near the old mill by the sea shore and the tall tree top")
    assert len(s) >= 8 and s == set(spotsigs.parse(spotsigs.fingerprint(s)))
    assert spotsigs.signatures("") == set() and spotsigs.signatures("zzz") and spotsigs.jaccard(set(), set()) == 1.0
    assert spotsigs.jaccard({1}, set()) == 0 and spotsigs.jaccard({1, 2}, {2, 3}) == 1 / 3 and spotsigs.jaccard({1}, set(range(9)), 0.5) == 0


def test_spotsigs_have_one_definition_for_all_texts():
    """A signature depends on its own words alone: taking words away never adds one, but for the
    text's first, so a text around eight signatures and its edit are described alike."""
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(60)] + sorted(spotsigs.ANCHORS)
    for n in range(1, 60):
        ws = rng.choices(vocabulary, k=n)
        whole = spotsigs.signatures(" ".join(ws))
        assert whole
        for k in range(1, n):
            assert spotsigs.signatures(" ".join(ws[:k])) <= whole | spotsigs.signatures(" ".join(ws[:min(3, k)]))


def test_dates_are_linked_in_every_written_form():
    """All forms of a day give forms of one other day, and lead back."""
    to, back = feistel.Pseudonyms(b"k"), feistel.Pseudonyms(b"k", back=True)
    seen = {}
    for k in range(0, 73049, 61):
        d = datetime.date(1900, 1, 1) + datetime.timedelta(k)
        new = datetime.date.fromisoformat(to.date(d.isoformat()))
        assert seen.setdefault(new, d) == d
        forms = [(f"{d.year}{s}{d.month:0{w}d}{s}{d.day:0{v}d}", f"{new.year}{s}{new.month:0{w}d}{s}{new.day:0{v}d}") for s in "-/." for w in (1, 2) for v in (1, 2)]
        forms += [(f"{d.day:0{v}d}{s}{d.month:0{w}d}{s}{d.year}", f"{new.day:0{v}d}{s}{new.month:0{w}d}{s}{new.year}") for s in "-/." for w in (1, 2) for v in (1, 2)]
        if d.day > 12:
            forms += [(f"{d.month:0{w}d}/{d.day}/{d.year}", f"{new.month:0{w}d}/{new.day}/{new.year}") for w in (1, 2)]
        for a, b in forms:
            assert to.date(a) == b and back.date(b) == a
