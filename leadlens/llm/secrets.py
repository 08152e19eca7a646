"""Secret scan with a battery of randomness tests.

Fixed patterns find assigned secrets, access keys and long hex runs. Besides, every run of 20 or
more token characters is taken as a candidate, and so are its parts of that length: those between
its signs, and the run without the plain words at its ends, so that neither ``name=`` nor the words
of a path hide a secret (``=`` ends a run; as padding it is not part of the span). A reported part
of a reported candidate is left out. For each candidate, its encoding is inferred from its characters, and
tests ask whether it looks drawn uniformly from that alphabet: chi-squared on the counts, split
into small letters, capitals, digits and signs against each other and the symbols within each
(with the exact mean and variance for a uniform alphabet, so short tokens are judged fairly),
a runs test on low and high symbols, and lag-one serial correlation. Fisher's method combines
them into one p-value, which is uniform for random tokens and near 0 for words and identifiers.

False discoveries are controlled per stratum (encoding x length class), over the whole table: the
number of random tokens is estimated from the upper half of the p-values, and the lowest cut is
taken at which the estimated share of non-random tokens among the reported is at most ``fdr``. The
estimate says little about a few tokens, so p-values of ``FLOOR`` and more are reported as well,
unless too few of them are in the upper half for random tokens (a binomial test at ``DOUBT``): that
takes seven tokens at least, and in large strata what is left is the estimate. A token that the
table repeats counts once. The tasks hand on one short row for each distinct token; what is
collected is a histogram of bounded size (strata x bins).

A null text counts as empty and has no spans. Repeated rows are scanned one by one. An empty
table gives an empty result. A column named ``spans`` in the input is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.common import prepare, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: Maximal runs, so asking for the least length in the pattern drops the same matches as afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
LEAST = 20
_SIGNS = re.compile(r"[+/_-]")
_SEGMENT = re.compile(r"[A-Za-z0-9]+")
#: What lies between the signs of one alphabet, of the other, and of both.
_BETWEEN = (re.compile(r"[^+/]+"), re.compile(r"[^_-]+"), _SEGMENT)

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Inferred encodings, narrowest first.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "hexup": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36up": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
KINDS = ["assign", "access", "hex", *(f"random_{e}" for e in ENCODINGS)]
_RANK = {k: i for i, k in enumerate(KINDS)}
_CLASSES = (str.islower, str.isupper, str.isdigit, lambda a: not a.isalnum())
#: p-values from here on are reported unless the upper half of them is as thin as random tokens
#: would leave it once in 1 / ``DOUBT`` strata.
FLOOR, DOUBT = 0.05, 0.01
#: Lower edges of the p-value bins.
EDGES = [0.0, 0.001, 0.002, 0.005, 0.01, 0.02, *(i / 20 for i in range(1, 20))]


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-14:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return min(1.0, h * scale)


def _mixed(token: str) -> bool:
    return sum(any(map(f, token)) for f in (str.islower, str.isupper, str.isdigit)) > 1


def infer_encoding(token: str) -> str | None:
    """The narrowest alphabet that holds the token; None for tokens of one class of characters
    (words, numbers), whose randomness says nothing about a secret."""
    if not _mixed(token):
        return None
    have = set(token)
    return next((e for e, a in ENCODINGS.items() if have <= set(a)), None)


def battery(token: str, encoding: str) -> dict[str, float]:
    """p-values of the tests and of their combination."""
    alphabet = ENCODINGS[encoding]
    k, n = len(alphabet), len(token)
    counts = Counter(token)
    groups = [g for g in ([a for a in alphabet if f(a)] for f in _CLASSES) if g]
    between = within = mean = var = 0.0
    for g in groups:
        m = sum(counts[a] for a in g)
        between += (m - n * len(g) / k) ** 2 / (n * len(g) / k)
        if m:
            within += len(g) / m * sum(counts[a] ** 2 for a in g) - m
            mean += len(g) - 1
            var += 2 * (len(g) - 1) * (m - 1) / m
    df, spread = len(groups) - 1, 2 * (len(groups) - 1) + sum(k / len(g) for g in groups) / n - (len(groups) ** 2 + 2 * len(groups) - 2) / n
    p_classes = gamma_tail(df * df / spread, between * df / spread)
    p_chi = gamma_tail(mean * mean / var, within * mean / var) if var else 1.0
    values = np.array([alphabet.index(ch) for ch in token], float)
    high = values >= k / 2
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mu = 1 + 2 * n1 * n2 / n
        sd = math.sqrt(max(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)), 1e-12))
        p_runs = math.erfc(abs(runs - mu) / sd / math.sqrt(2))
    else:
        p_runs = 2.0 ** (1 - n)
    centred = values - values.mean()
    spread = float((centred * centred).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / spread if spread else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    x = -sum(math.log(max(p, 1e-300)) for p in (p_classes, p_chi, p_runs, p_serial))
    combined = math.exp(-x) * (1 + x + x * x / 2 + x ** 3 / 6)
    return {"classes": p_classes, "chi": p_chi, "runs": p_runs, "serial": p_serial, "p": min(1.0, combined)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]]))


def parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of the run and of its parts of ``LEAST`` characters or more."""
    out = {(0, len(run))}
    if _SIGNS.search(run):
        for pattern in _BETWEEN:
            out.update(m.span() for m in pattern.finditer(run))
        mixed = [m.span() for m in _SEGMENT.finditer(run) if _mixed(m.group())]
        if mixed:
            out.add((mixed[0][0], mixed[-1][1]))
    return sorted(x for x in out if x[1] - x[0] >= LEAST)


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, int, float]]:
    """(start, end, encoding, length class, p) of tokens that no fixed pattern touches."""
    for m in CANDIDATE.finditer(text):
        for a, b in parts(m.group()):
            start, end = m.start() + a, m.start() + b
            if any(s < end and start < e for s, e, _ in base):
                continue
            token = text[start:end]
            encoding = infer_encoding(token)
            if encoding:
                yield start, end, encoding, int(2 * math.log2(len(token))), battery(token, encoding)["p"]


def thresholds(df: DataFrame, fdr: float = 0.1, text_col: str = "text") -> dict[tuple[str, int], float]:
    """Lowest reported p-value of each stratum (encoding, length class), from all texts."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for text in b.column(0).to_pylist():
                text = text or ""
                for s, e, enc, size, p in candidates(text, base_spans(text)):
                    token = hashlib.blake2b(text[s:e].encode("ascii"), digest_size=8).digest()
                    rows.add((int.from_bytes(token, "big", signed=True), enc, size, int(np.searchsorted(EDGES, p, side="right")) - 1))
            if rows:
                token, enc, size, cell = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"token": list(token), "enc": list(enc), "size": list(size), "cell": list(cell)})

    rows = (df.select(text_col).mapInArrow(tally, "token long, enc string, size long, cell long").distinct()
            .groupBy("enc", "size", "cell").agg(F.count("*").alias("n")).collect())  # strata x bins: bounded
    cells: dict[tuple[str, int], list[int]] = {}
    for r in rows:
        cells.setdefault((r.enc, r.size), [0] * len(EDGES))[r.cell] += r.n
    return {k: _cut(v, fdr) for k, v in cells.items()}


def _cut(cells: list[int], fdr: float) -> float:
    half, floor = EDGES.index(0.5), EDGES.index(FLOOR)
    high, many = sum(cells[half:]), sum(cells[floor:])
    least = FLOOR if many and _at_most(high, many, 0.5 / (1 - FLOOR)) >= DOUBT else 2.0
    for i in range(1, len(EDGES)):
        reported = sum(cells[i:])
        if reported and 1 - 2 * high * (1 - EDGES[i]) / reported <= fdr:
            return min(EDGES[i], least)
    return least


def _at_most(k: int, n: int, p: float) -> float:
    """Probability of ``k`` or fewer of ``n`` at chance ``p`` each."""
    if n > 1000:
        return math.erfc((n * p - k - 0.5) / math.sqrt(2 * n * p * (1 - p))) / 2
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))


def all_spans(text: str, cuts: dict[tuple[str, int], float]) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    found = [(s, e, f"random_{enc}") for s, e, enc, size, p in candidates(text, base) if p >= cuts.get((enc, size), 2.0)]
    added, reach = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[1] > reach:  # else part of one before
            added.append(x)
            reach = x[1]
    return sorted(base + added, key=lambda s: (s[0], _RANK[s[2]]))


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                      T.StructField("kind", T.StringType())])
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def find_secrets(df: DataFrame, fdr: float = 0.1, text_col: str = "text") -> DataFrame:
    """``df`` with ``spans``: start, end (code points, end exclusive) and kind of every secret, by
    start, then kind."""
    prepare(df.sparkSession)
    df = df.drop("spans")
    cuts = thresholds(df, fdr, text_col)
    at = df.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": s, "end": e, "kind": k} for s, e, k in all_spans(t or "", cuts)] for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, _ARROW_SPAN)], names=[*b.schema.names, "spans"])

    return df.mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField("spans", T.ArrayType(_SPAN))]))


def redact(df: DataFrame, fdr: float = 0.1, text_col: str = "text") -> DataFrame:
    """``df`` with every secret span (overlapping ones as one) replaced by ``[secret]``."""
    prepare(df.sparkSession)
    cuts = thresholds(df, fdr, text_col)
    at = df.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, done = [], 0
        for s, e, _ in all_spans(text, cuts):
            if s >= done:
                out += [text[done:s], "[secret]"]
            done = max(done, e)
        return "".join(out) + text[done:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array(map(clean, b.column(at).to_pylist()), b.column(at).type))

    return df.mapInArrow(scan, df.schema)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the fixed patterns, their digest, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def n(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
