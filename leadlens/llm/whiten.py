"""Whitening by the exact characteristic polynomial of the integer scatter.

Entries become whole numbers, so the scatter n * sum(x x') - S S' is an integer matrix that Spark's
partial sums give exactly. Its characteristic polynomial is taken modulo many primes (a Hessenberg
reduction each, dealt over tasks) and put together by Chinese remaindering; as all its roots are
real, the sign changes of the polynomial shifted by a count the roots above a exactly, multiple
ones included. Bisection by these counts isolates the largest eigenvalues to ``ROOT_BITS`` bits;
inverse iteration in fixed-point numbers of ``FIXED_BITS`` bits finds the null space at each, so
components hold to double precision also when eigenvalues nearly meet. Eigenvalues that agree in
all ROOT_BITS bits count as one multiple root; their components are an orthonormal basis.

What reaches the driver has the size of the dimension squared, whatever the number of rows.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are vectors
of another length than the most common one (the longer of two equally common). Entries beyond
2^50 / 1024 in size are taken as that bound. Repeated rows are whitened one by one. Rows without
vec_id stay. A component whose eigenvalue is zero has whitened null; ``identity_error`` covers the
others and is null if there are none; ``explained`` is null if the scatter is zero. ``deviation``
is null where it leaves 64 bits. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import prepare, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
_LIMIT = 1 << 50
ROOT_BITS, FIXED_BITS = 160, 512
_PRIME_BITS = 30


# ---------------------------------------------------------------- vectors as whole numbers

def _whole(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * c) of each entry, as int64 rows."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.clip(np.floor(SCALE * flat), -_LIMIT, _LIMIT).astype(np.int64).reshape(-1, dim)


def _gram(y: np.ndarray) -> np.ndarray:
    """y' y, exactly: in doubles where every sum fits, else in Python's numbers."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def usable(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, int]:
    """(vec_id, vec) of the rows that take part, and their dimension (0: none)."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad)
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common.dim if common else 0
    return rows.where(F.size("vec") == dim), dim


def scatter(rows: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums S of x, integer scatter n * sum(x x') - S S') of the rows' x-vectors."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, gram = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            y = _whole(b.column(0), dim)
            n += len(y)
            total += y.astype(object).sum(0) if np.abs(y).max(initial=0) > 1 << 40 else y.sum(0).astype(object)
            gram += _gram(y)
        cells = [n, *total, *(gram[i, j] for i in range(dim) for j in range(i, dim))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(cells)), pa.int32()), pa.array([str(int(v)) for v in cells])], names=["cell", "value"])

    cells = (rows.select("vec").mapInArrow(sums, "cell int, value string")
             .groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).orderBy("cell").collect())  # dim^2 / 2 rows
    if not cells:
        return 0, [0] * dim, [[0] * dim for _ in range(dim)]
    n, *rest = [int(r.value) for r in cells]
    t, at = rest[:dim], iter(rest[dim:])
    m = [[0] * dim for _ in range(dim)]
    for i in range(dim):
        for j in range(i, dim):
            m[i][j] = m[j][i] = n * next(at) - t[i] * t[j]  # the shift of x cancels
    return n, [v + SHIFT * n for v in t], m


# ---------------------------------------------------------------- characteristic polynomial

def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):  # decides below 3.2e9
        x = pow(a, d, n)
        if a % n and x not in (1, n - 1):
            for _ in range(s - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
    return True


def primes(count: int) -> list[int]:
    """The ``count`` largest primes below 2^_PRIME_BITS, or as many as there are."""
    out, n = [], (1 << _PRIME_BITS) - 1
    while len(out) < count:
        if _is_prime(n):
            out.append(n)
        n -= 2
    return out


def charpoly_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first) of det(z I - m) modulo p: Hessenberg form by similarity, then
    the recurrence over its leading minors."""
    h, d = m % p, len(m)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        r = k + int(below[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        factor = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * factor % p).sum(1)) % p
    minors = [np.zeros(d + 1, np.int64)]
    minors[0][0] = 1
    for k in range(d):
        q = np.concatenate(([0], minors[k][:-1])) - h[k, k] * minors[k] % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            q = q - int(h[i, k]) * product % p * minors[i] % p
        minors.append(q % p)
    return minors[-1].tolist()


def characteristic_polynomial(spark, m: list[list[int]]) -> list[int]:
    """Coefficients (constant first) of det(z I - m) of a positive semidefinite integer matrix."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # k-th coefficient: at most C(d, k) (trace / d)^k for non-negative roots
    bound = max(math.comb(d, k) * (trace ** k // max(d ** k, 1) + 1) for k in range(d + 1))
    ps = primes((2 * bound).bit_length() // (_PRIME_BITS - 1) + 2)
    text = [[str(v) for v in row] for row in m]  # dim^2 numbers

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[int(v) for v in row] for row in text], object).reshape(d, d)
        for b in batches:
            for p in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"p": [p], "c": [charpoly_mod((whole % p).astype(np.int64), p)]})

    table_ = spark.createDataFrame([(p,) for p in ps], "p long").repartition(min(len(ps), max(1, spark.sparkContext.defaultParallelism)))
    found = table_.mapInArrow(reduce, "p long, c array<long>").collect()  # one row a prime
    modulus = math.prod(ps)
    out = [0] * (d + 1)
    for r in found:
        rest = modulus // r.p
        unit = rest * pow(rest, -1, r.p)
        for k in range(d + 1):
            out[k] += r.c[k] * unit
    return [v - modulus if (v := c % modulus) > modulus // 2 else v for c in out]


# ---------------------------------------------------------------- roots

class RealRoots:
    """Counts of the roots of a polynomial (constant first) all of whose roots are real."""

    def __init__(self, coefficients: list[int]):
        self.c = coefficients

    def above(self, a: int, bits: int = 0) -> int:
        """How many roots, with their multiplicity, exceed a / 2^bits: the sign changes of the
        polynomial shifted to that point (Budan's bound, exact if all roots are real)."""
        d = len(self.c) - 1
        power, shifted = 1, []
        for k, v in enumerate(self.c):  # p(z + a) = sum c_k a^k (z / a + 1)^k, over a common 2^(bits d)
            shifted.append((v << bits * (d - k)) * (power if a else 1))
            power *= a
        if a:
            work = np.array(shifted[::-1], object)
            for k in range(d):
                work[:d + 1 - k] = np.add.accumulate(work[:d + 1 - k])
            shifted = work[::-1].tolist()
            signs = [(v > 0) - (v < 0) if a > 0 or k % 2 == 0 else (v < 0) - (v > 0) for k, v in enumerate(shifted)]
        else:
            signs = [(v > 0) - (v < 0) for v in shifted]
        signs = [s for s in signs if s]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def largest(self, count: int, bound: int) -> list[tuple[int, int, int]]:
        """The ``count`` largest of the roots in [0, bound], falling, as (a, bits, multiplicity) with
        the root in (a, a + 1] / 2^bits; a width of 2^-ROOT_BITS of the root. A zero is (-1, 0, m)."""
        zeros = next((k for k, v in enumerate(self.c) if v), len(self.c))
        roots = RealRoots(self.c[zeros:])
        out: list[tuple[int, int, int]] = []
        top = max(1, bound).bit_length()
        open_ = [(0, -top, roots.above(0), 0)]  # (a, bits, roots above a, roots above a + 1)
        while open_ and sum(x[2] for x in out) < count:
            a, bits, low, high = open_.pop()
            if low == high:
                continue
            if a and a.bit_length() > ROOT_BITS:
                out.append((a, bits, low - high))
                continue
            middle = roots._above_scaled(2 * a + 1, bits + 1)
            open_ += [(2 * a, bits + 1, low, middle), (2 * a + 1, bits + 1, middle, high)]
        if zeros and sum(x[2] for x in out) < count:
            out.append((-1, 0, zeros))
        return out

    def _above_scaled(self, a: int, bits: int) -> int:
        return self.above(a, bits) if bits >= 0 else self.above(a << -bits)


# ---------------------------------------------------------------- null spaces

def _solve_fixed(m: list[list[int]], shift: int, starts: list[list[int]], rounds: int = 3) -> list[list[int]]:
    """Inverse iteration with m - shift (entries and shift in units of 2^-FIXED_BITS): one LU, then
    ``rounds`` solves of each start, orthonormalised in between. All in fixed-point numbers."""
    d, one = len(m), 1 << FIXED_BITS
    a = np.array(m, object).reshape(d, d).copy()
    for i in range(d):
        a[i, i] -= shift
    order = list(range(d))
    for k in range(d):
        r = max(range(k, d), key=lambda i: abs(a[i, k]))
        if r != k:
            a[[k, r]] = a[[r, k]]
            order[k], order[r] = order[r], order[k]
        if not a[k, k]:
            a[k, k] = 1  # the matrix is singular to the last bit
        if k + 1 < d:
            a[k + 1:, k] = [(v << FIXED_BITS) // a[k, k] for v in a[k + 1:, k]]
            a[k + 1:, k + 1:] -= np.outer(a[k + 1:, k], a[k, k + 1:]) >> FIXED_BITS
    vectors = [np.array(s, object) for s in starts]
    for _ in range(rounds):
        solved = []
        for v in vectors:
            x = v[order].copy()
            for k in range(d):
                x[k + 1:] -= (a[k + 1:, k] * x[k]) >> FIXED_BITS
            for k in range(d - 1, -1, -1):
                x[k] = (int(x[k]) << FIXED_BITS) // a[k, k]
                x[:k] -= (a[:k, k] * x[k]) >> FIXED_BITS
            for u in solved:
                x = x - ((u * (int((u * x).sum()) >> FIXED_BITS)) >> FIXED_BITS)
            norm = math.isqrt(int((x * x).sum())) or 1
            x = np.array([(int(c) << FIXED_BITS) // norm for c in x], object)
            for u in solved:  # once more, after scaling
                x = x - ((u * (int((u * x).sum()) >> FIXED_BITS)) >> FIXED_BITS)
            norm = math.isqrt(int((x * x).sum())) or one
            solved.append(np.array([(int(c) << FIXED_BITS) // norm for c in x], object))
        vectors = solved
    return [v.tolist() for v in vectors]


def _fraction(v: int) -> float:
    """A fixed-point number as the nearest double."""
    return v / (1 << FIXED_BITS)


def eigen(m: list[list[int]], coefficients: list[int], count: int = COMPONENTS) -> tuple[list[float], list[float], np.ndarray]:
    """(eigenvalues as doubles, their shares of the trace, unit eigenvectors as rows), falling."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    count = min(count, d)
    values, shares, vectors = [], [], []
    unit = trace.bit_length()  # entries are scaled by 2^-unit, so that all are below one
    fixed = [[v << FIXED_BITS >> unit for v in row] for row in m]
    rng = np.random.default_rng(1)
    for a, bits, many in RealRoots(coefficients).largest(count, trace):
        middle, bits = (2 * a + 1, bits + 1) if a >= 0 else (0, 0)  # of the interval
        value = middle / (1 << bits) if bits >= 0 else float(middle << -bits)
        at = FIXED_BITS - bits - unit
        shift = middle << at if at >= 0 else middle >> -at
        wanted = min(many, count - len(values))
        starts = [[int(c) << (FIXED_BITS - 31) for c in rng.integers(-1 << 30, 1 << 30, d)] for _ in range(wanted)]
        for v in _solve_fixed(fixed, shift, starts):
            values.append(value)
            shares.append(value / trace if trace else math.nan)
            vectors.append([_fraction(c) for c in v])
    return values, shares, np.array(vectors).reshape(len(values), d)


# ---------------------------------------------------------------- the transform

@dataclass
class Whitening:
    n: int
    sums: list[int]
    eigenvalues: list[float]  # of the integer scatter: n^2 times those of the covariance
    explained: list[float]
    components: np.ndarray  # unit rows

    def project(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - S, exactly; whitened, nan where the eigenvalue is zero) of rows floor(SCALE * c)."""
        t = [s - SHIFT * self.n for s in self.sums]
        top = int(np.abs(y).max(initial=0))
        if self.n * top + max(map(abs, t)) < 1 << 62:
            diff = y * np.int64(self.n) - np.array(t, np.int64)
        else:
            diff = y.astype(object) * self.n - np.array(t, object)
        with np.errstate(divide="ignore", invalid="ignore"):
            roots = np.sqrt(np.array(self.eigenvalues))
            white = np.where(roots > 0, (diff.astype(np.float64) @ self.components.T) / roots, np.nan)
        return diff, white


def fit(df: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding", id_col: str = "vec_id") -> Whitening:
    """The whitening of all usable vectors of ``df``."""
    prepare(df.sparkSession)
    rows, dim = usable(df, vec_col, id_col)
    return _fit(rows, dim, components)


def _fit(rows: DataFrame, dim: int, components: int) -> Whitening:
    n, sums, m = scatter(rows, dim)
    if not n:
        return Whitening(0, sums, [], [], np.empty((0, dim)))
    values, shares, vectors = eigen(m, characteristic_polynomial(rows.sparkSession, m), components)
    return Whitening(n, sums, values, shares, vectors)


def _identity_error(rows: DataFrame, dim: int, w: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    live = [i for i, e in enumerate(w.eigenvalues) if e > 0]
    k = len(live)
    if not k:
        return None

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(k), np.zeros((k, k))
        for b in batches:
            white = w.project(_whole(b.column(0), dim))[1][:, live]
            total += white.sum(0)
            gram += white.T @ white
        cells = np.concatenate((total, gram.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "value"])

    # x - S / n is centred already; what rounding leaves of the mean is taken off
    cells = [r.value for r in rows.select("vec").mapInArrow(sums, "cell int, value double")
             .groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").collect()]
    mean, gram = np.array(cells[:k]) / w.n, np.array(cells[k:]).reshape(k, k) / w.n
    return float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row."""
    prepare(df.sparkSession)
    rows, dim = usable(df, vec_col, id_col)
    w = _fit(rows, dim, components)
    error = _identity_error(rows, dim, w) if w.n else None
    k = len(w.eigenvalues)
    explained = [None if math.isnan(x) else x for x in w.explained]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            diff, white = w.project(_whole(b.column(1), dim))
            m = len(diff)
            if int(np.abs(diff).max(initial=0)) ** 2 * dim < 1 << 63 and diff.dtype != object:
                deviation = pa.array((diff * diff).sum(1))
            else:
                wide = [int((r * r).sum()) for r in diff.astype(object)]
                deviation = pa.array([v if v < 1 << 63 else None for v in wide], pa.int64())
            at = pa.array(np.repeat(np.arange(m), k))
            flat = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)),
                 deviation.take(at), pa.array(flat, mask=np.isnan(flat)), pa.array(explained * m, pa.float64()),
                 pa.array([error] * (m * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings, whitened to their first components."""
    return whiten(table(spark, sf_dir, "embeddings"))
