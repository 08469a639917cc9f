"""Whitening of embeddings by the exact characteristic polynomial of their scatter matrix.

Entries become whole numbers, so all that follows up to the roots is exact:

1. The fit list has each distinct vector once. Its sums, and the products of its vectors less a whole
   number near their mean, are summed in tasks (as float64 products of 20-bit digits, which are
   exact in blocks of 4096 rows) and by Spark. That gives A = n^2 * covariance as integers.
2. The characteristic polynomial of A: for each prime of 31 bits a task reduces A modulo the prime
   to Hessenberg form and reads the polynomial off it; Chinese remaindering joins as many primes as
   the bound of the coefficients asks for.
3. All roots are real, so the number of roots above x, with multiplicity, is the number of changes of
   sign in the polynomial shifted by x. Bisection by that count separates the distinct roots, of
   which gcd(p, p') modulo primes tells the number, and quadratic refinement makes them precise.
4. For each of the first roots a task finds the null space of A - root by inverse iteration in
   decimal arithmetic; a root of multiplicity m gets m orthogonal vectors.

Rows are then projected in tasks. Only matrices of d x d numbers reach the driver, d being the
number of dimensions; vectors are shuffled once, to make them distinct.

Results for odd input. Rows whose vector is null, or holds null, NaN or infinite entries, are dropped, as are
those with an entry whose whole number would not fit a long, and those of another length than
most have (of equally frequent lengths the largest counts). Null ids and repeated rows are kept, and
get a row each. Components of eigenvalue 0 cannot be whitened and are left out, so fewer than two
distinct vectors give no rows. Equal eigenvalues share a space, of which some orthogonal vectors are
taken, the same for all rows. A deviation that does not fit a long is null. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, ship, table

# Steps of an entry's unit, what is added, and the components returned.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Bits of a digit and rows of a block, so that float64 sums of products of digits are exact.
DIGIT, BLOCK = 20, 4096
#: Bits to which an eigenvalue is known relative to its distance from others.
BITS = 128
#: Steps of inverse iteration at most; it ends when the space stays the same to 20 digits, mostly after three.
ROUNDS = 100
_HALF = 60


# -- polynomials and matrices of whole numbers --------------------------------------------------------


def primes(first: int, many: int) -> list[int]:
    """`many` primes below 2**31, after leaving out the `first` largest ones."""
    found, n = [], (1 << 31) - 1
    while len(found) < first + many:
        if _strong(n):
            found.append(n)
        n -= 2
    return found[first:]


def _strong(n: int) -> bool:
    """The strong test to the bases 2, 3, 5 and 7, which is exact below 3.2 * 10**9."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def characteristic_mod(a: np.ndarray, p: int) -> list[int]:
    """det(x - a) modulo p, from the coefficient of 1 on, for a of residues modulo p < 2**31."""
    h, n = a.astype(np.int64) % p, len(a)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        by = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - by[:, None] * h[k + 1] % p) % p
        # the column k + 1 gets the sum of the columns after it; each product is below 2**62, so it is reduced before it is summed
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * by % p).sum(axis=1)) % p
    # p_m = (x - h[m-1, m-1]) p_(m-1) - sum of h[i, m-1] times the subdiagonal from i to m-1, times p_i
    poly = np.zeros((n + 1, n + 1), np.int64)
    poly[0, 0] = 1
    for m in range(1, n + 1):
        factor, t = np.zeros(m, np.int64), 1
        factor[m - 1] = h[m - 1, m - 1]
        for i in range(m - 2, -1, -1):
            t = t * int(h[i + 1, i]) % p
            if not t:
                break
            factor[i] = int(h[i, m - 1]) * t % p
        row = (poly[:m] * factor[:, None] % p).sum(axis=0) % p
        poly[m, 1:] = poly[m - 1, :-1]
        poly[m] = (poly[m] - row) % p
    return poly[n].tolist()


def coefficient_bits(a: list[list[int]]) -> int:
    """Bits that any coefficient of det(x - a) has at most, a being symmetric and without negative eigenvalues.

    They are sums of products of eigenvalues, so at most the coefficients of (x + trace / n)^n.
    """
    n, trace = len(a), sum(row[i] for i, row in enumerate(a))
    mean = -(-trace // n)
    return max((math.comb(n, k) * mean**k).bit_length() for k in range(n + 1)) + 1


def joined(residues: dict[int, list[int]]) -> list[int]:
    """The whole numbers, the smallest in size, of these residues by prime."""
    modulus, out = 1, None
    for p, values in sorted(residues.items()):
        if out is None:
            out = list(values)
        else:
            inverse = pow(modulus, -1, p)
            out = [x + modulus * ((v - x) * inverse % p) for x, v in zip(out, values, strict=True)]
        modulus *= p
    return [x - modulus if 2 * x > modulus else x for x in out]


def distinct_roots(poly: list[int], tried: int = 3) -> int:
    """How many distinct roots there are: the degree less that of gcd(p, p'), the least over a few primes, as a prime may only add to it."""

    def gcd_degree(p: int) -> int:
        a, b = [c % p for c in reversed(poly)], [c * k % p for k, c in enumerate(poly)][:0:-1]
        while True:
            while b and not b[0]:
                b = b[1:]
            if not b:
                return len(a) - 1
            inverse = pow(b[0], -1, p)
            while len(a) >= len(b):
                q = a[0] * inverse % p
                a = [(x - q * y) % p for x, y in zip(a, b + [0] * (len(a) - len(b)), strict=True)][1:]
            a, b = b, a

    return len(poly) - 1 - min(gcd_degree(p) for p in primes(1000, tried))


class RealRoots:
    """A polynomial of whole numbers whose roots are all real and not negative."""

    def __init__(self, poly: list[int]):
        self.poly = poly

    def above(self, x: Fraction) -> int:
        """Roots greater than x, with multiplicity: changes of sign of the coefficients of p(x + t)."""
        u, v = x.numerator, x.denominator
        n = len(self.poly) - 1
        if u < 0:
            return n
        if not u:
            shifted = self.poly
        else:
            # p(u / v * (1 + t)) * v^n has the same signs
            powers_u, powers_v = [1], [1]
            for _ in range(n):
                powers_u.append(powers_u[-1] * u)
                powers_v.append(powers_v[-1] * v)
            shifted = [c * powers_u[k] * powers_v[n - k] for k, c in enumerate(self.poly)]
            for i in range(n):
                for j in range(n - 1, i - 1, -1):
                    shifted[j] += shifted[j + 1]
        signs = [c > 0 for c in shifted if c]
        return sum(a != b for a, b in zip(signs, signs[1:]))

    def isolated(self, count: int, top: Fraction, most: int) -> list[tuple[Fraction, Fraction, int]]:
        """Intervals (low, high] of the `count` distinct roots, from the largest down, with multiplicities; of those with the first `most` roots."""
        n = len(self.poly) - 1
        parts = [(Fraction(-1), top, n, 0)]  # low, high, roots above low, roots above high
        while len(parts) < count:
            following = []
            for low, high, a, b in parts:
                if a - b == 1:
                    following.append((low, high, a, b))
                    continue
                middle = (low + high) / 2
                m = self.above(middle)
                following += [x for x in ((middle, high, m, b), (low, middle, a, m)) if x[2] > x[3]]
            parts = following
        return [(low, high, a - b) for low, high, a, b in parts if b < most]

    def refined(self, low: Fraction, high: Fraction, bits: int) -> Fraction:
        """The root in (low, high] with an error of (high - low) / 2**bits at most; all in it is one root."""
        upper, width = self.above(high), (high - low) / (1 << bits)
        cuts = 2
        while high - low > width:
            step = (high - low) / cuts
            at = min(max(int((self._newton((low + high) / 2) - low) / step), 0), cuts - 1)
            a, b = low + at * step, low + (at + 1) * step
            if self.above(a) > upper and self.above(b) == upper:
                low, high, cuts = a, b, min(cuts * cuts, 1 << 48)
            elif cuts > 2:
                cuts = math.isqrt(cuts)
            else:
                low, high = (b, high) if self.above(b) > upper else (low, a)
        return (low + high) / 2

    def _newton(self, x: Fraction) -> Fraction:
        """x - m p / p' with the multiplicity m that the second derivative tells: exact for a power of a linear factor."""
        u, v, n = x.numerator, x.denominator, len(self.poly) - 1
        p = d = s = 0
        for k in range(n, -1, -1):  # p, p' and p'' / 2 of the polynomial times v^n
            s = s * u + d
            d = d * u + p
            p = p * u + self.poly[k] * v ** (n - k)
        # by Horner's rule p = v^n p(x), d = v^(n-1) p'(x), s = v^(n-2) p''(x) / 2
        below = d * d - 2 * p * s
        return x - Fraction(p * d, below * v) if below else x


def null_space(a: list[list[int]], root: Fraction, many: int, digits: int) -> list[list[float]]:
    """`many` orthonormal vectors of the eigenvalue near `root`, by inverse iteration with `digits` digits."""
    n = len(a)
    with localcontext(Context(prec=digits)):
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        m = np.array([[Decimal(x) for x in row] for row in a], object)
        m[np.arange(n), np.arange(n)] -= shift
        least = max(abs(x) for x in m.ravel()) * Decimal(10) ** -(digits - 2) or Decimal(1)
        order = np.arange(n)
        for k in range(n):
            pivot = k + max(range(n - k), key=lambda i: abs(m[k + i, k]))
            if pivot != k:
                m[[k, pivot]] = m[[pivot, k]]
                order[[k, pivot]] = order[[pivot, k]]
            if abs(m[k, k]) < least:
                m[k, k] = least
            by = m[k + 1 :, k] / m[k, k]
            m[k + 1 :, k + 1 :] -= by[:, None] * m[k, k + 1 :]
            m[k + 1 :, k] = by
        draw = random.Random(n * 1000 + many)
        vectors = [np.array([Decimal(draw.randrange(-(10**6), 10**6)) for _ in range(n)], object) for _ in range(many)]
        for _ in range(ROUNDS):
            before, solved = vectors, []
            for y in vectors:
                y = y[order].copy()
                for k in range(n):
                    y[k + 1 :] -= m[k + 1 :, k] * y[k]
                for k in range(n - 1, -1, -1):
                    y[k] = y[k] / m[k, k]
                    y[:k] -= m[:k, k] * y[k]
                for z in [*solved, *solved]:
                    y = y - z * (y * z).sum()
                solved.append(y / (y * y).sum().sqrt())
            vectors = solved
            # the squared sine of the angle between this space and the one before
            if many - sum((y * z).sum() ** 2 for y in vectors for z in before) < Decimal("1e-40"):
                break
        return [[float(x) for x in y] for y in vectors]


# -- jobs ---------------------------------------------------------------------------------------------


def _vectors(df: DataFrame, vector_col: str) -> Column:
    """x: the vector as whole numbers; null where the row is dropped for its entries."""
    entry = F.col(vector_col).cast("array<double>")
    fits = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit((2.0**63 - 2 * SHIFT) / STEPS)))
    return F.when(fits & (F.size(entry) > 0), F.transform(entry, lambda c: F.floor(c * STEPS) + SHIFT))


def _sums(fit: DataFrame, width: int) -> list[int]:
    """Sums of the entries by dimension; the number of rows last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            # halves of 32 bits, whose sums fit
            sums = [(int(h) << 32) + int(lo) for h, lo in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
            total = [a + b for a, b in zip(total, [*sums, len(x)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    found = dict(fit.select("x").mapInArrow(run, "i int, s decimal(38, 0)").groupBy("i").agg(F.sum("s").alias("s")).collect())  # width + 1 rows
    return [int(found.get(i, 0)) for i in range(width + 1)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _digits(d: np.ndarray) -> list[np.ndarray]:
    """Signed digits of DIGIT bits, the lowest first, as float64."""
    out = []
    while True:
        low = ((d + (1 << (DIGIT - 1))) & ((1 << DIGIT) - 1)) - (1 << (DIGIT - 1))
        out.append(low.astype(np.float64))
        d = (d - low) >> DIGIT
        if not d.any():
            return out


def _products(d: np.ndarray) -> np.ndarray:
    """The exact matrix of sums of products of the columns of d, as Python's whole numbers."""
    total = np.zeros((d.shape[1], d.shape[1]), object)
    for a in range(0, len(d), BLOCK):
        parts = _digits(d[a : a + BLOCK])
        for i, x in enumerate(parts):
            for j, y in enumerate(parts):
                total += (x.T @ y).astype(np.int64).astype(object) << (DIGIT * (i + j))
    return total


def _scatter(fit: DataFrame, centre: list[int], width: int) -> tuple[list[int], list[list[int]]]:
    """Sums of the vectors less `centre`, and of their products."""
    upper = [(i, j) for i in range(width) for j in range(i, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            d = _less(_matrix(batch.column(0), width), centre)
            if d.dtype == object:  # further from the centre than a long reaches
                d1 = np.concatenate([d, np.ones((len(d), 1), object)], axis=1)
                total += d1.T.dot(d1)
            else:
                total += _products(np.concatenate([d, np.ones((len(d), 1), np.int64)], axis=1))
        rows = [(i, j, int(total[i, j])) for i, j in [*upper, *((i, width) for i in range(width))]]
        # halves of _HALF bits, so that their sums fit a decimal however large the whole is
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([Decimal(f(r[2])) for r in rows], pa.decimal128(38, 0)) for f in (lambda v: v >> _HALF, lambda v: v & ((1 << _HALF) - 1)))],
            names=["i", "j", "high", "low"],
        )

    got = fit.select("x").mapInArrow(run, "i int, j int, high decimal(38, 0), low decimal(38, 0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found = {(r.i, r.j): (int(r.high) << _HALF) + int(r.low) for r in got}  # (width + 1)^2 / 2 rows
    return [found[i, width] for i in range(width)], [[found[min(i, j), max(i, j)] for j in range(width)] for i in range(width)]


def _less(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre, as longs if they surely fit."""
    if len(x) and max(int(np.abs(x // 2).max()) * 2 + 2, 0) + max(map(abs, centre)) >= 1 << 62:
        return x.astype(object) - np.array(centre, object)
    return x - np.array(centre, np.int64)


def characteristic(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """det(x - a) of a symmetric matrix without negative eigenvalues: one prime after the other in tasks, joined here."""
    many = coefficient_bits(a) // 30 + 2
    rows = spark.createDataFrame([(p,) for p in primes(0, many)], "p long").repartition(min(many, 4 * spark.sparkContext.defaultParallelism))
    sent = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps = batch.column(0).to_pylist()
            found = [characteristic_mod(np.array([[x % p for x in row] for row in sent.value], np.int64), p) for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "poly"])

    return joined({r.p: r.poly for r in ship(rows).mapInArrow(run, "p long, poly array<long>").collect()})


class Whitening:
    """What was learned: rows n of the fit list, sums, a centre near the mean, and by component vector, eigenvalue and share of the trace."""

    def __init__(self, n: int, sums: list[int], centre: list[int], vectors: list[list[float]], eigenvalues: list[Fraction], explained: list[float]):
        self.n, self.sums, self.centre, self.explained = n, sums, centre, explained
        #: n * x - sums is n * (x - centre) less this
        self.rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
        scale = np.array([1 / math.sqrt(e) for e in eigenvalues])
        self.matrix = np.array(vectors).reshape(-1, len(sums)).T * scale
        self.eigenvalues, self.vectors = [float(e) for e in eigenvalues], vectors

    def whitened(self, x: np.ndarray) -> np.ndarray:
        d = _less(x, self.centre)
        return (d.astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = _less(x, self.centre)
        reach = (int(np.abs(d).max()) if d.size else 0) * self.n + max(map(abs, self.rest))
        if d.dtype != object and reach * reach * x.shape[1] < 1 << 63:
            return ((self.n * d - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        every = ((self.n * d.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in every.tolist()]


def eigen(spark: SparkSession, a: list[list[int]], most: int) -> list[tuple[Fraction, list[float]]]:
    """The first `most` eigenvalues over 0, falling, and unit vectors, of a symmetric matrix without negative ones."""
    trace = sum(a[i][i] for i in range(len(a)))
    if not trace:
        return []
    roots = RealRoots(characteristic(spark, a))
    count = distinct_roots(roots.poly)
    parts = roots.isolated(count, Fraction(1 << trace.bit_length()), most)
    parts = [(low, high, m) for low, high, m in parts if high > 0 and roots.above(max(low, Fraction(0))) > roots.above(high)]
    tasks = []
    for low, high, many in parts:
        # digits: those of the largest root over the distance from others, twice, and those of the result
        near = trace.bit_length() - math.floor(math.log2(high - low))
        tasks.append((len(tasks), str(low), str(high), many, BITS, 40 + math.ceil((2 * max(0, near) + 2 * BITS) * 0.302)))
    rows = spark.createDataFrame(tasks, "k int, low string, high string, many int, bits int, digits int").repartition(len(tasks)) if tasks else None
    if rows is None:
        return []
    sent = spark.sparkContext.broadcast((a, roots.poly))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, poly = sent.value
        for batch in batches:
            for t in batch.to_pylist():
                root = RealRoots(poly).refined(Fraction(t["low"]), Fraction(t["high"]), t["bits"])
                found = null_space(matrix, root, t["many"], t["digits"])
                yield pa.RecordBatch.from_arrays([pa.array([t["k"]], pa.int32()), pa.array([str(root)]), pa.array([found], pa.list_(pa.list_(pa.float64())))], names=["k", "root", "vectors"])

    got = sorted(ship(rows).mapInArrow(run, "k int, root string, vectors array<array<double>>").collect())  # `most` vectors, and those of one root more
    return [(Fraction(r.root), list(v)) for r in got for v in r.vectors][:most]


def fit_list(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Each distinct vector x of whole numbers once, of the most frequent length."""
    x = ship(df).select(_vectors(df, vector_col).alias("x")).where("x is not null")
    return x.groupBy("x").agg(F.lit(1).alias("one")).select("x")


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening, float, int] | None:
    """The whitening, its identity error and the length of vectors; None if no component can be whitened."""
    spark = df.sparkSession
    lengths = ship(df).select(F.size(_vectors(df, vector_col)).alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    width = lengths[0].d
    listed = materialize(fit_list(df, vector_col).where(F.size("x") == width), "fit")
    *sums, n = _sums(listed, width)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    first, products = _scatter(listed, centre, width)
    scatter = [[n * products[i][j] - first[i] * first[j] for j in range(width)] for i in range(width)]
    found = eigen(spark, scatter, components)
    if not found:
        return None
    trace = sum(scatter[i][i] for i in range(width))
    white = Whitening(n, sums, centre, [v for _, v in found], [e / n**2 for e, _ in found], [float(e / trace) for e, _ in found])
    return white, identity_error(listed, white, width), width


def identity_error(listed: DataFrame, white: Whitening, width: int) -> float:
    """The largest entry, in size, of the covariance of the whitened fit list less the identity."""
    sent = listed.sparkSession.sparkContext.broadcast(white)
    k = len(white.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = sent.value.whitened(_matrix(batch.column(0), width))
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    # whitened vectors have mean 0 but for rounding, which the last column measures
    got = {(r.i, r.j): r.v for r in listed.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    n = got[k, k]
    return max(abs(got[i, j] / n - got[i, k] / n * got[j, k] / n - (i == j)) for i in range(k) for j in range(k))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row with a whole vector and each component: id, component, n, deviation, whitened, explained and identity_error."""
    kind = dict(df.dtypes)[id_col]
    out = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    learned = fit(df, vector_col, components)
    if learned is None:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {out}")
    white, error, width = learned
    rows = ship(df).select(F.col(id_col).alias("row"), _vectors(df, vector_col).alias("x")).where(F.size("x") == width)
    sent = df.sparkSession.sparkContext.broadcast(white)
    k = len(white.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                x = _matrix(part.column(1), width)
                which = pa.array(np.repeat(np.arange(len(x)), k))
                deviation = pa.array(model.deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(k * len(x), model.n), pa.int64()), deviation.take(which),
                        pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(k * len(x), error)),
                    ],
                    names=["row", *(c.split()[0] for c in out.split(", "))],
                )

    return rows.mapInArrow(run, f"row {kind}, {out}").withColumnRenamed("row", id_col)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
