"""Embeddings whitened on the leading components of their exact integer scatter.

Entries become integers; every distinct vector counts once. Tasks sum vectors and products exactly, as limbs of longs, so the scatter
A = n * sum(x x') - S S', which is n^2 times the covariance, is exact at any size. Its characteristic polynomial is found modulo
many primes, each by reduction to Hessenberg form in a task, and put together by Chinese remaindering. All its roots are real, so the sign
changes of a shifted polynomial count the roots to the right: bisection isolates the largest ones, with their multiplicity, to any precision.
Inverse iteration with decimals on the almost singular A - root gives the components, orthogonal within a cluster of equal roots.

The driver holds d * d numbers, never rows. Dimension: the commonest length of the vectors left (of equals the larger); vectors of another
length can't be whitened with them and are dropped like null ones. Integers beyond 64 bits are taken as the nearest long. Roots of 0 have no
component, so equal vectors, a single one or none give no rows. Repeated rows and ids give a row each; other columns are not read. `deviation` is null
where the exact number is beyond 64 bits; `deviation_digits` always has it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.session import settle

COMPONENTS = 4
DIGITS = 60  # of roots and components before they are rounded to doubles
LIMB = 30  # bits of a limb of the exact sums
PIECE = 21  # bits of a piece of an entry: products of pieces, added over PIECE_ROWS rows, stay exact in doubles
PIECE_ROWS = 512
PRIME_FROM = 2**31

Matrix = list[list[int]]


# ---- exact sums in Spark


def _as_integers(vec: str, scale: int):
    usable = F.col(vec).isNotNull() & F.forall(vec, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    return F.when(usable, F.transform(vec, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")))


def integer_vectors(rows: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is whole, finite and of the common length."""
    whole = rows.select("vec_id", F.col(vec).cast("array<double>").alias("vec")).select("vec_id", _as_integers("vec", scale).alias("x")).filter("x IS NOT NULL")
    lengths = whole.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return whole.filter(F.size("x") == F.lit(lengths["d"] if lengths else 0))


def _reach(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _pieces(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of pieces[i] << (PIECE * i), exact, with as few pieces as the largest entry needs."""
    out, rest = [], x
    while _reach(rest) >= 1 << PIECE:
        out.append((rest & ((1 << PIECE) - 1)).astype(float))
        rest = rest >> PIECE
    return [*out, rest.astype(float)]


def products(x: np.ndarray) -> np.ndarray:
    """The exact d x d sums of products of the rows of x, as Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    step = len(x) if _reach(x) ** 2 * len(x) < 1 << 53 and _reach(x) < 1 << PIECE else PIECE_ROWS
    for start in range(0, len(x), max(step, 1)):
        pieces = _pieces(x[start:start + step])
        for i, a in enumerate(pieces):
            for j, b in enumerate(pieces):
                total += (a.T @ b).astype(np.int64).astype(object) << (PIECE * (i + j))
    return total


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """value = sum of limb << (LIMB * k); every limb has the sign of value."""
    sign, rest, k = (1, value, 0) if value >= 0 else (-1, -value, 0)
    while rest:
        yield k, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        k += 1


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], Matrix]:
    """(n, S, A) of the vectors x of fit: their number, their sums, and n * sum(x x') - S S'."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, pairs = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = np.array(batch["x"].tolist(), np.int64).reshape(len(batch), d)
            both = products(np.hstack([x, np.ones((len(x), 1), np.int64)]))
            n, sums, pairs = n + len(x), sums + both[d, :d], pairs + both[:d, :d]
        rows = [(-1, -1, k, v) for k, v in _limbs(n)] + [(i, -1, k, v) for i in range(d) for k, v in _limbs(sums[i])]
        rows += [(i, j, k, v) for i in range(d) for j in range(i + 1) for k, v in _limbs(pairs[i, j])]
        yield pd.DataFrame(rows, columns=["i", "j", "k", "v"], dtype=np.int64)

    found = fit.select("x").mapInPandas(partial, "i long, j long, k long, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v"))
    n, sums, pairs = 0, [0] * d, [[0] * d for _ in range(d)]
    for r in found.collect():  # a few limbs for each of d * (d + 1) / 2 numbers
        value = r["v"] << (LIMB * r["k"])
        if r["i"] < 0:
            n += value
        elif r["j"] < 0:
            sums[r["i"]] += value
        else:
            pairs[r["i"]][r["j"]] += value
    whole = [[n * pairs[max(i, j)][min(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return n, sums, whole


# ---- characteristic polynomial


def hessenberg_polynomial(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo a prime below 2^31, constant first."""
    h = matrix.astype(np.int64) % p
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)  # minors[k]: the polynomial of the leading k rows and columns
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - int(h[k - 1, k - 1]) * minors[k - 1]) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            minors[k] = (minors[k] - int(h[i - 1, k - 1]) * below % p * minors[i - 1]) % p
    return minors[d].tolist()


def _is_prime(n: int) -> bool:
    """Miller and Rabin; these bases decide every number below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bits: int) -> list[int]:
    """Primes below PRIME_FROM whose product has more than so many bits."""
    out, left, n = [], bits, PRIME_FROM - 1
    while left >= 0:
        if _is_prime(n):
            out.append(n)
            left -= math.log2(n)
        n -= 2
    return out


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The integers next to 0 with these remainders, prime by prime."""
    done, modulus = None, 1
    for p, values in residues.items():
        if done is None:
            done = list(values)
        else:
            inverse = pow(modulus, -1, p)
            done = [a + modulus * ((v - a) * inverse % p) for a, v in zip(done, values)]
        modulus *= p
    return [a - modulus if 2 * a > modulus else a for a in done]


def characteristic_polynomial(spark: SparkSession, matrix: Matrix) -> list[int]:
    """Exact coefficients of det(t - matrix), constant first, for a matrix without negative eigenvalues; a task for some of the primes."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # the k-th coefficient is a sum of products of k eigenvalues, largest where all are equal
    bound = max((math.log2(math.comb(d, k)) + k * (math.log2(max(trace, 1)) - math.log2(k)) for k in range(1, d + 1)), default=0)
    primes = primes_beyond(math.ceil(bound) + 64)
    digits = [[hex(v) for v in row] for row in matrix]

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = [[int(v, 16) for v in row] for row in digits]
        for batch in batches:
            found = [hessenberg_polynomial(np.array([[v % p for v in row] for row in numbers], np.int64).reshape(d, d), p) for p in batch["p"].tolist()]
            yield pd.DataFrame({"p": batch["p"], "c": found})

    parts = min(len(primes), max(1, len(primes) * d**3 // 30_000_000), spark.sparkContext.defaultParallelism * 4)
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(parts)
    residues = {r["p"]: list(r["c"]) for r in table.mapInPandas(reduce, "p long, c array<long>").collect()}  # d + 1 numbers for each prime
    return remaindered(dict(sorted(residues.items())))


# ---- roots


def _shifted(poly: list[int], t: int) -> list[int]:
    """poly(x + t)."""
    out = list(poly)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += t * out[j + 1]
    return out


def roots_above(poly: list[int], t: int) -> int:
    """How many roots are larger than t, with their multiplicity. All roots must be real, which makes the sign changes exact."""
    signs = [c > 0 for c in _shifted(poly, t) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], t: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * t + c
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int, digits: int = DIGITS) -> list[tuple[Decimal, int]]:
    """(root, multiplicity) of the largest positive roots, falling, until `most` roots are covered; relative error below 10^-digits.

    Roots nearer to each other than that are one root with their common multiplicity.
    """
    positive = roots_above(poly, 0)
    if not positive:
        return []
    top = 1
    while roots_above(poly, top):
        top *= 2

    def in_units(bits: int) -> list[int]:
        """The polynomial whose roots are 2^bits times as large."""
        return [c << (bits * (len(poly) - 1 - i)) for i, c in enumerate(poly)]

    low = top.bit_length() - 1  # the last root that counts is above 2^low
    while roots_above(in_units(max(0, -low)), 1 << max(0, low)) < min(most, positive):
        low -= 1
    bits = max(0, math.ceil(digits * math.log2(10)) + 2 - low)
    fine = in_units(bits)

    def halved(a: int, above_a: int, z: int, above: int) -> tuple[int, int, int]:
        """a, z, roots above a: neighbours, or the two sides of a single root; more than `above` roots lie above a, no more above z."""
        while z - a > 1:
            middle = (a + z) // 2
            count = roots_above(fine, middle)
            if count > above:
                a, above_a = middle, count
            else:
                z = middle
            if above_a == above + 1 and _sign(fine, a) * _sign(fine, z) < 0:
                break
        return a, z, above_a

    def by_sign(a: int, z: int) -> tuple[int, int]:
        left = _sign(fine, a)
        while z - a > 1:
            middle = (a + z) // 2
            if _sign(fine, middle) == left:
                a = middle
            else:
                z = middle
        return a, z

    found, covered, end = [], 0, top << bits
    with localcontext(Context(prec=digits + 20)):
        while covered < min(most, positive):
            a, z, above = halved(0, positive, end, covered)
            end = a  # `above` roots lie beyond
            a, z = by_sign(a, z)
            found.append(((Decimal(a) + Decimal(z)) / 2 / (Decimal(2) ** bits), above - covered))
            covered = above
    return found


# ---- components


def _factorised(a: list[list[Decimal]]) -> tuple[list[list[Decimal]], list[int]]:
    """Rows of a, reduced in place with partial pivoting, and their order."""
    d, order = len(a), list(range(len(a)))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[pivot] = a[pivot], a[k]
        order[k], order[pivot] = order[pivot], order[k]
        if not a[k][k]:
            continue
        top = a[k]
        for i in range(k + 1, d):
            row = a[i]
            if row[k]:
                factor = row[k] / top[k]
                row[k] = factor
                for j in range(k + 1, d):
                    row[j] -= factor * top[j]
    return a, order


def _solved(factors: list[list[Decimal]], order: list[int], b: list[Decimal], tiny: Decimal) -> list[Decimal]:
    d = len(b)
    x = [b[i] for i in order]
    for i in range(d):
        x[i] -= sum((factors[i][j] * x[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        x[i] = (x[i] - sum((factors[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / (factors[i][i] or tiny)
    return x


def _unit(v: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
    for _ in range(2):
        for o in others:
            dot = sum((a * b for a, b in zip(v, o)), Decimal(0))
            v = [a - dot * b for a, b in zip(v, o)]
    length = sum((a * a for a in v), Decimal(0)).sqrt()
    return [a / length for a in v]


def components(matrix: Matrix, roots: list[tuple[Decimal, int]], most: int, digits: int = DIGITS) -> list[tuple[Decimal, list[Decimal]]]:
    """(root, unit vector) by falling root; vectors of a root with multiplicity are orthogonal to each other."""
    d, out = len(matrix), []
    with localcontext(Context(prec=digits + 20)):
        for root, times in roots:
            largest = max(root, Decimal(1))
            tiny = largest * Decimal(10) ** -(digits + 15)
            factors, order = _factorised([[Decimal(matrix[i][j]) - (root if i == j else 0) for j in range(d)] for i in range(d)])
            cluster: list[list[Decimal]] = []
            for k in range(min(times, most - len(out))):
                v = [Decimal(1 + (i * 7919 + k * 104_729) % 1009) for i in range(d)]
                for _ in range(3):
                    v = _unit(_solved(factors, order, _unit(v, cluster), tiny), cluster)
                lead = next(a for a in v if abs(a) > Decimal(10) ** -20)
                v = [a if lead > 0 else -a for a in v]
                cluster.append(v)
                out.append((root, v))
    return out


# ---- whitening


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    vectors: list[list[float]]  # unit vectors
    values: list[float]  # eigenvalues of the covariance
    explained: list[float]


def fit_whitening(fit: DataFrame, most: int = COMPONENTS) -> Whitening:
    """Components of the distinct vectors x in fit."""
    spark = fit.sparkSession
    first = fit.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    n, sums, matrix = scatter(fit, d)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return Whitening(n, sums, [], [], [])
    found = components(matrix, largest_roots(characteristic_polynomial(spark, matrix), min(most, d)), most)
    with localcontext(Context(prec=DIGITS)):
        values = [float(root / (Decimal(n) * n)) for root, _ in found]
        return Whitening(n, sums, [[float(a) for a in v] for _, v in found], values, [float(root / trace) for root, _ in found])


def _centred(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, int]:
    """n * x - S, exact, and a bound of its entries."""
    reach = _reach(x) * w.n + max(map(abs, w.sums), default=0)
    kind = np.int64 if reach < 1 << 62 else object
    return x.astype(kind) * (np.int64(w.n) if kind is np.int64 else w.n) - np.array(w.sums, kind), reach


def _deviations(centred: np.ndarray, reach: int) -> list[int]:
    kind = np.int64 if reach * reach * max(centred.shape[1], 1) < 1 << 62 else object
    return [int(v) for v in (centred.astype(kind) ** 2).sum(axis=1)]


def projections(rows: DataFrame, w: Whitening) -> DataFrame:
    """rows of integer_vectors with whitened array<double>, deviation and deviation_digits."""
    d = len(w.sums)
    basis = np.array(w.vectors).T / (w.n * np.sqrt(np.array(w.values)))

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), np.int64).reshape(len(batch), d)
            centred, reach = _centred(x, w)
            exact = _deviations(centred, reach)
            yield pd.DataFrame({
                "vec_id": batch["vec_id"], "whitened": (centred.astype(float) @ basis).tolist(),
                "deviation": pd.array([v if v < 1 << 63 else None for v in exact], "Int64"), "deviation_digits": [str(v) for v in exact],
            })

    return rows.mapInPandas(whiten, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, whitened array<double>, deviation long, deviation_digits string")


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list minus the identity; covar_pop centres before it multiplies."""
    k = len(w.values)
    white = projections(fit.select(F.lit(0).cast("long").alias("vec_id"), "x"), w).select("whitened")
    part = lambda i: F.col("whitened")[i]
    entries = [F.abs(F.covar_pop(part(i), part(j)) - float(i == j)) for i in range(k) for j in range(i + 1)]
    return white.agg(F.array_max(F.array(*entries)).alias("most")).first()["most"]


def whitened(rows: DataFrame, vec: str = "embedding", scale: int = 256, most: int = COMPONENTS) -> DataFrame:
    """A row for every usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits."""
    integers = integer_vectors(rows, vec, scale)
    fit = settle(integers.select("x").distinct(), "distinct-vectors")
    w = fit_whitening(fit, most)
    if not w.values:
        empty = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
        return rows.sparkSession.createDataFrame([], empty)
    error = identity_error(fit, w)
    each = projections(integers, w).select("vec_id", "deviation", "deviation_digits", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, w.explained)), F.col("k") + 1)
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(error).alias("identity_error"), "deviation_digits",
    )
