"""Whitening of embeddings by the exact characteristic polynomial.

The scatter matrix of integer vectors is an integer matrix, so its characteristic
polynomial has integer coefficients. Spark sums the scatter exactly over all rows;
the polynomial is reduced to Hessenberg form modulo many primes, one prime a row
of a Spark job, and put together by Chinese remaindering. All its roots are real,
so Descartes' rule counts those above a rational number without fail: bisection
and secant steps isolate the largest ones to hundreds of bits, and inverse
iteration in long fixed-point numbers finds the null space at each of them, one
component a row. What the driver holds is bounded by the number of dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, smaller_batches
from .vectors import integer_vectors, matrix

#: Bits of a limb: products of two, summed over ``BLOCK`` rows, are exact in a double.
LIMB, BLOCK = 20, 1 << 13
#: Bits of a root below the largest one, and of the fixed-point numbers of the null spaces.
ROOT_BITS, WORK_BITS = 256, 640
#: Largest prime asked for: sums of products of two residues stay in a long.
TOP = (1 << 31) - 1


def exact_gram(y: np.ndarray) -> np.ndarray:
    """``y' y`` of rows of longs, as Python integers.

    Rows are cut into limbs of 20 bits, whose products are taken by the double
    matrix product in blocks that keep every sum below 2^53.
    """
    d = y.shape[1]
    total = np.zeros((d, d), dtype=object)
    for at in range(0, len(y), BLOCK):
        rest, limbs = y[at : at + BLOCK], []
        while True:
            if rest.size and -(1 << (LIMB - 1)) <= rest.min() and rest.max() < 1 << (LIMB - 1):
                limbs.append(rest.astype(np.float64))
                break
            limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
            rest = rest >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def scatter_sums(vectors: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows of ``vectors(y)``, sums of ``y``, and sums of ``y y'``, exactly.

    Every task adds up its own rows; the shuffle holds one value a pair of
    dimensions and task, in three limbs that decimals add without overflow.
    """
    base, width = 1 << 60, dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        n = 0
        for b in batches:
            y = matrix(b.column("y"), width)
            if not len(y):
                continue
            n += len(y)
            gram += exact_gram(y)
            total += ((y >> 32).sum(0).astype(object) << 32) + (y & 0xFFFFFFFF).sum(0).astype(object)
        if n:
            out = [(-1, -1, n)] + [(-1, j, v) for j, v in enumerate(total)] + [(i, j, gram[i, j]) for i in range(width) for j in range(i, width)]
            limbs = [(i, j, v % base, v // base % base, v // base // base) for i, j, v in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*limbs), [pa.int32()] * 2 + [pa.int64()] * 3)], list("ijabc"))

    parts = smaller_batches(vectors.select("y")).mapInArrow(run, "i int, j int, a long, b long, c long")
    rows = parts.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in "abc"]).collect()
    got = {(r.i, r.j): int(r.a) + int(r.b) * base + int(r.c) * base * base for r in rows}
    sums = [got.get((-1, j), 0) for j in range(dims)]
    return got.get((-1, -1), 0), sums, [[got.get((min(i, j), max(i, j)), 0) for j in range(dims)] for i in range(dims)]


def _is_prime(n: int) -> bool:
    if n % 2 == 0 or any(n % q == 0 for q in (3, 5, 7, 11, 13, 17, 19, 23)):
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23)
    s = ((n - 1) & -(n - 1)).bit_length() - 1
    for a in (2, 3, 5, 7):  # enough for numbers below 3.2e9
        x = pow(a, n - 1 >> s, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``2 * bound``."""
    out, product, n = [], 1, TOP
    while product <= 2 * bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients, highest first, of ``det(x - a)`` modulo the prime ``p``."""
    h, d = a % p, len(a)
    for k in range(d - 2):
        below = np.nonzero(h[k + 1 :, k])[0]
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i > k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    # polynomials of the leading blocks, lowest coefficient first
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        shifted = np.roll(polys[m - 1], 1)
        new = (shifted - int(h[m - 1, m - 1]) * polys[m - 1] % p) % p
        run = 1
        for i in range(m - 1, 0, -1):
            run = run * int(h[i, i - 1]) % p
            if not run:
                break
            new = (new - int(h[i - 1, m - 1]) * run % p * polys[i - 1] % p) % p
        polys[m] = new
    return polys[d][::-1].tolist()


def characteristic_polynomial(spark, a: list[list[int]]) -> list[int]:
    """Coefficients, highest first, of the positive semidefinite integer matrix ``a``.

    The k-th is a sum over principal minors, at most ``C(d, k) (trace / d)^k``, which
    says how many primes are needed. One prime is one row of the job.
    """
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    mean = -(-trace // d)
    primes = primes_for(max(math.comb(d, k) * mean**k for k in range(d + 1)))
    shared = spark.sparkContext.broadcast([[str(x) for x in row] for row in a])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = np.array([[int(x) for x in row] for row in shared.value], dtype=object)
        for f in frames:
            yield pd.DataFrame({"p": f.p, "c": [polynomial_mod((full % p).astype(np.int64), p) for p in f.p.tolist()]})

    tasks = min(len(primes), max(spark.sparkContext.defaultParallelism, 1))
    table = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    value, modulus = [0] * (d + 1), 1
    for r in table.mapInPandas(run, "p long, c array<long>").collect():
        inverse = pow(modulus, -1, r.p)
        value = [v + modulus * ((c - v) * inverse % r.p) for v, c in zip(value, r.c)]
        modulus *= r.p
    return [v - modulus if 2 * v > modulus else v for v in value]


def roots_above(poly: list[int], num: int, bits: int) -> int:
    """How many roots of ``poly``, all of whose roots are real, exceed ``num / 2^bits``,
    each counted as often as it occurs: the sign changes of ``poly(x + num / 2^bits)``."""
    c = [v << (bits * i) for i, v in enumerate(poly)]
    d = len(c) - 1
    for k in range(d):
        for i in range(1, d - k + 1):
            c[i] += num * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def isolate(poly: list[int], k: int) -> tuple[int, int, int, int]:
    """``num, bits, first, times``: the k-th largest root is ``num / 2^bits``, rounded up
    at ``ROOT_BITS`` below the largest possible root; ``first`` is the rank of the
    first root that is equal to it at that precision, and ``times`` their number."""
    top = -poly[1] + 1  # above the trace
    bits = max(0, ROOT_BITS - top.bit_length())
    low, high = 0, top << bits
    count = lambda x: roots_above(poly, x, bits)
    value = lambda x: _value(poly, x, bits)
    at_low, at_high = count(low), 0
    while high - low > 1:
        if at_low - at_high == 1 and high - low > 16 and value(low):  # one simple root: the value changes its sign once
            low, high = _refine(value, low, high)
            break
        mid = (low + high) // 2
        n = count(mid)
        low, high, at_low, at_high = (mid, high, n, at_high) if n >= k else (low, mid, at_low, n)
    at_low, at_high = count(low), count(high)
    return high, bits, at_high + 1, at_low - at_high


def _value(poly: list[int], num: int, bits: int) -> int:
    """``poly(num / 2^bits)`` times ``2^(bits * degree)``."""
    v = 0
    for i, c in enumerate(poly):
        v = v * num + (c << (bits * i))
    return v


def _refine(value, low: int, high: int) -> tuple[int, int]:
    """A bracket of width 1 of the one root in ``(low, high]``, where ``low`` is no root:
    secant guesses with a grid that gets finer as they come true, bisection where
    they do not."""
    at_low, at_high = value(low), value(high)
    cells = 4
    while high - low > 1:
        if at_high == 0:
            return high - 1, high
        width = high - low
        cells = min(cells, width)
        k = min(cells - 1, at_low * cells // (at_low - at_high))
        a, b = low + width * k // cells, low + width * (k + 1) // cells
        va, vb = (at_low if a == low else value(a)), (at_high if b == high else value(b))
        if va == 0:
            return a - 1, a
        if vb == 0 or (va > 0) != (vb > 0):
            low, high, at_low, at_high, cells = a, b, va, vb, cells * cells
        else:
            mid = (low + high) // 2
            vm = value(mid)
            low, high, at_low, at_high = (mid, high, vm, at_high) if vm and (vm > 0) == (at_low > 0) else (low, mid, at_low, vm)
            cells = max(2, math.isqrt(cells))
    return low, high


def null_space(a: np.ndarray, num: int, bits: int, times: int) -> np.ndarray:
    """``times`` orthonormal rows that span the null space of ``a - num / 2^bits``.

    Inverse iteration: one elimination with row exchanges in fixed-point numbers
    of ``WORK_BITS`` bits beside the largest entry, then three solves of a block
    of fixed starting vectors, made orthonormal after each.
    """
    d = len(a)
    unit = 1 << WORK_BITS
    largest = max(1, int(max(abs(x) for x in a.ravel().tolist())))
    m = np.array([[((x << bits) - (num if i == j else 0)) * unit // (largest << bits) for j, x in enumerate(row)] for i, row in enumerate(a.tolist())], dtype=object)
    order = list(range(d))
    for k in range(d):
        p = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        if p != k:
            m[[k, p]] = m[[p, k]]
            order[k], order[p] = order[p], order[k]
        if m[k, k] == 0:
            m[k, k] = 1
        if k + 1 < d:
            f = m[k + 1 :, k] * unit // m[k, k]
            m[k + 1 :, k + 1 :] = m[k + 1 :, k + 1 :] - (f[:, None] * m[k, k + 1 :] >> WORK_BITS)
            m[k + 1 :, k] = f
    v = np.array([[((i * 7919 + j * 104729 + i * i * j * 31) % 1009 + 1) * unit // 1009 for j in range(d)] for i in range(1, times + 1)], dtype=object)
    for _ in range(3):
        for r in range(times):
            x = v[r][order]
            for k in range(1, d):
                x[k] -= int((m[k, :k] * x[:k]).sum()) >> WORK_BITS
            for k in range(d - 1, -1, -1):
                rest = int((m[k, k + 1 :] * x[k + 1 :]).sum()) >> WORK_BITS if k + 1 < d else 0
                x[k] = (x[k] - rest) * unit // m[k, k]
            v[r] = x
        for r in range(times):
            x = v[r]
            for _ in range(2):
                x = x * unit // max(1, math.isqrt(int((x * x).sum())))
                for q in range(r):
                    x = x - (v[q] * (int((x * v[q]).sum()) >> WORK_BITS) >> WORK_BITS)
            v[r] = x * unit // max(1, math.isqrt(int((x * x).sum())))
    return np.array([[int(x) / unit for x in row] for row in v])


def components(spark, a: list[list[int]], most: int) -> list[tuple[int, float, np.ndarray]]:
    """``number, eigenvalue, unit eigenvector`` of the ``most`` largest eigenvalues above
    zero of the positive semidefinite integer matrix ``a``; the largest entry of a
    vector is positive. Equal eigenvalues share an orthonormal basis."""
    d = len(a)
    shrink = math.gcd(*[x for row in a for x in row])
    if not shrink:
        return []
    small = [[x // shrink for x in row] for row in a]
    poly = characteristic_polynomial(spark, small)
    rank = d - next(i for i, c in enumerate(reversed(poly)) if c)
    shared = spark.sparkContext.broadcast(([str(c) for c in poly], [[str(x) for x in row] for row in small]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = [int(x) for x in shared.value[0]]
        full = np.array([[int(x) for x in row] for row in shared.value[1]], dtype=object)
        for f in frames:
            out = []
            for k in f.k.tolist():
                num, bits, first, times = isolate(c, k)
                vector = null_space(full, num, bits, times)[k - first]
                vector = vector * (1 if vector[np.argmax(np.abs(vector))] > 0 else -1)
                out.append((k, str(num), bits, vector.tolist()))
            yield pd.DataFrame(out, columns=["k", "num", "bits", "vector"])

    wanted = min(most, rank)
    table = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k int").repartition(wanted)
    rows = table.mapInPandas(run, "k int, num string, bits int, vector array<double>").collect()
    return [(r.k, int(r.num) * shrink / (1 << r.bits), np.array(r.vector)) for r in sorted(rows)]


def whiten(embeddings: DataFrame, most: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for
    each vector that can be used and each of the ``most`` largest components.

    Rows go whose vector is null, empty, holds null, NaN or infinite entries, or has
    another length than most vectors; rows are independent otherwise, so repeated
    rows and null ids stay, and count in the fit. Components whose eigenvalue is
    zero have no rows: with one vector, or equal vectors, there are none.
    ``deviation`` is null where it is too large for a long. Other columns are not read.
    """
    spark = embeddings.sparkSession
    vectors, d = integer_vectors(embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), "v")
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(embeddings.schema[vec_id].dataType.simpleString())
    if not d:
        return spark.createDataFrame([], schema)
    vectors = materialize(vectors)
    n, sums, squares = scatter_sums(vectors, d)
    a = [[n * squares[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    found = components(spark, a, most)
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(a[i][i] for i in range(d))
    # (n y - S) / n on the component, over the root of eigenvalue / n^2
    loads = np.column_stack([v / math.sqrt(e) for _, e, v in found])
    limit, longest = (1 << 62) // max(n, 1), (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.array(sums, dtype=object)
        for b in batches:
            y = matrix(b.column("y"), d)
            if not len(y):
                continue
            short = max(abs(int(y.min())), abs(int(y.max()))) < limit and max(map(abs, sums)) < 1 << 62
            t = y * n - centre.astype(np.int64) if short else y.astype(object) * n - centre
            small = short and max(abs(int(t.min())), abs(int(t.max()))) ** 2 * d < 1 << 63
            squared = (t * t).sum(1) if small else (t.astype(object) ** 2).sum(1)
            deviation = pa.array([int(x) if int(x) <= longest else None for x in squared], pa.int64())
            w = t.astype(np.float64) @ loads
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    kind = embeddings.schema[vec_id].dataType.simpleString()
    done = materialize(smaller_batches(vectors).mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>"))
    m = len(found)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    cov = done.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(cov, pairs))
    share = F.element_at(F.array(*[F.lit(e / trace) for _, e, _ in found]), F.col("at") + 1)
    return done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")
    )
