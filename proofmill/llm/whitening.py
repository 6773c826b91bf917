"""Whitening of embeddings by principal components from the exact characteristic polynomial of their scatter.

Entries are rounded to whole numbers (a constant added to them all, such as 1,000,000, changes no result
here, so none is added), and the scatter matrix is a matrix of whole numbers, summed exactly over
all vectors.  Its characteristic polynomial comes from Hessenberg forms modulo many primes (dealt over
tasks) and Chinese remaindering.  All its roots are real, so Descartes' rule counts those above a
bound exactly: roots are isolated and narrowed by exact signs.  Inverse iteration in long fixed-point
numbers then finds the null space of scatter minus root, again over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb, gcd, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, COMPONENTS = 64, 32
#: Binary digits of a root, relative to it, and of the numbers in inverse iteration.
ROOT_BITS, WORK_BITS = 120, 320
#: Rows of one exact product, bits of a limb: 2**11 products of 2**42 stay below 2**53.
BLOCK, LIMB = 2048, 20
DIGIT, DIGITS = 30, 6
MOST = float(1 << 62)


# --------------------------------------------------------------------------------------- polynomial of a matrix


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``limit`` (at most 2**31)."""
    small = np.ones(isqrt(limit) + 1, bool)
    small[:2] = False
    for p in range(2, isqrt(len(small)) + 1):
        if small[p]:
            small[p * p :: p] = False
    small = np.flatnonzero(small)
    out: list[int] = []
    while len(out) < count and limit > 3:
        low = max(2, limit - 40 * (count - len(out)) - 1000)
        sieve = np.ones(limit - low, bool)
        for p in small:
            if p * p >= limit:
                break
            sieve[max(p * p, -(-low // p) * p) - low :: p] = False
        out += [int(v) + low for v in np.flatnonzero(sieve)[::-1]][: count - len(out)]
        limit = low
    return out


def _inverse(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, e = np.ones_like(v), p - 2
    while e.any():
        out = np.where(e & 1, out * v % p, out)
        v, e = v * v % p, e >> 1
    return out


def polynomials_modulo(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of det(x - matrix) modulo each prime, by way of a Hessenberg form.  All primes step together."""
    d, p = len(matrix), np.array(primes, np.int64)
    a = np.stack([(matrix % q).astype(np.int64) for q in primes]) if d else np.zeros((len(p), 0, 0), np.int64)
    q, each = p[:, None], np.arange(len(p))
    for k in range(d - 2):
        at = k + 1 + (a[:, k + 1 :, k] != 0).argmax(1)  # a row with a pivot, where there is one
        rows = a[each, at].copy()
        a[each, at], a[:, k + 1] = a[:, k + 1], rows
        columns = a[each, :, at].copy()
        a[each, :, at], a[:, :, k + 1] = a[:, :, k + 1], columns
        f = a[:, k + 2 :, k] * _inverse(a[:, k + 1, k], p)[:, None] % q
        a[:, k + 2 :] = (a[:, k + 2 :] - f[:, :, None] * a[:, k + 1, None, :] % q[:, :, None]) % q[:, :, None]
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * f[:, None, :] % q[:, :, None]).sum(2)) % q
    poly = [np.ones((len(p), 1), np.int64)]
    for k in range(d):
        new = np.zeros((len(p), k + 2), np.int64)
        new[:, 1:] = poly[k]
        new[:, :-1] -= a[:, k, k, None] * poly[k] % q
        below = np.ones_like(p)
        for i in range(k - 1, -1, -1):
            below = below * a[:, i + 1, i] % p
            new[:, : i + 1] -= (a[:, i, k] * below % p)[:, None] * poly[i] % q
        poly.append(new % q)
    return poly[d]


def remaindered(residues: np.ndarray, primes: list[int]) -> list[int]:
    """The whole numbers, least in absolute value, that have these residues (one row a prime)."""
    whole = 1
    for p in primes:
        whole *= p
    parts = [whole // p * pow(whole // p, -1, p) for p in primes]
    out = []
    for column in residues.T:
        v = sum(int(r) * m for r, m in zip(column, parts)) % whole
        out.append(v - whole if 2 * v > whole else v)
    return out


def primes_for(matrix: np.ndarray) -> list[int]:
    """Primes whose product exceeds twice every coefficient of a positive semidefinite matrix's polynomial, and one to prove it."""
    d = len(matrix)
    mean = -(-int(np.trace(matrix)) // d)
    bits = max(comb(d, i).bit_length() + i * mean.bit_length() for i in range(d + 1)) + 2  # elementary symmetric sums are largest for equal roots
    return primes_below(1 << 31, bits // 30 + 2)


# ------------------------------------------------------------------------------------------------ real roots


def _divided(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder of whole polynomials, ``b`` with leading coefficient 1."""
    a, q = a[:], [0] * max(0, len(a) - len(b) + 1)
    for k in range(len(a) - len(b), -1, -1):
        q[k] = f = a[k + len(b) - 1]
        for i, c in enumerate(b):
            a[k + i] -= f * c
    return q, a[: len(b) - 1]


def _common_modulo(a: list[int], b: list[int], p: int) -> list[int]:
    """Greatest common divisor modulo a prime, leading coefficient 1."""
    a, b = ([c % p for c in v] for v in (a, b))
    while True:
        while b and not b[-1]:
            b.pop()
        if not b:
            inverse = pow(a[-1], -1, p)
            return [c * inverse % p for c in a]
        inverse = pow(b[-1], -1, p)
        b = [c * inverse % p for c in b]
        while len(a) >= len(b):
            f = a[-1]
            for i in range(len(b)):
                a[len(a) - len(b) + i] = (a[len(a) - len(b) + i] - f * b[i]) % p
            while a and not a[-1]:
                a.pop()
        a, b = b, a


def common_divisor(a: list[int], b: list[int]) -> list[int]:
    """Greatest common divisor of whole polynomials, ``a`` with leading coefficient 1: by primes until both divide exactly."""
    limit, best, images, used = 1 << 31, len(a), [], []
    while True:
        (p,) = primes_below(limit, 1)
        limit = p
        g = _common_modulo(a, b, p)
        if len(g) == 1:
            return [1]
        if len(g) > best:
            continue  # an unlucky prime
        if len(g) < best:
            best, images, used = len(g), [], []
        images.append(g)
        used.append(p)
        if len(used) & (len(used) - 1) == 0:  # tried at 1, 2, 4, 8 ... primes
            found = remaindered(np.array(images, object), used)
            if not any(_divided(a, found)[1]) and not any(_divided(b, found)[1]):
                return found


def square_free_parts(poly: list[int]) -> list[tuple[list[int], int]]:
    """(factor without repeated roots, multiplicity) of a whole polynomial with leading coefficient 1 (Yun)."""
    out, n = [], 1
    slope = [i * c for i, c in enumerate(poly)][1:]
    g = common_divisor(poly, slope)
    w, y = _divided(poly, g)[0], _divided(slope, g)[0]
    while len(w) > 1:
        z = [c - s for c, s in zip(y, [i * c for i, c in enumerate(w)][1:] + [0] * len(y))]
        g = common_divisor(w, z) if any(z) else w
        if len(g) > 1:
            out.append((g, n))
        w, y, n = _divided(w, g)[0], (_divided(z, g)[0] if any(z) else [0]), n + 1
    return out


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """How many roots of a polynomial with only real roots exceed ``at / 2**bits``: sign changes of the polynomial moved there (Descartes)."""
    n = len(poly) - 1
    c = [v << (bits * (n - i)) for i, v in enumerate(poly)]  # roots times 2**bits
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: list[int], at: int, bits: int) -> int:
    v = 0
    for i in range(len(poly) - 1, -1, -1):
        v = v * at + (poly[i] << (bits * (len(poly) - 1 - i)))
    return (v > 0) - (v < 0)


def real_roots(poly: list[int], above: int, digits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """(a, bits): every root of a square-free polynomial with positive real roots only, at most ``above``, as a / 2**bits to ``digits`` binary digits."""
    found, open_ = [], [(0, 1 << above.bit_length(), 0, len(poly) - 1, 0)]
    while open_:
        low, high, bits, n_low, n_high = open_.pop()
        if n_low == n_high:
            continue
        if n_low - n_high == 1 and low and high - low <= low:
            found.append((low, high, bits))
            continue
        if (low + high) % 2:
            low, high, bits = 2 * low, 2 * high, bits + 1
        mid = (low + high) // 2
        n = roots_above(poly, mid, bits)
        open_ += [(low, mid, bits, n_low, n), (mid, high, bits, n, n_high)]
    out = []
    for low, high, bits in found:
        more = max(0, digits + 2 - low.bit_length())
        low, high, bits = low << more, high << more, bits + more
        top = _sign(poly, high, bits)
        if top == 0:
            low = high
        while high - low > 1 and (high - low) << digits > low:
            mid = (low + high) // 2
            s = _sign(poly, mid, bits)
            if s == 0:
                low = high = mid
            elif s == top:
                high = mid
            else:
                low = mid
        out.append((low + high, bits + 1))
    return out


# ------------------------------------------------------------------------------------------------ components


def null_vectors(matrix: np.ndarray, root: int, bits: int, count: int, work: int = WORK_BITS) -> np.ndarray:
    """``count`` orthonormal vectors (rows) of the null space of matrix - root / 2**bits, by inverse iteration in fixed-point numbers."""
    d = len(matrix)
    size = max(1, max(abs(int(v)) for v in matrix.ravel()))
    up = max(0, work - size.bit_length())
    a = matrix.astype(object) * (1 << up)
    a[np.arange(d), np.arange(d)] -= (root << up) >> bits
    one = 1 << work
    rng = np.random.default_rng(5)
    b = np.array([[int(v) for v in row] for row in rng.integers(-(1 << 40), 1 << 40, (d, count))], object) * (one >> 40)
    lower = np.zeros((d, d), object)
    order = np.arange(d)
    for k in range(d):
        at = k + int(np.argmax([abs(v) for v in a[k:, k]]))
        for m in (a, lower):
            m[[k, at]] = m[[at, k]]
        order[[k, at]] = order[[at, k]]
        if a[k, k] == 0:
            a[k, k] = 1  # as small as these numbers get
        if k + 1 < d:
            f = np.array([(int(v) << work) // int(a[k, k]) for v in a[k + 1 :, k]], object)
            lower[k + 1 :, k] = f
            a[k + 1 :, k:] -= (f[:, None] * a[None, k, k:]) >> work
    for _ in range(3):
        b = b[order]
        for k in range(d - 1):
            b[k + 1 :] -= (lower[k + 1 :, k, None] * b[None, k]) >> work
        for k in range(d - 1, -1, -1):
            b[k] = np.array([(int(v) << work) // int(a[k, k]) for v in b[k]], object)
            b[:k] -= (a[:k, k, None] * b[None, k]) >> work
        done = []
        for j in range(count):  # orthonormal again
            v = b[:, j]
            top = max(1, max(abs(int(x)) for x in v)).bit_length()
            v = np.array([int(x) << (work - top) if top <= work else int(x) >> (top - work) for x in v], object)
            for w in done + done:
                v = v - ((w * (int((v * w).sum()) >> work)) >> work)
            norm = max(1, isqrt(int((v * v).sum())))
            done.append(np.array([(int(x) << work) // norm for x in v], object))
        b = np.stack(done, 1)
    return np.array([[float(int(x) >> (work - 64)) / 2.0**64 for x in v] for v in done])


# ---------------------------------------------------------------------------------------------------- Spark


def whole_numbers(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, floor(64 c) of their entries): rows whose list is there, complete, finite and of the width.

    Values beyond 2**62 count as that.  Without a width the rows' lengths come instead of the entries.
    """
    n = len(column)
    values = column.values if hasattr(column, "values") else column.flatten()
    offsets = column.offsets.to_numpy().astype(np.int64)
    entries = values.cast(pa.float64())
    bad = entries.is_null().to_numpy(zero_copy_only=False)
    flat = entries.fill_null(0.0).to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(flat)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    sizes = np.diff(offsets)
    good = (wrong[offsets[1:]] == wrong[offsets[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
    if width is None:
        return np.flatnonzero(good), sizes[good]
    rows = np.flatnonzero(good & (sizes == width))
    x = flat[offsets[:-1][rows][:, None] + np.arange(width)] if n and width else np.zeros((len(rows), width))
    return rows, np.floor(np.clip(x * SCALE, -MOST, MOST)).astype(np.int64)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as digits of 2**20, the last one signed: as many as its largest value needs."""
    out = []
    while len(x) and (x.max() >= 1 << LIMB or x.min() < -(1 << LIMB)):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray) -> np.ndarray:
    """x^T x as Python numbers, exactly."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i in range(0, len(x), BLOCK):
        parts = _limbs(x[i : i + BLOCK])
        for s, a in enumerate(parts):
            for t, b in enumerate(parts):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (s + t))
    return total


def _digits(values: list[int]) -> list[list[int]]:
    """Each value as DIGITS columns of base 2**DIGIT, the last one signed; sums of columns stay sums of values."""
    mask = (1 << DIGIT) - 1
    return [[(v >> (DIGIT * k)) & mask if k < DIGITS - 1 else v >> (DIGIT * k) for v in values] for k in range(DIGITS)]


def _sums(width: int):
    """Rows (i, j, digits): products for i <= j, plain sums for i = -1, the number of vectors for i = -2."""

    def run(batches):
        n, total, squares = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            _, x = whole_numbers(batch.column(0), width)
            one = np.ones((len(x), 1), np.int64)
            m = exact_products(np.concatenate([x, one], 1))
            squares, total, n = squares + m[:-1, :-1], total + m[-1, :-1], n + len(x)
        i, j = np.triu_indices(width)
        values = [int(v) for v in [*squares[i, j], *total, n]]
        first = np.concatenate([i, np.full(width, -1), [-2]])
        second = np.concatenate([j, np.arange(width), [0]])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *(pa.array(c, pa.int64()) for c in _digits(values))], ["i", "j", *(f"d{k}" for k in range(DIGITS))])

    return run


def scatter(vectors: DataFrame, column: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, n * sum of x x^T - sums sums^T) of floor(64 c), exact.  One row for each pair of dimensions reaches the driver."""
    names = [f"d{k}" for k in range(DIGITS)]
    parts = vectors.select(column).mapInArrow(_sums(width), "i int, j int, " + ", ".join(f"{c} long" for c in names))
    n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
    for r in parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names)).collect():
        v = sum(int(r[c]) << (DIGIT * k) for k, c in enumerate(names))
        if r["i"] == -2:
            n = v
        elif r["i"] == -1:
            sums[r["j"]] = v
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = v
    return n, sums, n * products - sums[:, None] * sums[None, :]


@dataclass
class Whitening:
    """What a row needs: mean of floor(64 c), components over the square root of their variance, shares of the variance."""

    width: int
    n: int
    sums: np.ndarray
    axes: np.ndarray
    explained: np.ndarray


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """det(x - matrix) of a positive semidefinite whole matrix; its primes are dealt over tasks, one more proves the result."""
    primes = primes_for(matrix)
    together = max(1, (1 << 22) // len(matrix) ** 2)  # matrices that a task holds at a time

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, together):
                some = b.column(0).slice(i, together)
                yield pa.RecordBatch.from_arrays([some, pa.array(polynomials_modulo(matrix, some.to_pylist()).tolist(), pa.list_(pa.int64()))], ["prime", "rest"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks)
    got = {r["prime"]: r["rest"] for r in dealt.mapInArrow(run, "prime long, rest array<long>").collect()}
    *used, proof = primes
    poly = remaindered(np.array([got[p] for p in used], object), used)
    if [c % proof for c in poly] != got[proof]:
        raise ArithmeticError("the characteristic polynomial does not hold modulo another prime")
    return poly


def principal_roots(poly: list[int], trace: int, most: int) -> list[tuple[int, int, int]]:
    """(a, bits, multiplicity) of the largest positive roots a / 2**bits, ``most`` of them counted as often as they occur."""
    while len(poly) > 1 and poly[0] == 0:
        poly = poly[1:]
    roots = [(a, bits, m) for part, m in square_free_parts(poly) for a, bits in real_roots(part, trace)]
    top = max((bits for _, bits, _ in roots), default=0)
    roots.sort(key=lambda r: -(r[0] << (top - r[1])))
    out, left = [], most
    for a, bits, m in roots:
        if left > 0:
            out.append((a, bits, min(m, left)))
            left -= m
    return out


def learn_whitening(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Components of all vectors; what reaches the driver are numbers for each pair of dimensions."""
    spark = vectors.sparkSession

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(whole_numbers(b.column(0))[1], pa.int64())], ["width"])

    found = vectors.select(column).mapInArrow(lengths, "width long").groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()
    width = int(found["width"]) if found else 0
    if not width:
        return Whitening(0, 0, np.zeros(0, object), np.zeros((0, 0)), np.zeros(0))
    n, sums, matrix = scatter(vectors, column, width)
    content = gcd(*(int(v) for v in matrix.ravel()))
    if not content:  # all vectors are equal
        return Whitening(width, n, sums, np.zeros((0, width)), np.zeros(0))
    small = matrix // content
    trace = int(np.trace(small))
    roots = principal_roots(characteristic_polynomial(spark, small), trace, components)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                a, bits, m = roots[k]
                v = null_vectors(small, a, bits, m)
                yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int32()), pa.array(v.tolist(), pa.list_(pa.float64()))], ["k", "v"])

    spread = spark.createDataFrame([(k,) for k in range(len(roots))], "k int").repartition(max(1, min(len(roots), spark.sparkContext.defaultParallelism)), "k")
    rows = sorted(((r["k"], r["v"]) for r in spread.mapInArrow(run, "k int, v array<double>").collect()))
    explained = np.array([(roots[k][0] << 256) // (trace << roots[k][1]) / (1 << 256) for k, _ in rows])
    # variance = root * content / n**2, its square root as a quotient of whole numbers
    deviation = [isqrt((roots[k][0] * content << 256) >> roots[k][1]) / (n << 128) for k, _ in rows]
    axes = np.array([v for _, v in rows]) / np.array(deviation)[:, None]
    return Whitening(width, n, sums, axes, explained)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    mean = np.array([float(int(s) // model.n) for s in model.sums])
    rest = np.array([int(s) % model.n / model.n for s in model.sums])
    return (x - mean) - rest


def _whitened(model: Whitening, emit):
    def run(batches):
        for batch in batches:
            rows, x = whole_numbers(batch.column(batch.num_columns - 1), model.width)
            yield from emit(batch, rows, x, _centred(x, model) @ model.axes.T)

    return run


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity: sums first, then products of centred values."""
    k = len(model.axes)
    if not k:
        return 0.0

    def totals(batches):
        s = np.zeros(k)
        for part in _whitened(model, lambda b, rows, x, w: [w.sum(0)])(batches):
            s += part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(s)], ["i", "s"])

    src = vectors.select(column)
    mean = np.zeros(k)
    for r in src.mapInArrow(totals, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        mean[r["i"]] = r["s"] / model.n

    def products(batches):
        s = np.zeros((k, k))
        for part in _whitened(model, lambda b, rows, x, w: [(w - mean).T @ (w - mean)])(batches):
            s += part
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s[i, j])], ["i", "j", "s"])

    cells = src.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return cells.select(F.max(F.abs(F.col("s") / model.n - (F.col("i") == F.col("j")).cast("double"))).alias("e")).first()["e"]


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Sum over dimensions of (n x - sums)**2 of each row, exactly."""
    most = max([model.n * max(1, int(np.abs(x).max(initial=0))), *(abs(int(s)) for s in model.sums)])
    if (2 * most) ** 2 * model.width < 1 << 62:
        return ((x * model.n - model.sums.astype(np.int64)) ** 2).sum(1).tolist()
    d = x.astype(object) * model.n - model.sums
    return [int(v) for v in (d * d).sum(1)]


def whitened_components(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component.

    Vectors that are null or hold a null or non-finite entry are left out, and so are those whose length
    is not the most frequent one (the smaller of equally frequent ones).  Only components with a positive
    variance are given: at most ``components``, none where all vectors are equal, no rows from an empty table.
    Repeated rows and keys stay; a null key stays null.  ``deviation`` is null beyond the range of a long.
    """
    model = learn_whitening(vectors, column, components)
    error, k = identity_error(vectors, column, model), len(model.axes)
    kind = vectors.schema[key].dataType.simpleString()
    names = ["key", "component", "deviation", "whitened", "explained"]

    def emit(batch, rows, x, w):
        at = pa.array(np.repeat(rows, k), pa.int64())
        big = pa.array([v if v < 1 << 63 else None for v in deviations(x, model)], pa.int64())
        each = pa.array(np.repeat(np.arange(len(rows)), k), pa.int64())
        columns = [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), big.take(each), pa.array(w.ravel()), pa.array(np.tile(model.explained, len(rows)))]
        yield pa.RecordBatch.from_arrays(columns, names)

    src = vectors.select(F.col(key).alias("key"), column)
    if not k:
        src = src.limit(0)
    out = src.mapInArrow(_whitened(model, emit), f"key {kind}, component int, deviation long, whitened double, explained double")
    return out.select(F.col("key").alias(key), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))
