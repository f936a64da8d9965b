"""Eigenvalues of integer matrices from their exact characteristic polynomial.

The polynomial comes from its residues: modulo each prime the matrix is reduced to
Hessenberg form and the polynomial read off by the usual recurrence, and the residues
are joined by Chinese remaindering. The matrices here are symmetric and positive
semidefinite, so all roots are real and not negative; then the number of roots above a
point is exactly the number of sign changes of the polynomial shifted to that point
(Descartes' rule, exact where all roots are real). Isolation halves intervals by that
count, and a simple root is refined by interpolation steps that are accepted only when
the sign changes across the smaller interval. All of it is integer arithmetic; roots are
dyadic intervals ``(a, b] / 2^k``.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

import numpy as np

#: digits of the elimination that finds null spaces
DIGITS = 100
#: bits to which a root is known beyond its first one
BITS = 160


# ---- residues -------------------------------------------------------------------
def _is_prime(n: int) -> bool:
    """Deterministic below 3.3e9 (bases 2, 3, 5, 7)."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7)):
        return False
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if n == a or x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(bound: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``bound``."""
    out, n = [], bound - 1
    while len(out) < count:
        if _is_prime(n):
            out.append(n)
        n -= 1
    return out


def primes_needed(dimension: int, trace: int) -> list[int]:
    """Primes below 2^31 whose product exceeds twice any coefficient.

    The k-th coefficient of a positive semidefinite matrix is at most
    C(d, k) (trace / d)^k (Maclaurin), which (1 + trace / d)^d bounds.
    """
    bits = dimension * (max(1, -(-trace // dimension)) + 1).bit_length() + 2
    return primes_below(1 << 31, bits // 30 + 1)


def charpoly_mod(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients (constant first) of det(x - A) modulo ``p`` < 2^31 by Hessenberg form."""
    a = np.array([[x % p for x in row] for row in matrix], np.int64)
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + int(below[0])
        if at != k + 1:
            a[[k + 1, at]] = a[[at, k + 1]]
            a[:, [k + 1, at]] = a[:, [at, k + 1]]
        factor = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factor[:, None] * a[k + 1] % p) % p
        # the inverse operation on columns keeps the matrix similar
        sums = np.zeros(d, np.int64)
        for j in np.flatnonzero(factor).tolist():
            sums = (sums + a[:, k + 2 + j] * factor[j]) % p
        a[:, k + 1] = (a[:, k + 1] + sums) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[m - 1, :-1]
        new = (new - a[m - 1, m - 1] * polys[m - 1]) % p
        product = 1
        for i in range(m - 1, 0, -1):
            product = product * int(a[i, i - 1]) % p
            if not product:
                break
            new = (new - int(a[i - 1, m - 1]) * product % p * polys[i - 1]) % p
        polys[m] = new
    return polys[d]


def from_residues(primes: list[int], residues: list[list[int]]) -> list[int]:
    """Signed integers whose residues are given (one list for each prime), by Chinese remaindering."""
    whole = 1
    for p in primes:
        whole *= p
    out = [0] * len(residues[0])
    for p, row in zip(primes, residues, strict=True):
        rest = whole // p
        weight = rest * pow(rest % p, -1, p)
        out = [(o + r * weight) % whole for o, r in zip(out, row, strict=True)]
    return [o - whole if o * 2 > whole else o for o in out]


# ---- real roots -----------------------------------------------------------------
def roots_above(poly: list[int], a: int, k: int) -> int:
    """Roots greater than a / 2^k of a polynomial with real roots only, each as often as it occurs."""
    d = len(poly) - 1
    c = [x << (k * (d - i)) for i, x in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(s != t for s, t in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], a: int, k: int) -> int:
    """2^(k d) times the polynomial at a / 2^k."""
    d = len(poly) - 1
    out = poly[d]
    for i in range(d - 1, -1, -1):
        out = out * a + (poly[i] << (k * (d - i)))
    return out


def isolate(poly: list[int], most: int) -> list[tuple[int, int, int, int]]:
    """Intervals ``(a, b, k, roots)``, (a, b] / 2^k, of the ``most`` largest positive roots, falling.

    An interval holds one root, or several that agree to ``BITS`` bits.
    """
    zeros = next(i for i, x in enumerate(poly) if x)
    poly = poly[zeros:]
    total = len(poly) - 1
    if not total:
        return []
    top = 1
    while roots_above(poly, top, 0):
        top *= 2
    out, found = [], 0
    todo = [(0, top, 0, total)]
    while todo and found < most:
        a, b, k, n = todo.pop()
        if n == 1 and a or (n and a and (b - a) << BITS <= a):
            out.append((a, b, k, n))
            found += n
            continue
        if (a + b) & 1:
            a, b, k = 2 * a, 2 * b, k + 1
        mid = (a + b) // 2
        above = roots_above(poly, mid, k) - roots_above(poly, b, k)
        if n - above:
            todo.append((a, mid, k, n - above))
        if above:
            todo.append((mid, b, k, above))
    return out


def refine(poly: list[int], a: int, b: int, k: int) -> tuple[int, int, int]:
    """A simple root of (a, b] / 2^k to ``BITS`` bits: interpolation with verified signs."""
    zeros = next(i for i, x in enumerate(poly) if x)
    poly = poly[zeros:]
    fa, fb = _value(poly, a, k), _value(poly, b, k)
    d = len(poly) - 1
    if not fb:
        return b, b, k
    if not fa:  # the root at the open end belongs to the interval below
        step = 1
        while True:
            k, a, b = k + step, (a << step) + 1, b << step
            fa, fb = _value(poly, a, k), fb << (d * step)
            if fa and (fa > 0) != (fb > 0):
                break
            a -= 1
    cuts = 2
    while (b - a) << BITS > a:
        shift = cuts
        k, a, b, fa, fb = k + shift, a << shift, b << shift, fa << (d * shift), fb << (d * shift)
        width = (b - a) >> shift  # 2^shift parts
        part = max(0, min((1 << shift) - 1, (abs(fa) << shift) // (abs(fa) + abs(fb))))
        lo = a + part * width
        hi = lo + width
        flo = fa if lo == a else _value(poly, lo, k)
        fhi = fb if hi == b else _value(poly, hi, k)
        if not flo:
            return lo, lo, k
        if not fhi:
            return hi, hi, k
        if (flo > 0) != (fhi > 0):
            a, b, fa, fb = lo, hi, flo, fhi
            cuts = min(2 * cuts, 64)
            continue
        if (fa > 0) != (flo > 0):
            b, fb = lo, flo
        else:
            a, fa = hi, fhi
        cuts = max(1, cuts // 2)
    return a, b, k


# ---- components -----------------------------------------------------------------
def _decimal(a: int, k: int) -> Decimal:
    return Decimal(a) / (Decimal(2) ** k)


def null_space(matrix: list[list[int]], root: Decimal, count: int, rounds: int = 3) -> np.ndarray:
    """``count`` orthonormal vectors of the null space of A - root, by inverse iteration.

    The elimination carries ``DIGITS`` digits, far more than the root's error leaves
    between a component and its nearest neighbour.
    """
    with localcontext() as ctx:
        ctx.prec = DIGITS
        d = len(matrix)
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= root
        scale = max(map(abs, a.ravel())) or Decimal(1)
        tiny = scale.scaleb(-DIGITS + 10)
        rows = list(range(d))
        for k in range(d):
            at = max(range(k, d), key=lambda r: abs(a[r, k]))
            if at != k:
                a[[k, at]] = a[[at, k]]
                rows[k], rows[at] = rows[at], rows[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                factor = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] -= factor[:, None] * a[k, k + 1 :][None, :]
                a[k + 1 :, k] = factor

        def solve(b):
            x = b[rows].copy()
            for k in range(d - 1):
                x[k + 1 :] -= a[k + 1 :, k] * x[k]
            for k in range(d - 1, -1, -1):
                x[k] = x[k] / a[k, k]
                if k:
                    x[:k] -= a[:k, k] * x[k]
            return x

        def cleaned(vectors):
            done = []
            for v in vectors:
                v = v / max(map(abs, v))
                for _ in range(2):
                    for u in done:
                        v = v - u * (u @ v)
                v = v / (v @ v).sqrt()
                done.append(v)
            return done

        vectors = [np.array([Decimal((7919 * (i + 1) * (c + 1) + 104729 * (i + c) ** 2) % 2003 - 1001) + Decimal("0.5") for i in range(d)], object) for c in range(count)]
        for _ in range(rounds):
            vectors = cleaned([solve(v) for v in vectors])
        return np.array([[float(x) for x in v] for v in vectors])
