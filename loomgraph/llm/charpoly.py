"""Eigenvalues and eigenvectors of a symmetric integer matrix, from its exact characteristic polynomial.

The polynomial is found modulo many primes, each on its own, and put together by Chinese
remaindering. All of its roots are real, so the number of roots above a point is the number of sign
changes among the coefficients of the polynomial moved to that point: roots are isolated and
narrowed down by exact integer arithmetic, repeated roots included. Vectors come from inverse
iteration in decimal arithmetic of many digits.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

import numpy as np

#: Primes lie below this, so that products of residues fit in 64 bits.
PRIME_LIMIT = 1 << 31
#: Bits to which a root is narrowed down, relative to itself.
ROOT_BITS = 160
DIGITS = 120


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all n below 3.3 * 10 ** 9."""
    if n < 2 or any(n % p == 0 and n != p for p in (2, 3, 5, 7)):
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n == 0 or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes whose product has more than `bits` bits, the largest below the limit first."""
    found, size, n = [], 0.0, PRIME_LIMIT
    while size <= bits:
        n -= 1
        if is_prime(n):
            found.append(n)
            size += np.log2(n)
    return found


def coefficient_bits(matrix: list[list[int]]) -> int:
    """Bits that hold every coefficient and its sign.

    The k-th one is a sum of minors of size k, each at most the product of its rows' lengths.
    """
    bits = 2
    for row in matrix:
        bits += 1 + max((sum(x * x for x in row).bit_length() + 1) // 2, 0)
    return bits


def charpoly_mod(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo the prime p, the constant one first."""
    d = len(matrix)
    h = np.array([[x % p for x in row] for row in matrix], np.int64).reshape(d, d)
    # Similar matrices have one polynomial: below the subdiagonal everything is made zero.
    for m in range(1, d - 1):
        nonzero = np.flatnonzero(h[m:, m - 1])
        if not len(nonzero):
            continue
        pivot = m + nonzero[0]
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        now = np.roll(polys[k - 1], 1)
        now = (now - polys[k - 1] * h[k - 1, k - 1] % p) % p
        if k > 1:
            factors, product = np.zeros(k - 1, np.int64), 1
            for i in range(k - 2, -1, -1):
                product = product * int(h[i + 1, i]) % p
                factors[i] = int(h[i, k - 1]) * product % p
            now = (now - (factors[:, None] * polys[: k - 1] % p).sum(axis=0)) % p
        polys[k] = now
    return polys[d]


def combined(primes: list[int], residues: list[np.ndarray]) -> list[int]:
    """The integers, between minus and plus half the product, with the given residues."""
    product = 1
    for p in primes:
        product *= p
    parts = [product // p for p in primes]
    weights = [part * pow(part, -1, p) for part, p in zip(parts, primes, strict=True)]
    out = []
    for column in zip(*(r.tolist() for r in residues), strict=True):
        value = sum(w * r for w, r in zip(weights, column, strict=True)) % product
        out.append(value - product if value > product // 2 else value)
    return out


def moved(poly: list[int], by: int) -> list[int]:
    """The coefficients of poly(x + by)."""
    out = list(poly)
    for i in range(len(out) - 1):
        for k in range(len(out) - 2, i - 1, -1):
            out[k] += by * out[k + 1]
    return out


def roots_above(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are greater, each as often as it occurs."""
    signs = [c > 0 for c in moved(poly, at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2 ** bits times as large."""
    top = len(poly) - 1
    return [c << (bits * (top - k)) for k, c in enumerate(poly)]


def _value(poly: list[int], at: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * at + c
    return total


def largest_roots(poly: list[int], count: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """The `count` largest roots that are positive, falling, each as (numerator, binary exponent).

    A root is below the numerator times 2 ** exponent by less than 2 ** -bits of itself. Repeated
    roots come as often as they occur.
    """
    least = next((k for k, c in enumerate(poly) if c), len(poly) - 1)
    poly = poly[least:]
    positive = roots_above(poly, 0)
    high = 1
    while roots_above(poly, high):
        high *= 2
    found: list[tuple[int, int]] = []
    # Open ranges (low, high] in units of 2 ** -scale with the roots they hold, the highest on top.
    stack = [(0, high, 0, positive, 0)]
    while stack and len(found) < count:
        low, high, scale, above_low, above_high = stack.pop()
        n = above_low - above_high
        if n == 0:
            continue
        if n == 1:
            found.append(_narrowed(poly, low, high, scale, bits))
            continue
        if low > 0 and (high - low) << bits <= low:
            found.extend([(high, -scale)] * n)
            continue
        if high - low == 1:
            low, high, scale = 2 * low, 2 * high, scale + 1
        middle = (low + high) // 2
        above = roots_above(_scaled(poly, scale), middle)
        stack.append((low, middle, scale, above_low, above))
        stack.append((middle, high, scale, above, above_high))
    return found[:count]


def _narrowed(poly: list[int], low: int, high: int, scale: int, bits: int) -> tuple[int, int]:
    """The one root in (low, high] * 2 ** -scale, by halving on the polynomial's sign.

    It may be repeated no more than once, so the sign changes there.
    """
    now = _scaled(poly, scale)
    above = _value(now, high)
    if above == 0:
        return high, -scale
    while low == 0 or (high - low) << bits > low:
        if high - low == 1:
            # Many bits at a time: every change of scale builds the polynomial anew.
            low, high, scale = low << 32, high << 32, scale + 32
            now = _scaled(poly, scale)
        middle = (low + high) // 2
        value = _value(now, middle)
        if value == 0:
            return middle, -scale
        if (value > 0) == (above > 0):
            high = middle
        else:
            low = middle
    return high, -scale


def decimal_root(root: tuple[int, int]) -> Decimal:
    numerator, exponent = root
    with localcontext() as context:
        context.prec = DIGITS
        return Decimal(numerator) / (1 << -exponent) if exponent < 0 else Decimal(numerator << exponent)


def _factored(rows: list[list[Decimal]], tiny: Decimal) -> list[int]:
    """LU with row exchanges, in place; the order of the rows. A pivot of zero becomes `tiny`."""
    d, order = len(rows), list(range(len(rows)))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best] = rows[best], rows[k]
        order[k], order[best] = order[best], order[k]
        if abs(rows[k][k]) < tiny:
            rows[k][k] = tiny
        top = rows[k]
        for i in range(k + 1, d):
            factor = rows[i][k] / top[k]
            if factor:
                own = rows[i]
                own[k] = factor
                for j in range(k + 1, d):
                    own[j] -= factor * top[j]
    return order


def _solved(rows: list[list[Decimal]], order: list[int], right: list[Decimal]) -> list[Decimal]:
    d = len(rows)
    x = [right[i] for i in order]
    for i in range(d):
        x[i] -= sum((rows[i][j] * x[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        x[i] = (x[i] - sum((rows[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / rows[i][i]
    return x


def null_vectors(matrix: list[list[int]], root: tuple[int, int], count: int, steps: int = 3) -> np.ndarray:
    """`count` unit vectors, as rows, of the eigenvalue next to `root`, orthogonal to each other.

    Inverse iteration at the root. Of a repeated root they are some base of its null space. The
    sign is that which makes the entry of largest size positive.
    """
    d = len(matrix)
    found: list[list[Decimal]] = []
    with localcontext() as context:
        context.prec = DIGITS
        context.Emin, context.Emax = -999_999, 999_999
        shift = decimal_root(root)
        rows = [[Decimal(v) - (shift if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        order = _factored(rows, shift * Decimal(10) ** (8 - DIGITS))
        for number in range(count):
            # Some start that is no more likely to miss one direction than another.
            x = [Decimal(1 + (i * i * 31 + i * (7 + 2 * number)) % 17) for i in range(d)]
            for _ in range(steps):
                x = _orthogonal(x, found)
                x = _orthogonal(_solved(rows, order, x), found)
            lead = max(x, key=abs)
            found.append([v if lead > 0 else -v for v in x])
    return np.array([[float(v) for v in x] for x in found]).reshape(len(found), d)


def _orthogonal(x: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
    """x less its parts along the others, of length 1."""
    scale = max(map(abs, x))
    x = [v / scale for v in x]
    for _ in range(2):
        for other in others:
            along = sum((a * b for a, b in zip(x, other, strict=True)), Decimal(0))
            x = [a - along * b for a, b in zip(x, other, strict=True)]
    length = sum((v * v for v in x), Decimal(0)).sqrt()
    return [v / length for v in x]
