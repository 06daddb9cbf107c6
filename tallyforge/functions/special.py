"""Special functions on numpy arrays (or scalars): log-gamma, digamma, incomplete gamma and beta, error function, and inverses."""

from __future__ import annotations

import math

import numpy as np

TINY = 1e-300
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_PSI = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760, -1 / 12)


def _array(f):
    """Arrays in, arrays out; a scalar gives a float."""

    def call(*args):
        found = np.broadcast_arrays(*(np.asarray(a, float) for a in args))
        with np.errstate(all="ignore"):
            out = f(*(np.atleast_1d(a) for a in found))
        return float(out.ravel()[0]) if found[0].ndim == 0 else out

    call.__name__, call.__doc__ = f.__name__, f.__doc__
    return call


@_array
def lgamma(x):
    """Logarithm of |gamma(x)|: reflection below a half, then a shift upwards and Stirling's series."""
    low = x < 0.5
    z = np.where(low, 1 - x, x)
    shift, small = np.ones_like(z), z.copy()
    for _ in range(9):
        step = small < 9
        shift = np.where(step, shift * small, shift)
        small = np.where(step, small + 1, small)
    inv = 1 / small
    tail = sum(c * inv ** (2 * i + 1) for i, c in enumerate(_STIRLING))
    out = (small - 0.5) * np.log(small) - small + 0.5 * math.log(2 * math.pi) + tail - np.log(shift)
    out = np.where(low, math.log(math.pi) - np.log(np.abs(np.sin(np.pi * x))) - out, out)
    return np.where((x <= 0) & (x == np.floor(x)) | np.isposinf(x), np.inf, out)


@_array
def gamma(x):
    sign = np.where((x < 0) & (np.floor(x) % 2 != 0), -1.0, 1.0)
    return np.where((x <= 0) & (x == np.floor(x)), np.nan, sign * np.exp(lgamma(x)))


@_array
def lbeta(a, b):
    return lgamma(a) + lgamma(b) - lgamma(a + b)


@_array
def digamma(x):
    """Derivative of lgamma."""
    low = x < 0.5
    z = np.where(low, 1 - x, x)
    total = np.zeros_like(z)
    for _ in range(9):
        step = z < 9
        total = np.where(step, total - 1 / z, total)
        z = np.where(step, z + 1, z)
    inv2 = 1 / (z * z)
    out = total + np.log(z) - 0.5 / z + sum(c * inv2 ** (i + 1) for i, c in enumerate(_PSI))
    out = np.where(low, out - np.pi / np.tan(np.pi * x), out)
    return np.where((x <= 0) & (x == np.floor(x)), np.nan, out)


@_array
def gammainc(a, x):
    """Regularised lower incomplete gamma function."""
    return _incomplete(a, x)[0]


@_array
def gammaincc(a, x):
    """Regularised upper incomplete gamma function."""
    return _incomplete(a, x)[1]


def _incomplete(a, x):
    a, x = np.atleast_1d(a), np.atleast_1d(x)
    scale = np.exp(a * np.log(np.where(x > 0, x, 1)) - x - lgamma(a))
    low = x < a + 1
    # Series where x is small.
    xs, term = np.where(low, x, 0), 1 / a
    total, n = term.copy(), a.copy()
    for _ in range(20_000):
        n = n + 1
        term = term * xs / n
        total = total + term
        if np.all(np.abs(term) <= np.abs(total) * 1e-17):
            break
    p_low = scale * total
    # Lentz's continued fraction elsewhere.
    xc = np.where(low, a + 2, x)
    b = xc + 1 - a
    c, d = np.full_like(b, 1 / TINY), 1 / b
    h = d.copy()
    for i in range(1, 20_000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < TINY, TINY, c)
        h = h * c * d
        if np.all(np.abs(c * d - 1) < 5e-16):
            break
    q_high = scale * h
    bad = ~((a > 0) & (x >= 0))
    p = np.where(x == 0, 0.0, np.where(low, p_low, 1 - q_high))
    q = np.where(x == 0, 1.0, np.where(low, 1 - p_low, q_high))
    p, q = np.where(np.isposinf(x), 1.0, p), np.where(np.isposinf(x), 0.0, q)
    return np.where(bad, np.nan, p), np.where(bad, np.nan, q)


@_array
def betainc(a, b, x):
    """Regularised incomplete beta function."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (z > 0) & (z < 1)
    z = np.where(inside, z, 0.5)
    front = np.exp(p * np.log(z) + q * np.log1p(-z) - lbeta(p, q)) / p
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d.copy()
    for m in range(1, 20_000):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 5e-16):
            break
    out = np.where(flip, 1 - front * h, front * h)
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
    return np.where((a > 0) & (b > 0) & ~np.isnan(x), out, np.nan)


@_array
def erf(x):
    return np.frompyfunc(math.erf, 1, 1)(x).astype(float)


@_array
def erfc(x):
    return np.frompyfunc(math.erfc, 1, 1)(x).astype(float)


def invert(f, target, low, high, rising: bool = True):
    """Points of [low, high] where the monotone f reaches target, by bisection of all at once down to neighbouring doubles."""
    low, high = np.broadcast_arrays(np.asarray(low, float), np.asarray(high, float), np.asarray(target, float))[:2]
    low, high = low.copy(), high.copy()
    for _ in range(2200):
        middle = np.where((low < 0) == (high < 0), 0.5 * low + 0.5 * high, 0.5 * (low + high))
        if np.all((middle <= low) | (middle >= high)):
            break
        below = (f(middle) < target) == rising
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return 0.5 * low + 0.5 * high


def bracket(f, target, start, rising: bool = True):
    """An upper end at which the monotone f has passed target: start, doubled as often as it takes."""
    high = np.broadcast_arrays(np.asarray(start, float), np.asarray(target, float))[0].copy()
    for _ in range(1100):
        short = (f(high) < target) == rising
        short &= np.isfinite(high)
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    return np.where(np.isfinite(high), high, np.finfo(float).max)


@_array
def erfinv(y):
    """Inverse of erf; small tails come from erfc, so that they keep their digits."""
    a = np.abs(y)
    tail = 1 - a
    x = np.where(a < 0.5, invert(erf, np.minimum(a, 0.5), 0.0, 1.0), invert(erfc, np.maximum(tail, TINY), 0.0, 27.0, rising=False))
    return np.where(a > 1, np.nan, np.where(a == 1, np.inf, x) * np.sign(y))


@_array
def gammaincinv(a, p):
    """x where gammainc(a, x) is p."""
    x = np.empty_like(a)
    for i, (k, q) in enumerate(zip(a.ravel(), p.ravel())):
        x.ravel()[i] = _gamma_point(k, q, 1 - q)
    return x


def _gamma_point(a: float, p: float, q: float) -> float:
    """x with lower tail p, or upper tail q where that is smaller."""
    if math.isnan(a) or math.isnan(p) or a <= 0 or not 0 <= p <= 1:
        return math.nan
    if p == 0 or q == 0:
        return 0.0 if p == 0 else math.inf
    f, target, rising = ((lambda x: gammainc(a, x)), p, True) if p <= q else ((lambda x: gammaincc(a, x)), q, False)
    return float(invert(f, target, 0.0, bracket(f, target, a + 1, rising), rising))


@_array
def betaincinv(a, b, p):
    """x where betainc(a, b, x) is p."""
    return np.where((p >= 0) & (p <= 1), np.where(p == 0, 0.0, np.where(p == 1, 1.0, invert(lambda x: betainc(a, b, x), p, 0.0, 1.0))), np.nan)
