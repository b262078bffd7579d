"""Student t tail and critical value as native expressions, one formula for all degrees of freedom.

With w = t^2 / nu, x = 1 / (1 + w) and a = nu / 2 the two-sided tail is the incomplete beta
function I_x(a, 1/2):

* x below (a + 1) / (a + 5/2): its continued fraction, so that very small tails keep
  their relative accuracy;
* else 1 - I_(1-x)(1/2, a), a series of positive terms that falls faster than 2^-n.

Which one runs depends on x only through the point where the fraction starts to
converge fast; both hold for every nu. log B(a, 1/2) comes from the asymptotic series of a
ratio of gamma functions at a + 16 and sixteen exact steps back.
"""

from __future__ import annotations

_PI = "3.141592653589793D"
_FRACTION_STEPS = 200
_SERIES_TERMS = 100
_SHIFT = 16


def two_sided_p(t: str, nu: str) -> str:
    """SQL text of P(|T| > |t|) for the SQL texts of t and nu."""
    t, nu = f"CAST({t} AS DOUBLE)", f"CAST({nu} AS DOUBLE)"
    # the fold names w once
    tail = f"aggregate(array({t} * {t} / {nu}), 0D, (none, w) -> {_tail('w', nu)})"
    return (
        f"CASE WHEN {t} IS NULL OR {nu} < 1 THEN NULL WHEN {t} = 0 THEN 1D "
        f"WHEN isnan({t}) THEN {t} WHEN abs({t}) = double('infinity') THEN 0D ELSE greatest(0D, least(1D, {tail})) END"
    )


def critical_t(nu: str, confidence: float = 0.95) -> str:
    """SQL text of the t whose two-sided tail is 1 - confidence, by bisection.

    The value for one degree of freedom, tan(pi * confidence / 2), is above all others.
    """
    tail = two_sided_p("(s[0] + s[1]) / 2", nu)
    step = f"IF({tail} > {1 - confidence!r}D, array((s[0] + s[1]) / 2, s[1]), array(s[0], (s[0] + s[1]) / 2))"
    top = f"2 * tan({_PI} * {confidence!r}D / 2)"
    search = f"aggregate(sequence(1, 80), array(0D, {top}), (s, b) -> {step}, s -> (s[0] + s[1]) / 2)"
    return f"CASE WHEN {nu} >= 1 THEN {search} END"


def _tail(w: str, nu: str) -> str:
    a = f"({nu} / 2)"
    x, y = f"(1 / (1 + {w}))", f"({w} / (1 + {w}))"
    front = f"exp(0.5D * ln({y}) - {a} * log1p({w}) - {_log_beta(a)})"
    even = f"(k div 2) * (0.5D - k div 2) * {x} / (({a} + k - 1) * ({a} + k))"
    odd = f"-({a} + k div 2) * ({a} + k div 2 + 0.5D) * {x} / (({a} + k - 1) * ({a} + k))"
    fraction = f"aggregate(sequence({_FRACTION_STEPS}, 1, -1), 1D, (f, k) -> 1 + IF(k % 2 = 0, {even}, {odd}) / f)"
    series = (
        f"aggregate(sequence(0, {_SERIES_TERMS - 1}), array(1D, 0D), "
        f"(z, n) -> array(z[0] * {y} * ({a} + 0.5D + n) / (1.5D + n), z[1] + z[0]), z -> z[1])"
    )
    return f"IF({x} < ({a} + 1) / ({a} + 2.5D), {front} / {a} / {fraction}, 1 - 2 * {front} * {series})"


def _log_beta(a: str) -> str:
    z = f"({a} + {_SHIFT})"
    # fixed values: coefficients of the series of ln(gamma(z + 1/2) / gamma(z)) - ln(z) / 2 in odd powers of 1 / z
    series = f"(-1 / 8D + (1 / 192D + (-1 / 640D + (17 / 14336D - 31 / 18432D / ({z} * {z})) / ({z} * {z})) / ({z} * {z})) / ({z} * {z})) / {z}"
    back = f"aggregate(sequence(0, {_SHIFT - 1}), 0D, (l, j) -> l + log1p(0.5D / ({a} + j)))"
    return f"(0.5D * ln({_PI}) - 0.5D * ln({z}) - {series} + {back})"
