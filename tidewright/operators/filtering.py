"""State-space filters as folds over packed series, in Catalyst.

A fold carries the state and its sufficient statistics through ``aggregate`` over the sorted samples of a series; the
results are single expressions, so a grid of candidates is a join and needs no Python.  ``let`` binds a value once, so the
expression does not grow with each use.

The parameters are SQL expressions: column names or numbers.  ``sigma``/``rho`` are those of a Matérn-1/2 or -3/2 process,
``tau`` the standard deviation of white noise (0: none).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_2PI = 1.8378770664093453  # ln 2 pi


def let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def white_loglik(samples: str, tau: str) -> Column:
    """(n, loglik) of independent noise with standard deviation ``tau``."""
    quad = f"aggregate({samples}, 0D, (a, e) -> a + e.v * e.v)"
    return F.expr(f"named_struct('n', cast(size({samples}) as bigint), 'loglik', -0.5D * (size({samples}) * ({LOG_2PI}D + 2 * ln({tau})) + {quad} / ({tau} * {tau})))")


def ou_loglik(samples: str, sigma: str, rho: str, tau: str = "0D") -> Column:
    """(n, loglik, ok) of a Matérn-1/2 process plus white noise; a sample with a NULL value is predicted but not used."""
    start = f"named_struct('x', 0D, 'p', {sigma} * {sigma}, 't', cast(NULL as double), 'q', 0D, 'l', 0D, 'n', 0L)"
    update = let(
        "w", "named_struct('s', b.p + r.r2, 'd', e.v - b.x)",
        "if(e.v is null, named_struct('x', b.x, 'p', b.p, 't', e.t, 'q', a.q, 'l', a.l, 'n', a.n), named_struct('x', b.x + b.p / w.s * w.d, 'p', b.p - b.p / w.s * b.p, 't', e.t, 'q', a.q + w.d * w.d / w.s, 'l', a.l + ln(w.s), 'n', a.n + 1L))",
    )
    predict = let("f", f"if(a.t is null, 1D, exp((a.t - e.t) / {rho}))", let("b", f"named_struct('x', f * a.x, 'p', if(a.t is null, a.p, f * f * a.p - {sigma} * {sigma} * expm1(2 * (a.t - e.t) / {rho})))", update))
    done = f"named_struct('n', a.n, 'loglik', -0.5D * (a.n * {LOG_2PI}D + a.l + a.q), 'ok', a.n > 0 and not isnan(a.l + a.q) and abs(a.l + a.q) < double('infinity'))"
    fold = f"aggregate({samples}, {start}, (a, e) -> {predict}, a -> {done})"
    return F.expr(let("r", f"named_struct('r2', {tau} * {tau})", fold))


def matern32_loglik(samples: str, sigma: str, rho: str, tau: str) -> Column:
    """(n, loglik) of a Matérn-3/2 process plus white noise; the noise terms use a series where the closed form cancels."""
    from tidewright.functions.families import _G1, _G2

    horner = lambda c: "aggregate(array(" + ", ".join(f"{float(x)!r}D" for x in c[::-1]) + "), 0D, (h, k) -> h * u + k)"
    g1 = f"if(u < 1, {horner(_G1)}, 1 - exp(-u) * (1 + u + u * u / 2))"
    g2 = f"if(u < 1, {horner(_G2)}, 1 - exp(-u) * (1 - u + u * u / 2))"
    start = f"named_struct('x', 0D, 'y', 0D, 'p', {sigma} * {sigma}, 'c', 0D, 'r', {sigma} * {sigma} * m.l * m.l, 't', cast(NULL as double), 'q', 0D, 'l', 0D, 'n', 0L)"
    predicted = (
        "named_struct('x', f.a * a.x + f.b * a.y, 'y', f.c * a.x + f.d * a.y,"
        f" 'p', f.a * f.a * a.p + 2 * f.a * f.b * a.c + f.b * f.b * a.r + {sigma} * {sigma} * g.g1,"
        f" 'c', f.a * f.c * a.p + (f.a * f.d + f.b * f.c) * a.c + f.b * f.d * a.r + {sigma} * {sigma} * 2 * power(m.l, 3) * d * d * exp(-u),"
        f" 'r', f.c * f.c * a.p + 2 * f.c * f.d * a.c + f.d * f.d * a.r + {sigma} * {sigma} * m.l * m.l * g.g2)"
    )
    update = let("w", "named_struct('s', b.p + m.r2, 'd', e.v - b.x)", "named_struct('x', b.x + b.p / w.s * w.d, 'y', b.y + b.c / w.s * w.d, 'p', b.p - b.p / w.s * b.p, 'c', b.c - b.p / w.s * b.c, 'r', b.r - b.c / w.s * b.c, 't', e.t, 'q', a.q + w.d * w.d / w.s, 'l', a.l + ln(w.s), 'n', a.n + 1L)")
    moved = let("f", "named_struct('a', exp(-m.l * d) * (1 + m.l * d), 'b', exp(-m.l * d) * d, 'c', -exp(-m.l * d) * m.l * m.l * d, 'd', exp(-m.l * d) * (1 - m.l * d))", let("g", f"named_struct('g1', {g1}, 'g2', {g2})", predicted))
    stay = "named_struct('x', a.x, 'y', a.y, 'p', a.p, 'c', a.c, 'r', a.r)"
    merge = let("d", "coalesce(e.t - a.t, 0D)", let("u", "2 * m.l * d", let("b", f"if(a.t is null, {stay}, {moved})", update)))
    fold = f"aggregate({samples}, {start}, (a, e) -> {merge}, a -> named_struct('n', a.n, 'loglik', -0.5D * (a.n * {LOG_2PI}D + a.l + a.q)))"
    return F.expr(let("m", f"named_struct('l', sqrt(3D) / {rho}, 'r2', {tau} * {tau})", fold))


def augmented(samples: str, columns: list[str], sigma: str, rho: str, tau: str) -> Column:
    """(n, logdet, a): whitened products of ``[v, columns]`` under a Matérn-1/2 process plus white noise.

    ``columns`` are SQL over a sample ``e``.  All columns share one filter, so ``a`` (row by row) holds the products that a
    generalised least squares solution needs: a[0] = y'S⁻¹y, then y'S⁻¹X and X'S⁻¹X.
    """
    k = len(columns) + 1
    zero = "array_repeat(0D, {})"
    start = f"named_struct('x', {zero.format(k)}, 'p', {sigma} * {sigma}, 't', cast(NULL as double), 'a', {zero.format(k * k)}, 'l', 0D, 'n', 0L)"
    update = let(
        "w", f"named_struct('s', p + r2, 'd', zip_with(array(e.v, {', '.join(columns)}), a.x, (z, x) -> z - f * x))",
        f"named_struct('x', zip_with(a.x, w.d, (x, d) -> f * x + p / w.s * d), 'p', p - p / w.s * p, 't', e.t, 'a', transform(a.a, (c, i) -> c + get(w.d, i div {k}) * get(w.d, i % {k}) / w.s), 'l', a.l + ln(w.s), 'n', a.n + 1L)",
    )
    merge = let("f", f"if(a.t is null, 1D, exp((a.t - e.t) / {rho}))", let("p", f"if(a.t is null, a.p, f * f * a.p - {sigma} * {sigma} * expm1(2 * (a.t - e.t) / {rho}))", update))
    return F.expr(let("r2", f"{tau} * {tau}", f"aggregate({samples}, {start}, (a, e) -> {merge}, a -> named_struct('n', a.n, 'logdet', a.l, 'a', a.a))"))
