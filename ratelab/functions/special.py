"""Log-gamma and its first two derivatives as column expressions.

Each takes SQL text for a positive double, shifts it up by eight and uses the
asymptotic series there (Abramowitz and Stegun 6.1.41, 6.3.18, 6.4.12). They
stay inside generated code, so a likelihood over counts needs no Python on the
row path. Text keeps building them cheap: each is one parse.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SHIFT = 8
HALF_LOG_TWO_PI = 0.9189385332046727


def _shifted(x: str) -> list[str]:
    return [f"(({x}) + {k}D)" for k in range(SHIFT)]


def log_gamma(x: str) -> Column:
    z = f"(({x}) + {SHIFT}D)"
    r, r2 = f"(1D / {z})", f"(1D / ({z} * {z}))"
    series = f"{r} * (1D/12 - {r2} * (1D/360 - {r2} * (1D/1260 - {r2} * (1D/1680 - {r2} / 1188D))))"
    product = " * ".join(_shifted(x))
    return F.expr(f"({z} - 0.5D) * ln({z}) - {z} + {HALF_LOG_TWO_PI}D + {series} - ln({product})")


def digamma(x: str) -> Column:
    z = f"(({x}) + {SHIFT}D)"
    r2 = f"(1D / ({z} * {z}))"
    series = f"{r2} * (1D/12 - {r2} * (1D/120 - {r2} * (1D/252 - {r2} * (1D/240 - {r2} / 132D))))"
    steps = " + ".join(f"1D / {s}" for s in _shifted(x))
    return F.expr(f"ln({z}) - 0.5D / {z} - {series} - ({steps})")


def trigamma(x: str) -> Column:
    z = f"(({x}) + {SHIFT}D)"
    r, r2 = f"(1D / {z})", f"(1D / ({z} * {z}))"
    series = f"{r} * {r2} * (1D/6 - {r2} * (1D/30 - {r2} * (1D/42 - {r2} * (1D/30 - {r2} * 5D/66))))"
    steps = " + ".join(f"1D / ({s} * {s})" for s in _shifted(x))
    return F.expr(f"{r} + 0.5D * {r2} + {series} + {steps}")
