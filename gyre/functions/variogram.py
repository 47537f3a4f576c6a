"""Variogram models, as columns and as functions of arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gyre.functions.geo import _col

MODELS = ("linear", "exponential", "gaussian", "spherical")
#: The nugget's largest share of the sill.
MAX_NUGGET = 0.2


def bounded(nugget: float, sill: float, span: float) -> tuple[float, float, float]:
    sill = max(sill, 0.0)
    return min(max(nugget, 0.0), MAX_NUGGET * sill), sill, max(span, 0.0)


def model(kind: str, h, nugget: float, sill: float, span: float) -> Column:
    """The model's value at distance h."""
    n, s, r = bounded(nugget, sill, span)
    x = _col(h) / r
    shape = {
        "linear": lambda: F.least(x, F.lit(1.0)),
        "exponential": lambda: 1 - F.exp(-3 * x),
        "gaussian": lambda: 1 - F.exp(-3 * x * x),
        "spherical": lambda: F.when(x <= 1, 1.5 * x - 0.5 * x * x * x).otherwise(F.lit(1.0)),
    }[kind]()
    return n + (s - n) * shape


def model_array(kind, h: np.ndarray, nugget: float, sill: float, span: float) -> np.ndarray:
    """The values of a model, by name or a function of distances and bounded parameters, at distances h."""
    n, s, r = bounded(nugget, sill, span)
    if callable(kind):
        return kind(h, n, s, r)
    x = h / r
    shape = {
        "linear": lambda: np.minimum(x, 1),
        "exponential": lambda: 1 - np.exp(-3 * x),
        "gaussian": lambda: 1 - np.exp(-3 * x**2),
        "spherical": lambda: np.where(x <= 1, 1.5 * x - 0.5 * x**3, 1.0),
    }[kind]()
    return n + (s - n) * shape


def fit(kind, dist: np.ndarray, gamma: np.ndarray, frozen: dict[str, float] | None = None) -> dict[str, float]:
    """Nugget ``n``, sill ``s`` and range ``r`` of least squares on bin means, by a shrinking grid search."""
    frozen = frozen or {}
    ok = np.isfinite(dist) & np.isfinite(gamma)
    dist, gamma = dist[ok], gamma[ok]
    lo = {"n": 0.0, "s": 1e-12, "r": max(dist.max() * 1e-3, 1e-12)}
    hi = {"n": gamma.max() * MAX_NUGGET, "s": 2 * gamma.max() + 1e-12, "r": 3 * dist.max()}
    best = {k: frozen.get(k, 0.5 * (lo[k] + hi[k])) for k in lo}
    width = {k: 0.0 if k in frozen else hi[k] - lo[k] for k in lo}
    for _ in range(30):
        axes = {k: [best[k]] if not width[k] else np.clip(best[k] + width[k] * np.linspace(-0.5, 0.5, 9), lo[k], hi[k]) for k in lo}
        cost = lambda p: float(((model_array(kind, dist, *p) - gamma) ** 2).sum())
        best = dict(zip("nsr", min(((n, s, r) for n in axes["n"] for s in axes["s"] for r in axes["r"]), key=cost)))
        width = {k: w * 0.6 for k, w in width.items()}
    return best
