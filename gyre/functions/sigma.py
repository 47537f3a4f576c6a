"""Heights and pressures of terrain-following levels, as columns.

``eta`` is the sea level, ``h`` the depth of the sea floor, ``sig`` the level (-1 at the floor, 0 at the surface).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gyre.functions.geo import _col


def atmosphere_sigma(sig, ps, ptop) -> Column:
    """Pressure from the surface pressure and that of the top."""
    return _col(ptop) + _col(sig) * (_col(ps) - _col(ptop))


def ocean_sigma(sig, eta, h) -> Column:
    return _col(eta) + _col(sig) * (_col(eta) + _col(h))


def stretching(sig, thetas, thetab) -> Column:
    """The stretching function of the s-coordinates, by its surface and bottom control."""
    sig, a, b = _col(sig), _col(thetas), _col(thetab)
    return (1 - b) * F.sinh(a * sig) / F.sinh(a) + b * (F.tanh(a * (sig + 0.5)) / (2 * F.tanh(0.5 * a)) - 0.5)


def ocean_s(s, eta, h, hc, c) -> Column:
    s, eta, h, hc, c = map(_col, (s, eta, h, hc, c))
    return eta * (1 + s) + hc * s + (h - hc) * c


def ocean_s_g1(s, eta, h, hc, c) -> Column:
    s, eta, h, hc, c = map(_col, (s, eta, h, hc, c))
    still = hc * s + (h - hc) * c
    return still + eta * (1 + still / h)


def ocean_s_g2(s, eta, h, hc, c) -> Column:
    s, eta, h, hc, c = map(_col, (s, eta, h, hc, c))
    share = (hc * s + h * c) / (h + hc)
    return share * (h + eta) + eta
