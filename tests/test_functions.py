import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from gyre.functions import geo, sigma, variogram


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def lits(*values):
    return [F.lit(float(v)) for v in values]


def test_haversine(spark):
    assert int(one(spark, geo.haversine(*lits(0, 0, 10, 10)))) == 1568520
    assert one(spark, geo.haversine(*lits(0, -90, 0, 90), radius=1)) == pytest.approx(math.pi)
    assert one(spark, geo.haversine(*lits(0, 0, 180, 0), radius=2)) == pytest.approx(2 * math.pi)


@pytest.mark.parametrize("to,angle", [((0, 1), 90), ((1, 0), 0), ((0, -1), -90), ((-1, 0), 180)])
def test_bearing(spark, to, angle):
    assert one(spark, geo.bearing(*lits(0, 0, *to))) == pytest.approx(angle)


def test_units(spark):
    there = one(spark, geo.m2deg(geo.deg2m(F.lit(3.0), F.lit(40.0)), F.lit(40.0)))
    assert there == pytest.approx(3.0)


LEVELS = [-1.0, -0.5, 0.0]


@pytest.mark.parametrize(
    "make,expected",
    [
        (lambda s, c: sigma.ocean_sigma(s, 0.5, 100.0), [-100, -49.75, 0.5]),
        (lambda s, c: sigma.atmosphere_sigma(s + 1, 101325.0, 10000.0), [10000, 55662.5, 101325]),
        (lambda s, c: sigma.ocean_s(s, 0.5, 100.0, 10.0, (s + 1)), [-10, 40.25, 90.5]),
        (lambda s, c: sigma.ocean_s_g1(s, 1.0, 100.0, 10.0, s), [-100, -49.5, 1]),
        (lambda s, c: sigma.ocean_s_g2(s, 0.5, 100.0, 10.0, s), [-100, -49.75, 0.5]),
        (lambda s, c: sigma.stretching(s, 7.0, 2.0), [-1, -0.96983013, 0]),
    ],
)
def test_levels(spark, make, expected):
    got = [one(spark, make(F.lit(s), None)) for s in LEVELS]
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("kind", variogram.MODELS)
def test_models_agree_and_fit(spark, kind):
    h = np.array([0.5, 1.0, 3.0, 7.0, 12.0])
    want = variogram.model_array(kind, h, 0.1, 2.0, 5.0)
    assert [one(spark, variogram.model(kind, F.lit(float(x)), 0.1, 2.0, 5.0)) for x in h] == pytest.approx(want.tolist())
    found = variogram.fit(kind, h, want)
    assert variogram.model_array(kind, h, *[found[k] for k in "nsr"]) == pytest.approx(want, abs=0.05)
