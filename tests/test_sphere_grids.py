"""Grids to points across the date line, around poles, on rings and on long axes."""

import numpy as np
import pytest

from gyre.operators.interp import curvilinear2loc, grid2loc


def curvilinear(spark, lon, lat, v):
    rows = [(j, i, float(lon[j][i]), float(lat[j][i]), float(v[j][i])) for j in range(len(lon)) for i in range(len(lon[0]))]
    return spark.createDataFrame(rows, "j int, i int, lon double, lat double, v double")


def at(spark, *places):
    return spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in enumerate(places)], "id int, lon double, lat double")


def test_cells_across_the_date_line(spark):
    east = np.array([170, 175, -180, -175, -170])
    lon, lat = np.tile(east, (4, 1)), np.tile(np.arange(4)[:, None] * 5, (1, 5))
    grid = curvilinear(spark, lon, lat, np.tile(np.arange(5), (4, 1)))
    out = {r.id: (r.p, r.q, r.v) for r in curvilinear2loc(grid, at(spark, (-178, 7), (0, 7), (182, 7), (172.5, 0), (-170, 15), (-169, 5))).collect()}
    assert out[0] == pytest.approx((2.4, 1.4, 2.4)) and out[2] == pytest.approx((2.4, 1.4, 2.4))
    assert out[1] == out[5] == (-1, -1, None) and out[3] == pytest.approx((0.5, 0, 0.5)) and out[4][2] == pytest.approx(4)


@pytest.mark.parametrize("shift", [137, 179.99])
def test_a_turned_grid_gives_what_it_gives_elsewhere(spark, shift):
    rnd = np.random.default_rng(3)
    j, i = np.mgrid[:12, :14]
    lon, lat, v = 2.0 * i + 0.4 * j, 1.5 * j - 0.2 * i, rnd.normal(size=(12, 14))
    wrap = lambda x: (x + 180) % 360 - 180
    x, y = rnd.uniform(-2, 32, 200), rnd.uniform(-4, 18, 200)
    first = {r.id: r for r in curvilinear2loc(curvilinear(spark, lon, lat, v), at(spark, *zip(x, y))).collect()}
    moved = {r.id: r for r in curvilinear2loc(curvilinear(spark, wrap(lon + shift), lat, v), at(spark, *zip(wrap(x + shift), y))).collect()}
    assert sum(r.p >= 0 for r in first.values()) > 80
    for n, r in first.items():
        assert (moved[n].p, moved[n].q) == pytest.approx((r.p, r.q), abs=1e-6) and (moved[n].v == pytest.approx(r.v, abs=1e-6) if r.v is not None else moved[n].v is None)


@pytest.mark.parametrize("pole", [1, -1])
def test_cells_around_a_pole(spark, pole):
    """A grid laid over the pole: the value is the way along one of its axes."""
    a = np.arange(-3, 4) * 2.0 + 0.5
    gx, gy = np.meshgrid(a, a)
    lon, lat = np.degrees(np.arctan2(gy, gx)), pole * (90 - np.hypot(gx, gy))
    points = [(0, pole * 90), (45, pole * 89.8), (-120, pole * 89.5), (10, pole * 86), (10, 0), (200, -pole * 89.8)]
    out = {r.id: r.v for r in curvilinear2loc(curvilinear(spark, lon, lat, gx), at(spark, *points)).collect()}
    for n, (x, y) in enumerate(points[:3]):
        assert out[n] == pytest.approx((90 - abs(y)) * np.cos(np.radians(x)), abs=1e-6)
    assert out[3] == pytest.approx(4 * np.cos(np.radians(10)), abs=0.1)
    assert out[4] is None and out[5] is None


@pytest.mark.parametrize("literal", [4096, 3])
def test_rings_and_long_axes(spark, literal):
    n = 10
    ring = spark.createDataFrame([(i, 36.0 * i, float(i)) for i in range(n)], "i int, lon double, v double")
    p = spark.createDataFrame([(k, float(x)) for k, x in enumerate([342, 0, 18, -18, 360, 324, 359.9, 720 + 90])] + [(20, None)], "id int, lon double")
    out = {r.id: r.v for r in grid2loc(ring, p, {"i": "lon"}, "v", period={"lon": 360.0}, literal=literal).collect()}
    assert [out[k] for k in range(8)] == pytest.approx([4.5, 0, 0.5, 4.5, 0, 9, 9 * 0.1 / 36, 2.5]) and out[20] is None
    out = {r.id: r.v for r in grid2loc(ring, p, {"i": "lon"}, "v", literal=literal).collect()}
    assert out[0] is None and out[4] is None and out[2] == 0.5 and out[5] == 9 and out[3] is None


@pytest.mark.parametrize("literal", [4096, 2])
def test_uneven_axes(spark, literal):
    rnd = np.random.default_rng(7)
    x, y = np.cumsum(rnd.exponential(1, 300) ** 3 + 1e-3), np.cumsum(rnd.uniform(0.1, 2, 20))
    v = rnd.normal(size=(20, 300))
    grid = spark.createDataFrame([(j, i, float(x[i]), float(y[j]), float(v[j, i])) for j in range(20) for i in range(300)], "j int, i int, lon double, lat double, v double")
    px, py = np.concatenate([rnd.uniform(x[0] - 5, x[-1] + 5, 100), x[:50]]), rnd.uniform(y[0], y[-1], 150)
    out = {r.id: r.v for r in grid2loc(grid, at(spark, *zip(px, py)), {"i": "lon", "j": "lat"}, "v", literal=literal).collect()}
    for n, (a, b) in enumerate(zip(px, py)):
        if not x[0] <= a <= x[-1]:
            assert out[n] is None
            continue
        i, j = min(np.searchsorted(x, a, "right") - 1, 298), min(np.searchsorted(y, b, "right") - 1, 18)
        s, t = (a - x[i]) / (x[i + 1] - x[i]), (b - y[j]) / (y[j + 1] - y[j])
        want = (1 - t) * ((1 - s) * v[j, i] + s * v[j, i + 1]) + t * ((1 - s) * v[j + 1, i] + s * v[j + 1, i + 1])
        assert out[n] == pytest.approx(want)
