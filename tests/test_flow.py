"""Tracks over a field in tiles against the same steps over the whole field."""

import numpy as np
import pytest

from gyre.operators import dyn


def field(spark, nx=40, ny=30, hole=False, seed=2):
    rnd = np.random.default_rng(seed)
    lon, lat = np.cumsum(rnd.uniform(0.5, 1.5, nx)), np.cumsum(rnd.uniform(0.5, 1.5, ny)) - 10
    u, v = rnd.normal(0, 8, (2, ny, nx))
    if hole:
        u[10:12, 20:23] = v[10:12, 20:23] = np.nan
    value = lambda x: None if np.isnan(x) else float(x)
    rows = [(j, i, float(lon[i]), float(lat[j]), value(u[j, i]), value(v[j, i])) for j in range(ny) for i in range(nx)]
    return lon, lat, u, v, spark.createDataFrame(rows, "i_y int, i_x int, lon double, lat double, u double, v double")


def plain(lon, lat, u, v, seeds, steps, exact):
    box = (lon[0], lon[-1], lat[0], lat[-1])
    f = lambda x, y: dyn._velocity(x, y, lon, lat, u, v, box)
    x, y = (np.array([np.nan if s[k] is None else s[k] for s in seeds], float) for k in (1, 2))
    out, t = {(s[0], 0.0): p for s, p in zip(seeds, zip(x, y))}, 0.0
    for dt in steps:
        x, y = dyn._stepped(f, x, y, dt, exact)
        t += dt
        out |= {(s[0], t): p for s, p in zip(seeds, zip(x, y))}
    return out


@pytest.mark.parametrize("tile, particles, hole, exact", [(128, 20_000, False, False), (3, 7, True, True), (1, 50, True, False)])
def test_against_whole_field(spark, tile, particles, hole, exact):
    lon, lat, u, v, df = field(spark, hole=hole)
    rnd = np.random.default_rng(3)
    seeds = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rnd.uniform(lon[0] - 1, lon[-1] + 1, 120), rnd.uniform(lat[0], lat[-1], 120)))]
    seeds += [(200, float(lon[-1]), float(lat[-1])), (201, float(lon[0]), float(lat[3])), (202, None, 0.0), (203, float(lon[5]), float(lat[5]))]
    df_seeds = spark.createDataFrame(seeds, "id long, lon double, lat double")
    got = {(r.id, r.seconds): (r.lon, r.lat) for r in dyn.flow2d(df, df_seeds, 9.5 * 3600.0, 3600.0, exact, tile, particles).collect()}
    want = plain(lon, lat, u, v, seeds, [3600.0] * 9 + [1800.0], exact)
    assert got.keys() == want.keys()
    a, b = (np.array([m[k] for k in sorted(want)], float) for m in (got, want))
    assert np.allclose(a, b, rtol=0, atol=1e-9, equal_nan=True) and np.isfinite(a).mean() > 0.5


def test_no_seeds_no_steps_and_gaps(spark):
    *_, df = field(spark, 6, 5)
    seeds = spark.createDataFrame([(1, 3.0, -8.0)], "id int, lon double, lat double")
    assert dyn.flow2d(df, seeds.where("false"), 7200.0, 3600.0).count() == 0
    assert [tuple(r) for r in dyn.flow2d(df, seeds, 0.0, 3600.0).collect()] == [(1, 0.0, 3.0, -8.0)]
    with pytest.raises(ValueError, match="without gaps"):
        dyn.flow2d(df.where("i_x <> 2"), seeds, 7200.0, 3600.0)
