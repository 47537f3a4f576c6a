"""Kernels by dimension and index, filters by key, profiles over coordinates of several dimensions, levels at locations."""

import itertools
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from gyre.errors import MetaError, TimeStepError
from gyre.gridframe import GridFrame
from gyre.operators import filters, thermdyn
from gyre.operators.regrid import regrid1d_nd


def values(df, keys, v):
    return {tuple(r[k] for k in keys): r[v] for r in df.collect()}


def test_neighbours_go_by_index(spark):
    data = [(i, float(i), k) for k in "ab" for i in [0, 1, 2, 3, 4, 50, 51, 52]]
    df = spark.createDataFrame(data, "i int, v double, k string")
    out = values(filters.convolve(df, ["k"], ["i"], "v", 3, True, 0.9), ["k", "i"], "v")
    assert [out["a", i] for i in (0, 1, 4, 50, 51)] == pytest.approx([0.5, 1.0, 3.5, 50.5, 51.0])
    one_of_two = filters.convolve(df.withColumn("j", F.lit(0)), ["k"], ["j", "i"], "v", np.ones((1, 3)), True, 0.9)
    assert values(one_of_two, ["k", "i"], "v") == pytest.approx(out)


def plain(cells, kernel, normalize, na):
    shape, out = kernel.shape, {}
    for at in cells:
        s = q = 0.0
        for k in np.ndindex(*shape):
            v = cells.get(tuple(a - (o - n // 2) for a, o, n in zip(at, k, shape)))
            if v is not None:
                s, q = s + kernel[k] * v, q + kernel[k]
        out[at] = (s / q if normalize else s) if q > filters.least_weight(kernel, na) else None
    return out


@pytest.mark.parametrize("kernel, normalize", [({"x": [1, 2, 1], "y": 5}, True), ({"y": 3}, False), ({"x": 7, "y": [0.5, 0, 2, 1]}, False), (5, True), ([3, 7, 3], False)])
def test_separate_passes_give_the_product(spark, kernel, normalize):
    rnd = np.random.default_rng(4)
    places = [p for p in itertools.product(range(6), range(9), range(4)) if rnd.random() < 0.7]  # gaps
    cells = {p: float(rnd.normal()) if rnd.random() < 0.8 else None for p in places}
    df = spark.createDataFrame([(*p, v) for p, v in cells.items()], "y int, x int, z int, v double")
    dims = ["y", "x", "z"]
    whole = filters.make_kernel([np.atleast_1d(k) for k in filters.axis_kernels(kernel, dims)], 3)
    got = values(filters.convolve(df, [], dims, "v", kernel, normalize, 0.7), dims, "v")
    want = plain(cells, whole, normalize, 0.7)
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p]) if want[p] is not None else got[p] is None for p in want)
    with pytest.raises(ValueError, match="no such"):
        filters.convolve(df, [], dims, "v", {"t": 3})


def test_tides_of_two_rates(spark):
    def series(key, step, n):
        return [(key, 1_600_000_000 + step * i, math.sin(step * i / 9000) + i * step / 1e6) for i in range(n)]

    hourly, half = series("h", 3600, 120), series("q", 1800, 240)
    df = spark.createDataFrame(hourly + half + [("one", 1_600_000_000, 1.0)], "k string, s long, v double").withColumn("t", F.timestamp_seconds("s")).drop("s")
    got = values(filters.tidal_filter(df, ["k"], "t", "v", "mean", 0.1).withColumn("s", F.unix_seconds("t")), ["k", "s"], "v")
    w = np.interp(np.linspace(0, 24, 49), np.arange(25), filters.tidal_weights("mean"))
    for rows, weights in ((hourly, np.ones(25)), (half, w)):
        reach = len(weights) // 2
        for i in range(reach, len(rows) - reach):
            part = np.array([r[2] for r in rows[i - reach : i + reach + 1]])
            assert got[rows[i][:2]] == pytest.approx((part * weights).sum() / weights.sum())
    assert got["one", 1_600_000_000] is None
    with pytest.raises(TimeStepError, match="regular"):
        filters.tidal_filter(df.where("k <> 'h' OR unix_seconds(t) % 7 <> 0"), ["k"], "t", "v")


def test_mixed_layer_of_columns_by_what_they_are(spark):
    rows = [(p, float(-d), 1020 + 0.01 * d + p) for p in range(3) for d in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "p int, depth double, rho double")
    df = df.withColumn("rho", F.col("rho").alias("rho", metadata={"standard_name": "sea_water_density"}))
    out = values(thermdyn.mixed_layer_depth(df, ["p"], "depth", "rho"), ["p"], "mld")
    assert list(out.values()) == pytest.approx([3.0] * 3)
    at = values(thermdyn.mixed_layer_depth(df, ["p"], "depth", "rho", zref=-10.0), ["p"], "mld")
    assert list(at.values()) == pytest.approx([13.0] * 3)
    null = df.withColumn("p", F.when(F.col("p") > 0, F.col("p")))
    assert values(thermdyn.mixed_layer_depth(null, ["p"], "depth", "rho", zref=-10.0), ["p"], "mld")[None,] == pytest.approx(13.0)
    with pytest.raises(MetaError):
        thermdyn.mixed_layer_depth(df.withColumn("speed", F.col("depth") * 2), ["p"], "depth", "speed")


@pytest.mark.parametrize("of", [("tx", "tx", "tx"), ("x", "tx", "tx"), ("tx", "t", "tx"), ("tx", "tx", "x"), ("tx", "", ""), ("", "t", "x")])
def test_profiles_over_coordinates_of_several_dimensions(spark, of):
    """Coordinates and values repeat along the dimensions that they lack."""
    rnd = np.random.default_rng(9)
    sizes, nz, no = {"t": 3, "x": 6}, 8, 5
    shape = lambda dims, n: [sizes[d] for d in dims] + [n]
    v, y, to = rnd.normal(size=shape(of[0], nz)), np.sort(rnd.uniform(0, 50, shape(of[1], nz)), -1), rnd.uniform(-5, 55, shape(of[2], no))

    def frame(array, dims, z, name):
        names = [*dims, z]
        return spark.createDataFrame([(*map(int, k), float(array[k])) for k in np.ndindex(array.shape)], ", ".join(f"{n} int" for n in names) + f", {name} double")

    out = regrid1d_nd(frame(v, of[0], "z", "v"), frame(y, of[1], "z", "y"), frame(to, of[2], "k", "y"), ["t", "x"], "z", "k", "y", "v")
    every = [d for d in "tx" if any(d in o for o in of)]
    got = values(out, [*every, "k"], "v")
    assert len(got) == int(np.prod([sizes[d] for d in every])) * no
    for key, value in got.items():
        at = dict(zip([*every, "k"], key))
        pick = lambda array, dims: array[tuple(at[d] for d in dims)]
        ys, vs, where = pick(y, of[1]), pick(v, of[0]), pick(to, of[2])[at["k"]]
        inside = ys[0] <= where <= ys[-1]
        assert value == pytest.approx(np.interp(where, ys, vs)) if inside else value is None


def test_levels_at_locations(spark):
    meta = lambda loc: {"standard_name": f"ocean_sigma_coordinate{loc}", "formula_terms": "sigma: s eta: ssh depth: h"}
    rows = [(i, k, -k / 4, 0.1 * i, 10.0 + i, 5.0 + i) for i in range(4) for k in range(5)]
    df = spark.createDataFrame(rows, "i int, k int, s double, ssh double, h double, h_v double")
    df = df.withColumn("s", F.col("s").alias("s", metadata=meta("_at_r_location")))
    frame = GridFrame(df, ("i", "k"), ("s",))
    assert set(frame.sigma_terms(["u", None])) == {("r", "u"), ("r", None)} and frame.sigma_terms(["u"])["r", "u"][1]["depth"] == "h_u"
    out = frame.decode_sigma(hlocs=[None, "u", "v"], average={"u": "i", "v": "i"})
    assert out.coords == ("s", "depth_r", "depth_ur", "depth_vr")
    for r in out.df.collect():
        j = min(r.i + 1, 3)
        ssh, h = (0.1 * r.i + 0.1 * j) / 2, 10 + (r.i + j) / 2
        assert r.depth_r == pytest.approx(r.ssh + r.s * (r.ssh + r.h)) and r.depth_ur == pytest.approx(ssh + r.s * (ssh + h))
        assert r.depth_vr == pytest.approx(ssh + r.s * (ssh + r.h_v))
    with pytest.raises(KeyError):
        frame.decode_sigma(hlocs=["u"])
