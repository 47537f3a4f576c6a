"""Coordinates and dimensions by meaning, the operators on them, and grids to points."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre import coords
from gyre.gridframe import GridFrame
from gyre.meta import specs as meta
from gyre.operators import geostat, grid, interp, regrid, thermdyn
from gyre.sources.samples import open_sample


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, j, i, 4.0 + i, 40.0 + j, -5.0 * k, 10.0 + k + j + i) for k in range(3) for j in range(2) for i in range(4)]
    df = spark.createDataFrame(rows, "lev int, nj int, ni int, longitude double, latitude double, depth double, temperature double")
    spans = {"longitude": ("ni",), "latitude": ("nj",), "depth": ("lev",)}
    return GridFrame(df, ("lev", "nj", "ni"), ("longitude", "latitude", "depth"), {"ni": "x", "nj": "y", "lev": "z"}, spans)


def field(name, **attrs):
    return T.StructField(name, T.DoubleType(), metadata=attrs)


def test_coordinates_by_meaning(frame):
    assert (coords.get_lon(frame), coords.get_lat(frame), coords.get_vertical(frame)) == ("longitude", "latitude", "depth")
    assert coords.get_time(frame, "ignore") is None and coords.get_altitude(frame, "ignore") is None
    with pytest.raises(KeyError):
        coords.get_time(frame)
    assert coords.get_depth(frame)[1] == "depth"
    assert coords.get_meta_coords(frame, ("lon", "lat", "time")) == {"lon": "longitude", "lat": "latitude"}
    assert coords.is_lon(field("nav_lon")) and coords.is_lat(field("y", standard_name="latitude")) and not coords.is_lon(field("salt"))
    assert coords.is_depth(field("depth")) and coords.is_time(field("time")) and not coords.is_altitude(field("depth"))


def test_dimensions_by_type(frame):
    assert [coords.get_xdim(frame), coords.get_ydim(frame), coords.get_zdim(frame)] == ["ni", "nj", "lev"]
    assert coords.get_tdim(frame, "ignore") is None and coords.get_fdim(frame, "ignore") is None
    assert coords.get_meta_dims(frame, "yx") == ["nj", "ni"]
    untyped = GridFrame(frame.df, frame.dims, frame.coords, spans=frame.spans)
    assert coords.get_dim(untyped, "x") == "ni"
    assert coords.get_meta_dims(GridFrame(frame.df, ("lev", "nj", "ni")), "tyx", positional=True) == ["lev", "nj", "ni"]
    with pytest.raises(KeyError):
        coords.get_meta_dims(frame, "tx")


def test_what_belongs_to_dimensions(frame):
    assert coords.coords_compat_with_dims(frame, ("ni", "nj")) == ["longitude", "latitude"]
    assert coords.coords_compat_with_dims(frame, exclude=("lev",)) == ["longitude", "latitude"]
    assert coords.binding_data_vars(frame, "longitude") == ["temperature"]
    assert coords.drop_dim_coords(frame, "ni").coords == ("latitude", "depth")
    changed = coords.change_index(frame, "ni", [10.0, 20.0, 30.0, 40.0])
    assert {(r.ni, r.ni_value) for r in changed.df.collect()} == {(i, 10.0 * (i + 1)) for i in range(4)} and changed.along("ni_value") == ("ni",)
    assert coords.positive_attr(frame) == "up"
    marked = GridFrame(frame.df.withColumn("depth", F.col("depth").alias("depth", metadata={"positive": "Down"})), frame.dims, frame.coords)
    assert coords.positive_attr(marked, "depth") == coords.positive_attr(marked) == "down"


def test_depth_from_levels_and_thicknesses(spark):
    rows = [(0, k, s, 0.5, 100.0) for k, s in enumerate([-1.0, -0.5, 0.0])]
    df = spark.createDataFrame(rows, "x int, k int, sig double, zeta double, h double")
    terms = {"standard_name": "ocean_sigma_coordinate", "formula_terms": "sigma: sig eta: zeta depth: h"}
    df = df.withColumn("sig", F.col("sig").alias("sig", metadata=terms))
    found, name = coords.get_depth(GridFrame(df, ("x", "k"), ("sig",)))
    assert [r[0] for r in found.df.orderBy("k").select(name).collect()] == [-100.0, -49.75, 0.5]
    with pytest.raises(ValueError):
        GridFrame(df, ("x", "k"), spans={"h": ("x", "k"), "zeta": ("x",)}).decode_sigma()
    layers = spark.createDataFrame([(0, k, dz) for k, dz in enumerate([100.0, 500.0, 1000.0])], "x int, k int, dz double")
    found, name = coords.get_depth(coords.decode_dz2depth(GridFrame(layers, ("x", "k"), types={"k": "z"}), "down"))
    assert [r[0] for r in found.df.orderBy("k").select(name).collect()] == [50.0, 350.0, 1100.0]
    with pytest.raises(KeyError):
        coords.get_depth(GridFrame(df.drop("sig"), ("x", "k")))


def test_variants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "ptemp double, psal double, sigma0 double, sla double")
    assert [thermdyn.get_temp(df), thermdyn.get_sal(df), thermdyn.get_dens(df), thermdyn.get_sea_level(df)] == ["ptemp", "psal", "sigma0", "sla"]
    assert thermdyn.is_temp(field("temp")) and thermdyn.is_sal(field("salinity")) and not thermdyn.is_dens(field("temp"))
    with pytest.raises(KeyError):
        thermdyn.get_temp(df.drop("ptemp"), "raise")


def test_mixed_layer_below_a_reference(spark):
    rows = [(1, z, t) for z, t in zip([-50.0, -40.0, -30.0, -20.0, -10.0, 0.0], [10.0, 12.0, 14.0, 15.0, 15.1, 18.0])]
    df = spark.createDataFrame(rows, "p int, depth double, temp double")
    mld = lambda **k: thermdyn.mixed_layer_depth(df, ["p"], "depth", "temp", **k).first().mld
    assert mld() == pytest.approx(0.2 / 2.9 * 10)
    assert mld(zref=-10.0) == pytest.approx(20 + 0.1 * 10)


def test_specifications(spark, tmp_path):
    s = meta.MetaSpecs.default()
    df = spark.createDataFrame([(1.0, 2.0)], "temp_t double, lon_u double")
    assert s.locations(df) == {"temp_t": "t", "lon_u": "u"}
    assert s.dims(("nt", "lat", "lon"), "yx") == ["lat", "lon"] and s.parse_dims(("time", "lat", "lon"), ["lon", "y", "time"]) == ["lon", "lat", "time"]
    assert s.match_dim("lon") == "lon" and s.match_dim("lon", "lat") is None and s.category("temp") == "data_vars" and s.category("lon") == "coords"
    with pytest.raises(KeyError):
        s.parse_dims(("lat",), ["x"])
    assert meta.search_similar(df, field("temperature")) == "temp_t" and meta.search_similar(df, field("salt")) is None
    path = tmp_path / "own.txt"
    path.write_text("[data_vars]\nbubbles | bub |  | bubble_count | 1\n")
    own = meta.from_file(str(path))
    assert own.name == "own" and own.match(field("bub")) == ("data_vars", "bubbles") and own.to_dict()["data_vars"]["bubbles"]["units"] == ("1",)
    try:
        assert meta.infer(own.assign(df)).name == "own" and meta.from_name("own") is own
    finally:
        meta.reset()
    assert meta.from_name("own", "ignore") is None and meta.from_name("default").name == "default"


@pytest.mark.parametrize("mode", ["reflect", "symmetric", "wrap"])
def test_pad_modes(spark, mode):
    v = [3.0, 1.0, 4.0, 1.5, 9.0]
    df = spark.createDataFrame([(0, i, x, 10.0 * i) for i, x in enumerate(v)], "p int, i int, v double, x double")
    out = grid.pad(df, ["p"], "i", ["v"], 2, 3, mode, coords=["x"]).orderBy("i").collect()
    assert [r.v for r in out] == np.pad(v, (2, 3), mode).tolist() and [r.x for r in out] == [10.0 * i for i in range(-2, 8)]


@pytest.mark.parametrize("name,sides", [("no", ()), (False, ()), ("yes", ("top", "bottom")), (2, ("top", "bottom")), ("above", ("top",)), (-1, ("bottom",)), ("Below", ("bottom",))])
def test_names_of_extrapolation(name, sides):
    assert regrid.extrap_sides(name) == sides


def test_indices_and_changes(spark):
    df = spark.createDataFrame([(p, t, None if (p, t) == (0, 0) else float(t * t)) for p in range(2) for t in range(4)], "p int, t int, v double")
    assert {tuple(r) for r in coords.iminmax(df, ["p"], "t", "v").collect()} == {(0, 1, 3), (1, 0, 3)}
    assert {tuple(r) for r in coords.mask_counts(df, ["p"], "v").collect()} == {(0, 1, 4, True), (1, 0, 4, False)}
    parts = coords.axis_slices("t", 4)
    assert {k: [r.t for r in df.where("p = 1").where(c).orderBy("t").collect()] for k, c in parts.items()} == {
        "all": [0, 1, 2, 3], "first": [0], "last": [3], "firsts": [0, 1, 2], "lasts": [1, 2, 3], "mid": [1, 2]
    }
    timed = df.where("p = 1").withColumn("time", F.timestamp_seconds(F.col("t") * 10))
    out = coords.rate_of_change(timed, ["p"], "time", ["v"]).orderBy("time").collect()
    assert [r.v for r in out] == pytest.approx((np.gradient(np.arange(4.0) ** 2) / 10).tolist())
    shape = [3, 4, 5]
    place = spark.range(60).select(*[c.alias(f"i{n}") for n, c in enumerate(coords.unravel_index("id", shape))], "id")
    assert [tuple(r)[:3] for r in place.orderBy("id").collect()] == [tuple(map(int, np.unravel_index(n, shape))) for n in range(60)]
    assert place.where(coords.ravel_index(["i0", "i1", "i2"], shape) != F.col("id")).count() == 0


def bent(n=6, m=5):
    return {(j, i): (2.0 * i + 0.35 * j + 0.05 * i * j, 1.5 * j - 0.2 * i + 0.04 * j * j) for j in range(m) for i in range(n)}


def test_curvilinear_grid_to_points(spark):
    nodes = bent()
    df = spark.createDataFrame([(j, i, x, y, 3 * x - 2 * y) for (j, i), (x, y) in nodes.items()], "j int, i int, lon double, lat double, v double")
    rng = np.random.default_rng(0)
    pts = [(n, float(x), float(y)) for n, (x, y) in enumerate(zip(rng.uniform(-1, 13, 200), rng.uniform(-2, 8, 200)))]
    pts += [(500, *nodes[2, 3]), (501, None, 1.0), (502, *nodes[4, 5])]
    out = {r.id: r for r in interp.curvilinear2loc(df, spark.createDataFrame(pts, "id int, lon double, lat double")).collect()}
    assert len(out) == len(pts)
    inside = 0
    for n, x, y in pts:
        want = (-1.0, -1.0)
        for j in range(4):
            for i in range(5):
                if x is not None and want == (-1.0, -1.0):
                    c = np.array([nodes[j, i], nodes[j, i + 1], nodes[j + 1, i + 1], nodes[j + 1, i]])
                    p, q = interp.cell_coordinates(x, y, c)
                    want = (i + p, j + q) if p >= 0 else want
        assert (out[n].p, out[n].q) == pytest.approx(want, abs=1e-6)
        assert out[n].v == (None if want[0] < 0 else pytest.approx(3 * x - 2 * y, abs=1e-6))
        inside += want[0] >= 0
    assert inside > 60
    holed = df.withColumn("v", F.when(~((F.col("j") == 0) & (F.col("i") == 0)), F.col("v")))
    near = spark.createDataFrame([(1, 1.0, 0.4), (2, *nodes[1, 1])], "id int, lon double, lat double")
    got = {r.id: r.v for r in interp.curvilinear2loc(holed, near).collect()}
    assert got[1] is None and got[2] is not None


def test_axes_that_are_none(spark):
    df = spark.createDataFrame([(j, i, i + 5.0 * j, float(j), 1.0) for j in range(3) for i in range(3)], "j int, i int, lon double, lat double, v double")
    points = spark.createDataFrame([(1, 1.0, 1.0)], "id int, lon double, lat double")
    with pytest.raises(ValueError, match="changes along"):
        interp.grid2loc(df, points, {"i": "lon", "j": "lat"}, "v")
    with pytest.raises(ValueError, match="does not rise"):
        interp.grid2loc(df.withColumn("lat", -F.col("lat")), points, {"j": "lat"}, "v")


def test_levels_that_change_from_cell_to_cell(spark):
    depth = lambda k, j, i: -(10.0 + i + 2 * j) * (3 - k)
    rows = [(k, j, i, float(i), float(j), depth(k, j, i), i + 2.0 * j + 7 * k, None if (k, j, i) == (3, 0, 0) else 1.0) for k in range(4) for j in range(3) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, j int, i int, lon double, lat double, depth double, v double, w double")
    pts = [(1, 0.5, 1.25, -20.0), (2, 2.0, 2.0, 0.0), (3, 0.5, 0.5, -500.0), (4, 0.5, 0.5, -0.5), (5, 9.0, 0.5, -1.0), (6, 0.5, 0.5, None)]
    out = {r.id: r for r in interp.grid2loc(df, spark.createDataFrame(pts, "id int, lon double, lat double, depth double"), {"i": "lon", "j": "lat"}, ["v", "w"], level="k", level_coord="depth").collect()}
    assert out[1].v == pytest.approx(0.5 + 2.5 + 7 * (3 - 20 / 13)) and out[1].w == 1.0
    assert out[2].v == pytest.approx(6.0 + 21) and out[4].w is None and out[4].v is not None
    assert out[3].v is out[5].v is out[6].v is None


def test_kriging_exactly_and_over_blocks(spark):
    pts = [(i, float(i % 5), float(i // 5), float(i % 7)) for i in range(25)]
    points = spark.createDataFrame(pts, "id int, lon double, lat double, value double")
    model = geostat.VariogramModel("exponential", n=0.1, s=4.0, r=300.0)
    exact = {r.id: r.value for r in geostat.krig(points, points.drop("value"), model, exact=True).collect()}
    assert [exact[i] for i, *_ in pts] == pytest.approx([v for *_, v in pts], abs=1e-6)
    targets = spark.createDataFrame([(1, 1.2, 1.3), (2, 1.3, 1.3), (3, 3.0, 3.4)], "id int, lon double, lat double")
    plain = {r.id: r.value for r in geostat.krig(points, targets, model).collect()}
    block = {r.id: r.value for r in geostat.krig(points, targets, model, block=0.5).collect()}
    assert block[1] == block[2] == pytest.approx((plain[1] + plain[2]) / 2) and block[3] == pytest.approx(plain[3])


def test_unit_rows_of_csv(spark, tmp_path):
    path = tmp_path / "drift.csv"
    path.write_text("id,when,lon\n,UTC,degrees_east\na,2020-01-01,1.5\nb,2020-01-02,bad\n")
    df = open_sample(spark, str(path), "id string, when date, lon double", skip_units=True)
    assert [(r.id, r.lon) for r in df.orderBy("id").collect()] == [("a", 1.5), ("b", None)]
