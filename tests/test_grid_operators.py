import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from gyre.operators import distance, dyn, filters, geostat, grid, interp, regrid, thermdyn
from gyre.sources.samples import open_sample
from gyre.streaming.resample import resample, tidal_resample


def values(df, order, col):
    return [r[col] for r in df.orderBy(*order).collect()]


def profile(spark, y, v, p=0):
    return spark.createDataFrame([(p, float(a), None if b is None else float(b)) for a, b in zip(y, v)], "p int, y double, v double")


@pytest.mark.parametrize("extrap,want", [("both", [1, 1, 1]), ("top", [None, 1, 1]), ("bottom", [1, 1, None]), ("no", [None, 1, None])])
def test_extrapolation(spark, extrap, want):
    out = regrid.regrid1d(profile(spark, [1, 2], [1, 1]), ["p"], "y", "v", [0.0, 1.5, 3.0], extrap=extrap)
    assert values(out, ["y"], "v") == want


def test_node_with_a_missing_right_neighbour_is_missing(spark):
    out = regrid.regrid1d(profile(spark, range(5), [1, 2, None, 4, 5]), ["p"], "y", "v", [0.0, 1.0, 2.0, 3.0, 4.0])
    assert values(out, ["y"], "v") == [1, None, None, 4, 5]


def test_one_valid_node_gives_nothing(spark):
    out = regrid.regrid1d(profile(spark, [1, 2], [3, None]), ["p"], "y", "v", [1.0, 1.5])
    assert values(out, ["y"], "v") == [None, None]


def test_drop_na_bridges_gaps(spark):
    df = profile(spark, range(5), [1, None, None, None, 5])
    at = [i / 2 for i in range(9)]
    assert values(regrid.regrid1d(df, ["p"], "y", "v", at, drop_na=True), ["y"], "v") == pytest.approx([1 + i / 2 for i in range(9)])
    assert set(values(regrid.regrid1d(df, ["p"], "y", "v", at[1:-1], drop_na=True, maxgap=2), ["y"], "v")) == {None}


def test_cubic_stays_in_range(spark):
    y = np.linspace(-100, 0, 15)
    out = regrid.regrid1d(profile(spark, y, 12.35 * y), ["p"], "y", "v", np.linspace(-95, -5, 9).tolist(), method="cubic")
    assert all(-1235 <= v <= 0 for v in values(out, ["y"], "v"))


@pytest.mark.parametrize("method", ["linear", "hermit"])
def test_linear_fields_are_exact(spark, method):
    rng = np.random.default_rng(0)
    y = np.sort(rng.uniform(-100, 0, 15)) if method == "linear" else np.linspace(-100, 0, 15)
    to = rng.uniform(-90, -10, 9).round(3).tolist()
    out = regrid.regrid1d(profile(spark, y, 12.35 * y), ["p"], "y", "v", to, method=method)
    assert values(out, ["y"], "v") == pytest.approx([12.35 * t for t in sorted(to)])


def test_unknown_method(spark):
    with pytest.raises(NotImplementedError):
        regrid.regrid1d(profile(spark, [1], [1]), ["p"], "y", "v", [1.0], method="cellave")


def test_conservation(spark):
    rng = np.random.default_rng(1)
    edges = np.concatenate([[-1000], np.sort(rng.uniform(-990, -10, 19)), [0]])
    rows = [(0, float(a), float(b), float(rng.uniform())) for a, b in zip(edges, edges[1:])]
    df = spark.createDataFrame(rows, "p int, lo double, hi double, v double")
    to = np.linspace(-1200, 200, 13).tolist()
    out = {r.cell: r.v for r in regrid.cellave1d(df, ["p"], "lo", "hi", "v", to, conserv=True).collect()}
    total = sum(v * (to[c + 1] - to[c]) for c, v in out.items())
    assert total == pytest.approx(sum(v * (b - a) for _, a, b, v in rows))


def test_isoslice_takes_last_or_first_crossing(spark):
    df = spark.createDataFrame([(0, i, float(i), v) for i, v in enumerate([0.0, 2.0, 0.0, 2.0])], "p int, i int, x double, v double")
    assert regrid.isoslice(df, ["p"], "i", "x", "v", 1.0).first().x == 2.5
    assert regrid.isoslice(df, ["p"], "i", "x", "v", 1.0, reverse=True).first().x == 0.5
    depth = spark.createDataFrame([(0, i, -50.0 + 10 * i, 10.0 + 2 * i) for i in range(6)], "p int, i int, d double, v double")
    assert regrid.isoslice(depth, ["p"], "i", "d", "v", 15.0).first().d == -25


def test_extrap1d(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1.0, None, 2.0, None])], "p int, i int, v double")
    assert values(regrid.extrap1d(df, ["p"], "i", "v"), ["i"], "v") == [1, 1, None, 2, 2]


def test_mixed_layer_depth(spark):
    z = [-50.0 + 10 * i for i in range(6)]
    make = lambda v: spark.createDataFrame([(0, a, b) for a, b in zip(z, v)], "p int, z double, v double")
    temp = make([10.0 + 2 * i for i in range(6)])
    assert thermdyn.mixed_layer_depth(temp, ["p"], "z", "v", "deltatemp").first().mld == pytest.approx(1)
    dens = make([1030.0 - i for i in range(6)])
    assert thermdyn.mixed_layer_depth(dens, ["p"], "z", "v", "deltadens", deltadens=1.0).first().mld == pytest.approx(10)
    kz = make([0.005 - 0.001 * i for i in range(6)])
    assert thermdyn.mixed_layer_depth(kz, ["p"], "z", "v", "kzmax").first().mld == pytest.approx(5)


DZ = [100.0, 500.0, 1000.0]


@pytest.mark.parametrize(
    "options,want",
    [
        ({"positive": "down"}, [0, 100, 600, 1600]),
        ({"positive": "up"}, [-1600, -1500, -1000, 0]),
        ({"positive": "up", "ref": "ssh", "ref_type": "top"}, [-1590, -1490, -990, 10]),
        ({"positive": "down", "ref": "bathy", "ref_type": "bottom"}, [100, 200, 700, 1700]),
        ({"positive": "down", "centered": True}, [50, 350, 1100]),
    ],
)
def test_dz2depth(spark, options, want):
    df = spark.createDataFrame([(0, i, d, 10.0, 1700.0) for i, d in enumerate(DZ)], "p int, k int, dz double, ssh double, bathy double")
    assert values(grid.dz2depth(df, ["p"], "k", "dz", **options), ["k"], "depth") == want


def test_grid_algebra(spark):
    df = spark.createDataFrame([(j, i, 2.0 * i, 3.0 * j - 2.0 * i) for j in range(3) for i in range(4)], "j int, i int, lon double, sst double")
    assert values(grid.centers(df, ["j"], "i", ["lon"]), ["j", "i"], "lon")[:3] == [1, 3, 5]
    padded = grid.pad(df, ["j"], "i", ["sst"], 1, 2, coords=["lon"])
    assert values(padded.where("j = 0"), ["i"], "lon") == [-2, 0, 2, 4, 6, 8, 10]
    assert values(padded.where("j = 0"), ["i"], "sst") == [0, 0, -2, -4, -6, -6, -6]
    assert values(grid.edges(df, ["j"], "i", [], ["lon"]).where("j = 0"), ["i"], "lon") == [-1, 1, 3, 5, 7]
    assert values(grid.diff(df, ["j"], "i", ["sst"]).where("j = 1"), ["i"], "sst") == [-2, -2, -2]
    assert values(grid.shift(df, ["j"], "i", ["lon"], "left").where("j = 0"), ["i"], "lon") == [0, 1, 3, 5]


def test_to_rect(spark):
    good = spark.createDataFrame([(j, i, 1.0 * i, 2.0 * j) for j in range(3) for i in range(4)], "j int, i int, lon double, lat double")
    x, y = grid.to_rect(good, "j", "i")
    assert values(x, ["i"], "lon") == [0, 1, 2, 3] and values(y, ["j"], "lat") == [0, 2, 4]
    assert grid.to_rect(good.withColumn("lon", F.col("lon") + F.col("j")), "j", "i") is None


def test_convolution_blanks_by_weight(spark):
    df = spark.createDataFrame([(y, x, None if (y, x) == (2, 2) else 1.0) for y in range(5) for x in range(5)], "y int, x int, v double")
    assert set(values(filters.convolve(df, [], ["y", "x"], "v", 3, True, 1.0), ["y"], "v")) == {1.0}
    assert set(values(filters.convolve(df, [], ["y", "x"], "v", 3, True, 0.0), ["y"], "v")) == {None}
    total = sum(values(filters.convolve(df, [], ["y", "x"], "v", 3, False, 1.0), ["y"], "v"))
    assert total == 160


def test_convolution_reverses_the_kernel(spark):
    df = spark.createDataFrame([(0, i, float(i == 3)) for i in range(7)], "p int, i int, v double")
    out = filters.convolve(df, ["p"], ["i"], "v", np.array([1.0, 2.0, 5.0]), False, 1.0)
    assert values(out, ["i"], "v") == [0, 0, 1, 2, 5, 0, 0]


def test_erosion(spark):
    hole = spark.createDataFrame([(y, x, None if 2 <= y < 7 and 3 <= x < 8 else 1.0) for y in range(9) for x in range(11)], "y int, x int, v double")
    left = filters.erode(hole, [], ["y", "x"], "v", 2)
    assert left.where("v IS NULL").count() == 1
    assert filters.erode(hole.withColumn("land", F.lit(False)), [], ["y", "x"], "v", mask="land").where("v IS NULL").count() == 0


@pytest.mark.parametrize("name,total,size", [("demerliac", 24576, 71), ("godin", 14400, 71), ("mean", 25, 25)])
def test_tides(spark, name, total, size):
    w = filters.tidal_weights(name)
    assert (sum(w), len(w)) == (total, size)
    df = spark.range(9 * 24).select(F.lit(0).alias("p"), (F.timestamp_seconds(F.col("id") * 3600)).alias("t"), F.cos(F.col("id") * math.pi / 12.5).alias("v"))
    out = [x for x in values(filters.tidal_filter(df, ["p"], "t", "v", name), ["t"], "v") if x is not None]
    assert len(out) == 9 * 24 - size + 1 and max(map(abs, out)) < (1e-4 if name != "godin" else 1e-2)


def test_irregular_steps_are_an_error(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 3600, 1.0), (0, 9000, 1.0)], "p int, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    with pytest.raises(ValueError):
        filters.tidal_filter(df, ["p"], "t", "v")


def test_kernels():
    assert filters.orthogonal_kernel([2.8], fill=-1).tolist() == [-1, 1, 1, -1]
    assert filters.shapiro_kernel(1).tolist() == [0, 1, 0] and filters.shapiro_kernel(2).sum() == 6
    assert filters.make_kernel(3, 3).shape == (3, 3, 3) and filters.make_kernel((3, 5), 2).shape == (3, 5)
    iso = filters.isotropic_kernel((5, 5))
    assert iso[2, 2] == iso.max() and np.allclose(iso, iso.T)


def points(spark, rows, schema="id long, lon double, lat double, value double"):
    return spark.createDataFrame(rows, schema)


def test_decimation(spark):
    p = points(spark, [(i, x, x, 20.0 + i) for i, x in enumerate([0.0, 1.0, 2.0, 5.0, 6.0])])
    assert values(filters.decimate(p, 160e3), ["id"], "lon") == [0, 2, 5]
    assert set(values(filters.decimate(p, 160e3, "average", smooth_factor=1e3), ["id"], "value")) == {22.0}


def test_distance_joins_at_the_date_line_and_poles(spark):
    rng = np.random.default_rng(4)
    spots = [(float(rng.uniform(-180, 180)), float(rng.uniform(-90, 90))) for _ in range(80)] + [(179.9, 0.0), (-179.9, 0.1), (0.0, 89.9), (180.0, 89.8), (10.0, -90.0)]
    a = points(spark, [(i, x, y, 0.0) for i, (x, y) in enumerate(spots)])
    b = points(spark, [(100 + i, x + 0.37 if x < 179 else x, y * 0.99, 0.0) for i, (x, y) in enumerate(spots[::2])])
    allp = {(r.id_a, r.id_b): r.dist for r in distance.pairwise(a, b).collect()}
    near = {i: min((round(d, 6), -k) for (j, k), d in allp.items() if j == i) for i in range(len(spots))}
    got = {r.id: (r.dist, -r.nearest_id) for r in distance.nearest(a, b).collect()}
    assert {i: k for i, (_, k) in got.items()} == {i: k for i, (_, k) in near.items()}
    assert [got[i][0] for i in near] == pytest.approx([near[i][0] for i in near], abs=1e-5)
    for radius in (1e5, 9e5):
        want = {i for (i, _), d in allp.items() if d < radius}
        assert {r.id for r in distance.within_radius(a, b, radius).collect()} == want


def test_extent(spark):
    p = points(spark, [(0, 0.0, 0.0, 0.0), (1, 10.0, 20.0, 0.0)])
    assert distance.extent(p) == [0, 10, 0, 20]
    assert distance.extent(p, margin=0.1) == pytest.approx([-1, 11, -2, 22])
    assert distance.extent(p, min_extent=(20.0, 1.0)) == [-5, 15, 0, 20]


def test_grid2loc_is_exact_on_linear_fields(spark):
    f = lambda x, y, t: 1.13 * x + 12.35 * y - 0.65 * t
    cells = [(t, y, x, 2.0 * x, 3.0 * y, 5.0 * t, f(2.0 * x, 3.0 * y, 5.0 * t)) for t in range(3) for y in range(4) for x in range(5)]
    g = spark.createDataFrame(cells, "k int, j int, i int, lon double, lat double, time double, v double")
    rng = np.random.default_rng(0)
    rows = [(n, float(rng.uniform(0, 8)), float(rng.uniform(0, 9)), float(rng.uniform(0, 10))) for n in range(10)] + [(90, 8.0, 9.0, 10.0), (91, 8.1, 0.0, 0.0), (92, None, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "id long, lon double, lat double, time double")
    out = {r.id: r.v for r in interp.grid2loc(g, p, {"i": "lon", "j": "lat", "k": "time"}, "v").collect()}
    for n, x, y, t in rows[:11]:
        assert out[n] == pytest.approx(f(x, y, t))
    assert out[91] is None and out[92] is None


def test_quadrilateral():
    corners = np.array([(0, 0), (3, 1), (2, 3), (-1, 2)], float)
    assert interp.cell_coordinates(1, 1.5, corners) == pytest.approx((0.5, 0.5))
    assert interp.cell_coordinates(-1, -1, corners) == (-1, -1)
    for (x, y), want in zip(corners, [(0, 0), (1, 0), (1, 1), (0, 1)]):
        assert interp.cell_coordinates(x, y, corners) == pytest.approx(want)


def test_flow(spark):
    cells = [(y, x, float(x), float(y), y * x / 3, (y + x) / 2) for y in range(3) for x in range(4)]
    field = spark.createDataFrame(cells, "i_y int, i_x int, lon double, lat double, u double, v double")
    seeds = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 1.5)], "id long, lon double, lat double")
    out = dyn.flow2d(field, seeds, 3 * 3600.0, 2 * 3600.0)
    assert values(out, ["seconds", "id"], "lon") == pytest.approx([1.0, 2.0, 1.0148674, 2.04497533, 1.02261437, 2.06865695])


def test_clusters_and_kriging(spark):
    p = points(spark, [(i, x, x, 2 * x) for i, x in enumerate([0.0, 1.0, 3.0, 4.0, 8.0, 9.0, 10.0])])
    sizes = sorted(r["count"] for r in geostat.clusterize(p, 3).groupBy("cluster").count().collect())
    assert sizes == [2, 2, 3]
    model = geostat.VariogramModel("linear", "km", n=0.0, s=100.0, r=3000.0)
    out = {r.id: r.value for r in geostat.krig(p, p, model).collect()}
    assert [out[i] for i in range(7)] == pytest.approx([2 * x for x in [0.0, 1.0, 3.0, 4.0, 8.0, 9.0, 10.0]], abs=1e-6)


@pytest.mark.parametrize("step", [1.0, 0.0])
def test_clusters_split_again(spark, step):
    p = points(spark, [(i, step * i, step * (i * 7 % 30), 1.0) for i in range(30)])
    out = geostat.clusterize(p, 3)
    sizes = [r["count"] for r in out.groupBy("cluster").count().collect()]
    assert sum(sizes) == 30 and max(sizes) <= 3 and out.select("id").distinct().count() == 30


def test_registered_variograms_take_all_pairs(spark, monkeypatch):
    from gyre.plans import queries, registry

    n = geostat.MAX_POINTS + 100
    p = points(spark, [(i, i % 40 * 1.37, i // 40 * 0.91, float(i % 7)) for i in range(n)])
    monkeypatch.setattr(queries, "suppliers", lambda *_: p)
    assert registry.QUERIES["variogram_pairs"](spark, "").count() == n * (n - 1) // 2
    gaps = points(spark, [(i, float(i), 0.0, None if i % 2 else 1.0) for i in range(20)])
    assert geostat.variogram_pairs(gaps, most=10).count() == 45
    seen = []
    monkeypatch.setattr(geostat, "empirical_variogram", lambda *_, most=0, **__: seen.append(most) or spark.createDataFrame([(0, 1.0, 1.0)], "bin int, dist double, gamma double"))
    registry.QUERIES["variogram_bins"](spark, "")
    assert seen == [None]


def test_variogram_fit(spark):
    rng = np.random.default_rng(2)
    p = points(spark, [(i, float(rng.uniform(0, 5)), float(rng.uniform(0, 5)), float(rng.normal())) for i in range(60)])
    model = geostat.VariogramModel("exponential").fit(p, nbin=8, nbin0=2)
    assert model.params["s"] > 0 and model.params["r"] > 0
    assert geostat.bin_edges(100, 10, 3) == [0, 3, 6, 9, 19, 29, 39, 49, 59, 69, 79, 89, 99]


def test_resample_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(600).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    df.write.parquet(src)
    stream = resample(spark.readStream.schema(df.schema).parquet(src), ["k"], "ts", "v", late="1 hour")
    q = stream.writeStream.format("memory").queryName("resampled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start, r.v) for r in spark.table("resampled").collect()} == {(r.start, r.v) for r in resample(df, ["k"], "ts", "v").collect()}


def test_tidal_stream(spark, tmp_path):
    src, w = str(tmp_path / "in"), filters.tidal_weights("demerliac")
    df = spark.range(6 * 24 * 2).select(F.timestamp_seconds(F.col("id") * 1800).alias("t"), F.lit("a").alias("k"), F.sin("id").alias("v"))
    df.write.parquet(src)
    stream = tidal_resample(spark.readStream.schema(df.schema).parquet(src), ["k"], "t", "v", late="1 hour")
    q = stream.writeStream.format("memory").queryName("tides").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    hourly = [(math.sin(2 * i) + math.sin(2 * i + 1)) / 2 for i in range(6 * 24)]
    want = {i + 35: sum(a * b for a, b in zip(w, hourly[i:])) / sum(w) for i in range(6 * 24 - 70)}
    batch = {r.h: r.v for r in tidal_resample(df, ["k"], "t", "v").select((F.unix_seconds("hour") / 3600).alias("h"), "v").collect()}
    got = {r.h: r.v for r in spark.table("tides").select((F.unix_seconds("hour") / 3600).alias("h"), "v").collect()}
    assert batch == pytest.approx(want)
    # The watermark trails the last row by an hour, and so the last hours wait for more.
    assert len(got) >= len(want) - 3 and got == pytest.approx({h: want[h] for h in got})


def test_open_sample(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,v\n(1),(m)\n1,2.5\n2,3.5\n")
    df = open_sample(spark, str(tmp_path / "x.csv"), "id long, v double", skip_units=True)
    assert values(df.where("id IS NOT NULL"), ["id"], "v") == [2.5, 3.5]
    with pytest.raises(ValueError):
        open_sample(spark, "a.xyz")
