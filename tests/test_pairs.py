"""Joins in blocks, and points at one place taken as one."""

import numpy as np

from gyre.gridframe import GridFrame
from gyre.operators import distance, geostat, interp
from gyre.operators.pairs import met


def points(spark, n, places, seed=1):
    g = np.random.default_rng(seed)
    lon, lat = g.uniform(-30, 30, places), g.uniform(-20, 20, places)
    rows = [(i, float(lon[i % places]), float(lat[i % places]), float(g.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, lon double, lat double, value double"), rows


def test_blocks_of_one_key_meet_in_many_tasks(spark):
    a, b = spark.range(300, numPartitions=1).selectExpr("id a", "0 k"), spark.range(200, numPartitions=1).selectExpr("id b", "0 k")
    out = met(a, b, ["k"], block=50)
    assert out.distinct().count() == out.count() == 60_000
    assert out.selectExpr("spark_partition_id() p").distinct().count() > 4
    assert met(a, b.where("b < 0"), ["k"]).count() == 0


def test_pairwise_is_spread(spark):
    p, _ = points(spark, 2500, 2500)
    out = distance.self_pairwise(p.coalesce(1))
    assert out.count() == 2500 * 2499 // 2
    assert out.selectExpr("spark_partition_id() p").distinct().count() > 1


def test_radius_average_of_points_at_one_place(spark):
    p, rows = points(spark, 300, 20)
    got = {r.id: r.value for r in distance.radius_average(p, p, 900_000.0).collect()}
    every = {(r.id_a, r.id_b): r.dist for r in distance.pairwise(p, p).collect()}
    for i, *_ in rows:
        near = [b[3] for b in rows if every[i, b[0]] <= 900_000.0]
        assert abs(got[i] - sum(near) / len(near)) < 1e-12


def test_variogram_bins_of_points_at_one_place(spark):
    p, rows = points(spark, 120, 30)
    got = {r.bin: (r.dist, r.gamma) for r in geostat.empirical_variogram(p, nbin=6, nbin0=1, most=None).collect()}
    first = {}
    for r in sorted(geostat.variogram_pairs(p, most=None).collect(), key=lambda r: (r._a, r._b)):
        first.setdefault(round(r.dist * 1000, 3), (r.dist, r.gamma))
    listed = [first[k] for k in sorted(first)]
    edges = geostat.bin_edges(len(listed), 6, 1)
    assert geostat._two_of_place(p.withColumnRenamed('value', 'v')).count() == 60
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        assert np.allclose(got[k], np.mean(listed[a : b + 1], axis=0))


def test_krig_at_one_place_and_without_one(spark):
    p, _ = points(spark, 40, 40)
    model = geostat.VariogramModel("linear", n=0.0, s=1.0, r=40_000.0)
    to = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, 5.0, 2.0)], "id long, lon double, lat double")
    for options in ({}, {"neighbours": 3}):
        got = {r.id: (r.value, r.error) for r in geostat.krig(p, to, model, **options).collect()}
        assert sorted(got) == [1, 2, 3] and got[1] == got[2] != got[3]


def test_grid_to_points_at_one_place(spark):
    grid = spark.createDataFrame([(i, k, float(i), 10.0 * k, float(i + k)) for i in range(4) for k in range(3)], "i int, k int, lon double, depth double, v double")
    p = spark.createDataFrame([(1, 0.5, 5.0), (2, 0.5, 5.0), (3, 0.5, 15.0), (4, None, 5.0), (5, 0.5, None), (6, 9.0, 5.0)], "id int, lon double, depth double")
    out = {r.id: r.v for r in interp.grid2loc(grid, p, {"i": "lon"}, "v", level="k", level_coord="depth").collect()}
    assert out == {1: 1.0, 2: 1.0, 3: 2.0, 4: None, 5: None, 6: None}
    out = sorted((r.id, r.k, r.v) for r in interp.grid2loc(grid, p, {"i": "lon"}, "v", ["k"]).collect() if r.k is not None)
    assert out == [(i, k, 0.5 + k) for i in (1, 2, 3, 5) for k in range(3)]


def test_averaged_between_cells(spark):
    rows = spark.createDataFrame([(i, float(i * i)) for i in (0, 1, 3, 7)], "x int, eta double")
    out = GridFrame(rows, ("x",)).averaged(["eta"], "u", "x").df
    assert {r.x: r.eta_u for r in out.collect()} == {0: 0.5, 1: 5.0, 3: 29.0, 7: 49.0}
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_of_blocks_meet_as_arrays(spark, tmp_path):
    a = spark.range(3000).selectExpr("id a", "id % 3 k", "IF(id % 5 = 0, NULL, id) x")
    b = spark.range(900).selectExpr("id b", "id % 4 k", "id * 0.5D y")
    got, plain = (df.select("a", "k", "x", "b", "y") for df in (met(a, b, ["k"], block=500), a.join(b, "k")))
    assert got.count() == plain.count() == 675_000 and got.exceptAll(plain).count() == 0
    assert met(a.select("k"), b, ["k"]).count() == 675_000
    # Pairs of a row lie together, and few rows of arrays are dealt.
    one = met(spark.range(2000).selectExpr("id a", "0 k"), spark.range(1500).selectExpr("id b", "0 k"), ["k"]).select("a", "b")
    assert "inline" in one._jdf.queryExecution().executedPlan().toString()
    one.write.parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.3 * 3_000_000


def test_places_are_looked_up_once(spark):
    grid = spark.createDataFrame([(i, k, float(i), float(i + k)) for i in range(4) for k in range(3)], "i int, k int, lon double, v double")
    p = spark.range(900).selectExpr("id", "CAST(id % 2 AS DOUBLE) + 0.5 lon")
    out = interp.grid2loc(grid, p, {"i": "lon"}, "v", ["k"])
    assert out.count() == 2700 and out.where("v <> id % 2 + 0.5 + k").count() == 0
