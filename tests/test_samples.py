"""Slabs, sorted axes, named samples, folders that go, and columns that are not one."""

import os

import pytest

from gyre import scratch
from gyre.errors import MetaError
from gyre.meta.specs import MetaSpecs
from gyre.operators import grid
from gyre.sources.samples import get_sample, register_sample, sample_names


def test_slabs_and_axes(spark):
    a = spark.createDataFrame([(1, 5, 1.0), (2, 6, 2.0)], "t int, x int, v double")
    b = spark.createDataFrame([(9, 5, 3.0, "w"), (11, 6, 4.0, "z")], "t int, x int, v double, n string")
    out = grid.concat([a, b.where("false"), b, a], "t", start=10)
    assert sorted((r.t, r.v, r.n) for r in out.collect()) == [(10, 1.0, None), (11, 2.0, None), (12, 3.0, "w"), (14, 4.0, "z"), (15, 1.0, None), (16, 2.0, None)]
    assert sorted((r.t, r.v) for r in grid.reverse(b, [], "t").collect()) == [(9, 4.0), (11, 3.0)]
    s = spark.createDataFrame([("a", 3, 1.0), ("a", 4, None), ("a", 5, 0.5), ("b", 0, 2.0)], "k string, i int, c double")
    assert sorted(tuple(r) for r in grid.sort(s, ["k"], "i", "c").select("k", "i", "c").collect()) == [("a", 3, 0.5), ("a", 4, 1.0), ("a", 5, None), ("b", 0, 2.0)]
    with pytest.raises(ValueError):
        grid.concat([], "t")


def test_named_samples(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,v\n1,2.5\n")
    register_sample("own.x", str(tmp_path / "x.csv"), schema="id long, v double")
    assert "own.x" in sample_names("own.*") and get_sample(spark, "own.x", columns=["v"]).collect() == [(2.5,)]
    with pytest.raises(KeyError, match="own.x"):
        get_sample(spark, "own.y")


def test_folders_go_with_their_block(spark, tmp_path):
    df = spark.range(3)
    with scratch.cleared():
        kept = scratch.written(df, "test")
        files = [f.removeprefix("file://") for f in kept.inputFiles()]
        assert kept.count() == 3 and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))
    assert scratch.written(df, "test").count() == 3


def test_several_columns_for_one_quantity(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "temperature double, temp double, lon double")
    s = MetaSpecs.default()
    assert s.search_all(df, "temp")[0] == "temp" and len(s.search_all(df, "temp")) == 2 and s.search_all(df, "sal") == []
    assert s.search(df, "temp") == "temp" and s.search(df, "lon", errors="raise") == "lon"
    with pytest.warns(UserWarning, match="2 columns match, temp, temperature; the first"):
        assert s.search(df, "temp", errors="warn") == "temp"
    with pytest.warns(UserWarning, match="sal: 0 columns"):
        assert s.search(df, "sal", errors="warn") is None
    for name in ("temp", "sal"):
        with pytest.raises(MetaError):
            s.search(df, name, errors="raise")
