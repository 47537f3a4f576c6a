import pytest

from pyspark.sql import functions as F

from gyre.gridframe import GridFrame, decode_formula_terms
from gyre.meta import specs as meta
from gyre.meta.locator import Locator


def frame(spark, *names, **attrs):
    df = spark.range(1)
    return df.select(*[F.lit(1.0).alias(n, metadata=attrs.get(n, {})) for n in names])


@pytest.mark.parametrize(
    "attr,value,want",
    [
        ("name", "temp_t", ("temp", "t")),
        ("name", "temp", ("temp", None)),
        ("standard_name", "sea_water_temperature_at_u_location", ("sea_water_temperature", "u")),
        ("long_name", "Temperature at U location", ("Temperature", "u")),
    ],
)
def test_locations(attr, value, want):
    assert Locator().parse(attr, value) == want


def test_location_formats():
    x = Locator()
    assert x.format("name", "temp_t", "u") == "temp_u" and x.format("name", "temp_t", None) == "temp"
    assert x.matches("name", "u_t", "u", "xtu") and not x.matches("name", "u_t", "u", False)
    assert x.location({"name": "u_u", "standard_name": "x_at_u_location"}) == "u"
    with pytest.raises(ValueError):
        x.location({"name": "u_u", "standard_name": "x_at_v_location"})


def test_locations_of_several_letters():
    x = Locator(("t", "r", "rho"), {"name": "{root}{loc}"})
    assert x.parse("name", "temprho") == ("temp", "rho") and x.parse("name", "tempr") == ("temp", "r")
    assert x.matches("name", "temprho", "temp", "rho") and not x.matches("name", "tempr", "temp", "rho")
    assert x.matches("name", "tempr", "temp", ["t", "r"]) and x.matches("name", "tempr", "temp", "tr")
    y = Locator(("a.b",))
    assert y.parse("name", "x_axb") == ("x_axb", None) and y.parse("name", "x_a.b") == ("x", "a.b")


def test_patched_attributes():
    x = Locator()
    have = {"standard_name": "sea_water_temperature_at_u_location", "units": "K"}
    assert x.patch(have, {"long_name": "Temperature", "units": "degC"}) == {"long_name": "Temperature at U location", "units": "K", "standard_name": have["standard_name"]}
    assert x.patch(have, {"units": "degC"}, "v", replace=True) == {"standard_name": "sea_water_temperature_at_v_location", "units": "degC"}


def test_added_location(spark):
    df = frame(spark, "temp", "sal", temp={"standard_name": "sea_water_temperature"})
    out = meta.MetaSpecs.default().add_loc(df, "temp", "u")
    assert out.columns == ["temp_u", "sal"] and out.schema["temp_u"].metadata["standard_name"] == "sea_water_temperature_at_u_location"
    assert meta.MetaSpecs.default().add_loc(out, "temp_u", None).schema["temp"].metadata["standard_name"] == "sea_water_temperature"


def test_errors_are_the_built_in_ones_too():
    from gyre import errors

    with pytest.raises(errors.MetaError) as e:
        meta.from_name("nowhere")
    assert isinstance(e.value, KeyError) and str(e.value) == "nowhere"
    with pytest.raises(errors.LocationError):
        Locator().format("name", "temp", "q")


def test_vocabulary():
    s = meta.MetaSpecs.default()
    assert len(s.items["data_vars"]) == 154 and len(s.items["coords"]) == 13
    assert s.items["coords"]["depth"].standard_names == s.items["data_vars"]["depth"].standard_names
    assert s.items["data_vars"]["speed"].units == ("m s-1",)


def test_decode_and_encode(spark):
    df = frame(spark, "nav_lon", "x1", "other", x1={"standard_name": "sea_water_temperature"})
    out = meta.MetaSpecs.default().decode(df)
    assert out.columns == ["lon", "temp", "other"]
    assert out.schema["lon"].metadata["units"] == "degrees_east" and out.schema["temp"].metadata["meta_specs"] == "default"
    own = meta.MetaSpecs.from_dict("own", {"data_vars": {"temp": {"name": "x1"}}, "coords": {"lon": {"name": "nav_lon"}}})
    assert own.encode(out).columns == ["nav_lon", "x1", "other"]


def test_second_claimant_keeps_its_name(spark):
    out = meta.MetaSpecs.default().decode(frame(spark, "longitude", "nav_lon"))
    assert out.columns == ["lon", "nav_lon"]


def test_search_and_locations(spark):
    s = meta.MetaSpecs.default()
    df = frame(spark, "u_u", "u_t", "lat")
    assert s.search(df, "u", loc="t") == "u_t" and s.search(df, "lat") == "lat" and s.search(df, "temp") is None
    with pytest.raises(KeyError):
        s.search(df, "u", errors="raise")
    assert s.reloc(df, u="v").columns == ["u_v", "u_t", "lat"]
    assert s.to_loc(frame(spark, "u", "lat"), u="t").columns == ["u_t", "lat"]


def test_scores_and_inference(spark):
    df = frame(spark, "kelvins", "swell", "east_west", "north_south", "hour_of_day", "floor")
    coord = {"lon": {"name": "east_west"}, "lat": {"name": "north_south"}, "time": {"name": "hour_of_day"}}
    make = lambda name, coords, data, **more: meta.MetaSpecs.from_dict(name, {"coords": coords, "data_vars": data}, **more)
    known = {
        "waves": make("waves", {}, {"hs": {"name": "swell"}}, attrs={"title": ["*buoy*"]}),
        "grid": make("grid", coord, {"bathy": {"name": "floor"}}),
        "heat": make("heat", {"lon": coord["lon"]}, {"temp": {"name": "kelvins"}}),
    }
    scores = {name: round(s.score(df), 6) for name, s in known.items()}
    assert scores == {"waves": round(100 / 6, 6), "grid": round(400 / 6, 6), "heat": round(200 / 6, 6)}
    assert known["grid"].score(df.select("kelvins")) == 0
    meta.reset()
    meta.register(*known.values())
    try:
        assert meta.infer(df).name == "grid"
        assert meta.infer(df, {"title": "Buoy 62001"}).name == "waves"
        assert [s.name for s in meta.registered()] == ["heat", "grid", "waves"]
    finally:
        meta.reset()
    with meta.set_specs(known["heat"]):
        assert meta.current() is known["heat"]
    assert meta.current().name == "default"


def test_grid_frame(spark):
    df = frame(spark, "time", "lat", "lon", "v")
    g = GridFrame(df, ("time", "lat", "lon"))
    assert g.order() == "tyx" and g.reorder("xt").dims == ("lat", "lon", "time")
    assert g.transpose(["lon", "z"], "insert").dims == ("time", "lat", "lon", "z")
    assert g.transpose(["z"], "resize", {"z": 3}).df.count() == 3
    with pytest.raises(ValueError):
        g.transpose(["z"])


def test_formula_terms():
    assert decode_formula_terms("s: sc_r C: Cs_r eta: zeta depth: h depth_c: hc") == {"s": "sc_r", "C": "Cs_r", "eta": "zeta", "depth": "h", "depth_c": "hc"}
    with pytest.raises(ValueError):
        decode_formula_terms("bad format here")
