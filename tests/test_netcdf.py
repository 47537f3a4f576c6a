"""NetCDF classic files written here, byte by byte, and read as tables."""

import struct

import numpy as np
import pytest

from gyre.gridframe import GridFrame
from gyre.sources.netcdf import open_netcdf
from gyre.sources.samples import open_sample

CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "u1": 7, "u2": 8, "u4": 9, "i8": 10, "u8": 11}


def write(path, version, dims, variables, records=0):
    """``dims``: name to size, 0 for records; ``variables``: name to (dims, array, attributes)."""
    size = (lambda n: struct.pack(">q", n)) if version == 5 else (lambda n: struct.pack(">i", n))
    offset = (lambda n: struct.pack(">i", n)) if version == 1 else (lambda n: struct.pack(">q", n))
    padded = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: size(len(s.encode())) + padded(s.encode())
    names = list(dims)

    def attributes(a):
        if not a:
            return struct.pack(">i", 0) + size(0)
        out = struct.pack(">i", 12) + size(len(a))
        for k, v in a.items():
            v = np.frombuffer(v.encode(), "S1") if isinstance(v, str) else np.atleast_1d(v)
            out += name(k) + struct.pack(">i", CODES[v.dtype.str[1:]]) + size(len(v)) + padded(v.astype(v.dtype.newbyteorder(">")).tobytes())
        return out

    def header(begins):
        out = b"CDF" + bytes([version]) + size(records) + struct.pack(">i", 10) + size(len(dims))
        out += b"".join(name(n) + size(k) for n, k in dims.items()) + attributes({"title": "test"})
        out += struct.pack(">i", 11) + size(len(variables))
        for (n, (d, x, a)), begin in zip(variables.items(), begins):
            out += name(n) + size(len(d)) + b"".join(size(names.index(i)) for i in d) + attributes(a)
            out += struct.pack(">i", CODES[x.dtype.str[1:]]) + size(0) + offset(begin)
        return out

    raw = lambda x: np.asarray(x).astype(np.asarray(x).dtype.newbyteorder(">")).tobytes()
    rec = {n: bool(d) and dims[d[0]] == 0 for n, (d, _, _) in variables.items()}
    at, begins, body = len(header([0] * len(variables))), {}, b""
    for n, (_, x, _) in variables.items():
        if not rec[n]:
            begins[n], body = at + len(body), body + padded(raw(x))
    alone = sum(rec.values()) == 1
    pieces = {n: [raw(r) if alone else padded(raw(r)) for r in variables[n][1]] for n in variables if rec[n]}
    for n, p in pieces.items():
        begins[n] = at + len(body) + sum(len(q[0]) for m, q in pieces.items() if list(pieces).index(m) < list(pieces).index(n))
    body += b"".join(p[r] for r in range(records) for p in pieces.values())
    path.write_bytes(header([begins[n] for n in variables]) + body)


def sample(version):
    rnd = np.random.default_rng(version)
    temp = rnd.normal(size=(3, 4, 5)).astype("f4")
    temp[1, 2, 3], temp[0, 0, 0] = -999, np.nan
    packed = rnd.integers(-100, 100, (4, 5)).astype("i2")
    packed[1, 1] = -32768
    return {
        "lat": (["y"], np.linspace(40, 43, 4), {"standard_name": "latitude", "units": "degrees_north"}),
        "lon": (["x"], np.arange(5, dtype="f4"), {"standard_name": "longitude"}),
        "temp": (["time", "y", "x"], temp, {"standard_name": "sea_water_temperature", "_FillValue": np.float32(-999)}),
        "time": (["time"], np.array([0, 6, 12], "i4"), {"units": "hours since 2000-01-01"}),
        "mask": (["time", "y"], rnd.integers(0, 2, (3, 4)).astype("i1"), {}),
        "depth": (["y", "x"], packed, {"scale_factor": 0.5, "add_offset": 10.0, "_FillValue": np.int16(-32768)}),
        "label": (["y"], np.array([b"a", b"b", b"c", b"d"], "S1"), {}),
        "scalar": ([], np.array(7, "i4"), {}),
    }


@pytest.mark.parametrize("version, time", [(1, 0), (2, 3), (5, 0), (1, 3)])
def test_round_trip(spark, tmp_path, version, time):
    variables = sample(version)
    write(tmp_path / "a.nc", version, {"time": time, "y": 4, "x": 5}, variables, 3 if time == 0 else 0)
    df = open_netcdf(spark, str(tmp_path / "a.nc"), cells=7)
    assert df.columns == ["i_time", "i_y", "i_x", "lat", "lon", "temp", "time", "mask", "depth", "scalar"] and df.rdd.getNumPartitions() == 9
    rows = df.collect()
    assert sorted((r.i_time, r.i_y, r.i_x) for r in rows) == [k for k in np.ndindex(3, 4, 5)]
    lat, lon, temp, when, mask, packed = (variables[n][1] for n in ("lat", "lon", "temp", "time", "mask", "depth"))
    for r in rows:
        k = (r.i_time, r.i_y, r.i_x)
        assert (r.lat, r.lon, r.time, r.mask, r.scalar) == (lat[k[1]], lon[k[2]], when[k[0]], mask[k[:2]], 7)
        assert r.temp == (None if k in ((1, 2, 3), (0, 0, 0)) else temp[k])
        assert r.depth == (None if k[1:] == (1, 1) else packed[k[1:]] * 0.5 + 10)
    assert df.schema["temp"].metadata["standard_name"] == "sea_water_temperature"
    frame = GridFrame(df, ("i_time", "i_y", "i_x")).infer_coords()
    assert frame.get("temp") == "temp" and {"lat", "lon"} <= set(frame.coords)


def test_variables_and_ranges(spark, tmp_path):
    variables = sample(1)
    for n in "ab":
        write(tmp_path / f"{n}.nc", 1, {"time": 0, "y": 4, "x": 5}, variables, 3)
    df = open_netcdf(spark, str(tmp_path / "*.nc"), ["temp"], {"time": (1, 3), "x": (2, 4)})
    rows = df.collect()
    assert df.columns == ["i_time", "i_y", "i_x", "temp"] and len(rows) == 2 * 2 * 4 * 2
    assert all(r.temp == variables["temp"][1][r.i_time, r.i_y, r.i_x] for r in rows if (r.i_time, r.i_y, r.i_x) != (1, 2, 3))
    assert open_sample(spark, str(tmp_path / "a.nc"), columns=["lat"]).distinct().count() == 4
    assert open_netcdf(spark, str(tmp_path / "a.nc"), ["temp"], {"time": (2, 2)}).count() == 0


def test_one_record_variable_and_other_files(spark, tmp_path):
    write(tmp_path / "one.nc", 1, {"t": 0, "x": 3}, {"v": (["t", "x"], np.arange(15, dtype="i2").reshape(5, 3), {})}, 5)
    assert sorted((r.i_t, r.i_x, r.v) for r in open_netcdf(spark, str(tmp_path / "one.nc")).collect()) == [(i, j, 3 * i + j) for i in range(5) for j in range(3)]
    write(tmp_path / "none.nc", 2, {"t": 0}, {"v": (["t"], np.zeros(0), {})}, 0)
    assert open_netcdf(spark, str(tmp_path / "none.nc")).count() == 0
    (tmp_path / "x.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(Exception, match="not a NetCDF classic file"):
        open_netcdf(spark, str(tmp_path / "x.nc"))
    with pytest.raises(Exception, match="no such variables"):
        open_netcdf(spark, str(tmp_path / "one.nc"), ["w"])
