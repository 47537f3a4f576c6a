"""Coordinates and dimensions of a grid frame by what they mean.

All of it looks at names and metadata; only depths that have to be computed add an expression, and no
function here runs a job.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from gyre.errors import CoordsError
from gyre.gridframe import GridFrame
from gyre.meta import specs as meta
from gyre.operators.grid import layer_centres

#: Generic names of the coordinates that place a cell, and of those that make a vertical one, the first found counting.
PLACES = ("lon", "lat", "depth", "altitude", "level", "time")
VERTICAL = ("depth", "altitude")


def find_coord(frame: GridFrame, generic: str, errors: str = "raise") -> str | None:
    """The column that is the coordinate; with ``errors="ignore"`` None where there is none."""
    found = meta.infer(frame.df).search(frame.df, generic, "coords")
    if found is None and errors == "raise":
        raise CoordsError(f"no column is {generic}")
    return found


def get_lon(frame: GridFrame, errors: str = "raise") -> str | None:
    return find_coord(frame, "lon", errors)


def get_lat(frame: GridFrame, errors: str = "raise") -> str | None:
    return find_coord(frame, "lat", errors)


def get_time(frame: GridFrame, errors: str = "raise") -> str | None:
    return find_coord(frame, "time", errors)


def get_altitude(frame: GridFrame, errors: str = "raise") -> str | None:
    return find_coord(frame, "altitude", errors)


def get_level(frame: GridFrame, errors: str = "raise") -> str | None:
    return find_coord(frame, "level", errors)


def get_vertical(frame: GridFrame, errors: str = "raise") -> str | None:
    """The depth, or else the altitude."""
    found = next((c for g in VERTICAL if (c := find_coord(frame, g, "ignore"))), None)
    if found is None and errors == "raise":
        raise CoordsError("no column is a depth or an altitude")
    return found


def get_depth(frame: GridFrame, errors: str = "raise", kind: str | None = None, name: str = "depth") -> tuple[GridFrame, str | None]:
    """The frame with a depth, and the depth's column: a column that is one, else terrain-following levels
    decoded, else thicknesses summed up. ``kind`` ("z", "sigma", "dz") allows one of these ways only.
    """
    found = find_coord(frame, "depth", "ignore")
    if found and kind in (None, "z"):
        return frame, found
    if kind in (None, "sigma"):
        decoded = frame.decode_sigma(name)
        if decoded is not frame:
            return decoded, name
    thickness = meta.infer(frame.df).search(frame.df, "dz", "data_vars")
    if thickness and kind in (None, "dz"):
        return decode_dz2depth(frame, name=name), name
    if errors == "raise":
        raise CoordsError("no column is a depth, a level with formula terms, or a thickness")
    return frame, None


def decode_dz2depth(frame: GridFrame, positive: str | None = None, name: str = "depth") -> GridFrame:
    """Add the depths of the centres of layers, from thicknesses and where they are there the sea level and the bathymetry."""
    s = meta.infer(frame.df)
    thickness, zdim = s.search(frame.df, "dz", "data_vars", errors="raise"), get_dim(frame, "z")
    positive = positive or s.positive
    # The surface gives the reference of layers counted from it, the floor that of layers counted from below.
    refs = [r for r in (("ssh", "bathy") if positive == "up" else ("bathy", "ssh")) if s.search(frame.df, r, "data_vars")]
    keys, rest = [d for d in frame.dims if d != zdim], [c for c in frame.df.columns if c not in (*frame.dims, name)]
    ref = s.search(frame.df, refs[0], "data_vars") if refs else None
    kind = {"bathy": "bottom", "ssh": "top"}[refs[0]] if refs else "infer"
    # The centre of a layer stands in the layer's own row.
    df = layer_centres(frame.df, keys, zdim, thickness, positive, ref, kind, name)
    df = df.select(*frame.dims, *rest, F.col(name).alias(name, metadata={"units": "m", "positive": positive}))
    return replace(frame, df=df, coords=(*frame.coords, name))


def is_coord(field: StructField, generic: str) -> bool:
    """Whether a field is the coordinate."""
    s = meta.current()
    return s.match_item(field, s.items["coords"][generic], "coords")


def is_lon(field: StructField) -> bool:
    return is_coord(field, "lon")


def is_lat(field: StructField) -> bool:
    return is_coord(field, "lat")


def is_depth(field: StructField) -> bool:
    return is_coord(field, "depth")


def is_altitude(field: StructField) -> bool:
    return is_coord(field, "altitude")


def is_level(field: StructField) -> bool:
    return is_coord(field, "level")


def is_time(field: StructField) -> bool:
    return is_coord(field, "time")


def get_meta_coords(frame: GridFrame, names: tuple[str, ...] = PLACES, errors: str = "ignore") -> dict[str, str]:
    """The columns of several coordinates by generic name."""
    return {g: c for g in names if (c := find_coord(frame, g, errors))}


def get_dim(frame: GridFrame, kind: str, errors: str = "raise") -> str | None:
    """The dimension of a type (x, y, z, t or f): by the types given, its own name and attributes, then coordinates along it alone."""
    order = frame.order()
    if kind in order:
        return frame.dims[order.index(kind)]
    s = meta.infer(frame.df)
    for c in frame.coords:
        along = frame.along(c)
        if len(along) == 1 and s.axis_of(frame.df.schema[c]) == kind:
            return along[0]
    if errors == "raise":
        raise CoordsError(f"no dimension of type {kind}")
    return None


def get_meta_dims(frame: GridFrame, kinds: str, positional: bool = False, errors: str = "raise") -> list[str | None]:
    """The dimensions of several types; ``positional`` takes the last ones in that order where some are unknown."""
    found = [get_dim(frame, k, "ignore") for k in kinds]
    if None in found and positional and len(frame.dims) >= len(kinds):
        return list(frame.dims[-len(kinds) :])
    if None in found and errors == "raise":
        raise CoordsError(f"no dimension of type {kinds[found.index(None)]}")
    return found


def get_xdim(frame: GridFrame, errors: str = "raise") -> str | None:
    return get_dim(frame, "x", errors)


def get_ydim(frame: GridFrame, errors: str = "raise") -> str | None:
    return get_dim(frame, "y", errors)


def get_zdim(frame: GridFrame, errors: str = "raise") -> str | None:
    return get_dim(frame, "z", errors)


def get_tdim(frame: GridFrame, errors: str = "raise") -> str | None:
    return get_dim(frame, "t", errors)


def get_fdim(frame: GridFrame, errors: str = "raise") -> str | None:
    return get_dim(frame, "f", errors)


def coords_compat_with_dims(frame: GridFrame, include: tuple[str, ...] | None = None, exclude: tuple[str, ...] = ()) -> list[str]:
    """Coordinates that vary along none but the dimensions in ``include``, and along none of those in ``exclude``."""
    allowed = set(frame.dims if include is None else include)
    return [c for c in frame.coords if set(frame.along(c)) <= allowed and not set(frame.along(c)) & set(exclude)]


def binding_data_vars(frame: GridFrame, coord: str) -> list[str]:
    """Data columns that vary along all dimensions of a coordinate."""
    return [v for v in frame.data_vars if set(frame.along(coord)) <= set(frame.along(v))]


def change_index(frame: GridFrame, dim: str, values: list, name: str | None = None) -> GridFrame:
    """Give a dimension's rows other values, the first to index 0, in the coordinate of the dimension's name or in ``name``."""
    name = name or f"{dim}_value"
    df = frame.df.withColumn(name, F.get(F.array(*[F.lit(x) for x in values]), F.col(dim).cast("int")))
    coords = frame.coords if name in frame.coords else (*frame.coords, name)
    return replace(frame, df=df, coords=coords, spans={**frame.spans, name: (dim,)})


def drop_dim_coords(frame: GridFrame, dim: str) -> GridFrame:
    """Without the coordinates that vary along a dimension."""
    return frame.drop_dim_coords([c for c in frame.coords if dim in frame.along(c)])


def positive_attr(frame: GridFrame, column: str | None = None) -> str | None:
    """"up" or "down": that of the column, else of any vertical coordinate, else of the specifications."""
    s = meta.infer(frame.df)
    fields = [frame.df.schema[column]] if column else [f for f in frame.df.schema.fields if s.axis_of(f) == "z"]
    found = next((f.metadata["positive"].lower() for f in fields if (f.metadata or {}).get("positive")), None)
    return found or s.positive


# Indices.


def axis_slices(axis: str, n: int, first: int = 0, last: int | None = None) -> dict[str, Column]:
    """Conditions on the index of an axis of ``n`` rows: all, first, last, all but one end or both."""
    i, last = F.col(axis), n - 1 if last is None else last
    return {
        "all": (i >= first) & (i <= last), "first": i == first, "last": i == last, "firsts": (i >= first) & (i < last),
        "lasts": (i > first) & (i <= last), "mid": (i > first) & (i < last),
    }


def iminmax(df: DataFrame, keys: list[str], order: str, v: str) -> DataFrame:
    """The first and last index with a valid value: keys, imin, imax; missing where there is none."""
    at = F.when(F.col(v).isNotNull(), F.col(order))
    return df.groupBy(*keys).agg(F.min(at).alias("imin"), F.max(at).alias("imax"))


def ravel_index(indices: list[Column | str], shape: list[int]) -> Column:
    """The place in row-major order of the cell with these indices."""
    out = F.lit(0).cast("long")
    for i, n in zip(indices, shape):
        out = out * n + (F.col(i) if isinstance(i, str) else i)
    return out


def unravel_index(place: Column | str, shape: list[int]) -> list[Column]:
    """The indices of the cell at a place in row-major order."""
    left, out = F.col(place) if isinstance(place, str) else place, []
    for n in reversed(shape):
        out.append(F.pmod(left, F.lit(n)))
        left = F.floor(left / n)
    return out[::-1]


# Aggregates over dimensions.


def mask_counts(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Missing values by key: keys, masked, total, any_masked."""
    gone = F.col(v).isNull()
    return df.groupBy(*keys).agg(F.sum(gone.cast("long")).alias("masked"), F.count(F.lit(1)).alias("total"), F.max(gone).alias("any_masked"))


def reduce_mean(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Mean over all other dimensions: keys, v."""
    return df.groupBy(*keys).agg(F.avg(v).alias(v))


def reduce_std(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Population standard deviation over all other dimensions, such as the members of an ensemble: keys, v."""
    return df.groupBy(*keys).agg(F.stddev_pop(v).alias(v))


def rate_of_change(df: DataFrame, keys: list[str], time: str, cols: list[str]) -> DataFrame:
    """Change a second along time, between both neighbours, at the ends between the row and its one neighbour."""
    w = Window.partitionBy(*keys).orderBy(time)
    at = lambda c, k: F.coalesce(F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w), c)
    micros = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = df.withColumn("_t", micros)
    first, last = F.lag("_t").over(w).isNull(), F.lead("_t").over(w).isNull()

    def slope(c: str) -> Column:
        x = F.col(c)
        after, before = F.when(last, x).otherwise(F.lead(c).over(w)), F.when(first, x).otherwise(F.lag(c).over(w))
        span = at(F.col("_t"), 1) - at(F.col("_t"), -1)
        return F.when(span > 0, (after - before) / span)

    return rows.select(*keys, time, *[slope(c).alias(c) for c in cols])
