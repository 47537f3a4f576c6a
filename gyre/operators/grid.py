"""Operations on the indices of a grid: centres, edges, padding, shifts, differences, layers to depths, stacking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(keys: list[str], dim: str):
    return Window.partitionBy(*keys).orderBy(dim)


def centers(df: DataFrame, keys: list[str], dim: str, cols: list[str]) -> DataFrame:
    """Means of neighbours along a dimension, one fewer than the rows; the index is that of the first."""
    w = _along(keys, dim)
    rows = df.select(*keys, dim, *[(F.col(c) + (F.lead(c).over(w) - F.col(c)) / 2).alias(c) for c in cols], F.lead(F.lit(1)).over(w).alias("_more"))
    return rows.where("_more = 1").drop("_more")


def diff(df: DataFrame, keys: list[str], dim: str, cols: list[str], coords: list[str] = ()) -> DataFrame:
    """First differences along a dimension; coordinates go to the centres."""
    w = _along(keys, dim)
    out = [(F.lead(c).over(w) - F.col(c)).alias(c) for c in cols] + [(F.col(c) + (F.lead(c).over(w) - F.col(c)) / 2).alias(c) for c in coords]
    return df.select(*keys, dim, *out, F.lead(F.lit(1)).over(w).alias("_more")).where("_more = 1").drop("_more")


def reverse(df: DataFrame, keys: list[str], dim: str) -> DataFrame:
    """The rows of each key in the opposite order: index and values meet again from the other end."""
    every = Window.partitionBy(*keys)
    turned = F.min(dim).over(every) + F.max(dim).over(every) - F.col(dim)
    return df.withColumn(dim, turned.cast(df.schema[dim].dataType))


def sort(df: DataFrame, keys: list[str], dim: str, coord: str, ascending: bool = True) -> DataFrame:
    """The index anew, from the least one of each key on, by a coordinate; equal coordinates stay in their order, missing ones come last."""
    by = F.col(coord).asc_nulls_last() if ascending else F.col(coord).desc_nulls_last()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(by, dim)) - 1 + F.min(dim).over(Window.partitionBy(*keys))
    return df.withColumn(dim, place.cast(df.schema[dim].dataType))


def concat(slabs: list[DataFrame], dim: str, start: int = 0) -> DataFrame:
    """Slabs one after the other along a dimension, from ``start`` on; each brings its own range of indices, gaps and all.

    Columns go by name, and those that a slab lacks are missing in it. A slab without rows takes no room. No data is shuffled.
    """
    out, at = None, start
    for slab in slabs:
        low, high = slab.agg(F.min(dim), F.max(dim)).first()
        if low is None:
            low, high = 0, -1
        moved = slab.withColumn(dim, (F.col(dim) - F.lit(low) + F.lit(at)).cast(slab.schema[dim].dataType))
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        at += high - low + 1
    if out is None:
        raise ValueError("no slabs")
    return out


#: Of a row at place i of n, the places before and after the dimension that take its values.
MIRRORS = {
    "reflect": lambda i, n: (-i, 2 * (n - 1) - i),
    "symmetric": lambda i, n: (-1 - i, 2 * n - 1 - i),
    "wrap": lambda i, n: (i - n, i + n),
}


def _mirrored(df: DataFrame, keys: list[str], dim: str, cols: list[str], before: int, after: int, mode: str) -> DataFrame:
    every = Window.partitionBy(*keys)
    rows = df.withColumn("_i", (F.row_number().over(_along(keys, dim)) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(every))
    low, high = MIRRORS[mode](F.col("_i"), F.col("_n"))
    takes = F.array(F.col("_i"), F.when((low < 0) & (low >= -before), low), F.when((high >= F.col("_n")) & (high < F.col("_n") + after), high))
    rows = rows.withColumn("_to", F.explode(F.array_compact(takes)))
    return rows.select(*keys, (F.col(dim) + F.col("_to") - F.col("_i")).cast(df.schema[dim].dataType).alias(dim), *cols)


def pad(df: DataFrame, keys: list[str], dim: str, cols: list[str], before: int = 0, after: int = 0, mode: str = "edge", coords: list[str] = (), coord_mode: str = "extrap", constant: float | None = None) -> DataFrame:
    """Add rows at the ends of a dimension: edge values, a constant, a linear continuation (``extrap``), rows
    mirrored at the end row (``reflect``) or behind it (``symmetric``), or those of the other end (``wrap``).

    Each row explodes to itself and the new rows that it gives its values to, so that the only shuffle is that of
    the keys. Mirrored and wrapped widths are those of the dimension at most.
    """
    if mode in MIRRORS:
        given = _mirrored(df, keys, dim, cols, before, after, mode)
        if not coords:
            return given
        placed = pad(df, keys, dim, [], before, after, "edge", coords, coord_mode)
        return given.join(placed, [*keys, dim]).select(*keys, dim, *cols, *coords)
    w = _along(keys, dim)
    wd = Window.partitionBy(*keys).orderBy(F.col(dim).desc())
    rows = df.withColumn("_f", F.row_number().over(w) == 1).withColumn("_l", F.row_number().over(wd) == 1)
    for c in [*cols, *coords]:
        rows = rows.withColumn(f"_d_{c}", F.when(F.col("_f"), F.lead(c).over(w) - F.col(c)).otherwise(F.col(c) - F.lag(c).over(w)))
        rows = rows.withColumn(f"_e_{c}", F.coalesce(F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c)))
    low = F.when(F.col("_f"), F.lit(-before)).otherwise(F.lit(0))
    high = F.when(F.col("_l"), F.lit(after)).otherwise(F.lit(0))
    rows = rows.withColumn("_k", F.explode(F.sequence(low, high)))

    def moved(c: str, how: str):
        if how == "extrap":
            return F.when(F.col("_k") < 0, F.col(c) + F.col("_k") * F.col(f"_d_{c}")).when(F.col("_k") > 0, F.col(c) + F.col("_k") * F.col(f"_e_{c}")).otherwise(F.col(c))
        if how == "constant":
            return F.when(F.col("_k") != 0, F.lit(constant)).otherwise(F.col(c))
        return F.col(c)

    return rows.select(
        *keys, (F.col(dim) + F.col("_k")).alias(dim), *[moved(c, mode).alias(c) for c in cols], *[moved(c, coord_mode).alias(c) for c in coords]
    )


def edges(df: DataFrame, keys: list[str], dim: str, cols: list[str], coords: list[str] = ()) -> DataFrame:
    """Values at the edges between rows and at both ends, one more than the rows."""
    return centers(pad(df, keys, dim, cols, 1, 1, "edge", coords), keys, dim, [*cols, *coords])


def shift(df: DataFrame, keys: list[str], dim: str, cols: list[str], direction: str = "right", coords: list[str] = ()) -> DataFrame:
    """Move by half a cell: the mean with the neighbour on that side, the end padded; as many rows as before."""
    right = direction in ("right", "top", "front", "up")
    out = centers(pad(df, keys, dim, cols, 0 if right else 1, 1 if right else 0, "edge", coords), keys, dim, [*cols, *coords])
    return out if right else out.withColumn(dim, F.col(dim) + 1)


def _referred(depth: Column, positive: str, ref: str | None, ref_type: str) -> Column:
    """The depth at a sum of thicknesses, with the total of its profile in ``_total``."""
    if ref_type == "infer":
        ref_type = {"bathy": "bottom", "ssh": "top"}.get(ref or "", "top" if positive == "down" else "bottom")
    if positive == "up":
        return depth - (F.col("_total") if ref is None else F.col("_total") - F.col(ref) if ref_type == "top" else F.col(ref))
    if ref is not None:
        return (depth - F.col("_total") if ref_type == "bottom" else depth) + F.col(ref)
    return depth


def layer_centres(df: DataFrame, keys: list[str], order: str, dz: str, positive: str = "down", ref: str | None = None, ref_type: str = "infer", name: str = "depth") -> DataFrame:
    """Add the depths of the centres of layers, as ``dz2depth`` has them; one shuffle, all columns stay."""
    rows = df.withColumn("_sum", F.sum(dz).over(_along(keys, order))).withColumn("_total", F.sum(dz).over(Window.partitionBy(*keys)))
    centre = F.col("_sum") - F.coalesce(F.col(dz), F.lit(0.0)) / 2
    return rows.withColumn(name, _referred(centre, positive, ref, ref_type)).drop("_sum", "_total")


def dz2depth(df: DataFrame, keys: list[str], order: str, dz: str, positive: str = "down", ref: str | None = None, ref_type: str = "infer", centered: bool = False) -> DataFrame:
    """Depths of the edges of layers from their thicknesses, or of their centres: keys, order, depth.

    Thicknesses are summed from the first row, with a row of 0 before it. ``positive`` up: the reference (the
    total by default, or the total less a ``top`` reference) is taken off. Down: a ``bottom`` reference
    takes the total off, then the reference column is added.
    """
    if centered:
        return layer_centres(df, keys, order, dz, positive, ref, ref_type, "depth").select(*keys, order, "depth")
    w = _along(keys, order)
    total = F.sum(dz).over(Window.partitionBy(*keys))
    rows = df.withColumn("_sum", F.sum(dz).over(w)).withColumn("_total", total).withColumn("_first", F.row_number().over(w) == 1)
    sums = F.when(F.col("_first"), F.array(F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("s")), F.struct(F.lit(0).alias("k"), F.col("_sum").alias("s")))).otherwise(
        F.array(F.struct(F.lit(0).alias("k"), F.col("_sum").alias("s")))
    )
    rows = rows.withColumn("_p", F.explode(sums))
    return rows.select(*keys, (F.col(order) + F.col("_p.k")).alias(order), _referred(F.col("_p.s"), positive, ref, ref_type).alias("depth"))


def to_rect(df: DataFrame, ydim: str, xdim: str, lon: str = "lon", lat: str = "lat", tol: float = 1e-5) -> tuple[DataFrame, DataFrame] | None:
    """The axes (xdim, lon) and (ydim, lat) of a grid whose longitudes and latitudes do not change along the other dimension; else None."""
    axes = []
    for dim, c in ((xdim, lon), (ydim, lat)):
        axis = df.groupBy(dim).agg(F.min(c).alias("_a"), F.max(c).alias("_b"))
        if not axis.where(F.col("_b") - F.col("_a") > tol).isEmpty():
            return None
        axes.append(axis.select(dim, F.col("_a").alias(c)))
    return axes[0], axes[1]


def geo_stack(df: DataFrame, ydim: str, xdim: str, nx: int, name: str = "npts") -> DataFrame:
    """One dimension of points in place of two: index y * nx + x."""
    return df.withColumn(name, F.col(ydim) * nx + F.col(xdim)).drop(ydim, xdim)


def apply_along_dim(df: DataFrame, func, keys: list[str], dim: str, data: list[str], coords: list[str] = (), coord_func=None) -> DataFrame:
    """Apply column functions of (column, window) to data and coordinates along a dimension, in one select."""
    w = _along(keys, dim)
    coord_func = coord_func or func
    return df.select(*keys, dim, *[func(F.col(c), w).alias(c) for c in data], *[coord_func(F.col(c), w).alias(c) for c in coords])
