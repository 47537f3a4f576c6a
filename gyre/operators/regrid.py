"""Interpolation along one axis: profiles regridded, extrapolated, averaged over cells, cut by iso-values.

A profile is the rows of one key. Its nodes are gathered into one sorted array in a single shuffle by key;
what follows are expressions on that array, so that targets are exploded after the shuffle, not before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.arrays import let

METHODS = ("nearest", "linear", "cubic", "hermit", "cellave")
EXTRAP = {"no": (), "top": ("top",), "bottom": ("bottom",), "both": ("top", "bottom")}
# Other names of the ways to extrapolate.
SYNONYMS = {
    "false": "no", "none": "no", "0": "no", "true": "both", "yes": "both", "all": "both", "2": "both", "above": "top", "after": "top", "1": "top",
    "below": "bottom", "before": "bottom", "-1": "bottom",
}


def extrap_sides(mode) -> tuple[str, ...]:
    """The sides that a way to extrapolate fills, by its name or another of its names."""
    name = str(mode).lower()
    name = SYNONYMS.get(name, name)
    if name not in EXTRAP:
        raise ValueError(f"no such way to extrapolate: {mode!r}")
    return EXTRAP[name]


def profiles(df: DataFrame, keys: list[str], y: str, v: str) -> DataFrame:
    """One row a profile: the keys and ``nodes``, an array of (y, v) by rising y; rows without y are dropped."""
    rows = df.where(F.col(y).isNotNull())
    pair = F.struct(F.col(y).cast("double").alias("y"), F.col(v).cast("double").alias("v"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("nodes"))


def usable(nodes: Column, drop_na: bool) -> Column:
    """Nodes from the first to the last valid one with their place ``i``, without missing ones inside if asked for."""
    placed = F.transform(nodes, lambda n, i: F.struct(n["y"].alias("y"), n["v"].alias("v"), i.alias("i")))

    def trim(n: Column) -> Column:
        ok = F.filter(n, lambda x: x["v"].isNotNull())
        if drop_na:
            return ok
        first, last = F.get(ok, F.lit(0))["i"], F.get(ok, F.size(ok) - 1)["i"]
        return F.when(F.size(ok) == 0, ok).otherwise(F.filter(n, lambda x: (x["i"] >= first) & (x["i"] <= last)))

    return let(placed, trim)


def value_at(nodes: Column, y: Column, method: str = "linear", extrap: str = "no", maxgap: int = 0, bias: float = 0.0, tension: float = 0.0) -> Column:
    """The interpolated value of usable nodes (y, v, i) at y.

    A place on a node belongs to the interval above it, at the last node to that below; a missing end of
    the interval gives a missing value. Outside of the nodes values are missing, or the first or last one.
    """
    if method not in METHODS[:4]:
        raise NotImplementedError(method)
    n = F.size(nodes)
    after = F.size(F.filter(nodes, lambda x: x["y"] <= y))
    last = F.get(nodes, n - 1)

    def inside(p: Column) -> Column:
        at = lambda k: F.get(nodes, k)
        a, b = at(p), at(p + 1)
        v0, v1 = a["v"], b["v"]
        d0, d1 = y - a["y"], b["y"] - y
        mu = d0 / (d0 + d1)
        if method == "nearest":
            out = F.when(d0 <= d1, v0).otherwise(v1)
        elif method == "linear":
            out = (v0 * d1 + v1 * d0) / (d0 + d1)
        else:
            vm = F.when(p == 0, 2 * v0 - v1).otherwise(F.coalesce(at(p - 1)["v"], v0))
            vp = F.when(p + 2 >= n, 2 * v1 - v0).otherwise(F.coalesce(at(p + 2)["v"], v1))
            if method == "cubic":
                c = vp - v1 - vm + v0
                out = c * mu * mu * mu + (vm - v0 - c) * mu * mu + (v1 - vm) * mu + v0
            else:
                up, down = (1 + bias) * (1 - tension) / 2, (1 - bias) * (1 - tension) / 2
                m0 = (v0 - vm) * up + (v1 - v0) * down
                m1 = (v1 - v0) * up + (vp - v1) * down
                mu2, mu3 = mu * mu, mu * mu * mu
                out = (2 * mu3 - 3 * mu2 + 1) * v0 + (mu3 - 2 * mu2 + mu) * m0 + (mu3 - mu2) * m1 + (3 * mu2 - 2 * mu3) * v1
        if maxgap > 0:
            out = F.when(b["i"] - a["i"] - 1 <= maxgap, out)
        return out

    body = F.when((after > 0) & (y <= last["y"]) & (n > 1), let(F.least(after, n - 1) - 1, inside))
    if "bottom" in extrap_sides(extrap):
        body = F.when((n > 0) & (y < F.get(nodes, F.lit(0))["y"]), F.get(F.filter(nodes, lambda x: x["v"].isNotNull()), F.lit(0))["v"]).otherwise(body)
    if "top" in extrap_sides(extrap):
        body = F.when((n > 0) & (y > last["y"]), last["v"]).otherwise(body)
    return body


def regrid1d(
    df: DataFrame, keys: list[str], y: str, v: str, targets: list[float] | Column, method: str = "linear", extrap: str = "no",
    drop_na: bool = False, maxgap: int = 0, bias: float = 0.0, tension: float = 0.0,
) -> DataFrame:
    """Profiles at the target coordinates: keys, y, v. ``targets`` are numbers, or an array column of the keys."""
    to = F.array(*[F.lit(float(t)) for t in targets]) if isinstance(targets, list) else targets
    rows = profiles(df, keys, y, v).withColumn("_n", usable(F.col("nodes"), drop_na)).withColumn("_y", F.explode(to))
    return rows.select(*keys, F.col("_y").alias(y), value_at(F.col("_n"), F.col("_y"), method, extrap, maxgap, bias, tension).alias(v))


def regrid1d_nd(
    data: DataFrame, source: DataFrame, target: DataFrame, dims: list[str], z: str, z_out: str, y: str, v: str, method: str = "linear", extrap: str = "no", drop_na: bool = False, **options,
) -> DataFrame:
    """Profiles of ``data`` on levels whose coordinates may change along other dimensions: all dimensions, z_out, y, v.

    ``data`` has the values v along z, ``source`` the coordinates y of the same levels, ``target`` those of the levels
    z_out to go to. Each has those of ``dims`` along which it changes; along the others it is the same. A profile meets
    its target levels, which are the levels of a grid, as one array.
    """
    has = {n: [d for d in dims if d in f.columns] for n, f in (("data", data), ("source", source), ("target", target))}
    both = [d for d in dims if d in has["data"] or d in has["source"]]
    shared = [d for d in has["data"] if d in has["source"]]
    rows = data.select(*has["data"], z, F.col(v).cast("double").alias("_v")).join(source.select(*has["source"], z, F.col(y).cast("double").alias("_y")), [*shared, z])
    nodes = profiles(rows, both, "_y", "_v").withColumn("_one", F.lit(1))
    levels = target.groupBy(*has["target"]).agg(F.collect_list(F.struct(F.col(z_out).alias("z"), F.col(y).cast("double").alias("y"))).alias("_to")).withColumn("_one", F.lit(1))
    met = nodes.join(levels, [*(d for d in both if d in has["target"]), "_one"])
    met = met.withColumn("_n", usable(F.col("nodes"), drop_na)).withColumn("_at", F.explode("_to"))
    every = [d for d in dims if d in both or d in has["target"]]
    value = value_at(F.col("_n"), F.col("_at.y"), method, extrap, **options)
    return met.select(*every, F.col("_at.z").alias(z_out), F.col("_at.y").alias(y), value.alias(v))


def extrap1d(df: DataFrame, keys: list[str], order: str, v: str, mode: str = "both") -> DataFrame:
    """Carry the first and last valid values outward; gaps inside stay."""
    w = Window.partitionBy(*keys)
    full = w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ok = F.when(F.col(v).isNotNull(), F.col(order))
    first, last = F.min(ok).over(w), F.max(ok).over(w)
    out = F.col(v)
    if "bottom" in extrap_sides(mode):
        out = F.when(F.col(order) < first, F.first(v, ignorenulls=True).over(full)).otherwise(out)
    if "top" in extrap_sides(mode):
        out = F.when(F.col(order) > last, F.last(v, ignorenulls=True).over(full)).otherwise(out)
    return df.withColumn(v, out)


def cellave1d(df: DataFrame, keys: list[str], lo: str, hi: str, v: str, edges: list[float], conserv: bool = False, extrap: str = "no") -> DataFrame:
    """Means of cells over the cells between ``edges``, weighted by overlap: keys, cell, v.

    ``conserv`` divides the overlaps by the width of the output cell instead, which keeps the sum of value
    times width. The output cells are a literal array: each input row explodes to those it overlaps only.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    rows = df
    if extrap_sides(extrap):
        w = Window.partitionBy(*keys)
        low, high = F.min(lo).over(w), F.max(hi).over(w)
        if "bottom" in extrap_sides(extrap):
            rows = rows.withColumn(lo, F.when(F.col(lo) == low, F.least(F.col(lo), F.lit(float(edges[0])))).otherwise(F.col(lo)))
        if "top" in extrap_sides(extrap):
            rows = rows.withColumn(hi, F.when(F.col(hi) == high, F.greatest(F.col(hi), F.lit(float(edges[-1])))).otherwise(F.col(hi)))
    rows = rows.where(F.col(v).isNotNull()).withColumn("_c", F.explode(F.filter(cells, lambda c: (F.col(hi) > c["a"]) & (F.col(lo) < c["b"]))))
    w = F.least(F.col(hi), F.col("_c.b")) - F.greatest(F.col(lo), F.col("_c.a"))
    grouped = rows.groupBy(*keys, F.col("_c.cell").alias("cell"))
    if conserv:
        return grouped.agg(F.sum(F.col(v) * w / (F.col("_c.b") - F.col("_c.a"))).alias(v))
    return grouped.agg((F.sum(F.col(v) * w) / F.sum(w)).alias(v))


def isoslice(df: DataFrame, keys: list[str], order: str, var: str, values: str, isoval: float | Column, reverse: bool = False, flat_var: bool = False) -> DataFrame:
    """``var`` where ``values`` crosses ``isoval``: the last crossing by rising order, or in reverse the first.

    Where two neighbours both equal the iso-value the result is that value, or with ``flat_var`` that of ``var``.
    """
    iso = isoval if isinstance(isoval, Column) else F.lit(float(isoval))
    w = Window.partitionBy(*keys).orderBy(order)
    v0, v1, x0, x1 = F.col(values), F.lead(values).over(w), F.col(var), F.lead(var).over(w)
    rows = df.select(*keys, F.col(order).alias("_o"), v0.alias("_v0"), v1.alias("_v1"), x0.alias("_x0"), x1.alias("_x1"), iso.alias("_iso"))
    hit = ((F.col("_v0") >= F.col("_iso")) & (F.col("_v1") <= F.col("_iso"))) | ((F.col("_v0") <= F.col("_iso")) & (F.col("_v1") >= F.col("_iso")))
    sloped = F.col("_x1") + (F.col("_iso") - F.col("_v1")) * (F.col("_x0") - F.col("_x1")) / (F.col("_v0") - F.col("_v1"))
    res = F.when(F.col("_v0") == F.col("_v1"), F.col("_x0") if flat_var else F.col("_v0")).otherwise(sloped)
    crossed = rows.withColumn("_r", F.when(hit, res)).withColumn("_at", F.when(hit, F.col("_o")))
    pick = F.min_by if reverse else F.max_by
    return crossed.groupBy(*keys).agg(pick("_r", "_at").alias(var))
