"""Interpolation of gridded values to scattered points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.functions.arrays import count_upto, let
from gyre.operators.pairs import met
from gyre.operators.regrid import value_at
from gyre.scratch import written


#: Nodes of an axis that become a literal of the plan; the intervals of longer ones are joined.
LITERAL = 4096
#: Corners that are broadcast to the cells.
BROADCAST_CORNERS = 100_000


def _falls(index: str, coord: str, changes: bool) -> ValueError:
    if changes:
        return ValueError(f"{coord} changes along other dimensions than {index}; use level_coord or curvilinear2loc")
    return ValueError(f"{coord} does not rise with {index}")


def _axis(grid: DataFrame, index: str, coord: str, literal: int) -> tuple[list, DataFrame | None]:
    """The nodes of an axis, (place, coordinate) in order, or of one longer than ``literal`` their table (_i, _c).

    An error if the coordinate changes along another dimension, or does not rise.
    """
    nodes = grid.groupBy(F.col(index).cast("long").alias("_i")).agg(F.min(coord).cast("double").alias("_c"), F.max(coord).cast("double").alias("_d"))
    few = sorted((r["_i"], r["_c"], r["_d"]) for r in nodes.orderBy("_i").limit(literal + 1).collect() if r["_c"] is not None)
    if len(few) <= literal:
        if any(d - c > 1e-9 * max(1.0, abs(c)) for _, c, d in few):
            raise _falls(index, coord, True)
        if any(b[1] <= a[1] for a, b in zip(few, few[1:])):
            raise _falls(index, coord, False)
        return [(i, c) for i, c, _ in few], None
    nodes = written(nodes.where("_c IS NOT NULL"), "axis")
    if not nodes.where(F.col("_d") - F.col("_c") > 1e-9 * F.greatest(F.lit(1.0), F.abs("_c"))).isEmpty():
        raise _falls(index, coord, True)
    if not nodes.join(nodes.select((F.col("_i") - 1).alias("_i"), F.col("_c").alias("_next")), "_i").where("_next <= _c").isEmpty():
        raise _falls(index, coord, False)
    return [], nodes.select("_i", "_c")


def _bracketed(rows: DataFrame, grid: DataFrame, index: str, coord: str, period: float | None, literal: int) -> DataFrame:
    """Add where each row lies on an axis: _i and _j, the nodes around it, and _a, its share of the way; null outside.

    With a ``period`` the axis is a ring: behind its last node comes the first one again.
    """
    listed, nodes = _axis(grid, index, coord, literal)
    names = [f"_{x}_{index}" for x in "ija"]
    if nodes is None and not listed:
        return rows.withColumns({c: F.lit(None).cast("double" if c.startswith("_a") else "long") for c in names})
    n, low, high = nodes.agg(F.count(F.lit(1)), F.min("_c"), F.max("_c")).first() if nodes is not None else (len(listed), listed[0][1], listed[-1][1])
    x = F.col(coord).cast("double")
    if period:
        x = F.lit(low) + F.pmod(x - F.lit(low), F.lit(float(period)))
    closing = bool(period) and high < low + period
    if nodes is None:
        coords, places = [c for _, c in listed], [i for i, _ in listed]
        if closing:
            coords, places = [*coords, low + period], [*places, places[0]]
        at, numbers = F.array(*map(F.lit, coords)), F.array(*[F.lit(i).cast("long") for i in places])
        k = F.when((x >= coords[0]) & (x <= coords[-1]), count_upto(at, len(coords), x) - 1)
        share = lambda k: F.coalesce((x - F.get(at, k)) / (F.get(at, k + 1) - F.get(at, k)), F.lit(0.0))
        rows = rows.withColumn("_k", k)
        found = [F.get(numbers, F.col("_k")), F.get(numbers, F.col("_k") + 1), F.when(F.col("_k").isNotNull(), share(F.col("_k")))]
        return rows.withColumns(dict(zip(names, found))).drop("_k")
    # Intervals and rows meet on bins of the mean width of an interval, or wider ones of which an interval takes few.
    ends = nodes.select((F.col("_i") - 1).alias("_i"), F.col("_i").alias("_j"), F.col("_c").alias("_e"))
    parts = nodes.join(ends, "_i").select("_i", "_j", "_c", "_e", F.lit(False).alias("_last"))
    final = nodes.where(F.col("_c") == high).select("_i", F.lit(None).cast("long").alias("_j"), "_c", F.col("_c").alias("_e"), F.lit(True).alias("_last"))
    if closing:
        first = nodes.where(F.col("_c") == low).select(F.col("_i").alias("_j"))
        final = final.drop("_j").join(F.broadcast(first)).select("_i", "_j", "_c", F.lit(low + period).alias("_e"), F.lit(False).alias("_last"))
    width = ((low + period if closing else high) - low) / n or 1.0
    bin_of = lambda c: F.floor((c - F.lit(low)) / width)
    parts = parts.unionByName(final).withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_c")), bin_of(F.col("_e")))))
    rows = rows.withColumn("_x", x).withColumn("_bin", bin_of(F.col("_x")))
    parts = parts.withColumnRenamed("_bin", "_pbin")
    inside = (F.col("_bin") == F.col("_pbin")) & (F.col("_x") >= F.col("_c")) & ((F.col("_x") < F.col("_e")) | (F.col("_last") & (F.col("_x") == F.col("_e"))))
    met = rows.join(parts, inside, "left")
    share = F.when(F.col("_last"), F.lit(0.0)).otherwise((F.col("_x") - F.col("_c")) / (F.col("_e") - F.col("_c")))
    return met.withColumns({names[0]: F.col("_i"), names[1]: F.col("_j"), names[2]: share}).drop("_i", "_j", "_c", "_e", "_last", "_bin", "_pbin", "_x")


def grid2loc(
    grid: DataFrame, points: DataFrame, axes: dict[str, str], v: str | list[str], extra: list[str] = (), period: dict[str, float] | None = None,
    level: str | None = None, level_coord: str | None = None, literal: int = LITERAL,
) -> DataFrame:
    """Linear interpolation at points over up to four axes: id, extra dimensions, v (one column or several).

    ``axes`` maps an index column of the grid (from 0 on, rising with its coordinate) to the coordinate's
    column, which both frames have. A point outside an axis, without a coordinate, or with a missing corner
    has a missing value; on the last node the corner beyond it is not needed. ``period`` makes an axis a ring, whose
    first node follows on the last. Points at one place are interpolated once. Each place explodes to its corners, at most
    two an axis, and these meet the cells by an equi-join. Axes of more than ``literal`` nodes are joined by their
    intervals; the result is the same. With extra dimensions each point has a row for every one of their places, so that
    points and results meet in blocks.

    ``level`` is the index of a dimension whose coordinate, ``level_coord``, changes from cell to cell, such as the
    depth of terrain-following levels: it is interpolated along the other axes first, with the values.
    """
    values = [v] if isinstance(v, str) else list(v)
    at = list(dict.fromkeys(axes.values()))
    of = {c: f"_at_{c}" for c in at}
    asked = points.select("id", *[F.col(c).cast("double").alias(k) for c, k in of.items()], *([F.col(level_coord).cast("double").alias("_y")] if level else []))
    # Written, so that what is asked of a place is not asked of every point.
    places = written(asked.select(*[F.col(k).alias(c) for c, k in of.items()]).distinct(), "places")
    found = _at_places(grid, places, axes, [level_coord, *values] if level else values, [*extra, level] if level else extra, period, literal)
    found = found.withColumnsRenamed(of)
    keys = list(of.values())
    if level:
        # One array a place, by rising depth, of all values; each depth at a place is looked up once.
        node = F.struct(F.col(level_coord).alias("y"), *[F.col(c).alias(f"v{n}") for n, c in enumerate(values)])
        found = found.where(F.col(level).isNotNull() & F.col(level_coord).isNotNull()).groupBy(*keys, *extra).agg(F.array_sort(F.collect_list(node)).alias("_nodes"))
        one = lambda n: F.transform("_nodes", lambda x: F.struct(x["y"].alias("y"), x[f"v{n}"].alias("v")))
        depths = asked.select(*keys, "_y").distinct().join(found, keys)
        found = depths.select(*keys, "_y", *extra, *[_on_profile(one(n), F.col("_y")).alias(c) for n, c in enumerate(values)])
        keys = [*keys, "_y"]
    if not extra:
        return asked.join(found, keys, "left").select("id", *values)
    found = written(found, "found")
    out = met(asked, found, keys).unionByName(asked.join(found.select(*keys).distinct(), keys, "left_anti"), True)
    return out.select("id", *extra, *values)


def _at_places(grid: DataFrame, places: DataFrame, axes: dict[str, str], values: list[str], extra: list[str], period: dict[str, float] | None, literal: int) -> DataFrame:
    """Linear interpolation at different places: their coordinates, extra dimensions, values; none where no corner is a cell."""
    rows, at = places, places.columns
    for index, coord in axes.items():
        rows = _bracketed(rows, grid, index, coord, (period or {}).get(coord), literal)
    weight, need, corner = F.lit(1.0), F.lit(1), rows
    for index in axes:
        pair = F.array(
            F.struct(F.col(f"_i_{index}").alias("i"), (1 - F.col(f"_a_{index}")).alias("w")),
            F.struct(F.col(f"_j_{index}").alias("i"), F.col(f"_a_{index}").alias("w")),
        )
        # A corner without weight is not asked for.
        corner = corner.withColumn(f"_p_{index}", F.filter(pair, lambda c: c["w"] > 0))
        need = need * F.size(f"_p_{index}")
    corner = corner.withColumn("_need", need)
    for index in axes:
        corner = corner.withColumn(f"_c_{index}", F.explode(f"_p_{index}"))
        weight = weight * F.col(f"_c_{index}.w")
    named = {c: f"_at_{c}" for c in at}
    wanted = written(corner.select(*[F.col(c).alias(k) for c, k in named.items()], *[F.col(f"_c_{i}.i").alias(i) for i in axes], weight.alias("_w"), "_need"), "corners")
    # Exploded rows are more than the planner takes them for.
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_CORNERS else wanted.hint("merge")
    cells = grid.select(*axes, *extra, *[F.col(c).cast("double").alias(f"_v_{c}") for c in values])
    sums = [f(F.col(f"_v_{c}")).alias(f"{n}{c}") for c in values for n, f in (("_s_", lambda x: F.sum(F.col("_w") * x)), ("_got_", F.count))]
    found = cells.join(wanted, list(axes)).groupBy(*named.values(), *extra).agg(F.first("_need").alias("_need"), *sums)
    return found.select(*[F.col(k).alias(c) for c, k in named.items()], *extra, *[F.when(F.col(f"_got_{c}") == F.col("_need"), F.col(f"_s_{c}")).alias(c) for c in values])


def _on_profile(nodes: Column, y: Column) -> Column:
    """Linear between the two nodes around y, missing where one of them is, or outside; on a node its own value."""
    placed = F.transform(nodes, lambda n, i: F.struct(n["y"].alias("y"), n["v"].alias("v"), i.alias("i")))
    on = lambda n: F.filter(n, lambda x: x["y"] == y)
    return let(placed, lambda n: F.when(F.size(on(n)) > 0, F.get(on(n), F.lit(0))["v"]).otherwise(value_at(n, y)))


def curvilinear2loc(grid: DataFrame, points: DataFrame, ydim: str = "j", xdim: str = "i", v: str = "v", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Bilinear interpolation at points from a grid whose longitudes and latitudes both change along both dimensions.

    Columns: id, p and q (place along xdim and ydim, whole part the cell, -1 outside), v. The cells, as
    quadrilaterals of four nodes, and the points meet on bins about as large as a cell; of several cells that hold
    a point the one of least indices counts. A missing corner of any weight gives a missing value.

    Longitudes are unrolled around each cell, and bins go round the globe, so that cells across the date line are as
    narrow as any. A cell whose corners turn around a pole is laid out on the plane around that pole.
    """
    node = F.struct(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"), F.col(v).cast("double").alias("v"))
    # A node is a corner of up to four cells.
    share = F.array(*[F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj in (0, 1) for di in (0, 1)])
    own = grid.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(ydim, xdim, node.alias("_n"), F.explode(share).alias("_d"))
    of_cell = own.groupBy((F.col(ydim) - F.col("_d.dj")).alias("_j"), (F.col(xdim) - F.col("_d.di")).alias("_i"))
    corner = lambda di, dj: F.max(F.when((F.col("_d.di") == di) & (F.col("_d.dj") == dj), F.col("_n")))
    cells = of_cell.agg(*[corner(*d).alias(f"_n{k}") for k, d in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    cells = _unrolled(cells.where(" AND ".join(f"_n{k} IS NOT NULL" for k in range(4))))
    # Nearly all cells fit into a bin; larger ones enter several.
    size = cells.where("_pole = 0").agg(*[F.percentile_approx(F.col(f"_{a}1") - F.col(f"_{a}0"), 0.99).alias(a) for a in "xy"]).first()
    around = max(1, int(360 // max(size["x"] or 1.0, 1e-6)))
    step = {"x": 360 / around, "y": max(size["y"] or 1.0, 1e-9)}
    low, high = (F.floor((F.col(f"_x{e}") + by) / step["x"]) for e, by in ((0, -1e-9), (1, 1e-9)))
    columns = F.transform(F.sequence(low, F.least(high, low + (around - 1))), lambda i: F.pmod(i, F.lit(around)))
    cells = cells.withColumn("_bx", F.explode(columns))
    cells = cells.withColumn("_by", F.explode(F.sequence(F.floor(F.col("_y0") / step["y"]), F.floor(F.col("_y1") / step["y"]))))
    here = points.select("id", F.col(lon).cast("double").alias("_px"), F.col(lat).cast("double").alias("_py"))
    here = here.withColumn("_bx", F.pmod(F.floor(F.col("_px") / step["x"]), F.lit(around))).withColumn("_by", F.floor(F.col("_py") / step["y"]))
    middle = (F.col("_x0") + F.col("_x1")) / 2
    x, y = middle + _turn(F.col("_px") - middle), F.col("_py")
    inside = (F.col("_pole") != 0) | x.between(F.col("_x0") - 1e-9, F.col("_x1") + 1e-9) & y.between(F.col("_y0"), F.col("_y1"))
    flat = _around_pole(F.col("_px"), F.col("_py"), F.col("_pole"))
    at = [F.when(F.col("_pole") != 0, p).otherwise(q) for p, q in zip(flat, (x, y))]
    met = here.join(cells, ["_bx", "_by"]).where(inside).withColumn("_pq", _relative(*at)).where("_pq IS NOT NULL")
    p, q = F.col("_pq.p"), F.col("_pq.q")
    weights = [(1 - p) * (1 - q), p * (1 - q), p * q, (1 - p) * q]
    terms = [F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(f"_n{k}.v")) for k, w in enumerate(weights)]
    total = terms[0] + terms[1] + terms[2] + terms[3]
    best = met.groupBy("id").agg(F.min(F.struct("_j", "_i", (F.col("_i") + p).alias("p"), (F.col("_j") + q).alias("q"), total.alias("v"))).alias("_m"))
    out = points.select("id").join(best, "id", "left")
    return out.select("id", F.coalesce("_m.p", F.lit(-1.0)).alias("p"), F.coalesce("_m.q", F.lit(-1.0)).alias("q"), F.col("_m.v").alias(v))


def _turn(degrees: Column) -> Column:
    """An angle as one from -180 to 180 degrees."""
    return F.when(F.abs(degrees) <= 180, degrees).otherwise(F.pmod(degrees + 180, F.lit(360.0)) - 180)


def _around_pole(x: Column, y: Column, pole: Column) -> list[Column]:
    """A place on the plane around a pole (1 or -1): its distance in degrees, in the direction of its longitude."""
    away = 90 - y * pole
    return [away * F.cos(F.radians(x)), away * F.sin(F.radians(x))]


def _unrolled(cells: DataFrame) -> DataFrame:
    """Cells with their corners _n0 to _n3 as a plane has them, their range _x0 to _y1 in degrees, and _pole: 1 or -1 if they hold one, or 0."""
    x, y = ([F.col(f"_n{k}.{c}") for k in range(4)] for c in "xy")
    steps = [_turn(x[(k + 1) % 4] - x[k]) for k in range(4)]
    pole = F.when(F.abs(steps[0] + steps[1] + steps[2] + steps[3]) < 180, F.lit(0)).otherwise(F.when(y[0] + y[1] + y[2] + y[3] > 0, 1).otherwise(-1))
    rows = cells.withColumn("_pole", pole)
    along = [x[0], x[0] + steps[0], x[0] + steps[0] + steps[1], x[0] + steps[0] + steps[1] + steps[2]]
    for k in range(4):
        flat = _around_pole(x[k], y[k], F.col("_pole"))
        px, py = (F.when(F.col("_pole") != 0, p).otherwise(q) for p, q in zip(flat, (along[k], y[k])))
        rows = rows.withColumn(f"_m{k}", F.struct(px.alias("x"), py.alias("y"), F.col(f"_n{k}.v").alias("v")))
    holds = F.col("_pole") != 0
    ranges = {
        "_x0": F.when(holds, -180.0).otherwise(F.least(*along)), "_x1": F.when(holds, 180.0).otherwise(F.greatest(*along)),
        "_y0": F.when(F.col("_pole") < 0, -90.0).otherwise(F.least(*y)), "_y1": F.when(F.col("_pole") > 0, 90.0).otherwise(F.greatest(*y)),
    }
    return rows.withColumns(ranges).drop(*[f"_n{k}" for k in range(4)]).withColumnsRenamed({f"_m{k}": f"_n{k}" for k in range(4)})


def _relative(x: Column, y: Column) -> Column:
    """``cell_coordinates`` as a column of the cell's corners _n0 to _n3: (p, q), or missing outside."""
    at = lambda k, c: F.col(f"_n{k}.{c}")
    side = lambda k, c: at(k, c) - at(0, c)
    ax, ay, bx, by = side(1, "x"), side(1, "y"), side(3, "x"), side(3, "y")
    cx, cy = at(2, "x") - at(1, "x") - bx, at(2, "y") - at(1, "y") - by
    dx, dy = x - at(0, "x"), y - at(0, "y")
    names = dict(zip(("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"), (ax, ay, bx, by, cx, cy, dx, dy)))

    def of(s: Column) -> Column:
        k2 = s["bx"] * s["cy"] - s["by"] * s["cx"]
        k1 = s["bx"] * s["ay"] - s["by"] * s["ax"] + s["dy"] * s["cx"] - s["dx"] * s["cy"]
        k0 = s["dy"] * s["ax"] - s["dx"] * s["ay"]
        straight, under = F.abs(k2) < 1e-12 * F.greatest(F.abs(k1), F.lit(1e-300)), k1 * k1 - 4 * k2 * k0
        root = lambda sign: F.when(straight, F.when(k1 != 0, -k0 / k1)).when(under >= 0, (-k1 + sign * F.sqrt(under)) / (2 * k2))

        def placed(q: Column) -> Column:
            ex, ey = s["ax"] + q * s["cx"], s["ay"] + q * s["cy"]
            p = F.when(F.abs(ex) >= F.abs(ey), (s["dx"] - q * s["bx"]) / ex).otherwise((s["dy"] - q * s["by"]) / ey)
            # Unrolled longitudes are off by the last bits, and a place on a node is to be on it.
            held = lambda z: F.when(F.abs(z - F.round(z)) < 1e-11, F.round(z)).otherwise(F.greatest(F.least(z, F.lit(1.0)), F.lit(0.0)))
            fits = p.between(-1e-9, 1 + 1e-9) & q.between(-1e-9, 1 + 1e-9)
            return F.when(fits, F.struct(held(p).alias("p"), held(q).alias("q")))

        return F.coalesce(let(root(1), placed), let(root(-1), placed))

    return let(F.struct(*[c.alias(n) for n, c in names.items()]), of)


def cell_coordinates(x, y, corners: np.ndarray) -> tuple[float, float]:
    """Relative place (p, q) of a point in a quadrilateral with corners (0,0), (1,0), (1,1), (0,1); (-1, -1) outside.

    The inverse of the bilinear map: a quadratic in q, and then p.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    ax, ay, bx, by = x1 - x0, y1 - y0, x3 - x0, y3 - y0
    cx, cy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx, dy = x - x0, y - y0
    k2, k1, k0 = bx * cy - by * cx, bx * ay - by * ax + dy * cx - dx * cy, dy * ax - dx * ay
    if abs(k2) < 1e-12 * max(abs(k1), 1e-300):
        roots = [-k0 / k1] if k1 else []
    else:
        under = k1 * k1 - 4 * k2 * k0
        roots = [] if under < 0 else [(-k1 + s * under**0.5) / (2 * k2) for s in (1, -1)]
    for q in roots:
        ex, ey = ax + q * cx, ay + q * cy
        p = (dx - q * bx) / ex if abs(ex) >= abs(ey) else (dy - q * by) / ey
        if -1e-9 <= p <= 1 + 1e-9 and -1e-9 <= q <= 1 + 1e-9:
            return min(max(p, 0.0), 1.0), min(max(q, 0.0), 1.0)
    return -1.0, -1.0
