"""Particles carried by a frozen field of velocity.

The field is cut into tiles of cells, each with a margin that no particle crosses in one step. A task has one tile and some
of the particles in it, and carries them step by step until they leave it; then they are dealt to their new tiles. So there
are as many rounds as tiles that one particle goes through, whatever the number of steps, and no task holds the field.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.functions.arrays import count_upto
from gyre.scratch import written
from gyre.shipping import ship

RADIUS = 6371e3
_SCALE = 180 / (math.pi * RADIUS)
#: Cells along a side of a tile, and particles of a task.
TILE, PARTICLES = 128, 20_000


def _velocity(x, y, lon, lat, u, v, box):
    """Velocity in degrees a second at places, by bilinear interpolation; missing outside the ``box`` of the whole field."""
    i = np.clip(np.searchsorted(lon, x, "right") - 1, 0, len(lon) - 2)
    j = np.clip(np.searchsorted(lat, y, "right") - 1, 0, len(lat) - 2)
    a, b = (x - lon[i]) / (lon[i + 1] - lon[i]), (y - lat[j]) / (lat[j + 1] - lat[j])
    out = (x < box[0]) | (x > box[1]) | (y < box[2]) | (y > box[3])

    def at(f):
        r = f[j, i] * (1 - a) * (1 - b) + f[j, i + 1] * a * (1 - b) + f[j + 1, i] * (1 - a) * b + f[j + 1, i + 1] * a * b
        return np.where(out, np.nan, r)

    return at(u) * _SCALE, at(v) * _SCALE * np.cos(np.radians(y))


def _stepped(f, x, y, dt, exact_rk4: bool):
    """Places after a step of ``dt`` in the velocity ``f``."""
    k1 = f(x, y)
    k2 = f(x + dt * k1[0] / 2, y + dt * k1[1] / 2)
    k3 = f(x + dt * k2[0] / 2, y + dt * k2[1] / 2)
    far, m = (1.0, 2) if exact_rk4 else (0.5, 1)
    k4 = f(x + far * dt * k3[0], y + far * dt * k3[1])
    return tuple(p + dt * (k1[q] + m * k2[q] + m * k3[q] + k4[q]) / 6 for q, p in enumerate((x, y)))


class _Axis:
    """An axis of the field: its nodes as a table (_i, _c), and where its tiles begin."""

    def __init__(self, field: DataFrame, index: str, coord: str):
        self.nodes = written(field.groupBy(F.col(index).cast("long").alias("_i")).agg(F.min(coord).cast("double").alias("_c")), "flow-axis")
        first, last, n, self.low, self.high = self.nodes.agg(F.min("_i"), F.max("_i"), F.count(F.lit(1)), F.min("_c"), F.max("_c")).first()
        if n < 2 or last - first + 1 != n:
            raise ValueError(f"{index} has {n} nodes from {first} to {last}: at least 2, without gaps, are needed")
        self.first, self.cells = first, n - 1
        gap = self.nodes.join(self.nodes.select((F.col("_i") - 1).alias("_i"), F.col("_c").alias("_e")), "_i").agg(F.min(F.col("_e") - F.col("_c"))).first()[0]
        if gap <= 0:
            raise ValueError(f"{coord} does not rise with {index}")
        self.gap = gap

    def cut(self, tile: int, margin: int) -> None:
        """Divide the axis into tiles of so many cells, with so many more at either side."""
        self.tile, self.margin, self.n = tile, margin, -(-self.cells // tile)
        marks = self.nodes.where(f"pmod(_i - {self.first}, {tile}) = 0 AND _i < {self.first + self.cells}").orderBy("_i").collect()
        self.begins = [r["_c"] for r in marks]

    def tiles_of(self, index: str) -> Column:
        """The tiles that a node belongs to, with their margins."""
        i = F.col(index).cast("long") - self.first
        low, high = F.ceil((i - self.margin) / self.tile) - 1, F.floor((i + self.margin) / self.tile)
        return F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(self.n - 1))))

    def tile_at(self, place: str) -> Column:
        """The tile that a place lies in; null outside the field."""
        x = F.col(place)
        return F.when((x >= self.low) & (x <= self.high), count_upto(F.array(*map(F.lit, self.begins)), len(self.begins), x) - 1)

    def pieces(self, name: str) -> DataFrame:
        """Of each tile the nodes along this axis, and the places between which it is left: infinite at the ends of the field."""
        rows = self.nodes.withColumn(name, self.tiles_of("_i")).groupBy(name).agg(F.array_sort(F.collect_list("_c")).alias(f"{name}_nodes"), F.min("_i").alias(f"{name}_first"))
        begins, ends = F.array(*map(F.lit, [-math.inf, *self.begins[1:]])), F.array(*map(F.lit, [*self.begins[1:], math.inf]))
        return rows.withColumns({f"{name}_from": F.get(begins, F.col(name)), f"{name}_to": F.get(ends, F.col(name))})


def flow2d(field: DataFrame, seeds: DataFrame, duration: float, step: float, exact_rk4: bool = False, tile: int = TILE, particles: int = PARTICLES) -> DataFrame:
    """Tracks of seeds (id, lon, lat) in a field (i_y, i_x, lon, lat, u, v): id, seconds, lon, lat.

    The step weighs its four slopes equally, the last of them taken half-way, which is the contract of this
    operator; ``exact_rk4`` gives the classical scheme. The last step is shortened to the duration. Outside the field,
    beside missing cells, and ever after, places are missing. ``tile`` and ``particles`` bear on the plan alone: tiles grow
    where a step at the highest speed reaches farther than that.
    """
    ship(field.sparkSession)
    steps = [step] * int(duration // step) + ([duration % step] if duration % step else [])
    start = seeds.select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    seconds = F.get(F.array(*[F.lit(float(t)) for t in np.concatenate([[0.0], np.cumsum(steps)])]), F.col("_n"))
    axes = {"_ty": _Axis(field, "i_y", "lat"), "_tx": _Axis(field, "i_x", "lon")}
    fastest = field.agg(F.max(F.abs("u")), F.max(F.abs("v"))).first()
    reach = {"_tx": fastest[0] or 0.0, "_ty": fastest[1] or 0.0}
    for name, axis in axes.items():
        margin = math.ceil(reach[name] * _SCALE * step / axis.gap) + 1
        axis.cut(max(tile, margin), margin)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(c)
    nodes = field.select(F.col("i_y").cast("long").alias("j"), F.col("i_x").cast("long").alias("i"), value("u"), value("v"))
    nodes = nodes.withColumn("_ty", axes["_ty"].tiles_of("j")).withColumn("_tx", axes["_tx"].tiles_of("i"))
    tiles = nodes.groupBy("_ty", "_tx").agg(F.collect_list(F.struct("j", "i", "u", "v")).alias("_nodes"))
    for name, axis in axes.items():
        tiles = tiles.join(axis.pieces(name), name)
    tiles = written(tiles, "flow-tiles")
    box = (axes["_tx"].low, axes["_tx"].high, axes["_ty"].low, axes["_ty"].high)

    def carry(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        """Steps of particles as long as they are in a tile: places after each, and which of them go on elsewhere."""
        ids, n = pdf["id"].to_numpy(), pdf["_n"].to_numpy().copy()
        x, y = pdf["lon"].to_numpy(float).copy(), pdf["lat"].to_numpy(float).copy()
        if len(of):
            t = of.iloc[0]
            lon, lat = (np.asarray(t[f"{c}_nodes"], float) for c in ("_tx", "_ty"))
            u, v = np.full((2, len(lat), len(lon)), np.nan)
            j, i, fu, fv = (np.array([r[c] for r in t["_nodes"]]) for c in "jiuv")
            u[j - t["_ty_first"], i - t["_tx_first"]], v[j - t["_ty_first"], i - t["_tx_first"]] = fu, fv
            f = lambda a, b: _velocity(a, b, lon, lat, u, v, box)
        else:  # a tile without any node, or a place outside
            t, f = None, lambda a, b: (np.full(len(a), np.nan),) * 2
        size = np.append(steps, 0.0)
        out, at = [], np.arange(len(ids))
        while len(at):
            x[at], y[at] = _stepped(f, x[at], y[at], size[n[at]], exact_rk4)
            n[at] += 1
            lost = np.isnan(x[at]) | np.isnan(y[at])
            here = lost if t is None else lost | ((x[at] >= t["_tx_from"]) & (x[at] < t["_tx_to"]) & (y[at] >= t["_ty_from"]) & (y[at] < t["_ty_to"]))
            goes = ~here & (n[at] < len(steps))
            out.append(pd.DataFrame({"id": ids[at], "_n": n[at], "lon": x[at], "lat": y[at], "_go": goes}))
            at = at[here & (n[at] < len(steps))]
        return pd.concat(out) if out else pd.DataFrame({"id": ids[:0], "_n": n[:0], "lon": x[:0], "lat": y[:0], "_go": np.zeros(0, bool)})

    schema = f"id {seeds.schema['id'].dataType.simpleString()}, _n int, lon double, lat double, _go boolean"
    first = start.select("id", F.lit(0).alias("_n"), F.coalesce("lon", F.lit(math.nan)).alias("lon"), F.coalesce("lat", F.lit(math.nan)).alias("lat"), F.lit(bool(steps)).alias("_go"))
    rounds = [written(first, "flow-round")]
    while not rounds[-1].where("_go").isEmpty():
        placed = rounds[-1].where("_go").drop("_go").withColumns({c: F.coalesce(a.tile_at(p), F.lit(-1)) for (c, a), p in zip(axes.items(), ("lat", "lon"))})
        many = placed.groupBy("_ty", "_tx").agg(F.ceil(F.count(F.lit(1)) / particles).cast("int").alias("_parts"))
        dealt = placed.join(many, ["_ty", "_tx"]).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
        wanted = tiles.join(many, ["_ty", "_tx"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        keys = ["_ty", "_tx", "_part"]
        rounds.append(written(dealt.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(carry, schema), "flow-round"))
    known = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("lon", "lat")]
    return reduce(DataFrame.unionByName, rounds).select("id", seconds.alias("seconds"), *known)
