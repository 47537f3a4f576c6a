"""Queries of the grid operators over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyre import coords
from gyre.functions import geo, sigma, variogram
from gyre.gridframe import GridFrame
from gyre.meta.specs import MetaSpecs
from gyre.operators import distance, filters, geostat, grid, interp, regrid, thermdyn
from gyre.operators.dyn import flow2d
from gyre.operators.neighbours import nearest_k
from gyre.plans.tables import CELLS, HOURS, LEVELS, POINTS, SCALE, cells, customers, hours, levels, suppliers, table
from gyre.streaming.resample import resample, tidal_resample

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TARGETS = [5.0, 20.0, 40.0, 60.0, 90.0, 130.0]
_T = "o AS (SELECT unnest([5.0, 20.0, 40.0, 60.0, 90.0, 130.0])::DOUBLE AS yo)"
_HAV = "2 * 6371000.0 * asin(least(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)), 1.0))"


def hav(a: str, b: str) -> str:
    return _HAV.format(a=a, b=b)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def r(c, n: int = 4):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def r_pairs(c, n: int):
    """``round`` for columns of very many rows: the same values, by way of decimals only where a tie is near."""
    c = F.col(c) if isinstance(c, str) else c
    scaled = c * 10.0**n
    near_tie = F.abs(scaled - F.floor(scaled) - 0.5) < 1e-3
    return F.when(near_tie | (F.abs(scaled) > 1e12), F.round(c, n)).otherwise(F.floor(scaled + 0.5) / 10.0**n)


# Geometry.


@query("geo_distance_matrix", f"WITH {POINTS} SELECT s.id AS id_a, c.id AS id_b, round({hav('s', 'c')}, 3) AS dist FROM s, c")
def _(spark, d):
    return distance.pairwise(suppliers(spark, d), customers(spark, d), of=lambda dist: r_pairs(dist, 3))


@query("geo_self_distances", f"WITH {POINTS} SELECT a.id AS id_a, b.id AS id_b, round({hav('a', 'b')} / 1000, 4) AS dist FROM s a, s b WHERE a.id < b.id")
def _(spark, d):
    return distance.self_pairwise(suppliers(spark, d), units="km", of=lambda dist: r_pairs(dist, 4))


@query("geo_radius_semijoin", f"WITH {POINTS} SELECT c.id, c.lon, c.lat FROM c WHERE EXISTS (SELECT 1 FROM s WHERE {hav('c', 's')} < 500000.3)")
def _(spark, d):
    return distance.within_radius(customers(spark, d), suppliers(spark, d), 500_000.3).select("id", "lon", "lat")


@query(
    "geo_nearest",
    f"""WITH {POINTS}, x AS (SELECT s.id, c.id AS nearest_id, round({hav('s', 'c')}, 6) AS d FROM s, c)
SELECT id, nearest_id, round(d, 3) AS dist FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, nearest_id DESC) = 1""",
)
def _(spark, d):
    return distance.nearest(suppliers(spark, d), customers(spark, d)).select("id", "nearest_id", r("dist", 3).alias("dist"))


@query(
    "geo_nearest_k",
    f"""WITH {POINTS}, x AS (SELECT s.id, c.id AS nearest_id, round({hav('s', 'c')}, 6) AS d FROM s, c)
SELECT id, CAST(row_number() OVER w AS INTEGER) AS rank, nearest_id, round(d * {SCALE}, 3) AS dist FROM x WINDOW w AS (PARTITION BY id ORDER BY d, nearest_id DESC) QUALIFY rank <= 5""",
)
def _(spark, d):
    # Distances come rounded; the factor keeps them off the ties of another rounding.
    return nearest_k(suppliers(spark, d), customers(spark, d), 5).select("id", "rank", "nearest_id", r(F.col("dist") * SCALE, 3).alias("dist"))


@query(
    "geo_bearing",
    f"""WITH {POINTS} SELECT s.id AS id_a, c.id AS id_b, round(degrees(atan2(cos(radians(s.lat)) * sin(radians(c.lat)) - sin(radians(s.lat)) * cos(radians(c.lat)) * cos(radians(c.lon - s.lon)),
 sin(radians(c.lon - s.lon)) * cos(radians(c.lat)))), 4) AS angle FROM s JOIN c ON s.id = c.id AND (s.lon <> c.lon OR s.lat <> c.lat)""",
)
def _(spark, d):
    s, c = suppliers(spark, d).alias("s"), customers(spark, d).alias("c")
    rows = s.join(c, (F.col("s.id") == F.col("c.id")) & ((F.col("s.lon") != F.col("c.lon")) | (F.col("s.lat") != F.col("c.lat"))))
    return rows.select(F.col("s.id").alias("id_a"), F.col("c.id").alias("id_b"), r(geo.bearing("s.lon", "s.lat", "c.lon", "c.lat")).alias("angle"))


@query("deg_m", f"WITH {POINTS} SELECT id, round(radians(lon) * 6371000 * cos(radians(lat)), 3) AS metres, round(degrees(value / 6371000) / cos(radians(lat)), 9) AS degrees FROM c")
def _(spark, d):
    return customers(spark, d).select("id", r(geo.deg2m("lon", "lat"), 3).alias("metres"), r(geo.m2deg("value", "lat"), 9).alias("degrees"))


@query(
    "geo_extent",
    f"""WITH {POINTS}, e AS (SELECT min(lon) a, max(lon) b, min(lat) y, max(lat) z FROM c)
SELECT round((a + b) / 2 - (b - a) * 0.6, 6) AS xmin, round((a + b) / 2 + (b - a) * 0.6, 6) AS xmax, round((y + z) / 2 - (z - y) * 0.6, 6) AS ymin, round((y + z) / 2 + (z - y) * 0.6, 6) AS ymax FROM e""",
)
def _(spark, d):
    box = distance.extent(customers(spark, d), margin=0.1)
    return spark.createDataFrame([tuple(round(x, 6) for x in box)], "xmin double, xmax double, ymin double, ymax double")


@query("radius_average", f"WITH {POINTS} SELECT s.id, round(avg(c.value), 4) AS value FROM s JOIN c ON {hav('s', 'c')} <= 800000.7 GROUP BY s.id")
def _(spark, d):
    return distance.radius_average(customers(spark, d), suppliers(spark, d), 800_000.7).select("id", r("value").alias("value"))


# Vertical coordinates.

_SIG = "k AS (SELECT unnest(range(0, 11))::INTEGER AS k, -1 + unnest(range(0, 11)) / 10.0 AS sig), o2 AS (SELECT o_orderkey AS id, o_totalprice / 70001.0 AS eta, 50 + o_totalprice / 131.0 AS h FROM orders)"


def _sea_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 70001.0).alias("eta"), (50 + F.col("o_totalprice") / 131.0).alias("h")
    )


def _by_levels(columns: DataFrame) -> DataFrame:
    sig = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(-1 + k / 10.0).alias("sig")) for k in range(11)])
    return columns.withColumn("_s", F.explode(sig)).select(*columns.columns, "_s.k", "_s.sig")


def _columns_by_levels(spark: SparkSession, d: str) -> DataFrame:
    return _by_levels(_sea_columns(spark, d))


_CS = "((1 - 0.4) * sinh(6.0 * sig) / sinh(6.0) + 0.4 * (tanh(6.0 * (sig + 0.5)) / (2 * tanh(3.0)) - 0.5))"


def _sigma(name: str, expr: str, make) -> None:
    @query(name, f"WITH {_SIG} SELECT id, k, round({expr}, 4) AS z FROM o2, k")
    def _(spark, d):
        return _columns_by_levels(spark, d).select("id", "k", r(make()).alias("z"))


def _stretch():
    return sigma.stretching("sig", 6.0, 0.4)


_sigma("sigma_atmosphere", "100.0 + sig * (h * 1000 - 100.0)", lambda: sigma.atmosphere_sigma("sig", F.col("h") * 1000, 100.0))
_sigma("sigma_ocean", "eta + sig * (eta + h)", lambda: sigma.ocean_sigma("sig", "eta", "h"))
_sigma("stretching_cs", _CS, _stretch)
_sigma("ocean_s", f"eta * (1 + sig) + 10.0 * sig + (h - 10.0) * {_CS}", lambda: sigma.ocean_s("sig", "eta", "h", 10.0, _stretch()))
_sigma(
    "ocean_s_g1",
    f"(10.0 * sig + (h - 10.0) * {_CS}) + eta * (1 + (10.0 * sig + (h - 10.0) * {_CS}) / h)",
    lambda: sigma.ocean_s_g1("sig", "eta", "h", 10.0, _stretch()),
)
_sigma(
    "ocean_s_g2", f"((10.0 * sig + h * {_CS}) / (h + 10.0)) * (h + eta) + eta", lambda: sigma.ocean_s_g2("sig", "eta", "h", 10.0, _stretch())
)


def _dz2depth(name: str, expr: str, centered: bool = False, **options) -> None:
    edge = f"e AS (SELECT prof, lvl, {expr} AS depth FROM (SELECT prof, 0 AS lvl, 0.0 AS s, sum(dz) AS total FROM l GROUP BY prof UNION ALL SELECT prof, lvl, y, sum(dz) OVER (PARTITION BY prof) FROM p))"
    out = "SELECT prof, lvl, round(depth, 4) AS depth FROM e"
    if centered:
        out = "SELECT prof, CAST(lvl + 1 AS INTEGER) AS lvl, round((depth + n) / 2, 4) AS depth FROM (SELECT *, lead(depth) OVER (PARTITION BY prof ORDER BY lvl) AS n FROM e) WHERE n IS NOT NULL"

    @query(name, f"WITH {LEVELS}, {edge} {out}")
    def _(spark, d):
        rows = levels(spark, d).withColumn("ref", F.lit(7.5))
        return grid.dz2depth(rows, ["prof"], "lvl", "dz", centered=centered, **options).select("prof", "lvl", r("depth").alias("depth"))


_dz2depth("dz2depth_down", "s", positive="down")
_dz2depth("dz2depth_up", "s - total", positive="up")
_dz2depth("dz2depth_up_ssh", "s - (total - 7.5)", positive="up", ref="ref", ref_type="top")
_dz2depth("dz2depth_down_bottom", "s - total + 7.5", positive="down", ref="ref", ref_type="bottom")
_dz2depth("dz2depth_centered", "s - total", centered=True, positive="up")


# Grid algebra along i within each row j.


@query("grid_centers", f"WITH {CELLS} SELECT * FROM (SELECT j, i, round((v + lead(v) OVER w) / 2, 4) AS v, lon + 1 AS lon FROM f WINDOW w AS (PARTITION BY j ORDER BY i)) WHERE i < 39")
def _(spark, d):
    return grid.centers(cells(spark, d), ["j"], "i", ["v", "lon"]).select("j", "i", r("v").alias("v"), "lon")


@query(
    "grid_edges",
    f"""WITH {CELLS}, e AS (SELECT j, i, v, lon FROM f UNION ALL SELECT j, -1, v, -2.0 FROM f WHERE i = 0 UNION ALL SELECT j, 40, v, 80.0 FROM f WHERE i = 39)
SELECT j, i, v, lon FROM (SELECT j, CAST(i AS INTEGER) AS i, round((v + lead(v) OVER w) / 2, 4) AS v, (lon + lead(lon) OVER w) / 2 AS lon, lead(i) OVER w AS n FROM e WINDOW w AS (PARTITION BY j ORDER BY i)) WHERE n IS NOT NULL""",
)
def _(spark, d):
    return grid.edges(cells(spark, d), ["j"], "i", ["v"], ["lon"]).select("j", "i", r("v").alias("v"), "lon")


@query(
    "grid_pad_extrap",
    f"""WITH {CELLS}, e AS (SELECT j, i, lon FROM f UNION ALL SELECT j, k, CAST(k AS DOUBLE) * 2 FROM (SELECT DISTINCT j FROM f), (SELECT unnest([-2, -1, 40]) AS k)) SELECT j, CAST(i AS INTEGER) AS i, lon FROM e""",
)
def _(spark, d):
    return grid.pad(cells(spark, d), ["j"], "i", [], 2, 1, coords=["lon"]).select("j", "i", "lon")


@query(
    "grid_shift_right",
    f"WITH {CELLS} SELECT j, i, round((v + coalesce_next) / 2, 4) AS v, lon + 1 AS lon FROM (SELECT *, CASE WHEN i = 39 THEN v ELSE lead(v) OVER (PARTITION BY j ORDER BY i) END AS coalesce_next FROM f)",
)
def _(spark, d):
    return grid.shift(cells(spark, d), ["j"], "i", ["v"], "right", ["lon"]).select("j", "i", r("v").alias("v"), "lon")


@query(
    "grid_shift_2d",
    f"""WITH {CELLS}, a AS (SELECT j, i, CASE WHEN i = 0 THEN v ELSE (v + lag(v) OVER (PARTITION BY j ORDER BY i)) / 2 END AS v FROM f)
SELECT j, i, round(CASE WHEN j = (SELECT min(j) FROM f) THEN v ELSE (v + lag(v) OVER (PARTITION BY i ORDER BY j)) / 2 END, 4) AS v FROM a""",
)
def _(spark, d):
    once = grid.shift(cells(spark, d), ["j"], "i", ["v"], "left")
    return grid.shift(once, ["i"], "j", ["v"], "left").select("j", "i", r("v").alias("v"))


@query("grid_diff", f"WITH {CELLS} SELECT * FROM (SELECT j, i, round(lead(v) OVER w - v, 4) AS v, lon + 1 AS lon FROM f WINDOW w AS (PARTITION BY j ORDER BY i)) WHERE i < 39")
def _(spark, d):
    return grid.diff(cells(spark, d), ["j"], "i", ["v"], ["lon"]).select("j", "i", r("v").alias("v"), "lon")


@query("grid_reverse", f"WITH {LEVELS} SELECT prof, CAST(count(*) OVER (PARTITION BY prof) + 1 - lvl AS INTEGER) AS lvl, v FROM l")
def _(spark, d):
    return grid.reverse(levels(spark, d), ["prof"], "lvl").select("prof", "lvl", "v")


@query("grid_sort", f"WITH {LEVELS} SELECT prof, CAST(row_number() OVER (PARTITION BY prof ORDER BY v DESC NULLS LAST, lvl) AS INTEGER) AS lvl, dz, v FROM l")
def _(spark, d):
    return grid.sort(levels(spark, d), ["prof"], "lvl", "v", ascending=False).select("prof", "lvl", "dz", "v")


@query(
    "grid_concat",
    f"WITH {CELLS}, h AS (SELECT max(j) + 1 AS n FROM f) SELECT j, i, v, NULL::DOUBLE AS lon FROM f UNION ALL SELECT CAST(j + n - 1 AS INTEGER), i, v, lon FROM f, h WHERE j >= 1 UNION ALL SELECT CAST(j + 2 * n - 1 AS INTEGER), i, NULL, lon FROM f, h",
)
def _(spark, d):
    """Three slabs along j, of which the second lacks its first row of cells."""
    field = cells(spark, d)
    parts = [field.select("j", "i", "v"), field.where("j >= 1").select("j", "i", "v", "lon"), field.select("j", "i", "lon")]
    return grid.concat(parts, "j").select("j", "i", "v", "lon")


@query("geo_stack", f"WITH {CELLS} SELECT j * 40 + i AS npts, lon, lat, v FROM f")
def _(spark, d):
    return grid.geo_stack(cells(spark, d), "j", "i", 40).select("npts", "lon", "lat", "v")


@query("to_rect", f"WITH {CELLS} SELECT 'x' AS axis, i AS idx, min(lon) AS coord FROM f GROUP BY i UNION ALL SELECT 'y', j, min(lat) FROM f GROUP BY j")
def _(spark, d):
    x, y = grid.to_rect(cells(spark, d), "j", "i")
    return x.select(F.lit("x").alias("axis"), F.col("i").alias("idx"), F.col("lon").alias("coord")).unionByName(
        y.select(F.lit("y").alias("axis"), F.col("j").alias("idx"), F.col("lat").alias("coord"))
    )


# Interpolation along profiles.

_PAIR = "v0 * d1 / (d0 + d1) + v1 * d0 / (d0 + d1)"
_CUBIC = "(vp - v1 - vm + v0) * mu * mu * mu + (vm - v0 - (vp - v1 - vm + v0)) * mu * mu + (v1 - vm) * mu + v0"
_HERMIT = """(2*mu*mu*mu - 3*mu*mu + 1) * v0 + (mu*mu*mu - 2*mu*mu + mu) * ((v0 - vm) / 2 + (v1 - v0) / 2)
 + (mu*mu*mu - mu*mu) * ((v1 - v0) / 2 + (vp - v1) / 2) + (3*mu*mu - 2*mu*mu*mu) * v1"""


def _regrid_sql(inner: str, last: str = "a.pv IS NOT NULL", extrap: str = "no", drop: bool = False, gap: int = 0) -> str:
    low = "WHEN yo < f THEN fv" if extrap in ("bottom", "both") else ""
    high = "WHEN yo > g THEN gv" if extrap in ("top", "both") else ""
    return f"""WITH {LEVELS}, {_T},
t AS (SELECT *, row_number() OVER (PARTITION BY prof ORDER BY y) AS i, min(CASE WHEN v IS NOT NULL THEN y END) OVER (PARTITION BY prof) AS f, max(CASE WHEN v IS NOT NULL THEN y END) OVER (PARTITION BY prof) AS g FROM p),
n AS (SELECT prof, y, v, i, lag(v) OVER w AS pv, lag(i) OVER w AS pi, lag(y) OVER w AS py, lead(v) OVER w AS nv, lead(y) OVER w AS ny FROM t
  WHERE y BETWEEN f AND g {'AND v IS NOT NULL' if drop else ''} WINDOW w AS (PARTITION BY prof ORDER BY y)),
k AS (SELECT prof, min(f) AS f, min(g) AS g, min(CASE WHEN y = f THEN v END) AS fv, min(CASE WHEN y = g THEN v END) AS gv FROM t GROUP BY prof),
b AS (SELECT k.prof, k.f, k.g, k.fv, k.gv, o.yo, arg_max(n, n.y) FILTER (n.y <= o.yo) AS a, arg_min(n, n.y) FILTER (n.y > o.yo) AS b
  FROM k CROSS JOIN o LEFT JOIN n ON n.prof = k.prof GROUP BY ALL),
q AS (SELECT *, a.v AS v0, b.v AS v1, yo - a.y AS d0, b.y - yo AS d1, (yo - a.y) / (b.y - a.y) AS mu, b.i - a.i - 1 AS gap,
  CASE WHEN a.py IS NULL THEN 2 * a.v - b.v ELSE coalesce(a.pv, a.v) END AS vm, CASE WHEN b.ny IS NULL THEN 2 * b.v - a.v ELSE coalesce(b.nv, b.v) END AS vp FROM b)
SELECT prof, yo AS y, round(CASE {low} {high} WHEN b.y IS NULL THEN CASE WHEN a.y = yo AND {last} THEN a.v END
  WHEN a.y IS NULL {f'OR gap > {gap}' if gap else ''} THEN NULL ELSE {inner} END, 3) AS v FROM q"""


def _regrid(name: str, sql: str, **options) -> None:
    @query(name, sql)
    def _(spark, d):
        out = regrid.regrid1d(levels(spark, d), ["prof"], "y", "v", TARGETS, **options)
        return out.select("prof", "y", r("v", 3).alias("v"))


_regrid("regrid_linear", _regrid_sql(_PAIR))
_regrid("regrid_nearest", _regrid_sql("CASE WHEN d0 <= d1 THEN v0 ELSE v1 END", "a.py IS NOT NULL"), method="nearest")
_regrid("regrid_cubic", _regrid_sql(_CUBIC), method="cubic")
_regrid("regrid_hermit", _regrid_sql(_HERMIT), method="hermit")
_regrid("regrid_extrap_top", _regrid_sql(_PAIR, extrap="top"), extrap="top")
_regrid("regrid_extrap_bottom", _regrid_sql(_PAIR, extrap="bottom"), extrap="bottom")
_regrid("regrid_extrap_both", _regrid_sql(_PAIR, extrap="both"), extrap="both")
_regrid("regrid_drop_na", _regrid_sql(_PAIR, drop=True), drop_na=True)
_regrid("regrid_maxgap", _regrid_sql(_PAIR, "a.pv IS NOT NULL AND a.i - a.pi <= 2", drop=True, gap=1), drop_na=True, maxgap=1)


@query(
    "extrap1d_both",
    f"""WITH {LEVELS}, t AS (SELECT *, min(CASE WHEN v IS NOT NULL THEN lvl END) OVER (PARTITION BY prof) AS f, max(CASE WHEN v IS NOT NULL THEN lvl END) OVER (PARTITION BY prof) AS g FROM p),
e AS (SELECT prof, min(CASE WHEN lvl = f THEN v END) AS fv, min(CASE WHEN lvl = g THEN v END) AS gv FROM t GROUP BY prof)
SELECT t.prof, lvl, CASE WHEN lvl < f THEN fv WHEN lvl > g THEN gv ELSE v END AS v FROM t JOIN e ON t.prof = e.prof""",
)
def _(spark, d):
    return regrid.extrap1d(levels(spark, d), ["prof"], "lvl", "v").select("prof", "lvl", "v")


def _cellave(name: str, value: str, **options) -> None:
    @query(
        name,
        f"""WITH {LEVELS}, e AS (SELECT unnest([0, 1, 2, 3])::INTEGER AS cell, unnest([0.0, 30.0, 60.0, 100.0])::DOUBLE AS a, unnest([30.0, 60.0, 100.0, 200.0])::DOUBLE AS b),
x AS (SELECT prof, cell, a, b, v, least(y, b) - greatest(y - dz, a) AS w FROM p JOIN e ON y > a AND y - dz < b WHERE v IS NOT NULL)
SELECT prof, cell, round({value}, 3) AS v FROM x GROUP BY prof, cell""",
    )
    def _(spark, d):
        rows = levels(spark, d).withColumn("lo", F.col("y") - F.col("dz"))
        out = regrid.cellave1d(rows, ["prof"], "lo", "y", "v", [0.0, 30.0, 60.0, 100.0, 200.0], **options)
        return out.select("prof", "cell", r("v", 3).alias("v"))


_cellave("regrid_cellave", "sum(v * w) / sum(w)")
_cellave("regrid_conserv", "sum(v * w / (b - a))", conserv=True)


def _isoslice(name: str, pick: str, reverse: bool) -> None:
    @query(
        name,
        f"""WITH {LEVELS}, x AS (SELECT prof, lvl, y AS x0, v AS v0, lead(y) OVER w AS x1, lead(v) OVER w AS v1 FROM p WINDOW w AS (PARTITION BY prof ORDER BY lvl)),
h AS (SELECT *, (v0 >= 30000 AND v1 <= 30000) OR (v0 <= 30000 AND v1 >= 30000) AS hit FROM x)
SELECT prof, round({pick}(CASE WHEN v0 = v1 THEN v0 ELSE x1 + (30000 - v1) * (x0 - x1) / (v0 - v1) END, lvl) FILTER (hit), 4) AS y FROM h GROUP BY prof""",
    )
    def _(spark, d):
        return regrid.isoslice(levels(spark, d), ["prof"], "lvl", "y", "v", 30000.0, reverse).select("prof", r("y").alias("y"))


_isoslice("isoslice_last", "arg_max", False)
_isoslice("isoslice_first", "arg_min", True)


def _mld(name: str, iso: str, **options) -> None:
    @query(
        name,
        f"""WITH {LEVELS}, u AS (SELECT prof, -y AS up, w AS v, last_value(w) OVER (PARTITION BY prof ORDER BY -y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top FROM p),
x AS (SELECT prof, up AS x0, v AS v0, lead(up) OVER s AS x1, lead(v) OVER s AS v1, {iso} AS iso FROM u WINDOW s AS (PARTITION BY prof ORDER BY up)),
h AS (SELECT *, (v0 >= iso AND v1 <= iso) OR (v0 <= iso AND v1 >= iso) AS hit FROM x)
SELECT prof, round(abs(arg_max(CASE WHEN v0 = v1 THEN v0 ELSE x1 + (iso - v1) * (x0 - x1) / (v0 - v1) END, x0) FILTER (hit)), 4) AS mld FROM h GROUP BY prof""",
    )
    def _(spark, d):
        rows = levels(spark, d).select("prof", "y", "w")
        return thermdyn.mixed_layer_depth(rows, ["prof"], "y", "w", positive="down", **options).select("prof", r("mld").alias("mld"))


_mld("mld_deltatemp", "top - 0.015", method="deltatemp", deltatemp=0.015)
_mld("mld_deltadens", "top + 0.015", method="deltadens", deltadens=0.015)
_mld("mld_kzmax", "0.035", method="kzmax", kzmax=0.035)


@query(
    "mld_zref",
    f"""WITH {LEVELS}, x AS (SELECT prof, -y AS x0, w * {SCALE} AS v0, lead(-y) OVER s AS x1, lead(w * {SCALE}) OVER s AS v1 FROM p WINDOW s AS (PARTITION BY prof ORDER BY -y)),
r AS (SELECT prof, v0 + (v1 - v0) * (-10.5 - x0) / (x1 - x0) - 0.01517 AS iso FROM x WHERE x0 <= -10.5 AND x1 > -10.5),
h AS (SELECT x.*, iso, (v0 >= iso AND v1 <= iso) OR (v0 <= iso AND v1 >= iso) AS hit FROM x LEFT JOIN r ON x.prof = r.prof)
SELECT prof, round(abs(arg_max(CASE WHEN v0 = v1 THEN v0 ELSE x1 + (iso - v1) * (x0 - x1) / (v0 - v1) END, x0) FILTER (hit)), 4) AS mld FROM h GROUP BY prof""",
)
def _(spark, d):
    """With the reference interpolated at a depth."""
    rows = levels(spark, d).select("prof", "y", (F.col("w") * SCALE).alias("w"))
    return thermdyn.mixed_layer_depth(rows, ["prof"], "y", "w", method="deltatemp", deltatemp=0.01517, positive="down", zref=10.5).select("prof", r("mld").alias("mld"))


# Filters.


def _conv2d(name: str, kernel: list[list[float]], na: float, normalize: bool, op) -> None:
    n, m = len(kernel), len(kernel[0])
    rows = ", ".join(f"({j - n // 2}, {i - m // 2}, {float(kernel[j][i])})" for j in range(n) for i in range(m) if kernel[j][i])
    total = sum(map(sum, kernel))
    cut = total * min(max(1e-6, 1 - na), 1 - 1e-6)
    value = "s / q" if normalize else "s"

    @query(
        name,
        f"""WITH {CELLS}, k(dj, di, w) AS (VALUES {rows}),
x AS (SELECT t.j, t.i, coalesce(sum(w * f.v), 0) AS s, coalesce(sum(CASE WHEN f.v IS NOT NULL THEN w END), 0) AS q FROM f t CROSS JOIN k LEFT JOIN f ON f.j = t.j - dj AND f.i = t.i - di GROUP BY t.j, t.i)
SELECT j, i, round(CASE WHEN q > {cut!r} THEN {value} END, 4) AS v FROM x""",
    )
    def _(spark, d):
        return op(cells(spark, d).select("j", "i", "v")).select("j", "i", r("v").alias("v"))


_ONES = [[1.0] * 3] * 3
_CROSS = filters.shapiro_kernel(2).tolist()
for _na in (0.0, 0.5, 1.0):
    _conv2d(f"convolve_2d_na{int(100 * _na)}", _ONES, _na, True, lambda df, na=_na: filters.convolve(df, [], ["j", "i"], "v", 3, True, na))
_conv2d("convolve_2d_plain", _ONES, 1.0, False, lambda df: filters.convolve(df, [], ["j", "i"], "v", 3, False, 1.0))
_conv2d("smooth_shapiro", _CROSS, 0.5, True, lambda df: filters.smooth(df, [], ["j", "i"], "v", na_thres=0.5))


def _erode_sql(times: int) -> str:
    rows = ", ".join(f"({j - 1}, {i - 1}, {float(_CROSS[j][i])})" for j in range(3) for i in range(3) if _CROSS[j][i])
    steps, last = [], "f"
    for n in range(times):
        steps.append(
            f"""e{n} AS (SELECT t.j, t.i, coalesce(any_value(t.v), CASE WHEN coalesce(sum(CASE WHEN u.v IS NOT NULL THEN w END), 0) > 6e-6 THEN sum(w * u.v) / sum(CASE WHEN u.v IS NOT NULL THEN w END) END) AS v
FROM {last} t CROSS JOIN k LEFT JOIN {last} u ON u.j = t.j - dj AND u.i = t.i - di GROUP BY t.j, t.i)"""
        )
        last = f"e{n}"
    return f"WITH {CELLS}, k(dj, di, w) AS (VALUES {rows}), {', '.join(steps)} SELECT j, i, round(v, 4) AS v FROM {last}"


def _erode(name: str, times: int) -> None:
    @query(name, _erode_sql(times))
    def _(spark, d):
        return filters.erode(cells(spark, d).select("j", "i", "v"), [], ["j", "i"], "v", times).select("j", "i", r("v").alias("v"))


_erode("erode_1", 1)
_erode("erode_2", 2)


@query(
    "convolve_1d",
    f"""WITH {LEVELS}, k(d, w) AS (VALUES (-1, 1.0), (0, 3.0), (1, 2.0)),
x AS (SELECT t.prof, t.lvl, coalesce(sum(k.w * u.v), 0) AS s, coalesce(sum(CASE WHEN u.v IS NOT NULL THEN k.w END), 0) AS q FROM p t CROSS JOIN k LEFT JOIN p u ON u.prof = t.prof AND u.lvl = t.lvl - d GROUP BY ALL)
SELECT prof, lvl, round(CASE WHEN q > 3.0 THEN s / q END, 4) AS v FROM x""",
)
def _(spark, d):
    import numpy as np

    out = filters.convolve(levels(spark, d), ["prof"], ["lvl"], "v", np.array([1.0, 3.0, 2.0]), True, 0.5)
    return out.select("prof", "lvl", r("v").alias("v"))


def _tidal(name: str) -> None:
    weights = filters.tidal_weights(name)
    half = len(weights) // 2
    rows = ", ".join(f"({i - half}, {w})" for i, w in enumerate(weights))

    @query(
        f"tidal_{name}",
        f"""WITH {HOURS}, k(d, w) AS (VALUES {rows}),
x AS (SELECT t.event_type, t.hour, coalesce(sum(w * u.value), 0) AS s, coalesce(sum(CASE WHEN u.value IS NOT NULL THEN w END), 0) AS q
  FROM h t CROSS JOIN k LEFT JOIN h u ON u.event_type = t.event_type AND u.hour = t.hour - to_hours(CAST(d AS INTEGER)) GROUP BY ALL)
SELECT event_type, hour, round(CASE WHEN q > {0.5 * sum(weights)} THEN s / q END, 4) AS value FROM x""",
    )
    def _(spark, d):
        out = filters.tidal_filter(hours(spark, d), ["event_type"], "hour", "value", name, 0.5)
        return out.select("event_type", "hour", r("value").alias("value"))


for _name in ("demerliac", "godin", "mean"):
    _tidal(_name)


@query(
    "resample_3h",
    "SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS start, round(avg(value * 1.0001237::DOUBLE), 4) AS value, count(value) AS n FROM events GROUP BY ALL",
)
def _(spark, d):
    events = table(spark, d, "events").withColumn("value", F.col("value") * SCALE)
    return resample(events, ["event_type"], "ts", "value").select("event_type", "start", r("value").alias("value"), "n")


_MEAN = len(filters.tidal_weights("mean"))


@query(
    "tidal_resample",
    f"""WITH {HOURS}, s AS (SELECT event_type, hour, avg(value) OVER w AS value, count(value) OVER w AS n FROM h
  WINDOW w AS (PARTITION BY event_type ORDER BY hour RANGE BETWEEN INTERVAL {_MEAN // 2} HOUR PRECEDING AND INTERVAL {_MEAN // 2} HOUR FOLLOWING))
SELECT event_type, hour, round(value, 4) AS value FROM s WHERE n > {0.5 * _MEAN}""",
)
def _(spark, d):
    events = table(spark, d, "events").withColumn("value", F.col("value") * SCALE)
    return tidal_resample(events, ["event_type"], "ts", "value", "mean", 0.5).select("event_type", "hour", r("value").alias("value"))


# Grids to points.


@query(
    "grid2loc_xy",
    f"""WITH {CELLS}, {POINTS}, u AS (SELECT id, (lon + 180) / 4.5 AS x, (lat + 85) / 10 AS y FROM c),
q AS (SELECT *, CAST(floor(x / 2) AS INTEGER) AS i, CAST(floor(y / 3) AS INTEGER) AS j FROM u WHERE x BETWEEN 0 AND 78 AND y BETWEEN 0 AND (SELECT max(lat) FROM f)),
k(di, dj) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
w AS (SELECT id, i + di AS i, j + dj AS j, (CASE WHEN di = 0 THEN 1 - (x - 2 * i) / 2 ELSE (x - 2 * i) / 2 END) * (CASE WHEN dj = 0 THEN 1 - (y - 3 * j) / 3 ELSE (y - 3 * j) / 3 END) AS w FROM q, k),
s AS (SELECT w.id, sum(w * f.v) AS v, count(f.v) AS got, count(*) AS need FROM w LEFT JOIN f ON f.i = w.i AND f.j = w.j WHERE w > 0 GROUP BY w.id)
SELECT c.id, round(CASE WHEN got = need THEN s.v END, 3) AS v FROM c LEFT JOIN s ON c.id = s.id""".replace("s AS (SELECT s_suppkey", "s0 AS (SELECT s_suppkey"),
)
def _(spark, d):
    points = customers(spark, d).select("id", ((F.col("lon") + 180) / 4.5).alias("lon"), ((F.col("lat") + 85) / 10).alias("lat"))
    return interp.grid2loc(cells(spark, d), points, {"i": "lon", "j": "lat"}, "v").select("id", r("v", 3).alias("v"))


# Where the points lie on the field, off its nodes.
_AT = f"""WITH {CELLS}, {POINTS}, n AS (SELECT max(i) AS ni, max(j) AS nj FROM f),
u AS (SELECT id, (lon + 180) / 4.5 + 0.0137 AS x, (lat + 85) / 10 + 0.0171 AS y, CAST(id % 53 AS DOUBLE) AS z FROM c),
g AS (SELECT u.*, {{i}} AS fi, {{j}} AS fj FROM u),
q AS (SELECT *, CAST(floor(fi) AS INTEGER) AS i, CAST(floor(fj) AS INTEGER) AS j FROM g, n WHERE fi BETWEEN 0 AND ni AND fj BETWEEN 0 AND nj),
k(di, dj) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
w AS (SELECT id, i + di AS i, j + dj AS j, (CASE WHEN di = 0 THEN 1 - (fi - i) ELSE fi - i END) * (CASE WHEN dj = 0 THEN 1 - (fj - j) ELSE fj - j END) AS w FROM q, k),
b AS (SELECT w.id, sum(w * f.v) AS v, count(f.v) AS got, count(*) AS need FROM w LEFT JOIN f ON f.i = w.i AND f.j = w.j WHERE w > 0 GROUP BY w.id),
a AS (SELECT id, CASE WHEN got = need THEN v END AS v FROM b)"""


def _on_field(spark: SparkSession, d: str) -> DataFrame:
    c = customers(spark, d)
    return c.select("id", ((F.col("lon") + 180) / 4.5 + 0.0137).alias("lon"), ((F.col("lat") + 85) / 10 + 0.0171).alias("lat"), (F.col("id") % 53).cast("double").alias("depth"))


@query(
    "grid2loc_levels",
    _AT.format(i="x / 2", j="y / 3")
    + """ SELECT u.id, round(CASE WHEN u.z / (10 + 0.1 * u.x + 0.05 * u.y) <= 5 THEN a.v * (1 + 0.1 * u.z / (10 + 0.1 * u.x + 0.05 * u.y)) END, 3) AS v FROM u LEFT JOIN a ON u.id = a.id""",
)
def _(spark, d):
    levels_ = F.explode(F.sequence(F.lit(0), F.lit(5)))
    field = cells(spark, d).withColumn("k", levels_).withColumn("depth", F.col("k") * (10 + 0.1 * F.col("lon") + 0.05 * F.col("lat")))
    field = field.withColumn("v", F.col("v") * (1 + 0.1 * F.col("k")))
    out = interp.grid2loc(field, _on_field(spark, d), {"i": "lon", "j": "lat"}, "v", level="k", level_coord="depth")
    return out.select("id", r("v", 3).alias("v"))


@query(
    "curvilinear2loc",
    _AT.format(i="(3 * x - 0.3 * y) / 5.97", j="(2 * y - 0.1 * x) / 5.97")
    + " SELECT u.id, round(coalesce(q.fi, -1), 5) AS p, round(coalesce(q.fj, -1), 5) AS q, round(a.v, 3) AS v FROM u LEFT JOIN q ON u.id = q.id LEFT JOIN a ON u.id = a.id",
)
def _(spark, d):
    field = cells(spark, d).withColumns({"lon": 2.0 * F.col("i") + 0.3 * F.col("j"), "lat": 3.0 * F.col("j") + 0.1 * F.col("i")})
    return interp.curvilinear2loc(field, _on_field(spark, d)).select("id", r("p", 5).alias("p"), r("q", 5).alias("q"), r("v", 3).alias("v"))


@query(
    "curvilinear_dateline",
    _AT.format(i="(3 * x - 0.3 * y) / 5.97", j="(2 * y - 0.1 * x) / 5.97")
    + " SELECT u.id, round(coalesce(q.fi, -1), 5) AS p, round(coalesce(q.fj, -1), 5) AS q, round(a.v, 3) AS v FROM u LEFT JOIN q ON u.id = q.id LEFT JOIN a ON u.id = a.id",
)
def _(spark, d):
    """The same grid and points turned to where the date line runs through them."""
    turned = lambda x: F.pmod(x + 151 + 180, F.lit(360.0)) - 180
    field = cells(spark, d).withColumns({"lon": turned(2.0 * F.col("i") + 0.3 * F.col("j")), "lat": 3.0 * F.col("j") + 0.1 * F.col("i")})
    out = interp.curvilinear2loc(field, _on_field(spark, d).withColumn("lon", turned(F.col("lon"))))
    return out.select("id", r("p", 5).alias("p"), r("q", 5).alias("q"), r("v", 3).alias("v"))


@query(
    "grid2loc_ring",
    f"""WITH {CELLS}, {POINTS}, u AS (SELECT id, ((lon + 360.37) % 360) / 9 AS x FROM c), q AS (SELECT id, CAST(floor(x) AS INTEGER) AS i, x - floor(x) AS a FROM u),
w AS (SELECT id, i, 1 - a AS w FROM q UNION ALL SELECT id, (i + 1) % 40, a FROM q)
SELECT w.id, f.j, round(CASE WHEN count(f.v) = 2 THEN sum(w * f.v) END, 3) AS v FROM w JOIN f ON f.i = w.i GROUP BY w.id, f.j""",
)
def _(spark, d):
    points = customers(spark, d).select("id", (F.col("lon") + 0.37).alias("lon"))
    field = cells(spark, d).withColumn("lon", F.col("i") * 9.0)
    return interp.grid2loc(field, points, {"i": "lon"}, "v", ["j"], period={"lon": 360.0}).select("id", "j", r_pairs("v", 3).alias("v"))


@query(
    "grid2loc_4d",
    _AT.format(i="x / 2", j="y / 3")
    + """, g4 AS (SELECT u.id, a.v, u.z, 10 + 0.1 * u.x + 0.05 * u.y + (u.id % 31) / 10.0 + 0.013 AS h, (u.id % 31) / 10.0 + 0.013 AS t FROM u LEFT JOIN a ON u.id = a.id)
SELECT id, round(CASE WHEN z / h <= 5 AND t <= 3 THEN v * (1 + 0.1 * z / h) * (1 + 0.2 * t) END, 3) AS v FROM g4""",
)
def _(spark, d):
    """Over longitude, latitude, time, and a depth whose levels move with all three."""
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    field = cells(spark, d).withColumn("k", steps(5)).withColumn("n", steps(3)).withColumn("time", F.col("n").cast("double"))
    field = field.withColumn("depth", F.col("k") * (10 + 0.1 * F.col("lon") + 0.05 * F.col("lat") + F.col("time")))
    field = field.withColumn("v", F.col("v") * (1 + 0.1 * F.col("k")) * (1 + 0.2 * F.col("time")))
    points = _on_field(spark, d).withColumn("time", F.col("id") % 31 / 10.0 + 0.013)
    out = interp.grid2loc(field, points, {"i": "lon", "j": "lat", "n": "time"}, "v", level="k", level_coord="depth")
    return out.select("id", r("v", 3).alias("v"))


# Dimensions.


def _pad_query(mode: str, low: str, high: str) -> None:
    @query(
        f"grid_pad_{mode}",
        f"""WITH {LEVELS}, q AS (SELECT prof, lvl, v, count(*) OVER (PARTITION BY prof) AS n FROM l)
SELECT prof, lvl, round(v, 4) AS v FROM q UNION ALL SELECT prof, 0, round(v, 4) FROM q WHERE {low} UNION ALL SELECT prof, CAST(n + 1 AS INTEGER), round(v, 4) FROM q WHERE {high}""",
    )
    def _(spark, d):
        return grid.pad(levels(spark, d), ["prof"], "lvl", ["v"], 1, 1, mode).select("prof", "lvl", r("v").alias("v"))


_pad_query("reflect", "lvl = 2", "lvl = n - 1")
_pad_query("symmetric", "lvl = 1", "lvl = n")
_pad_query("wrap", "lvl = n", "lvl = 1")


@query("iminmax", f"WITH {LEVELS} SELECT prof, coalesce(min(lvl) FILTER (v IS NOT NULL), 0) AS imin, coalesce(max(lvl) FILTER (v IS NOT NULL), 0) AS imax FROM l GROUP BY prof")
def _(spark, d):
    out = coords.iminmax(levels(spark, d), ["prof"], "lvl", "v")
    return out.select("prof", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("imin", "imax")])


@query("mask_counts", f"WITH {LEVELS} SELECT prof, CAST(sum(CAST(v IS NULL AS INTEGER)) AS BIGINT) AS masked, count(*) AS total, bool_or(v IS NULL) AS any_masked FROM l GROUP BY prof")
def _(spark, d):
    return coords.mask_counts(levels(spark, d), ["prof"], "v")


@query("time_mean", f"WITH {HOURS} SELECT event_type, round(avg(value), 4) AS value FROM h GROUP BY event_type")
def _(spark, d):
    return coords.reduce_mean(hours(spark, d), ["event_type"], "value").select("event_type", r("value").alias("value"))


@query("ensemble_std", f"WITH {HOURS} SELECT hour, round(stddev_pop(value), 4) AS value FROM h GROUP BY hour")
def _(spark, d):
    return coords.reduce_std(hours(spark, d), ["hour"], "value").select("hour", r("value").alias("value"))


@query(
    "rate_of_change",
    f"""WITH {HOURS}, x AS (SELECT *, lag(value) OVER w AS v0, lead(value) OVER w AS v1, lag(hour) OVER w AS t0, lead(hour) OVER w AS t1 FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour))
SELECT event_type, hour, round((CASE WHEN t1 IS NULL THEN value ELSE v1 END - CASE WHEN t0 IS NULL THEN value ELSE v0 END) / (epoch(coalesce(t1, hour)) - epoch(coalesce(t0, hour))) * 3600, 4) AS value FROM x""",
)
def _(spark, d):
    out = coords.rate_of_change(hours(spark, d), ["event_type"], "hour", ["value"])
    return out.select("event_type", "hour", F.round(F.col("value") * 3600, 4).alias("value"))


@query("unravel_index", f"WITH {CELLS}, x AS (SELECT CAST(j AS BIGINT) * 40 + i AS place FROM f) SELECT place, place // 40 AS j, place % 40 AS i FROM x")
def _(spark, d):
    rows = cells(spark, d).select(coords.ravel_index(["j", "i"], [1 << 20, 40]).alias("place"))
    j, i = coords.unravel_index("place", [1 << 20, 40])
    return rows.select("place", j.alias("j"), i.alias("i"))


@query("decode_dz2depth", f"WITH {LEVELS} SELECT prof, lvl, round(y - dz / 2, 6) AS depth FROM p")
def _(spark, d):
    frame = GridFrame(levels(spark, d).select("prof", "lvl", "dz"), ("prof", "lvl"), types={"lvl": "z"})
    frame, name = coords.get_depth(coords.decode_dz2depth(frame, "down"))
    return frame.df.select("prof", "lvl", r(name, 6).alias("depth"))


# Geostatistics.


@query("variogram_pairs", f"WITH {POINTS} SELECT round({hav('a', 'b')} / 1000, 4) AS dist, round(0.5 * (b.value - a.value) * (b.value - a.value), 3) AS gamma FROM s a JOIN s b ON a.id < b.id")
def _(spark, d):
    return geostat.variogram_pairs(suppliers(spark, d), most=None).select(r_pairs("dist", 4).alias("dist"), r_pairs("gamma", 3).alias("gamma"))


@query(
    "variogram_bins",
    f"""WITH {POINTS}, x AS (SELECT a.id AS ia, b.id AS ib, {hav('a', 'b')} / 1000 AS dist, 0.5 * (b.value - a.value) * (b.value - a.value) AS gamma FROM s a JOIN s b ON a.id < b.id),
u AS (SELECT round(dist * 1000, 3) AS d, arg_min(dist, (ia, ib)) AS dist, arg_min(gamma, (ia, ib)) AS gamma FROM x GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS r, (SELECT count(*) FROM u) AS n FROM u),
z AS (SELECT any_value(n) AS n, least(any_value(n), 8) AS nb FROM r),
e AS (SELECT CAST(i AS INTEGER) AS bin, CAST(floor(i * (n - 1) / nb) AS BIGINT) AS a, CAST(floor((i + 1) * (n - 1) / nb) AS BIGINT) AS b FROM z, (SELECT unnest(range(0, 8)) AS i) WHERE i < nb)
SELECT bin, round(avg(dist), 3) AS dist, round(avg(gamma), 2) AS gamma FROM r JOIN e ON r.r BETWEEN e.a AND e.b GROUP BY bin""",
)
def _(spark, d):
    out = geostat.empirical_variogram(suppliers(spark, d), nbin=8, nbin0=1, most=None)
    return out.select("bin", r("dist", 3).alias("dist"), r("gamma", 2).alias("gamma"))


@query(
    "variogram_models",
    f"""WITH {POINTS}, x AS (SELECT id, abs(value) / 1000 AS h FROM c)
SELECT id, round(0.2 + 1.8 * least(h / 5, 1.0), 6) AS linear, round(0.2 + 1.8 * (1 - exp(-3 * h / 5)), 6) AS exponential, round(0.2 + 1.8 * (1 - exp(-3 * h * h / 25)), 6) AS gaussian,
round(0.2 + 1.8 * (CASE WHEN h / 5 <= 1 THEN 1.5 * h / 5 - 0.5 * (h / 5) * (h / 5) * (h / 5) ELSE 1 END), 6) AS spherical FROM x""",
)
def _(spark, d):
    h = F.abs("value") / 1000
    return customers(spark, d).select("id", *[r(variogram.model(k, h, 0.2, 2.0, 5.0), 6).alias(k) for k in variogram.MODELS])


@query("clusterize")
def _(spark, d):
    out = geostat.clusterize(suppliers(spark, d), 40)
    return out.select("id", F.count(F.lit(1)).over(Window.partitionBy("cluster")).alias("size"))


@query("clusterize_bounded", f"WITH {POINTS} SELECT id, true AS fits FROM s")
def _(spark, d):
    out = geostat.clusterize(suppliers(spark, d), 40)
    sizes = out.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    return out.join(sizes, "cluster").select("id", (F.col("_n") <= 40).alias("fits"))


@query(
    "cluster_stats",
    f"""WITH {POINTS}, k AS (SELECT c.*, customer.c_nationkey AS cluster FROM c JOIN customer ON c.id = customer.c_custkey), m AS (SELECT cluster, avg(lon) AS mx, avg(lat) AS my FROM k GROUP BY cluster)
SELECT k.cluster, count(*) AS size, round(min(mx), 6) AS lon, round(min(my), 6) AS lat, round(avg(sqrt((lon - mx) * (lon - mx) + (lat - my) * (lat - my))), 6) AS distortion FROM k JOIN m ON k.cluster = m.cluster GROUP BY k.cluster""",
)
def _(spark, d):
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster"))
    out = geostat.cluster_stats(customers(spark, d).join(nation, "id"))
    return out.select("cluster", "size", r("lon", 6).alias("lon"), r("lat", 6).alias("lat"), r("distortion", 6).alias("distortion"))


@query(
    "variogram_near",
    f"""WITH {POINTS} SELECT a.id AS id_a, b.id AS id_b, round({hav('a', 'b')} / 1000, 4) AS dist, round(abs(b.value - a.value), 3) AS gamma FROM s a JOIN s b ON a.id < b.id
WHERE {hav('a', 'b')} / 1000 <= 1500.123""",
)
def _(spark, d):
    pairs = geostat.variogram_pairs(suppliers(spark, d), most=None, distmax=1500.123, errfunc=lambda a, b: F.abs(b - a))
    return pairs.select(F.col("_a").alias("id_a"), F.col("_b").alias("id_b"), r_pairs("dist", 4).alias("dist"), r_pairs("gamma", 3).alias("gamma"))


@query(
    "krig_two_nearest",
    f"""WITH {POINTS}, x AS (SELECT c.id, s.id AS sid, s.lon, s.lat, s.value AS z, round({hav('c', 's')}, 6) AS d FROM c, s),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, sid DESC) AS k FROM x QUALIFY k <= 2),
a AS (SELECT * FROM n WHERE k = 1), b AS (SELECT * FROM n WHERE k = 2),
g AS (SELECT a.id, a.z AS z1, b.z AS z2, a.d / 4e7 AS g1, b.d / 4e7 AS g2, {hav('a', 'b')} / 4e7 AS g12 FROM a JOIN b ON a.id = b.id),
w AS (SELECT *, 0.5 + (g2 - g1) / (2 * g12) AS w FROM g)
SELECT id, round(w * z1 + (1 - w) * z2, 3) AS value, round(greatest(w * g1 + (1 - w) * g2 + g1 - g12 * (1 - w), 1e-12), 6) AS error FROM w""",
)
def _(spark, d):
    """Ordinary kriging from two points has a closed form."""
    model = geostat.VariogramModel("linear", n=0.0, s=1.0, r=40_000.0)
    out = geostat.krig(suppliers(spark, d), customers(spark, d), model, neighbours=2)
    return out.select("id", r("value", 3).alias("value"), r("error", 6).alias("error"))


_GAMMA = "(CASE WHEN {d} = 0 THEN 0 ELSE 0.1 + 0.9 * {d} / 4e7 END)"


@query(
    "krig_exact",
    f"""WITH {POINTS}, x AS (SELECT c.id, s.id AS sid, s.lon, s.lat, s.value AS z, {hav('c', 's')} AS d FROM c, s),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 6), sid DESC) AS k FROM x QUALIFY k <= 2),
a AS (SELECT * FROM n WHERE k = 1), b AS (SELECT * FROM n WHERE k = 2), e AS (SELECT a.id, a.z AS z1, b.z AS z2, a.d AS d1, b.d AS d2, {hav('a', 'b')} AS d12 FROM a JOIN b ON a.id = b.id),
w AS (SELECT id, z1, z2, 0.5 + ({_GAMMA.format(d='d2')} - {_GAMMA.format(d='d1')}) / (2 * {_GAMMA.format(d='d12')}) AS w FROM e)
SELECT id, round(w * z1 + (1 - w) * z2, 3) AS value FROM w""",
)
def _(spark, d):
    """A value at a point is the point's, whatever the nugget."""
    model = geostat.VariogramModel("linear", n=0.1, s=1.0, r=40_000.0)
    out = geostat.krig(suppliers(spark, d), customers(spark, d), model, neighbours=2, exact=True)
    return out.select("id", r("value", 3).alias("value"))


@query("krig_ordinary")
def _(spark, d):
    model = geostat.VariogramModel("exponential", n=0.0, s=1e7, r=3000.0)
    out = geostat.krig(suppliers(spark, d), customers(spark, d), model, npmax=60)
    return out.select("id", r("value", 3).alias("value"), r("error", 3).alias("error"))


@query(
    "decimate_pick",
    f"""WITH RECURSIVE {POINTS},
l(step, id, lon, lat, value, keep) AS (
  SELECT 0, id, lon, lat, value, (SELECT min(id) FROM c) FROM c
  UNION ALL
  SELECT step + 1, id, lon, lat, value, min(id) OVER () FROM (
    SELECT a.* FROM l a JOIN l b ON b.id = b.keep WHERE {hav('a', 'b')} >= 600000.0))
SELECT id, lon, lat, value FROM l WHERE id = keep""",
)
def _(spark, d):
    return filters.decimate(customers(spark, d), 600_000.0)


def _tracks_sql() -> str:
    """Steps over the field of the query, whose u depends on the longitude alone and v on the latitude alone."""
    scale = "(180 / (pi() * 6371e3))"
    part = lambda f, x, w: f"((1 - ({x} / {w} - floor({x} / {w}))) * {f}(radians({w} * floor({x} / {w}))) + ({x} / {w} - floor({x} / {w})) * {f}(radians({w} * (floor({x} / {w}) + 1))))"
    slope = lambda n, x, y: f"{part('sin', x, 2)} * {scale} AS u{n}, {part('cos', y, 3)} * {scale} * cos(radians({y})) AS v{n}"
    k1 = f"SELECT *, {slope(1, 'lon', 'lat')} FROM t WHERE seconds < 25200"
    k2 = f"SELECT *, {slope(2, '(lon + 1800 * u1)', '(lat + 1800 * v1)')} FROM ({k1})"
    k3 = f"SELECT *, {slope(3, '(lon + 1800 * u2)', '(lat + 1800 * v2)')} FROM ({k2})"
    k4 = f"SELECT *, {slope(4, '(lon + 1800 * u3)', '(lat + 1800 * v3)')} FROM ({k3})"
    return f"""WITH RECURSIVE {POINTS}, t(id, seconds, lon, lat) AS (SELECT id, 0.0::DOUBLE, id % 70 + 2.5::DOUBLE, id % 9 + 1.5::DOUBLE FROM s UNION ALL
SELECT id, seconds + 3600, lon + 600 * (u1 + u2 + u3 + u4), lat + 600 * (v1 + v2 + v3 + v4) FROM ({k4}))
SELECT id, seconds, round(lon, 6) AS lon, round(lat, 6) AS lat FROM t"""


@query("flow2d_tracks", _tracks_sql())
def _(spark, d):
    field = cells(spark, d).select(
        F.col("j").alias("i_y"), F.col("i").alias("i_x"), "lon", "lat", F.sin(F.radians("lon")).alias("u"), F.cos(F.radians("lat")).alias("v")
    )
    seeds = suppliers(spark, d).select("id", (F.col("id") % 70 + 2.5).alias("lon"), (F.col("id") % 9 + 1.5).alias("lat"))
    return flow2d(field, seeds, 7 * 3600.0, 3600.0).select("id", "seconds", r("lon", 6).alias("lon"), r("lat", 6).alias("lat"))


# Names and attributes.


@query(
    "decode_sigma_locations",
    f"""WITH {_SIG}, a AS (SELECT id, eta, h, (eta + coalesce(lead(eta) OVER w, eta)) / 2 AS eta_u, (h + coalesce(lead(h) OVER w, h)) / 2 AS h_u FROM o2 WINDOW w AS (ORDER BY id))
SELECT id, k, round(eta + sig * (eta + h), 4) AS depth, round(eta_u + sig * (eta_u + h_u), 4) AS depth_u, round(2 * eta + sig * (2 * eta + h + 1), 4) AS depth_v FROM a, k""",
)
def _(spark, d):
    """Levels at three locations of one frame: v has columns of its own, u lies between a column and the next."""
    terms = {"standard_name": "ocean_sigma_coordinate", "formula_terms": "sigma: sig eta: eta depth: h"}
    columns = GridFrame(_sea_columns(spark, d), ("id",)).averaged(["eta", "h"], "u", "id").df
    rows = _by_levels(columns).withColumn("sig", F.col("sig").alias("sig", metadata=terms))
    rows = rows.withColumns({"eta_v": 2 * F.col("eta"), "h_v": F.col("h") + 1})
    out = GridFrame(rows, ("id", "k"), ("sig",)).decode_sigma(hlocs=[None, "u", "v"], average={"u": "id"}).df
    return out.select("id", "k", *[r(c).alias(c) for c in ("depth", "depth_u", "depth_v")])


@query(
    "regrid_nd",
    f"""WITH {LEVELS}, e AS (SELECT o.l_orderkey AS prof, max(l_orderkey % 7) AS shift FROM lineitem o GROUP BY o.l_orderkey),
g AS (SELECT prof, lvl, lvl * 10.0 + shift AS y, v FROM l JOIN e USING (prof)), n AS (SELECT *, lead(y) OVER w AS y1, lead(v) OVER w AS v1, lag(v) OVER w AS v0 FROM g WINDOW w AS (PARTITION BY prof ORDER BY y)),
z AS (SELECT prof, m, CAST(k AS INTEGER) AS k, k * 7.3 + m AS yo FROM e, (SELECT unnest(range(0, 2))::INTEGER AS m), (SELECT unnest(range(0, 6)) AS k))
SELECT z.prof, z.m, z.k, round(z.yo, 3) AS y, round(n.v + (n.v1 - n.v) * (z.yo - n.y) / (n.y1 - n.y), 3) AS v FROM z LEFT JOIN n ON n.prof = z.prof AND n.y <= z.yo AND z.yo < n.y1""",
)
def _(spark, d):
    """Values by profile, levels whose depth changes by profile, and targets that change along a dimension of their own."""
    data = levels(spark, d).select("prof", "lvl", "v")
    source = data.select("prof", "lvl", (F.col("lvl") * 10.0 + F.col("prof") % 7).alias("y"))
    target = spark.range(12).select((F.col("id") % 2).cast("int").alias("m"), F.floor(F.col("id") / 2).cast("int").alias("k"))
    target = target.withColumn("y", F.col("k") * 7.3 + F.col("m"))
    out = regrid.regrid1d_nd(data, source, target, ["prof", "m"], "lvl", "k", "y", "v")
    return out.select("prof", "m", "k", r("y", 3).alias("y"), r("v", 3).alias("v"))


@query(
    "regrid_hermit_tension",
    _regrid_sql("""(2*mu*mu*mu - 3*mu*mu + 1) * v0 + (mu*mu*mu - 2*mu*mu + mu) * ((v0 - vm) * 1.2 * 0.7 / 2 + (v1 - v0) * 0.8 * 0.7 / 2)
 + (mu*mu*mu - mu*mu) * ((v1 - v0) * 1.2 * 0.7 / 2 + (vp - v1) * 0.8 * 0.7 / 2) + (3*mu*mu - 2*mu*mu*mu) * v1"""),
)
def _(spark, d):
    out = regrid.regrid1d(levels(spark, d), ["prof"], "y", "v", TARGETS, method="hermit", bias=0.2, tension=0.3)
    return out.select("prof", "y", r("v", 3).alias("v"))


@query(
    "convolve_separable",
    f"""WITH {CELLS}, k(dj, di, w) AS (SELECT a.d, b.d, a.w * b.w FROM (VALUES (-2, 1.0), (-1, 2.0), (0, 3.0), (1, 2.0), (2, 1.0)) a(d, w), (VALUES (-3, 1.0), (-2, 1.0), (-1, 1.0), (0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)) b(d, w)),
x AS (SELECT t.j, t.i, coalesce(sum(w * f.v * {SCALE}), 0) AS s, coalesce(sum(CASE WHEN f.v IS NOT NULL THEN w END), 0) AS q FROM f t CROSS JOIN k LEFT JOIN f ON f.j = t.j - dj AND f.i = t.i - di GROUP BY t.j, t.i)
SELECT j, i, round(CASE WHEN q > 25.2 THEN s / q END, 4) AS v FROM x""",
)
def _(spark, d):
    field = cells(spark, d).select("j", "i", (F.col("v") * SCALE).alias("v"))
    out = filters.convolve(field, [], ["j", "i"], "v", {"j": [1.0, 2.0, 3.0, 2.0, 1.0], "i": 7}, True, 0.6)
    return out.select("j", "i", r("v").alias("v"))


@query("meta_decode", f"WITH {CELLS} SELECT i AS i, j AS j, lon, lat, v AS temp FROM f")
def _(spark, d):
    raw = cells(spark, d).select("i", "j", F.col("lon").alias("nav_lon"), F.col("lat").alias("latitude"), F.col("v").alias("temperature"))
    return MetaSpecs.default().decode(raw)


@query("meta_encode", f"WITH {CELLS} SELECT i, j, lon AS mylon, lat AS mylat, v AS mytemp_t FROM f")
def _(spark, d):
    own = {"data_vars": {"temp": {"name": "mytemp"}}, "coords": {"lon": {"name": "mylon"}, "lat": {"name": "mylat"}}}
    specs = MetaSpecs.from_dict("my", own)
    raw = cells(spark, d).select("i", "j", "lon", "lat", F.col("v").alias("temp_t"))
    return specs.encode(raw)


@query("meta_best_match", f"WITH {CELLS} SELECT i, j, lon, lat, v AS temp FROM f")
def _(spark, d):
    """Cells under the names of their quantities, by the one of two specifications that matches the columns better."""
    raw = cells(spark, d).select("i", "j", F.col("lon").alias("mylon"), F.col("lat").alias("mylat"), F.col("v").alias("mytemp"))
    own = lambda n, lon, temp: MetaSpecs.from_dict(n, {"coords": {"lon": {"name": lon}, "lat": {"name": "mylat"}}, "data_vars": {"temp": {"name": temp}}})
    best = max((own("a", "x", "t"), own("b", "mylon", "mytemp")), key=lambda s: s.score(raw))
    return best.decode(raw)


@query("meta_score", "SELECT 75.0::DOUBLE AS score, 25.0::DOUBLE AS other")
def _(spark, d):
    make = lambda n, coords, data: MetaSpecs.from_dict(n, {"coords": {k: {"name": v} for k, v in coords.items()}, "data_vars": {k: {"name": v} for k, v in data.items()}})
    raw = cells(spark, d).select(F.col("lon").alias("mylon"), F.col("lat").alias("mylat"), F.col("v").alias("mytemp"), F.col("v").alias("mysal"))
    a = make("a", {"lon": "mylon", "lat": "mylat"}, {"temp": "mytemp"})
    b = make("b", {}, {"sal": "mysal"})
    return spark.createDataFrame([(a.score(raw), b.score(raw))], "score double, other double")


@query(
    "decode_sigma",
    f"WITH {_SIG} SELECT id, k, round(eta + sig * (eta + h), 4) AS depth FROM o2, k",
)
def _(spark, d):
    terms = {"standard_name": "ocean_sigma_coordinate", "formula_terms": "sigma: sig eta: eta depth: H"}
    rows = _columns_by_levels(spark, d).withColumn("sig", F.col("sig").alias("sig", metadata=terms))
    frame = GridFrame(rows, ("id", "k"), ("sig",)).decode_sigma()
    return frame.df.select("id", "k", r("depth").alias("depth"))
