"""Thermodynamic variables found by what they are, and the mixed-layer depth from their profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from gyre.errors import MetaError
from gyre.meta import specs as meta
from gyre.operators.regrid import isoslice, profiles, usable, value_at

# The generic names that are a temperature, a salinity, a density or a sea level, in the order of preference.
VARIANTS = {
    "temp": ("temp", "ptemp", "ctemp"), "sal": ("sal", "psal", "asal", "pfsal"), "dens": ("dens", "sigmat", "sigmatheta", "ndens", "pdens", "sigma0", "sigma1", "sigma2", "sigma3", "sigma4"),
    "sea_level": ("ssh", "adt", "sla", "mdt", "mss"),
}


def is_variant(f: StructField, kind: str, variants: tuple[str, ...] | None = None) -> bool:
    """Whether a field is a temperature ("temp"), salinity ("sal"), density ("dens") or sea level ("sea_level")."""
    s = meta.current()
    return any(s.match_item(f, s.items["data_vars"][v], "data_vars") for v in variants or VARIANTS[kind])


def find_variant(df: DataFrame, kind: str, variants: tuple[str, ...] | None = None, errors: str = "ignore") -> str | None:
    """The first column that is a temperature, salinity, density or sea level, by the order of the variants."""
    return meta.variant(df, variants or VARIANTS[kind], errors)


def is_temp(f: StructField) -> bool:
    return is_variant(f, "temp")


def is_sal(f: StructField) -> bool:
    return is_variant(f, "sal")


def is_dens(f: StructField) -> bool:
    return is_variant(f, "dens")


def get_temp(df: DataFrame, errors: str = "ignore") -> str | None:
    return find_variant(df, "temp", errors=errors)


def get_sal(df: DataFrame, errors: str = "ignore") -> str | None:
    return find_variant(df, "sal", errors=errors)


def get_dens(df: DataFrame, errors: str = "ignore") -> str | None:
    return find_variant(df, "dens", errors=errors)


def get_sea_level(df: DataFrame, errors: str = "ignore") -> str | None:
    return find_variant(df, "sea_level", errors=errors)


def method_of(f: StructField) -> str:
    """The way to find the mixed layer that suits a column, by what it is."""
    for kind, method in (("temp", "deltatemp"), ("dens", "deltadens")):
        if is_variant(f, kind):
            return method
    s = meta.current()
    if f.name.lower() in ("kz", "akt") or any(s.match_item(f, s.items["data_vars"][k], "data_vars") for k in ("kz", "akt") if k in s.items["data_vars"]):
        return "kzmax"
    raise MetaError(f"{f.name} is no temperature, density or mixing; give the method")


def mixed_layer_depth(
    df: DataFrame, keys: list[str], depth: str, v: str, method: str | None = None, deltatemp: float = 0.2, deltadens: float = 0.03, kzmax: float = 5e-4, positive: str = "up", zref: float = 0.0
) -> DataFrame:
    """Depth where the temperature has dropped, the density risen, or the mixing faded from its surface value: keys, mld.

    ``depth`` rises towards the surface (``positive`` up) or away from it (down); the crossing nearest to the
    surface counts, and the result is positive. Other than at the surface the reference value is that interpolated
    at the depth ``zref``, given as ``depth`` is.
    """
    method = method or method_of(df.schema[v])
    change = -deltatemp if method == "deltatemp" else deltadens
    up = F.col(depth) if positive == "up" else -F.col(depth)
    rows = df.select(*keys, up.alias("_up"), F.col(v).alias("_v"))
    if method == "kzmax":
        iso = F.lit(kzmax)
    elif zref:
        # The nodes come as arrays and go back to rows, in one shuffle by the keys.
        nodes = profiles(rows, keys, "_up", "_v").withColumn("_n", usable(F.col("nodes"), False))
        nodes = nodes.withColumn("_ref", value_at(F.col("_n"), F.lit(float(zref if positive == "up" else -zref))))
        rows = nodes.select(*keys, "_ref", F.explode("nodes").alias("_x")).select(*keys, "_ref", F.col("_x.y").alias("_up"), F.col("_x.v").alias("_v"))
        iso = F.col("_ref") + change
    else:
        w = Window.partitionBy(*keys).orderBy("_up").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        iso = F.last("_v").over(w) + change
    rows = rows.withColumn("_iso", iso)
    return isoslice(rows, keys, "_up", "_up", "_v", F.col("_iso")).select(*keys, F.abs("_up").alias("mld"))
