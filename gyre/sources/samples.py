"""Tables from files by their suffix."""

from __future__ import annotations

import difflib
import fnmatch
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.sources.netcdf import open_netcdf


_SAMPLES: dict[str, dict] = {}


def register_sample(name: str, path: str, **options) -> None:
    """Make a table known by a name, with the options of ``open_sample``; the same name again replaces it."""
    _SAMPLES[name] = {"path": path, **options}


def sample_names(pattern: str = "*") -> list[str]:
    """The names of the registered samples that match a pattern, in order."""
    return sorted(fnmatch.filter(_SAMPLES, pattern))


def get_sample(spark: SparkSession, name: str, **options) -> DataFrame:
    """A registered sample; options given here come before those registered."""
    if name not in _SAMPLES:
        close = difflib.get_close_matches(name, _SAMPLES)
        raise KeyError(f"no sample {name!r}" + (f"; there is {', '.join(close)}" if close else ""))
    return open_sample(spark, **{**_SAMPLES[name], **options})


def open_sample(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None, skip_units: bool = False) -> DataFrame:
    """A Parquet, ORC, JSON, CSV or NetCDF classic table; CSV has a header.

    ``skip_units`` drops the row of units below the header of a CSV with a schema: a row none of whose values that
    should be numbers or times is one. Other rows that do not fit the schema stay, with missing values.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == "csv":
        df = reader.option("header", True).csv(path)
        typed = [f.name for f in df.schema.fields if f.dataType.typeName() != "string"]
        if skip_units and typed:
            df = df.where(" OR ".join(f"`{c}` IS NOT NULL" for c in typed))
    elif suffix == "nc":
        return open_netcdf(spark, path, columns)
    elif suffix in ("parquet", "orc", "json"):
        df = getattr(reader, suffix)(path)
    else:
        raise ValueError(f"no reader for {suffix!r}")
    return df.select(*columns) if columns else df


def as_float(c: Column, kind: str) -> Column:
    """A column as a double: times as microseconds since 1950-01-01, NaN as missing."""
    if kind.startswith("timestamp"):
        return (F.unix_micros(c.cast("timestamp")) - F.unix_micros(F.lit("1950-01-01 00:00:00").cast("timestamp"))).cast("double")
    x = c.cast("double")
    return F.when(~F.isnan(x), x)
