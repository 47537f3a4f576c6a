"""Gives the package to the Python workers of a cluster, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers through Spark's own file server, once per application."""
    context = spark.sparkContext
    if getattr(context, "_gyre_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(top):  # imported from an archive that has been sent already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="gyre-"), "gyre.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith((".py", ".txt")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("gyre", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._gyre_shipped = True
