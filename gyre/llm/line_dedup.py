"""Removal of boilerplate lines by the number of distinct sites that carry them.

A line's key is two 64-bit hashes of its stripped bytes. Distinct sites are counted by HyperLogLog sketches,
built before the shuffle and merged after it, so that a line found everywhere costs one sketch a task.
Lines whose estimate is far above the threshold are boilerplate, and those far below are not; those near it
get their exact number of distinct sites. Marked lines are then cut out of the texts.

Cases: a null text stays null and has no lines; a null site counts as a site of its own; blank lines are
never removed; rows that repeat an identifier, or have none, are cut by their own text; all columns of
the input come back, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.functions.arrays import let
from gyre.llm.session import written

#: Distinct sites from which a line is boilerplate.
SITES = 5
#: Base-2 logarithm of a sketch's registers: a standard error of 0.8 % for many sites; a few are counted exactly.
LOG_K = 14
#: Share of the threshold around it within which the exact count decides: over ten standard errors.
NEAR = 0.25


def _keys(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(1), line).alias("_h2")]


def boilerplate(df: DataFrame, text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """Keys (_h1, _h2) and number of sites of the lines found on ``sites`` or more distinct sites."""
    lines = _lines(df, text_col, site_col)
    counted = lines.groupBy("_h1", "_h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", LOG_K)).alias("_n"))
    low, high = sites * (1 - NEAR), sites * (1 + NEAR)
    rough = counted.where(F.col("_n") >= F.lit(low))
    sure = rough.where(F.col("_n") > F.lit(high)).select("_h1", "_h2")
    near = rough.where(F.col("_n") <= F.lit(high)).select("_h1", "_h2")
    exact = (
        lines.join(near, ["_h1", "_h2"], "left_semi")
        .groupBy("_h1", "_h2", "_site")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= sites)
        .select("_h1", "_h2")
    )
    return sure.unionByName(exact)


def _lines(df: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """Keys and site of every line that is not blank, once for each text."""
    split = F.array_distinct(F.transform(F.split(F.col(text_col), "\n"), _strip))
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))
    lines = df.select(F.explode(split).alias("_line"), site.alias("_site")).where("_line <> ''")
    return lines.select(*_keys(F.col("_line")), "_site")


def _strip(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def line_dedup(
    df: DataFrame, text_col: str = "text", site_col: str = "source", sites: int = SITES, counts: bool = False
) -> DataFrame:
    """``df`` with the boilerplate lines cut out of its texts.

    ``counts`` adds ``n_lines`` and ``n_removed``, the lines of the text (blank ones too) and those cut out.
    """
    bad = written(boilerplate(df, text_col, site_col, sites), "boilerplate")
    row = [F.xxhash64(F.col(text_col)).alias("__gyre_r1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("__gyre_r2")]
    placed = df.select(*row, F.posexplode(F.split(F.col(text_col), "\n")).alias("_at", "_line")).withColumn("_line", _strip(F.col("_line")))
    placed = placed.where("_line <> ''").select("__gyre_r1", "__gyre_r2", "_at", *_keys(F.col("_line")))
    cut = placed.join(bad, ["_h1", "_h2"], "left_semi").groupBy("__gyre_r1", "__gyre_r2").agg(F.collect_set("_at").alias("__gyre_cut"))
    lines = F.split(F.col(text_col), "\n")
    # A difference of sets of places: in proportion to the lines, however many are cut.
    places = lambda every: F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("__gyre_cut"))
    left = let(lines, lambda every: F.array_join(F.transform(places(every), lambda i: F.get(every, i)), "\n"))
    text = F.when(F.col("__gyre_cut").isNull(), F.col(text_col)).otherwise(left)
    joined = df.withColumns({"__gyre_r1": row[0], "__gyre_r2": row[1]}).join(cut, ["__gyre_r1", "__gyre_r2"], "left")
    out = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if counts:
        out += [
            F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("__gyre_cut"), F.lit(0)).cast("long").alias("n_removed"),
        ]
    return joined.select(*out)
