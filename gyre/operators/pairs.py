"""Joins whose output is far larger than their input, cut into blocks of which two meet in a task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.scratch import written

#: Rows of one block of a side, about: where the pairs are few, and where they are many.
BLOCK, LARGE = 1000, 2000
#: Tasks of a join at most.
TASKS = 20_000
#: Rows of one place or key, and rows that they meet, which go as one row of arrays; all their pairs are in memory at once.
PIECE, RUN = 64, 32


def _side(pairs: float, cores: int, least: int = 1) -> int:
    """Rows of a block of either side: all cores get work, and tasks of many pairs stay small until there are ``TASKS`` of them."""
    return math.ceil(max(least, min(LARGE, math.sqrt(pairs / cores)), math.sqrt(pairs / TASKS)))


def _arrays(rows: DataFrame, by: list[str], own: list[str], size: int, name: str) -> DataFrame:
    """The columns ``own`` of rows that are equal in ``by`` as arrays ``name``, in their order, of up to ``size`` rows."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*own))
    return rows.withColumn("_s", F.floor((number - 1) / size)).groupBy(*by, "_s").agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name)).drop("_s")


def _packed(rows: DataFrame, parts: int, at: list[str], own: list[str], size: int, name: str) -> DataFrame:
    """``_arrays`` of rows that are equal in ``at``, in ``parts`` ranges of ``at`` and ``own``."""
    rows = rows.repartitionByRange(parts, *at, *own).withColumn("_b", F.spark_partition_id()).repartitionById(parts, "_b")
    # Each range is read by many tasks.
    return _arrays(rows, ["_b", *at], own, size, name).repartitionById(parts, "_b").select(*at, name)


def crossed(left: DataFrame, right: DataFrame, at: list[str], once: dict[str, Column], less: tuple[str, str] | None = None) -> DataFrame:
    """Each row of ``left`` with each of ``right``; the columns ``once`` follow from a row of ``left`` and from ``at`` of ``right``.

    ``once`` is worked out for all rows at a place at a time: those of ``right`` that are equal in ``at``, of which nothing is
    left in the result. ``less`` are a column of either side of which the former must be less. Ranges of rows meet two by two
    where they are read, and no row is copied for it, so that disk grows with the input and memory stays the same. The rows of
    ``left`` are dealt by the order of their columns; equal values that come first there lie together in the result.
    """
    n, m = left.count(), right.count()
    side = _side(float(n) * m, left.sparkSession.sparkContext.defaultParallelism)
    own = [c for c in right.columns if c not in at]
    some = _packed(left, max(1, -(-n // side)), [], left.columns, RUN, "_left")
    places = _packed(right, max(1, -(-m // side)), at, own, PIECE, "_right")
    if less:
        places = places.withColumn("_most", F.array_max(F.transform("_right", lambda r: r[less[1]])))
    both = places.hint("shuffle_replicate_nl").crossJoin(some).select(*places.columns, F.inline("_left"))
    if less:
        both = both.where(F.col(less[0]) < F.col("_most"))
    out = both.select(*left.columns, *[c.alias(k) for k, c in once.items()], "_right").select(*left.columns, *once, F.inline("_right"))
    return out.where(F.col(less[0]) < F.col(less[1])) if less else out


def met(left: DataFrame, right: DataFrame, keys: list[str], block: int | None = None) -> DataFrame:
    """``left.join(right, keys)``, with the rows of a key dealt to blocks of about ``block`` rows on either side.

    Each two blocks of a key meet on their own, so neither a common key nor few rows in few files leave the work to
    few tasks; their number follows that of the pairs. Rows of a block go as arrays, so that few rows are copied, sorted and
    joined. Without ``block`` it is ``BLOCK``, or up to twice as many where that leaves all cores work. Without ``keys`` every
    row meets every other one.
    """
    if not keys:
        return met(left.withColumn("_k", F.lit(0)), right.withColumn("_k", F.lit(0)), ["_k"], block).drop("_k")
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    # Keys are met by number: constant ones, which the planner would strike out, no longer match how rows are dealt.
    sizes = written(sizes.withColumn("_key", F.monotonically_increasing_id()), "pair-sizes")
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
    cores = left.sparkSession.sparkContext.defaultParallelism
    block = block or _side(pairs, cores, BLOCK)
    tasks = int(min(TASKS, max(cores, pairs // block**2 + 1)))
    blocks = [F.ceil(F.col(c) / block).cast("int").alias(to) for c, to in (("_n", "_p"), ("_m", "_q"))]
    sizes = sizes.select(*keys, "_key", *blocks)

    def dealt(rows: DataFrame, at: str, of: str, to: str, copies: str, size: int, name: str) -> DataFrame:
        rows = rows if set(rows.columns) - set(keys) else rows.withColumn("_none", F.lit(0))
        own = [c for c in rows.columns if c not in keys]
        placed = rows.join(sizes, keys).withColumn(at, F.pmod(F.xxhash64(*rows.columns), F.col(of)).cast("int"))
        arrays = _arrays(placed, ["_key", at, copies, *keys], own, size, name)
        return arrays.withColumn(to, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop(copies).repartition(tasks, "_key", "_i", "_j")

    a, b = dealt(left, "_i", "_p", "_j", "_q", PIECE, "_left"), dealt(right, "_j", "_q", "_i", "_p", RUN, "_right")
    # A side is larger than the planner takes it for, so it must not be broadcast. A condition without generated code keeps the
    # arrays from being exploded inside the join, which would hold all pairs of a row of arrays at once.
    full = F.forall(F.array(F.size("_left"), F.size("_right")), lambda n: n > 0)
    both = a.join(b.drop(*keys).hint("merge"), ["_key", "_i", "_j"]).where(full).select(*keys, "_left", F.inline("_right"))
    rest = [c for c in right.columns if c not in keys]
    return both.select(*keys, *rest, F.inline("_left")).select(*left.columns, *rest)
