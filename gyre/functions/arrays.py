"""Helpers for columns of arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_upto(rising: Column, n: int, value: Column) -> Column:
    """How many of an array's ``n`` rising numbers are at most the value, by halving."""

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        open_, below = state["lo"] < state["hi"], F.get(rising, middle) <= value
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when(open_ & ~below, middle).otherwise(state["hi"]).alias("hi"),
        )

    zero = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), zero, step)["lo"]
