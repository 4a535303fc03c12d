"""Three-valued option algebra: n < m < y as 0, 1, 2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tri(value: Column) -> Column:
    return F.when(value == "y", 2).when(value == "m", 1).when(value == "n", 0)


def text(level: Column) -> Column:
    return F.when(level == 2, "y").when(level == 1, "m").when(level == 0, "n")


def tri_and(a: Column, b: Column) -> Column:
    return F.least(a, b)


def tri_or(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def tri_not(a: Column) -> Column:
    return F.lit(2) - a


def select_force(selector: Column, condition: Column) -> Column:
    """How far a ``select`` with a condition raises its target."""
    return F.least(selector, condition)


def is_unmet(force: Column, limit: Column) -> Column:
    """The selected value lies above what the target's dependencies allow."""
    return limit < force


def to_bool(a: Column) -> Column:
    return a >= 1


def is_unmet_bool(selector: Column, condition: Column, limit: Column) -> Column:
    """The same question after collapsing m and y, which misses force y over limit m."""
    return to_bool(selector) & to_bool(condition) & ~to_bool(limit)


def to_dual(a: Column) -> Column:
    return F.struct((a >= 1).alias("on"), (a == 2).alias("built_in"))


def from_dual(d: Column) -> Column:
    return F.when(d["built_in"], 2).when(d["on"], 1).otherwise(0)


def dual_ok(d: Column) -> Column:
    """built_in implies on."""
    return ~d["built_in"] | d["on"]
