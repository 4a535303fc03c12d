"""Exact medians of groups of any size.

Approximate percentiles bracket the middle of each group; the bracket is cut into ranges,
whose counts (and the count below it) tell which range holds the middle, and only that
range is ordered. Outliers fall outside the bracket and don't widen its ranges, so no task
sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def middle_values(df: DataFrame, keys: list[str], value: str, ranges: int = 4096) -> DataFrame:
    """``(keys, n, lower, upper)``: the two middle values of each group, equal for odd n.
    The median is their mean, the upper-middle convention is ``upper``."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    counts = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    # the middle lies within: the ranks are exact to a ten-thousandth
    bracket = F.percentile_approx("v", [0.49, 0.51], 10_000).alias("b")
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bracket).select(*keys, "n", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0] if same else F.lit(True)
    for c in same[1:]:
        on = on & c
    spread = F.col("hi") - F.col("lo")
    binned = counts.alias("a").join(bounds.alias("b"), on).select(
        *[F.col(f"a.{k}").alias(k) for k in keys], "v", "c", "n",
        F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), ranges + 1)
        .when(spread > 0, F.floor((F.col("v") - F.col("lo")) / spread * ranges)).otherwise(0).alias("bin"),
    )
    per_bin = binned.groupBy(*keys, "n", "bin").agg(F.sum("c").alias("size"))
    upto = F.sum("size").over(Window.partitionBy(*keys).orderBy("bin"))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    hit = per_bin.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("size")).where(
        ((F.col("before") < lower) & (lower <= F.col("upto"))) | ((F.col("before") < upper) & (upper <= F.col("upto")))
    )
    cond = F.col("a.bin") == F.col("b.bin")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    inside = binned.alias("a").join(hit.alias("b"), cond).select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.v", "a.c", "a.n", "a.bin", "b.before")
    last = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "bin").orderBy("v"))
    ranked = inside.withColumn("last", last).withColumn("first", F.col("last") - F.col("c") + 1)
    pick = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("v")))
    return ranked.groupBy(*keys, "n").agg(pick(lower).alias("lower"), pick(upper).alias("upper"))


def median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return middle_values(df, keys, value).select(*keys, ((F.col("lower") + F.col("upper")) / 2).alias("median"))
