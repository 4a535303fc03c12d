"""Build plan of a set of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optlake.operators import packages as p
from optlake.operators.graph import build_waves


def plan_world(installed: DataFrame, sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """Units to build: ``(source, version, binaries, deps, wave, in_cycle, cost,
    use_stock)`` for the sources of the installed binaries that the index knows."""
    mapped = p.binary_sources(installed, sources).where("known")
    sizes = mapped.groupBy("source").agg(F.countDistinct("binary").alias("binaries"), F.sum("installed_kb").alias("kb"))
    edges = p.closure_edges(sources, sizes)
    waves = build_waves(sizes.select(F.col("source").alias("name")), edges)
    deps = edges.groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("deps"))
    return (
        sizes.join(sources.select("source", "version"), "source").join(waves.withColumnRenamed("name", "source"), "source")
        .join(deps, "source", "left").join(overrides.select("source", "use_stock"), "source", "left")
        .select("source", "version", "binaries", F.coalesce("deps", F.lit(0)).alias("deps"), "wave", "in_cycle", p.cost_class(F.col("source"), F.col("kb")).alias("cost"),
                F.coalesce("use_stock", F.lit(False)).alias("use_stock"))
    )
