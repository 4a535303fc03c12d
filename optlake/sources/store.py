"""Guard store and reports on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "objects": "tree long, path string, guard_id string, kind string",
    "guard_nodes": "tree long, node_id string, op string, symbol string, want string, level int",
    "guard_edges": "tree long, parent string, child string",
}


def write_store(path: str, **tables: DataFrame) -> None:
    """Clustered by tree, so that a query on some trees skips the other files."""
    for name, df in tables.items():
        cols = [c.split()[0] for c in TABLES[name].split(", ")]
        df.select(*cols).repartitionByRange("tree").sortWithinPartitions("tree").write.mode("errorifexists").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}


def write_report(rows: DataFrame, path: str, by: list[str]) -> None:
    """One JSON folder per value of ``by``, e.g. subject and variant. The files are packed, as
    every line repeats the names of its fields."""
    rows.write.mode("errorifexists").partitionBy(*by).json(path, compression="gzip")
