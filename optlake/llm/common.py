"""Small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from optlake.session import cut_lineage

#: A word is a run of characters other than the six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, kept when executors go."""
    return cut_lineage(df)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    edges = F.substring(text, 1, 1).rlike(BLANK).cast("long") + F.substring(text, -1, 1).rlike(BLANK).cast("long")
    return F.when(F.length(text) > 0, F.size(F.split(text, BLANK + "+")).cast("long") - edges).otherwise(F.lit(0).cast("long"))


def fold(column: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(key: Column, modulus: int) -> Column:
    """The 32-bit CRC of a value written as text, modulo ``modulus``."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` from 0 in the given order. Sorted by ranges in many tasks;
    only one count per task meets in one place."""
    parts = stored(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    counts = parts.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return parts.join(counts, "_part").withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_n", "_before")
