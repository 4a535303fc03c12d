"""Requirement report of a candidate configuration against its baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def requirement_report(pairs: DataFrame, requirements: DataFrame, holding: DataFrame, lines: DataFrame, base: DataFrame, effective: DataFrame, rejected: DataFrame, strict: bool = True) -> DataFrame:
    """Per pair ``(merge_id, tree, base_id, next_id)``: violations of the candidate and of
    the baseline, requests without effect, duplicate assignments, lines of either input
    that no rule took and the first of the candidate's, status.

    ``holding`` are ``(tree, config_id, holds)``, the number of requirements that hold,
    ``rejected`` are ``(config_id, line_no, line, reason)``. A candidate without violations
    is ``incomplete`` if a line of it was not understood, since that may have been an
    option; without ``strict`` such lines are only counted."""
    total = requirements.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
    holds = holding.groupBy("config_id").agg(F.sum("holds").alias("holds"))
    repeated = lines.groupBy("config_id", "symbol").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    duplicates = repeated.groupBy("config_id").agg(F.count(F.lit(1)).alias("duplicates"))
    now = effective.withColumnRenamed("value", "now")
    ineffective = (
        base.join(now, ["merge_id", "symbol"], "left")
        .groupBy("merge_id")
        .agg(F.count_if(F.coalesce("now", F.lit("n")) != F.col("value")).alias("ineffective"))
    )
    unread = rejected.groupBy("config_id").agg(F.count(F.lit(1)).alias("unread"), F.min(F.struct("line_no", "reason")).alias("first"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        pairs.join(total, "tree", "left")
        .join(holds.select(F.col("config_id").alias("base_id"), F.col("holds").alias("base_holds")), "base_id", "left")
        .join(holds.select(F.col("config_id").alias("next_id"), F.col("holds").alias("next_holds")), "next_id", "left")
        .join(duplicates.withColumnRenamed("config_id", "base_id"), "base_id", "left")
        .join(ineffective, "merge_id", "left")
        .join(unread.select(F.col("config_id").alias("base_id"), F.col("unread").alias("base_unread")), "base_id", "left")
        .join(unread.select(F.col("config_id").alias("next_id"), F.col("unread").alias("next_unread"), "first"), "next_id", "left")
        .withColumn("violations", zero("total") - zero("next_holds"))
        .select(
            "merge_id", "violations", (zero("total") - zero("base_holds")).alias("baseline_violations"), zero("ineffective").alias("ineffective"),
            zero("duplicates").alias("duplicates"), zero("next_unread").alias("unparsed"), zero("base_unread").alias("baseline_unparsed"),
            F.concat_ws(": ", "first.line_no", "first.reason").alias("first_unparsed"),
            F.when(F.col("violations") > 0, "violation").when(F.lit(strict) & (zero("next_unread") > 0), "incomplete").otherwise("pass").alias("status"),
        )
    )
