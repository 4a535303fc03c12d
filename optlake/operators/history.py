"""Histories of repeated builds: trends, convergence and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fitness_trend(history: DataFrame, metric: str) -> DataFrame:
    """Percent change to the previous iteration; a missing value resets the comparison."""
    prev = F.lag(metric).over(Window.partitionBy("host").orderBy("iteration"))
    return history.withColumn("prev", prev).select(
        "host", "iteration", metric,
        F.round(F.when(F.col("prev") > 0, (F.col(metric) - F.col("prev")) / F.col("prev") * 100), 1).alias("change_pct"),
    )


def converged(history: DataFrame, metric: str, window: int = 2, threshold_pct: float = 1.0) -> DataFrame:
    """Are the last ``window`` steps of each host all within the threshold? A missing
    value or a zero to compare with means no."""
    order = Window.partitionBy("host").orderBy("iteration")
    back = Window.partitionBy("host").orderBy(F.desc("iteration"))
    prev = F.lag(metric).over(order)
    ok = F.coalesce((F.col("prev") != 0) & (F.abs(F.col(metric) - F.col("prev")) / F.col("prev") <= threshold_pct / 100), F.lit(False))
    steps = history.withColumn("prev", prev).withColumn("back", F.row_number().over(back)).withColumn("ok", ok)
    return steps.groupBy("host").agg(
        ((F.count(F.lit(1)) > window) & F.bool_and(F.when(F.col("back") <= window, F.col("ok")).otherwise(True))).alias("converged")
    )


def is_regression(build_ok: Column, boot_ok: Column) -> Column:
    return ~build_ok | F.coalesce(~boot_ok, F.lit(False))


def do_not_repeat(history: DataFrame, proposals: DataFrame) -> DataFrame:
    """Options proposed in an iteration that regressed."""
    bad = history.where("regressed").select("host", "iteration")
    return proposals.join(bad, ["host", "iteration"], "left_semi").select("host", "symbol").distinct()


def selected_history(history: DataFrame, recent: int) -> DataFrame:
    """First record of each host and its last ``recent`` ones."""
    first = F.row_number().over(Window.partitionBy("host").orderBy("iteration"))
    last = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("iteration")))
    return history.withColumn("f", first).withColumn("l", last).where((F.col("f") == 1) | (F.col("l") <= recent)).drop("f", "l")


def trajectory(history: DataFrame, metric: str, target: str) -> DataFrame:
    """First against last value of iterations that did not regress."""
    known = history.where(F.col(metric).isNotNull() & ~F.col("regressed"))
    ends = known.groupBy("host").agg(F.min_by(metric, "iteration").alias("first"), F.max_by(metric, "iteration").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    change = (F.col("last") - F.col("first")) / F.col("first") * 100
    edge = 5.0 if target == "boot-time" else 1.0
    steady = F.lit("stable") if target == "size" else F.lit(None).cast("string")
    return ends.select("host", "n", F.when(change > edge, "grown").when(change < -edge, "shrinking").otherwise(steady).alias("trajectory"))


def compile_seconds(log: Column) -> Column:
    """Duration of the first finished make step in a build log's step table."""
    hit = F.regexp_extract(log, r"(?im)^.*\b(?:make-\w+)\b[^\n]*?│\s*0\s*│\s*([\d.]+)\s*│", 1)
    return F.nullif(hit, F.lit("")).try_cast("double")


def measurements(iterations: DataFrame, logs: DataFrame, boots: DataFrame, landed: DataFrame) -> DataFrame:
    """One record per (host, iteration); what was not measured stays null."""
    key = ["host", "iteration"]
    passed = F.col("verdict_ok")
    return (
        iterations.join(logs.select(*key, compile_seconds(F.col("log")).alias("compile_s")), key, "left")
        .join(boots.select(*key, "verdict_ok", "duration_s", "verdict_reason"), key, "left")
        .join(landed.select(*key, "proposed", "landed"), key, "left")
        .select(*key, "size_bytes", "compile_s", passed.alias("boot_passed"), F.col("duration_s").alias("boot_s"),
                F.when(passed == F.lit(False), F.coalesce(F.nullif("verdict_reason", F.lit("")), F.lit("unknown"))).alias("boot_failure"), "proposed", "landed")
    )


def phase_gaps(marks: DataFrame) -> DataFrame:
    """Time since the previous phase that was recorded; missing phases are skipped."""
    prev = F.last("stamp", ignorenulls=True).over(Window.partitionBy("run").orderBy("phase").rowsBetween(Window.unboundedPreceding, -1))
    return marks.withColumn("gap", F.col("stamp") - prev)


def boot_seconds(log: Column) -> Column:
    """Kernel, userspace and total seconds of the "Startup finished" line."""
    number = lambda unit: rf"([\d.]+)\s*{unit}"
    def part(name):
        text = F.regexp_extract(log, rf"((?:[\d.]+\s*(?:min|ms|s)\s*)+)\({name}\)", 1)
        read = lambda unit, scale: F.coalesce(F.regexp_extract(text, number(unit) + r"(?![a-z])", 1).try_cast("double") * scale, F.lit(0.0))
        return F.when(text != "", read("min", 60.0) + read("ms", 0.001) + read("s", 1.0))
    kernel, user = part("kernel"), part("userspace")
    return F.when(log.contains("Startup finished"), F.struct(kernel.alias("kernel"), user.alias("userspace"), (kernel + user).alias("total")))


def phase_marks(log: Column) -> Column:
    """``KEY=NNN`` lines of a log as a map."""
    pairs = F.regexp_extract_all(log, F.lit(r"(?m)^([A-Za-z]+=\d+)\s*$"), 1)
    return F.map_from_entries(F.transform(F.array_distinct(pairs), lambda p: F.struct(F.split(p, "=")[0], F.split(p, "=")[1].cast("bigint"))))
