"""Ordered rules over options and proposals: first match wins.

Rules are short lists given by the user, so they become one CASE expression inside the
scan's stage: no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optlake.functions.globs import shell_rlike

# fixed values: confidence a proposal needs, by aggression
CONFIDENCE_FLOOR = {"conservative": 0.85, "balanced": 0.65, "aggressive": 0.40}

# fixed values: options that are never trimmed
CORE_OPTIONS = [
    "CONFIG_PRINTK",
    "CONFIG_TTY",
    "CONFIG_VT",
    "CONFIG_VT_CONSOLE",
    "CONFIG_UNIX98_PTYS",
    "CONFIG_DEVTMPFS",
    "CONFIG_DEVTMPFS_MOUNT",
    "CONFIG_TMPFS",
    "CONFIG_PROC_FS",
    "CONFIG_SYSFS",
    "CONFIG_FUTEX",
    "CONFIG_EPOLL",
    "CONFIG_SIGNALFD",
    "CONFIG_TIMERFD",
    "CONFIG_EVENTFD",
    "CONFIG_BLOCK",
    "CONFIG_MULTIUSER",
    "CONFIG_PRINTK_SAFE_LOG_BUF_SHIFT",
    "CONFIG_BLK_DEV_INITRD",
    "CONFIG_RD_GZIP",
    "CONFIG_RD_LZ4",
    "CONFIG_RD_ZSTD",
    "CONFIG_MMU",
    "CONFIG_SWAP",
    "CONFIG_SHMEM",
    "CONFIG_CGROUPS",
    "CONFIG_CGROUP_SCHED",
    "CONFIG_CGROUP_CPUACCT",
    "CONFIG_CGROUP_MEMORY",
    "CONFIG_CGROUP_PIDS",
    "CONFIG_CGROUP_FREEZER",
    "CONFIG_CGROUP_DEVICE",
    "CONFIG_MODULES",
    "CONFIG_MODULE_UNLOAD",
    "CONFIG_HW_RANDOM",
]

# fixed values: options an architecture cannot run without
ARCH_OPTIONS = {
    "x86_64": ["64BIT", "X86_64", "X86", "SMP"],
    "aarch64": ["64BIT", "ARM64", "SMP"],
    "armv7l": ["ARM", "SMP"],
    "ppc64le": ["PPC64", "PPC", "SMP"],
    "riscv64": ["64BIT", "RISCV", "SMP"],
}


def first_match(cases: list[tuple[Column, object]], default) -> Column:
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(default) if out is None else out.otherwise(default)


def subsystem(symbol: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Bucket of an option by ordered ``(name, patterns)`` rules, else ``misc``."""
    name = F.regexp_replace(symbol, "^CONFIG_", "")
    return first_match([(name.rlike("|".join(f"(?:{p})" for p in patterns)), label) for label, patterns in rules], "misc")


def above_floor(proposals: DataFrame, aggression: str) -> DataFrame:
    return proposals.where(F.col("confidence") >= CONFIDENCE_FLOOR[aggression])


@dataclass(frozen=True)
class Rule:
    """One review rule; an axis left at its default matches everything."""

    label: str
    decision: str
    risk: tuple[str, ...] | None = None
    source: tuple[str, ...] | None = None
    subsystems: tuple[str, ...] | None = None
    globs: tuple[str, ...] = ()
    min_confidence: float | None = None
    max_confidence: float | None = None

    def condition(self, bucket: Column) -> Column:
        tests = [F.lit(True)]
        if self.risk is not None:
            tests.append(F.col("risk").isin(*self.risk))
        if self.source is not None:
            tests.append(F.col("source").isin(*self.source))
        if self.subsystems is not None:
            tests.append(bucket.isin(*self.subsystems))
        if self.globs:
            tests.append(reduce(lambda a, b: a | b, [shell_rlike(F.col("config"), g) for g in self.globs]))
        if self.min_confidence is not None:
            tests.append(F.col("confidence") >= self.min_confidence)
        if self.max_confidence is not None:
            tests.append(F.col("confidence") <= self.max_confidence)
        return reduce(lambda a, b: a & b, tests)


ACCEPT_RECOMMENDED = [
    Rule("accept-recommended-not-high-risk", "accept", risk=("low", "medium")),
    Rule("defer-high-risk", "defer", risk=("high",)),
]
ACCEPT_LOW_RISK = [Rule("accept-low-risk", "accept", risk=("low",))]
ACCEPT_DETERMINISTIC = [Rule("accept-deterministic", "accept", source=("deterministic",))]


def reject_subsystems(names: list[str]) -> Rule:
    return Rule("reject-subsystems:" + ",".join(sorted(names)), "reject", subsystems=tuple(names))


def reject_patterns(patterns: list[str]) -> Rule:
    return Rule("reject-pattern:" + ",".join(patterns), "reject", globs=tuple(patterns))


def review(proposals: DataFrame, rules: list[Rule], subsystem_rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Add ``decision`` and ``rule`` of the first matching rule; unmatched ones defer."""
    bucket = F.col("subsystem")
    return proposals.withColumn("subsystem", subsystem(F.col("config"), subsystem_rules)).select(
        "*",
        first_match([(r.condition(bucket), r.decision) for r in rules], "defer").alias("decision"),
        first_match([(r.condition(bucket), r.label) for r in rules], "unmatched").alias("rule"),
    )


def load_bearing(sources: list[DataFrame]) -> DataFrame:
    """Union of ``(host, symbol, reason)`` sources; the earliest source names the reason."""
    ranked = [s.select("host", "symbol", "reason", F.lit(i).alias("rank")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked).groupBy("host", "symbol").agg(F.min_by("reason", F.struct("rank", "reason")).alias("reason"))


def first_evidence(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first value recorded for each key; later ones do not replace it."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(value), F.min(order).alias(order))


def apply_policy(proposals: DataFrame, autonomy: str, bearing: DataFrame) -> DataFrame:
    """Outcome of every proposal: blocked, annotation, auto_applied or needs_review."""
    sure = F.col("source").isin("deterministic", "microarch") & (F.col("confidence") >= 0.95)
    auto = {
        "advise": sure,
        "auto-safe": (F.col("risk") == "low") & (F.col("confidence") >= 0.9),
        "auto-bold": F.col("risk") != "high",
    }
    open_outcome = F.lit("annotation") if autonomy == "explain" else F.when(auto[autonomy], "auto_applied").otherwise("needs_review")
    marked = proposals.join(bearing.select("host", F.col("symbol").alias("config"), F.col("reason").alias("bearing")), ["host", "config"], "left")
    return marked.withColumn("outcome", F.when(F.col("bearing").isNotNull(), "blocked").otherwise(open_outcome))


def review_counts(items: DataFrame, decision: str | None = None, bucket: str | None = None) -> DataFrame:
    """Per host: decisions over all items, and items visible under the filters."""
    visible = F.lit(True)
    if decision is not None:
        visible = visible & (F.col("decision") == decision)
    if bucket is not None:
        visible = visible & (F.col("subsystem") == bucket)
    count = lambda d: F.count_if(F.col("decision") == d)
    return items.groupBy("host").agg(
        count("accept").alias("accepted"), count("reject").alias("rejected"), count("defer").alias("deferred"), F.count_if(visible).alias("visible")
    )


def first_appearance(items: DataFrame) -> DataFrame:
    """Subsystems per host in order of first appearance."""
    first = items.groupBy("host", "subsystem").agg(F.min("position").alias("first"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("first")))


def recipes_for(symbols: DataFrame, workload: DataFrame, threat: DataFrame) -> DataFrame:
    """Recipe entries of both axes that touch the given ``(host, symbol, workload, threat)``."""
    perf = symbols.join(workload, ["workload", "symbol"]).select("host", "symbol", "recommended", F.lit("workload").alias("axis"))
    safe = symbols.join(threat, ["threat", "symbol"]).select("host", "symbol", "recommended", F.lit("threat").alias("axis"))
    return perf.unionByName(safe)


def eligible_knobs(knobs: DataFrame, allowlist: DataFrame, recipes: DataFrame) -> DataFrame:
    """Knobs on the allowlist or in an active recipe; a choice counts by any option."""
    allowed = allowlist.select("symbol").unionByName(recipes.select("symbol")).distinct()
    direct = knobs.join(allowed, "symbol", "left_semi")
    live = direct.where("kind = 'choice'").select("choice").distinct()
    plain = direct.where("kind <> 'choice'")
    return plain.unionByName(knobs.where("kind = 'choice'").join(live, "choice", "left_semi").select(*plain.columns))


def capability_mapping(leaves: DataFrame, declared: DataFrame) -> DataFrame:
    """Per capability: options named, and whether all of them are declared."""
    known = declared.select("symbol").distinct().withColumn("known", F.lit(True))
    return leaves.select("capability", "symbol").distinct().join(known, "symbol", "left").groupBy("capability").agg(
        F.count(F.lit(1)).alias("symbols"), F.bool_and(F.coalesce("known", F.lit(False))).alias("available")
    )


def knob_surface(choices: DataFrame, toggles: DataFrame, tunables: DataFrame) -> DataFrame:
    """One row per option with the kind of knob it is."""
    kinds = (("choice", choices), ("toggle", toggles), ("tunable", tunables))
    return reduce(DataFrame.unionByName, [df.select("symbol", "type", F.lit(k).alias("kind")) for k, df in kinds])


def keep_needed_sources(decisions: DataFrame, bearing: DataFrame) -> DataFrame:
    """A trim decision on a load-bearing source becomes keep."""
    marked = decisions.join(bearing.select("source").distinct().withColumn("needed", F.lit(True)), "source", "left")
    forced = F.coalesce("needed", F.lit(False)) & (F.col("action") == "trim")
    return marked.select("source", F.when(forced, "keep").otherwise(F.col("action")).alias("action"), forced.alias("forced"))
