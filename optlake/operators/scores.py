"""Scores of predicted against built objects, and statistics over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optlake.functions.median import median, middle_values
from optlake.operators import guards as g
from optlake.session import cut_lineage

PAIR = ["tree", "config_id"]


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Null when the whole is 0."""
    return F.round(F.when(whole > 0, 100.0 * part / whole), digits)


def percent_or_zero(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.coalesce(percent(part, whole, digits), F.lit(0.0))


def percent_of_at_least_one(part: Column, whole: Column) -> Column:
    return 100.0 * part / F.greatest(whole, F.lit(1))


def agreement(configs: DataFrame, objects: DataFrame, physical: DataFrame, failed: DataFrame, changed: DataFrame, store: g.GuardStore) -> DataFrame:
    """Prediction against what builds left, per configuration, for all objects (members)
    and for directly built ones (targets).

    True positives come from the built rows and predicted totals from per-guard object
    counts, so (configuration, object) pairs are never spelled out. ``failed`` names
    objects the build tried and failed on; those are reported apart.
    """
    known = objects.select("tree", "path", "guard_id", "kind")
    rows = physical.select(*PAIR, "path", F.lit(True).alias("left")).unionByName(failed.select(*PAIR, "path", F.lit(False).alias("left")))
    rows = rows.groupBy(*PAIR, "path").agg(F.bool_or("left").alias("left"), F.bool_or(~F.col("left")).alias("tried"))
    judged = g.verdicts_for(rows.join(known, ["tree", "path"], "left"), changed, store)
    known_here, hit, left = F.col("guard_id").isNotNull(), F.coalesce("built", F.lit(False)), F.col("left")
    views = {"members": known_here, "targets": known_here & (F.col("kind") == "target")}
    sums = [
        F.count_if(left & ok & hit if n == "tp" else left & ok & ~hit if n == "fn" else left & ~F.coalesce(ok, F.lit(False)) if n == "outside" else ~left & F.col("tried") & ok & hit).alias(f"{view}_{n}")
        for view, ok in views.items() for n in ("tp", "fn", "outside", "fp_build_failed")
    ]
    rows = judged.groupBy(*PAIR).agg(F.count_if(left).alias("physical"), *sums)
    # per-guard totals give the predicted counts of both views at once
    n, targets = F.count(F.lit(1)), F.count_if(F.col("kind") == "target")
    weight = objects.groupBy("tree", "guard_id").agg(n.alias("members_predicted"), targets.alias("targets_predicted"))
    predicted = g.weighted_counts(configs, weight, ["tree"], ["members_predicted", "targets_predicted"], changed, store)
    universe = objects.groupBy("tree").agg(n.alias("members_universe"), targets.alias("targets_universe"))
    wide = configs.select(*PAIR).join(universe, "tree", "left").join(predicted, PAIR, "left").join(rows, PAIR, "left").na.fill(0)
    fields = ("universe", "predicted", "tp", "fn", "outside", "fp_build_failed")
    stacked = ", ".join(f"'{view}', " + ", ".join(f"{view}_{f}" for f in fields) for view in views)
    tall = wide.select(*PAIR, "physical", F.expr(f"stack(2, {stacked}) AS (view, {', '.join(fields)})"))
    both = tall.withColumn("fp", F.col("predicted") - F.col("tp"))
    return both.select(
        *PAIR, "view", "universe", "predicted", "physical", "tp", "fp", "fn", "outside", "fp_build_failed",
        percent(F.col("tp"), F.col("predicted")).alias("precision_pct"),
        percent(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_pct"),
        percent(F.col("tp"), F.col("physical")).alias("overlap_pct"),
    )


def headline(scores: DataFrame, host_outside: DataFrame) -> DataFrame:
    """Published form of agreement rows: build failures left out of precision, host
    programs left out of overlap, 0.0 on empty denominators."""
    selection = F.col("fp") - F.col("fp_build_failed")
    return scores.join(host_outside, PAIR, "left").na.fill(0, ["host"]).select(
        *PAIR, "view", selection.alias("fp_selection"),
        percent_or_zero(F.col("tp"), F.col("tp") + selection).alias("precision_pct"),
        percent_or_zero(F.col("tp"), F.col("physical") - F.col("host")).alias("overlap_no_host_pct"),
    )


def confusion(counts: DataFrame) -> DataFrame:
    """Ratios of ``tp, fp, fn, universe``; denominators are at least one."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumn("tn", F.col("universe") - tp - fp - fn)
    out = out.withColumn("p", percent_of_at_least_one(tp, tp + fp)).withColumn("r", percent_of_at_least_one(tp, tp + fn))
    return out.select(
        *[c for c in counts.columns], "tn", F.round("p", 2).alias("precision"), F.round("r", 2).alias("recall"),
        F.round(2 * F.col("p") * F.col("r") / F.greatest(F.col("p") + F.col("r"), F.lit(1e-6)), 2).alias("f1"),
        F.round(percent_of_at_least_one(tp + F.col("tn"), F.col("universe")), 2).alias("accuracy"),
    )


def three_way(configs: DataFrame, objects: DataFrame, dry_run: DataFrame, physical: DataFrame, changed: DataFrame, store: g.GuardStore) -> DataFrame:
    """Prediction, dry run and build against each other within the known objects."""
    known = objects.select("tree", "path", "guard_id")
    flags = (
        dry_run.select(*PAIR, "path", F.lit(1).alias("dry"), F.lit(0).alias("disk"))
        .unionByName(physical.select(*PAIR, "path", F.lit(0).alias("dry"), F.lit(1).alias("disk")))
        .groupBy(*PAIR, "path").agg(F.max("dry").alias("dry"), F.max("disk").alias("disk"))
        .join(known, ["tree", "path"])
    )
    judged = g.verdicts_for(flags, changed, store).withColumn("pred", F.col("built").cast("int"))
    sums = judged.groupBy(*PAIR).agg(*[F.sum(F.expr(e)).alias(n) for n, e in
                                       (("dry", "dry"), ("disk", "disk"), ("pd", "pred * dry"), ("pk", "pred * disk"), ("dk", "dry * disk"))])
    base = (
        configs.select(*PAIR)
        .join(objects.groupBy("tree").agg(F.count(F.lit(1)).alias("universe")), "tree")
        .join(g.built_counts(configs, objects, changed, store).withColumnRenamed("built", "pred"), PAIR, "left")
        .join(sums, PAIR, "left")
        .na.fill(0)
    )
    sides = base.select(*PAIR, "universe", F.expr("""stack(3, 'prediction vs dry run', pd, pred - pd, dry - pd,
        'prediction vs build', pk, pred - pk, disk - pk, 'dry run vs build', dk, dry - dk, disk - dk) AS (sides, tp, fp, fn)"""))
    return confusion(sides)


def overlap(a: DataFrame, b: DataFrame, built: DataFrame) -> DataFrame:
    """Objects of two tools: side (common, first only, second only), and whether each was
    built, belongs to another architecture, or has a built neighbour."""
    sides = (
        a.select("tree", "path", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(b.select("tree", "path", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy("tree", "path").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    made = built.select("tree", "path").distinct().withColumn("was_built", F.lit(True))
    made_dirs = made.select("tree", folder.alias("dir")).distinct().withColumn("dir_built", F.lit(True))
    return (
        sides.withColumn("dir", folder)
        .join(made, ["tree", "path"], "left").join(made_dirs, ["tree", "dir"], "left")
        .select(
            "tree", "path",
            F.when((F.col("a") == 1) & (F.col("b") == 1), "common").when(F.col("a") == 1, "first only").otherwise("second only").alias("side"),
            F.when(F.col("was_built"), "built").when(F.col("path").rlike("^arch/(?!x86/)[^/]+"), "other_arch")
            .when(F.col("dir_built").isNull(), "dir_unbuilt").otherwise("dir_built").alias("class"),
        )
    )


def top_directories(sides: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` top directories with most unbuilt objects per side."""
    counts = sides.where("class IN ('dir_built', 'dir_unbuilt')").groupBy("side", F.split("path", "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("objects"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("objects"), "top"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def ablation(full: DataFrame, variant: DataFrame) -> DataFrame:
    """Variant scores next to what the variant loses against the full analysis."""
    small = variant.select(*PAIR, "view", F.col("universe").alias("u"), F.col("fp").alias("variant_fp"), F.col("fn").alias("variant_fn"), F.col("overlap_pct").alias("variant_overlap"))
    return full.join(small, [*PAIR, "view"]).select(
        *PAIR, "view", (F.col("universe") - F.col("u")).alias("lost_objects"), "variant_fp", "variant_fn", "variant_overlap",
    )


def misses_by_kind(missed: DataFrame, objects: DataFrame, prefix: str) -> DataFrame:
    """Built objects another tool missed, by the kind this analysis gives them."""
    return (
        missed.join(objects.select("tree", "path", "kind"), ["tree", "path"], "left")
        .groupBy("tree", "config_id", F.coalesce("kind", F.lit("not extracted")).alias("kind"))
        .agg(F.count(F.lit(1)).alias("missed"), F.count_if(F.col("path").startswith(prefix)).alias("under_prefix"))
    )


def timing_summary(runs: DataFrame) -> DataFrame:
    """Per subject: runs, median, min and max seconds, peak memory, inexact runs."""
    return (
        runs.groupBy("subject")
        .agg(F.count(F.lit(1)).alias("runs"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"),
             F.max("rss_mb").alias("max_rss_mb"), F.count_if(~F.col("exact")).alias("inexact"))
        .join(median(runs, ["subject"], "seconds"), "subject")
        .withColumn("median", F.round("median", 2))
    )


def scaling_table(runs: DataFrame, families: list[str]) -> DataFrame:
    """Worst seconds per problem size, a column per family."""
    return runs.groupBy("k").pivot("family", families).agg(F.max("seconds"))


def run_statistics(runs: DataFrame) -> DataFrame:
    """n, min, max, median, mean and population deviation of ``seconds`` per arm."""
    return (
        runs.groupBy("arm")
        .agg(F.count("seconds").alias("n"), F.min("seconds").alias("min"), F.max("seconds").alias("max"),
             F.round(F.avg("seconds"), 6).alias("mean"), F.round(F.stddev_pop("seconds"), 6).alias("stdev"))
        .join(median(runs, ["arm"], "seconds"), "arm")
    )


def ab_verdict(stats: DataFrame, base: str) -> DataFrame:
    """Every other arm against the base arm: percent saved, PASS from 10% on."""
    ref = stats.where(F.col("arm") == base).select(F.col("arm").alias("against"), F.col("median").alias("base"))
    return stats.where(F.col("arm") != base).withColumn("against", F.lit(base)).join(ref, "against").select(
        "arm", F.round((F.col("base") - F.col("median")) / F.col("base") * 100, 1).alias("saved_pct"),
        F.when(F.col("median") <= 0.9 * F.col("base"), "PASS").otherwise("short of -10%").alias("verdict"),
    )


def campaign(arms: DataFrame, runs: DataFrame, base: str) -> DataFrame:
    """Each arm's saving against the baseline median, judged by the noise floor: half
    the baseline's range, at least 12 ms. Arms without runs failed to boot."""
    stats = run_statistics(runs).select("arm", "median", "min", "max")
    ref = stats.where(F.col("arm") == base).select(F.col("arm").alias("against"), F.col("median").alias("base"), F.greatest(F.lit(12.0), (F.col("max") - F.col("min")) / 2).alias("floor"))
    saved = F.col("base") - F.col("median")
    return arms.where(F.col("arm") != base).join(stats, "arm", "left").withColumn("against", F.lit(base)).join(ref, "against").select(
        "arm", F.round(saved, 6).alias("saved"),
        F.when(F.col("median").isNull(), "BOOT-FAIL").when(saved >= F.col("floor"), "WIN").when(saved <= -F.col("floor"), "regress").otherwise("~noise").alias("verdict"),
    )


def construct_census(uses: DataFrame, categories: DataFrame) -> DataFrame:
    """Uses per category and construct with totals; unknown constructs are unsupported."""
    counts = uses.groupBy("construct").agg(F.count(F.lit(1)).alias("uses"))
    return (
        counts.join(categories, "construct", "left")
        .withColumn("category", F.coalesce("category", F.lit("unsupported")))
        .rollup("category", "construct").agg(F.sum("uses").alias("uses"))
    )


def failing_kind(label: Column) -> Column:
    """Class of the first failing link of a guard chain."""
    return (
        F.when(label.startswith("reached"), "directory route")
        .when(label.startswith("member"), "composite membership")
        .when(label.isNotNull(), "target-list line")
    )


def selectable(row: Column) -> Column:
    """Could this commit's objects be selected? ``row`` is a struct of the search result."""
    return (
        (row["rc"] == 0) & (row["objects"] > 0) & (row["predicted_not_built"] == 0) & (row["excluded"] == 0)
        & (row["normalize_rc"] == 0) & (row["lost"] == 0) & row["all_built"]
    )


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return middle_values(df, keys, value).select(*keys, F.col("upper").alias("upper_median"))


def sided(predicted: DataFrame, known: DataFrame, configs: DataFrame) -> DataFrame:
    """``(config_id, path, p, k)``: each pair of either side once, with the sides that have it.

    All three tables have ``tree, config_id``, ``configs`` with every configuration of the others.
    A configuration of one tree is grouped with its tree, where its rows lie; only those whose
    id stands under several trees are brought together by their id."""
    # under a new name, by which the union knows that both sides lie by tree
    side = lambda df, p: df.select(F.col("tree").alias("home"), "config_id", "path", F.lit(p).alias("p"), F.lit(not p).alias("k"))
    rows = side(predicted, True).unionByName(side(known, False))
    merged = [F.bool_or("p").alias("p"), F.bool_or("k").alias("k")]
    trees = F.struct(F.col("tree").isNull().alias("none"), "tree")
    several = configs.groupBy("config_id").agg(F.min(trees).alias("low"), F.max(trees).alias("high")).where("low <> high")
    several = cut_lineage(several.select(F.col("config_id").alias("id")))
    if several.isEmpty():
        return rows.groupBy("home", "config_id", "path").agg(*merged).drop("home")
    same = F.col("config_id").eqNullSafe(F.col("id"))
    alone = rows.join(several, same, "left_anti").groupBy("home", "config_id", "path").agg(*merged).drop("home")
    return alone.unionByName(rows.join(several, same, "left_semi").groupBy("config_id", "path").agg(*merged))


def set_sizes(predicted: DataFrame, known: DataFrame, configs: DataFrame) -> DataFrame:
    """Sizes of the intersection, of what is only predicted and of the union, from one
    grouping of both sides (see ``sided``)."""
    each = sided(predicted, known, configs)
    counts = each.agg(F.count_if(F.col("p") & F.col("k")).alias("both"), F.count_if(F.col("p") & ~F.col("k")).alias("only"), F.count(F.lit(1)).alias("either"))
    return counts.select(F.expr("stack(3, 'both', both, 'predicted only', only, 'either', either) AS (part, n)"))


def stratified_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` built and ``n`` unbuilt paths per configuration, the same for the same seed.
    Rows are cut to ``n`` in each of many hashed parts before the parts meet."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "path"))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*PAIR, "built", *keys).orderBy(order, "path"))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(256)))
    few = parts.withColumn("rank", first("part")).where(F.col("rank") <= n).drop("rank", "part")
    return few.withColumn("rank", first()).where(F.col("rank") <= n)


def discrepancies(false_positive: DataFrame, outside: DataFrame, special: tuple[str, ...]) -> DataFrame:
    """Per configuration: false positives that are composite containers, and outside
    objects under special directories."""
    in_special = F.coalesce(*[F.when(F.col("path").startswith(p), True) for p in special], F.lit(False))
    rows = false_positive.select(*PAIR, F.lit(1).alias("fp"), (F.col("kind") == "member").cast("int").alias("composite"), F.lit(0).alias("outside"), F.lit(0).alias("special")).unionByName(
        outside.select(*PAIR, F.lit(0).alias("fp"), F.lit(0).alias("composite"), F.lit(1).alias("outside"), in_special.cast("int").alias("special"))
    )
    return rows.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in ("fp", "composite", "outside", "special")])


def alarm_funnel(alarms: DataFrame) -> DataFrame:
    return alarms.groupBy("arch", "analysis_result").agg(F.count(F.lit(1)).alias("constructs"), F.countDistinct("selectee", "selector").alias("pairs"))


def funnel_percentiles(alarms: DataFrame) -> DataFrame:
    """Per analysis result: spread of the constructs of an architecture, their total, and
    the selectee and selector pairs that are left without repeats between architectures.
    One row for each architecture stands behind a percentile."""
    per = alarm_funnel(alarms)
    at = F.percentile("constructs", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    spread = per.groupBy("analysis_result").agg(at.alias("p"), F.count(F.lit(1)).alias("architectures"), F.sum("constructs").alias("total"))
    unique = alarms.groupBy("analysis_result").agg(F.countDistinct("selectee", "selector").alias("unique_pairs"))
    named = [F.col("p")[i].alias(n) for i, n in enumerate(("least", "p25", "median", "p75", "most"))]
    return spread.join(unique, "analysis_result").select("analysis_result", "architectures", *named, "total", "unique_pairs")
