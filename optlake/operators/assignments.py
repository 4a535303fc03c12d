"""Assignments of configurations: effective values, merges, diffs and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optlake.functions import tristate as t
from optlake.functions.values import as_number, config_line, normalize, or_off, strip_quotes


def last_assignment(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Effective value per symbol: the last assignment wins. Partial aggregation keeps
    one candidate per symbol before the shuffle."""
    return lines.groupBy(*keys, "symbol").agg(F.max_by("value", "line_no").alias("value"))


def duplicate_assignments(lines: DataFrame, keys: list[str]) -> DataFrame:
    return (
        lines.groupBy(*keys, "symbol")
        .agg(F.count(F.lit(1)).alias("times"), F.array_sort(F.collect_list("line_no")).alias("at"))
        .where("times > 1")
        .select(*keys, "symbol", "times", F.array_join("at", ",").alias("at"))
    )


def enabled_counts(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(
        F.count_if(F.col("value") == "m").alias("modules"),
        F.count_if(F.col("value") == "y").alias("built_in"),
        F.count_if(F.col("value").isin("y", "m")).alias("enabled"),
    )


def unmet_selects(values: DataFrame, selects: DataFrame) -> DataFrame:
    """Select edges ``(src, dst, dep)`` under each configuration, with the unmet verdict in
    three values and after the Boolean collapse. ``dep`` limits ``dst``."""
    level = F.coalesce(t.tri(F.col("value")), F.lit(0))
    force = values.select("config_id", F.col("symbol").alias("src"), level.alias("force"))
    limit = values.select("config_id", F.col("symbol").alias("dep"), level.alias("limit"))
    return (
        force.join(selects, "src")
        .join(limit, ["config_id", "dep"], "left")
        .withColumn("limit", F.coalesce("limit", F.lit(0)))
        .withColumn("force", t.select_force(F.col("force"), F.lit(2)))
        .withColumn("unmet", t.is_unmet(F.col("force"), F.col("limit")))
        .withColumn("unmet_bool", t.is_unmet_bool(F.col("force"), F.lit(2), F.col("limit")))
        .select("config_id", "src", "dst", "force", "limit", "unmet", "unmet_bool")
    )


def merge_fragment(base: DataFrame, fragment: DataFrame) -> DataFrame:
    """Apply ``fragment (merge_id, symbol, value)`` to ``base (merge_id, line_no, symbol,
    value)``: the fragment wins, base order stays, new symbols go to the end."""
    frag = fragment.select("merge_id", "symbol", F.col("value").alias("new"))
    over = base.join(frag, ["merge_id", "symbol"], "left").select(
        "merge_id", "line_no", "symbol", F.col("value").alias("old"), F.coalesce("new", "value").alias("value"),
        F.when(F.col("new").isNull(), "base only").when(F.col("new") == F.col("value"), "no-op").otherwise("override").alias("change"),
    )
    added = frag.join(base.select("merge_id", "symbol").distinct(), ["merge_id", "symbol"], "left_anti").select(
        "merge_id", F.lit(None).cast("int").alias("line_no"), "symbol", F.lit(None).cast("string").alias("old"),
        F.col("new").alias("value"), F.lit("fragment only").alias("change"),
    )
    return over.unionByName(added).withColumn(
        "line",
        F.when(F.col("change").isin("base only", "no-op") & ~(F.col("value") == "n"), F.concat_ws("=", "symbol", "value"))
        .otherwise(config_line(F.col("symbol"), F.col("value"))),
    )


def merge_report(merged: DataFrame) -> DataFrame:
    count = lambda kind: F.count_if(F.col("change") == kind)
    return merged.groupBy("merge_id").agg(
        count("override").alias("overrides"), count("no-op").alias("no_ops"),
        count("base only").alias("base_only"), count("fragment only").alias("added"),
    )


def removals(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Switch off ``wanted (config_id, symbol)`` in place: its first line becomes n, later
    lines go, symbols never set are added at the end."""
    asked = wanted.select("config_id", "symbol").distinct().withColumn("asked", F.lit(True))
    first = lines.groupBy("config_id", "symbol").agg(F.min("line_no").alias("first"))
    kept = (
        lines.join(asked, ["config_id", "symbol"], "left").join(first, ["config_id", "symbol"])
        .where("asked IS NULL OR line_no = first")
        .select("config_id", "line_no", "symbol", F.when(F.col("asked"), "n").otherwise(F.col("value")).alias("value"))
    )
    added = asked.join(first, ["config_id", "symbol"], "left_anti").select(
        "config_id", F.lit(None).cast("int").alias("line_no"), "symbol", F.lit("n").alias("value")
    )
    return kept.unionByName(added)


def bearing_symbols(pairs: DataFrame, literals: DataFrame, base: DataFrame) -> DataFrame:
    """``(merge_id, symbol, reason)``: the options that guards of its tree name, for every merge
    that has a next configuration, among those its base has on; others can't be lost. What a base
    has on meets the different options of the tree, so options aren't listed merge by merge."""
    on = base.where("value IN ('y', 'm')").select("merge_id", "symbol").distinct()
    asked = pairs.where("next_id IS NOT NULL").select("tree", "merge_id").distinct().join(on, "merge_id")
    rows = asked.join(literals.select("tree", "symbol").distinct(), ["tree", "symbol"], "left_semi")
    return rows.select("merge_id", "symbol", F.lit("guards an object").alias("reason")).distinct()


def lost_load_bearing(load_bearing: DataFrame, base: DataFrame, merged: DataFrame) -> DataFrame:
    """Load-bearing symbols ``(merge_id, symbol, reason)`` that were on and no longer are."""
    was = base.select("merge_id", "symbol", F.col("value").alias("was"))
    now = merged.select("merge_id", "symbol", F.col("value").alias("actual"))
    return (
        load_bearing.join(was.where("was IN ('y', 'm')"), ["merge_id", "symbol"], "left_semi")
        .join(now, ["merge_id", "symbol"], "left")
        .withColumn("actual", F.coalesce("actual", F.lit("missing")))
        .where("actual NOT IN ('y', 'm')")
    )


def proposed_vs_actual(proposed: DataFrame, actual: DataFrame) -> DataFrame:
    """Per merge: proposed, landed and dropped symbols (values compared without quotes)."""
    now = actual.select("merge_id", "symbol", F.col("value").alias("actual"))
    landed = F.coalesce(normalize(F.col("actual")) == normalize(F.col("value")), F.lit(False))
    return (
        proposed.join(now, ["merge_id", "symbol"], "left")
        .withColumn("landed", landed)
        .groupBy("merge_id")
        .agg(
            F.count(F.lit(1)).alias("proposed"), F.count_if("landed").alias("landed"),
            F.array_join(F.array_sort(F.collect_list(F.when(~F.col("landed"), F.col("symbol")))), " ").alias("dropped"),
        )
    )


def upgrade_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols removed and values changed between two effective configurations."""
    return (
        old.select("merge_id", "symbol", F.col("value").alias("old"))
        .join(new.select("merge_id", "symbol", F.col("value").alias("new")), ["merge_id", "symbol"], "left")
        .where("new IS NULL OR old <> new")
        .select("merge_id", "symbol", "old", "new", F.when(F.col("new").isNull(), "removed").otherwise("changed").alias("kind"))
    )


def value_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Symbols both sides know with different values."""
    return (
        left.select("merge_id", "symbol", F.col("value").alias("config_value"))
        .join(right.select("merge_id", "symbol", F.col("value").alias("model_value")), ["merge_id", "symbol"])
        .where("config_value <> model_value")
    )


def bisect_trials(good: DataFrame, bad: DataFrame) -> DataFrame:
    """One trial per changed symbol: the bad configuration with that symbol restored.

    A trial is an overlay of one row on the bad configuration; whole trial configurations
    come from ``merge_fragment`` when one is run.
    """
    return (
        good.select("merge_id", "symbol", F.col("value").alias("good"))
        .join(bad.select("merge_id", "symbol", F.col("value").alias("bad")), ["merge_id", "symbol"], "full")
        .select("merge_id", "symbol", or_off(F.col("bad")).alias("bad_value"), or_off(F.col("good")).alias("restored_value"))
        .where("bad_value <> restored_value")
    )


def likely_causes(trials: DataFrame, results: DataFrame) -> DataFrame:
    """Trials whose supplied test result is a pass."""
    return trials.join(results.where("test = 'pass'"), ["merge_id", "symbol"], "left_semi")


def requirement_leaf(value: Column, want: Column, two_state: bool = False) -> Column:
    """Leaf rule of the requirement language; ``want`` is ``equals:v``, ``allowed:a|b`` or
    ``range:lo..hi`` with open ends. A missing option is n."""
    seen = F.coalesce(value, F.lit("n"))
    arg = F.regexp_replace(want, "^[a-z]+:", "")
    number = as_number(seen)
    low, high = as_number(F.split(arg, r"\.\.")[0]), as_number(F.split(arg, r"\.\.")[1])
    inside = number.isNotNull() & (F.coalesce(low, number) <= number) & (number <= F.coalesce(high, number))
    return (
        F.when(want.startswith("equals:"), seen == arg)
        .when(want.startswith("allowed:"), F.array_contains(F.split(arg, r"\|"), seen))
        .otherwise(F.coalesce(inside, F.lit(False)))
    )


def applies(target: Column, arch: str) -> Column:
    """A requirement without target architectures applies everywhere."""
    return target.isNull() | F.array_contains(target, arch)


def unsafe_recipe(text: Column) -> Column:
    """Does a JSON text hold a key that would run code? A quote inside a JSON string is
    escaped, so an unescaped quoted word before a colon is a key."""
    # fixed values: forbidden keys
    return text.rlike(r'(?<!\\)"(python|shell|lua|command|exec)"\s*:')


def check_against_surface(proposed: DataFrame, surface: DataFrame, actual: DataFrame) -> DataFrame:
    """Findings of proposed values against the options a tree declares.

    ``surface`` has one row per symbol: ``(symbol, kind, choice, is_current, type,
    ranges ARRAY<STRUCT<lo, hi>>)``. Finds unknown symbols, options of a choice with no
    current member, numbers outside every range, and values that did not survive.
    """
    live = surface.where("kind = 'choice'").groupBy("choice").agg(F.bool_or("is_current").alias("choice_live"))
    known = surface.join(live, "choice", "left")
    row = proposed.join(known, "symbol", "left")
    text = strip_quotes(F.col("value"))
    hexa = (F.col("type") == "hex") | text.startswith("0x")
    number = F.when(hexa, as_number(text)).otherwise(text.try_cast("bigint"))
    outside = (F.size("ranges") > 0) & ~F.exists("ranges", lambda r: (as_number(r["lo"]) <= number) & (number <= as_number(r["hi"])))
    found = F.array_compact(F.array(
        F.when(F.col("kind").isNull(), "unknown symbol"),
        F.when((F.col("kind") == "choice") & ~F.col("choice_live") & (F.col("value") == "y"), "dead-letter choice"),
        F.when((F.col("kind") == "tunable") & F.col("type").isin("int", "hex") & number.isNotNull() & outside, "out of range"),
    ))
    static = row.select("merge_id", "symbol", F.explode(found).alias("finding"))
    stripped = value_mismatches(
        proposed.withColumn("value", normalize(F.col("value"))), actual.withColumn("value", normalize(F.col("value")))
    ).select("merge_id", "symbol", F.lit("stripped").alias("finding"))
    return static.unionByName(stripped).withColumn("is_error", F.col("finding").isin("unknown symbol", "out of range"))
