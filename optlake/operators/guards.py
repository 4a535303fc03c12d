"""Guard evaluation: Boolean conditions over options, for many configurations at once.

A guard store keeps each tree's conditions as a shared node table. Evaluation is
sparse: every node has a verdict for the all-unset configuration, and a configuration
only produces rows for nodes whose verdict differs from it. The difference is carried
upward one level at a time as a change in the number of true children, so a level is one
equi join and one partially aggregated ``groupBy``, and an assignment that no guard
names costs nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optlake.operators.decide import possible_verdicts, written
from optlake.session import Heap, cut_lineage, stored_by

VALUES = ("undef", "y", "m")


def tri_state(value: Column, want: Column, two_state: bool = False) -> Column:
    """Leaf rule of a guard: anything but y and m counts as undef."""
    known = ("y",) if two_state else ("y", "m")
    return F.when(value.isin(*known), value).otherwise(F.lit("undef")) == want


def literal(value: Column, want: Column, two_state: bool = False) -> Column:
    """Leaf rule of the second evaluator: non-empty and not ``n`` is on; a wanted text
    is compared without quotes."""
    value = F.coalesce(value, F.lit(""))
    strip = lambda c: F.regexp_replace(c, '^"+|"+$', "")
    return F.when(want.isNull(), ~value.isin("", "n")).otherwise(strip(value) == strip(want))


@dataclass(frozen=True)
class GuardStore:
    """``leaves`` (tree, node, symbol, want, default), ``steps[l]`` the edges from any lower
    level into level ``l + 1`` with the parent's data, ``roots`` (tree, guard_id, default)."""

    leaves: DataFrame
    steps: list[DataFrame]
    roots: DataFrame
    rule: object


def _verdict(op: Column, kids: Column, true_kids: Column) -> Column:
    return (
        F.when(op == "and", true_kids == kids)
        .when(op == "or", true_kids > 0)
        .otherwise(true_kids == 0)
    )


def depth_of(nodes: DataFrame) -> int:
    """Level of the highest node; one aggregate."""
    return nodes.agg(F.max("level")).first()[0] or 0


def leveled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges ``(tree, parent, node, op, level)`` with what a level loop asks of the parent."""
    inner = nodes.where("level > 0").select("tree", F.col("node_id").alias("parent"), "op", "level")
    return stored_by(edges.select("tree", "parent", F.col("child").alias("node")).join(inner, ["tree", "parent"]), "tree")


def build_store(nodes: DataFrame, edges: DataFrame, guards: DataFrame, rule=tri_state) -> GuardStore:
    """Prepare nodes ``(tree, node_id, op, symbol, want, level)`` and edges ``(tree,
    parent, child)`` for evaluation; ``guards`` are ``(tree, guard_id)`` root nodes.

    ``op`` is eq, true, false, and, or, not. A level takes its children from all levels under
    it, so no node is repeated on the way up. The store is written as tables.
    """
    depth = depth_of(nodes)
    base = nodes.where("level = 0")
    leaf_default = F.when(F.col("op") == "eq", rule(F.lit(None).cast("string"), F.col("want"))).otherwise(F.col("op") == "true")
    leaves = base.select("tree", F.col("node_id").alias("node"), "op", "symbol", "want", leaf_default.alias("default"))
    links = leveled(nodes, edges)
    known = Heap(nodes.sparkSession, "tree")
    known.add(leaves.select("tree", "node", "default"))
    steps = []
    for lvl in range(1, depth + 1):
        # a formula's fan-in bounds each window
        mine = Window.partitionBy("tree", "parent")
        counted = links.where(F.col("level") == lvl).drop("level").join(known.read(), ["tree", "node"]).select(
            "tree", "node", "parent", "op", F.count(F.lit(1)).over(mine).alias("kids"), F.count_if("default").over(mine).alias("true_kids")
        )
        step = counted.withColumn("default", _verdict(F.col("op"), F.col("kids"), F.col("true_kids")))
        steps.append(stored_by(step, "tree"))
        known.add(steps[-1].select("tree", F.col("parent").alias("node"), "default").distinct())
    roots = guards.join(known.read().withColumnRenamed("node", "guard_id"), ["tree", "guard_id"])
    return GuardStore(leaves, steps, stored_by(roots.select("tree", "guard_id", "default"), "tree"), rule)


def changed_verdicts(values: DataFrame, store: GuardStore, two_state: bool = False) -> DataFrame:
    """``(tree, config_id, guard_id, built)`` for every guard whose verdict under a
    configuration differs from its all-unset default. ``values`` are ``(tree, config_id,
    symbol, value)`` with one row per configuration and symbol. What each level changes is
    written once."""
    on = store.rule(F.col("value"), F.col("want"), two_state)
    delta = lambda now: F.when(now & ~F.col("default"), 1).when(~now & F.col("default"), -1).otherwise(0)
    moved = Heap(values.sparkSession, "tree")
    moved.add(
        values.select("tree", "config_id", "symbol", "value")
        .join(store.leaves.where("op = 'eq'"), ["tree", "symbol"])
        .select("tree", "config_id", "node", delta(on).alias("delta"))
        .where("delta <> 0")
    )
    for step in store.steps:
        moved.add(
            moved.read().join(step, ["tree", "node"])
            .groupBy("tree", "config_id", "parent", "op", "kids", "true_kids", "default")
            .agg(F.sum("delta").alias("shift"))
            .withColumn("delta", delta(_verdict(F.col("op"), F.col("kids"), F.col("true_kids") + F.col("shift"))))
            .where("delta <> 0")
            .select("tree", "config_id", F.col("parent").alias("node"), "delta")
        )
    return moved.read().withColumnRenamed("node", "guard_id").join(store.roots.select("tree", "guard_id"), ["tree", "guard_id"]).select(
        "tree", "config_id", "guard_id", (F.col("delta") > 0).alias("built")
    )


def verdicts_for(pairs: DataFrame, changed: DataFrame, store: GuardStore) -> DataFrame:
    """Add ``built`` to rows that have ``tree, config_id, guard_id``."""
    return (
        pairs.join(store.roots.select("tree", "guard_id", "default"), ["tree", "guard_id"], "left")
        .join(changed, ["tree", "config_id", "guard_id"], "left")
        .withColumn("built", F.coalesce("built", "default"))
        .drop("default")
    )


def guard_verdicts_on(configs: DataFrame, changed: DataFrame, store: GuardStore) -> DataFrame:
    """``(tree, config_id, guard_id)`` for each guard that holds, listing default-true
    guards for the configurations that leave them alone."""
    always = store.roots.where("default").select("tree", "guard_id").join(configs.select("tree", "config_id"), "tree")
    return always.join(changed.where("NOT built"), ["tree", "config_id", "guard_id"], "left_anti").select(
        "tree", "config_id", "guard_id"
    ).unionByName(changed.where("built").select("tree", "config_id", "guard_id"))


def holding_counts(configs: DataFrame, changed: DataFrame, store: GuardStore) -> DataFrame:
    """``(tree, config_id, holds)``: rows that ``guard_verdicts_on`` has for each
    configuration, from counts: defaults of the tree, what a configuration turned off and
    what it turned on. Configurations that stand several times count as often."""
    base = store.roots.where("default").groupBy("tree").agg(F.count(F.lit(1)).alias("base"))
    times = configs.groupBy("tree", "config_id").agg(F.count(F.lit(1)).alias("times")).join(base, "tree", "left")
    moved = changed.groupBy("tree", "config_id").agg(F.count_if("built").alias("on"), F.count_if(~F.col("built")).alias("off"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    holds = zero("times") * (zero("base") - zero("off")) + zero("on")
    return times.join(moved, ["tree", "config_id"], "full").select("tree", "config_id", holds.alias("holds"))


def built_objects(configs: DataFrame, objects: DataFrame, changed: DataFrame, store: GuardStore) -> DataFrame:
    """Objects each configuration builds: ``(tree, config_id, path)``. The rows are the
    answer; no pair that is not part of it is made, except default-true ones a
    configuration turned off."""
    return guard_verdicts_on(configs, changed, store).join(
        objects.select("tree", "guard_id", "path"), ["tree", "guard_id"]
    ).select("tree", "config_id", "path")


def built_counts(configs: DataFrame, objects: DataFrame, changed: DataFrame, store: GuardStore, group: str | None = None) -> DataFrame:
    """Number of objects built per configuration (and ``group`` column of objects),
    from per-guard object counts: the pairs themselves are never made."""
    keys = ["tree"] + ([group] if group else [])
    weight = objects.groupBy(*keys, "guard_id").agg(F.count(F.lit(1)).alias("built"))
    return weighted_counts(configs, weight, keys, ["built"], changed, store)


def weighted_counts(configs: DataFrame, weight: DataFrame, keys: list[str], measures: list[str], changed: DataFrame, store: GuardStore) -> DataFrame:
    """Sums of per-guard ``measures`` over the guards each configuration satisfies: the
    default sum of its tree, shifted by the guards whose verdict it changes."""
    base = (
        weight.join(store.roots, ["tree", "guard_id"])
        .groupBy(*keys)
        .agg(*[F.sum(F.when(F.col("default"), F.col(m)).otherwise(0)).alias(m) for m in measures])
    )
    shift = changed.join(weight.withColumnsRenamed({m: f"w_{m}" for m in measures}), ["tree", "guard_id"]).select(
        *keys, "config_id", *[F.when(F.col("built"), F.col(f"w_{m}")).otherwise(-F.col(f"w_{m}")).alias(m) for m in measures]
    )
    return (
        configs.select("tree", "config_id")
        .join(base, "tree")
        .select(*keys, "config_id", *measures)
        .unionByName(shift)
        .groupBy(*keys, "config_id")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def built_anywhere(configs: DataFrame, changed: DataFrame, store: GuardStore) -> DataFrame:
    """``(tree, guard_id, ever)``: does any configuration of the tree satisfy the guard?
    Counting changes answers it without listing pairs."""
    total = configs.groupBy("tree").agg(F.count(F.lit(1)).alias("configs"))
    moved = changed.groupBy("tree", "guard_id").agg(F.count(F.lit(1)).alias("moved"))
    return (
        store.roots.join(total, "tree", "left")
        .join(moved, ["tree", "guard_id"], "left")
        .select(
            "tree",
            "guard_id",
            F.when(F.col("default"), F.coalesce("configs", F.lit(0)) > F.coalesce("moved", F.lit(0)))
            .otherwise(F.coalesce("moved", F.lit(0)) > 0)
            .alias("ever"),
        )
    )


# ------------------------------------------------------------------ structure


def guard_leaves(nodes: DataFrame, edges: DataFrame, guards: DataFrame) -> DataFrame:
    """Distinct ``(tree, guard_id, node_id)`` reachable from each guard, every level."""
    seen = Heap(nodes.sparkSession, "tree")
    seen.add(guards.select("tree", "guard_id", F.col("guard_id").alias("node_id"), F.lit(0).alias("step")))
    below = edges.select("tree", F.col("parent").alias("node_id"), "child")
    for step in range(1, depth_of(nodes) + 1):
        front = seen.read().where(F.col("step") == step - 1).join(below, ["tree", "node_id"])
        seen.add(front.select("tree", "guard_id", F.col("child").alias("node_id"), F.lit(step).alias("step")).distinct())
    return stored_by(seen.read().drop("step").distinct().join(nodes, ["tree", "node_id"]), "tree")


def guard_symbols(closure: DataFrame) -> DataFrame:
    """Options each guard names."""
    return closure.where("op = 'eq'").select("tree", "guard_id", "symbol").distinct()


def conjoin_directories(objects: DataFrame, dir_guards: DataFrame, nodes: DataFrame, edges: DataFrame):
    """Object guard AND the guard of every ancestor directory.

    Returns ``(objects, nodes, edges)``: objects get a guard per distinct
    (directory, guard), which keeps conditions shared. ``dir_guards`` are ``(tree, dir,
    guard_id)`` with ``dir`` ending in a slash.
    """
    named = objects.withColumn("dir", F.regexp_extract("path", "^(.*/)?", 0))
    named = named.withColumn("both", F.concat_ws(" & ", "guard_id", "dir"))
    pairs = named.select("tree", "both", "guard_id", "dir").distinct()
    parts = F.split(F.expr("rtrim('/', dir)"), "/")
    ancestors = pairs.where("dir <> ''").select(
        "tree", "both",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)),
                              lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).alias("dir"),
    )
    links = (
        pairs.select("tree", F.col("both").alias("parent"), F.col("guard_id").alias("child"))
        .unionByName(
            ancestors.join(dir_guards, ["tree", "dir"]).select("tree", F.col("both").alias("parent"), F.col("guard_id").alias("child"))
        )
        .distinct()
    )
    tops = pairs.select("tree", F.col("both").alias("node_id"), F.lit("and").alias("op"),
                        F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("want"),
                        F.lit(depth_of(nodes) + 1).alias("level"))
    return (
        named.drop("guard_id", "dir").withColumnRenamed("both", "guard_id"),
        nodes.unionByName(tops),
        edges.unionByName(links),
    )


def _leaf_hash() -> Column:
    return F.sha2(F.to_json(F.struct("op", "symbol", "want")), 256)


def _inner_hash(op: Column) -> Column:
    """Hash over an operator and the set of its children's hashes."""
    kids = F.array_join(F.array_sort(F.collect_set("hash")), ",")
    return F.sha2(F.concat(op, F.lit("("), kids, F.lit(")")), 256)


def guard_metrics(nodes: DataFrame, edges: DataFrame, guards: DataFrame) -> DataFrame:
    """Per guard: options named, height and unfolded node count of the formula. Sizes and
    hashes go up the levels together; the options are counted once for each formula."""
    links, size = leveled(nodes, edges), Heap(nodes.sparkSession, "tree")
    base = nodes.where("level = 0").withColumn("hash", _leaf_hash())
    size.add(base.select("tree", F.col("node_id").alias("node"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("height"), "hash"))
    for lvl in range(1, depth_of(nodes) + 1):
        here = links.where(F.col("level") == lvl).join(size.read(), ["tree", "node"])
        size.add(here.groupBy("tree", F.col("parent").alias("node")).agg(
            (F.sum("n") + 1).alias("n"), (F.max("height") + 1).alias("height"), _inner_hash(F.min("op")).alias("hash")))
    sized = guards.join(size.read().withColumnRenamed("node", "guard_id"), ["tree", "guard_id"])
    sized = stored_by(sized.select("tree", "guard_id", "n", "height", "hash"), "tree")
    _, closure = formula_leaves(nodes, edges, sized)
    degree = closure.where("op = 'eq'").select("hash", "symbol").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("degree"))
    return sized.join(degree, "hash", "left").select(
        "tree", "guard_id", F.coalesce("degree", F.lit(0)).alias("degree"), "height", F.col("n").alias("nodes"))


def condition_hashes(nodes: DataFrame, edges: DataFrame, guards: DataFrame) -> DataFrame:
    """Structural hash of each guard, equal for equal formulas in any tree. A node's hash
    covers its operator and the sorted hashes of its children, so text never unfolds."""
    links, known = leveled(nodes, edges), Heap(nodes.sparkSession, "tree")
    known.add(nodes.where("level = 0").select("tree", F.col("node_id").alias("node"), _leaf_hash().alias("hash")))
    for lvl in range(1, depth_of(nodes) + 1):
        here = links.where(F.col("level") == lvl).join(known.read(), ["tree", "node"])
        kids = here.groupBy("tree", "parent", "op").agg(_inner_hash(F.col("op")).alias("hash"))
        known.add(kids.select("tree", F.col("parent").alias("node"), "hash"))
    return guards.join(known.read().withColumnRenamed("node", "guard_id"), ["tree", "guard_id"]).select("tree", "guard_id", "hash")


def symbol_references(objects: DataFrame, symbols: DataFrame) -> DataFrame:
    """How many objects name each option, from per-guard object counts."""
    weight = objects.groupBy("tree", "guard_id").agg(F.count(F.lit(1)).alias("n"))
    return symbols.join(weight, ["tree", "guard_id"]).groupBy("symbol").agg(F.sum("n").alias("objects"))


def co_compilation(objects: DataFrame, hashes: DataFrame) -> DataFrame:
    """Objects that share a condition, per tree: class size and first member."""
    return (
        objects.join(hashes, ["tree", "guard_id"])
        .groupBy("tree", "hash")
        .agg(F.count(F.lit(1)).alias("size"), F.min("path").alias("first_member"))
    )


# ------------------------------------------------------------------ decisions


def scoped_store(key: str, closure: DataFrame, edges: DataFrame, guards: DataFrame, rule=tri_state) -> GuardStore:
    """A store in which each guard (or pair of guards) named by ``key`` is a tree of its
    own, so hypothetical assignments touch only the guard they are about."""
    inside = cut_lineage(closure.select(F.col(key).alias("tree"), "node_id", "op", "symbol", "want", "level").distinct())
    links = (
        closure.select(F.col(key).alias("scope"), F.col("tree"), F.col("node_id").alias("parent"))
        .join(edges, ["tree", "parent"])
        .select(F.col("scope").alias("tree"), "parent", "child")
        .distinct()
    )
    return build_store(inside, links, guards.select(F.col(key).alias("tree"), "guard_id").distinct(), rule)


def one_guard_per_hash(hashes: DataFrame) -> DataFrame:
    """One ``(tree, guard_id, hash)`` to stand for all guards with the same formula."""
    pick = F.min(F.struct("tree", "guard_id")).alias("pick")
    return hashes.groupBy("hash").agg(pick).select("hash", "pick.tree", "pick.guard_id")


def formula_leaves(nodes: DataFrame, edges: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One guard for each formula ``(hash, tree, guard_id)``, and the nodes under it with
    the ``hash``: what the formula alone decides is found once, not once a tree."""
    reps = cut_lineage(one_guard_per_hash(hashes))
    closure = guard_leaves(nodes, edges, reps.select("tree", "guard_id")).join(reps, ["tree", "guard_id"])
    return reps, cut_lineage(closure)


def decided(reps: DataFrame, closure: DataFrame, edges: DataFrame, domains: dict[str, DataFrame | None]) -> DataFrame:
    """``(hash, domain, status)`` of every formula under every domain: dead (never true),
    always or mixed, whatever the number of options, all of them together.

    A domain restricts values: its ``(symbol, banned)`` rows forbid a value; None forbids
    nothing. An option can always be unset.
    """
    each = F.explode(F.array(*[F.lit(name) for name in domains])).alias("domain")
    scopes = cut_lineage(reps.select("hash", each).withColumn("scope", F.concat_ws(" ", "domain", "hash")))
    inside = closure.join(scopes, "hash").select("scope", "tree", F.col("node_id").alias("node"), "op", "symbol", "want", "level")
    links = inside.select("scope", "tree", F.col("node").alias("parent")).join(edges, ["tree", "parent"]).select("scope", "parent", "child")
    roots = reps.join(scopes, "hash").select("scope", F.col("guard_id").alias("root"))
    banned = None
    for name, domain in domains.items():
        if domain is not None:
            mine = inside.where(F.col("op") == "eq").join(scopes.where(F.col("domain") == name).select("scope"), "scope").select("scope", "symbol").distinct()
            rows = mine.join(domain.where("banned <> 'undef'").select("symbol", F.col("banned").alias("value")).distinct(), "symbol").select("scope", "symbol", "value")
            banned = rows if banned is None else banned.unionByName(rows)
    found = possible_verdicts(inside.drop("tree"), links, roots, None if banned is None else cut_lineage(banned))
    both = found.groupBy("scope").agg(F.bool_or("verdict").alias("can"), F.bool_and("verdict").alias("must"))
    status = F.when(F.col("must"), "always").when(F.col("can"), "mixed").otherwise("dead").alias("status")
    return both.join(scopes, "scope").select("hash", "domain", status)


def judged(nodes: DataFrame, edges: DataFrame, guards: DataFrame, domains: dict[str, DataFrame | None]) -> DataFrame:
    """``(tree, guard_id, hash, domain, status)`` of every guard under every domain (see
    ``decided``)."""
    hashes = stored_by(condition_hashes(nodes, edges, guards), "tree")
    return hashes.join(decided(*formula_leaves(nodes, edges, hashes), edges, domains), "hash")


def satisfiability(nodes: DataFrame, edges: DataFrame, guards: DataFrame, domain: DataFrame | None = None) -> DataFrame:
    """``(tree, guard_id, hash, status)``: dead (never true), always or mixed."""
    return judged(nodes, edges, guards, {"all": domain}).drop("domain")


def condition_changes(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Compare two guards over every assignment of their options, of any number.

    ``pairs`` are ``(tree, old, new)``, the two guards of an object that has different
    conditions in two versions. Returns ``(tree, old, new, change, witness)`` with change
    unchanged, generalized, restricted or diverged, and the first assignment on which the
    two differ. Each direction is a formula of its own: one holds and the other doesn't.
    """
    pairs = pairs.select("tree", "old", "new").distinct().withColumn("pair", F.concat_ws(" > ", "tree", "old", "new"))
    ways = F.array(F.struct(F.lit("lost").alias("way"), F.col("old").alias("on"), F.col("new").alias("off")), F.struct(F.lit("won").alias("way"), F.col("new").alias("on"), F.col("old").alias("off")))
    keyed = pairs.select("tree", "old", "new", "pair", F.explode(ways).alias("w")).select("tree", "old", "new", "pair", "w.*")
    keyed = cut_lineage(keyed.withColumn("scope", F.concat_ws(" ", "way", "pair")))
    asked = keyed.select("tree", F.explode(F.array("on", "off")).alias("guard_id"), "scope")
    closure = guard_leaves(nodes, edges, asked.select("tree", "guard_id").distinct()).join(asked, ["tree", "guard_id"])
    inside = closure.select("scope", "tree", F.col("node_id").alias("node"), "op", "symbol", "want", "level").distinct()
    links = inside.select("scope", "tree", F.col("node").alias("parent")).join(edges, ["tree", "parent"]).select("scope", "parent", "child")
    depth, none = depth_of(nodes), F.lit(None).cast("string")
    # "! " and "& " begin no node id of a scope, since ids of nodes are those of its tree
    top = lambda name, op, level: keyed.select("scope", F.lit(name).alias("node"), F.lit(op).alias("op"), none.alias("symbol"), none.alias("want"), F.lit(level).alias("level"))
    edge = lambda parent, child: keyed.select("scope", F.lit(parent).alias("parent"), child.alias("child"))
    all_nodes = inside.drop("tree").unionByName(top("! ", "not", depth + 1)).unionByName(top("& ", "and", depth + 2))
    all_edges = links.unionByName(edge("! ", F.col("off"))).unionByName(edge("& ", F.col("on"))).unionByName(edge("& ", F.lit("! ")))
    found = possible_verdicts(all_nodes, all_edges, keyed.select("scope", F.lit("& ").alias("root")))
    seen = keyed.join(found.where("verdict").select("scope", "witness"), "scope", "left").groupBy("tree", "old", "new").agg(
        F.bool_or(F.when(F.col("way") == "lost", F.col("witness").isNotNull())).alias("lost"),
        F.bool_or(F.when(F.col("way") == "won", F.col("witness").isNotNull())).alias("won"),
        F.min("witness").alias("first"),
    )
    change = F.when(F.col("lost") & F.col("won"), "diverged").when(F.col("lost"), "restricted").when(F.col("won"), "generalized").otherwise("unchanged")
    return seen.select("tree", "old", "new", change.alias("change"), F.when(F.col("first").isNotNull(), written(F.col("first"))).alias("witness"))


def pivotal_options(asks: DataFrame, values: DataFrame, nodes: DataFrame, edges: DataFrame, formulas: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """For guards that are off, the options whose change alone turns them on.

    ``asks`` are ``(tree, config_id, guard_id)`` that do not hold. Each option of the
    guard is tried with y, m, n (not its current value); the first that works is kept. What
    works depends on the formula and its options' current values only, so each such case is
    tried once, whatever the number of trees and configurations. ``formulas`` are the hashes of
    the guards and what ``formula_leaves`` finds of them, if known.
    """
    asks = asks.select("tree", "config_id", "guard_id").distinct()
    if formulas is None:
        hashes = stored_by(condition_hashes(nodes, edges, asks.select("tree", "guard_id").distinct()), "tree")
        formulas = hashes, *formula_leaves(nodes, edges, hashes)
    hashes, reps, closure = formulas
    symbols = closure.where("op = 'eq'").select("hash", "symbol").distinct()
    named = stored_by(hashes.select("tree", "guard_id", "hash").join(symbols, "hash"), "tree")
    now = F.when(F.col("value").isin("y", "m"), F.col("value")).otherwise("n").alias("value")
    states = (
        asks.join(named, ["tree", "guard_id"])
        .join(values.select("tree", "config_id", "symbol", "value"), ["tree", "config_id", "symbol"], "left")
        .groupBy("tree", "config_id", "guard_id", "hash").agg(F.sort_array(F.collect_set(F.struct("symbol", now))).alias("state"))
    )
    states = stored_by(states.withColumn("case", F.to_json("state")), "tree")
    cases = cut_lineage(states.select("hash", "case", "state").distinct())
    found = _pivots(cases, scoped_store("hash", closure, edges, reps))
    return states.select("tree", "config_id", "guard_id", "hash", "case").join(found, ["hash", "case"]).drop("hash", "case")


def _pivots(cases: DataFrame, store: GuardStore) -> DataFrame:
    """``(hash, case, symbol, current_value, suggested_value)`` of the cases ``(hash, case, state)``;
    each formula is a tree of ``store`` and a ``state`` has the value of each of its options."""
    current = cut_lineage(cases.select(F.col("hash").alias("tree"), "case", F.inline("state")))
    trials = current.select(
        "tree", "case", F.col("symbol").alias("tried"), F.col("value").alias("current_value"),
        F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit("y").alias("to")),
                          F.struct(F.lit(1).alias("rank"), F.lit("m").alias("to")),
                          F.struct(F.lit(2).alias("rank"), F.lit("n").alias("to")))).alias("t"),
    ).where("t.to <> current_value")
    trials = cut_lineage(trials.select("tree", "case", F.struct("case", "tried", "t.rank", "t.to", "current_value").alias("config_id")))
    assigned = trials.join(current, ["tree", "case"]).select(
        "tree", "config_id", "symbol",
        F.when(F.col("symbol") == F.col("config_id.tried"), F.col("config_id.to")).otherwise(F.col("value")).alias("value"))
    changed = cut_lineage(changed_verdicts(assigned, store))
    by_default = (
        trials.join(store.roots.where("default").select("tree"), "tree", "left_semi")
        .join(changed.where("NOT built").select("tree", "config_id"), ["tree", "config_id"], "left_anti")
        .select("tree", "config_id")
    )
    works = changed.where("built").select("tree", "config_id").unionByName(by_default)
    return works.groupBy(
        F.col("tree").alias("hash"), F.col("config_id.case").alias("case"), F.col("config_id.tried").alias("symbol"),
        F.col("config_id.current_value").alias("current_value"),
    ).agg(F.min_by("config_id.to", "config_id.rank").alias("suggested_value"))


# ------------------------------------------------------------------ covers and nearest


def same_name_groups(built: DataFrame) -> DataFrame:
    """Objects that a configuration builds together with others of their base name:
    ``(tree, name, path, configs, witness)`` with the number of such configurations and the
    first. One row for each object; pairs are never listed."""
    name = F.element_at(F.split("path", "/"), -1)
    named = built.withColumn("name", name)
    shared = named.groupBy("tree", "config_id", "name").agg(F.count(F.lit(1)).alias("together")).where("together > 1")
    rows = named.join(shared, ["tree", "config_id", "name"])
    return rows.groupBy("tree", "name", "path").agg(F.count(F.lit(1)).alias("configs"), F.min("config_id").alias("witness"), F.max("together").alias("together"))


def nearest_building_config(configs: DataFrame, values: DataFrame, wanted: DataFrame, base: DataFrame) -> DataFrame:
    """Per tree, the configuration that builds all wanted objects with the fewest option
    differences to the tree's base configuration.

    ``wanted`` are ``(tree, config_id, path, built)`` for the wanted objects, ``base`` is
    ``(tree, base_id)``.
    """
    full = wanted.groupBy("tree", "config_id").agg(F.bool_and("built").alias("ok")).where("ok").select("tree", "config_id")
    mine = full.join(values.select("tree", "config_id", "symbol", "value"), ["tree", "config_id"])
    theirs = base.join(values.select("tree", F.col("config_id").alias("base_id"), "symbol", F.col("value").alias("base_value")), ["tree", "base_id"])
    size = theirs.groupBy("tree").agg(F.count(F.lit(1)).alias("base_n"))
    shared = mine.join(theirs, ["tree", "symbol"], "left").groupBy("tree", "config_id").agg(
        F.count_if(F.col("base_value").isNotNull()).alias("both"),
        F.count_if(F.col("base_value") == F.col("value")).alias("same"),
        F.count(F.lit(1)).alias("own"),
    )
    zero = F.lit(0)
    distance = F.coalesce("own", zero) + F.coalesce("base_n", zero) - F.coalesce("both", zero) - F.coalesce("same", zero)
    return (
        full.join(shared, ["tree", "config_id"], "left").join(size, "tree", "left")
        .withColumn("distance", distance)
        .groupBy("tree")
        .agg(F.min(F.struct("distance", "config_id")).alias("best"))
        .select("tree", "best.config_id", "best.distance")
    )


def largest_buildable_subset(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per tree the configuration that builds most wanted objects (smallest id on ties)
    and the objects it leaves out."""
    counts = wanted.groupBy("tree", "config_id").agg(F.count_if("built").alias("n"))
    best = counts.groupBy("tree").agg(F.max(F.struct("n", -F.col("config_id"))).alias("b")).select(
        "tree", (-F.col("b.col2")).alias("config_id"), F.col("b.n").alias("included")
    )
    left = wanted.where("NOT built").join(best.select("tree", "config_id"), ["tree", "config_id"], "left_semi").select("tree", "config_id", "path")
    return best, left


def unit_kinds(rows: DataFrame) -> DataFrame:
    """Class of each ``(variable, word)`` row of a build file."""
    # fixed values: variable prefixes of each class, tested in this order
    host = ("hostprogs", "host-progs", "userprogs", "always")
    dialect = ("pbl-", "obj-pbl-", "bootblock-", "romstage-", "postcar-", "verstage-", "ramstage-", "smm-", "spl-", "tpl-")
    clean = ("clean-files", "clean-dirs", "mrproper-dirs")
    extra = ("extra-", "targets")
    starts = lambda names: F.coalesce(*[F.when(F.col("variable").startswith(n), True) for n in names], F.lit(False))
    is_object = F.col("word").rlike(r"\.(o|a)$")
    unset = F.col("variable").isin("obj-", "lib-", "pbl-")
    kind = (
        F.when(unset, F.when(is_object, "unconfigurable"))
        .when(starts(host), "host program")
        .when(starts(dialect), F.when(is_object, "dialect"))
        .when(starts(clean), "clean")
        .when(starts(extra), "extra")
        .when(is_object & F.coalesce(F.col("is_composite"), F.lit(False)), "composite")
        .when(is_object, "compilation")
    )
    orphaned = is_object & F.col("variable").endswith("-")
    return rows.select("*", kind.alias("unit_kind"), orphaned.alias("orphaned"))


def first_failing_link(links: DataFrame) -> DataFrame:
    """Links ``(config_id, path, position, label, built)`` of a guard chain to one row per
    object: links, links that hold, and the label of the first that does not."""
    keys = [c for c in ("tree", "config_id", "path") if c in links.columns]
    return links.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("links"),
        F.count_if("built").alias("holding"),
        F.min_by(F.when(~F.col("built"), F.col("label")), F.when(~F.col("built"), F.col("position"))).alias("first_failing"),
    )
