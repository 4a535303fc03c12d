"""Score queries."""

from pyspark.sql import functions as F

from optlake.catalog import views  # noqa: F401
from optlake.catalog.guards import changed_of, store_of
from optlake.catalog.registry import query, view
from optlake.operators import covers
from optlake.operators import guards as g
from optlake.operators import scores as s

view("v_failed", "SELECT c.tree, c.config_id, o.path FROM v_configs c JOIN v_objects o ON c.tree = o.tree WHERE o.size > 45")
view("v_dry_run", "SELECT c.tree, c.config_id, o.path FROM v_configs c JOIN v_objects o ON c.tree = o.tree WHERE o.size * 9000 < c.budget")

PRED = """
pred AS (SELECT d.tree, d.config_id, o.path, o.kind FROM v_verdicts d JOIN v_objects o ON o.tree = d.tree AND o.guard_id = d.guard_id WHERE d.built)
"""


def agree(pred="pred", objects="v_objects"):
    def side(name, cond):
        return f"""
SELECT c.tree, c.config_id, '{name}' AS view, coalesce(u.n, 0) AS universe, coalesce(p.n, 0) AS predicted, coalesce(k.n, 0) AS physical,
  coalesce(t.n, 0) AS tp, coalesce(p.n, 0) - coalesce(t.n, 0) AS fp, coalesce(i.n, 0) - coalesce(t.n, 0) AS fn, coalesce(k.n, 0) - coalesce(i.n, 0) AS outside, coalesce(f.n, 0) AS fp_build_failed
FROM v_configs c LEFT JOIN (SELECT tree, count(*) AS n FROM {objects} WHERE {cond} GROUP BY 1) u ON u.tree = c.tree
LEFT JOIN (SELECT config_id, count(*) AS n FROM {pred} WHERE {cond} GROUP BY 1) p ON p.config_id = c.config_id
LEFT JOIN (SELECT config_id, count(*) AS n FROM v_inventory GROUP BY 1) k ON k.config_id = c.config_id
LEFT JOIN (SELECT i.config_id, count(*) AS n FROM v_inventory i JOIN {objects} o ON o.tree = i.tree AND o.path = i.path WHERE {cond} GROUP BY 1) i ON i.config_id = c.config_id
LEFT JOIN (SELECT i.config_id, count(*) AS n FROM v_inventory i JOIN {pred} o ON o.config_id = i.config_id AND o.path = i.path WHERE {cond} GROUP BY 1) t ON t.config_id = c.config_id
LEFT JOIN (SELECT p.config_id, count(*) AS n FROM {pred} p JOIN v_failed f ON f.config_id = p.config_id AND f.path = p.path
  WHERE {cond} AND NOT EXISTS (SELECT 1 FROM v_inventory i WHERE i.config_id = p.config_id AND i.path = p.path) GROUP BY 1) f ON f.config_id = c.config_id"""
    return f"""(SELECT *, round(CASE WHEN predicted > 0 THEN 100.0 * tp / predicted END, 1) AS precision_pct, round(CASE WHEN tp + fn > 0 THEN 100.0 * tp / (tp + fn) END, 1) AS recall_pct,
  round(CASE WHEN physical > 0 THEN 100.0 * tp / physical END, 1) AS overlap_pct FROM ({side('members', 'TRUE')} UNION ALL {side('targets', "kind = 'target'")}))"""


def agreement_of(v, objects=None):
    store = store_of(v)
    return s.agreement(v("configs"), objects if objects is not None else v("objects"), v("inventory"), v("failed"), changed_of(v, store), store)


@query("a01_agreement", f"WITH {PRED} SELECT * FROM {agree()}")
def _(v):
    return agreement_of(v)


@query("a01_headline", f"""
WITH {PRED}, sc AS {agree()} SELECT tree, config_id, view, fp - fp_build_failed AS fp_selection,
 round(CASE WHEN tp + fp - fp_build_failed > 0 THEN 100.0 * tp / (tp + fp - fp_build_failed) ELSE 0 END, 1) AS precision_pct,
 round(CASE WHEN physical - 1 > 0 THEN 100.0 * tp / (physical - 1) ELSE 0 END, 1) AS overlap_no_host_pct FROM sc
""")
def _(v):
    host = v("inventory").where("path LIKE 'scripts/%'").groupBy("tree", "config_id").agg(F.count(F.lit(1)).alias("host"))
    return s.headline(agreement_of(v), host)


@query("a02_three_way", f"""
WITH {PRED}, k AS (SELECT config_id, path FROM v_inventory WHERE path <> 'scripts/host.o'),
c AS (SELECT c.tree, c.config_id, (SELECT count(*) FROM v_objects o WHERE o.tree = c.tree) AS universe FROM v_configs c WHERE EXISTS (SELECT 1 FROM v_objects o WHERE o.tree = c.tree)),
fl AS (SELECT config_id, path, max(p) AS p, max(d) AS d, max(k) AS k FROM (SELECT config_id, path, 1 AS p, 0 AS d, 0 AS k FROM pred UNION ALL SELECT config_id, path, 0, 1, 0 FROM v_dry_run UNION ALL SELECT config_id, path, 0, 0, 1 FROM k) GROUP BY 1, 2),
sm AS (SELECT config_id, sum(p * d) AS pd, sum(p * k) AS pk, sum(d * k) AS dk, sum(p) AS p, sum(d) AS d, sum(k) AS k FROM fl GROUP BY 1),
j AS (SELECT c.tree, c.config_id, c.universe, coalesce(pd, 0) AS pd, coalesce(pk, 0) AS pk, coalesce(dk, 0) AS dk, coalesce(p, 0) AS p, coalesce(d, 0) AS d, coalesce(k, 0) AS k FROM c LEFT JOIN sm ON sm.config_id = c.config_id),
x AS (SELECT tree, config_id, universe, 'prediction vs dry run' AS sides, pd AS tp, p - pd AS fp, d - pd AS fn FROM j UNION ALL SELECT tree, config_id, universe, 'prediction vs build', pk, p - pk, k - pk FROM j
  UNION ALL SELECT tree, config_id, universe, 'dry run vs build', dk, d - dk, k - dk FROM j),
y AS (SELECT *, universe - tp - fp - fn AS tn, 100.0 * tp / greatest(tp + fp, 1) AS pp, 100.0 * tp / greatest(tp + fn, 1) AS rr FROM x)
SELECT tree, config_id, universe, sides, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(pp, 2) AS "precision", round(rr, 2) AS recall,
  round(2 * pp * rr / greatest(pp + rr, 1e-6), 2) AS f1, round(100.0 * (tp + tn) / greatest(universe, 1), 2) AS accuracy FROM y
""")
def _(v):
    store = store_of(v)
    return s.three_way(v("configs"), v("objects"), v("dry_run"), v("inventory"), changed_of(v, store), store)


view("v_other_tool", """
SELECT tree, path FROM v_objects WHERE kind <> 'rule' UNION ALL SELECT tree, replace(path, '.o', '.extra.o') AS path FROM v_objects WHERE kind = 'rule'
""")
SIDES = """
made AS (SELECT DISTINCT tree, path FROM v_inventory), mdir AS (SELECT DISTINCT tree, regexp_replace(path, '/?[^/]*$', '') AS dir FROM made),
sides AS (SELECT coalesce(a.tree, b.tree) AS tree, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN 'common' WHEN b.path IS NULL THEN 'first only' ELSE 'second only' END AS side
  FROM v_objects a FULL JOIN v_other_tool b ON a.tree = b.tree AND a.path = b.path),
cls AS (SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM made m WHERE m.tree = s.tree AND m.path = s.path) THEN 'built' WHEN s.path LIKE 'arch/%' THEN 'other_arch'
  WHEN NOT EXISTS (SELECT 1 FROM mdir m WHERE m.tree = s.tree AND m.dir = regexp_replace(s.path, '/?[^/]*$', '')) THEN 'dir_unbuilt' ELSE 'dir_built' END AS class FROM sides s)
"""


@query("a03_tool_overlap", f"WITH {SIDES} SELECT tree, side, class, count(*) AS objects FROM cls GROUP BY 1, 2, 3")
def _(v):
    return s.overlap(v("objects"), v("other_tool"), v("inventory")).groupBy("tree", "side", "class").agg(F.count(F.lit(1)).alias("objects"))


@query("a03_top_directories", f"""
WITH {SIDES} SELECT side, split_part(path, '/', 1) AS top, count(*) AS objects, row_number() OVER (PARTITION BY side ORDER BY count(*) DESC, split_part(path, '/', 1)) AS rank
FROM cls WHERE class IN ('dir_built', 'dir_unbuilt') GROUP BY 1, 2
""")
def _(v):
    return s.top_directories(s.overlap(v("objects"), v("other_tool"), v("inventory")))


@query("a04_archive_rollup", """
WITH o AS (SELECT i.tree, split_part(i.path, '/', 1) AS dir, count(*) AS n FROM v_inventory i LEFT JOIN v_objects o ON o.tree = i.tree AND o.path = i.path WHERE o.path IS NULL GROUP BY 1, 2),
d AS (SELECT tree, count(*) - count(DISTINCT path) AS duplicates FROM (SELECT l.tree, o.path FROM v_lines l JOIN v_objects o ON o.tree = l.tree AND o.part = l.l_partkey) GROUP BY 1)
SELECT i.tree, i.physical, i.builds, coalesce(d.duplicates, 0) AS duplicate_targets, o.dir AS top_outside, o.n AS outside FROM (SELECT tree, count(*) AS physical, count(DISTINCT config_id) AS builds FROM v_inventory GROUP BY 1) i
LEFT JOIN d ON d.tree = i.tree LEFT JOIN (SELECT tree, arg_max(dir, n) AS dir, sum(n)::BIGINT AS n FROM o GROUP BY 1) o ON o.tree = i.tree
""")
def _(v):
    from optlake.plans.scoreboard import archive_rollup
    listed = v("lines").selectExpr("tree", "l_partkey AS part").join(v("objects").select("tree", "part", "path"), ["tree", "part"]).select("tree", "path")
    return archive_rollup(v("inventory"), v("objects"), listed)


@query("a05_ablation", f"""
WITH {PRED}, kept_objects AS (SELECT * FROM v_objects WHERE kind <> 'rule'), pred2 AS (SELECT * FROM pred WHERE kind <> 'rule'), a AS {agree()}, b AS {agree("pred2", "kept_objects")}
SELECT a.tree, a.config_id, a.view, a.universe - b.universe AS lost_objects, b.fp AS variant_fp, b.fn AS variant_fn, b.overlap_pct AS variant_overlap FROM a JOIN b ON a.config_id = b.config_id AND a.view = b.view
""")
def _(v):
    return s.ablation(agreement_of(v), agreement_of(v, v("objects").where("kind <> 'rule'")))


view("v_runs", "SELECT event_type AS subject, event_type AS arm, event_type AS family, extract(hour FROM ts) AS k, value AS seconds, user_id * 1.5 AS rss_mb, value < 60 AS exact FROM events")


@query("a06_timing_summary", """
SELECT subject, count(*) AS runs, min(seconds) AS min_s, max(seconds) AS max_s, CAST(max(rss_mb) AS DOUBLE) AS max_rss_mb, count(*) FILTER (NOT exact) AS inexact, round(median(seconds), 2) AS median FROM v_runs GROUP BY 1
""")
def _(v):
    return s.timing_summary(v("runs").withColumn("rss_mb", F.col("rss_mb").cast("double")))


@query("a06_scaling_table", "SELECT k, max(seconds) FILTER (family = 'click') AS click, max(seconds) FILTER (family = 'error') AS error FROM v_runs GROUP BY 1")
def _(v):
    return s.scaling_table(v("runs"), ["click", "error"])


STATS = "st AS (SELECT arm, count(seconds) AS n, min(seconds) AS min, max(seconds) AS max, round(avg(seconds), 6) AS mean, round(stddev_pop(seconds), 6) AS stdev, median(seconds) AS median FROM v_runs GROUP BY 1)"


@query("a07_boot_statistics", f"WITH {STATS} SELECT * FROM st")
def _(v):
    return s.run_statistics(v("runs"))


@query("a07_ab_verdict", f"""
WITH {STATS} SELECT a.arm, round((b.median - a.median) / b.median * 100, 1) AS saved_pct, CASE WHEN a.median <= 0.9 * b.median THEN 'PASS' ELSE 'short of -10%' END AS verdict
FROM st a JOIN st b ON b.arm = 'click' WHERE a.arm <> 'click'
""")
def _(v):
    return s.ab_verdict(s.run_statistics(v("runs")), "click")


@query("a08_campaign", f"""
WITH {STATS}, arms AS (SELECT DISTINCT event_type AS arm FROM events UNION ALL SELECT DISTINCT p_type FROM part)
SELECT a.arm, round(b.median - s.median, 6) AS saved, CASE WHEN s.median IS NULL THEN 'BOOT-FAIL' WHEN b.median - s.median >= greatest(12.0, (b.max - b.min) / 2) THEN 'WIN'
  WHEN b.median - s.median <= -greatest(12.0, (b.max - b.min) / 2) THEN 'regress' ELSE '~noise' END AS verdict
FROM arms a LEFT JOIN st s ON s.arm = a.arm JOIN st b ON b.arm = 'click' WHERE a.arm <> 'click'
""")
def _(v):
    arms = v.sql("SELECT DISTINCT event_type AS arm FROM events UNION ALL SELECT DISTINCT p_type FROM part")
    return s.campaign(arms, v("runs"), "click")


@query("a13_construct_census", """
SELECT category, construct, count(*) AS uses FROM (SELECT p_type AS construct, CASE WHEN p_type < 'L' THEN 'conditional' WHEN p_type < 'Q' THEN 'list' ELSE 'unsupported' END AS category FROM part)
GROUP BY ROLLUP (category, construct)
""")
def _(v):
    known = v.sql("SELECT DISTINCT p_type AS construct, CASE WHEN p_type < 'L' THEN 'conditional' ELSE 'list' END AS category FROM part WHERE p_type < 'Q'")
    return s.construct_census(v.table("part").selectExpr("p_type AS construct"), known)


CHAIN = """
link AS (SELECT a.tree, a.config_id, a.path, length(x.dir) AS position, 'reached: ' || x.dir AS label, d.built FROM v_asks a
  JOIN v_dirs x ON x.tree = a.tree AND starts_with(a.path, x.dir) JOIN v_verdicts d ON d.config_id = a.config_id AND d.guard_id = x.guard_id
  UNION ALL SELECT a.tree, a.config_id, a.path, 1000, a.kind, d.built FROM v_asks a JOIN v_verdicts d ON d.config_id = a.config_id AND d.guard_id = a.guard_id),
chain AS (SELECT tree, config_id, path, bool_and(built) AS verdict, arg_min(label, position) FILTER (NOT built) AS first_failing FROM link GROUP BY 1, 2, 3)
"""


@query("p28_failing_kinds", f"""
WITH {CHAIN} SELECT CASE WHEN first_failing LIKE 'reached%' THEN 'directory route' WHEN first_failing LIKE 'member%' THEN 'composite membership' WHEN first_failing IS NOT NULL THEN 'target-list line' END AS kind, count(*) AS n FROM chain GROUP BY 1
""")
def _(v):
    from optlake.plans.explain import guard_chain
    store = store_of(v)
    links = g.first_failing_link(g.verdicts_for(guard_chain(v("asks"), v("dirs")), changed_of(v, store), store))
    return links.groupBy(s.failing_kind(F.col("first_failing")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


view("v_searches", """
SELECT o_custkey AS tree, o_orderkey AS commit_id, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS rc, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 2 END AS objects,
  0 AS predicted_not_built, CASE WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END AS excluded, 0 AS normalize_rc, CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS lost, o_orderstatus <> 'O' AS all_built FROM orders
""")


@query("p29_selectable_commits", """
SELECT tree, commit_id FROM v_searches WHERE rc = 0 AND objects > 0 AND excluded = 0 AND lost = 0 AND all_built
""")
def _(v):
    row = F.struct("rc", "objects", "predicted_not_built", "excluded", "normalize_rc", "lost", "all_built")
    return v("searches").where(s.selectable(row)).select("tree", "commit_id")


@query("a14_task_summary", """
SELECT tree, count(*) AS cases, count(*) FILTER (rc = 0 AND objects > 0 AND excluded = 0 AND lost = 0 AND all_built) AS selectable, count(*) FILTER (objects = 0) AS unmapped, count(*) FILTER (excluded > 0) AS excluded,
  count(*) FILTER (lost > 0) AS lost, CAST(sum(size) AS BIGINT) AS total_size, CAST(list_sort(list(size))[count(*) // 2 + 1] AS DOUBLE) AS upper_median FROM v_searches GROUP BY 1
""")
def _(v):
    from optlake.plans.scoreboard import task_summary
    return task_summary(v("searches"))


@query("p27_discrepancy_classes", f"""
WITH {PRED} SELECT tree, config_id, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(composite) AS BIGINT) AS composite, CAST(sum(outside) AS BIGINT) AS outside, CAST(sum(special) AS BIGINT) AS special FROM (
 SELECT p.tree, p.config_id, 1 AS fp, CASE WHEN kind = 'member' THEN 1 ELSE 0 END AS composite, 0 AS outside, 0 AS special FROM pred p WHERE NOT EXISTS (SELECT 1 FROM v_inventory i WHERE i.config_id = p.config_id AND i.path = p.path)
 UNION ALL SELECT tree, config_id, 0, 0, 1, 1 FROM v_inventory WHERE path = 'scripts/host.o') GROUP BY 1, 2
""")
def _(v):
    store = store_of(v)
    built = g.built_objects(v("configs"), v("objects"), changed_of(v, store), store)
    fp = built.join(v("inventory"), ["tree", "config_id", "path"], "left_anti").join(v("objects").select("tree", "path", "kind"), ["tree", "path"])
    outside = v("inventory").join(v("objects").select("tree", "path"), ["tree", "path"], "left_anti")
    return s.discrepancies(fp, outside, ("scripts/", "tools/"))


@query("p38_stratified_sample", """
SELECT tree, config_id, path, built, rank FROM (SELECT a.tree, a.config_id, a.path, d.built, row_number() OVER (PARTITION BY a.tree, a.config_id, d.built ORDER BY md5('7|' || a.path), a.path) AS rank
 FROM v_asks a JOIN v_verdicts d ON d.config_id = a.config_id AND d.guard_id = a.guard_id) WHERE rank <= 2
""")
def _(v):
    store = store_of(v)
    rows = g.verdicts_for(v("asks"), changed_of(v, store), store).select("tree", "config_id", "path", "built")
    return s.stratified_sample(rows, 2, 7)


@query("e01_object_sets", f"""
WITH {PRED}, k AS (SELECT config_id, path FROM v_inventory) SELECT 'both' AS part, count(*) AS n FROM (SELECT config_id, path FROM pred INTERSECT SELECT * FROM k)
UNION ALL SELECT 'predicted only', count(*) FROM (SELECT config_id, path FROM pred EXCEPT SELECT * FROM k) UNION ALL SELECT 'either', count(*) FROM (SELECT config_id, path FROM pred UNION SELECT * FROM k)
""")
def _(v):
    store = store_of(v)
    return s.set_sizes(g.built_objects(v("configs"), v("objects"), changed_of(v, store), store), v("inventory"), v("configs"))


@query("e02_build_difference", f"""
WITH {PRED} SELECT p.config_id, p.path, 'prediction only' AS side FROM pred p ANTI JOIN v_inventory i ON i.config_id = p.config_id AND i.path = p.path
UNION ALL SELECT i.config_id, i.path, 'build only' FROM v_inventory i ANTI JOIN pred p ON i.config_id = p.config_id AND i.path = p.path
""")
def _(v):
    from optlake.plans.scoreboard import build_difference
    store = store_of(v)
    return build_difference(g.built_objects(v("configs"), v("objects"), changed_of(v, store), store), v("inventory"), v("configs"))


@query("e03_built_anywhere", "SELECT tree, guard_id, bool_or(built) AS ever FROM v_verdicts GROUP BY 1, 2")
def _(v):
    store = store_of(v)
    return g.built_anywhere(v("configs"), changed_of(v, store), store)


@query("j34_misses_by_kind", f"""
WITH {PRED} SELECT i.tree, i.config_id, coalesce(o.kind, 'not extracted') AS kind, count(*) AS missed, count(*) FILTER (i.path LIKE 'arch/%') AS under_prefix FROM v_inventory i LEFT JOIN v_objects o ON o.tree = i.tree AND o.path = i.path
WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.config_id = i.config_id AND p.path = i.path) GROUP BY 1, 2, 3
""")
def _(v):
    store = store_of(v)
    rows = v("inventory").join(v("objects").select("tree", "path", "guard_id"), ["tree", "path"], "left")
    missed = g.verdicts_for(rows, changed_of(v, store), store).where("NOT coalesce(built, FALSE)").select("tree", "config_id", "path")
    return s.misses_by_kind(missed, v("objects"), "arch/")


def alarms_of(v):
    return v.sql("SELECT n_name AS arch, o_orderstatus AS analysis_result, c_mktsegment AS selectee, o_orderpriority AS selector FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey")


@query("a20_alarm_funnel", """
SELECT n_name AS arch, o_orderstatus AS analysis_result, count(*) AS constructs, count(DISTINCT (c_mktsegment, o_orderpriority)) AS pairs FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2
""")
def _(v):
    return s.alarm_funnel(alarms_of(v))


@query("a20_funnel_percentiles", """
WITH a AS (SELECT n_name AS arch, o_orderstatus AS analysis_result, c_mktsegment AS selectee, o_orderpriority AS selector FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
per AS (SELECT arch, analysis_result, count(*) AS constructs FROM a GROUP BY 1, 2), u AS (SELECT analysis_result, count(DISTINCT (selectee, selector)) AS unique_pairs FROM a GROUP BY 1)
SELECT per.analysis_result, count(*) AS architectures, min(constructs)::DOUBLE AS least, quantile_cont(constructs, 0.25) AS p25, quantile_cont(constructs, 0.5) AS median, quantile_cont(constructs, 0.75) AS p75, max(constructs)::DOUBLE AS most,
  CAST(sum(constructs) AS BIGINT) AS total, any_value(unique_pairs) AS unique_pairs FROM per JOIN u ON u.analysis_result = per.analysis_result GROUP BY 1
""")
def _(v):
    return s.funnel_percentiles(alarms_of(v))


@query("o01_top_symbols", """
SELECT symbol, count(DISTINCT (o.tree, o.path)) AS objects FROM v_objects o JOIN v_literals l ON l.tree = o.tree AND l.guard_id = o.guard_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def _(v):
    closure = g.guard_leaves(v("guard_nodes"), v("guard_edges"), v("guards").select("tree", "guard_id"))
    return g.symbol_references(v("objects"), g.guard_symbols(closure)).orderBy(F.desc("objects"), "symbol").limit(10)


@query("o02_group_samples", "SELECT kind, path, tree FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path, tree) AS rn FROM v_objects) WHERE rn <= 5")
def _(v):
    from optlake.plans.scoreboard import first_per_group
    return first_per_group(v("objects").select("kind", "path", "tree"), "kind", ["path", "tree"], 5)


def holds_of(v):
    store = store_of(v)
    return g.guard_verdicts_on(v("configs"), changed_of(v, store), store)


def weights_of(v):
    return v("objects").groupBy("tree", "guard_id").agg(F.count(F.lit(1)).alias("n"))


def picks_of(v):
    return v.once("greedy picks", lambda: covers.greedy_cover(holds_of(v), weights_of(v)))


# greedy picks as a recursion with one row for each tree and step; the state is the list
# of guards still uncovered
COVER = """
w AS (SELECT tree, guard_id, count(*) AS n FROM v_objects GROUP BY 1, 2),
h AS MATERIALIZED (SELECT d.tree, d.config_id, d.guard_id, w.n FROM v_verdicts d JOIN w ON w.tree = d.tree AND w.guard_id = d.guard_id WHERE d.built),
"""
STEPS = """
{name}(tree, round, config_id, gain, open) AS (
  SELECT tree, 0, CAST(NULL AS BIGINT), CAST(1 AS BIGINT), list(DISTINCT guard_id) FROM {holds} GROUP BY tree
  UNION ALL
  SELECT tree, round, pick.config_id, pick.gain, list_filter(open, lambda x: NOT list_contains(pick.mine, x)) FROM (
    SELECT s.tree, s.round + 1 AS round, s.open,
           (SELECT arg_min(struct_pack(config_id := f.config_id, gain := f.gain, mine := f.mine), (-f.gain, f.config_id)) FROM (
              SELECT x.config_id, CAST(sum(x.n) AS BIGINT) AS gain, list(x.guard_id) AS mine FROM {holds} x
              WHERE x.tree = s.tree AND list_contains(s.open, x.guard_id) GROUP BY x.config_id) f) AS pick
    FROM {name} s WHERE len(s.open) > 0) WHERE pick.gain > 0)
"""
GREEDY = "WITH RECURSIVE" + COVER + STEPS.format(name="step", holds="h")


@query("g15_greedy_cover", GREEDY + "SELECT tree, round, config_id, gain FROM step WHERE round > 0")
def _(v):
    return picks_of(v)


@query("w08_coverage_progression", GREEDY + """
SELECT tree, round, config_id, gain, CAST(covered AS BIGINT) AS covered, round(covered::DOUBLE / total * 100, 2) AS covered_pct FROM (
  SELECT s.tree, round, config_id, gain, sum(gain) OVER (PARTITION BY s.tree ORDER BY round) AS covered, t.total
  FROM step s JOIN (SELECT tree, sum(n) AS total FROM w GROUP BY 1) t ON t.tree = s.tree WHERE round > 0)
""")
def _(v):
    return covers.progression(picks_of(v), weights_of(v))


@query("g16_negative_cover", GREEDY + """,
picked AS (SELECT tree, config_id FROM step WHERE round > 0),
sure AS (SELECT h.tree, h.guard_id, any_value(h.n) AS n FROM h JOIN picked p ON p.tree = h.tree AND p.config_id = h.config_id GROUP BY 1, 2
         HAVING count(*) = (SELECT count(*) FROM picked q WHERE q.tree = h.tree)),
off AS MATERIALIZED (SELECT c.tree, c.config_id, u.guard_id, u.n FROM v_configs c JOIN sure u ON u.tree = c.tree
        WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.tree = c.tree AND h.config_id = c.config_id AND h.guard_id = u.guard_id)),
""" + STEPS.format(name="down", holds="off") + "SELECT tree, round, config_id, gain FROM down WHERE round > 0")
def _(v):
    negative = covers.negative_holds(picks_of(v), holds_of(v), weights_of(v), v("configs"))
    return covers.greedy_cover(negative, weights_of(v))


# what each configuration is asked for: all objects of its tree, or the two smallest as one request
view("v_wanted", """
SELECT c.tree, c.config_id, o.path, o.guard_id, o.rn FROM v_configs c
JOIN (SELECT tree, path, guard_id, row_number() OVER (PARTITION BY tree ORDER BY size, path) AS rn FROM v_objects) o ON o.tree = c.tree
""")
view("v_first_config", "SELECT tree, min(config_id) AS base_id FROM v_configs GROUP BY tree")


def wanted_of(v, wanted):
    store = store_of(v)
    return g.verdicts_for(wanted, changed_of(v, store), store).select("tree", "config_id", "path", "built")


@query("g17_nearest_config", """
WITH w AS (SELECT w.tree, w.config_id FROM v_wanted w JOIN v_verdicts d ON d.config_id = w.config_id AND d.guard_id = w.guard_id WHERE w.rn <= 2 GROUP BY 1, 2 HAVING bool_and(d.built)),
s AS (SELECT w.tree, w.config_id, c.symbol FROM w JOIN v_config_values c ON c.config_id = w.config_id UNION SELECT w.tree, w.config_id, c.symbol FROM w JOIN v_first_config f ON f.tree = w.tree JOIN v_config_values c ON c.config_id = f.base_id),
d AS (SELECT w.tree, w.config_id, count(s.symbol) FILTER (a.value IS DISTINCT FROM b.value) AS distance FROM w LEFT JOIN s ON s.config_id = w.config_id JOIN v_first_config f ON f.tree = w.tree
  LEFT JOIN v_config_values a ON a.config_id = w.config_id AND a.symbol = s.symbol LEFT JOIN v_config_values b ON b.config_id = f.base_id AND b.symbol = s.symbol GROUP BY 1, 2)
SELECT tree, arg_min(config_id, (distance, config_id)) AS config_id, min(distance) AS distance FROM d GROUP BY 1
""")
def _(v):
    return g.nearest_building_config(v("configs"), v("config_values"), wanted_of(v, v("wanted").where("rn <= 2")), v("first_config"))


@query("g18_largest_subset", """
WITH n AS (SELECT w.tree, w.config_id, count(*) FILTER (d.built) AS n FROM v_wanted w JOIN v_verdicts d ON d.config_id = w.config_id AND d.guard_id = w.guard_id GROUP BY 1, 2),
b AS (SELECT tree, arg_min(config_id, (-n, config_id)) AS config_id, max(n) AS included FROM n GROUP BY 1)
SELECT b.tree, b.config_id, b.included, count(w.path) AS excluded FROM b LEFT JOIN (SELECT w.* FROM v_wanted w JOIN v_verdicts d ON d.config_id = w.config_id AND d.guard_id = w.guard_id WHERE NOT d.built) w
ON w.config_id = b.config_id GROUP BY 1, 2, 3
""")
def _(v):
    best, left = g.largest_buildable_subset(wanted_of(v, v("wanted")))
    out = left.groupBy("tree").agg(F.count(F.lit(1)).alias("excluded"))
    return best.join(out, "tree", "left").na.fill(0, ["excluded"])
