"""Graph loops and the build plan."""

from pyspark.sql import functions as F

from optlake.catalog.packages import COST, EDGES, installed, overrides, sources
from optlake.catalog.registry import query, view
from optlake.operators import graph as g
from optlake.operators import packages as p
from optlake.plans.world import plan_world

view("v_relations", """
SELECT 's' || CAST(s_suppkey AS STRING) AS src, 'n' || CAST(s_nationkey AS STRING) AS dst, CASE WHEN s_acctbal < 2000 THEN 'selected_by' ELSE 'depends' END AS rel FROM supplier
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), 'default' FROM nation
UNION ALL SELECT 'r' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING), 'choice' FROM nation
UNION ALL SELECT DISTINCT 'p' || CAST(l_partkey AS STRING), 's' || CAST(l_suppkey AS STRING), CASE WHEN l_quantity > 45 THEN 'prompt' ELSE 'depends' END FROM lineitem
""", keep=True)
view("v_seeds", "SELECT 'p' || CAST(p_partkey AS STRING) AS name FROM part WHERE p_size = 50 UNION ALL SELECT 's' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_acctbal > 9800")
CONE = """
WITH RECURSIVE cone(name, step) AS (SELECT DISTINCT name, 0 FROM v_seeds UNION SELECT r.dst, {step} FROM cone c JOIN v_relations r ON r.src = c.name WHERE {cond})
SELECT DISTINCT name FROM cone
"""


@query("i02_dependency_cone", CONE.format(step="0", cond="r.rel <> 'selected_by'"))
def _(v):
    return g.dependency_cone(v("seeds"), v("relations"))


@query("i02_cone_with_selects", CONE.format(step="0", cond="TRUE"))
def _(v):
    return g.dependency_cone(v("seeds"), v("relations"), follow_selects=True)


@query("i03_neighbourhood", CONE.format(step="step + 1", cond="step < 2"))
def _(v):
    return g.reach(v("seeds"), v("relations"), rounds=2)


view("v_members", """
SELECT 'r' || CAST(n_regionkey AS STRING) AS container, 'n' || CAST(n_nationkey AS STRING) AS member, n_nationkey % 4 <> 0 AS holds FROM nation
UNION ALL SELECT 'n' || CAST(s_nationkey AS STRING), 's' || CAST(s_suppkey AS STRING), s_acctbal > 0 FROM supplier
UNION ALL SELECT 's' || CAST(l_suppkey AS STRING), 'p' || CAST(l_partkey AS STRING), bool_or(l_tax > 0.02) FROM lineitem GROUP BY l_suppkey, l_partkey
""")


@query("i04_composite_expansion", """
WITH RECURSIVE x(root, name, holds) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, TRUE FROM region UNION SELECT x.root, m.member, x.holds AND m.holds FROM x JOIN v_members m ON m.container = x.name)
SELECT root, name, bool_or(holds) AS holds FROM x GROUP BY 1, 2
""")
def _(v):
    roots = v.sql("SELECT 'r' || CAST(r_regionkey AS STRING) AS name, TRUE AS holds FROM region")
    return g.expand_composites(roots, v("members"))


def waves_of(v):
    edges = v("relations").select("src", "dst")
    nodes = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    return g.build_waves(nodes, edges)


# one row for each wave; the state is the list of names placed so far
WAVES = """
st(wave, placed, fresh, forced) AS (
  SELECT -1, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), FALSE
  UNION ALL
  SELECT wave + 1, list_concat(placed, ready.names), ready.names, ready.k > 0 FROM (
    SELECT s.wave, s.placed, (
      SELECT arg_min(struct_pack(names := names, k := k), k) FROM (
        SELECT k, list(name) AS names FROM (
          SELECT n.name, count(e.dst) FILTER (NOT list_contains(s.placed, e.dst)) AS k FROM n LEFT JOIN e ON e.src = n.name
          WHERE NOT list_contains(s.placed, n.name) GROUP BY n.name) GROUP BY k)) AS ready
    FROM st s) WHERE ready IS NOT NULL)
"""


@query("i01_build_waves", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM v_relations),
n AS (SELECT src AS name FROM e UNION SELECT dst FROM e), {WAVES}
SELECT unnest(fresh) AS name, wave, forced AS in_cycle FROM st
""")
def _(v):
    return waves_of(v)


@query("i05_world_plan", f"""
WITH RECURSIVE {EDGES}, e AS MATERIALIZED (SELECT * FROM edges),
sz AS MATERIALIZED (SELECT source, count(DISTINCT bname) AS binaries, CAST(sum(installed_kb) AS BIGINT) AS kb FROM mapped WHERE source IN (SELECT source FROM v_names) GROUP BY 1),
n AS (SELECT source AS name FROM sz), {WAVES},
placed AS (SELECT unnest(fresh) AS source, wave, forced AS in_cycle FROM st),
ver AS (SELECT source, CASE WHEN p_partkey % 4 IN (1, 2) THEN second_version ELSE first_version END AS version FROM v_versions_ab),
o AS (SELECT source, CASE WHEN tier = 'R' THEN 0 ELSE 1 END AS tier, position, use_stock FROM v_overrides UNION ALL SELECT source, 2, 0, TRUE FROM v_names WHERE source LIKE 'gcc-%'),
f AS (SELECT source, arg_min(use_stock, (tier, position)) AS use_stock FROM o GROUP BY 1)
SELECT sz.source, ver.version, sz.binaries, (SELECT count(*) FROM e WHERE e.src = sz.source) AS deps, p.wave, p.in_cycle, {COST.replace("source", "sz.source")} AS cost, coalesce(f.use_stock, FALSE) AS use_stock
FROM sz JOIN ver ON ver.source = sz.source JOIN placed p ON p.source = sz.source LEFT JOIN f ON f.source = sz.source
""")
def _(v):
    return plan_world(installed(v), sources(v), overrides(v))


@query("a10_plan_statistics", """
SELECT count(*) AS total_sources, count(*) FILTER (NOT p_size = 10) AS rebuild_sources, count(*) FILTER (p_size = 10) AS stock_sources, CAST(sum(p_size) AS BIGINT) AS total_binaries, max(p_size) + 1 AS waves,
  round(sum(CASE WHEN p_size = 10 THEN 0 WHEN p_size < 3 THEN 6 WHEN p_size = 4 THEN 1 WHEN p_size < 15 THEN 0.04 ELSE 0.12 END)::DOUBLE, 2) AS cpu_hours, count(*) FILTER (p_size < 3) AS monsters FROM v_names
""")
def _(v):
    units = v("names").select("source", F.col("p_size").alias("binaries"), F.col("p_size").alias("wave"), p.cost_class(F.col("source"), F.col("p_size") * 20).alias("cost"), (F.col("p_size") == 10).alias("use_stock"))
    return p.plan_statistics(units, [])


@query("j35_reverse_relations", """
SELECT dst AS symbol, coalesce(string_agg(DISTINCT src, ' ' ORDER BY src) FILTER (rel = 'select'), '') AS selected_by, coalesce(string_agg(DISTINCT src, ' ' ORDER BY src) FILTER (rel = 'imply'), '') AS implied_by
FROM (SELECT src, dst, CASE WHEN rel = 'prompt' THEN 'select' WHEN rel = 'default' THEN 'imply' END AS rel FROM v_relations) WHERE rel IS NOT NULL GROUP BY 1
""")
def _(v):
    edges = v("relations").selectExpr("src", "dst", "CASE rel WHEN 'prompt' THEN 'select' WHEN 'default' THEN 'imply' END AS rel")
    return g.reverse_relations(edges)
