"""Guard queries."""

from pyspark.sql import functions as F

from optlake.catalog import views  # noqa: F401
from optlake.catalog.registry import query, view
from optlake.operators import guards as g

def store_of(v):
    def make():
        guards = v("guards").select("tree", "guard_id")
        return g.build_store(v("guard_nodes"), v("guard_edges"), guards)

    return v.once("guard store", make)


def changed_of(v, store):
    make = lambda: g.changed_verdicts(v("config_values"), store)
    return v.once("changed verdicts", make) if store is store_of(v) else make()


@query("g01_built_objects", """
SELECT d.tree, d.config_id, o.path FROM v_verdicts d JOIN v_objects o ON o.tree = d.tree AND o.guard_id = d.guard_id WHERE d.built
""")
def _(v):
    store = store_of(v)
    return g.built_objects(v("configs"), v("objects"), changed_of(v, store), store)


@query("g01_literal_rule", """
WITH lit AS (SELECT DISTINCT tree, symbol, CASE WHEN want = 'm' THEN 'O-tag' END AS want FROM v_literals)
SELECT c.tree, c.config_id, l.symbol, l.want FROM v_config_values c JOIN lit l ON l.tree = c.tree AND l.symbol = c.symbol
WHERE CASE WHEN l.want IS NULL THEN c.value NOT IN ('', 'n') ELSE trim(c.value, '"') = l.want END
""")
def _(v):
    leaves = v("literals").selectExpr("tree", "symbol", "CASE WHEN want = 'm' THEN 'O-tag' END AS want").distinct()
    nodes = leaves.selectExpr("tree", "concat_ws('=', symbol, want) AS node_id", "'eq' AS op", "symbol", "want", "0 AS level")
    edges = v.spark.createDataFrame([], "tree long, parent string, child string")
    guards = nodes.selectExpr("tree", "node_id AS guard_id")
    store = g.build_store(nodes, edges, guards, g.literal)
    on = g.changed_verdicts(v("config_values"), store).where("built")
    return on.selectExpr("tree", "config_id", "split(guard_id, '=')[0] AS symbol", "CASE WHEN guard_id LIKE '%=%' THEN split(guard_id, '=')[1] END AS want")


view("v_dirs", """
SELECT tree, dir, CASE WHEN deep = 1 THEN min(guard_id) ELSE max(guard_id) END AS guard_id FROM (
  SELECT tree, guard_id, inline(array(named_struct('deep', 1, 'dir', CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^[^/]*/', 0) END),
                                      named_struct('deep', 2, 'dir', CASE WHEN path LIKE '%/%/%' THEN regexp_extract(path, '^[^/]*/[^/]*/', 0) END))) FROM v_objects)
WHERE dir IS NOT NULL GROUP BY tree, deep, dir
""", """
SELECT tree, regexp_extract(path, '^[^/]*/') AS dir, min(guard_id) AS guard_id FROM v_objects WHERE path LIKE '%/%' GROUP BY 1, 2
UNION ALL SELECT tree, regexp_extract(path, '^[^/]*/[^/]*/') AS dir, max(guard_id) AS guard_id FROM v_objects WHERE path LIKE '%/%/%' GROUP BY 1, 2
""".replace("'^[^/]*/')", "'^[^/]*/', 0)").replace("'^[^/]*/[^/]*/')", "'^[^/]*/[^/]*/', 0)"), by="tree")
# the objects each configuration is asked about: the parts on the order itself
view("v_asks", """
SELECT DISTINCT l.tree, l.l_orderkey AS config_id, o.path, o.guard_id, o.kind FROM v_lines l
JOIN v_objects o ON o.tree = l.tree AND o.part = l.l_partkey
""", by="tree")


@query("g02_directory_conjunction", """
WITH vd AS MATERIALIZED (SELECT config_id, guard_id, built FROM v_verdicts WHERE config_id IN (SELECT config_id FROM v_asks))
SELECT a.tree, a.config_id, a.path, d.built AND coalesce(d1.built, TRUE) AND coalesce(d2.built, TRUE) AS built
FROM v_asks a JOIN vd d ON d.config_id = a.config_id AND d.guard_id = a.guard_id
LEFT JOIN v_dirs x ON x.tree = a.tree AND x.dir = regexp_extract(a.path, '^[^/]*/', 0)
LEFT JOIN vd d1 ON d1.config_id = a.config_id AND d1.guard_id = x.guard_id
LEFT JOIN v_dirs y ON y.tree = a.tree AND y.dir = regexp_extract(a.path, '^[^/]*/[^/]*/', 0)
LEFT JOIN vd d2 ON d2.config_id = a.config_id AND d2.guard_id = y.guard_id
""")
def _(v):
    objects, nodes, edges = g.conjoin_directories(v("objects").select("tree", "path", "guard_id"), v("dirs"), v("guard_nodes"), v("guard_edges"))
    store = g.build_store(nodes, edges, objects.select("tree", "guard_id").distinct())
    asks = v("asks").select("tree", "config_id", "path").join(objects, ["tree", "path"])
    return g.verdicts_for(asks, changed_of(v, store), store).select("tree", "config_id", "path", "built")


@query("g03_object_query", """
SELECT a.tree, a.config_id, a.path, a.kind, any_value(d.built) AS built,
       coalesce(string_agg(s.symbol || '=' || coalesce(c.value, 'n'), ' ' ORDER BY s.symbol), '') AS settings
FROM v_asks a JOIN v_verdicts d ON d.config_id = a.config_id AND d.guard_id = a.guard_id
LEFT JOIN (SELECT DISTINCT tree, guard_id, symbol FROM v_literals) s ON s.tree = a.tree AND s.guard_id = a.guard_id
LEFT JOIN v_config_values c ON c.config_id = a.config_id AND c.symbol = s.symbol GROUP BY 1, 2, 3, 4
""")
def _(v):
    from optlake.plans.explain import object_query
    store = store_of(v)
    closure = g.guard_leaves(v("guard_nodes"), v("guard_edges"), v("guards").select("tree", "guard_id"))
    return object_query(v("asks"), v("config_values"), g.guard_symbols(closure), changed_of(v, store), store)


@query("g04_guard_chain", """
WITH link AS (
  SELECT a.tree, a.config_id, a.path, length(x.dir) AS position, 'reached: ' || x.dir AS label, d.built FROM v_asks a
  JOIN v_dirs x ON x.tree = a.tree AND starts_with(a.path, x.dir) JOIN v_verdicts d ON d.config_id = a.config_id AND d.guard_id = x.guard_id
  UNION ALL SELECT a.tree, a.config_id, a.path, 1000, a.kind, d.built FROM v_asks a JOIN v_verdicts d ON d.config_id = a.config_id AND d.guard_id = a.guard_id)
SELECT tree, config_id, path, count(*) AS links, count(*) FILTER (built) AS holding, arg_min(label, position) FILTER (NOT built) AS first_failing
FROM link GROUP BY 1, 2, 3
""")
def _(v):
    from optlake.plans.explain import guard_chain
    store = store_of(v)
    links = guard_chain(v("asks"), v("dirs"))
    return g.first_failing_link(g.verdicts_for(links, changed_of(v, store), store))


@query("g05_pivotal_options", """
WITH off AS (SELECT DISTINCT a.tree, a.config_id, a.guard_id, d.gnum FROM v_asks a JOIN v_verdicts d ON d.config_id = a.config_id AND d.guard_id = a.guard_id WHERE NOT d.built),
cur AS (SELECT o.*, l.j, l.symbol, l.want, l.negated, CASE WHEN c.value IN ('y', 'm') THEN c.value ELSE 'n' END AS value
        FROM off o JOIN v_literals l ON l.tree = o.tree AND l.guard_id = o.guard_id LEFT JOIN v_config_values c ON c.config_id = o.config_id AND c.symbol = l.symbol),
trial AS (SELECT s.*, t.rank, t.val FROM (SELECT DISTINCT tree, config_id, guard_id, gnum, symbol AS tried, value AS was FROM cur) s
          JOIN (SELECT 0 AS rank, 'y' AS val UNION ALL SELECT 1, 'm' UNION ALL SELECT 2, 'n') t ON t.val <> s.was),
res AS (SELECT t.tree, t.config_id, t.guard_id, t.gnum, t.tried, t.was, t.rank, t.val,
          bool_or(CASE WHEN c.j = 0 THEN ((CASE WHEN c.symbol = t.tried THEN t.val ELSE c.value END) = c.want) <> c.negated END) AS t0,
          bool_or(CASE WHEN c.j = 1 THEN ((CASE WHEN c.symbol = t.tried THEN t.val ELSE c.value END) = c.want) <> c.negated END) AS t1,
          bool_or(CASE WHEN c.j = 2 THEN ((CASE WHEN c.symbol = t.tried THEN t.val ELSE c.value END) = c.want) <> c.negated END) AS t2
        FROM trial t JOIN cur c ON c.tree = t.tree AND c.config_id = t.config_id AND c.guard_id = t.guard_id GROUP BY ALL)
SELECT tree, config_id, guard_id, tried AS symbol, was AS current_value, arg_min(val, rank) AS suggested_value FROM res
WHERE CASE WHEN gnum % 3 = 0 THEN t0 AND t1 AND t2 WHEN gnum % 3 = 1 THEN t0 OR t1 OR t2 ELSE (t0 OR t1) AND t2 END GROUP BY 1, 2, 3, 4, 5
""")
def _(v):
    store = store_of(v)
    pairs = v("asks").select("tree", "config_id", "guard_id").distinct()
    off = g.verdicts_for(pairs, changed_of(v, store), store).where("NOT built")
    return g.pivotal_options(off, v("config_values"), v("guard_nodes"), v("guard_edges"))


SHAPES = """
shape AS (SELECT tree, guard_id, gnum, count(DISTINCT symbol) AS degree, count(*) FILTER (negated) AS nots,
          max(CASE WHEN negated THEN 1 ELSE 0 END) AS inner_not, max(CASE WHEN negated AND (j < 2) THEN 1 ELSE 0 END) AS sub_not,
          max(CASE WHEN negated AND (j = 2) THEN 1 ELSE 0 END) AS last_not,
          count(DISTINCT symbol || want || CAST(negated AS STRING)) AS lits,
          count(DISTINCT CASE WHEN j < 2 THEN symbol || want || CAST(negated AS STRING) END) AS sub_lits
          FROM v_literals GROUP BY 1, 2, 3)
"""


METRICS = """SELECT g.tree, g.guard_id, coalesce(count(DISTINCT l.symbol), 0) AS degree,
  CASE WHEN g.gnum = 0 THEN 1 WHEN g.gnum % 3 = 2 THEN greatest(3 + max(CASE WHEN negated AND j < 2 THEN 1 ELSE 0 END), 2 + max(CASE WHEN negated AND j = 2 THEN 1 ELSE 0 END))
       ELSE 2 + max(CASE WHEN negated THEN 1 ELSE 0 END) END AS height,
  CASE WHEN g.gnum = 0 THEN 1 ELSE 1 + CASE WHEN g.gnum % 3 = 2 THEN 1 ELSE 0 END + count(*) + count(*) FILTER (negated) END AS nodes
FROM v_guards g LEFT JOIN (SELECT tree, guard_id, symbol, want, negated, CASE WHEN gnum % 3 = 2 AND j < 2 THEN 0 ELSE 2 END AS j FROM v_literals GROUP BY ALL) l
  ON l.tree = g.tree AND l.guard_id = g.guard_id GROUP BY g.tree, g.guard_id, g.gnum
"""


def metrics(v):
    return g.guard_metrics(v("guard_nodes"), v("guard_edges").distinct(), v("guards").select("tree", "guard_id"))


@query("g06_guard_metrics", METRICS)
def _(v):
    return metrics(v)


@query("g06_guard_distribution", f"SELECT degree, height, count(*) AS guards, min(nodes) AS least_nodes, max(nodes) AS most_nodes FROM ({METRICS}) m GROUP BY 1, 2")
def _(v):
    n = F.count(F.lit(1))
    return metrics(v).groupBy("degree", "height").agg(n.alias("guards"), F.min("nodes").alias("least_nodes"), F.max("nodes").alias("most_nodes"))


@query("g06_top_guards", f"SELECT * FROM ({METRICS}) m ORDER BY degree DESC, nodes DESC, height DESC, tree, guard_id LIMIT 10")
def _(v):
    return metrics(v).orderBy(F.desc("degree"), F.desc("nodes"), F.desc("height"), "tree", "guard_id").limit(10)


@query("g07_symbol_references", """
SELECT l.symbol, count(DISTINCT (o.tree, o.path)) AS objects FROM v_objects o JOIN v_literals l ON l.tree = o.tree AND l.guard_id = o.guard_id GROUP BY 1
""")
def _(v):
    closure = g.guard_leaves(v("guard_nodes"), v("guard_edges"), v("guards").select("tree", "guard_id"))
    return g.symbol_references(v("objects"), g.guard_symbols(closure))


FORM = """
form AS (SELECT g.tree, g.guard_id, coalesce(CASE WHEN g.gnum % 3 = 2 THEN 'ao' WHEN g.gnum % 3 = 1 THEN 'o' ELSE 'a' END
  || string_agg(DISTINCT CASE WHEN g.gnum % 3 = 2 AND j < 2 THEN 's' ELSE 't' END || CASE WHEN negated THEN '!' ELSE '' END || symbol || '=' || want, ',' ORDER BY
     CASE WHEN g.gnum % 3 = 2 AND j < 2 THEN 's' ELSE 't' END || CASE WHEN negated THEN '!' ELSE '' END || symbol || '=' || want), 'true') AS form
  FROM v_guards g LEFT JOIN v_literals l ON l.tree = g.tree AND l.guard_id = g.guard_id GROUP BY g.tree, g.guard_id, g.gnum)
"""


@query("g08_co_compilation", f"""
WITH {FORM} SELECT o.tree, count(*) AS size, min(o.path) AS first_member FROM v_objects o JOIN form f ON f.tree = o.tree AND f.guard_id = o.guard_id GROUP BY o.tree, f.form
""")
def _(v):
    hashes = g.condition_hashes(v("guard_nodes"), v("guard_edges"), v("guards").select("tree", "guard_id"))
    return g.co_compilation(v("objects"), hashes).select("tree", "size", "first_member")


# all assignments of a guard's options in SQL: 0 undef, 1 y, 2 m per literal position
TABLE = """
val AS (SELECT 'undef' AS val UNION ALL SELECT 'y' UNION ALL SELECT 'm'),
lit AS (SELECT DISTINCT gnum, j, symbol, want, negated FROM v_literals),
tab AS (SELECT a.gnum, a.symbol AS s0, b.symbol AS s1, c.symbol AS s2, x.val AS v0, y.val AS v1, z.val AS v2,
          (x.val = a.want) <> a.negated AS t0, (y.val = b.want) <> b.negated AS t1, (z.val = c.want) <> c.negated AS t2
        FROM lit a JOIN lit b ON b.gnum = a.gnum AND b.j = 1 JOIN lit c ON c.gnum = a.gnum AND c.j = 2 AND a.j = 0
        CROSS JOIN val x CROSS JOIN val y CROSS JOIN val z
        WHERE (a.symbol <> b.symbol OR x.val = y.val) AND (a.symbol <> c.symbol OR x.val = z.val) AND (b.symbol <> c.symbol OR y.val = z.val)),
truth AS (SELECT gnum, s0, s1, s2, v0, v1, v2, CASE WHEN gnum % 3 = 0 THEN t0 AND t1 AND t2 WHEN gnum % 3 = 1 THEN t0 OR t1 OR t2 ELSE (t0 OR t1) AND t2 END AS ok FROM tab)
"""


@query("g09_dead_and_always", f"""
WITH {TABLE}, st AS (SELECT gnum, CASE WHEN NOT bool_or(ok) THEN 'dead' WHEN bool_and(ok) THEN 'always' ELSE 'mixed' END AS status FROM truth GROUP BY 1)
SELECT g.tree, g.guard_id, coalesce(st.status, 'always') AS status FROM v_guards g LEFT JOIN st ON st.gnum = g.gnum
""")
def _(v):
    return g.satisfiability(v("guard_nodes"), v("guard_edges"), v("guards").select("tree", "guard_id")).select("tree", "guard_id", "status")


# version 1 drops an object that version 2 keeps and the other way round; common objects
# move to the next guard of their tree
view("v_versions", """
SELECT tree, path, CASE WHEN size > 2 THEN guard_id END AS old,
       CASE WHEN size < 49 THEN CASE WHEN kind = 'rule' THEN lead(guard_id) OVER (PARTITION BY tree ORDER BY gnum, path) ELSE guard_id END END AS new
FROM v_objects
""")


@query("g10_condition_changes", f"""
WITH {TABLE}, pair AS (SELECT DISTINCT CAST(substr(old, 2) AS BIGINT) AS a, CAST(substr(new, 2) AS BIGINT) AS b FROM v_versions WHERE old <> new),
syms AS (SELECT DISTINCT p.a, p.b, l.symbol FROM pair p JOIN lit l ON l.gnum IN (p.a, p.b)),
num AS (SELECT a, b, symbol, row_number() OVER (PARTITION BY a, b ORDER BY symbol) - 1 AS i, count(*) OVER (PARTITION BY a, b) AS k FROM syms),
cells AS (SELECT a, b, n.w, list(symbol || '=' || CASE (n.w // CAST(pow(3, i) AS BIGINT)) % 3 WHEN 0 THEN 'undef' WHEN 1 THEN 'y' ELSE 'm' END ORDER BY i) AS cell
          FROM num CROSS JOIN range(729) n(w) WHERE n.w < pow(3, k) GROUP BY a, b, n.w),
ev AS (SELECT c.a, c.b, c.w, c.cell, g.gnum, bool_or(CASE WHEN l.j = 0 THEN list_contains(c.cell, l.symbol || '=' || l.want) <> l.negated END) AS t0,
         bool_or(CASE WHEN l.j = 1 THEN list_contains(c.cell, l.symbol || '=' || l.want) <> l.negated END) AS t1,
         bool_or(CASE WHEN l.j = 2 THEN list_contains(c.cell, l.symbol || '=' || l.want) <> l.negated END) AS t2
       FROM cells c JOIN (SELECT DISTINCT gnum FROM v_guards) g ON g.gnum IN (c.a, c.b) LEFT JOIN lit l ON l.gnum = g.gnum GROUP BY ALL),
vd AS (SELECT a, b, w, cell, max(CASE WHEN gnum = a THEN ok END) AS oa, max(CASE WHEN gnum = b THEN ok END) AS ob FROM (
         SELECT *, CAST(CASE WHEN gnum = 0 THEN TRUE WHEN gnum % 3 = 0 THEN t0 AND t1 AND t2 WHEN gnum % 3 = 1 THEN t0 OR t1 OR t2 ELSE (t0 OR t1) AND t2 END AS INT) AS ok FROM ev) GROUP BY a, b, w, cell),
ch AS (SELECT a, b, CASE WHEN bool_and(oa <= ob) AND bool_and(ob <= oa) THEN 'unchanged' WHEN bool_and(oa <= ob) THEN 'generalized' WHEN bool_and(ob <= oa) THEN 'restricted' ELSE 'diverged' END AS change,
         array_to_string(list_filter(arg_min(cell, w) FILTER (oa <> ob), lambda x: NOT ends_with(x, '=undef')), ' ') AS witness FROM vd GROUP BY 1, 2)
SELECT v.tree, v.path, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'retired' WHEN old = new THEN 'unchanged' ELSE ch.change END AS change,
       ch.witness FROM v_versions v LEFT JOIN ch ON 'g' || ch.a = v.old AND 'g' || ch.b = v.new AND v.old <> v.new WHERE old IS NOT NULL OR new IS NOT NULL
""")
def _(v):
    from optlake.plans.explain import evolution
    versions = v("versions")
    old = versions.where("old IS NOT NULL").selectExpr("tree", "path", "old AS guard_id")
    new = versions.where("new IS NOT NULL").selectExpr("tree", "path", "new AS guard_id")
    return evolution(old, new, v("guard_nodes"), v("guard_edges"))


@query("g11_same_names", """
WITH b AS MATERIALIZED (SELECT d.tree, d.config_id, regexp_extract(o.path, '[^/]*$', 0) AS name, o.path FROM v_verdicts d JOIN v_objects o ON o.tree = d.tree AND o.guard_id = d.guard_id WHERE d.built),
t AS (SELECT tree, config_id, name, count(*) AS together FROM b GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT b.tree, b.name, b.path, count(*) AS configs, min(b.config_id) AS witness, max(t.together) AS together FROM b JOIN t ON t.tree = b.tree AND t.config_id = b.config_id AND t.name = b.name GROUP BY 1, 2, 3
""")
def _(v):
    store = store_of(v)
    return g.same_name_groups(g.built_objects(v("configs"), v("objects"), changed_of(v, store), store))


view("v_units", """
SELECT l_orderkey AS file, l_linenumber AS line, CASE l_linenumber WHEN 1 THEN 'obj-y' WHEN 2 THEN 'hostprogs-y' WHEN 3 THEN 'obj-' WHEN 4 THEN 'spl-obj-y'
         WHEN 5 THEN 'extra-y' WHEN 6 THEN 'clean-files' ELSE 'lib-' END AS variable,
       'u' || CAST(l_partkey AS STRING) || CASE WHEN l_returnflag = 'A' THEN '.o' WHEN l_returnflag = 'R' THEN '.a' ELSE '.h' END AS word,
       l_quantity > 40 AS is_composite
FROM lineitem
""")


@query("g12_unit_kinds", """
SELECT unit_kind, count(*) AS n, count(*) FILTER (orphaned) AS orphaned FROM (
  SELECT CASE line WHEN 3 THEN CASE WHEN o THEN 'unconfigurable' END WHEN 2 THEN 'host program' WHEN 4 THEN CASE WHEN o THEN 'dialect' END WHEN 5 THEN 'extra'
     WHEN 6 THEN 'clean' WHEN 7 THEN CASE WHEN o THEN 'unconfigurable' END ELSE CASE WHEN o AND is_composite THEN 'composite' WHEN o THEN 'compilation' END END AS unit_kind,
     o AND variable LIKE '%-' AS orphaned
  FROM (SELECT *, word LIKE '%.o' OR word LIKE '%.a' AS o FROM v_units)) GROUP BY 1
""")
def _(v):
    return g.unit_kinds(v("units")).groupBy("unit_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("orphaned").alias("orphaned"))


@query("g19_subsystem_activity", """
SELECT d.tree, d.config_id, regexp_extract(o.path, '^[^/]*', 0) AS top, count(*) FILTER (d.built) AS built, count(*) AS total, count(*) FILTER (d.built)::DOUBLE / count(*) AS share FROM v_verdicts d
JOIN v_objects o ON o.tree = d.tree AND o.guard_id = d.guard_id GROUP BY 1, 2, 3
""")
def _(v):
    store = store_of(v)
    objects = v("objects").withColumn("top", F.split("path", "/")[0])
    counts = g.built_counts(v("configs"), objects, changed_of(v, store), store, "top")
    total = objects.groupBy("tree", "top").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(total, ["tree", "top"]).withColumn("share", F.col("built") / F.col("total"))
