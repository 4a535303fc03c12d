"""Configuration-shaped views of the given tables.

A customer stands for a source tree, its orders for the configurations of that tree,
order lines for assignments, and the parts a customer ever ordered for the tree's
objects. Work per view grows linearly with the tables. Stored views lie in buckets by tree
(lines by order), so what joins or groups them tree by tree moves no rows.
"""

from optlake.catalog.registry import view

view("v_lines", """
SELECT o.o_custkey AS tree, l.*, CAST(row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_returnflag) AS INT) AS line_no
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""", by="l_orderkey")

# assignments with position; switches, numbers and quoted strings
view("v_config_lines", """
SELECT tree, l_orderkey AS config_id, line_no, 'CONFIG_S' || CAST(l_partkey % 40 AS STRING) AS symbol,
       CASE WHEN l_linenumber = 6 THEN CAST(CAST(l_quantity AS INT) AS STRING)
            WHEN l_linenumber = 7 THEN '"' || l_linestatus || '-tag"'
            WHEN l_returnflag = 'A' THEN 'y' WHEN l_returnflag = 'R' THEN 'm' ELSE 'n' END AS value
FROM v_lines
""")
view("v_config_values", """
SELECT tree, config_id, line_no, symbol, value FROM (
  SELECT *, row_number() OVER (PARTITION BY config_id, symbol ORDER BY line_no DESC) AS rn FROM v_config_lines) t
WHERE rn = 1
""", by="tree")
view("v_configs", "SELECT o_orderkey AS config_id, o_custkey AS tree, o_totalprice AS budget, o_orderdate AS made FROM orders", by="tree")
# Spark's texts of the following views explode rows where they lie and join a tree's parts
# once each; the second texts are the ones that check them
view("v_objects", """
SELECT l.tree, p.path, p.part, p.gnum, p.guard_id, p.size, p.kind
FROM (SELECT DISTINCT tree, l_partkey FROM (SELECT /*+ REPARTITION(tree) */ tree, l_partkey FROM v_lines)) l
JOIN (SELECT DISTINCT CASE WHEN p.p_size < 10 THEN 'arch/arm/' WHEN p.p_size < 20 THEN 'net/' ELSE 'drivers/' END
         || lower(p.p_type) || '/' || replace(lower(p.p_brand), '#', '') || '/u' || CAST(CAST(floor(p.p_partkey / 50.0) AS INT) AS STRING)
         || '/f' || CAST(p.p_partkey % 50 AS STRING) || '.o' AS path,
       p.p_partkey AS part, p.p_partkey % 97 AS gnum, 'g' || CAST(p.p_partkey % 97 AS STRING) AS guard_id, p.p_size AS size,
       CASE p.p_partkey % 4 WHEN 0 THEN 'member' WHEN 1 THEN 'rule' ELSE 'target' END AS kind FROM part p) p ON l.l_partkey = p.part
""", """
SELECT DISTINCT l.tree,
       CASE WHEN p.p_size < 10 THEN 'arch/arm/' WHEN p.p_size < 20 THEN 'net/' ELSE 'drivers/' END
         || lower(p.p_type) || '/' || replace(lower(p.p_brand), '#', '') || '/u' || CAST(CAST(floor(p.p_partkey / 50.0) AS INT) AS STRING)
         || '/f' || CAST(p.p_partkey % 50 AS STRING) || '.o' AS path,
       p.p_partkey AS part, p.p_partkey % 97 AS gnum, 'g' || CAST(p.p_partkey % 97 AS STRING) AS guard_id, p.p_size AS size,
       CASE p.p_partkey % 4 WHEN 0 THEN 'member' WHEN 1 THEN 'rule' ELSE 'target' END AS kind
FROM v_lines l JOIN part p ON l.l_partkey = p.p_partkey
""", by="tree")
# guards: g0 is constant true, the others have three literals in three shapes
view("v_guards", "SELECT DISTINCT tree, guard_id, gnum FROM v_objects", by="tree")
# three literals for each guard; for g0 one row that stands for none
view("v_terms", """
SELECT tree, guard_id, gnum, j, 'CONFIG_S' || CAST((gnum * (j + 1) + j) % 40 AS STRING) AS symbol,
       CASE WHEN (gnum + j) % 3 = 0 THEN 'm' ELSE 'y' END AS want, (gnum + j) % 4 = 1 AS negated
FROM (SELECT tree, guard_id, gnum, explode(CASE WHEN gnum = 0 THEN array(0) ELSE array(0, 1, 2) END) AS j FROM v_guards) g
""")
view("v_literals", "SELECT * FROM v_terms WHERE gnum <> 0", """
SELECT tree, guard_id, gnum, j, 'CONFIG_S' || CAST((gnum * (j + 1) + j) % 40 AS STRING) AS symbol,
       CASE WHEN (gnum + j) % 3 = 0 THEN 'm' ELSE 'y' END AS want, (gnum + j) % 4 = 1 AS negated
FROM (SELECT *, 0 AS j FROM v_guards UNION ALL SELECT *, 1 AS j FROM v_guards UNION ALL SELECT *, 2 AS j FROM v_guards) g WHERE gnum <> 0
""")
view("v_guard_nodes", """
SELECT DISTINCT * FROM (SELECT tree, inline(array(
  named_struct('node_id', CASE WHEN gnum <> 0 THEN symbol || '=' || want END, 'op', 'eq', 'symbol', symbol, 'want', want, 'level', 0),
  named_struct('node_id', CASE WHEN gnum <> 0 AND negated THEN '!' || symbol || '=' || want END, 'op', 'not', 'symbol', CAST(NULL AS STRING), 'want', CAST(NULL AS STRING), 'level', 1),
  named_struct('node_id', CASE WHEN j = 0 AND gnum % 3 = 2 THEN 'sub' || guard_id END, 'op', 'or', 'symbol', CAST(NULL AS STRING), 'want', CAST(NULL AS STRING), 'level', 2),
  named_struct('node_id', CASE WHEN j = 0 THEN guard_id END, 'op', CASE WHEN gnum = 0 THEN 'true' WHEN gnum % 3 = 1 THEN 'or' ELSE 'and' END,
               'symbol', CAST(NULL AS STRING), 'want', CAST(NULL AS STRING), 'level', CASE WHEN gnum = 0 THEN 0 ELSE 3 END))) FROM v_terms) WHERE node_id IS NOT NULL
""", """
SELECT DISTINCT tree, symbol || '=' || want AS node_id, 'eq' AS op, symbol, want, 0 AS level FROM v_literals
UNION ALL SELECT DISTINCT tree, '!' || symbol || '=' || want, 'not', NULL, NULL, 1 FROM v_literals WHERE negated
UNION ALL SELECT tree, 'sub' || guard_id, 'or', NULL, NULL, 2 FROM v_guards WHERE gnum % 3 = 2
UNION ALL SELECT tree, guard_id, CASE WHEN gnum = 0 THEN 'true' WHEN gnum % 3 = 1 THEN 'or' ELSE 'and' END, NULL, NULL,
                 CASE WHEN gnum = 0 THEN 0 ELSE 3 END FROM v_guards
""", by="tree")
view("v_guard_edges", """
SELECT * FROM (SELECT tree, inline(array(
  named_struct('parent', CASE WHEN gnum % 3 = 2 AND j < 2 THEN 'sub' || guard_id ELSE guard_id END, 'child', CASE WHEN negated THEN '!' ELSE '' END || symbol || '=' || want),
  named_struct('parent', CASE WHEN j = 0 AND gnum % 3 = 2 THEN guard_id END, 'child', 'sub' || guard_id))) FROM v_terms WHERE gnum <> 0) WHERE parent IS NOT NULL
UNION ALL SELECT tree, node_id, substr(node_id, 2) FROM v_guard_nodes WHERE op = 'not'
""", """
SELECT tree, CASE WHEN gnum % 3 = 2 AND j < 2 THEN 'sub' || guard_id ELSE guard_id END AS parent,
       CASE WHEN negated THEN '!' ELSE '' END || symbol || '=' || want AS child FROM v_literals
UNION ALL SELECT DISTINCT tree, '!' || symbol || '=' || want, symbol || '=' || want FROM v_literals WHERE negated
UNION ALL SELECT tree, guard_id, 'sub' || guard_id FROM v_guards WHERE gnum % 3 = 2
""", by="tree")
# what the builds left behind
view("v_inventory", """
SELECT c.tree, c.config_id, o.path FROM v_configs c JOIN v_objects o ON c.tree = o.tree WHERE o.size * 10000 < c.budget
UNION ALL SELECT tree, config_id, 'scripts/host.o' FROM v_configs
""")
# direct evaluation of every (configuration, guard of its tree), used only by checks
view("v_verdicts", """
SELECT b.tree, b.config_id, b.guard_id, b.gnum,
       CASE WHEN b.gnum = 0 THEN TRUE WHEN b.gnum % 3 = 0 THEN t0 AND t1 AND t2
            WHEN b.gnum % 3 = 1 THEN t0 OR t1 OR t2 ELSE (t0 OR t1) AND t2 END AS built
FROM (SELECT c.tree, c.config_id, g.guard_id, g.gnum,
             coalesce(bool_or(CASE WHEN l.j = 0 THEN (coalesce(v.value, 'undef') = l.want) <> l.negated END), FALSE) AS t0,
             coalesce(bool_or(CASE WHEN l.j = 1 THEN (coalesce(v.value, 'undef') = l.want) <> l.negated END), FALSE) AS t1,
             coalesce(bool_or(CASE WHEN l.j = 2 THEN (coalesce(v.value, 'undef') = l.want) <> l.negated END), FALSE) AS t2
      FROM v_configs c JOIN v_guards g ON c.tree = g.tree
      LEFT JOIN v_literals l ON l.tree = g.tree AND l.guard_id = g.guard_id
      LEFT JOIN v_config_values v ON v.config_id = c.config_id AND v.symbol = l.symbol
      GROUP BY c.tree, c.config_id, g.guard_id, g.gnum) b
""")
