"""Assignment queries."""

from pyspark.sql import functions as F

from optlake.catalog import views  # noqa: F401
from optlake.catalog.registry import VIEWS, query, view
from optlake.functions import tristate as t
from optlake.functions import values as val
from optlake.operators import assignments as a
from optlake.operators import guards as g
from optlake.sources import configs as src
from optlake.session import shared_folder

TRI = "CASE {} WHEN 'y' THEN 2 WHEN 'm' THEN 1 WHEN 'n' THEN 0 END"

# configuration texts: a header comment, one line per assignment, one unreadable line
LINE = "CASE WHEN value = 'n' THEN '# ' || symbol || ' is not set' ELSE symbol || '=' || value END"
view("v_config_texts", f"""
SELECT tree, config_id, '# generated' || chr(10) || listagg({LINE}, chr(10)) WITHIN GROUP (ORDER BY line_no) || chr(10) || 'stray words' AS text
FROM v_config_lines GROUP BY tree, config_id
""", f"""
SELECT tree, config_id, '# generated' || chr(10) || string_agg({LINE}, chr(10) ORDER BY line_no) || chr(10) || 'stray words' AS text
FROM v_config_lines GROUP BY tree, config_id
""", keep=True)
# each configuration with the next one of its tree
view("v_pairs", """
SELECT tree, config_id AS merge_id, config_id AS base_id, lead(config_id) OVER (PARTITION BY tree ORDER BY config_id) AS next_id FROM v_configs
""")
view("v_base", "SELECT merge_id, line_no, symbol, value FROM v_pairs p JOIN v_config_values c ON c.config_id = p.base_id WHERE p.next_id IS NOT NULL")
view("v_next", "SELECT merge_id, symbol, value FROM v_pairs p JOIN v_config_values c ON c.config_id = p.next_id")
view("v_selects", """
SELECT DISTINCT 'CONFIG_S' || CAST(p_partkey % 40 AS STRING) AS src, 'CONFIG_S' || CAST((p_partkey * 7 + 3) % 40 AS STRING) AS dst,
       'CONFIG_S' || CAST((p_partkey * 11 + 5) % 40 AS STRING) AS dep FROM part
""")


@query("s01_config_positions", """
SELECT config_id, line_no + 1 AS line_no, symbol, value, CASE WHEN value = 'n' THEN 'unset' ELSE 'set' END AS kind FROM v_config_lines
UNION ALL SELECT config_id, max(line_no) + 2, NULL, 'stray words', 'unparsed' FROM v_config_lines GROUP BY config_id
""")
def _(v):
    return src.config_rows(v("config_texts").select("config_id", "text"))


@query("s01_config_raw", "SELECT config_id, line_no + 1 AS line_no, symbol, value FROM v_config_lines WHERE value <> 'n'")
def _(v):
    return src.config_rows(v("config_texts").select("config_id", "text"), "raw").drop("kind")


@query("s01_config_values", "SELECT config_id, symbol, trim(value, '\"') AS value FROM v_config_values")
def _(v):
    return a.last_assignment(src.config_rows(v("config_texts").select("config_id", "text"), "values"), ["config_id"])


@query("s02_fragment_scan", """
SELECT config_id, count(*) + 1 AS readable, count(*) FILTER (value = 'n') AS disables, count(*) FILTER (value <> 'n') AS assigns FROM v_config_lines GROUP BY 1
""")
def _(v):
    rows = src.fragment_rows(v("config_texts").select("config_id", "text"))
    return rows.groupBy("config_id").agg(F.count(F.lit(1)).alias("readable"), F.count_if(F.col("kind") == "disable").alias("disables"),
                                         F.count_if(F.col("kind") == "assign").alias("assigns"))


@query("s02_fragment_values", """
SELECT config_id, symbol, coalesce(arg_max(trim(value, '"'), line_no) FILTER (value <> 'n'), 'n') AS value FROM v_config_lines GROUP BY 1, 2
""")
def _(v):
    return src.fragment_values(src.fragment_rows(v("config_texts").select("config_id", "text")), ["config_id"])


@query("s37_config_sink", "SELECT config_id, symbol, CASE WHEN value LIKE '\"%' THEN value || '\"' ELSE value END AS value FROM (SELECT config_id, symbol, CASE WHEN value LIKE '\"%' THEN '\"' || value ELSE value END AS value FROM v_config_values)")
def _(v):
    import uuid
    path = f"{shared_folder(v.spark)}/configs-{uuid.uuid4().hex}"
    src.write_config_texts(src.config_texts(v("config_values"), ["config_id"]), path)
    back = v.spark.read.schema("config_id long, text string").json(path)
    return src.config_rows(back).select("config_id", "symbol", "value")


@query("p01_tristate_algebra", f"""
SELECT b.merge_id, b.symbol, least(x, y) AS both, greatest(x, y) AS either, 2 - x AS negated, x < y AS below FROM (
 SELECT b.merge_id, b.symbol, {TRI.format('b.value')} AS x, {TRI.format('n.value')} AS y FROM v_base b JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol) b
""")
def _(v):
    x, y = t.tri(F.col("value")), t.tri(F.col("other"))
    pair = v("base").join(v("next").withColumnRenamed("value", "other"), ["merge_id", "symbol"])
    return pair.select("merge_id", "symbol", t.tri_and(x, y).alias("both"), t.tri_or(x, y).alias("either"), t.tri_not(x).alias("negated"), (x < y).alias("below"))


FORCED = f"""
forced AS (SELECT c.config_id, s.src, s.dst, coalesce({TRI.format('c.value')}, 0) AS force, coalesce({TRI.format('d.value')}, 0) AS lim
  FROM v_config_values c JOIN v_selects s ON s.src = c.symbol LEFT JOIN v_config_values d ON d.config_id = c.config_id AND d.symbol = s.dep)
"""


@query("p02_select_force", f"WITH {FORCED} SELECT force, count(*) AS n FROM forced GROUP BY 1")
def _(v):
    return a.unmet_selects(v("config_values"), v("selects")).groupBy("force").agg(F.count(F.lit(1)).alias("n"))


@query("p03_unmet_dependencies", f"WITH {FORCED} SELECT config_id, src, dst, force, lim AS \"limit\" FROM forced WHERE lim < force")
def _(v):
    return a.unmet_selects(v("config_values"), v("selects")).where("unmet").drop("unmet", "unmet_bool")


@query("p04_missed_by_bool", f"WITH {FORCED} SELECT config_id, src, dst FROM forced WHERE lim < force AND NOT (force >= 1 AND lim < 1)")
def _(v):
    return a.unmet_selects(v("config_values"), v("selects")).where("unmet AND NOT unmet_bool").select("config_id", "src", "dst")


@query("p05_dual_encoding", f"""
SELECT config_id, symbol, {TRI.format('value')} >= 1 AS is_on, {TRI.format('value')} = 2 AS built_in, value AS back, TRUE AS ok FROM v_config_values WHERE value IN ('y', 'm', 'n')
""")
def _(v):
    rows = v("config_values").where("value IN ('y', 'm', 'n')").withColumn("d", t.to_dual(t.tri(F.col("value"))))
    return rows.select("config_id", "symbol", F.col("d.on").alias("is_on"), "d.built_in", t.text(t.from_dual(F.col("d"))).alias("back"), t.dual_ok(F.col("d")).alias("ok"))


@query("p06_value_lookup", """
SELECT p.merge_id, b.symbol, coalesce(n.value, 'n') AS value, CASE WHEN n.value IN ('y', 'm') THEN n.value ELSE 'n' END AS switch
FROM v_pairs p JOIN v_base b ON b.merge_id = p.merge_id LEFT JOIN v_next n ON n.merge_id = p.merge_id AND n.symbol = b.symbol
""")
def _(v):
    rows = v("base").select("merge_id", "symbol").join(v("next"), ["merge_id", "symbol"], "left")
    return rows.select("merge_id", "symbol", val.or_off(F.col("value")).alias("value"), val.switch(F.col("value")).alias("switch"))


@query("p07_normalized_values", "SELECT config_id, line_no, trim(value, '\"') AS value FROM v_config_lines")
def _(v):
    return v("config_lines").select("config_id", "line_no", val.normalize(F.col("value")).alias("value"))


@query("p08_assignment_lines", """
SELECT config_id, line_no, CASE WHEN value = 'n' THEN '# ' || symbol || ' is not set' WHEN value IN ('y', 'm') OR regexp_matches(value, '^[0-9]+$') THEN symbol || '=' || value ELSE symbol || '="' || value || '"' END AS merged_line,
  CASE WHEN value = 'n' THEN '# ' || symbol || ' is not set' ELSE symbol || '=' || value END AS proposal_line FROM v_config_lines
""")
def _(v):
    s, x = F.col("symbol"), F.col("value")
    return v("config_lines").select("config_id", "line_no", val.config_line(s, x).alias("merged_line"), val.proposal_line(s, x).alias("proposal_line"))


@query("w01_last_assignment", "SELECT config_id, symbol, value FROM v_config_values")
def _(v):
    return a.last_assignment(v("config_lines"), ["config_id"])


@query("a17_duplicate_assignments", """
SELECT config_id, symbol, count(*) AS times, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS at FROM v_config_lines GROUP BY 1, 2 HAVING count(*) > 1
""")
def _(v):
    return a.duplicate_assignments(v("config_lines"), ["config_id"])


@query("a18_enabled_counts", """
SELECT config_id, count(*) FILTER (value = 'm') AS modules, count(*) FILTER (value = 'y') AS built_in, count(*) FILTER (value IN ('y', 'm')) AS enabled FROM v_config_values GROUP BY 1
""")
def _(v):
    return a.enabled_counts(v("config_values"), ["config_id"])


view("v_merge_base", "SELECT merge_id, line_no, symbol, value FROM v_pairs p JOIN v_config_lines c ON c.config_id = p.base_id WHERE p.next_id IS NOT NULL")
MERGED = """
merged AS (SELECT b.merge_id, b.line_no, b.symbol, b.value AS old, coalesce(n.value, b.value) AS value,
    CASE WHEN n.value IS NULL THEN 'base only' WHEN n.value = b.value THEN 'no-op' ELSE 'override' END AS change
  FROM v_merge_base b LEFT JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol
  UNION ALL SELECT n.merge_id, NULL, n.symbol, NULL, n.value, 'fragment only' FROM v_next n
  WHERE NOT EXISTS (SELECT 1 FROM v_merge_base b WHERE b.merge_id = n.merge_id AND b.symbol = n.symbol))
"""


@query("j17_fragment_merge", f"""
WITH {MERGED} SELECT merge_id, line_no, symbol, old, value, change, CASE WHEN value = 'n' THEN '# ' || symbol || ' is not set'
  WHEN change IN ('base only', 'no-op') OR value IN ('y', 'm') OR regexp_matches(value, '^[0-9]+$') THEN symbol || '=' || value ELSE symbol || '="' || value || '"' END AS line FROM merged
""")
def _(v):
    return a.merge_fragment(v("merge_base"), v("next"))


@query("j17_merge_report", f"""
WITH {MERGED} SELECT merge_id, count(*) FILTER (change = 'override') AS overrides, count(*) FILTER (change = 'no-op') AS no_ops,
  count(*) FILTER (change = 'base only') AS base_only, count(*) FILTER (change = 'fragment only') AS added FROM merged GROUP BY 1
""")
def _(v):
    return a.merge_report(a.merge_fragment(v("merge_base"), v("next")))


@query("j17_removals", """
SELECT b.merge_id AS config_id, line_no, symbol, CASE WHEN n.value = 'n' THEN 'n' ELSE b.value END AS value
FROM v_merge_base b LEFT JOIN v_next n USING (merge_id, symbol)
WHERE n.value IS DISTINCT FROM 'n' OR line_no = (SELECT min(line_no) FROM v_merge_base x WHERE x.merge_id = b.merge_id AND x.symbol = b.symbol)
UNION ALL SELECT n.merge_id, NULL, n.symbol, 'n' FROM v_next n WHERE n.value = 'n' AND NOT EXISTS (SELECT 1 FROM v_merge_base b WHERE b.merge_id = n.merge_id AND b.symbol = n.symbol)
""")
def _(v):
    wanted = v("next").where("value = 'n'").selectExpr("merge_id AS config_id", "symbol")
    return a.removals(v("merge_base").withColumnRenamed("merge_id", "config_id"), wanted)


view("v_load_bearing", "SELECT DISTINCT p.merge_id, l.symbol, 'guards an object' AS reason FROM v_pairs p JOIN v_literals l ON l.tree = p.tree WHERE p.next_id IS NOT NULL")


@query("j18_lost_load_bearing", """
SELECT l.merge_id, l.symbol, l.reason, coalesce(n.value, 'missing') AS actual FROM v_load_bearing l
JOIN v_base b ON b.merge_id = l.merge_id AND b.symbol = l.symbol AND b.value IN ('y', 'm')
LEFT JOIN v_next n ON n.merge_id = l.merge_id AND n.symbol = l.symbol WHERE coalesce(n.value, 'missing') NOT IN ('y', 'm')
""")
def _(v):
    base = v("base")
    return a.lost_load_bearing(a.bearing_symbols(v("pairs"), v("literals"), base), base, v("next"))


@query("j19_config_check", """
WITH live AS (SELECT choice, bool_or(is_current) AS live FROM v_surface WHERE kind = 'choice' GROUP BY 1),
r AS (SELECT b.merge_id, b.symbol, b.value, s.kind, l.live, TRY_CAST(trim(b.value, '"') AS BIGINT) AS num, s.lo, s.hi FROM v_base b LEFT JOIN v_surface s ON s.symbol = b.symbol LEFT JOIN live l ON l.choice = s.choice)
SELECT merge_id, symbol, 'unknown symbol' AS finding, TRUE AS is_error FROM r WHERE kind IS NULL
UNION ALL SELECT merge_id, symbol, 'dead-letter choice', FALSE FROM r WHERE kind = 'choice' AND NOT live AND value = 'y'
UNION ALL SELECT merge_id, symbol, 'out of range', TRUE FROM r WHERE kind = 'tunable' AND num IS NOT NULL AND NOT (num BETWEEN lo AND hi OR num = 50)
UNION ALL SELECT b.merge_id, b.symbol, 'stripped', FALSE FROM v_base b JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol AND n.value <> b.value
""")
def _(v):
    surface = v("surface").withColumn("ranges", F.expr("CASE WHEN kind = 'tunable' THEN array(named_struct('lo', CAST(lo AS STRING), 'hi', CAST(hi AS STRING)), named_struct('lo', '0x32', 'hi', '50')) END")).drop("lo", "hi")
    return a.check_against_surface(v("base"), surface, v("next"))


view("v_surface", """
SELECT DISTINCT 'CONFIG_S' || CAST(p_partkey % 40 AS STRING) AS symbol,
       CASE WHEN p_partkey % 40 < 12 THEN 'toggle' WHEN p_partkey % 40 < 22 THEN 'choice' ELSE 'tunable' END AS kind,
       CASE WHEN p_partkey % 40 BETWEEN 12 AND 21 THEN 'c' || CAST(p_partkey % 40 % 3 AS STRING) END AS choice, p_partkey % 40 = 13 AS is_current,
       CASE WHEN p_partkey % 40 < 12 THEN 'bool' WHEN p_partkey % 2 = 0 THEN 'int' ELSE 'hex' END AS type, p_partkey % 40 - 10 AS lo, p_partkey % 40 + 5 AS hi
FROM part WHERE p_partkey % 40 < 36
""")


@query("j20_proposed_vs_actual", """
SELECT b.merge_id, count(*) AS proposed, count(*) FILTER (n.value = b.value) AS landed,
  coalesce(string_agg(b.symbol, ' ' ORDER BY b.symbol) FILTER (n.value IS DISTINCT FROM b.value), '') AS dropped
FROM v_base b LEFT JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol GROUP BY 1
""")
def _(v):
    return a.proposed_vs_actual(v("base"), v("next"))


@query("j22_upgrade_diff", """
SELECT b.merge_id, b.symbol, b.value AS old, n.value AS "new", CASE WHEN n.value IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM v_base b LEFT JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol WHERE n.value IS DISTINCT FROM b.value
""")
def _(v):
    return a.upgrade_diff(v("base"), v("next"))


@query("j23_bisect_trials", """
SELECT coalesce(b.merge_id, n.merge_id) AS merge_id, coalesce(b.symbol, n.symbol) AS symbol, coalesce(n.value, 'n') AS bad_value, coalesce(b.value, 'n') AS restored_value
FROM v_base b FULL JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol WHERE coalesce(n.value, 'n') <> coalesce(b.value, 'n')
""")
def _(v):
    return a.bisect_trials(v("base"), v("next"))


@query("j23_likely_causes", """
SELECT b.merge_id, b.symbol FROM v_base b JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol WHERE n.value <> b.value AND b.line_no % 2 = 1
""")
def _(v):
    results = v("base").select("merge_id", "symbol", F.when(F.col("line_no") % 2 == 1, "pass").otherwise("fail").alias("test"))
    known = v("next").select("merge_id", "symbol")
    return a.likely_causes(a.bisect_trials(v("base"), v("next")), results).join(known, ["merge_id", "symbol"], "left_semi").select("merge_id", "symbol")


@query("j25_value_mismatches", """
SELECT b.merge_id, b.symbol, b.value AS config_value, n.value AS model_value FROM v_base b JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol WHERE n.value <> b.value
""")
def _(v):
    return a.value_mismatches(v("base"), v("next"))


# requirements: the guard shapes with requirement leaves
view("v_req_literals", """
SELECT tree, guard_id, gnum, j, symbol, CASE j WHEN 0 THEN 'equals:' || want WHEN 1 THEN 'allowed:y|m' ELSE 'range:0x5..30' END AS want, negated FROM v_literals
""")
view("v_req_terms", """
SELECT tree, guard_id, gnum, j, symbol, CASE j WHEN 0 THEN 'equals:' || want WHEN 1 THEN 'allowed:y|m' ELSE 'range:0x5..30' END AS want, negated FROM v_terms
""")
for name in ("guard_nodes", "guard_edges"):
    text, check = VIEWS[f"v_{name}"]
    view(f"v_req_{name[6:]}", text.replace("v_terms", "v_req_terms").replace("v_guard_nodes", "v_req_nodes"), check.replace("v_literals", "v_req_literals"), by="tree")
REQ = """
leaf AS (SELECT c.config_id, g.tree, g.guard_id, g.gnum, l.j, l.negated, coalesce(v.value, 'n') AS value, l.want FROM v_configs c JOIN v_guards g ON c.tree = g.tree
  LEFT JOIN v_req_literals l ON l.tree = g.tree AND l.guard_id = g.guard_id LEFT JOIN v_config_values v ON v.config_id = c.config_id AND v.symbol = l.symbol),
truth AS (SELECT config_id, tree, guard_id, gnum, bool_or(CASE WHEN j = 0 THEN ok <> negated END) AS t0, bool_or(CASE WHEN j = 1 THEN ok <> negated END) AS t1, bool_or(CASE WHEN j = 2 THEN ok <> negated END) AS t2
  FROM (SELECT *, CASE j WHEN 0 THEN value = substr(want, 8) WHEN 1 THEN value IN ('y', 'm') ELSE coalesce(TRY_CAST(value AS BIGINT) BETWEEN 5 AND 30, FALSE) END AS ok FROM leaf) GROUP BY 1, 2, 3, 4),
req AS (SELECT config_id, tree, guard_id, CASE WHEN gnum = 0 THEN TRUE WHEN gnum % 3 = 0 THEN t0 AND t1 AND t2 WHEN gnum % 3 = 1 THEN t0 OR t1 OR t2 ELSE (t0 OR t1) AND t2 END AS met FROM truth)
"""


def requirement_store(v):
    return v.once("requirement store", lambda: g.build_store(v("req_nodes"), v("req_edges"), v("guards").select("tree", "guard_id"), a.requirement_leaf))


def requirements_met(v):
    store = requirement_store(v)
    return g.guard_verdicts_on(v("configs"), g.changed_verdicts(v("config_values"), store), store)


@query("p12_requirements_met", f"WITH {REQ} SELECT tree, config_id, guard_id FROM req WHERE met")
def _(v):
    return requirements_met(v)


view("v_targets", "SELECT tree, guard_id, gnum % 3 AS kind FROM v_guards")


@query("p12_requirements_for_target", f"""
WITH {REQ} SELECT r.tree, r.config_id, r.guard_id, r.met FROM req r JOIN v_targets t ON t.tree = r.tree AND t.guard_id = r.guard_id WHERE t.kind <> 2
""")
def _(v):
    # requirements of kind 0 have no target, of kind 1 name two architectures, of kind 2 another
    targets = v("targets").withColumn("target", F.when(F.col("kind") == 1, F.array(F.lit("arm64"), F.lit("x86_64"))).when(F.col("kind") == 2, F.array(F.lit("arm64"))))
    mine = targets.where(a.applies(F.col("target"), "x86_64")).select("tree", "guard_id")
    met = requirements_met(v).withColumn("met", F.lit(True))
    asked = v("configs").select("tree", "config_id").join(mine, "tree")
    return asked.join(met, ["tree", "config_id", "guard_id"], "left").na.fill(False, ["met"]).select("tree", "config_id", "guard_id", "met")


view("v_recipes", """
SELECT event_id AS recipe_id, '{"all": [{"symbol": "' || event_type || '", "note": "say ' || chr(92) || '"exec' || chr(92) || '": no"}, {"'
   || CASE WHEN value > 40 THEN 'shell' WHEN value > 30 THEN 'shells' ELSE 'equals' END || '": 1}]}' AS body FROM events
""")


@query("p13_unsafe_recipes", "SELECT recipe_id FROM v_recipes WHERE body LIKE '%{\"shell\": 1}%'")
def _(v):
    return v("recipes").where(a.unsafe_recipe(F.col("body"))).select("recipe_id")


# submitted texts: the configuration with lines that no rule takes in front, by the id
view("v_submitted", """
SELECT config_id, CASE config_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'FOO=y' || chr(10) WHEN 2 THEN 'stray words' || chr(10) || 'CONFIG_BAD-NAME=y' || chr(10) ELSE ' CONFIG_BAD NAME=m' || chr(10) END || replace(text, 'stray words', '') AS text FROM v_config_texts
""")
UNREAD = """
unread AS (SELECT config_id, CASE config_id % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS n, CASE config_id % 4 WHEN 1 THEN '1: no option prefix' WHEN 2 THEN '1: no assignment' WHEN 3 THEN '1: bad option name' ELSE '' END AS place FROM v_submitted)
"""


@query("j21_rejected_lines", """
SELECT config_id, 1 AS line_no, CASE config_id % 4 WHEN 1 THEN 'FOO=y' WHEN 2 THEN 'stray words' ELSE ' CONFIG_BAD NAME=m' END AS line, CASE config_id % 4 WHEN 1 THEN 'no option prefix' WHEN 2 THEN 'no assignment' ELSE 'bad option name' END AS reason FROM v_submitted WHERE config_id % 4 > 0
UNION ALL SELECT config_id, 2, 'CONFIG_BAD-NAME=y', 'bad option name' FROM v_submitted WHERE config_id % 4 = 2
""")
def _(v):
    return src.rejected_lines(v("submitted"))


@query("j21_requirement_report", f"""
WITH {REQ}, {UNREAD}, bad AS (SELECT config_id, count(*) FILTER (NOT met) AS violations FROM req GROUP BY 1),
dup AS (SELECT config_id, count(*) AS duplicates FROM (SELECT config_id FROM v_config_lines GROUP BY config_id, symbol HAVING count(*) > 1) GROUP BY 1),
ine AS (SELECT b.merge_id, count(*) FILTER (coalesce(n.value, 'n') <> b.value) AS ineffective FROM v_base b LEFT JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol GROUP BY 1)
SELECT p.merge_id, coalesce(b2.violations, 0) AS violations, coalesce(b1.violations, 0) AS baseline_violations, coalesce(i.ineffective, 0) AS ineffective,
  coalesce(d.duplicates, 0) AS duplicates, coalesce(u2.n, 0) AS unparsed, coalesce(u1.n, 0) AS baseline_unparsed, coalesce(u2.place, '') AS first_unparsed,
  CASE WHEN coalesce(b2.violations, 0) > 0 THEN 'violation' WHEN coalesce(u2.n, 0) > 0 THEN 'incomplete' ELSE 'pass' END AS status
FROM v_pairs p LEFT JOIN unread u1 ON u1.config_id = p.base_id LEFT JOIN unread u2 ON u2.config_id = p.next_id LEFT JOIN bad b1 ON b1.config_id = p.base_id LEFT JOIN bad b2 ON b2.config_id = p.next_id LEFT JOIN dup d ON d.config_id = p.base_id LEFT JOIN ine i ON i.merge_id = p.merge_id
WHERE p.next_id IS NOT NULL
""")
def _(v):
    from optlake.plans.requirements import requirement_report
    store = requirement_store(v)
    holding = g.holding_counts(v("configs"), g.changed_verdicts(v("config_values"), store), store)
    return requirement_report(v("pairs").where("next_id IS NOT NULL"), v("guards"), holding, v("config_lines"), v("base"), v("next"), src.rejected_lines(v("submitted")))


@query("a15_check_rollup", """
SELECT p.tree, count(b.symbol) AS symbols, count(*) FILTER (n.value <> b.value) AS mismatches FROM v_pairs p JOIN v_base b ON b.merge_id = p.merge_id
JOIN v_next n ON n.merge_id = b.merge_id AND n.symbol = b.symbol GROUP BY ROLLUP (p.tree)
""")
def _(v):
    rows = v("base").join(v("next").withColumnRenamed("value", "model"), ["merge_id", "symbol"]).join(v("pairs").select("tree", "merge_id"), "merge_id")
    return rows.rollup("tree").agg(F.count("symbol").alias("symbols"), F.count_if(F.col("model") != F.col("value")).alias("mismatches"))
