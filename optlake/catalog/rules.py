"""Rule and policy queries."""

from pyspark.sql import functions as F

from optlake.catalog import views  # noqa: F401
from optlake.catalog.registry import query, view
from optlake.operators import rules as r

view("v_proposals", """
SELECT config_id AS host, line_no AS position, symbol AS config, value AS current_value, 'n' AS proposed_value,
       CASE (config_id + line_no) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk,
       CAST((config_id * 7 + line_no * 13) % 101 AS DOUBLE) / 100 AS confidence,
       CASE config_id % 4 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'microarch' WHEN 2 THEN 'choice' ELSE 'advice' END AS source
FROM v_config_lines
""", keep=True)
SUBSYSTEMS = [("storage", ["^S1[0-9]$", "^S3$"]), ("net", ["^S1", "^S2[0-4]"]), ("sound", ["^S5($|_)"])]
BUCKET = """CASE WHEN regexp_matches(config, '^CONFIG_S(1[0-9]|3)$') THEN 'storage' WHEN regexp_matches(config, '^CONFIG_S(1|2[0-4])') THEN 'net'
  WHEN config = 'CONFIG_S5' THEN 'sound' ELSE 'misc' END"""


@query("p14_subsystems", f"SELECT host, {BUCKET} AS subsystem, count(*) AS n FROM v_proposals GROUP BY 1, 2")
def _(v):
    return v("proposals").groupBy("host", r.subsystem(F.col("config"), SUBSYSTEMS).alias("subsystem")).agg(F.count(F.lit(1)).alias("n"))


@query("p25_confidence_floor", """
SELECT 'conservative' AS aggression, count(*) AS kept FROM v_proposals WHERE confidence >= 0.85 UNION ALL SELECT 'balanced', count(*) FROM v_proposals WHERE confidence >= 0.65
UNION ALL SELECT 'aggressive', count(*) FROM v_proposals WHERE confidence >= 0.4
""")
def _(v):
    from functools import reduce
    parts = [r.above_floor(v("proposals"), a).agg(F.count(F.lit(1)).alias("kept")).select(F.lit(a).alias("aggression"), "kept") for a in r.CONFIDENCE_FLOOR]
    return reduce(lambda a, b: a.unionByName(b), parts)


RULES = [r.reject_subsystems(["sound"]), r.reject_patterns(["CONFIG_S3?", "*[!0-8]"]),
         r.Rule("bold", "accept", source=("choice", "advice"), min_confidence=0.6, max_confidence=0.9), *r.ACCEPT_LOW_RISK, r.Rule("later", "defer", risk=("high",))]
REVIEW = f"""
rev AS (SELECT *, {BUCKET} AS subsystem, CASE WHEN config = 'CONFIG_S5' THEN 1 WHEN config LIKE 'CONFIG_S3_' OR right(config, 1) NOT IN ('0', '1', '2', '3', '4', '5', '6', '7', '8') THEN 2
  WHEN source IN ('choice', 'advice') AND confidence BETWEEN 0.6 AND 0.9 THEN 3 WHEN risk = 'low' THEN 4 WHEN risk = 'high' THEN 5 ELSE 6 END AS k FROM v_proposals),
dec AS (SELECT *, CASE WHEN k <= 2 THEN 'reject' WHEN k <= 4 THEN 'accept' ELSE 'defer' END AS decision, CASE k WHEN 1 THEN 'reject-subsystems:sound' WHEN 2 THEN 'reject-pattern:CONFIG_S3?,*[!0-8]' WHEN 3 THEN 'bold'
  WHEN 4 THEN 'accept-low-risk' WHEN 5 THEN 'later' ELSE 'unmatched' END AS rule FROM rev)
"""


@query("j15_review_rules", f"WITH {REVIEW} SELECT host, position, config, subsystem, decision, rule FROM dec")
def _(v):
    return r.review(v("proposals"), RULES, SUBSYSTEMS).select("host", "position", "config", "subsystem", "decision", "rule")


@query("a16_review_counts", f"""
WITH {REVIEW} SELECT host, count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (decision = 'reject') AS rejected, count(*) FILTER (decision = 'defer') AS deferred,
  count(*) FILTER (decision = 'defer' AND subsystem = 'misc') AS visible FROM dec GROUP BY 1
""")
def _(v):
    return r.review_counts(r.review(v("proposals"), RULES, SUBSYSTEMS), "defer", "misc")


@query("a16_first_appearance", f"SELECT host, subsystem, f AS first, row_number() OVER (PARTITION BY host ORDER BY f) AS nth FROM (SELECT host, {BUCKET} AS subsystem, min(position) AS f FROM v_proposals GROUP BY 1, 2)")
def _(v):
    return r.first_appearance(v("proposals").withColumn("subsystem", r.subsystem(F.col("config"), SUBSYSTEMS)))


BEARING = """
bearing AS (SELECT config_id AS host, symbol, CASE WHEN bool_or(value = 'y') THEN 'root filesystem' ELSE 'active device' END AS reason FROM v_config_lines WHERE value IN ('y', 'm') GROUP BY 1, 2)
"""


def bearing_of(v):
    rows = v("config_lines").withColumnRenamed("config_id", "host")
    one = rows.where("value = 'y'").select("host", "symbol", F.lit("root filesystem").alias("reason"))
    two = rows.where("value = 'm'").select("host", "symbol", F.lit("active device").alias("reason"))
    return r.load_bearing([one, two])


@query("j13_load_bearing", f"WITH {BEARING} SELECT * FROM bearing")
def _(v):
    return bearing_of(v)


@query("j14_policy", f"""
WITH {BEARING}, p AS (SELECT p.*, b.reason FROM v_proposals p LEFT JOIN bearing b ON b.host = p.host AND b.symbol = p.config)
SELECT host, position, a AS autonomy, CASE WHEN reason IS NOT NULL THEN 'blocked' WHEN a = 'explain' THEN 'annotation'
  WHEN CASE a WHEN 'advise' THEN source IN ('deterministic', 'microarch') AND confidence >= 0.95 WHEN 'auto-safe' THEN risk = 'low' AND confidence >= 0.9 ELSE risk <> 'high' END THEN 'auto_applied' ELSE 'needs_review' END AS outcome
FROM p CROSS JOIN (SELECT unnest(['explain', 'advise', 'auto-safe', 'auto-bold']) AS a)
""")
def _(v):
    from functools import reduce
    bearing = bearing_of(v)
    parts = [r.apply_policy(v("proposals"), a, bearing).select("host", "position", F.lit(a).alias("autonomy"), "outcome") for a in ("explain", "advise", "auto-safe", "auto-bold")]
    return reduce(lambda a, b: a.unionByName(b), parts)


view("v_workload_recipes", "SELECT o_orderstatus AS workload, 'CONFIG_S' || CAST(o_orderkey % 40 AS STRING) AS symbol, CASE WHEN max(o_totalprice) > 440000 THEN 'y' ELSE 'm' END AS recommended FROM orders GROUP BY 1, 2")
view("v_threat_recipes", "SELECT o_orderpriority AS threat, 'CONFIG_S' || CAST(o_orderkey % 40 AS STRING) AS symbol, CASE WHEN min(o_totalprice) < 60000 THEN 'n' ELSE 'm' END AS recommended FROM orders GROUP BY 1, 2")
view("v_contexts", "SELECT c.config_id AS host, c.symbol, o.o_orderstatus AS workload, o.o_orderpriority AS threat FROM v_config_values c JOIN orders o ON o.o_orderkey = c.config_id")


@query("j16_recipes", """
SELECT c.host, c.symbol, w.recommended, 'workload' AS axis FROM v_contexts c JOIN v_workload_recipes w ON w.workload = c.workload AND w.symbol = c.symbol
UNION ALL SELECT c.host, c.symbol, t.recommended, 'threat' FROM v_contexts c JOIN v_threat_recipes t ON t.threat = c.threat AND t.symbol = c.symbol
""")
def _(v):
    return r.recipes_for(v("contexts"), v("workload_recipes"), v("threat_recipes"))


@query("p26_eligible_knobs", """
WITH allowed AS (SELECT symbol FROM v_workload_recipes WHERE workload = 'F' AND recommended = 'y' UNION SELECT 'CONFIG_S' || CAST(s_suppkey % 40 AS STRING) FROM supplier WHERE s_acctbal < 0)
SELECT symbol, kind, choice FROM v_surface WHERE kind <> 'choice' AND symbol IN (SELECT symbol FROM allowed)
UNION ALL SELECT symbol, kind, choice FROM v_surface WHERE kind = 'choice' AND choice IN (SELECT choice FROM v_surface WHERE kind = 'choice' AND symbol IN (SELECT symbol FROM allowed))
""")
def _(v):
    allow = v.sql("SELECT DISTINCT 'CONFIG_S' || CAST(s_suppkey % 40 AS STRING) AS symbol FROM supplier WHERE s_acctbal < 0")
    return r.eligible_knobs(v("surface").select("symbol", "kind", "choice"), allow, v("workload_recipes").where("workload = 'F' AND recommended = 'y'"))


@query("j24_capability_mapping", """
SELECT l.guard_id AS capability, count(DISTINCT l.symbol) AS symbols, bool_and(s.symbol IS NOT NULL) AS available FROM v_literals l LEFT JOIN v_surface s ON s.symbol = l.symbol GROUP BY 1
""")
def _(v):
    return r.capability_mapping(v("literals").withColumnRenamed("guard_id", "capability"), v("surface"))


@query("j38_knob_surface", "SELECT symbol, type, kind FROM v_surface")
def _(v):
    pick = lambda k: v("surface").where(F.col("kind") == k)
    return r.knob_surface(pick("choice"), pick("toggle"), pick("tunable"))


@query("p36_package_policy", """
SELECT s_name AS source, CASE WHEN s_acctbal > 5000 AND s_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 25.5 * count(*)) THEN 'keep' WHEN s_acctbal > 5000 THEN 'trim' ELSE 'rebuild' END AS action,
  s_acctbal > 5000 AND s_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 25.5 * count(*)) AS forced FROM supplier
""")
def _(v):
    decisions = v.sql("SELECT s_name AS source, CASE WHEN s_acctbal > 5000 THEN 'trim' ELSE 'rebuild' END AS action FROM supplier")
    bearing = v.sql("SELECT s_name AS source FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name HAVING sum(l_quantity) > 25.5 * count(*)")
    return r.keep_needed_sources(decisions, bearing)


@query("w10_first_evidence", """
SELECT host, config, arg_min(source || ':' || risk, position) AS evidence, min(position) AS position FROM v_proposals GROUP BY 1, 2
""")
def _(v):
    return r.first_evidence(v("proposals").withColumn("evidence", F.concat_ws(":", "source", "risk")), ["host", "config"], "evidence", "position")
