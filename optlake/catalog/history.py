"""Queries over build histories, boots and ledgers of iterations."""

from pyspark.sql import functions as F

from optlake.catalog import views  # noqa: F401
from optlake.catalog.registry import query, view
from optlake.operators import history as h

view("v_iterations", """
SELECT o_custkey AS host, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS iteration,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS size_bytes, o_orderstatus = 'F' AS regressed, o_orderstatus FROM orders
""")
view("v_iteration_proposals", "SELECT i.host, i.iteration, c.symbol FROM v_iterations i JOIN v_config_values c ON c.config_id = i.o_orderkey")


@query("w02_fitness_trend", """
SELECT host, iteration, size_bytes, round(CASE WHEN p > 0 THEN (size_bytes - p) / p * 100 END, 1) AS change_pct FROM (SELECT *, lag(size_bytes) OVER (PARTITION BY host ORDER BY iteration) AS p FROM v_iterations)
""")
def _(v):
    return h.fitness_trend(v("iterations"), "size_bytes")


@query("w03_convergence", """
WITH s AS (SELECT host, iteration, size_bytes, lag(size_bytes) OVER (PARTITION BY host ORDER BY iteration) AS p, row_number() OVER (PARTITION BY host ORDER BY iteration DESC) AS back FROM v_iterations)
SELECT host, count(*) >= 3 AND count(*) FILTER (back <= 2 AND p <> 0 AND abs(size_bytes - p) / p <= 0.5) = 2 AS converged FROM s GROUP BY 1
""")
def _(v):
    return h.converged(v("iterations"), "size_bytes", 2, 50.0)


@query("w04_do_not_repeat", "SELECT DISTINCT i.host, p.symbol FROM v_iterations i JOIN v_iteration_proposals p ON p.host = i.host AND p.iteration = i.iteration WHERE i.o_orderstatus = 'F' OR i.o_orderstatus = 'P'")
def _(v):
    regressed = h.is_regression(F.col("o_orderstatus") != "F", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus") == "O"))
    return h.do_not_repeat(v("iterations").withColumn("regressed", regressed), v("iteration_proposals"))


@query("w05_history_selection", """
SELECT host, iteration, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY iteration) AS f, row_number() OVER (PARTITION BY host ORDER BY iteration DESC) AS l FROM v_iterations) WHERE f = 1 OR l <= 3
""")
def _(v):
    return h.selected_history(v("iterations"), 3).select("host", "iteration", "size_bytes")


@query("w06_trajectory", """
WITH e AS (SELECT host, count(*) AS n, arg_min(size_bytes, iteration) AS a, arg_max(size_bytes, iteration) AS b FROM v_iterations WHERE size_bytes IS NOT NULL AND NOT regressed GROUP BY 1 HAVING count(*) >= 2)
SELECT host, n, CASE WHEN (b - a) / a * 100 > 1 THEN 'grown' WHEN (b - a) / a * 100 < -1 THEN 'shrinking' ELSE 'stable' END AS trajectory FROM e
""")
def _(v):
    return h.trajectory(v("iterations"), "size_bytes", "size")


view("v_build_logs", """
SELECT host, iteration, 'fetch notes' || chr(10) || 'step │ rc │ s │' || chr(10) || 'make-bindeb-pkg │  ' || CASE WHEN regressed THEN '1' ELSE '0' END || ' │   ' || CAST(CAST(floor(size_bytes / 1000) AS BIGINT) AS STRING) || '.5 │ done' AS log FROM v_iterations
""")


@query("a19_measurement_record", """
SELECT i.host, i.iteration, i.size_bytes, CASE WHEN NOT i.regressed THEN floor(i.size_bytes / 1000) + 0.5 END AS compile_s, i.o_orderstatus <> 'P' AS boot_passed, i.size_bytes / 1000000 AS boot_s,
  CASE WHEN i.o_orderstatus = 'P' THEN 'unknown' END AS boot_failure, p.proposed, p.landed
FROM v_iterations i LEFT JOIN (SELECT config_id, count(*) AS proposed, count(*) FILTER (value = 'n') AS landed FROM v_config_values GROUP BY 1) p ON p.config_id = i.o_orderkey
""")
def _(v):
    it = v("iterations")
    boots = it.selectExpr("host", "iteration", "o_orderstatus <> 'P' AS verdict_ok", "size_bytes / 1000000 AS duration_s", "'' AS verdict_reason")
    landed = it.join(v("config_values").withColumnRenamed("config_id", "o_orderkey"), "o_orderkey").groupBy("host", "iteration").agg(
        F.count(F.lit(1)).alias("proposed"), F.count_if(F.col("value") == "n").alias("landed"))
    return h.measurements(it.select("host", "iteration", "size_bytes"), v("build_logs"), boots, landed)


view("v_marks", """
SELECT o_custkey AS run, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS phase, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS stamp FROM orders
""")


@query("w07_phase_gaps", """
SELECT run, phase, stamp, stamp - p AS gap FROM (SELECT *, last_value(stamp IGNORE NULLS) OVER (PARTITION BY run ORDER BY phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v_marks)
""")
def _(v):
    return h.phase_gaps(v("marks"))


view("v_boot_logs", """
SELECT o_orderkey AS run, 'kernel text' || chr(10) || 'Startup finished in ' || CAST(o_orderkey % 900 AS STRING) || 'ms (kernel) + ' || CASE WHEN o_orderstatus = 'F' THEN '1min ' ELSE '' END || CAST(o_custkey % 50 AS STRING) || '.25s (userspace) = x'
  || chr(10) || 'UserspaceTimestampMonotonic=' || CAST(o_orderkey * 10 AS STRING) || chr(10) || 'FinishTimestampMonotonic=' || CAST(o_orderkey * 10 + 7 AS STRING) AS log, o_orderkey, o_custkey, o_orderstatus FROM orders
""")


@query("s34_boot_logs", """
SELECT run, CAST(round(o_orderkey % 900 * 0.001, 6) AS DOUBLE) AS kernel, CAST(CASE WHEN o_orderstatus = 'F' THEN 60 ELSE 0 END + o_custkey % 50 + 0.25 AS DOUBLE) AS userspace, o_orderkey * 10 AS started, o_orderkey * 10 + 7 AS finished FROM v_boot_logs
""")
def _(v):
    rows = v("boot_logs").withColumn("b", h.boot_seconds(F.col("log"))).withColumn("m", h.phase_marks(F.col("log")))
    return rows.select("run", F.round("b.kernel", 6).alias("kernel"), "b.userspace", F.col("m")["UserspaceTimestampMonotonic"].alias("started"), F.col("m")["FinishTimestampMonotonic"].alias("finished"))
