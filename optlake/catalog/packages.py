"""Package queries: parts stand for source packages, customers for hosts."""

import uuid

from pyspark.sql import functions as F

from optlake.catalog import views  # noqa: F401
from optlake.catalog.registry import query, view
from optlake.operators import packages as p
from optlake.session import cut_lineage, shared_folder
from optlake.sources import packages as src
from optlake.sources.configs import text_lines

NL, TAB = "chr(10)", "chr(9)"
view("v_names", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'gcc-' WHEN 2 THEN 'linux-hwe' WHEN 3 THEN 'linux-meta' WHEN 4 THEN 'perl' ELSE 'src' END || CAST(p_partkey AS STRING) AS source, p_size, p_type, p_name FROM part", keep=True)
# every row is a dependency: some on a package of the index, the others on a library outside it
view("v_wants", """
SELECT DISTINCT l_partkey, CASE WHEN l_quantity = 50 AND l_discount >= 0.05 THEN 'bin' ELSE 'lib' END || CAST(l_suppkey AS STRING) AS dep FROM lineitem
""", keep=True)
view("v_want_text", """
SELECT l_partkey, listagg(dep || ' (>= 1.0) [amd64]', ', ') WITHIN GROUP (ORDER BY dep) AS deps FROM v_wants GROUP BY l_partkey
""", """
SELECT l_partkey, string_agg(dep || ' (>= 1.0) [amd64]', ', ' ORDER BY dep) AS deps FROM v_wants GROUP BY l_partkey
""")
view("v_versions_ab", """
SELECT n.*, '1:' || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || '-1' AS first_version,
  CASE p_partkey % 4 WHEN 0 THEN '1:' || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || '~rc1-9' WHEN 1 THEN '1:' || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 7 + 10 AS STRING) || '-1' WHEN 2 THEN '2:0.1'
   ELSE '1:' || CAST(p_size AS STRING) || '.0' || CAST(p_partkey % 7 AS STRING) || '-01' END AS second_version FROM v_names n
""")
view("v_index_text", f"""
SELECT v.p_partkey AS position, 'Package: ' || source || {NL} || 'Binary: bin' || CAST(v.p_partkey AS STRING) || ', bin' || CAST(v.p_partkey AS STRING) || '-dev' || {NL} || 'Version: ' || first_version || {NL} || 'Build-Depends: debhelper-compat (= 13),' || {NL} || ' ' || coalesce(deps, 'make') || ' | gawk <!nocheck>'
  || {NL} || {NL} || 'Package: ' || source || {NL} || 'Version: ' || second_version || {NL} || 'Binary: bin' || CAST(v.p_partkey AS STRING) || {NL} || 'Build-Depends-Indep: ' || coalesce(deps, 'make') || {NL} || {NL} || 'Package: broken' AS text
FROM v_versions_ab v LEFT JOIN v_want_text w ON w.l_partkey = v.p_partkey
""")
DEPS = "(SELECT p_partkey, coalesce((SELECT string_agg(dep, ' ' ORDER BY dep) FROM v_wants w WHERE w.l_partkey = p_partkey), 'make') AS d FROM v_names)"


def stanzas(v):
    return src.source_stanzas(v("index_text")).withColumn("position", F.col("position") * 10 + F.col("stanza_no"))


def sources(v):
    return v.once("sources", lambda: cut_lineage(p.highest_version(stanzas(v)).select("source", "version", "binaries", "build_depends")))


@query("s29_package_index", f"""
SELECT v.source, first_version AS version, 2 AS binaries, array_to_string(list_sort(list_concat(string_split(d, ' '), ['debhelper-compat', 'gawk'])), ' ') AS build_depends FROM v_versions_ab v JOIN {DEPS} x ON x.p_partkey = v.p_partkey
UNION ALL SELECT v.source, second_version, 1, d FROM v_versions_ab v JOIN {DEPS} x ON x.p_partkey = v.p_partkey
""")
def _(v):
    return stanzas(v).select("source", "version", F.size("binaries").alias("binaries"), F.array_join("build_depends", " ").alias("build_depends"))


@query("w09_highest_version", "SELECT source, CASE WHEN p_partkey % 4 IN (1, 2) THEN second_version ELSE first_version END AS version FROM v_versions_ab")
def _(v):
    return p.highest_version(stanzas(v)).select("source", "version")


view("v_installed_rows", """
SELECT DISTINCT l.tree AS host, n.p_partkey, 'bin' || CAST(n.p_partkey AS STRING) || CASE WHEN n.p_size % 3 = 0 THEN '-dev' WHEN n.p_size % 3 = 1 THEN '' ELSE '-x' END AS bname, n.source, n.p_size FROM v_lines l JOIN v_names n ON n.p_partkey = l.l_partkey
""", keep=True)
view("v_installed_text", f"""
SELECT host, listagg(bname || {TAB} || CASE WHEN p_size = 9 THEN '' ELSE 'required' END || {TAB} || CASE WHEN p_size > 25 THEN '' ELSE source END || {TAB} || '1.0' || {TAB} || CASE WHEN p_size = 8 THEN 'big' ELSE CAST(p_size * 20 AS STRING) END || {TAB} || CASE WHEN p_size = 7 THEN 'config-files' ELSE 'installed' END, {NL}) WITHIN GROUP (ORDER BY p_partkey) AS text FROM v_installed_rows GROUP BY host
""", f"SELECT host, '' AS text FROM v_installed_rows")
INSTALLED = """
inst AS (SELECT host, bname, CASE WHEN p_size > 25 THEN bname ELSE source END AS source, CASE WHEN p_size = 9 THEN 'optional' ELSE 'required' END AS priority, CAST(CASE WHEN p_size = 8 THEN 0 ELSE p_size * 20 END AS BIGINT) AS installed_kb, p_partkey, p_size FROM v_installed_rows WHERE p_size <> 7),
best AS (SELECT p_partkey, source, p_partkey % 4 IN (1, 2) AS second FROM v_names),
bin AS (SELECT 'bin' || p_partkey AS bname, source FROM best UNION ALL SELECT 'bin' || p_partkey || '-dev', source FROM best WHERE NOT second),
mapped AS (SELECT i.host, i.bname, coalesce(b.source, i.source) AS source, i.installed_kb FROM inst i LEFT JOIN bin b ON b.bname = i.bname)
"""


def installed(v):
    return src.installed_packages(v("installed_text"))


@query("s30_installed_packages", f"WITH {INSTALLED} SELECT host, bname AS \"binary\", source, priority, installed_kb FROM inst")
def _(v):
    return installed(v).drop("source_version")


@query("j26_binary_sources", f"WITH {INSTALLED} SELECT host, bname AS \"binary\", source, source IN (SELECT source FROM v_names) AS known FROM mapped")
def _(v):
    return p.binary_sources(installed(v), sources(v)).select("host", "binary", "source", "known")


EDGES = f"""
{INSTALLED}, closure AS (SELECT DISTINCT source FROM mapped WHERE source IN (SELECT source FROM v_names)),
edges AS (SELECT DISTINCT a.source AS src, b.source AS dst FROM v_wants w JOIN v_names a ON a.p_partkey = w.l_partkey JOIN v_names b ON 'bin' || b.p_partkey = w.dep WHERE a.source <> b.source AND a.source IN (SELECT source FROM closure) AND b.source IN (SELECT source FROM closure))
"""


@query("j27_closure_edges", f"WITH {EDGES} SELECT * FROM edges")
def _(v):
    inside = p.binary_sources(installed(v), sources(v)).where("known")
    return p.closure_edges(sources(v), inside)


COST = """CASE WHEN source LIKE 'gcc-%' OR source LIKE 'linux-hwe%' THEN 'monster' WHEN source LIKE 'perl%' THEN 'heavy' WHEN kb > 0 AND kb < 300 THEN 'tiny' ELSE 'normal' END"""


@query("p33_cost_class", f"SELECT source, kb, {COST} AS cost FROM (SELECT source, CAST(p_size * 20 AS BIGINT) AS kb FROM v_names)")
def _(v):
    rows = v("names").select("source", (F.col("p_size") * 20).cast("long").alias("kb"))
    return rows.withColumn("cost", p.cost_class(F.col("source"), F.col("kb")))


@query("a11_package_evidence", f"""
WITH {INSTALLED}, d AS (SELECT source, bname, sum(installed_kb) AS kb FROM inst GROUP BY 1, 2)
SELECT source, count(*) AS binaries, CAST(sum(kb) AS BIGINT) AS installed_kb, array_to_string(list_sort(list(bname))[1:6], ' ') AS first_six FROM d GROUP BY 1
""")
def _(v):
    return p.package_evidence(installed(v)).withColumn("first_six", F.array_join("first_six", " "))


view("v_overrides", "SELECT n.source, l_linenumber AS position, l_returnflag = 'A' AS use_stock, 'because ' || l_linestatus AS reason, l_returnflag AS tier FROM (SELECT l_partkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_partkey, l_linenumber) l JOIN v_names n ON n.p_partkey = l.l_partkey")


@query("j29_override_lookup", """
WITH o AS (SELECT source, CASE WHEN tier = 'R' THEN 0 ELSE 1 END AS tier, position, use_stock, reason FROM v_overrides UNION ALL SELECT source, 2, 0, TRUE, 'toolchain gate' FROM v_names WHERE source LIKE 'gcc-%'),
f AS (SELECT source, arg_min(use_stock, (tier, position)) AS use_stock, arg_min(reason, (tier, position)) AS reason FROM o GROUP BY 1)
SELECT n.source, coalesce(f.use_stock, FALSE) AS use_stock, f.reason FROM v_names n LEFT JOIN f ON f.source = n.source
""")
def _(v):
    return overrides(v)


def overrides(v):
    return p.first_override(v("names").select("source"), v("overrides").where("tier = 'R'"), v("overrides").where("tier <> 'R'"))


view("v_units_to_build", "SELECT n.source, '1.' || CAST(p_size AS STRING) AS version, 'h' || CAST(p_partkey % 3 AS STRING) AS flags_hash, p_size = 10 AS use_stock FROM v_names n")
view("v_records", "SELECT n.source, '1.' || CAST(n.p_size AS STRING) AS version, 'h' || CAST(l_suppkey % 4 AS STRING) AS flags_hash, CASE WHEN l_returnflag = 'A' THEN 'ok' ELSE 'failed' END AS outcome, l_quantity * 60 AS duration_s, l_shipdate AS finished_at, l_orderkey * 10 + l_linenumber AS record_id FROM lineitem l JOIN v_names n ON n.p_partkey = l.l_partkey")


@query("j28_pending_builds", """
SELECT u.source, u.version, CASE WHEN use_stock THEN 'stock' WHEN EXISTS (SELECT 1 FROM v_records r WHERE r.source = u.source AND r.version = u.version AND r.flags_hash = u.flags_hash AND r.outcome = 'ok') THEN 'done' ELSE 'pending' END AS state FROM v_units_to_build u
""")
def _(v):
    return p.pending_builds(v("units_to_build"), v("records")).select("source", "version", "state")


view("v_drafts", """
SELECT n.source, row_number() OVER (PARTITION BY n.source ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS position, l_returnflag AS rf, l_linestatus AS ls, l_linenumber AS ln FROM lineitem l JOIN v_names n ON n.p_partkey = l.l_partkey
""")


@query("a12_override_merge", """
WITH t AS (SELECT source, ln, min(position) AS pos FROM v_drafts GROUP BY 1, 2),
a AS (SELECT source, string_agg('f' || ln, ' ' ORDER BY pos) AS strip_flags, string_agg('-g' || ln, ' ' ORDER BY pos) AS add_flags FROM t GROUP BY 1),
-- a reason is left out where all reasons so far are one and the same
why AS (SELECT source, string_agg('why ' || ln, ' + ' ORDER BY position) FILTER (NOT same OR position = 1) AS reason
  FROM (SELECT d.*, bool_and(ln = first) OVER (PARTITION BY source ORDER BY position) AS same FROM (SELECT v.*, first_value(ln) OVER (PARTITION BY source ORDER BY position) AS first FROM v_drafts v) d) GROUP BY 1)
SELECT d.source, a.strip_flags, a.add_flags, any_value(why.reason) AS reason, arg_max(CASE WHEN rf = 'R' THEN 'gcc' ELSE 'clang' END, position) FILTER (rf <> 'N') AS compiler, bool_or(ls = 'F' AND rf = 'A') AS use_stock FROM v_drafts d JOIN a ON a.source = d.source JOIN why ON why.source = d.source GROUP BY 1, 2, 3
""")
def _(v):
    rows = v("drafts").selectExpr("source", "position", "array(concat('f', ln)) AS strip_flags", "array(concat('-g', ln)) AS add_flags", "CASE rf WHEN 'R' THEN 'gcc' WHEN 'A' THEN 'clang' END AS compiler", "ls = 'F' AND rf = 'A' AS use_stock", "concat('why ', ln) AS reason")
    return p.merge_overrides(rows).select("source", F.array_join("strip_flags", " ").alias("strip_flags"), F.array_join("add_flags", " ").alias("add_flags"), "reason", "compiler", "use_stock")


view("v_flag_cases", """
SELECT o_orderkey AS unit, CASE o_orderstatus WHEN 'F' THEN 'conservative' WHEN 'P' THEN 'balanced' ELSE 'aggressive' END AS aggression, CASE WHEN o_orderpriority LIKE '1%' THEN 'permissive' ELSE 'paranoid' END AS threat,
  CASE WHEN o_totalprice > 200000 THEN 'clang' ELSE 'gcc' END AS compiler, CASE WHEN o_orderpriority LIKE '2%' THEN 'bfd' ELSE '' END AS linker, o_orderpriority LIKE '%3%' AS strips FROM orders
""")


def flag_rows(v):
    fl = p.axis_flags(F.col("aggression"), F.col("threat"))
    strip = F.when(F.col("strips"), F.array(F.lit("-flto=thin"), F.lit("-O3"), F.lit("nodoc"))).otherwise(F.array().cast("array<string>"))
    add = F.when(F.col("strips"), F.array(F.lit("-fno-x"))).otherwise(F.array().cast("array<string>"))
    rows = v("flag_cases").withColumn("f", fl).withColumn("strip", strip).withColumn("add", add)
    return rows.select("unit", p.effective_cflags(F.col("f"), F.col("compiler"), F.col("strip"), F.col("add")).alias("cflags"), p.effective_ldflags(F.col("f"), F.col("compiler"), F.col("linker"), F.col("strip")).alias("ldflags"),
                       p.effective_options(F.col("f"), F.array(F.lit("parallel=4")), F.col("strip")).alias("options"), p.effective_profiles(F.col("f"), F.col("add"), F.col("strip")).alias("profiles"))


FLAGS = """
fl AS (SELECT unit, concat_ws(' ', CASE WHEN aggression = 'conservative' THEN '-march=x86-64-v3' ELSE '-march=native' END, CASE WHEN aggression = 'aggressive' THEN CASE WHEN NOT strips THEN '-O3' END ELSE '-O2' END, CASE WHEN compiler = 'clang' THEN '-gdwarf-4' END,
    CASE WHEN aggression = 'aggressive' THEN CASE WHEN compiler = 'gcc' THEN '-flto=auto' WHEN NOT strips THEN '-flto=thin' END END, CASE WHEN threat <> 'permissive' THEN '-D_FORTIFY_SOURCE=3' END, CASE WHEN strips THEN '-fno-x' END) AS cflags,
  concat_ws(' ', CASE WHEN compiler = 'clang' AND aggression = 'aggressive' AND NOT strips THEN '-flto=thin' END, CASE WHEN linker <> '' THEN '-fuse-ld=' || linker WHEN compiler = 'clang' AND NOT strips THEN '-fuse-ld=lld' END) AS ldflags,
  concat_ws(' ', CASE WHEN aggression = 'aggressive' THEN 'nocheck' END, CASE WHEN aggression = 'aggressive' AND NOT strips THEN 'nodoc' END, 'parallel=4') AS options,
  concat_ws(' ', CASE WHEN strips THEN '-fno-x' END, CASE WHEN aggression = 'aggressive' THEN 'nocheck' END, CASE WHEN aggression = 'aggressive' AND NOT strips THEN 'nodoc' END) AS profiles FROM v_flag_cases)
"""


@query("p30_compile_flags", f"WITH {FLAGS} SELECT * FROM fl")
def _(v):
    return flag_rows(v).select("unit", *[F.array_join(c, " ").alias(c) for c in ("cflags", "ldflags", "options", "profiles")])


@query("p31_flags_digest", f"WITH {FLAGS} SELECT unit, substr(sha256(cflags || chr(10) || ldflags || chr(10) || options || chr(10) || profiles), 1, 16) AS flags_hash FROM fl")
def _(v):
    return flag_rows(v).select("unit", p.flags_hash(F.col("cflags"), F.col("ldflags"), F.col("options"), F.col("profiles")).alias("flags_hash"))


@query("p31_fact_digest", "SELECT config_id, symbol, substr(sha256('{\"symbol\":\"' || symbol || '\",\"value\":\"' || replace(value, '\"', chr(92) || '\"') || '\"}'), 1, 24) AS fact_hash FROM v_config_values")
def _(v):
    return v("config_values").select("config_id", "symbol", p.fact_hash(F.struct("symbol", "value")).alias("fact_hash"))


view("v_logs", f"""
SELECT o_orderkey AS unit, o_orderstatus AS st, o_orderpriority AS pr, 'Get:1 http://x' || {NL} || CASE o_orderstatus WHEN 'F' THEN 'gcc -O2 -c a.c' WHEN 'P' THEN '/usr/bin/gcc-13 -O2 -c a.c' ELSE 'clang -O2 -flto -c a.c ' END || {NL} || 'clang++ -g -c b.cc' || {NL} || CASE WHEN o_totalprice > 250000 THEN ' cc -O3 -c d.c' || {NL} || 'g++ -c e.cc' ELSE 'ld -o x' END || {NL} || 'Fetched 3' || {NL} || 'done' AS log,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'No compiler commands' ELSE 'CFLAGS missing (-O2): gcc' || {NL} || 'LDFLAGS missing: x' || {NL} || 'CFLAGS missing (-O2): cc' || {NL} || 'note' END AS report, o_totalprice > 250000 AS more FROM orders
""")


@query("p32_log_audit", """
SELECT unit, CASE WHEN pr LIKE '1%' THEN 'no-compiler' WHEN st = 'O' THEN 'ok' ELSE 'missing-flags' END AS verdict, CASE WHEN pr LIKE '1%' OR st = 'O' THEN '' ELSE '-flto' END AS missing, CASE WHEN pr LIKE '1%' THEN 0 ELSE 3 END AS findings,
  CASE WHEN pr LIKE '1%' THEN '' ELSE 'CFLAGS missing (-O2);LDFLAGS missing' END AS kinds, CASE st WHEN 'F' THEN 1 WHEN 'P' THEN 1 ELSE 0 END + CASE WHEN more THEN 2 ELSE 0 END <= CASE st WHEN 'O' THEN 2 ELSE 1 END AS majority_ok, st <> 'P' AS redirected_ok FROM v_logs
""")
def _(v):
    expected = F.array(F.lit("-O2"), F.lit("-flto"))
    rows = v("logs").withColumn("a", p.log_audit(F.col("log"), expected, F.col("report"), F.when(F.col("pr").startswith("1"), 1).otherwise(0)))
    want = F.lit("clang")
    return rows.select("unit", "a.verdict", F.array_join("a.missing", " ").alias("missing"), "a.findings", F.array_join("a.kinds", ";").alias("kinds"), p.compiler_majority(F.col("log"), want).alias("majority_ok"), p.compiler_majority(F.col("log"), want, True).alias("redirected_ok"))


@query("p24_log_tail", f"SELECT unit, 'done' AS line, CASE WHEN more THEN 7 ELSE 6 END AS line_no FROM v_logs UNION ALL SELECT unit, CASE WHEN more THEN 'g++ -c e.cc' ELSE 'ld -o x' END, CASE WHEN more THEN 5 ELSE 4 END FROM v_logs")
def _(v):
    return p.log_tail(text_lines(v("logs").selectExpr("unit", "log AS text")), ["unit"], 2)


view("v_serials", f"""
SELECT o_orderkey AS unit, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice > 250000 AS panics, CASE WHEN o_orderpriority LIKE '1%' THEN 'garbage' ELSE 'Linux version 6' END || {NL} || CASE o_orderstatus WHEN 'F' THEN 'VFS: Unable to mount root fs' WHEN 'P' THEN 'Cannot open root device' ELSE 'BOOT_TEST_OK' END
  || {NL} || CASE WHEN o_totalprice > 250000 THEN 'Kernel panic - not syncing' || {NL} || 'VFS: Unable to mount root fs' ELSE 'login' END AS text FROM orders
""")


@query("p23_boot_verdicts", """
SELECT unit, CASE WHEN pr LIKE '1%' THEN 'no kernel banner' WHEN NOT panics THEN 'no panic' WHEN st = 'F' THEN 'reached root mount' WHEN st = 'P' THEN 'reached root lookup' ELSE 'panic before root' END AS bare,
  CASE WHEN st = 'O' THEN 'sentinel reached' WHEN panics THEN 'kernel panic' ELSE 'no sentinel' END AS guest, CASE WHEN st = 'O' THEN 'sentinel reached' WHEN panics THEN 'Kernel panic - not syncing' WHEN st = 'P' THEN 'root filesystem mount failed' ELSE 'no sentinel before timeout' END AS image FROM v_serials
""")
def _(v):
    t = F.col("text")
    return v("serials").select("unit", p.serial_verdict(t, F.lit("kernel"), "BOOT_TEST_OK")["reason"].alias("bare"), p.serial_verdict(t, F.lit("guest"), "BOOT_TEST_OK")["reason"].alias("guest"), p.world_verdict(t, "BOOT_TEST_OK")["reason"].alias("image"))


view("v_remedies", """
SELECT o_orderkey AS unit, CASE o_orderpriority WHEN '1-URGENT' THEN 'strip-flags' WHEN '2-HIGH' THEN 'strip-build-options' WHEN '3-MEDIUM' THEN 'nocheck' WHEN '5-LOW' THEN 'pray' ELSE 'defer' END AS action, CASE WHEN o_totalprice > 400000 THEN ' ' ELSE 'why' END AS reason, o_orderstatus AS st FROM orders
""")


@query("p35_remedy_checks", """
SELECT unit, concat_ws('; ', CASE WHEN action = 'pray' THEN 'unknown action pray' END, CASE WHEN reason = ' ' THEN 'empty reason' END, CASE WHEN action = 'strip-flags' AND st = 'O' THEN 'nothing to strip' END, CASE WHEN action = 'strip-flags' AND st <> 'O' THEN 'not in effect -O9' END,
  CASE WHEN action = 'strip-flags' AND st <> 'O' THEN 'not a flag x' END, CASE WHEN action <> 'strip-flags' AND st <> 'O' THEN 'flags without strip-flags' END, CASE WHEN action = 'strip-build-options' AND st <> 'P' THEN 'no options to strip' END, CASE WHEN action = 'strip-build-options' AND st = 'P' THEN 'not a build option zip' END,
  CASE WHEN action <> 'strip-build-options' AND st = 'P' THEN 'options without strip-build-options' END, CASE WHEN action = 'nocheck' AND st = 'F' THEN 'tests caught this one' END) AS problems,
  CASE WHEN action IN ('pray', 'defer') THEN NULL ELSE CASE WHEN action = 'strip-flags' AND st <> 'O' THEN 2 ELSE 0 END END AS stripped, CASE WHEN action IN ('pray', 'defer') THEN NULL ELSE action = 'nocheck' END AS skips_tests FROM v_remedies
""")
def _(v):
    none = F.array().cast("array<string>")
    some = F.col("st") != "O"
    strip = F.when(some, F.array(F.lit("-O2"), F.lit("-O9"))).otherwise(none)
    add = F.when(some, F.array(F.lit("x"), F.lit("-g"))).otherwise(none)
    options = F.when(F.col("st") == "P", F.array(F.lit("nodoc"), F.lit("zip"))).otherwise(none)
    failure = F.when(F.col("st") == "F", "opt-miscompile").otherwise("other")
    problems = p.remedy_problems(F.col("action"), F.col("reason"), strip, add, options, failure, F.array(F.lit("-O2"), F.lit("-g")), F.array(F.lit("nodoc")))
    over = p.remedy_override(F.col("action"), strip, add, options)
    rows = v("remedies").withColumn("problems", problems).withColumn("o", over)
    return rows.select("unit", F.array_join("problems", "; ").alias("problems"), F.when(F.col("o").isNotNull(), F.size("o.strip_flags")).alias("stripped"), F.when(F.col("o").isNotNull(), F.size("o.build_options") > 0).alias("skips_tests"))


@query("p34_token_cost", """
SELECT event_id, round(user_id * 10 / 1e6 * CASE event_type WHEN 'click' THEN 5 WHEN 'error' THEN 1 ELSE 3 END + event_id % 500 / 1e6 * CASE event_type WHEN 'click' THEN 25 WHEN 'error' THEN 5 ELSE 15 END, 8) AS cost FROM events
""")
def _(v):
    rates = [("click", 5.0, 25.0), ("view", 3.0, 15.0), ("error", 1.0, 5.0)]
    return v.table("events").select("event_id", F.round(p.token_cost(F.concat(F.lit("model-"), "event_type"), F.col("user_id") * 10, F.col("event_id") % 500, rates, "view"), 8).alias("cost"))


view("v_ledger", "SELECT event_id, ts AS stamp, event_type AS agent, CAST(user_id * 10 AS BIGINT) AS input_tokens, event_id % 500 AS output_tokens, value AS cost_usd FROM events")


def ledger(v):
    """The ledger written as JSON lines with a broken line after every costly call."""
    def make():
        path = f"{shared_folder(v.spark)}/ledger-{uuid.uuid4().hex}"
        good = v("ledger").select(F.to_json(F.struct(F.col("stamp").alias("at"), "agent", "input_tokens", "output_tokens", "cost_usd")).alias("value"), "cost_usd")
        good.select("value").unionByName(good.where("cost_usd > 50").select(F.substring("value", 1, 20).alias("value"))).write.text(path)
        return path

    return src.read_json_lines(v.spark, v.once("ledger path", make), src.LEDGER_SCHEMA)


@query("s32_ledger_lines", "SELECT agent, input_tokens, output_tokens, cost_usd FROM v_ledger")
def _(v):
    return ledger(v).drop("at")


def round_trip(v, rows, schema):
    """Rows written as JSON lines, each file with a broken line in it, and read again."""
    path = f"{shared_folder(v.spark)}/lines-{uuid.uuid4().hex}"
    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    text.unionByName(text.limit(1).select(F.substring("value", 1, 9).alias("value"))).write.text(path)
    return src.read_json_lines(v.spark, path, schema)


@query("s32_build_records", "SELECT source, version, flags_hash, outcome, CAST(duration_s AS DOUBLE) AS duration_s, CAST(finished_at AS DATE) AS finished_on FROM v_records")
def _(v):
    rows = v("records").select("source", "version", "flags_hash", "outcome", F.col("duration_s").cast("double").alias("duration_s"), F.col("finished_at").cast("timestamp").alias("finished_at"))
    return round_trip(v, rows, src.RECORD_SCHEMA).select("source", "version", "flags_hash", "outcome", "duration_s", F.to_date("finished_at").alias("finished_on"))


@query("s32_iteration_records", """
SELECT o_custkey AS host, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS iteration, 2 AS proposals,
  CAST(o_totalprice AS DOUBLE) AS size_bytes, o_orderstatus = 'F' AS regressed FROM orders
""")
def _(v):
    rows = v.sql("""SELECT o_custkey AS host, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS iteration, array(o_orderstatus, o_clerk) AS proposals,
                    named_struct('size_bytes', CAST(o_totalprice AS DOUBLE)) AS measurements, o_orderstatus = 'F' AS regressed FROM orders""".replace("o_clerk", "o_orderpriority"))
    return round_trip(v, rows, src.ITERATION_SCHEMA).select("host", "iteration", F.size("proposals").alias("proposals"), "measurements.size_bytes", "regressed")


@query("s35_artifact_files", """
SELECT s_nationkey AS nation, CAST(octet_length(encode(string_agg(s_name, chr(10) ORDER BY s_suppkey))) + 1 AS BIGINT) AS bytes, sha256(string_agg(s_name, chr(10) ORDER BY s_suppkey) || chr(10)) AS sha256 FROM supplier GROUP BY 1
""")
def _(v):
    # one file for each nation, as a build leaves one artifact for each target
    path = f"{shared_folder(v.spark)}/artifacts-{uuid.uuid4().hex}"
    rows = v.table("supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_name").alias("value"))
    rows.repartition("nation").sortWithinPartitions("nation", "s_suppkey").select("nation", "value").write.partitionBy("nation").text(path)
    return src.read_artifacts(v.spark, path).select(F.regexp_extract("path", "/nation=([0-9]+)/", 1).cast("int").alias("nation"), "bytes", "sha256")


@query("a09_cost_ledger", """
SELECT agent, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 4) AS cost_usd,
  CASE WHEN grouping(agent) = 1 THEN (SELECT count(*) FROM v_records) END AS builds, CASE WHEN grouping(agent) = 1 THEN (SELECT round(sum(duration_s) / 3600, 3) FROM v_records) END AS cpu_hours FROM v_ledger GROUP BY GROUPING SETS ((agent), ())
""")
def _(v):
    return p.cost_ledger(ledger(v), v("records"))


@query("s31_inventory_lines", "SELECT config_id, symbol, value FROM v_config_values")
def _(v):
    path = f"{shared_folder(v.spark)}/inventory-{uuid.uuid4().hex}"
    src.append_json_lines(v("config_values").select("config_id", "symbol", "value"), path)
    return src.read_json_lines(v.spark, path, "config_id long, symbol string, value string, bad string")


@query("s36_alarm_rows", "SELECT o_orderstatus AS arch, o_orderpriority AS analysis_result, count(*) AS constructs FROM orders GROUP BY 1, 2")
def _(v):
    path = f"{shared_folder(v.spark)}/alarms-{uuid.uuid4().hex}"
    rows = v.sql("SELECT o_orderstatus AS arch, 'A, b' AS selectee, CAST(o_custkey AS STRING) AS selector, CAST(o_orderkey AS STRING) AS visib_id, 'k' AS constraint_type, o_orderpriority AS analysis_result, 'y' AS verified, NULL AS testcase FROM orders")
    rows.withColumn("testcase", F.col("testcase").cast("string")).write.csv(path, header=True)
    return src.read_alarms(v.spark, path).where("selectee = 'A, b'").groupBy("arch", "analysis_result").agg(F.count(F.lit(1)).alias("constructs"))


@query("s35_artifacts", "SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("s35_tree_digest", """
WITH a AS (SELECT source, 'docs/' || doc_id AS path, sha256(text) AS h FROM documents), b AS (SELECT source, substr(sha256(path), 1, 4) AS bucket, sha256(string_agg(path || ' ' || h, chr(10) ORDER BY path || ' ' || h)) AS part, count(*) AS n FROM a GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(bucket || ' ' || part, chr(10) ORDER BY bucket)) AS digest FROM b GROUP BY 1
""")
def _(v):
    rows = v.table("documents").select("source", F.concat(F.lit("docs/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return src.tree_digest(rows, "source")
