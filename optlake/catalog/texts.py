"""Queries over build files, sources, patches, owners and reports."""

import uuid

from pyspark.sql import functions as F

from optlake.catalog import views  # noqa: F401
from optlake.catalog.guards import TABLE, changed_of, store_of
from optlake.catalog.registry import query, view
from optlake.catalog.scores import agree, agreement_of, picks_of, PRED
from optlake.functions import paths as pt
from optlake.operators import guards as g
from optlake.operators import lint
from optlake.plans import reports
from optlake.session import cut_lineage, shared_folder
from optlake.sources import builds as b
from optlake.sources import store as st
from optlake.sources.configs import text_lines

NL, BS = "chr(10)", "chr(92)"


def text_view(name, keys, expr, source, order, sep=NL, by=None):
    """``by`` are columns of the same groups, by which the rows already lie."""
    view(name, f"SELECT {keys}, listagg({expr}, {sep}) WITHIN GROUP (ORDER BY {order}) AS text FROM {source} GROUP BY {by or keys}",
         f"SELECT {keys}, string_agg({expr}, {sep} ORDER BY {order}) AS text FROM {source} GROUP BY {keys}", keep=True)


PK, K = "CAST(l_partkey AS STRING)", "CAST(l_partkey % 40 AS STRING)"
view("v_make_rows", f"""
SELECT tree, l_orderkey AS ok, l_partkey AS pk, line_no, l_linenumber AS ln, 'drivers/o' || CAST(l_orderkey AS STRING) || '/Makefile' AS path,
  CASE l_linenumber WHEN 1 THEN 'obj-$(CONFIG_S' || {K} || ') += f' || {PK} || '.o sub' || {PK} || '/g-x.o CONFIG_S' || {K} WHEN 2 THEN 'targets += ' || {BS} || {NL} || ' off' || {PK} || '.s FORCE'
   WHEN 3 THEN 'hostprogs := tool' || {PK} WHEN 4 THEN 'fam-$(CONFIG_S' || {K} || ') += a' || {PK} || '.o $(obj)/b' || {PK} || '.o $(X)/c.o' WHEN 5 THEN 'LIST_A := x' || {PK} || '.o y.o' WHEN 6 THEN 'obj-y += $(LIST_A) $(NOPE)'
   ELSE 'ccflags-y += -DCONFIG_H' || {K} || '=1 -DCONFIG_S' || {K} || ' -D$(CONFIG_Q) $(wildcard $(srctree)/$(src)/w' || {PK} || '/*.c)' END AS entry
FROM v_lines
""")
text_view("v_make_text", "tree, path", "entry", "v_make_rows", "line_no", by="tree, path, ok")
PHYS = "(line_no + CASE WHEN ln > 2 THEN (SELECT count(*) FROM v_make_rows z WHERE z.ok = m.ok AND z.ln = 2) ELSE 0 END)"
NAMED = f"""
named AS (SELECT tree, path, {PHYS} AS line_no, 'CONFIG_S' || pk % 40 AS symbol, ln, pk, ok FROM v_make_rows m WHERE ln IN (1, 4)
  UNION ALL SELECT tree, path, {PHYS}, 'CONFIG_Q', ln, pk, ok FROM v_make_rows m WHERE ln = 7)
"""


def bindings(v):
    return v.once("bindings", lambda: cut_lineage(b.symbol_lines(v("make_text"))))


@query("s05_build_bindings", f"""
WITH {NAMED} SELECT tree, path, line_no, symbol, CASE ln WHEN 1 THEN 'f' || pk || '.o sub' || pk || '/g-x.o' WHEN 4 THEN 'a' || pk || '.o /b' || pk || '.o /c.o' ELSE '' END AS objects FROM named
""")
def _(v):
    return bindings(v).select("tree", "path", "line_no", "symbol", F.array_join("objects", " ").alias("objects"))


view("v_doc_sources", "SELECT 'drivers/' || source || '/d' || CAST(doc_id AS STRING) || '.c' AS path, regexp_replace(text, '([A-Z])[a-z]+', 'CONFIG_$1') AS text FROM documents",
     r"SELECT 'drivers/' || source || '/d' || CAST(doc_id AS STRING) || '.c' AS path, regexp_replace(text, '([A-Z])[a-z]+', 'CONFIG_\1', 'g') AS text FROM documents")
DOC_LINES = r"doc_lines AS (SELECT path, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS line_no FROM v_doc_sources)"
USES = DOC_LINES + r", uses AS (SELECT DISTINCT path, line_no, unnest(regexp_extract_all(line, '\bCONFIG_[A-Z0-9_]+\b')) AS symbol FROM doc_lines)"


def usages(v):
    return v.once("usages", lambda: cut_lineage(b.symbol_lines(v("doc_sources")).select("path", "line_no", "symbol")))


@query("s06_source_usages", f"WITH {USES} SELECT * FROM uses")
def _(v):
    return usages(v)


view("v_decl", """
SELECT DISTINCT CASE WHEN p_partkey % 60 < 10 THEN 'arch/arm/' || lower(p_type) || '/Kconfig' WHEN p_partkey % 60 < 12 THEN 'arch/x86/Kconfig' WHEN p_partkey % 60 < 14 THEN 'arch/Kconfig.x' ELSE 'drivers/' || lower(p_type) || '/Kconfig' END AS path,
  p_partkey % 60 AS k FROM part WHERE p_partkey % 60 NOT BETWEEN 20 AND 22
""")
text_view("v_decl_text", "path", f"CASE WHEN k > 30 THEN 'menuconfig S' ELSE ' config S' END || CAST(k AS STRING) || {NL} || '  bool \"config X\"'", "v_decl", "k")


def declared(v):
    return v.once("declared", lambda: cut_lineage(b.declared_symbols(v("decl_text"))))


@query("s04_declarations", "SELECT DISTINCT CASE WHEN k < 10 THEN 'arm' WHEN k < 12 THEN 'x86' END AS arch, 'CONFIG_S' || k AS symbol FROM v_decl")
def _(v):
    return declared(v)


view("v_source_rows", f"""
SELECT tree, l_orderkey AS ok, l_partkey AS pk, l_linenumber AS ln, 'drivers/o' || CAST(l_orderkey AS STRING) || '/s' || CAST(line_no AS STRING) || '.c' AS path,
  CASE WHEN l_linenumber <= 2 THEN '# include "dir/inc' || {PK} || '.c"' || {NL} || '#include <other.c>' ELSE 'MODULE_DEVICE_TABLE(pci, t);' || {NL} || 'MODULE_FIRMWARE("fw' || {K} || '.bin");' END AS text FROM v_lines
""")


@query("s07_included_sources", "SELECT DISTINCT tree, 'inc' || pk || '.c' AS name FROM v_source_rows WHERE ln <= 2")
def _(v):
    return b.included_sources(v("source_rows").select("tree", "path", "text"))


STEMS = """
stems AS (SELECT tree, 'drivers/o' || ok || '/' || s AS stem FROM (
  SELECT tree, ok, 'f' || pk AS s FROM v_make_rows WHERE ln = 1 UNION SELECT tree, ok, 'sub' || pk || '/g-x' FROM v_make_rows WHERE ln = 1 UNION SELECT tree, ok, 'off' || pk FROM v_make_rows WHERE ln = 2 UNION SELECT tree, ok, 'tool' || pk FROM v_make_rows WHERE ln = 3
  UNION SELECT tree, ok, 'a' || pk FROM v_make_rows WHERE ln = 4 UNION SELECT tree, ok, 'b' || pk FROM v_make_rows WHERE ln = 4
  UNION SELECT tree, ok, unnest(['x' || arg_max(pk, line_no), 'y']) FROM v_make_rows m WHERE ln = 5 AND EXISTS (SELECT 1 FROM v_make_rows z WHERE z.ok = m.ok AND z.ln = 6) GROUP BY tree, ok))
"""


@query("s08_indirect_sources", f"WITH {STEMS} SELECT * FROM stems")
def _(v):
    return b.indirect_sources(v("make_text"))


@query("s08_wildcard_directories", "SELECT DISTINCT tree, 'drivers/o' || ok || '/w' || pk AS dir FROM v_make_rows WHERE ln = 7")
def _(v):
    return b.wildcard_directories(v("make_text"))


SCOPE = "scope AS (SELECT 'CONFIG_S' || k AS symbol, bool_or(k >= 10) AS here FROM v_decl GROUP BY 1)"
HARD = f"""
hard AS (SELECT d.*, CASE WHEN s.here = FALSE THEN 'info' ELSE 'error' END AS severity FROM (SELECT DISTINCT tree, path, {PHYS} AS line_no, u AS symbol FROM v_make_rows m, unnest(['CONFIG_H' || pk % 40, 'CONFIG_S' || pk % 40]) t(u) WHERE ln = 7) d LEFT JOIN scope s ON s.symbol = d.symbol WHERE s.here IS NULL OR NOT s.here)
"""


def hard_coded(v):
    return lint.hard_coded(b.hard_coded_defines(v("make_text")), declared(v), "x86")


@query("s09_hard_coded_defines", f"WITH {SCOPE}, {HARD} SELECT * FROM hard")
def _(v):
    return hard_coded(v)


def references(v):
    return bindings(v).select("symbol", F.explode("objects").alias("object"))


ZOMBIE = f"""
{NAMED}, ref AS (SELECT symbol, unnest(CASE ln WHEN 1 THEN ['f' || pk || '.o', 'sub' || pk || '/g-x.o'] WHEN 4 THEN ['a' || pk || '.o', '/b' || pk || '.o', '/c.o'] ELSE [] END) AS object FROM named), {SCOPE},
zom AS (SELECT r.symbol, count(*) AS uses, CASE WHEN bool_or(s.here = FALSE) THEN 'info' ELSE 'error' END AS severity, array_to_string(list_sort(list(DISTINCT object))[1:3], ' ') AS examples FROM ref r LEFT JOIN scope s ON s.symbol = r.symbol WHERE s.here IS NULL OR NOT s.here GROUP BY 1)
"""


@query("j01_zombie_symbols", f"WITH {ZOMBIE} SELECT * FROM zom")
def _(v):
    return lint.zombie_symbols(references(v), declared(v), "x86")


@query("j02_option_use", f"WITH {NAMED} SELECT DISTINCT 'CONFIG_S' || k AS symbol, 'CONFIG_S' || k IN (SELECT symbol FROM named) AS used FROM v_decl")
def _(v):
    # only the names are asked for, so the lines they stand on are neither made nor written
    return lint.option_use(declared(v), b.symbol_lines(v("make_text")).select("symbol"))


view("v_source_paths", """
SELECT DISTINCT tree, path FROM (SELECT tree, explode(array('drivers/o' || CAST(l_orderkey AS STRING) || '/f' || CAST(l_partkey AS STRING) || '.c', 'drivers/o' || CAST(l_orderkey AS STRING) || '/w' || CAST(l_partkey AS STRING) || '/q.S',
    'drivers/o' || CAST(l_orderkey AS STRING) || '/inc' || CAST(l_partkey AS STRING) || '.c', 'tools/t' || CAST(l_partkey AS STRING) || '.c', 'arch/arm/t' || CAST(l_partkey AS STRING) || '.c',
    'drivers/o' || CAST(l_orderkey AS STRING) || '/z.mod.c')) AS path
  FROM (SELECT /*+ REPARTITION(tree) */ tree, l_orderkey, l_partkey FROM v_lines))
""", """
SELECT DISTINCT tree, p AS path FROM (SELECT tree, 'drivers/o' || CAST(l_orderkey AS STRING) || '/f' || CAST(l_partkey AS STRING) || '.c' AS p FROM v_lines UNION ALL SELECT tree, 'drivers/o' || CAST(l_orderkey AS STRING) || '/w' || CAST(l_partkey AS STRING) || '/q.S' FROM v_lines
  UNION ALL SELECT tree, 'drivers/o' || CAST(l_orderkey AS STRING) || '/inc' || CAST(l_partkey AS STRING) || '.c' FROM v_lines UNION ALL SELECT tree, 'tools/t' || CAST(l_partkey AS STRING) || '.c' FROM v_lines UNION ALL SELECT tree, 'arch/arm/t' || CAST(l_partkey AS STRING) || '.c' FROM v_lines
  UNION ALL SELECT tree, 'drivers/o' || CAST(l_orderkey AS STRING) || '/z.mod.c' FROM v_lines) t
""")
ORPHAN = """
orph AS (SELECT DISTINCT tree, 'drivers/o' || l_orderkey || '/f' || l_partkey || '.c' AS path FROM v_lines l WHERE NOT EXISTS (SELECT 1 FROM v_make_rows m WHERE m.ok = l.l_orderkey AND m.pk = l.l_partkey AND m.ln IN (1, 2))
 UNION ALL SELECT DISTINCT tree, 'drivers/o' || l_orderkey || '/w' || l_partkey || '/q.S' FROM v_lines l WHERE NOT EXISTS (SELECT 1 FROM v_make_rows m WHERE m.ok = l.l_orderkey AND m.pk = l.l_partkey AND m.ln = 7)
 UNION ALL SELECT DISTINCT tree, 'drivers/o' || l_orderkey || '/inc' || l_partkey || '.c' FROM v_lines l WHERE NOT EXISTS (SELECT 1 FROM v_make_rows m WHERE m.tree = l.tree AND m.pk = l.l_partkey AND m.ln IN (1, 2)))
"""


def orphans(v):
    known = v("make_rows").where("ln = 2").selectExpr("tree", "'drivers/o' || ok || '/f' || pk || '.o' AS path")
    included = b.included_sources(v("source_rows").select("tree", "path", "text"))
    return lint.orphan_sources(v("source_paths"), known, included, b.wildcard_directories(v("make_text")), b.indirect_sources(v("make_text")), "x86")


@query("j03_orphan_sources", f"WITH {ORPHAN} SELECT * FROM orph")
def _(v):
    return orphans(v)


# patches: one per order
view("v_patch_rows", """
SELECT l.tree, l.l_orderkey AS patch, l.line_no, l.l_linenumber AS ln, l.l_partkey AS pk, CASE l.l_linenumber WHEN 2 THEN 'include/h' || CAST(l.l_partkey AS STRING) || '.h' WHEN 3 THEN 'drivers/o' || CAST(l.l_orderkey AS STRING) || '/Makefile' WHEN 4 THEN 'gone' || CAST(l.l_partkey AS STRING) || '.c'
  WHEN 5 THEN 'Documentation/t' || CAST(l.l_partkey AS STRING) || '.txt' WHEN 7 THEN 'drivers/o' || CAST(l.l_orderkey AS STRING) || '/f' || CAST(l.l_partkey AS STRING) || '.c' ELSE replace(o.path, '.o', '.c') END AS path
FROM v_lines l JOIN v_objects o ON o.tree = l.tree AND o.part = l.l_partkey
""")
text_view("v_patch_text", "tree, patch", f"'diff --git a/' || path || ' b/' || path || {NL} || CASE WHEN ln = 4 THEN '+++ /dev/null' ELSE '+++ b/' || path || chr(9) || 'x' END", "v_patch_rows", "line_no")


@query("s10_patched_paths", "SELECT tree, patch, path, min(line_no) * 2 AS position FROM v_patch_rows WHERE ln <> 4 GROUP BY 1, 2, 3")
def _(v):
    return b.patched_paths(v("patch_text"))


@query("s10_touched_files", "SELECT tree, patch, path, ln = 3 AS is_build_file FROM v_patch_rows")
def _(v):
    return b.touched_files(v("patch_text"))


@query("j32_patch_coverage", """
SELECT p.tree, p.patch, p.path, p.class, d.built FROM (SELECT DISTINCT tree, patch, path, CASE WHEN ln = 2 THEN 'header' WHEN ln IN (3, 5) THEN 'skipped' WHEN ln = 7 THEN 'unknown' ELSE 'mapped' END AS class, CASE WHEN ln IN (1, 6) THEN pk END AS pk FROM v_patch_rows WHERE ln <> 4) p
LEFT JOIN v_verdicts d ON d.config_id = p.patch AND d.gnum = p.pk % 97
""")
def _(v):
    store = store_of(v)
    rows = lint.patch_coverage(b.patched_paths(v("patch_text")), v("objects"))
    guarded = rows.join(v("objects").select("tree", "path", "guard_id"), ["tree", "path"], "left").withColumn("config_id", F.col("patch"))
    return g.verdicts_for(guarded, changed_of(v, store), store).select("tree", "patch", F.col("name").alias("path"), "class", "built")


# owners: one file per nation, one entry per supplier
view("v_owner_fields", """
SELECT s_nationkey AS file, s_suppkey AS sid, 1 AS pos, 'M' AS field, 'Some Body <a@b.c>' AS raw FROM supplier
UNION ALL SELECT s_nationkey, s_suppkey, 2, 'F', CASE s_suppkey % 5 WHEN 0 THEN 'drivers/economy/' WHEN 1 THEN 'net/' WHEN 2 THEN 'arch/arm' WHEN 3 THEN 'drivers/*/brand1?/' ELSE 'drivers/promo/brand' || CAST(s_suppkey % 25 AS STRING) || '/u1/f*.c' END FROM supplier
UNION ALL SELECT s_nationkey, s_suppkey, 3, 'F', '*/standard/brand' || CAST(s_suppkey % 25 AS STRING) || '/' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_nationkey, s_suppkey, 4, 'X', 'drivers/economy/brand' || CAST(s_suppkey % 25 AS STRING) || '/' FROM supplier
UNION ALL SELECT s_nationkey, s_suppkey, 5, 'N', 'u[2-3]/f' || CAST(s_suppkey % 10 AS STRING) || '[.]' FROM supplier WHERE s_suppkey % 4 = 0
""")
view("v_owner_blocks", f"SELECT file, sid, 'OWNER ' || CAST(sid AS STRING) || {NL} || listagg(field || ':' || chr(9) || raw, {NL}) WITHIN GROUP (ORDER BY pos) AS block FROM v_owner_fields GROUP BY file, sid",
     f"SELECT file, sid, 'OWNER ' || CAST(sid AS STRING) || {NL} || string_agg(field || ':' || chr(9) || raw, {NL} ORDER BY pos) AS block FROM v_owner_fields GROUP BY file, sid")
text_view("v_owner_text", "file", "block", "v_owner_blocks", "sid", f"{NL} || {NL}")
OWNED = r"""
flds AS (SELECT sid, field, raw, CASE WHEN raw = 'arch/arm' THEN raw || '/' ELSE raw END AS pat FROM v_owner_fields),
pths AS (SELECT DISTINCT replace(path, '.o', '.c') AS path FROM v_objects),
mtch AS (SELECT p.path, f.sid, f.field, CASE WHEN field = 'N' THEN 0 ELSE length(pat) - length(replace(pat, '/', '')) END AS depth FROM pths p JOIN flds f ON f.field IN ('F', 'X', 'N')
  AND CASE WHEN field = 'N' THEN regexp_matches(p.path, f.raw) ELSE regexp_matches(p.path, '^' || replace(replace(replace(pat, '.', '\.'), '*', '.*'), '?', '.')) AND (pat LIKE '%/' OR length(p.path) - length(replace(p.path, '/', '')) = length(pat) - length(replace(pat, '/', ''))) END),
clm AS (SELECT path, sid, coalesce(max(depth) FILTER (field = 'F'), 0) AS depth FROM mtch GROUP BY 1, 2 HAVING NOT bool_or(field = 'X')),
own AS (SELECT path, 'OWNER ' || sid AS title, depth FROM clm c WHERE depth = (SELECT max(depth) FROM clm x WHERE x.path = c.path))
"""


def owner_rows(v):
    def make():
        folders = v("objects").where("path LIKE 'arch/arm/%'").select(F.lit("arch/arm").alias("dir"))
        return cut_lineage(b.owner_fields(v("owner_text"), folders).withColumn("entry_id", F.concat_ws(":", "file", "entry_id")))

    return v.once("owner rows", make)


@query("s11_owner_entries", "SELECT file, 'OWNER ' || sid AS title, field, raw FROM v_owner_fields")
def _(v):
    return owner_rows(v).select("file", "title", "field", "raw")


@query("j04_owner_attribution", f"WITH {OWNED} SELECT * FROM own")
def _(v):
    paths = v("objects").select(F.regexp_replace("path", r"\.o$", ".c").alias("path"))
    return lint.owners(paths, owner_rows(v), "title")


EVER = "ever AS (SELECT tree, guard_id, bool_or(built) AS ever FROM v_verdicts GROUP BY 1, 2)"


@query("j05_blind_spots", f"""
WITH {OWNED}, {EVER} SELECT w.title, count(*) FILTER (NOT e.ever) AS blind, count(*) AS objects, round(100.0 * count(*) FILTER (NOT e.ever) / count(*), 1) AS percent
FROM v_objects o JOIN ever e ON e.tree = o.tree AND e.guard_id = o.guard_id LEFT JOIN own w ON w.path = replace(o.path, '.o', '.c') GROUP BY 1
""")
def _(v):
    store = store_of(v)
    ever = g.built_anywhere(v("configs"), changed_of(v, store), store)
    no_sources = v("objects").where("path LIKE '%.c'").select("tree", "path")
    return lint.blind_spots(v("objects").select("tree", "path", "guard_id"), ever, no_sources, owner_rows(v))


@query("j06_blind_reasons", f"""
WITH {EVER}, off AS (SELECT e.tree, f.base_id AS config_id, e.guard_id, g.gnum FROM ever e JOIN v_guards g ON g.tree = e.tree AND g.guard_id = e.guard_id JOIN v_first_config f ON f.tree = e.tree WHERE NOT e.ever),
cur AS (SELECT o.*, l.j, l.symbol, l.want, l.negated, CASE WHEN c.value IN ('y', 'm') THEN c.value ELSE 'n' END AS value FROM off o JOIN v_literals l ON l.tree = o.tree AND l.guard_id = o.guard_id LEFT JOIN v_config_values c ON c.config_id = o.config_id AND c.symbol = l.symbol),
trial AS (SELECT s.*, t.rank, t.val FROM (SELECT DISTINCT tree, guard_id, gnum, symbol AS tried, value AS was FROM cur) s JOIN (SELECT 0 AS rank, 'y' AS val UNION ALL SELECT 1, 'm' UNION ALL SELECT 2, 'n') t ON t.val <> s.was),
res AS (SELECT t.*, bool_or(CASE WHEN c.j = 0 THEN ((CASE WHEN c.symbol = t.tried THEN t.val ELSE c.value END) = c.want) <> c.negated END) AS t0, bool_or(CASE WHEN c.j = 1 THEN ((CASE WHEN c.symbol = t.tried THEN t.val ELSE c.value END) = c.want) <> c.negated END) AS t1,
  bool_or(CASE WHEN c.j = 2 THEN ((CASE WHEN c.symbol = t.tried THEN t.val ELSE c.value END) = c.want) <> c.negated END) AS t2 FROM trial t JOIN cur c ON c.tree = t.tree AND c.guard_id = t.guard_id GROUP BY ALL),
blk AS (SELECT tree, guard_id, arg_min((tried, was, val), (tried, rank)) AS b FROM res WHERE CASE WHEN gnum % 3 = 0 THEN t0 AND t1 AND t2 WHEN gnum % 3 = 1 THEN t0 OR t1 OR t2 ELSE (t0 OR t1) AND t2 END GROUP BY 1, 2),
onall AS (SELECT c.tree, c.symbol FROM v_config_values c WHERE value IN ('y', 'm') GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM v_configs x WHERE x.tree = c.tree)),
{TABLE.strip()}, dead AS (SELECT gnum FROM truth GROUP BY 1 HAVING NOT bool_or(ok))
SELECT o.tree, o.path, CASE WHEN o.path LIKE 'arch/%' THEN 'other architecture' WHEN EXISTS (SELECT 1 FROM v_literals l WHERE l.tree = o.tree AND l.guard_id = o.guard_id AND l.symbol = 'CONFIG_S7') THEN 'other architecture''s option' WHEN o.gnum IN (SELECT gnum FROM dead) THEN 'never satisfiable' WHEN b.b IS NULL THEN 'other'
  WHEN b.b[2] IN ('y', 'm') AND b.b[3] = 'n' THEN CASE WHEN EXISTS (SELECT 1 FROM onall a WHERE a.tree = o.tree AND a.symbol = b.b[1]) THEN 'excludes an option every configuration enables' ELSE 'excludes an option' END WHEN b.b[2] = 'n' THEN 'not enabled' ELSE 'other' END AS reason
FROM v_objects o JOIN ever e ON e.tree = o.tree AND e.guard_id = o.guard_id AND NOT e.ever LEFT JOIN blk b ON b.tree = o.tree AND b.guard_id = o.guard_id
""")
def _(v):
    from optlake.plans.explain import blind_reasons
    store = store_of(v)
    ever = g.built_anywhere(v("configs"), changed_of(v, store), store)
    return blind_reasons(v("objects"), ever, v("configs"), v("first_config"), v("config_values"), v("guard_nodes"), v("guard_edges"), ["CONFIG_S7"]).select("tree", "path", "reason")


view("v_choices", "SELECT DISTINCT 'choice ' || CAST(p_partkey % 40 % 6 AS STRING) AS choice, 'CONFIG_S' || CAST(p_partkey % 40 AS STRING) AS member, 40 - p_partkey % 40 AS position FROM part WHERE p_partkey % 40 % 6 < 4")


@query("j33_option_explanation", """
WITH ex AS (SELECT v.config_id, v.symbol, coalesce(string_agg(DISTINCT s.dep, ' ' ORDER BY s.dep) FILTER (coalesce(d.value, 'n') NOT IN ('y', 'm')), '') AS unmet,
  string_agg(DISTINCT s.src || '=' || CASE WHEN c.value IN ('y', 'm') THEN c.value ELSE 'n' END, ' ' ORDER BY s.src || '=' || CASE WHEN c.value IN ('y', 'm') THEN c.value ELSE 'n' END) AS selected_by
FROM v_config_values v JOIN v_selects s ON s.dst = v.symbol LEFT JOIN v_config_values d ON d.config_id = v.config_id AND d.symbol = s.dep LEFT JOIN v_config_values c ON c.config_id = v.config_id AND c.symbol = s.src GROUP BY 1, 2)
SELECT ex.*, m.choice, CASE WHEN m.choice IS NOT NULL THEN coalesce((SELECT arg_min(x.member, x.position) FROM v_choices x JOIN v_config_values w ON w.symbol = x.member WHERE x.choice = m.choice AND w.config_id = ex.config_id AND w.value = 'y'),
  (SELECT arg_min(x.member, x.position) FROM v_choices x WHERE x.choice = m.choice)) END AS selected_member
FROM ex LEFT JOIN v_choices m ON m.member = ex.symbol
""")
def _(v):
    return lint.explain_options(v("config_values"), v("selects"), v("choices"))


@query("j37_symbol_locations", f"WITH {USES} SELECT symbol, path, line_no FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, line_no) AS rn FROM uses) WHERE rn <= 3")
def _(v):
    return lint.locations(usages(v))


TAGS = USES + r""", cnt AS (SELECT symbol, path, count(*) AS n FROM (SELECT symbol, path FROM uses UNION ALL SELECT symbol, replace(path, 'drivers/o', 'net/root-o') FROM named) GROUP BY 1, 2),
wrd AS (SELECT DISTINCT symbol, unnest(CASE WHEN path LIKE 'net/%' THEN ['net'] ELSE ['drivers', 'drivers/' || split_part(path, '/', 2)] END) AS t FROM cnt), rsk AS (SELECT DISTINCT symbol, unnest(['boot_path', 'network']) AS t FROM cnt WHERE path LIKE 'net/%'),
top AS (SELECT symbol, string_agg(path, ' ' ORDER BY n DESC, path) AS top_paths FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, path) AS rn FROM cnt) WHERE rn <= 10 GROUP BY 1),
tag AS (SELECT c.symbol, (SELECT string_agg(t, ' ' ORDER BY t) FROM wrd w WHERE w.symbol = c.symbol) AS subsystems, coalesce((SELECT string_agg(t, ' ' ORDER BY t) FROM rsk r WHERE r.symbol = c.symbol), '') AS risks, t.top_paths FROM (SELECT DISTINCT symbol FROM cnt) c JOIN top t ON t.symbol = c.symbol)"""


def tags_of(v):
    mentions = usages(v).select("symbol", "path").unionByName(bindings(v).select("symbol", F.regexp_replace("path", "^drivers/o", "net/root-o").alias("path")))
    return lint.path_tags(mentions)


@query("a21_symbol_tags", f"WITH {NAMED}, {TAGS} SELECT * FROM tag")
def _(v):
    return tags_of(v)


@query("a21_device_tables", "SELECT path, CASE WHEN ln <= 2 THEN '' ELSE 'pci' END AS buses, CASE WHEN ln <= 2 THEN '' ELSE 'fw' || pk % 40 || '.bin' END AS firmware FROM v_source_rows")
def _(v):
    return lint.device_tables(v("source_rows"))


RECORDS = f"""
{NAMED}, {TAGS}, rev AS (SELECT dst AS symbol, string_agg(DISTINCT src, ' ' ORDER BY src) AS selected_by FROM v_selects GROUP BY 1),
mods AS (SELECT symbol, string_agg(DISTINCT m, ' ' ORDER BY m) AS modules FROM (SELECT symbol, unnest(CASE ln WHEN 1 THEN ['f' || pk, 'g_x'] WHEN 4 THEN ['a' || pk, 'b' || pk, 'c'] ELSE [] END) AS m FROM named) GROUP BY 1),
rec AS (SELECT d.symbol, coalesce(r.selected_by, '') AS selected_by, coalesce((SELECT count(*) FROM named n WHERE n.symbol = d.symbol), 0) AS bindings, coalesce((SELECT count(*) FROM uses u WHERE u.symbol = d.symbol), 0) AS usages,
  coalesce(m.modules, '') AS modules, coalesce(t.subsystems, '') AS subsystems, coalesce(t.risks, '') AS risks FROM (SELECT DISTINCT 'CONFIG_S' || k AS symbol FROM v_decl UNION SELECT 'CONFIG_A') d LEFT JOIN rev r ON r.symbol = d.symbol LEFT JOIN mods m ON m.symbol = d.symbol LEFT JOIN tag t ON t.symbol = d.symbol)
"""


def records(v):
    def make():
        options = declared(v).select("symbol").unionByName(usages(v).where("symbol = 'CONFIG_A'").select("symbol"))
        from optlake.operators.graph import reverse_relations
        edges = v("selects").selectExpr("src", "dst", "'select' AS rel")
        return cut_lineage(lint.symbol_records(options, reverse_relations(edges), bindings(v), usages(v), tags_of(v)))

    return v.once("symbol records", make)


@query("j36_symbol_records", f"WITH {RECORDS} SELECT *, least(usages, 100) AS listed_usages FROM rec")
def _(v):
    return records(v).select("symbol", "selected_by", "bindings", "usages", "modules", "subsystems", "risks", "listed_usages")


@query("j36_record_places", f"""
WITH {RECORDS}, places AS (SELECT symbol, string_agg(path || ':' || line_no, ' ' ORDER BY path, line_no) AS usage_list FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, line_no) AS rn FROM uses) WHERE rn <= 100 GROUP BY 1)
SELECT r.symbol, coalesce(usage_list, '') AS usage_list, sha256(concat_ws('|', r.symbol, selected_by, bindings, usages, modules, subsystems, risks, coalesce(usage_list, ''))) AS fact_hash
FROM rec r LEFT JOIN places p ON p.symbol = r.symbol
""")
def _(v):
    return records(v).select("symbol", "usage_list", "fact_hash")


@query("p17_module_names", f"WITH {NAMED} SELECT tree, path, line_no, symbol, CASE ln WHEN 1 THEN 'f' || pk || ' g_x' WHEN 4 THEN 'a' || pk || ' b' || pk || ' c' ELSE '' END AS modules FROM named")
def _(v):
    return bindings(v).select("tree", "path", "line_no", "symbol", F.array_join(lint.module_names(F.col("objects")), " ").alias("modules"))


view("v_expressions", """
SELECT l_orderkey, l_linenumber, l_partkey, 'S' || CAST(l_partkey % 12 AS STRING) || ' && (NET || !S' || CAST(l_suppkey % 12 AS STRING) || ' = "m") && s7' AS expression FROM lineitem
""")


@query("p17_expression_symbols", """
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(list_distinct(list_filter(['NET', 'S' || l_partkey % 12, 'S' || l_suppkey % 12], lambda x: x <> 'S5'))), ' ') AS symbols FROM lineitem
""")
def _(v):
    # option S5 is not declared
    known = F.array(*[F.lit(x) for x in ["NET", *(f"S{i}" for i in range(12) if i != 5)]])
    return v("expressions").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(lint.expression_symbols(F.col("expression"), known), " ").alias("symbols"))


@query("p15_option_search", f"WITH {RECORDS} SELECT symbol FROM rec WHERE symbol LIKE 'CONFIG_S1%' AND ' ' || subsystems || ' ' LIKE '% net %' ORDER BY 1 LIMIT 8")
def _(v):
    rows = records(v).withColumn("prompt", F.lit("Prompt")).withColumn("help", F.lit(None).cast("string")).withColumn("type", F.lit("bool"))
    return lint.search_options(rows, kind="bool", prefix="S1", subsystem="net", text="PROMPT", limit=8)


@query("p15_file_list", r"""
SELECT DISTINCT path FROM v_doc_sources WHERE NOT path LIKE '%/d7.c%' AND NOT list_contains(string_split(path, '/'), 'd11.c') AND (path LIKE '%/d%1.c' OR regexp_full_match(path, 'drivers/[a-s].*/d[2-4].\.c'))
""")
def _(v):
    return lint.list_files(v("doc_sources"), "drivers/", ["*/d*1.c", "drivers/[a-s]*/d[2-4]?.c"], skip=("d7.c", "d11.c"))


@query("p16_excerpts", f"WITH {DOC_LINES}, n AS (SELECT path, max(line_no) AS at FROM doc_lines GROUP BY 1) SELECT d.path, n.at AS \"at\", d.line_no, d.line FROM doc_lines d JOIN n ON n.path = d.path WHERE d.line_no BETWEEN n.at - 2 AND n.at + 2")
def _(v):
    lines = text_lines(v("doc_sources"))
    return lint.excerpts(lines, lines.groupBy("path").agg(F.max("line_no").alias("line_no")), 2)


@query("p37_guidance", f"WITH {RECORDS} SELECT symbol, CASE WHEN risks LIKE '%boot_path%' THEN 'keep_bias' WHEN modules <> '' OR symbol LIKE '%5' THEN 'disable_if_absent' ELSE 'workload_choice' END AS guidance FROM rec")
def _(v):
    kind = F.when(F.col("symbol").endswith("5"), "tristate").otherwise("bool")
    return lint.guidance(records(v).withColumn("type", kind)).select("symbol", "guidance")


@query("p37_enrichment_check", """
SELECT config_id || ':' || symbol AS symbol, CASE WHEN line_no = 1 THEN 'unknown symbol' WHEN value = 'n' THEN 'stale' WHEN value = 'm' THEN 'no citation' WHEN value <> 'y' THEN 'missing file' ELSE 'ok' END AS verdict FROM v_config_values
""")
def _(v):
    rows = v("config_values").withColumn("symbol", F.concat_ws(":", "config_id", "symbol"))
    facts = rows.where("line_no > 1").selectExpr("symbol", "'h' AS fact_hash")
    cited = F.expr("CASE WHEN value = 'm' THEN array() WHEN value = 'y' THEN array('Kconfig') ELSE array('Kconfig', concat('lost/', value)) END")
    drafts = rows.select("symbol", F.when(F.col("value") == "n", "old").otherwise("h").alias("fact_hash"), cited.alias("cited"))
    return lint.valid_enrichments(drafts, facts, rows.limit(1).select(F.lit("Kconfig").alias("path")))


@query("p39_wording", f"WITH {DOC_LINES} SELECT path, line_no, p AS pattern, len(regexp_extract_all(line, '(?i)' || p)) AS hits FROM doc_lines CROSS JOIN (SELECT unnest(['th[ae]n', 'an+d', 'guaranteed']) AS p) WHERE len(regexp_extract_all(line, '(?i)' || p)) > 0")
def _(v):
    return lint.wording(text_lines(v("doc_sources")), ["th[ae]n", "an+d", "guaranteed"])


view("v_words", f"""
SELECT tree, l_orderkey AS ok, line_no, l_linenumber AS ln, {PK} AS pk, CASE l_linenumber WHEN 1 THEN 'obj-y' WHEN 2 THEN 'ramstage-y' WHEN 3 THEN 'pbl-y' ELSE 'obj-m' END AS variable,
  CASE WHEN l_linenumber = 1 THEN '../up/f' || {PK} || '.c' WHEN l_linenumber = 2 THEN './a' || {PK} || '.S' WHEN l_linenumber = 3 THEN 'b' || {PK} || '.o' WHEN l_linenumber = 4 THEN '../../../../out' || {PK} || '.o' WHEN l_linenumber = 5 THEN 'sub/' ELSE 'lib' || {PK} || '.a' END AS word, CASE WHEN l_linenumber = 2 THEN 'src/soc' ELSE 'drivers/net/x' END AS folder FROM v_lines
""")


@query("p09_target_paths", """
SELECT ok, line_no, CASE ln WHEN 1 THEN 'drivers/net/up/f' || pk || '.o' WHEN 2 THEN 'build/ramstage/soc/a' || pk || '.o' WHEN 3 THEN 'drivers/net/x/b' || pk || '.pbl.o' WHEN 4 THEN '../../../../out' || pk || '.o' WHEN 5 THEN NULL ELSE 'drivers/net/x/lib' || pk || '.a' END AS path FROM v_words
""")
def _(v):
    path = pt.target_path(F.col("word"), F.col("variable"), F.col("folder"))
    return v("words").select("ok", "line_no", pt.with_suffix(path, F.col("variable"), {"pbl": ".pbl.o"}).alias("path"))


view("v_some_sources", "SELECT DISTINCT tree, replace(path, '.o', CASE WHEN size > 30 THEN '.c' ELSE '.S' END) AS path FROM v_objects WHERE size > 15 UNION ALL SELECT DISTINCT tree, replace(path, '.o', '.s') FROM v_objects WHERE size < 40")


@query("p10_object_sources", "SELECT tree, path, replace(path, '.o', CASE WHEN size > 30 THEN '.c' WHEN size > 15 THEN '.S' ELSE '.s' END) AS source FROM v_objects")
def _(v):
    return lint.source_of(v("objects").select("tree", "path"), v("some_sources"))


view("v_asked_names", "SELECT DISTINCT tree, CASE WHEN size > 40 THEN path WHEN size > 30 THEN replace(path, '.o', '.c') WHEN size > 20 THEN replace(path, '/u', '/w') ELSE replace(path, '.o', '.txt') END AS name FROM v_objects")


@query("p10_asked_objects", """
SELECT n.tree, n.name, o.path IS NOT NULL AS known FROM v_asked_names n LEFT JOIN v_objects o ON o.tree = n.tree AND o.path = replace(n.name, '.c', '.o')
""")
def _(v):
    return lint.object_of(v("asked_names"), v("objects")).select("tree", "name", "known")


@query("p10_close_names", """
WITH u AS (SELECT n.tree, n.name, replace(n.name, '.c', '.o') AS path FROM v_asked_names n WHERE NOT EXISTS (SELECT 1 FROM v_objects o WHERE o.tree = n.tree AND o.path = replace(n.name, '.c', '.o'))),
w AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM u), k AS (SELECT tree, path, regexp_extract(path, '[^/]*$') AS base FROM v_objects),
pw AS (SELECT *, list_transform(range(1, greatest(length(split_part(base, '.', 1)) - 2, 1) + 1), lambda i: substr(split_part(base, '.', 1), i, 3)) AS pieces FROM w),
pk AS (SELECT *, list_transform(range(1, greatest(length(split_part(base, '.', 1)) - 2, 1) + 1), lambda i: substr(split_part(base, '.', 1), i, 3)) AS pieces FROM k)
SELECT tree, name, suggestion, rank FROM (SELECT pw.tree, pw.name, pk.path AS suggestion, row_number() OVER (PARTITION BY pw.tree, pw.name ORDER BY levenshtein(pw.path, pk.path), pk.path) AS rank
  FROM pw JOIN pk ON pk.tree = pw.tree AND list_has_any(pw.pieces, pk.pieces) AND levenshtein(pw.base, pk.base) <= 2) WHERE rank <= 5
""")
def _(v):
    unknown = lint.object_of(v("asked_names"), v("objects")).where("NOT known")
    return lint.close_names(unknown, v("objects"))


@query("p11_scope", "SELECT path, CASE WHEN path LIKE 'arch/arm%' THEN 'arm' END AS arch, NOT (path LIKE 'tools/%' OR path LIKE 'arch/%') AS in_scope, NOT path LIKE '%.mod.c' AS is_source FROM v_source_paths")
def _(v):
    path = F.col("path")
    return v("source_paths").select("path", pt.arch_of(path).alias("arch"), pt.in_scope(path, "x86").alias("in_scope"), pt.is_source(path).alias("is_source"))


@query("s03_object_listing", "SELECT tree, config_id, path FROM v_inventory WHERE path NOT LIKE 'scripts/%'")
def _(v):
    stubs = v("inventory").withColumn("path", F.regexp_replace("path", r"\.o$", ".mod.o"))
    dotted = v("inventory").withColumn("path", F.concat(F.when(F.col("path").startswith("scripts"), "").otherwise("./"), "path"))
    return b.listed_objects(dotted.unionByName(stubs))


@query("s12_guard_store", "SELECT 'nodes' AS part, op, count(*) AS n FROM v_guard_nodes GROUP BY 2 UNION ALL SELECT 'edges', NULL, count(*) FROM v_guard_edges UNION ALL SELECT 'objects', kind, count(*) FROM v_objects GROUP BY 2")
def _(v):
    path = f"{shared_folder(v.spark)}/store-{uuid.uuid4().hex}"
    st.write_store(path, objects=v("objects"), guard_nodes=v("guard_nodes"), guard_edges=v("guard_edges"))
    kept = st.read_store(v.spark, path)
    n = F.count(F.lit(1)).alias("n")
    return (kept["guard_nodes"].groupBy("op").agg(n).select(F.lit("nodes").alias("part"), "op", "n")
            .unionByName(kept["guard_edges"].agg(n).select(F.lit("edges").alias("part"), F.lit(None).cast("string").alias("op"), "n"))
            .unionByName(kept["objects"].groupBy(F.col("kind").alias("op")).agg(n).select(F.lit("objects").alias("part"), "op", "n")))


text_view("v_tool_text", "tree", f"CASE WHEN ln = 1 THEN 'unit_pc $(X)/t.o 1' WHEN ln = 2 THEN 'unit_pc d' || CAST(pk AS STRING) || '/ 1' WHEN ln = 3 THEN 'note' ELSE 'unit_pc u' || CAST(pk AS STRING) || '.o defined(A)  && B' END", "v_make_rows", "ok, line_no")


@query("s13_tool_conditions", "SELECT tree, 'u' || pk || '.o' AS object, 'defined(A)  && B' AS condition FROM v_make_rows WHERE ln > 3")
def _(v):
    return b.tool_conditions(v("tool_text"))


text_view("v_trace_text", "tree", f"CASE WHEN ln = 1 THEN 'gcc -c -o scripts/s.o s.c' WHEN ln < 5 THEN 'gcc -c -o d/u' || CAST(pk AS STRING) || '.o u.c' ELSE '  AR lib' || CAST(pk AS STRING) || '.a' END", "v_make_rows", "ok, line_no")


@query("s14_dry_run_objects", "SELECT DISTINCT tree, CASE WHEN ln < 5 THEN 'd/u' || pk || '.o' ELSE 'lib' || pk || '.a' END AS object FROM v_make_rows WHERE ln > 1")
def _(v):
    return b.dry_run_objects(v("trace_text"))


@query("s38_report_sink", f"WITH {PRED} SELECT view, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp FROM {agree()} GROUP BY 1")
def _(v):
    path = f"{shared_folder(v.spark)}/report-{uuid.uuid4().hex}"
    st.write_report(agreement_of(v), path, ["view"])
    back = v.spark.read.schema("tree long, config_id long, tp long, view string").json(path)
    return back.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"))


@query("a22_claims_audit", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus <> 'F') AS unverified FROM orders")
def _(v):
    from optlake.plans.scoreboard import claims_audit
    return claims_audit(v.sql("SELECT o_orderkey AS claim_id, CASE o_orderstatus WHEN 'F' THEN ' Verified ' ELSE 'open' END AS status FROM orders"))


@query("a23_distinct_conditions", "SELECT count(DISTINCT gnum) AS conditions FROM v_guards")
def _(v):
    hashes = g.condition_hashes(v("guard_nodes"), v("guard_edges").distinct(), v("guards").select("tree", "guard_id"))
    return hashes.agg(F.countDistinct("hash").alias("conditions"))


LIMITS = {
    "limited": "v NOT IN ('y', 'm') OR (k NOT BETWEEN 20 AND 22 AND NOT (k % 2 = 0 AND v = 'm'))",
    "freed": "v NOT IN ('y', 'm') OR NOT (k % 2 = 0 AND v = 'm' AND k NOT BETWEEN 20 AND 22)",
}


def limited(name, table="truth"):
    ok = " AND ".join(LIMITS[name].replace("k ", f"CAST(substr(s{i}, 9) AS INT) ").replace("v ", f"v{i} ").join("()") for i in range(3))
    return f"{name} AS (SELECT gnum, CASE WHEN NOT coalesce(bool_or(ok), FALSE) THEN 'dead' ELSE 'alive' END AS st FROM {table} WHERE {ok} GROUP BY 1)"


DEAD = f"""
{TABLE.strip()}, st0 AS (SELECT gnum, CASE WHEN NOT bool_or(ok) THEN 'dead' ELSE 'alive' END AS st FROM truth GROUP BY 1), {limited('limited')}, {limited('freed')},
flg AS (SELECT gnum, bool_or(want = 'm' AND CAST(substr(symbol, 9) AS INT) % 2 = 0 AND CAST(substr(symbol, 9) AS INT) NOT BETWEEN 20 AND 22) AS container, bool_or(CAST(substr(symbol, 9) AS INT) BETWEEN 20 AND 22) AS incomplete FROM lit GROUP BY 1),
dead AS (SELECT g.tree, g.guard_id, CASE WHEN a.st = 'dead' THEN 'dead-everywhere' WHEN c.st <> 'dead' THEN 'arch-dead' ELSE 'dead-everywhere' END AS cause,
  CASE WHEN a.st = 'dead' THEN CASE WHEN f.container THEN 'info' ELSE 'error' END WHEN f.incomplete OR c.st <> 'dead' OR f.container THEN 'info' ELSE 'error' END AS severity FROM v_guards g JOIN st0 a ON a.gnum = g.gnum JOIN limited b ON b.gnum = g.gnum JOIN freed c ON c.gnum = g.gnum JOIN flg f ON f.gnum = g.gnum WHERE a.st = 'dead' OR b.st = 'dead')
"""
view("v_option_types", "SELECT DISTINCT 'CONFIG_S' || CAST(p_partkey % 40 AS STRING) AS symbol, p_partkey % 40 AS k FROM part")


def dead_guards(v):
    def make():
        from optlake.plans.explain import dead_findings
        types = v("option_types").selectExpr("symbol", "k BETWEEN 20 AND 22 AS absent", "CASE WHEN k % 2 = 0 THEN 'bool' ELSE 'tristate' END AS type")
        return cut_lineage(dead_findings(v("guards").select("tree", "guard_id"), v("guard_nodes"), v("guard_edges"), types))

    return v.once("dead guards", make)


@query("g13_dead_severity", f"WITH {DEAD} SELECT * FROM dead")
def _(v):
    return dead_guards(v).select("tree", "guard_id", "cause", "severity")


def arch_limit(name, low, high):
    ok = " AND ".join(f"(v{i} = 'undef' OR CAST(substr(s{i}, 9) AS INT) NOT BETWEEN {low} AND {high})" for i in range(3))
    return f"{name} AS (SELECT gnum, bool_or(ok) AS alive FROM truth WHERE {ok} GROUP BY 1)"


@query("g14_multi_arch", f"""
WITH {TABLE.strip()}, {arch_limit('arm', 0, 24)}, {arch_limit('mips', 10, 39)} SELECT g.tree, g.guard_id, CASE WHEN g.gnum = 0 OR a.alive THEN 'arm' WHEN m.alive THEN 'mips' END AS alive_on FROM v_guards g LEFT JOIN arm a ON a.gnum = g.gnum LEFT JOIN mips m ON m.gnum = g.gnum
""")
def _(v):
    def domain(low, high):
        rows = v("option_types").where(F.col("k").between(low, high))
        return rows.select("symbol", F.explode(F.array(F.lit("y"), F.lit("m"))).alias("banned"))

    return reports.first_reviving(v("guard_nodes"), v("guard_edges"), v("guards").select("tree", "guard_id"), {"arm": domain(0, 24), "mips": domain(10, 39)})


@query("i07_whole_lint", f"""
WITH {ZOMBIE}, {HARD}, {ORPHAN}, {DEAD.strip()} SELECT 'zombie' AS class, severity, count(*) AS findings FROM zom GROUP BY 2 UNION ALL SELECT 'hard-coded', severity, count(*) FROM hard GROUP BY 2 UNION ALL SELECT 'orphan', 'warning', count(*) FROM orph UNION ALL SELECT 'dead', severity, count(*) FROM dead GROUP BY 2
""")
def _(v):
    return reports.whole_lint(lint.zombie_symbols(references(v), declared(v), "x86"), hard_coded(v), orphans(v), dead_guards(v))


@query("i06_patch_lint", f"""
WITH {NAMED}, {SCOPE}, {ORPHAN}, z AS (SELECT n.ok AS patch, count(DISTINCT (n.line_no, n.symbol)) AS n FROM named n LEFT JOIN scope s ON s.symbol = n.symbol WHERE (s.here IS NULL OR NOT s.here) AND EXISTS (SELECT 1 FROM v_patch_rows p WHERE p.patch = n.ok AND p.ln = 3) GROUP BY 1),
o AS (SELECT p.patch, count(DISTINCT p.path) AS n FROM v_patch_rows p JOIN orph x ON x.tree = p.tree AND x.path = p.path GROUP BY 1),
i AS (SELECT ok AS patch, count(DISTINCT u) AS n FROM v_make_rows m, unnest(CASE ln WHEN 1 THEN ['f' || pk || '.o', 'sub' || pk || '/g-x.o'] WHEN 4 THEN ['a' || pk || '.o', '/b' || pk || '.o', '/c.o'] ELSE [] END) t(u) WHERE EXISTS (SELECT 1 FROM v_patch_rows p WHERE p.patch = m.ok AND p.ln = 3) GROUP BY 1)
SELECT d.patch, coalesce(z.n, 0) AS zombies, coalesce(o.n, 0) AS orphans, coalesce(i.n, 0) AS impacted FROM (SELECT DISTINCT patch FROM v_patch_rows) d LEFT JOIN z ON z.patch = d.patch LEFT JOIN o ON o.patch = d.patch LEFT JOIN i ON i.patch = d.patch
""")
def _(v):
    touched = b.touched_files(v("patch_text"))
    origins = bindings(v).select("tree", "path", F.explode("objects").alias("object"))
    return reports.patch_lint(touched, bindings(v), declared(v), v("source_paths"), orphans(v), origins, "x86")


@query("a24_corpus_summary", f"""
WITH {TABLE.strip()}, dd AS (SELECT gnum FROM truth GROUP BY 1 HAVING NOT bool_or(ok)) SELECT o.tree, count(*) AS objects, coalesce((SELECT count(DISTINCT path) FROM v_make_rows m WHERE m.tree = o.tree), 0) AS build_files, coalesce((SELECT count(*) + count(*) FILTER (ln = 2) FROM v_make_rows m WHERE m.tree = o.tree), 0) AS lines,
  coalesce((SELECT count(DISTINCT symbol) FROM v_literals l WHERE l.tree = o.tree), 0) AS options, count(*) FILTER (o.gnum IN (SELECT gnum FROM dd)) AS dead,
  coalesce((SELECT count(*) FROM v_objects x JOIN (SELECT tree, guard_id FROM v_verdicts GROUP BY 1, 2 HAVING bool_or(built)) e ON e.tree = x.tree AND e.guard_id = x.guard_id WHERE x.tree = o.tree), 0) AS covered FROM v_objects o GROUP BY o.tree
""")
def _(v):
    guards = v("guards").select("tree", "guard_id")
    status = g.satisfiability(v("guard_nodes"), v("guard_edges"), guards)
    symbols = v("literals").select("tree", "symbol")
    return reports.corpus_summary(v("objects"), v("make_text"), symbols, status, picks_of(v)).drop("suite", "covered_pct")
