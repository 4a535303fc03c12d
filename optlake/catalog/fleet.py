"""Fleet queries: a customer stands for a host, its orders for devices."""

from pyspark.sql import functions as F

from optlake.catalog import views  # noqa: F401
from optlake.catalog.registry import query, view
from optlake.operators import fleet as f
from optlake.sources import configs as src
from optlake.sources import hosts as h
from optlake.sources import modules as m

NL, TAB = "chr(10)", "chr(9)"


def agg_text(expr, source, order, sep=NL, group="host"):
    """One text per group in both dialects."""
    return (f"SELECT {group}, listagg({expr}, {sep}) WITHIN GROUP (ORDER BY {order}) AS text FROM {source} GROUP BY {group}",
            f"SELECT {group}, string_agg({expr}, {sep} ORDER BY {order}) AS text FROM {source} GROUP BY {group}")


view("v_devices", """
SELECT o_custkey AS host, o_orderkey AS dev, o_orderstatus AS st, CAST(floor(o_totalprice) AS BIGINT) AS size, CASE o_orderstatus WHEN 'F' THEN '0300' WHEN 'P' THEN '0403' ELSE '0200' END AS class_id,
  CASE WHEN o_orderpriority LIKE '1%' THEN '10de' WHEN o_orderpriority LIKE '2%' THEN '1002' ELSE '8086' END AS vendor_id, 'drv' || CAST(o_orderkey % 23 AS STRING) AS driver FROM orders
""", keep=True)
view("v_device_modules", "SELECT tree AS host, l_orderkey AS dev, line_no, 'mod-' || CAST(l_partkey % 60 AS STRING) AS module FROM v_lines")
view("v_pci_blocks", f"""
SELECT d.host, d.dev, 'Slot:' || {TAB} || CAST(d.dev AS STRING) || {NL} || 'Class:' || {TAB} || d.class_id || {NL} || 'Vendor:' || {TAB} || d.vendor_id || {NL} || 'Device:' || {TAB} || 'd' || CAST(d.size AS STRING)
  || CASE WHEN d.st = 'O' THEN '' ELSE {NL} || 'Driver:' || {TAB} || d.driver END || coalesce({NL} || t.text, '') AS block
FROM v_devices d LEFT JOIN (SELECT dev, listagg('Module:' || {TAB} || module, {NL}) WITHIN GROUP (ORDER BY line_no) AS text FROM v_device_modules GROUP BY dev) t ON t.dev = d.dev
""", f"""
SELECT d.host, d.dev, 'Slot:' || {TAB} || CAST(d.dev AS STRING) || {NL} || 'Class:' || {TAB} || d.class_id || {NL} || 'Vendor:' || {TAB} || d.vendor_id || {NL} || 'Device:' || {TAB} || 'd' || CAST(d.size AS STRING)
  || CASE WHEN d.st = 'O' THEN '' ELSE {NL} || 'Driver:' || {TAB} || d.driver END || coalesce({NL} || t.text, '') AS block
FROM v_devices d LEFT JOIN (SELECT dev, string_agg('Module:' || {TAB} || module, {NL} ORDER BY line_no) AS text FROM v_device_modules GROUP BY dev) t ON t.dev = d.dev
""")
view("v_pci_text", *agg_text("block", "v_pci_blocks", "dev", f"{NL} || {NL}"))


@query("s15_pci_scan", """
SELECT d.host, CAST(d.dev AS VARCHAR) AS slot, d.class_id, d.vendor_id, 'd' || d.size AS device_id, CASE WHEN st <> 'O' THEN driver END AS driver, coalesce(t.m, '') AS modules
FROM v_devices d LEFT JOIN (SELECT dev, string_agg(module, ',' ORDER BY line_no) AS m FROM v_device_modules GROUP BY 1) t ON t.dev = d.dev
""")
def _(v):
    return h.pci_devices(v("pci_text")).select("host", "slot", "class_id", "vendor_id", "device_id", "driver", F.array_join("modules", ",").alias("modules"))


view("v_host_lines", f"""
SELECT host, dev, 'Bus 00' || CAST(dev % 4 AS STRING) || ' Device 012: ID ' || vendor_id || ':' || class_id || CASE WHEN st = 'F' THEN '' ELSE ' Some Hub' END AS usb,
  '/sys/' || CAST(dev AS STRING) || {TAB} || CASE WHEN st = 'P' THEN 'nobus' ELSE 'pci:v' || vendor_id || 'c' || class_id END AS alias, '/dev/' || CAST(dev AS STRING) || {TAB} || driver || ' kbd' AS bound,
  driver || ' ' || CASE WHEN st = 'P' THEN 'big' ELSE CAST(size AS STRING) END || ' 2 ' || CASE WHEN st = 'F' THEN '-' ELSE 'a,b,' END AS loaded, 'nvidia/' || CAST(dev AS STRING) || '.1, 6.8.0, x86_64: ' || CASE WHEN st = 'F' THEN 'installed' ELSE 'built' END AS dkms,
  'src' || CAST(dev AS STRING) || ' ' || CASE st WHEN 'F' THEN '/' WHEN 'P' THEN '/boot' ELSE '/srv' END || CASE WHEN size > 200000 THEN ' ext4 rw 0 0' ELSE ' vfat' END AS mount,
  CASE WHEN st = 'F' THEN 'audio' ELSE ' firewall' END || {TAB} || 'pkg' || {TAB} || vendor_id || CASE WHEN class_id = '0300' THEN {TAB} || 'x' ELSE '' END AS soft, 'fw/' || vendor_id || '.bin loaded' AS dmesg, driver || {TAB} || 'fw/' || class_id || '.ucode' AS modfw
FROM v_devices
""", keep=True)
for name in ("usb", "alias", "bound", "loaded", "dkms", "mount", "soft", "dmesg", "modfw"):
    view(f"v_{name}_text", *agg_text(name, "v_host_lines", "dev"))


@query("s16_usb_scan", "SELECT host, '00' || dev % 4 AS bus, '012' AS device, vendor_id, class_id AS product_id, CASE WHEN st <> 'F' THEN 'Some Hub' END AS description FROM v_devices")
def _(v):
    return h.usb_devices(v("usb_text"))


@query("s17_modaliases", "SELECT host, '/sys/' || dev AS sysfs_path, CASE WHEN st = 'P' THEN 'nobus' ELSE 'pci:v' || vendor_id || 'c' || class_id END AS raw, CASE WHEN st = 'P' THEN 'unknown' ELSE 'pci' END AS bus FROM v_devices")
def _(v):
    return h.modaliases(v("alias_text"))


@query("s17_bound_drivers", "SELECT host, '/dev/' || dev AS device, driver || ' kbd' AS driver FROM v_devices")
def _(v):
    return h.bound_drivers(v("bound_text"))


@query("s18_loaded_modules", "SELECT host, driver AS name, size, CAST(2 AS BIGINT) AS used_by_count, CASE WHEN st = 'F' THEN '' ELSE 'a,b' END AS used_by FROM v_devices WHERE st <> 'P'")
def _(v):
    return h.loaded_modules(v("loaded_text")).withColumn("used_by", F.array_join("used_by", ","))


@query("s19_mounts", "SELECT host, 'src' || dev AS source, CASE st WHEN 'F' THEN '/' WHEN 'P' THEN '/boot' ELSE '/srv' END AS target, 'ext4' AS fstype, 'rw' AS options FROM v_devices WHERE size > 200000")
def _(v):
    return h.mounts(v("mount_text"))


DISK = """'{"name": "d' || CAST(dev AS STRING) || '", "type": "disk", "children": [{"name": "p' || CAST(dev AS STRING) || '", "fstype": "ext4", "type": "part"' || CASE WHEN st = 'F' THEN ', "children": [{"name": "md0", "fstype": null, "type": "raid"}]' ELSE '' END || '}]}'"""
LINK = """'{"ifindex": ' || CAST(dev AS STRING) || ', "ifname": "' || CASE WHEN st = 'P' THEN '' ELSE 'eth' || CAST(dev AS STRING) END || '", "operstate": "' || CASE WHEN st = 'F' THEN 'UP' ELSE 'DOWN' END || '"' || CASE WHEN st = 'O' THEN ', "linkinfo": {"info_kind": "tun"}' ELSE '' END || '}'"""
view("v_disk_inner", *agg_text(DISK, "v_devices", "dev", "', '"))
view("v_link_inner", *agg_text(LINK, "v_devices", "dev", "', '"))
view("v_disk_text", "SELECT host, '{\"blockdevices\": [' || text || ']}' AS text FROM v_disk_inner")
view("v_link_text", "SELECT host, '[' || text || ']' AS text FROM v_link_inner")


@query("s20_block_devices", """
SELECT host, 'd' || dev AS name, NULL AS fstype, 'disk' AS type FROM v_devices UNION ALL SELECT host, 'p' || dev, 'ext4', 'part' FROM v_devices UNION ALL SELECT host, 'md0', NULL, 'raid' FROM v_devices WHERE st = 'F'
""")
def _(v):
    return h.block_devices(v("disk_text"))


@query("s21_network_links", "SELECT host, CASE WHEN st = 'P' THEN CAST(dev AS VARCHAR) ELSE 'eth' || dev END AS name, CASE WHEN st = 'O' THEN 'tun' END AS driver, CASE WHEN st = 'F' THEN 'UP' ELSE 'DOWN' END AS operstate, st = 'F' AS is_active FROM v_devices")
def _(v):
    return h.network_links(v("link_text"))


@query("s22_dkms", "SELECT host, 'nvidia' AS name, dev || '.1' AS version, '6.8.0' AS kernel, CASE WHEN st = 'F' THEN 'installed' ELSE 'built' END AS status FROM v_devices")
def _(v):
    return h.dkms_modules(v("dkms_text"))


@query("s22_software_features", "SELECT DISTINCT host, CASE WHEN st = 'F' THEN 'audio' ELSE 'firewall' END AS feature, 'pkg' AS source, vendor_id AS name, CASE WHEN class_id = '0300' THEN 'x' END AS detail FROM v_devices")
def _(v):
    return h.software_features(v("soft_text"))


view("v_hosts", """
SELECT c_custkey AS host, CASE c_nationkey % 3 WHEN 0 THEN 'GenuineIntel' WHEN 1 THEN 'AuthenticAMD' ELSE 'HygonGenuine' END AS vendor_id, CASE c_nationkey % 3 WHEN 0 THEN 6 ELSE 15 + c_nationkey END AS cpu_family,
  CAST(c_custkey % 64 AS INT) AS model, CAST(2 + c_custkey % 3 AS INT) AS cores, CAST(c_custkey % 36 AS INT) AS chassis_type, c_mktsegment AS product_family, '6.' || CAST(c_nationkey AS STRING) || '.0-1-generic' AS release,
  CASE WHEN c_acctbal < 0 THEN 'QEMU' ELSE 'Acme' END AS sys_vendor, CASE WHEN c_nationkey > 22 THEN 'aarch64' ELSE 'x86_64' END AS arch, c_acctbal AS balance, c_mktsegment AS seg FROM customer
""")
view("v_cpu_text", f"""
SELECT host, 'processor : 0' || {NL} || 'vendor_id : ' || vendor_id || {NL} || 'cpu family : ' || CAST(cpu_family AS STRING) || {NL} || 'model : ' || CAST(model AS STRING) || {NL} || 'model name : Chip ' || seg || {NL} || 'flags : fpu hypervisor sse' || {NL} || {NL} || 'processor : 1'
  || CASE WHEN cores > 2 THEN {NL} || {NL} || 'processor : 2' ELSE '' END || CASE WHEN cores > 3 THEN {NL} || {NL} || 'processor : 3' || {NL} ELSE '' END AS text FROM v_hosts
""")
view("v_id_text", f"SELECT host, 'sys_vendor' || {TAB} || ' Acme ' || seg || {NL} || 'chassis_type' || {TAB} || CAST(chassis_type AS STRING) || {NL} || 'junk' AS text FROM v_hosts")


@query("s23_cpu_info", "SELECT host, vendor_id, cpu_family, model, 'Chip ' || seg AS model_name, cores, 'fpu hypervisor sse' AS flags FROM v_hosts")
def _(v):
    return h.cpu_info(v("cpu_text")).withColumn("flags", F.array_join("flags", " "))


@query("s23_identity", "SELECT host, 'Acme ' || seg AS sys_vendor, chassis_type, CAST(NULL AS VARCHAR) AS board_name FROM v_hosts")
def _(v):
    rows = h.key_values(v("id_text"), ["sys_vendor", "chassis_type", "board_name"], r"\t")
    return rows.withColumn("chassis_type", F.col("chassis_type").try_cast("int"))


@query("s24_firmware", "SELECT DISTINCT host, 'fw/' || vendor_id || '.bin' AS name, 'dmesg' AS source FROM v_devices UNION ALL SELECT DISTINCT host, 'fw/' || class_id || '.ucode', 'modinfo' FROM v_devices")
def _(v):
    empty = v("dmesg_text").where("text LIKE 'no such%'")
    return h.firmware([("dmesg", v("dmesg_text")), ("journal", empty)], v("modfw_text"))


@query("s24_initramfs", "SELECT DISTINCT host, driver || ' kbd' AS name FROM v_devices")
def _(v):
    return h.initramfs_names(v("bound_text").withColumn("text", F.regexp_replace("text", r"(?m)^[^\t]*\t", "")))


view("v_boot_rows", """
SELECT host, 'quiet root=/dev/sda rootfstype=' || CASE WHEN seg < 'C' THEN 'xfs' ELSE 'btrfs' END || CASE WHEN balance < 2000 THEN ' module_blacklist=a,,b-' || CAST(host % 10 AS STRING) ELSE ' blacklist=q' END || CASE WHEN arch = 'aarch64' THEN ' rd.luks.uuid=1' ELSE '' END || ' quiet root=/dev/sdb' AS cmdline,
  CASE WHEN balance > 5000 THEN '0' ELSE '1' END AS efi_rc, CASE WHEN balance > 7000 THEN 'SecureBoot enabled' WHEN balance > 3000 THEN 'SecureBoot disabled' ELSE '' END AS secureboot, CASE WHEN seg = 'BUILDING' THEN 'active' ELSE ' ' END AS crypt_status, balance, seg, arch FROM v_hosts
""")


@query("s25_boot_context", """
SELECT b.host, '/dev/sdb' AS root, CASE WHEN balance < 2000 THEN 'a,b-' || host % 10 ELSE 'q' END AS blacklist, balance > 5000 AS efi, CASE WHEN balance > 7000 THEN TRUE WHEN balance > 3000 THEN FALSE END AS secure_boot,
  CASE WHEN EXISTS (SELECT 1 FROM v_devices d WHERE d.host = b.host AND d.size > 200000 AND d.st = 'F') THEN 'ext4' WHEN seg < 'C' THEN 'xfs' ELSE 'btrfs' END AS root_fstype,
  CASE WHEN EXISTS (SELECT 1 FROM v_devices d WHERE d.host = b.host AND d.size > 200000 AND d.st = 'P') THEN 'ext4' END AS boot_fstype, seg = 'BUILDING' OR arch = 'aarch64' AS luks_in_chain FROM v_boot_rows b
""")
def _(v):
    rows = h.boot_context(v("boot_rows"), h.mounts(v("mount_text")))
    return rows.select("host", F.col("params")["root"].alias("root"), F.array_join("blacklist", ",").alias("blacklist"), "efi", "secure_boot", "root_fstype", "boot_fstype", "luks_in_chain")


@query("s26_snapshot_assembly", """
SELECT h.host, h.vendor_id, count(d.dev) AS pci, count(d.dev) FILTER (size > 200000) AS mounts, count(d.dev) FILTER (st <> 'P') AS modules FROM v_hosts h LEFT JOIN v_devices d ON d.host = h.host GROUP BY 1, 2
""")
def _(v):
    snap = h.assemble(h.cpu_info(v("cpu_text")).select("host", "vendor_id"), pci=h.pci_devices(v("pci_text")), mounts=h.mounts(v("mount_text")), modules=h.loaded_modules(v("loaded_text")))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    return snap.select("host", "vendor_id", n("pci"), n("mounts"), n("modules"))


view("v_alias_lines", """
SELECT 'alias ' || CASE WHEN p_size % 7 = 0 THEN 'usb:v' || lpad(CAST(p_partkey % 300 AS STRING), 4, '0') || '*' WHEN p_size % 7 = 1 THEN 'pci:v0' || CAST(p_partkey % 10 AS STRING) || '?[0-4]d*q' || CAST(p_size AS STRING)
   WHEN p_size % 7 = 2 THEN 'pci:*q[!0-3]' || CAST(p_size % 10 AS STRING) ELSE 'pci:v' || lpad(CAST(p_partkey % 300 AS STRING), 4, '0') || 'd' || lpad(CAST(p_size AS STRING), 2, '0') || '*' END || ' mod' || CAST(p_partkey AS STRING) AS line FROM part
""")
view("v_alias_ids", "SELECT tree AS host, CASE WHEN l_linenumber = 3 THEN 'usb' ELSE 'pci' END || ':v' || lpad(CAST(l_partkey % 300 AS STRING), 4, '0') || 'd' || lpad(CAST(CAST(l_quantity AS INT) AS STRING), 2, '0') || 'q' || CAST(CAST(l_quantity AS INT) AS STRING) AS raw FROM v_lines")


@query("s27_alias_table", "SELECT split_part(line, ' ', 2) AS pattern, split_part(line, ' ', 3) AS module, split_part(split_part(line, ' ', 2), ':', 1) AS bus FROM v_alias_lines")
def _(v):
    return m.alias_rows(v("alias_lines"))


GLOBBED = """
ids AS (SELECT DISTINCT raw FROM v_alias_ids), pats AS (SELECT split_part(line, ' ', 2) AS pattern, split_part(line, ' ', 3) AS module FROM v_alias_lines),
hit AS (SELECT DISTINCT raw, module FROM ids JOIN pats ON split_part(raw, ':', 1) = split_part(pattern, ':', 1) AND raw GLOB pattern)
"""


@query("j07_modalias_match", f"WITH {GLOBBED} SELECT DISTINCT i.host, i.raw, h.module FROM v_alias_ids i JOIN hit h ON h.raw = i.raw")
def _(v):
    ids = v("alias_ids").distinct()
    return ids.join(f.match_aliases(ids, m.alias_rows(v("alias_lines"))), "raw")


@query("j07_unresolved", f"WITH {GLOBBED} SELECT host, raw FROM v_alias_ids WHERE raw NOT IN (SELECT raw FROM hit)")
def _(v):
    return f.unresolved_aliases(v("alias_ids"), f.match_aliases(v("alias_ids"), m.alias_rows(v("alias_lines")))).select("host", "raw")


view("v_dep_lines", """
SELECT CASE p_size % 3 WHEN 0 THEN 'kernel/drivers/net/mod-' WHEN 1 THEN 'kernel/fs/x' || lower(p_type) || '/mod-' ELSE 'extra/mod-' END || CAST(p_partkey AS STRING) || CASE WHEN p_size < 20 THEN '.ko' WHEN p_size < 40 THEN '.ko.zst' ELSE '.so' END || ': kernel/lib/a.ko' AS line, p_partkey, p_size, p_type FROM part
""")


@query("s28_dependency_paths", """
SELECT 'mod_' || p_partkey AS module, CASE p_size % 3 WHEN 0 THEN 'drivers/net/mod-' ELSE 'fs/x' || lower(p_type) || '/mod-' END || p_partkey AS source_path FROM part WHERE p_size % 3 < 2 AND p_size < 40
""")
def _(v):
    return m.dependency_paths(v("dep_lines"))


view("v_modinfo_text", (
    "SELECT host, 'm' || CAST(host AS STRING) || '.license=GPL' || chr(0) || CASE WHEN seg = 'BUILDING' THEN '' ELSE 'm' || CAST(host AS STRING) || '.file=drivers/a' || CAST(host AS STRING) || chr(0) || 'm' || CAST(host AS STRING) || '.file=later' END AS text FROM v_hosts"
))


@query("s28_module_info", """
SELECT coalesce(b.module, c.module) AS module, CASE WHEN b.module IS NOT NULL THEN b.path ELSE c.path END AS source_path, b.module IS NOT NULL AS is_builtin FROM (SELECT 'm' || host AS module, CASE WHEN seg <> 'BUILDING' THEN 'drivers/a' || host END AS path FROM v_hosts) b
FULL JOIN (SELECT 'm' || p_partkey AS module, 'cached/' || p_partkey AS path FROM part) c ON c.module = b.module
""")
def _(v):
    cached = v.sql("SELECT 'm' || CAST(p_partkey AS STRING) AS module, 'cached/' || CAST(p_partkey AS STRING) AS source_path FROM part")
    return m.module_info(m.builtin_records(v("modinfo_text")), cached)


@query("s33_module_history", "SELECT DISTINCT host, driver AS module, 'unknown' AS absence_means FROM v_devices")
def _(v):
    return m.observed_modules(v("loaded_text").withColumn("text", F.concat(F.lit("# list\n"), "text")))


TABLE = [("drivers/net/", ["NET_{name}", "{name}"]), ("fs/", ["{fsdir}_FS", "{fsdir}"]), ("sound/", ["SND_{name}"])]
# module mN of a host belongs to option CONFIG_SN, found by template or bare name
view("v_host_modules", """
SELECT DISTINCT tree AS host, 's' || CAST(l_partkey % 45 AS STRING) AS module, CASE WHEN l_partkey % 45 % 3 = 0 THEN 'fs/s' || CAST(l_partkey % 45 % 40 AS STRING) || '/x' WHEN l_partkey % 45 % 3 = 1 THEN 'drivers/net/y' END AS source_path FROM v_lines
""")
view("v_host_values", "SELECT tree AS host, symbol, value FROM (SELECT *, row_number() OVER (PARTITION BY tree, symbol ORDER BY config_id DESC) AS rn FROM v_config_values) t WHERE rn = 1", keep=True)
CAND = """
cand AS (SELECT DISTINCT module, source_path, u.pos, 'CONFIG_' || u.s AS symbol FROM v_host_modules, LATERAL (SELECT * FROM (VALUES (0, CASE WHEN source_path LIKE 'drivers/net/%' THEN 'NET_' || upper(module) END),
  (1, CASE WHEN source_path LIKE 'fs/%' THEN upper(split_part(source_path, '/', 2)) || '_FS' END), (2, CASE WHEN source_path LIKE 'fs/%' THEN upper(split_part(source_path, '/', 2)) END), (3, upper(module))) t(pos, s) WHERE s IS NOT NULL) u)
"""


@query("j08_module_options", f"""
WITH {CAND}, b AS (SELECT h.host, h.module, arg_min(c.symbol, c.pos) AS symbol FROM v_host_modules h JOIN cand c ON c.module = h.module JOIN v_host_values v ON v.host = h.host AND v.symbol = c.symbol AND v.value IN ('y', 'm') GROUP BY 1, 2)
SELECT DISTINCT h.host, h.module, b.symbol FROM v_host_modules h LEFT JOIN b ON b.host = h.host AND b.module = h.module
""")
def _(v):
    return f.module_options(v("host_modules"), v("host_values"), TABLE).drop("source_path")


view("v_blacklist", "SELECT DISTINCT host, driver AS module FROM v_devices WHERE size > 400000")


@query("j09_keep_set", """
WITH e AS (SELECT host, driver AS module, 'loaded' AS why, count(*) AS n FROM v_devices WHERE st <> 'P' GROUP BY 1, 2 UNION ALL SELECT host, driver, 'bound', count(*) FROM v_devices GROUP BY 1, 2
  UNION ALL SELECT host, module, 'pci module', count(*) FROM v_device_modules GROUP BY 1, 2)
SELECT host, module, CAST(sum(n) AS BIGINT) AS evidence, string_agg(why, '; ' ORDER BY why) AS why FROM e WHERE NOT EXISTS (SELECT 1 FROM v_blacklist b WHERE b.host = e.host AND b.module = e.module) GROUP BY 1, 2
""")
def _(v):
    loaded = h.loaded_modules(v("loaded_text")).select("host", F.col("name").alias("module"))
    bound = h.bound_drivers(v("bound_text")).select("host", F.split("driver", " ")[0].alias("module"))
    pci = h.pci_devices(v("pci_text")).select("host", F.explode("modules").alias("module"))
    return f.keep_set([("loaded", loaded), ("bound", bound), ("pci module", pci)], v("blacklist"))


NEEDED = f"""
{CAND}, need AS (SELECT h.host, arg_min(c.symbol, c.pos) AS symbol FROM v_host_modules h JOIN cand c ON c.module = h.module JOIN v_host_values v ON v.host = h.host AND v.symbol = c.symbol AND v.value IN ('y', 'm') GROUP BY h.host, h.module),
trim AS (SELECT host, symbol, value FROM v_host_values v WHERE value IN ('y', 'm') AND NOT EXISTS (SELECT 1 FROM need n WHERE n.host = v.host AND n.symbol = v.symbol))
"""


def trims_of(v):
    required = f.module_options(v("host_modules"), v("host_values"), TABLE).where("symbol IS NOT NULL")
    return f.candidate_trims(v("host_values"), required)


@query("j10_candidate_trims", f"WITH {NEEDED} SELECT * FROM trim")
def _(v):
    return trims_of(v)


@query("j11_focused_trims", f"""
WITH {NEEDED}, sc AS (SELECT t.host, t.symbol, min((CASE WHEN c.source_path LIKE 'drivers/net%' THEN 10 ELSE 100 END, CASE WHEN t.value = 'm' THEN 0 ELSE 25 END, c.source_path)) AS s FROM trim t
  JOIN (SELECT DISTINCT symbol, source_path FROM cand WHERE source_path LIKE 'drivers/%') c ON c.symbol = t.symbol GROUP BY 1, 2)
SELECT host, symbol, s[1] AS prefix, s[2] AS form, s[3] AS source_path FROM sc UNION ALL SELECT host, symbol, NULL, NULL, NULL FROM trim WHERE host NOT IN (SELECT host FROM sc)
""")
def _(v):
    shipped = v("host_modules").where("source_path LIKE 'drivers/%'").select("module", "source_path").distinct()
    return f.focused_trims(trims_of(v), shipped, TABLE, [("drivers/net", 10)]).select("host", "symbol", "score.prefix", "score.form", "score.source_path")


view("v_vendor_options", """
SELECT d.host, CASE st WHEN 'F' THEN 'CONFIG_INTEL_IDLE' WHEN 'P' THEN 'CONFIG_DRM_NOUVEAU' ELSE 'CONFIG_X86_AMD_PSTATE' END AS symbol, 'm' AS value FROM v_devices d GROUP BY 1, 2
UNION ALL SELECT d.host, CASE vendor_id WHEN '10de' THEN 'CONFIG_DRM_AMDGPU' WHEN '1002' THEN 'CONFIG_DRM_I915' ELSE 'CONFIG_GENERIC_CPU' END, 'y' FROM v_devices d GROUP BY 1, 2
""")
view("v_gpu_flags", "SELECT h.host, h.vendor_id, coalesce(bool_or(d.vendor_id = '10de' AND d.class_id LIKE '03%'), FALSE) AS has_nvidia, coalesce(bool_or(d.vendor_id = '1002' AND d.class_id LIKE '03%'), FALSE) AS has_amd_gpu, coalesce(bool_or(d.vendor_id = '8086' AND d.class_id LIKE '03%'), FALSE) AS has_intel_gpu FROM v_hosts h LEFT JOIN v_devices d ON d.host = h.host GROUP BY 1, 2")


@query("j12_vendor_proposals", """
SELECT o.host, o.symbol, o.value AS current_value, 'n' AS proposed_value, r[1] AS reason, CAST(r[2] AS DOUBLE) AS confidence FROM (SELECT o.*, CASE WHEN g.vendor_id = 'AuthenticAMD' AND symbol = 'CONFIG_INTEL_IDLE' THEN ['AMD CPU, Intel option', '0.99'] WHEN g.vendor_id = 'GenuineIntel' AND symbol = 'CONFIG_X86_AMD_PSTATE' THEN ['Intel CPU, AMD option', '0.99']
  WHEN NOT has_nvidia AND symbol LIKE '%NOUVEAU%' THEN ['no NVIDIA GPU', '0.95'] WHEN NOT has_amd_gpu AND symbol LIKE '%AMDGPU%' THEN ['no AMD GPU', '0.95'] WHEN NOT has_intel_gpu AND symbol LIKE '%DRM_I915%' THEN ['no Intel GPU', '0.9'] END AS r
  FROM v_vendor_options o JOIN v_gpu_flags g ON g.host = o.host) o WHERE r IS NOT NULL
""")
def _(v):
    return f.vendor_proposals(v("vendor_options"), v("gpu_flags"))


view("v_microarch", "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'GenuineIntel' ELSE 'AuthenticAMD' END AS vendor_id, CASE WHEN n_nationkey % 3 = 0 THEN 6 ELSE 15 + n_nationkey END AS cpu_family, n_regionkey * 10 AS model_min, n_regionkey * 10 + 25 AS model_max, n_nationkey AS rank, 'ARCH' || CAST(n_nationkey AS STRING) AS arch, 6 AS added_major, n_nationkey % 9 AS added_minor FROM nation")
ARCH = """
m AS (SELECT h.host, min((m.rank, m.arch, m.added_minor)) AS m FROM v_hosts h JOIN v_microarch m ON m.vendor_id = h.vendor_id AND m.cpu_family = h.cpu_family AND h.model BETWEEN m.model_min AND m.model_max GROUP BY 1),
a AS (SELECT h.host, CASE WHEN m.host IS NOT NULL THEN m.m[2] WHEN h.vendor_id = 'AuthenticAMD' AND h.cpu_family = 15 THEN 'K8' WHEN h.vendor_id = 'HygonGenuine' THEN 'ZEN' ELSE 'GENERIC' END AS arch, CAST(split_part(h.release, '.', 2) AS INT) AS minor, m.m[3] AS added FROM v_hosts h LEFT JOIN m ON m.host = h.host),
rec AS (SELECT host, arch, CASE WHEN arch = 'GENERIC' THEN NULL WHEN minor >= 16 THEN 'CONFIG_X86_NATIVE_CPU' WHEN minor < added THEN NULL ELSE 'CONFIG_M' || arch END AS symbol FROM a)
"""


@query("p18_microarch", f"WITH {ARCH} SELECT * FROM rec")
def _(v):
    return f.microarch(v("hosts"), v("microarch"))


@query("j12_microarch_swap", f"""
WITH {ARCH} SELECT r.host, 'CONFIG_GENERIC_CPU' AS symbol, 'y' AS current_value, 'n' AS proposed_value FROM rec r WHERE r.symbol IS NOT NULL AND EXISTS (SELECT 1 FROM v_vendor_options o WHERE o.host = r.host AND o.symbol = 'CONFIG_GENERIC_CPU')
UNION ALL SELECT host, symbol, 'n', 'y' FROM rec WHERE symbol IS NOT NULL
""")
def _(v):
    return f.microarch_proposals(f.microarch(v("hosts"), v("microarch")), v("vendor_options"))


view("v_workload_facts", """
SELECT h.host, h.sys_vendor, h.arch, h.chassis_type, CASE WHEN h.seg = 'MACHINERY' THEN 'PowerEdge R' ELSE h.seg END AS product_family, CAST(h.host % 40 AS INT) AS cores, h.balance > 9000 AS has_hypervisor, h.balance BETWEEN 100 AND 300 AS has_devicetree, h.balance BETWEEN 6000 AND 7000 AS has_battery, g.has_nvidia OR g.has_amd_gpu OR g.has_intel_gpu AS has_gpu
FROM v_hosts h JOIN v_gpu_flags g ON g.host = h.host
""")


def workloads(v):
    flags = F.when(F.col("cores") == 7, F.array(F.lit("hypervisor"))).otherwise(F.array(F.lit("fpu")))
    return f.workload(v("workload_facts").withColumn("flags", flags))


@query("p19_workload", """
WITH n AS (SELECT host, (sys_vendor = 'QEMU')::INT + has_hypervisor::INT + (cores = 7)::INT AS g, has_devicetree::INT + (arch = 'aarch64')::INT AS e, (chassis_type IN (8, 9, 10, 11, 14, 30, 31, 32))::INT + has_battery::INT AS l,
  (chassis_type IN (17, 23, 28, 29))::INT + (product_family LIKE 'PowerEdge%')::INT + (NOT has_gpu AND NOT has_battery AND cores >= 16)::INT AS s, chassis_type IN (3, 4, 5, 6, 7, 35) AS d FROM v_workload_facts)
SELECT host, CASE WHEN g > 0 THEN 'vm-guest' WHEN e > 0 THEN 'embedded' WHEN l > 0 THEN 'laptop' WHEN s > 0 THEN 'server' ELSE 'desktop' END AS profile,
  CAST(CASE WHEN g > 0 THEN CASE WHEN g >= 2 THEN 0.95 ELSE 0.75 END WHEN e > 0 THEN CASE WHEN e >= 2 THEN 0.75 ELSE 0.55 END WHEN l > 0 THEN CASE WHEN l >= 2 THEN 0.95 ELSE 0.8 END WHEN s > 0 THEN CASE WHEN s >= 2 THEN 0.9 ELSE 0.7 END WHEN d THEN 0.85 ELSE 0.55 END AS DOUBLE) AS confidence FROM n
""")
def _(v):
    return workloads(v).drop("reasons")


@query("p19_workload_reasons", """
SELECT host, coalesce(CASE WHEN g <> '' THEN g WHEN e <> '' THEN e WHEN l <> '' THEN l WHEN s <> '' THEN s ELSE d END, '') AS reasons FROM (SELECT host,
  concat_ws(', ', CASE WHEN cores = 7 THEN 'hypervisor flag' END, CASE WHEN sys_vendor = 'QEMU' THEN 'cloud vendor' END, CASE WHEN has_hypervisor THEN 'hypervisor platform' END) AS g,
  concat_ws(', ', CASE WHEN has_devicetree THEN 'device tree' END, CASE WHEN arch = 'aarch64' THEN 'architecture' END) AS e,
  concat_ws(', ', CASE WHEN chassis_type IN (8, 9, 10, 11, 14, 30, 31, 32) THEN 'laptop chassis' END, CASE WHEN has_battery THEN 'battery' END) AS l,
  concat_ws(', ', CASE WHEN chassis_type IN (17, 23, 28, 29) THEN 'server chassis' END, CASE WHEN product_family LIKE 'PowerEdge%' THEN 'product line' END, CASE WHEN NOT has_gpu AND NOT has_battery AND cores >= 16 THEN 'many cores without screen' END) AS s,
  CASE WHEN chassis_type IN (3, 4, 5, 6, 7, 35) THEN 'desktop chassis' END AS d FROM v_workload_facts)
""")
def _(v):
    return workloads(v).select("host", F.array_join("reasons", ", ").alias("reasons"))


view("v_audio_facts", """
SELECT h.host, count(d.dev) FILTER (WHERE d.size > 420000) AS cards, count(d.dev) FILTER (WHERE d.size > 435000) AS pcms, 0 AS nodes, count(d.dev) FILTER (WHERE d.class_id = '0403' AND d.size > 300000) AS pci_audio, count(d.dev) FILTER (WHERE d.size BETWEEN 100000 AND 130000) AS usb_audio,
  count(d.dev) FILTER (WHERE d.driver = 'drv5') AS modules, count(d.dev) FILTER (WHERE d.driver = 'drv7' AND d.st = 'F') AS userspace, coalesce(bool_or(d.driver = 'drv9'), FALSE) AS sof, h.chassis_type < 18 AS user_facing FROM v_hosts h LEFT JOIN v_devices d ON d.host = h.host GROUP BY h.host, h.chassis_type
""")


@query("p20_audio", """
SELECT host, CASE WHEN cards + pcms > 0 OR (pci_audio > 0 AND modules > 0) THEN CASE WHEN sof THEN 'internal-sof' ELSE 'internal' END WHEN pci_audio > 0 AND user_facing THEN 'internal' WHEN userspace > 0 AND (pci_audio > 0 OR usb_audio > 0 OR user_facing) THEN 'userspace'
  WHEN usb_audio > 0 AND user_facing THEN 'usb-hotplug' WHEN userspace > 0 THEN 'userspace' ELSE 'unused' END AS role,
 CAST(CASE WHEN cards + pcms > 0 THEN 0.98 WHEN pci_audio > 0 AND modules > 0 THEN 0.95 WHEN pci_audio > 0 AND user_facing THEN 0.9 WHEN userspace > 0 AND (pci_audio > 0 OR usb_audio > 0 OR user_facing) THEN 0.82 WHEN usb_audio > 0 AND user_facing THEN 0.75 WHEN userspace > 0 THEN 0.55 ELSE 0 END AS DOUBLE) AS confidence FROM v_audio_facts
""")
def _(v):
    return f.audio(v("audio_facts"))


view("v_nvidia_packages", "SELECT host, CASE WHEN st = 'F' THEN 'nvidia-dkms-' || CAST(500 + dev % 60 AS STRING) || CASE WHEN size > 250000 THEN '-open' ELSE '' END ELSE 'nvidia-driver-' || CASE WHEN size > 250000 THEN 'local' ELSE CAST(400 + dev % 60 AS STRING) END END AS name FROM v_devices WHERE st <> 'O' AND vendor_id = '10de'")
view("v_nvidia_dkms", "SELECT host, 'nvidia' AS name, CAST(600 + host % 9 AS STRING) || '.12' AS version FROM v_hosts WHERE seg = 'BUILDING'")


@query("p21_nvidia_branch", """
WITH p AS (SELECT *, nullif(regexp_extract(name, '-([0-9]+)(-open)?$', 1), '') AS b FROM v_nvidia_packages),
best AS (SELECT host, (min((CASE WHEN name LIKE 'nvidia-driver%' THEN 0 ELSE 1 END, name, b)))[3] AS b FROM p WHERE b IS NOT NULL GROUP BY 1),
j AS (SELECT coalesce(best.host, d.host) AS host, coalesce(best.b, split_part(d.version, '.', 1)) AS branch FROM best FULL JOIN v_nvidia_dkms d ON d.host = best.host)
SELECT j.host, j.branch, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.host = j.host AND p.name = 'nvidia-dkms-' || j.branch || '-open') THEN 'open' WHEN EXISTS (SELECT 1 FROM p WHERE p.host = j.host AND p.name IN ('nvidia-dkms-' || j.branch, 'nvidia-driver-' || j.branch)) THEN 'proprietary'
  WHEN EXISTS (SELECT 1 FROM p WHERE p.host = j.host AND p.name LIKE '%-open') THEN 'open' ELSE 'proprietary' END AS flavor FROM j
""")
def _(v):
    return f.nvidia_branch(v("nvidia_packages"), v("nvidia_dkms"))


FAMILIES = {"debian": "debian", "ubuntu": "debian", "fedora": "fedora", "rhel": "fedora", "arch": "arch", "opensuse": "suse"}
view("v_os_release", f"SELECT host, 'NAME=x' || {NL} || 'ID=' || CASE WHEN balance > 5000 THEN '\"Ubuntu\"' WHEN balance > 2000 THEN 'rocky' ELSE 'odd' END || {NL} || 'ID_LIKE=' || CASE WHEN balance > 3000 THEN '\"centos rhel debian\"' ELSE 'none' END AS text, balance FROM v_hosts")


@query("p22_distro_family", "SELECT host, CASE WHEN balance > 5000 THEN 'debian' WHEN balance > 3000 THEN 'fedora' ELSE 'unknown' END AS family FROM v_os_release")
def _(v):
    rows = h.key_values(v("os_release").select("host", "text"), ["ID", "ID_LIKE"], "=")
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^[\"'](.*)[\"']$", "$1")
    return rows.select("host", f.distro_family(bare(F.col("ID")), bare(F.col("ID_LIKE")), FAMILIES).alias("family"))


view("v_boot_flags", "SELECT h.host, h.seg = 'BUILDING' AS luks, h.balance > 5000 AS lvm, coalesce(bool_or(d.st = 'F' AND d.size > 440000), FALSE) AS raid, CASE WHEN h.arch = 'aarch64' THEN 'btrfs' WHEN h.balance < 0 THEN 'ntfs' ELSE 'ext4' END AS root_fstype FROM v_hosts h LEFT JOIN v_devices d ON d.host = h.host GROUP BY h.host, h.seg, h.balance, h.arch")
FEATURES = "(VALUES ('LUKS', 'dm_crypt'), ('LUKS', 'aes_generic'), ('LUKS', 'aes_x86_64'), ('LUKS', 'xts'), ('LUKS', 'sha256'), ('LVM', 'dm_mod'), ('RAID', 'raid0'), ('RAID', 'raid1'), ('RAID', 'raid10'), ('RAID', 'raid456'), ('RAID', 'md_mod'), ('ext4', 'ext4'), ('btrfs', 'btrfs'), ('btrfs', 'crc32c'), ('btrfs', 'xxhash')) t(f, module)"


@query("j30_boot_modules", f"""
SELECT b.host, t.module, CASE WHEN f IN ('ext4', 'btrfs') THEN 'root fstype = ' || f ELSE f END AS reason FROM v_boot_flags b JOIN {FEATURES} ON (f = 'LUKS' AND luks) OR (f = 'LVM' AND lvm) OR (f = 'RAID' AND raid) OR f = root_fstype
UNION ALL SELECT host, 'nvidia', 'DKMS: nvidia/' || version FROM v_nvidia_dkms
""")
def _(v):
    return f.boot_modules(v("boot_flags"), v("nvidia_dkms"))


@query("j31_late_modules", """
SELECT DISTINCT host, module FROM (SELECT host, module FROM v_device_modules UNION SELECT b.host, t.m FROM v_boot_flags b JOIN (VALUES ('w', 'nf_tables'), ('w', 'xt_mark'), ('a', 'snd_hda'), ('a', 'mod-7')) t(k, m) ON (k = 'w' AND lvm) OR (k = 'a' AND raid)) x
WHERE NOT EXISTS (SELECT 1 FROM v_device_modules d WHERE d.host = x.host AND d.module = x.module AND d.line_no = 1)
""")
def _(v):
    extras = {"lvm": ["nf_tables", "xt_mark"], "raid": ["snd_hda", "mod-7"]}
    return f.late_modules(v("device_modules"), v("boot_flags"), extras, v("device_modules").where("line_no = 1"))


view("v_required_packages", "SELECT p_type || CASE WHEN p_size > 45 THEN '' ELSE ' optional' END AS family, p_name AS package, p_partkey AS position FROM part")
view("v_family_hosts", "SELECT c_custkey AS host, CASE WHEN c_nationkey < 12 THEN 'ECONOMY' ELSE 'PROMO' END AS family FROM customer")
view("v_installed", "SELECT o.o_custkey AS host, p.p_name AS package FROM v_lines l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey")


@query("j39_package_gap", """
SELECT h.host, r.package, r.position, EXISTS (SELECT 1 FROM v_installed i WHERE i.host = h.host AND i.package = r.package) AS installed FROM v_family_hosts h JOIN (SELECT family, package, min(position) AS position FROM v_required_packages GROUP BY 1, 2) r ON r.family = h.family
""")
def _(v):
    return f.package_gap(v("family_hosts"), v("required_packages"), v("installed"))


view("v_ready_facts", """
SELECT host, CASE WHEN balance < 0 THEN NULL ELSE balance / 400 END AS free_disk_gib, CASE WHEN chassis_type = 3 THEN NULL ELSE chassis_type / 8.0 END AS memory_gib, CASE WHEN model = 0 THEN NULL ELSE cores END AS cores, CASE WHEN seg = 'BUILDING' THEN NULL ELSE balance > 1000 END AS boot_tested,
  CASE WHEN model < 30 THEN 'qemu' ELSE 'virtme' END AS boot_method, seg <> 'MACHINERY' AS has_config, CASE WHEN model > 50 THEN 1 ELSE 0 END AS dkms FROM v_hosts
""")
READY = """
chk AS (SELECT host, 'disk' AS "check", CASE WHEN free_disk_gib IS NULL THEN 'warn' WHEN free_disk_gib < 5 THEN 'fail' WHEN free_disk_gib < 20 THEN 'warn' ELSE 'pass' END AS severity FROM v_ready_facts
 UNION ALL SELECT host, 'memory', CASE WHEN memory_gib IS NULL THEN 'skip' WHEN memory_gib < 2 THEN 'fail' WHEN memory_gib < 4 THEN 'warn' ELSE 'pass' END FROM v_ready_facts
 UNION ALL SELECT host, 'cores', CASE WHEN cores > 0 THEN 'pass' ELSE 'warn' END FROM v_ready_facts UNION ALL SELECT host, 'boot_test', CASE WHEN boot_tested IS NULL THEN 'warn' WHEN NOT boot_tested THEN 'fail' WHEN boot_method = 'qemu' THEN 'warn' ELSE 'pass' END FROM v_ready_facts
 UNION ALL SELECT host, 'config', CASE WHEN has_config THEN 'pass' ELSE 'fail' END FROM v_ready_facts UNION ALL SELECT host, 'dkms', CASE WHEN dkms > 0 THEN 'warn' ELSE 'pass' END FROM v_ready_facts)
"""


@query("j40_readiness", f"WITH {READY} SELECT * FROM chk")
def _(v):
    return f.readiness(v("ready_facts"))


@query("j40_readiness_summary", f"""
WITH {READY} SELECT host, count(*) FILTER (severity = 'pass') AS pass, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'fail') AS fail, count(*) FILTER (severity = 'skip') AS skip, bool_or(severity = 'fail') AS blocked FROM chk GROUP BY 1
""")
def _(v):
    return f.readiness_summary(f.readiness(v("ready_facts")))
