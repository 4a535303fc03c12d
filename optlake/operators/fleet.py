"""From host evidence to required options and change proposals, all hosts in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optlake.functions.globs import literal_head, shell_regex
from optlake.operators.rules import first_match
from optlake.operators.salting import dealt
from optlake.session import cut_lineage
from optlake.sources.modules import upper_name

# pattern heads are compared at these lengths; longer steps mean smaller join groups
HEAD_LENGTHS = (0, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 40)


def _fixed_fields(plain: Column) -> Column:
    """The two longest fields that every id fitting a pattern has after its literal head;
    ``plain`` is the pattern with a star for each class.

    A field is a lower-case letter and all that follows up to the next one. Where a plain
    stretch of a pattern holds a field and what ends it, the id holds the same field,
    whatever the wildcards around it stand for.
    """
    rest = F.substring(plain, F.length(F.regexp_extract(plain, "^[^*?]*", 0)) + 1, F.length(plain))
    fields = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"[a-z][^a-z*?]+(?=[a-z]|\z)"), 0))
    longest = F.slice(F.array_sort(F.transform(fields, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), 1, 2)
    return F.array_sort(F.transform(longest, lambda s: s["x"]))


def _with_letter(fields: Column, letter: Column) -> Column:
    return F.filter(fields, lambda x: x.startswith(letter))


def _alias_sides(ids: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ids (raw, bus)`` and ``patterns (bus, pattern)`` with a join ``key`` that is equal
    wherever a pattern fits: bus, literal head and fixed fields. The length of the head and
    the letters of the fields are the pattern's mask; an id gets a key for each mask of its
    bus, of which there are few."""
    cut = F.array_max(F.filter(F.array(*[F.lit(n) for n in HEAD_LENGTHS]), lambda n: n <= F.length(literal_head(F.col("pattern")))))
    plain = F.regexp_replace("pattern", r"\[[^\]]+\]", "*")
    rows = patterns.select("bus", "pattern", cut.alias("cut"), _fixed_fields(plain).alias("values"))
    letters = F.array_join(F.transform("values", lambda x: F.substring(x, 1, 1)), "")
    rows = rows.select("bus", "pattern", "cut", letters.alias("letters"), F.substring("pattern", F.lit(1), F.col("cut")).alias("head"), F.array_join("values", "|").alias("values"))
    masks = cut_lineage(rows.groupBy("bus").agg(F.collect_set(F.struct("cut", "letters")).alias("masks")))
    keyed = ids.withColumn("fields", F.array_distinct(F.regexp_extract_all("raw", F.lit("[a-z][^a-z]+"), 0)))
    keyed = keyed.join(masks, "bus").select("raw", "bus", "fields", F.inline("masks")).where(F.length("raw") >= F.col("cut"))
    first, second = _with_letter(F.col("fields"), F.substring("letters", 1, 1)), _with_letter(F.col("fields"), F.substring("letters", 2, 1))
    pairs = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.concat(x, F.lit("|"), y))))
    values = F.when(F.length("letters") == 0, F.array(F.lit(""))).when(F.length("letters") == 1, first).otherwise(pairs)
    keyed = keyed.select("raw", "bus", "cut", "letters", F.substring("raw", F.lit(1), F.col("cut")).alias("head"), F.explode(values).alias("values"))
    key = F.concat_ws("\n", "bus", "cut", "letters", "head", "values").alias("key")
    return keyed.select("raw", key), rows.select("pattern", key)


def match_aliases(devices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct ``(raw, module)`` matches of device ids against shell patterns.

    Ids and patterns join on the bus, the literal head cut to one of a few lengths, and the
    values of up to two fields that the pattern fixes further on; only those pairs are
    tested. Keys that many ids have in common are split. Equal ids are matched once, and a
    pattern is tested once, however many modules share it.
    """
    ids = devices.select("raw", F.substring_index("raw", ":", 1).alias("bus")).distinct()
    left, right = _alias_sides(ids, aliases.select("bus", "pattern").distinct())
    # plain text that must occur is looked for before the expression is run
    longest = F.aggregate(F.split("pattern", r"\*|\?|\[[^\]]+\]"), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    right = right.select("pattern", "key", F.regexp_extract("pattern", r"[^*?\[\]]*$", 0).alias("tail"), longest.alias("piece"), shell_regex(F.col("pattern")).alias("regex"))
    left, right = dealt(left, right, "key", "raw")
    hits = left.join(right, ["key", "part"]).where(F.expr("endswith(raw, tail) AND contains(raw, piece) AND raw RLIKE regex")).select("raw", "pattern")
    return hits.join(aliases.select("pattern", "module").distinct(), "pattern").select("raw", "module").distinct()


def unresolved_aliases(devices: DataFrame, matches: DataFrame) -> DataFrame:
    return devices.join(matches.select("raw").distinct(), "raw", "left_anti")


def candidate_options(module: Column, source_path: Column, table: list[tuple[str, list[str]]]) -> Column:
    """Ordered candidate options of a module: templates of the first path prefix that
    fits, then forms of the bare name. ``{name}`` and ``{fsdir}`` are filled in."""
    name = upper_name(module)
    parts = F.split(source_path, "/")
    fsdir = F.when((F.size(parts) >= 2) & (parts[0] == "fs"), upper_name(parts[1])).otherwise("")
    path = F.concat(F.coalesce(source_path, F.lit("")), F.lit("/"))
    none = F.array().cast("array<string>")
    chosen = none
    for prefix, templates in reversed(table):
        chosen = F.when(path.startswith(prefix), F.array(*[F.lit(t) for t in templates])).otherwise(chosen)
    chosen = F.when(source_path.isNull() | (source_path == ""), none).otherwise(chosen)
    filled = F.transform(chosen, lambda t: F.replace(F.replace(t, F.lit("{name}"), name), F.lit("{fsdir}"), fsdir))
    bare = F.array_compact(F.array(
        name, F.when(module.endswith("fs"), F.concat(name, F.lit("_FS"))), F.when(module.endswith("_mod"), F.regexp_replace(name, "_MOD$", ""))))
    return F.array_distinct(F.transform(F.concat(filled, bare), lambda s: F.concat(F.lit("CONFIG_"), s)))


def module_options(modules: DataFrame, values: DataFrame, table: list[tuple[str, list[str]]]) -> DataFrame:
    """First candidate option that is on, per ``(host, module, source_path)``; null when
    none is."""
    asked = modules.select("host", "module", F.coalesce("source_path", F.lit("")).alias("source_path")).distinct()
    names = asked.select("module", "source_path").distinct()
    candidates = names.select("module", "source_path", F.posexplode(candidate_options(F.col("module"), F.col("source_path"), table)).alias("pos", "symbol"))
    on = values.where("value IN ('y', 'm')").select("host", "symbol")
    key = ["host", "module", "source_path"]
    hit = asked.join(candidates, ["module", "source_path"]).join(on, ["host", "symbol"]).groupBy(*key).agg(F.min_by("symbol", "pos").alias("symbol"))
    return asked.join(hit, key, "left")


def keep_set(evidence: list[tuple[str, DataFrame]], blacklist: DataFrame) -> DataFrame:
    """Required modules with their evidence: union of sources minus modules the boot line
    blacklists."""
    rows = [df.select("host", "module", F.lit(label).alias("why")) for label, df in evidence]
    counted = reduce(DataFrame.unionByName, rows).groupBy("host", "module", "why").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.join(blacklist.select("host", F.translate("module", "-", "_").alias("module")).distinct(), ["host", "module"], "left_anti")
    return kept.groupBy("host", "module").agg(F.sum("n").alias("evidence"), F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("why"))


def candidate_trims(values: DataFrame, required: DataFrame) -> DataFrame:
    """Options that are on and not required."""
    return values.where("value IN ('y', 'm')").select("host", "symbol", "value").join(required.select("host", "symbol").distinct(), ["host", "symbol"], "left_anti")


def focused_trims(trims: DataFrame, shipped: DataFrame, table: list[tuple[str, list[str]]], scores: list[tuple[str, int]]) -> DataFrame:
    """Trims that belong to shipped modules, best score per option, in review order.

    A host without any falls back to all its trims. Scores prefer optional path classes,
    then modules over built-ins, then the path.
    """
    prefix = first_match([(F.col("source_path").startswith(p), s) for p, s in scores], 100)
    options = shipped.select("source_path", F.explode(candidate_options(F.col("module"), F.col("source_path"), table)).alias("symbol"), prefix.alias("prefix")).distinct()
    score = F.struct("prefix", F.when(F.col("value") == "m", 0).otherwise(25).alias("form"), "source_path")
    hit = trims.join(options, "symbol").groupBy("host", "symbol").agg(F.min(score).alias("score"))
    hosts = hit.select("host").distinct()
    rest = trims.join(hosts, "host", "left_anti").select("host", "symbol", F.lit(None).cast(hit.schema["score"].dataType).alias("score"))
    return hit.unionByName(rest)


def vendor_proposals(candidates: DataFrame, hosts: DataFrame) -> DataFrame:
    """Certain trims: options of another CPU vendor or of graphics the host lacks.
    ``hosts`` carry ``vendor_id, has_nvidia, has_amd_gpu, has_intel_gpu``."""
    s, cpu = F.upper("symbol"), F.col("vendor_id")
    # fixed values: vendor option names and the confidence of each rule
    cases = [
        ((cpu == "AuthenticAMD") & (s.contains("INTEL_IDLE") | s.startswith("CONFIG_X86_INTEL_") | s.contains("INTEL_RAPL")), "AMD CPU, Intel option", 0.99),
        ((cpu == "GenuineIntel") & (s.startswith("CONFIG_X86_AMD_") | s.contains("AMD_PSTATE")), "Intel CPU, AMD option", 0.99),
        (~F.col("has_nvidia") & (s.contains("NOUVEAU") | s.contains("NVIDIA")), "no NVIDIA GPU", 0.95),
        (~F.col("has_amd_gpu") & (s.contains("AMDGPU") | s.startswith("CONFIG_DRM_RADEON")), "no AMD GPU", 0.95),
        (~F.col("has_intel_gpu") & s.contains("DRM_I915"), "no Intel GPU", 0.9),
    ]
    joined = candidates.join(hosts, "host")
    return joined.select(
        "host", "symbol", F.col("value").alias("current_value"), F.lit("n").alias("proposed_value"),
        first_match([(c, r) for c, r, _ in cases], None).alias("reason"), first_match([(c, x) for c, _, x in cases], None).cast("double").alias("confidence"),
    ).where("reason IS NOT NULL")


def microarch(hosts: DataFrame, table: DataFrame) -> DataFrame:
    """CPU generation of each host and the option a kernel has for it.

    ``table`` rows are ``(vendor_id, cpu_family, model_min, model_max, rank, arch,
    added_major, added_minor)``. From 6.16 on one option serves every known CPU.
    """
    hit = (
        hosts.select("host", "vendor_id", "cpu_family", "model").join(table, ["vendor_id", "cpu_family"])
        .where("model BETWEEN model_min AND model_max")
        .groupBy("host").agg(F.min(F.struct("rank", "arch", "added_major", "added_minor")).alias("m"))
    )
    found = hosts.join(hit, "host", "left")
    arch = (
        F.when(F.col("m").isNotNull(), F.col("m.arch"))
        .when((F.col("vendor_id") == "AuthenticAMD") & (F.col("cpu_family") == 15) & F.col("model").isNotNull(), "K8")
        .when(F.col("vendor_id") == "HygonGenuine", "ZEN").otherwise("GENERIC")
    )
    head = F.split(F.substring_index("release", "-", 1), r"\.")
    version = F.struct(F.try_element_at(head, F.lit(1)).try_cast("int").alias("a"), F.try_element_at(head, F.lit(2)).try_cast("int").alias("b"))
    known = version["a"].isNotNull() & version["b"].isNotNull()
    at_least = lambda a, b: (version["a"] > a) | ((version["a"] == a) & (version["b"] >= b))
    modern = F.coalesce(known & at_least(F.lit(6), F.lit(16)), F.lit(False))
    too_old = known & F.col("m.added_major").isNotNull() & ~at_least(F.col("m.added_major"), F.col("m.added_minor"))
    return found.select("host", arch.alias("arch"), modern.alias("modern"), F.coalesce(too_old, F.lit(False)).alias("too_old")).select(
        "host", "arch",
        F.when(F.col("arch") == "GENERIC", None).when(F.col("modern"), "CONFIG_X86_NATIVE_CPU").when(F.col("too_old"), None).otherwise(F.concat(F.lit("CONFIG_M"), "arch")).alias("symbol"),
    )


def microarch_proposals(recommended: DataFrame, values: DataFrame) -> DataFrame:
    """Swap pair: generic CPU off, the host's own on."""
    generic = recommended.where("symbol IS NOT NULL").select("host").join(values.where("symbol = 'CONFIG_GENERIC_CPU' AND value = 'y'").select("host"), "host", "left_semi").select(
        "host", F.lit("CONFIG_GENERIC_CPU").alias("symbol"), F.lit("y").alias("current_value"), F.lit("n").alias("proposed_value"))
    tuned = recommended.where("symbol IS NOT NULL").select("host", "symbol").join(values.select("host", "symbol", "value"), ["host", "symbol"], "left").where("value IS NULL OR value <> 'y'").select(
        "host", "symbol", F.coalesce("value", F.lit("n")).alias("current_value"), F.lit("y").alias("proposed_value"))
    return generic.unionByName(tuned)


def workload(hosts: DataFrame) -> DataFrame:
    """Profile of each host, first of VM guest, embedded, laptop, server, desktop, with
    the signs that speak for it: the more of them, the surer."""
    chassis = F.col("chassis_type")
    # fixed values: vendor words, chassis classes and server lines
    cloud = r"qemu|amazon ec2|google|microsoft corporation|innotek gmbh|vmware, inc\.|xen|openstack foundation|bochs|red hat"
    laptops, servers, desktops = (8, 9, 10, 11, 14, 30, 31, 32), (17, 23, 28, 29), (3, 4, 5, 6, 7, 35)
    lines = "poweredge|proliant|ucs|thinksystem|primergy|primepower"
    yes = lambda c: F.coalesce(c, F.lit(False))
    signs = lambda **named: F.array_compact(F.array(*[F.when(yes(c), k.replace("_", " ")) for k, c in named.items()]))
    guest_signs = signs(hypervisor_flag=F.array_contains("flags", "hypervisor"), cloud_vendor=F.lower("sys_vendor").rlike(cloud), hypervisor_platform=F.col("has_hypervisor"))
    embedded_signs = signs(device_tree=F.col("has_devicetree"), architecture=F.lower("arch").rlike("^(arm|aarch|risc|mips)"))
    laptop_signs = signs(laptop_chassis=chassis.isin(*laptops), battery=F.col("has_battery"))
    server_signs = signs(server_chassis=chassis.isin(*servers), product_line=F.lower("product_family").rlike(lines), many_cores_without_screen=~F.col("has_gpu") & ~F.col("has_battery") & (F.col("cores") >= 16))
    guest, embedded, laptop, server = (F.size(x) for x in (guest_signs, embedded_signs, laptop_signs, server_signs))
    profile = first_match([(guest > 0, "vm-guest"), (embedded > 0, "embedded"), (laptop > 0, "laptop"), (server > 0, "server")], "desktop")
    confidence = (
        F.when(guest > 0, F.when(guest >= 2, 0.95).otherwise(0.75)).when(embedded > 0, F.when(embedded >= 2, 0.75).otherwise(0.55))
        .when(laptop > 0, F.when(laptop >= 2, 0.95).otherwise(0.80)).when(server > 0, F.when(server >= 2, 0.90).otherwise(0.70))
        .otherwise(F.when(yes(chassis.isin(*desktops)), 0.85).otherwise(0.55))
    )
    reasons = (
        F.when(guest > 0, guest_signs).when(embedded > 0, embedded_signs).when(laptop > 0, laptop_signs).when(server > 0, server_signs)
        .otherwise(signs(desktop_chassis=chassis.isin(*desktops)))
    )
    return hosts.select("host", profile.alias("profile"), confidence.alias("confidence"), reasons.alias("reasons"))


def audio(facts: DataFrame) -> DataFrame:
    """Is sound useful on a host? ``facts`` carry counts ``cards, pcms, nodes, pci_audio,
    usb_audio, modules, userspace`` and flags ``sof, user_facing``."""
    any_ = lambda c: F.col(c) > 0
    device = any_("cards") | any_("pcms") | any_("nodes")
    internal = F.when(F.col("sof"), "internal-sof").otherwise("internal")
    cases = [
        (device, internal, 0.98), (any_("pci_audio") & any_("modules"), internal, 0.95), (any_("pci_audio") & F.col("user_facing"), F.lit("internal"), 0.90),
        (any_("userspace") & (any_("pci_audio") | any_("usb_audio") | F.col("user_facing")), F.lit("userspace"), 0.82),
        (any_("usb_audio") & F.col("user_facing"), F.lit("usb-hotplug"), 0.75), (any_("userspace"), F.lit("userspace"), 0.55),
    ]
    return facts.select("host", first_match([(c, r) for c, r, _ in cases], "unused").alias("role"), first_match([(c, x) for c, _, x in cases], 0.0).alias("confidence"))


def nvidia_branch(packages: DataFrame, dkms: DataFrame) -> DataFrame:
    """Driver branch and flavor per host: from package names in order of kind and name,
    else from the DKMS version."""
    # fixed values: package names that carry a branch
    kinds = ("nvidia-driver-", "nvidia-dkms-", "nvidia-utils-", "nvidia-kernel-source-", "linux-modules-nvidia-", "linux-objects-nvidia-", "libnvidia-")
    name = F.col("name")
    # the branch is the first part that is a number, after the known name
    number = F.filter(F.split("name", "-"), lambda x: x.try_cast("int").isNotNull())
    rank = first_match([(name.startswith("nvidia-driver-"), 0), (name.startswith("nvidia-dkms-"), 1), (name.startswith("nvidia-utils-"), 2)], 3)
    known = reduce(lambda x, y: x | y, [name.startswith(k) for k in kinds])
    rows = packages.withColumn("branch", F.when(known, F.get(number, F.lit(0))))
    best = rows.where("branch IS NOT NULL").groupBy("host").agg(F.min_by("branch", F.struct(rank.alias("r"), "name")).alias("branch"))
    # only the few driver packages of a host
    opened = rows.where(known).groupBy("host").agg(F.collect_set("name").alias("names"))
    built = dkms.where("name = 'nvidia'").groupBy("host").agg(F.substring_index(F.min("version"), ".", 1).try_cast("int").cast("string").alias("dkms_branch"))
    has = lambda *parts: F.array_contains("names", F.concat(*[F.lit(p) if p != "branch" else F.col("branch") for p in parts]))
    is_open = lambda n: (n.startswith("nvidia-driver-") & n.endswith("-open")) | (n.startswith("nvidia-dkms-") & n.endswith("-open")) | (n.startswith("linux-modules-nvidia-") & n.contains("-open-"))
    flavor = (
        F.when(has("nvidia-driver-", "branch", "-open") | has("nvidia-dkms-", "branch", "-open"), "open")
        .when(has("nvidia-driver-", "branch") | has("nvidia-dkms-", "branch"), "proprietary")
        .when(F.exists("names", is_open), "open").otherwise("proprietary")
    )
    return best.join(built, "host", "full").join(opened, "host", "left").withColumn("branch", F.coalesce("branch", "dkms_branch")).where("branch IS NOT NULL").select("host", "branch", F.coalesce(flavor, F.lit("proprietary")).alias("flavor"))


def distro_family(os_id: Column, id_like: Column, families: dict[str, str]) -> Column:
    """Family of a distribution id, else of its first known ancestor."""
    table = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    likes = F.filter(F.transform(F.split(F.lower(F.trim(id_like)), r"\s+"), lambda t: table[t]), lambda f: f.isNotNull())
    return F.coalesce(table[F.lower(F.trim(os_id))], F.try_element_at(likes, F.lit(1)), F.lit("unknown"))


# fixed values: modules an early boot needs, per feature and root file system
BOOT_MODULES = {"luks": ["dm_crypt", "aes_generic", "aes_x86_64", "xts", "sha256"], "lvm": ["dm_mod"], "raid": ["raid0", "raid1", "raid10", "raid456", "md_mod"]}
FS_MODULES = {"ext4": ["ext4"], "btrfs": ["btrfs", "crc32c", "xxhash"], "xfs": ["xfs"], "f2fs": ["f2fs"], "zfs": ["zfs"]}


def boot_modules(hosts: DataFrame, dkms: DataFrame) -> DataFrame:
    """Modules each host needs before its root is mounted, with the first reason. Hosts
    carry flags ``luks, lvm, raid`` and ``root_fstype``."""
    entry = lambda m, why, rank: F.struct(F.lit(m).alias("module"), why.alias("reason"), F.lit(rank).alias("rank"))
    parts = [F.when(F.col(f), F.array(*[entry(m, F.lit(f.upper()), i) for m in ms])) for i, (f, ms) in enumerate(BOOT_MODULES.items())]
    parts += [F.when(F.col("root_fstype") == fs, F.array(*[entry(m, F.concat(F.lit("root fstype = "), "root_fstype"), 3) for m in ms])) for fs, ms in FS_MODULES.items()]
    rows = hosts.select("host", F.inline(F.flatten(F.array_compact(F.array(*parts)))))
    extra = dkms.select("host", F.col("name").alias("module"), F.concat(F.lit("DKMS: "), "name", F.lit("/"), "version").alias("reason"), F.lit(4).alias("rank"))
    return rows.unionByName(extra).groupBy("host", "module").agg(F.min_by("reason", F.struct("rank", "reason")).alias("reason"))


def late_modules(hardware: DataFrame, triggers: DataFrame, extras: dict[str, list[str]], loaded: DataFrame) -> DataFrame:
    """Hardware modules plus the fixed lists a host's flags ask for, minus loaded ones."""
    lists = [F.when(F.col(flag), F.array(*[F.lit(m) for m in ms])) for flag, ms in extras.items()]
    late = triggers.select("host", F.explode(F.flatten(F.array_compact(F.array(*lists)))).alias("module"))
    return hardware.select("host", "module").unionByName(late).distinct().join(loaded.select("host", "module").distinct(), ["host", "module"], "left_anti")


def package_gap(hosts: DataFrame, required: DataFrame, installed: DataFrame) -> DataFrame:
    """Packages each host's family needs, installed or missing."""
    first = required.groupBy("family", "package").agg(F.min("position").alias("position"))
    have = installed.select("host", "package").distinct().withColumn("here", F.lit(True))
    return hosts.select("host", "family").join(first, "family").join(have, ["host", "package"], "left").select(
        "host", "package", "position", F.coalesce("here", F.lit(False)).alias("installed"))


def readiness(facts: DataFrame) -> DataFrame:
    """Checks over collected host facts as ``(host, check, severity)``. Facts:
    ``free_disk_gib, memory_gib, cores, boot_tested, boot_method, has_config, dkms``."""
    disk, memory, cores = F.col("free_disk_gib"), F.col("memory_gib"), F.col("cores")
    # fixed values: limits of the checks
    checks = {
        "disk": F.when(disk.isNull(), "warn").when(disk < 5, "fail").when(disk < 20, "warn").otherwise("pass"),
        "memory": F.when(memory.isNull(), "skip").when(memory < 2, "fail").when(memory < 4, "warn").otherwise("pass"),
        "cores": F.when(F.coalesce(cores, F.lit(0)) > 0, "pass").otherwise("warn"),
        "boot_test": F.when(F.col("boot_tested").isNull(), "warn").when(~F.col("boot_tested"), "fail").when(F.col("boot_method") == "qemu", "warn").otherwise("pass"),
        "config": F.when(F.col("has_config"), "pass").otherwise("fail"),
        "dkms": F.when(F.col("dkms") > 0, "warn").otherwise("pass"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), c.alias("severity")) for k, c in checks.items()])
    return facts.select("host", F.inline(rows))


def readiness_summary(checks: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return checks.groupBy("host").agg(n("pass").alias("pass"), n("warn").alias("warn"), n("fail").alias("fail"), n("skip").alias("skip"), F.bool_or(F.col("severity") == "fail").alias("blocked"))
