"""Package builds: versions, dependencies, flags, overrides, records and cost."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optlake.functions.versions import debian_key
from optlake.operators.rules import first_match


def highest_version(stanzas: DataFrame) -> DataFrame:
    """The stanza with the highest version per source; the first one on ties."""
    rank = F.struct(debian_key(F.col("version")).alias("key"), (-F.col("position")).alias("first"))
    cols = [c for c in stanzas.columns if c != "source"]
    return stanzas.groupBy("source").agg(F.max_by(F.struct(*cols), rank).alias("s")).select("source", "s.*")


def binary_sources(installed: DataFrame, sources: DataFrame) -> DataFrame:
    """Source of each installed binary: the index first, then what the host recorded;
    ``known`` is false for sources without an index entry."""
    index = sources.select("source", F.explode("binaries").alias("binary")).groupBy("binary").agg(F.max("source").alias("indexed"))
    mapped = installed.join(index, "binary", "left").withColumn("source", F.coalesce("indexed", "source")).drop("indexed")
    return mapped.join(sources.select("source").distinct().withColumn("known", F.lit(True)), "source", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def closure_edges(sources: DataFrame, inside: DataFrame) -> DataFrame:
    """Build dependencies between sources of the set: ``(src, dst)``, dst first."""
    index = sources.select(F.col("source").alias("dst"), F.explode("binaries").alias("binary"))
    wants = sources.select(F.col("source").alias("src"), F.explode("build_depends").alias("binary"))
    keep = inside.select("source").distinct()
    return (
        wants.join(index, "binary").where("src <> dst").select("src", "dst").distinct()
        .join(keep.withColumnRenamed("source", "src"), "src", "left_semi")
        .join(keep.withColumnRenamed("source", "dst"), "dst", "left_semi")
        .select("src", "dst")
    )


# fixed values: source name prefixes of expensive builds, and CPU hours per class
MONSTER = ("llvm", "gcc-", "webkit2gtk", "chromium", "libreoffice", "rustc", "firefox")
NOT_KERNEL = ("firmware", "meta", "base", "signed")
HEAVY = ("glibc", "systemd", "perl", "python3.", "openssl", "binutils", "gnutls28", "cmake", "nodejs", "openjdk-", "qt6-base", "mesa")
CPU_HOURS = {"tiny": 0.04, "normal": 0.12, "heavy": 1.0, "monster": 6.0}


def cost_class(source: Column, installed_kb: Column) -> Column:
    any_prefix = lambda names: source.rlike("^(" + "|".join(n.replace(".", r"\.") for n in names) + ")")
    kernel = (source == "linux") | (source.startswith("linux-") & ~source.rlike("|".join(NOT_KERNEL)))
    return first_match([(kernel | any_prefix(MONSTER), "monster"), (any_prefix(HEAVY), "heavy"), ((installed_kb > 0) & (installed_kb < 300), "tiny")], "normal")


def cpu_hours(cost: Column) -> Column:
    return first_match([(cost == k, h) for k, h in CPU_HOURS.items()], 0.0)


def plan_statistics(units: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of planned units ``(source, binaries, wave, cost, use_stock)``."""
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_sources"), F.count_if(~F.col("use_stock")).alias("rebuild_sources"), F.count_if("use_stock").alias("stock_sources"),
        F.sum("binaries").alias("total_binaries"), (F.max("wave") + 1).alias("waves"),
        F.round(F.sum(F.when(F.col("use_stock"), 0.0).otherwise(cpu_hours(F.col("cost")))), 2).alias("cpu_hours"), F.count_if(F.col("cost") == "monster").alias("monsters"),
    )


def pending_builds(units: DataFrame, records: DataFrame) -> DataFrame:
    """State of each unit: stock, done (an ok record with these flags) or pending."""
    done = records.where("outcome = 'ok'").select("source", "version", "flags_hash").distinct().withColumn("done", F.lit(True))
    state = F.when(F.col("use_stock"), "stock").when(F.col("done"), "done").otherwise("pending")
    return units.join(done, ["source", "version", "flags_hash"], "left").withColumn("state", state).drop("done")


def first_override(sources: DataFrame, exceptions: DataFrame, presets: DataFrame) -> DataFrame:
    """Override of each source: confirmed exceptions before presets before the toolchain
    gate, the first entry of each."""
    # fixed values: toolchain sources kept stock
    gate = sources.where("source IN ('glibc', 'binutils') OR source LIKE 'gcc-%'").select("source", F.lit(2).alias("tier"), F.lit(0).cast("long").alias("position"), F.lit(True).alias("use_stock"), F.lit("toolchain gate").alias("reason"))
    tier = lambda df, n: df.select("source", F.lit(n).alias("tier"), F.col("position").cast("long").alias("position"), "use_stock", "reason")
    rows = tier(exceptions, 0).unionByName(tier(presets, 1)).unionByName(gate)
    first = rows.groupBy("source").agg(F.min_by(F.struct("use_stock", "reason"), F.struct("tier", "position")).alias("o"))
    return sources.join(first, "source", "left").select("source", F.coalesce("o.use_stock", F.lit(False)).alias("use_stock"), "o.reason")


def package_evidence(installed: DataFrame) -> DataFrame:
    """Per source: installed size, binaries, and the first six names. Names are ranked by
    partial minima, six per task at most."""
    top = F.slice(F.array_sort(F.collect_set("binary")), 1, 6)
    part = installed.groupBy("source", F.pmod(F.xxhash64("binary"), F.lit(64)).alias("part")).agg(top.alias("some"), F.sum("installed_kb").alias("kb"), F.countDistinct("binary").alias("n"))
    return part.groupBy("source").agg(F.sum("n").alias("binaries"), F.sum("kb").alias("installed_kb"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))), 1, 6).alias("first_six"))


def merge_overrides(drafts: DataFrame) -> DataFrame:
    """Fold the overrides of each source in order: lists are unioned in order of first
    appearance, the last compiler given wins, stock once is stock, reasons are joined."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "strip_flags", "add_flags", "reason")))
    rows = drafts.groupBy("source").agg(
        ordered.alias("o"), F.max_by("compiler", F.when(F.col("compiler").isNotNull(), F.col("position"))).alias("compiler"), F.bool_or("use_stock").alias("use_stock"))
    union = lambda c: F.array_distinct(F.flatten(F.transform("o", lambda x: x[c])))
    reasons = F.transform("o", lambda x: x["reason"])
    joined = F.aggregate(reasons, F.lit(None).cast("string"), lambda acc, r: F.when(acc.isNull() | (acc == r), r).otherwise(F.concat_ws(" + ", acc, r)))
    return rows.select("source", union("strip_flags").alias("strip_flags"), union("add_flags").alias("add_flags"), "compiler", "use_stock", joined.alias("reason"))


# ------------------------------------------------------------------ flags


def axis_flags(aggression: Column, threat: Column) -> Column:
    """Global flag record for the two axes."""
    bold = aggression == "aggressive"
    options = F.when(bold, F.array(F.lit("nocheck"), F.lit("nodoc"))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.when(aggression == "conservative", "x86-64-v3").otherwise("native").alias("march"), F.when(bold, "-O3").otherwise("-O2").alias("opt"),
        F.when(bold, "auto").otherwise("none").alias("lto"), (threat != "permissive").alias("hardened"), options.alias("options"),
    )


def base_cflags(flags: Column, compiler: Column) -> Column:
    clang, lto = compiler == "clang", flags["lto"]
    lto_flag = F.when(lto == "none", None).when(clang, F.when(lto == "full", "-flto").otherwise("-flto=thin")).when(lto == "full", "-flto").otherwise("-flto=auto")
    return F.array_compact(F.array(
        F.concat(F.lit("-march="), flags["march"]), flags["opt"], F.when(clang, F.lit("-gdwarf-4")), lto_flag, F.when(flags["hardened"], F.lit("-D_FORTIFY_SOURCE=3"))))


def base_ldflags(flags: Column, compiler: Column, linker: Column) -> Column:
    clang, lto = compiler == "clang", flags["lto"]
    used = F.when(linker != "", linker).when(clang, "lld").otherwise("")
    return F.array_compact(F.array(
        F.when(clang & (lto != "none"), F.when(lto == "full", "-flto").otherwise("-flto=thin")), F.when(used != "", F.concat(F.lit("-fuse-ld="), used))))


def effective_cflags(flags: Column, compiler: Column, strip: Column, add: Column) -> Column:
    """Base flags without the stripped tokens, then the added ones; order is kept."""
    return F.concat(F.filter(base_cflags(flags, compiler), lambda t: ~F.array_contains(strip, t)), add)


def effective_ldflags(flags: Column, compiler: Column, linker: Column, strip: Column) -> Column:
    """Stripping an LTO flag also removes it at link time, with the linker it implied."""
    base = base_ldflags(flags, compiler, linker)
    no_lto = F.exists(strip, lambda t: t.startswith("-flto"))
    without = F.filter(base, lambda t: ~t.startswith("-flto") & ~((linker == "") & (t == "-fuse-ld=lld")))
    return F.when(no_lto, without).otherwise(F.filter(base, lambda t: ~F.array_contains(strip, t)))


def effective_options(flags: Column, extra: Column, strip: Column) -> Column:
    return F.filter(F.array_distinct(F.concat(flags["options"], extra)), lambda o: ~F.array_contains(strip, o))


def effective_profiles(flags: Column, extra: Column, strip: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(F.concat(flags["options"], extra)), strip))


def flags_hash(*parts: Column) -> Column:
    """16 hex digits over the effective settings, in our own canonical form."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.array_join(p, " ") for p in parts]), 256), 1, 16)


def fact_hash(record: Column) -> Column:
    """24 hex digits over a record's JSON form."""
    return F.substring(F.sha2(F.to_json(record), 256), 1, 24)


# ------------------------------------------------------------------ logs and remedies


def missing_flags(log: Column, expected: Column) -> Column:
    return F.filter(expected, lambda t: ~log.contains(t))


def log_audit(log: Column, expected: Column, report: Column, report_rc: Column) -> Column:
    """Struct ``verdict, missing, findings, kinds`` of a build log."""
    # fixed values: report line starts that count as findings
    hits = F.regexp_extract_all(report, F.lit(r"(?m)^((?:CFLAGS missing|LDFLAGS missing|CPPFLAGS missing|NONVERBOSE BUILD).*)$"), 1)
    kinds = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.substring_index(h, ":", 1))))
    nothing = (report_rc != 0) & report.contains("No compiler commands")
    missing = F.when(nothing, F.array().cast("array<string>")).otherwise(missing_flags(log, expected))
    verdict = F.when(nothing, "no-compiler").when(F.size(missing) == 0, "ok").otherwise("missing-flags")
    return F.struct(verdict.alias("verdict"), missing.alias("missing"), F.when(nothing, 0).otherwise(F.size(hits)).alias("findings"), kinds.alias("kinds"))


def compiler_majority(log: Column, want: Column, masquerade: bool = False) -> Column:
    """Did the wanted compiler do the work? gcc may help but not compile the majority;
    when gcc names are redirected, only calls around the redirection count.

    A line is split into words. It compiles if a word is ``-c`` with something after it;
    the driver is the first word before it whose base name is that of a compiler."""
    # fixed values: names of the drivers and of a native tool chain's prefix
    clang, gcc, prefix = ("clang", "clang++"), ("gcc", "g++", "cc", "c++"), "x86_64-linux-gnu-"
    base = lambda w: F.substring_index(w, "/", -1)
    bare = lambda w: F.when(base(w).startswith(prefix), F.replace(base(w), F.lit(prefix), F.lit(""))).otherwise(base(w))
    # a versioned name, or one given by its full path, is not the redirected one
    versioned = lambda w: (F.size(F.split(bare(w), "-")) == 2) & F.split(bare(w), "-")[0].isin("gcc", "g++") & F.try_element_at(F.split(bare(w), "-"), F.lit(2)).try_cast("int").isNotNull()
    family = lambda w: F.when(base(w).isin(*clang), "clang").when(bare(w).isin(*gcc) | versioned(w), "gcc")
    direct = lambda w: (w.startswith("/") & bare(w).isin("gcc", "g++")) | versioned(w)
    words = lambda line: F.filter(F.split(line, r"\s+"), lambda w: w != "")
    before = lambda ws: F.when((F.array_position(ws, "-c") > 1) & (F.array_position(ws, "-c") < F.size(ws)), F.slice(ws, 1, F.array_position(ws, "-c").cast("int") - 1)).otherwise(F.array().cast("array<string>"))
    calls = F.transform(F.split(log, "\n"), lambda line: before(words(line)))
    count = lambda test: F.size(F.filter(calls, lambda ws: F.exists(ws, test)))
    by_clang, by_gcc = count(lambda w: family(w) == "clang"), count(lambda w: family(w) == "gcc")
    return (want != "clang") | ((count(direct) == 0) if masquerade else (by_gcc <= by_clang))


def log_tail(lines: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Last ``n`` lines of each log without fetch noise."""
    noise = r"^(Get:|Ign:|Hit:|Fetched |Reading |Building dep)"
    from pyspark.sql import Window
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("line_no")))
    return lines.where(~F.col("line").rlike(noise)).withColumn("back", back).where(F.col("back") <= n).drop("back")


def serial_verdict(text: Column, method: Column, sentinel: str) -> Column:
    """Struct ``ok, reason`` of a boot log, by the order of its markers."""
    # fixed values: log markers
    at = lambda s: F.instr(text, F.lit(s))
    panic, vfs, root = at("Kernel panic"), at("VFS: Unable to mount root fs"), at("Cannot open root device")
    v = lambda ok, why: F.struct(F.lit(ok).alias("ok"), F.lit(why).alias("reason"))
    guest = F.when(at(sentinel) > 0, v(True, "sentinel reached")).when(panic > 0, v(False, "kernel panic")).otherwise(v(False, "no sentinel"))
    bare = (
        F.when(at("Linux version") == 0, v(False, "no kernel banner")).when(panic == 0, v(True, "no panic"))
        .when((vfs > 0) & (vfs < panic), v(True, "reached root mount")).when((root > 0) & (root < panic), v(True, "reached root lookup"))
        .otherwise(v(False, "panic before root"))
    )
    return F.when(method == "guest", guest).otherwise(bare)


def world_verdict(text: Column, sentinel: str) -> Column:
    """Struct ``ok, reason`` of a whole-image boot log."""
    v = lambda ok, why: F.struct(F.lit(ok).alias("ok"), why.alias("reason"))
    panic = F.regexp_extract(text, r"Kernel panic[^\n]*", 0)
    return (
        F.when(text.contains(sentinel), v(True, F.lit("sentinel reached"))).when(panic != "", v(False, panic))
        .when(text.contains("Failed to mount") | text.contains("Cannot open root device"), v(False, F.lit("root filesystem mount failed")))
        .otherwise(v(False, F.lit("no sentinel before timeout")))
    )


# fixed values: actions a remedy may take
ACTIONS = ("retry", "nocheck", "strip-flags", "strip-build-options", "force-gcc", "use-stock", "defer")


def _is_flag(token: Column) -> Column:
    """A dash, an ASCII letter, and after them only letters, digits and a few marks."""
    second = F.substring(token, 2, 1)
    rest = F.translate(F.substr(token, F.lit(3)), ascii_letters + digits + "=_+,.-", "")
    return token.startswith("-") & (second.between("A", "Z") | second.between("a", "z")) & (rest == "")


def remedy_problems(action: Column, reason: Column, strip: Column, add: Column, options: Column, failure: Column, in_effect: Column, build_options: Column) -> Column:
    """Problems of a proposed remedy; empty means it may be tried."""
    flags, strips = action == "strip-flags", action == "strip-build-options"
    one = lambda cond, text: F.when(cond, F.array(text if isinstance(text, Column) else F.lit(text))).otherwise(F.array().cast("array<string>"))
    each = lambda cond, tokens, text: F.when(cond, F.transform(tokens, lambda t: F.concat(F.lit(text + " "), t))).otherwise(F.array().cast("array<string>"))
    return F.concat(
        one(~action.isin(*ACTIONS), F.concat(F.lit("unknown action "), action)),
        one(F.trim(reason) == "", "empty reason"),
        one(flags & (F.size(strip) == 0), "nothing to strip"),
        each(flags, F.array_except(strip, in_effect), "not in effect"),
        each(flags, F.filter(add, lambda t: ~_is_flag(t)), "not a flag"),
        one(~flags & ((F.size(strip) > 0) | (F.size(add) > 0)), "flags without strip-flags"),
        one(strips & (F.size(options) == 0), "no options to strip"),
        each(strips, F.array_except(options, build_options), "not a build option"),
        one(~strips & (F.size(options) > 0), "options without strip-build-options"),
        one((action == "nocheck") & (failure == "opt-miscompile"), "tests caught this one"),
    )


def remedy_override(action: Column, strip: Column, add: Column, options: Column) -> Column:
    """Override fields an action stands for; null when it defers."""
    none = F.array().cast("array<string>")
    return F.when(action.isin(*ACTIONS) & (action != "defer"), F.struct(
        F.when(action == "strip-flags", strip).otherwise(none).alias("strip_flags"), F.when(action == "strip-flags", add).otherwise(none).alias("add_flags"),
        F.when(action == "nocheck", F.array(F.lit("nocheck"))).otherwise(none).alias("build_options"), F.when(action == "strip-build-options", options).otherwise(none).alias("strip_options"),
        F.when(action == "force-gcc", "gcc").alias("compiler"), (action == "use-stock").alias("use_stock")))


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, rates: list[tuple[str, float, float]], default: str) -> Column:
    """Cost of a call by the first rate whose name occurs in the model's."""
    base = next(r for r in rates if r[0] == default)
    price = lambda i: first_match([(model.contains(r[0]), r[i]) for r in rates], base[i])
    return tokens_in / 1e6 * price(1) + tokens_out / 1e6 * price(2)


def cost_ledger(calls: DataFrame, builds: DataFrame) -> DataFrame:
    """Calls, tokens and cost per agent and in total, with build count and CPU hours on
    the total row (agent null)."""
    per = calls.groupingSets([["agent"], []], "agent").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.grouping("agent").alias("is_total"))
    work = builds.agg(F.count(F.lit(1)).alias("builds"), F.round(F.sum("duration_s") / 3600, 3).alias("cpu_hours")).withColumn("is_total", F.lit(1).cast("tinyint"))
    return per.join(work, "is_total", "left").drop("is_total")
