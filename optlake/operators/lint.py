"""Findings over build files, declarations, sources and owners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optlake.functions import paths as pt
from optlake.functions.globs import shell_rlike
from optlake.operators.salting import dealt
from optlake.plans.scoreboard import first_per_group
from optlake.session import cut_lineage

SALTS = 32


def declared_scope(declared: DataFrame, arch: str) -> DataFrame:
    """``(symbol, here, elsewhere)``: declared for ``arch`` or everywhere, or only for
    other architectures."""
    here = F.bool_or(F.col("arch").isNull() | (F.col("arch") == arch))
    return declared.groupBy("symbol").agg(here.alias("here")).select("symbol", "here", (~F.col("here")).alias("elsewhere"))


def zombie_symbols(references: DataFrame, declared: DataFrame, arch: str) -> DataFrame:
    """Options that build files use and nothing declares for ``arch``: ``(symbol, uses,
    severity, examples)``; information only when another architecture declares them.

    ``references`` are ``(symbol, object)``; examples are the first three objects, kept
    as three per part before they meet.
    """
    part = F.pmod(F.xxhash64("object"), F.lit(SALTS))
    counts = references.groupBy("symbol", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("object")), 1, 3).alias("some"))
    uses = counts.groupBy("symbol").agg(F.sum("n").alias("uses"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("some")))), 1, 3).alias("examples"))
    return uses.join(declared_scope(declared, arch), "symbol", "left").where("here IS NULL OR NOT here").select(
        "symbol", "uses", F.when(F.col("elsewhere"), "info").otherwise("error").alias("severity"), F.array_join("examples", " ").alias("examples"))


def option_use(declared: DataFrame, references: DataFrame) -> DataFrame:
    """Declared options: referenced by build files or unused there."""
    used = references.select("symbol").distinct().withColumn("used", F.lit(True))
    return declared.select("symbol").distinct().join(used, "symbol", "left").select("symbol", F.coalesce("used", F.lit(False)).alias("used"))


def hard_coded(defines: DataFrame, declared: DataFrame, arch: str) -> DataFrame:
    return defines.distinct().join(declared_scope(declared, arch), "symbol", "left").where("here IS NULL OR NOT here").withColumn(
        "severity", F.when(F.col("elsewhere"), "info").otherwise("error")).drop("here", "elsewhere")


def orphan_sources(sources: DataFrame, objects: DataFrame, included: DataFrame, wildcards: DataFrame, indirect: DataFrame, arch: str) -> DataFrame:
    """Source files no build file reaches: a chain of anti joins on equal keys. Whatever reaches
    them is dealt out by tree, so sources that lie so stay where they are."""
    path = F.col("path")
    rows = sources.where(pt.is_source(path) & pt.in_scope(path, arch) & ~F.array_contains(F.split("path", "/"), "generated")).select(
        "tree", "path", F.regexp_replace("path", r"\.[cS]$", "").alias("stem"), pt.base_name(path).alias("name"), pt.directory(path).alias("dir"))
    known = objects.select("tree", F.regexp_replace("path", r"\.o$", "").alias("stem"))
    for reached, key in ((known, "stem"), (indirect, "stem"), (included, "name"), (wildcards, "dir")):
        rows = rows.join(reached.select("tree", key).repartition("tree").distinct(), ["tree", key], "left_anti")
    return rows.select("tree", "path")


# ------------------------------------------------------------------ owners


def _prefixes(path: Column) -> Column:
    """Every ancestor directory with a trailing slash, and the empty prefix."""
    parts = F.split(path, "/")
    deeper = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), deeper)


def _triples(texts: Column) -> Column:
    """Distinct runs of three characters of an array of texts."""
    each = F.transform(F.filter(texts, lambda x: F.length(x) >= 3), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def _plain_parts(regex: Column) -> Column:
    """Texts that occur in whatever a regular expression finds; none where it has groups,
    alternatives, counts, letters behind a backslash or nested classes."""
    open_ = F.regexp_replace(regex, r"\\[^A-Za-z0-9]", "\n")
    unsure = open_.rlike(r"[|(){}\\]|\[\^?\]|\[[^\]]*\[")
    # a class, and a character that need not occur, end a part as an anchor does
    parts = F.split(F.regexp_replace(F.regexp_replace(open_, r"\[[^\]]*\]", "\n"), r"(?s).[*?]", "\n"), r"[\n.*?+^$\[\]]")
    return F.when(unsure, F.array().cast("array<string>")).otherwise(parts)


def _path_pieces(path: Column) -> Column:
    return F.array_union(F.transform(_prefixes(path), lambda x: F.concat(F.lit("^"), x)), _triples(F.array(path)))


def _rarest(patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """``patterns`` with the ``piece`` of theirs that the fewest paths have: the directory
    at their literal head, or three characters that must occur."""
    folder = F.when(F.col("named"), "").otherwise(F.regexp_extract(F.regexp_extract("pattern", r"^[^*?]*", 0), "^(.*/)?", 0))
    parts = F.when(F.col("named"), _plain_parts(F.col("regex"))).otherwise(F.split("pattern", "[*?]"))
    pieces = patterns.withColumn("piece", F.explode(F.array_union(F.array(F.concat(F.lit("^"), folder)), _triples(parts))))
    pieces = cut_lineage(pieces)
    held = paths.select(F.explode(_path_pieces(F.col("path"))).alias("piece")).join(pieces.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("held"))
    counted = pieces.join(held, "piece", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    return counted.groupBy(*patterns.columns).agg(F.min_by("piece", F.struct("held", "piece")).alias("piece"))


KIND = ["pattern", "regex", "named", "is_dir", "slash_count"]


def _met(paths: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, pid)`` of every distinct pattern that claims a path, and the patterns with
    their number ``pid``.

    Each distinct pattern is looked up under the rarest piece of text that must occur in
    what it claims, joined to the pieces of the paths. Patterns without such a piece meet
    all paths; these, and pieces that many paths have, are split by paths.
    """
    each = paths.select("path").distinct()
    chosen = cut_lineage(_rarest(entries.select(*KIND).distinct(), each).withColumn("pid", F.monotonically_increasing_id()))
    pieces = each.withColumn("piece", F.explode(_path_pieces(F.col("path"))))
    left, right = dealt(pieces.join(chosen.select("piece").distinct(), "piece", "left_semi"), chosen, "piece", "path")
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    fits = F.expr("path RLIKE regex") & (F.col("is_dir") | F.col("named") | (slashes == F.col("slash_count")))
    return left.join(right, ["piece", "part"]).where(fits).select("path", "pid"), chosen.select("pid", *KIND)


def _entries(patterns: DataFrame) -> DataFrame:
    return patterns.withColumn("named", F.col("field") == "N").withColumn("depth", F.when(F.col("named"), 0).otherwise(F.col("depth")))


def pattern_matches(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(path, entry_id, field, depth)`` of every pattern that claims a path."""
    entries = _entries(patterns)
    met, kinds = _met(paths, entries)
    return met.join(kinds, "pid").join(entries.select("entry_id", "field", "depth", *KIND), KIND).select("path", "entry_id", "field", "depth")


def _classes(sets: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``sets`` with a number ``name`` for each distinct array ``of``, and the arrays."""
    sets = cut_lineage(sets)
    numbered = cut_lineage(sets.select("of").distinct().withColumn(name, F.monotonically_increasing_id()))
    return sets.join(numbered, "of").drop("of"), numbered


def _claims(paths: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(path, class)``, ``(class, kin, depth)`` and ``(kin, entry_id)``: paths that the same
    patterns claim are a class, entries with the same patterns are kin, and a class is
    judged once for all its paths and all that are kin."""
    entries = _entries(fields.where("field IN ('F', 'X', 'N')"))
    met, kinds = _met(paths, entries)
    classed, classes = _classes(met.groupBy("path").agg(F.array_sort(F.collect_set("pid")).alias("of")), "class")
    rule = F.struct("pid", "field", "depth")
    rules = entries.join(kinds, KIND).groupBy("entry_id").agg(F.array_sort(F.collect_set(rule)).alias("of"))
    kinned, kin = _classes(rules, "kin")
    hits = classes.select("class", F.explode("of").alias("pid")).join(kin.select("kin", F.inline("of")), "pid")
    per = hits.groupBy("class", "kin").agg(
        F.max(F.when(F.col("field") == "F", F.col("depth"))).alias("f"), F.max(F.when(F.col("field") == "N", F.col("depth"))).alias("n"), F.bool_or(F.col("field") == "X").alias("x"))
    kept = per.where(~F.col("x") & (F.col("f").isNotNull() | F.col("n").isNotNull())).select("class", "kin", F.coalesce("f", "n").alias("depth"))
    best = F.max("depth").over(Window.partitionBy("class"))
    return classed, cut_lineage(kept.withColumn("best", best).where("depth = best").drop("best")), kinned


def owners(paths: DataFrame, fields: DataFrame, name: str = "entry_id") -> DataFrame:
    """Most specific entries that claim each path: ``(path, entry_id, depth)``, or with the
    entry's column ``name`` instead of its id; ties stay. An entry's exclusions remove it,
    name patterns count only where no path pattern does. Rows appear as the answer only;
    classes of many paths are split."""
    classed, claims, kinned = _claims(paths, fields)
    if name != "entry_id":
        kinned = kinned.join(fields.select("entry_id", name).distinct(), "entry_id")
    left, right = dealt(classed, claims.join(kinned, "kin").select("class", name, "depth"), "class", "path")
    return left.join(right, ["class", "part"]).select("path", name, "depth")


def source_of(objects: DataFrame, sources: DataFrame) -> DataFrame:
    """Source path of each object: .c, then .S, then .s; .c when none is there."""
    stem = F.regexp_replace("path", r"\.[cSs]$", "")
    ext = F.regexp_extract("path", r"\.([cSs])$", 1)
    rank = F.when(ext == "c", 0).when(ext == "S", 1).otherwise(2)
    known = sources.where(F.col("path").rlike(r"\.[cSs]$")).groupBy("tree", stem.alias("stem")).agg(F.min_by("path", rank).alias("source"))
    rows = objects.withColumn("stem", F.regexp_replace("path", r"\.o$", ""))
    return rows.join(known, ["tree", "stem"], "left").withColumn("source", F.when(~F.col("path").endswith(".o"), F.col("path")).otherwise(F.coalesce("source", F.concat("stem", F.lit(".c"))))).drop("stem")


def object_of(names: DataFrame, objects: DataFrame) -> DataFrame:
    """Object of each asked ``(tree, name)``: the name itself or its source's object."""
    stem = F.regexp_replace("name", r"\.(c|C|S|s)$", "")
    asked = names.withColumn("path", F.when(F.col("name").rlike(r"\.(c|C|S|s)$") | ~pt.base_name(F.col("name")).contains("."), F.concat(stem, F.lit(".o"))).otherwise(F.col("name")))
    return asked.join(objects.select("tree", "path", F.lit(True).alias("known")), ["tree", "path"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _pieces(base: Column) -> Column:
    """Three-letter pieces of a name without its extension; a short name is one piece."""
    stem = F.substring_index(base, ".", 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(stem) - 2, F.lit(1))), lambda i: F.substring(stem, i, F.lit(3))))


def close_names(unknown: DataFrame, objects: DataFrame, n: int = 5, far: int = 2) -> DataFrame:
    """Up to ``n`` objects of the tree for each name that is not known, nearest path first:
    those whose base name shares a three-letter piece and differs by ``far`` edits at most.
    Distinct base names meet first, paths after that; paths are cut to ``n`` in hashed parts
    before the parts meet."""
    known = objects.select("tree", F.col("path").alias("suggestion"), pt.base_name(F.col("path")).alias("base"))
    asked = unknown.select("tree", "name", "path", pt.base_name(F.col("path")).alias("wanted"))
    left = asked.select("tree", "wanted").distinct().select("tree", "wanted", F.explode(_pieces(F.col("wanted"))).alias("piece"))
    right = known.select("tree", "base").distinct().select("tree", "base", F.explode(_pieces(F.col("base"))).alias("piece"))
    alike = left.join(right, ["tree", "piece"]).where(F.levenshtein("wanted", "base") <= far).select("tree", "wanted", "base").distinct()
    rows = asked.join(alike, ["tree", "wanted"]).join(known, ["tree", "base"]).withColumn("distance", F.levenshtein("path", "suggestion"))
    first = lambda *keys: F.row_number().over(Window.partitionBy("tree", "name", *keys).orderBy("distance", "suggestion"))
    few = rows.withColumn("part", F.pmod(F.xxhash64("suggestion"), F.lit(64))).withColumn("rank", first("part")).where(F.col("rank") <= n)
    return few.withColumn("rank", first()).where(F.col("rank") <= n).select("tree", "name", "suggestion", "rank")


def blind_spots(objects: DataFrame, ever: DataFrame, sources: DataFrame, fields: DataFrame) -> DataFrame:
    """Per owner entry: objects no given configuration builds, all its objects, percent.
    Objects nobody owns are counted under a null entry."""
    judged = source_of(objects.join(ever, ["tree", "guard_id"]), sources)
    classed, claims, kinned = _claims(judged.select(F.col("source").alias("path")), fields)
    titles = fields.select("entry_id", "title").distinct()
    per = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ever")).alias("b"))
    # counts meet by class and kin before they are told apart by entry
    sums = per.join(classed.withColumnRenamed("path", "source"), "source", "left").groupBy("class").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    shared = sums.join(claims, "class", "left").groupBy("kin").agg(F.sum("n").alias("objects"), F.sum("b").alias("blind"))
    rows = shared.join(kinned, "kin", "left")
    return rows.join(titles, "entry_id", "left").select("title", "blind", "objects", F.round(100.0 * F.col("blind") / F.col("objects"), 1).alias("percent"))


def blind_reason(rows: DataFrame, foreign: list[str]) -> DataFrame:
    """Why an object is built nowhere. ``rows`` carry ``path, symbols, status, symbol,
    current_value, suggested_value, on_everywhere``."""
    second = F.try_element_at(F.split("path", "/"), F.lit(2))
    arch = (F.split("path", "/")[0] == "arch") & second.isNotNull() & (second != "x86")
    on, off = F.col("current_value").isin("y", "m"), F.col("current_value") == "n"
    reason = (
        F.when(arch, "other architecture").when(F.arrays_overlap("symbols", F.array(*[F.lit(x) for x in foreign])), "other architecture's option")
        .when(F.col("status") == "dead", "never satisfiable").when(F.size("symbols") == 0, "other").when(F.col("symbol").isNull(), "other")
        .when(on & (F.col("suggested_value") == "n"), F.when(F.col("on_everywhere"), "excludes an option every configuration enables").otherwise("excludes an option"))
        .when(off & F.col("suggested_value").isin("y", "m"), "not enabled").otherwise("other")
    )
    return rows.withColumn("reason", reason)


def patch_coverage(touched: DataFrame, objects: DataFrame) -> DataFrame:
    """Class of each path a patch touches: header, skipped, mapped or unknown."""
    mapped = object_of(touched.withColumnRenamed("path", "name"), objects)
    kind = (
        F.when(F.col("name").rlike(r"\.h$"), "header").when(~F.col("name").rlike(r"\.(c|C|S|s)$"), "skipped").when(F.col("known"), "mapped").otherwise("unknown"))
    return mapped.withColumn("class", kind)


def choice_selection(values: DataFrame, choices: DataFrame) -> DataFrame:
    """``(config_id, choice, selected)`` for each choice group a configuration names a
    member of: the first member by position that is y, else the group's first.

    ``choices`` are ``(choice, member, position)``. Members that are set are counted where they
    are; no pair of a configuration and a group it does not touch is made.
    """
    named = values.select("config_id", "symbol", "value").join(choices.withColumnRenamed("member", "symbol"), "symbol")
    first = choices.groupBy("choice").agg(F.min_by("member", "position").alias("default"))
    on = F.col("value") == "y"
    chosen = named.groupBy("config_id", "choice").agg(F.min_by(F.when(on, F.col("symbol")), F.when(on, F.col("position"))).alias("chosen"))
    return chosen.join(first, "choice").select("config_id", "choice", F.coalesce("chosen", "default").alias("selected"))


def explain_options(values: DataFrame, selects: DataFrame, choices: DataFrame) -> DataFrame:
    """For each option that is set: dependencies that are off, who selects it with which
    value, and of a member of a choice the group and its selected member. ``selects`` are
    ``(src, dst, dep)``, ``choices`` ``(choice, member, position)``; an option is a member of
    one group at most."""
    now = values.select("config_id", "symbol", F.when(F.col("value").isin("y", "m"), F.col("value")).otherwise("n").alias("v"))
    asked = now.select("config_id", F.col("symbol").alias("dst")).join(selects, "dst")
    dep = now.select("config_id", F.col("symbol").alias("dep"), F.col("v").alias("dep_v"))
    src = now.select("config_id", F.col("symbol").alias("src"), F.col("v").alias("src_v"))
    rows = asked.join(dep, ["config_id", "dep"], "left").join(src, ["config_id", "src"], "left").na.fill("n", ["dep_v", "src_v"])
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ")
    explained = rows.groupBy("config_id", F.col("dst").alias("symbol")).agg(
        text(F.when(F.col("dep_v") == "n", F.col("dep"))).alias("unmet"), text(F.concat_ws("=", "src", "src_v")).alias("selected_by"))
    groups = choices.select(F.col("member").alias("symbol"), "choice")
    return explained.join(groups, "symbol", "left").join(choice_selection(values, choices), ["config_id", "choice"], "left").withColumnRenamed("selected", "selected_member")


# ------------------------------------------------------------------ option records


def locations(lines: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` lines naming each option, in path order."""
    return first_per_group(lines.select("symbol", "path", "line_no"), "symbol", ["path", "line_no"], n)


def path_tags(mentions: DataFrame) -> DataFrame:
    """Subsystem and risk tags of each option from the paths that mention it, and its ten
    most frequent paths. Paths are counted first, so tags see each path once."""
    counts = mentions.groupBy("symbol", "path").agg(F.count(F.lit(1)).alias("n"))
    # fixed values: top directories that are tags, and path words of each risk
    tops = ("drivers", "fs", "net", "mm", "kernel", "crypto", "security", "sound", "arch")
    risks = {
        "boot_path": ("efi", "initrd", "initramfs", "root", "boot"), "storage": ("fs", "block", "nvme", "scsi", "ata", "dm"),
        "network": ("net", "ethernet", "wifi", "wireless"), "security": ("security", "crypto", "mitigation", "lockdown"),
    }
    parts = F.split("path", "/")
    tag = F.array_compact(F.array(F.when(parts[0].isin(*tops), parts[0]), F.when((parts[0] == "drivers") & (F.size(parts) > 1), F.concat(F.lit("drivers/"), parts[1]))))
    words = F.split(F.lower("path"), "[^a-z0-9]+")
    text = F.lower(F.concat_ws(" ", "symbol", "path"))
    risk = F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(x) for x in ws])), k) for k, ws in risks.items()], F.when(text.contains("debug") | text.contains("trace"), "debug")))
    tags = lambda c, name: counts.select("symbol", F.explode(c).alias("t")).distinct().groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list("t")), " ").alias(name))
    ranked = first_per_group(counts.withColumn("order", -F.col("n")).select("symbol", "order", "path"), "symbol", ["order", "path"], 10)
    top = ranked.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("order", "path"))).alias("p")).select("symbol", F.array_join(F.transform("p", lambda x: x["path"]), " ").alias("top_paths"))
    return counts.select("symbol").distinct().join(tags(tag, "subsystems"), "symbol", "left").join(tags(risk, "risks"), "symbol", "left").join(top, "symbol", "left").na.fill("", ["subsystems", "risks"])


def _arguments(text: Column, macro: str) -> Column:
    """First argument of each call of a macro, quotes and blanks stripped."""
    calls = F.filter(F.split(text, macro + r"\("), lambda x, i: (i > 0) & x.contains(")"))
    return F.transform(calls, lambda x: F.trim(F.substring_index(F.substring_index(x, ")", 1), ",", 1)))


def device_tables(texts: DataFrame) -> DataFrame:
    """Buses and firmware a source file declares."""
    listed = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), " ")
    buses = F.filter(_arguments(F.col("text"), "MODULE_DEVICE_TABLE"), lambda a: a.rlike(r"^\w+$"))
    quoted = F.filter(_arguments(F.col("text"), "MODULE_FIRMWARE"), lambda a: a.startswith('"') & a.endswith('"') & (F.length(a) > 2))
    return texts.select("path", listed(buses).alias("buses"), listed(F.transform(quoted, lambda a: F.trim(a, F.lit('"')))).alias("firmware"))


def module_names(objects: Column) -> Column:
    """Module names of object names; containers of whole directories are none."""
    stems = F.transform(objects, lambda o: F.regexp_replace(F.regexp_extract(o, "[^/]*$", 0), r"\.o$", ""))
    return F.array_sort(F.array_distinct(F.transform(F.filter(stems, lambda s: (s != "") & ~s.isin("built-in", "modules")), lambda s: F.translate(s, "-", "_"))))


def expression_symbols(expression: Column, known: Column) -> Column:
    """Known option names in a dependency expression."""
    return F.array_sort(F.array_intersect(F.split(expression, r"\W+"), known))


def symbol_records(options: DataFrame, relations: DataFrame, bindings: DataFrame, usages: DataFrame, tags: DataFrame) -> DataFrame:
    """One record per declared option: relations, bindings and usages counted, modules, the
    first hundred usages with their places, tags, and a digest of it all. Everything is
    reduced per option before it is joined."""
    mods = bindings.select("symbol", F.explode(module_names(F.col("objects"))).alias("m")).distinct().groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list("m")), " ").alias("modules"))
    bound = bindings.groupBy("symbol").agg(F.count(F.lit(1)).alias("bindings"))
    used = usages.groupBy("symbol").agg(F.count(F.lit(1)).alias("usages"))
    kept = first_per_group(usages.select("symbol", "path", "line_no"), "symbol", ["path", "line_no"], 100)
    places = F.transform(F.array_sort(F.collect_list(F.struct("path", "line_no"))), lambda x: F.concat_ws(":", x["path"], x["line_no"].cast("string")))
    listed = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("listed_usages"), F.array_join(places, " ").alias("usage_list"))
    out = options.select("symbol").distinct()
    for df in (relations, bound, used, listed, mods, tags):
        out = out.join(df, "symbol", "left")
    out = out.na.fill(0, ["bindings", "usages", "listed_usages"]).na.fill("", ["modules", "subsystems", "risks", "selected_by", "implied_by", "usage_list"])
    facts = ("symbol", "selected_by", "bindings", "usages", "modules", "subsystems", "risks", "usage_list")
    return out.withColumn("fact_hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in facts]), 256))


def guidance(records: DataFrame) -> DataFrame:
    """Baseline advice per option from its tags, type and modules."""
    risky = F.col("risks").rlike(r"\b(boot_path|storage|security)\b")
    return records.withColumn("guidance", F.when(risky, "keep_bias").when((F.col("type") == "tristate") | (F.col("modules") != ""), "disable_if_absent").otherwise("workload_choice"))


def valid_enrichments(enrichments: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict per enrichment ``(symbol, fact_hash, cited ARRAY)``: unknown symbol, stale
    hash, no citation, cites a missing file, or ok."""
    facts = records.select("symbol", F.col("fact_hash").alias("now"))
    cited = enrichments.select("symbol", F.explode("cited").alias("path")).distinct().join(files.select("path").distinct(), "path", "left_anti").select("symbol").distinct().withColumn("missing", F.lit(True))
    return enrichments.join(facts, "symbol", "left").join(cited, "symbol", "left").select(
        "symbol", F.when(F.col("now").isNull(), "unknown symbol").when(F.col("now") != F.col("fact_hash"), "stale").when(F.size("cited") == 0, "no citation").when(F.col("missing"), "missing file").otherwise("ok").alias("verdict"))


def search_options(records: DataFrame, kind: str | None = None, prefix: str | None = None, subsystem: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Options by type, name prefix, tag or text in name, prompt and help; with ``limit``,
    a report of the first by name."""
    tests = []
    if kind:
        tests.append(F.col("type") == kind)
    if prefix:
        tests.append(F.col("symbol").startswith(prefix if prefix.startswith("CONFIG_") else "CONFIG_" + prefix))
    if subsystem:
        tests.append(F.array_contains(F.split("subsystems", " "), subsystem))
    if text:
        tests.append(F.lower(F.concat_ws("\n", "symbol", "prompt", "help")).contains(text.lower()))
    for t in tests:
        records = records.where(t)
    found = records.select("symbol")
    return found if limit is None else found.orderBy("symbol").limit(limit)


def list_files(paths: DataFrame, prefix: str = "", globs: list[str] | None = None, skip: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Distinct paths below a directory (or the file of that name) that match any of the
    globs, in which ``*`` and ``?`` cross slashes; no part of the path is in ``skip``.
    One pass over the paths, whatever the globs fit; with ``limit``, the first by name."""
    found = paths.where("path IS NOT NULL").select("path")
    if prefix:
        below = prefix.rstrip("/")
        found = found.where((F.col("path") == below) | F.col("path").startswith(below + "/"))
    if skip:
        found = found.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skip])))
    if globs:
        found = found.where(reduce(lambda a, b: a | b, [shell_rlike(F.col("path"), g) for g in globs]))
    found = found.distinct()
    return found if limit is None else found.orderBy("path").limit(limit)


def excerpts(lines: DataFrame, at: DataFrame, context: int) -> DataFrame:
    """Lines around each asked ``(path, line)``. Asked places are widened to their lines,
    so both sides join on equal keys."""
    wide = at.select("path", F.col("line_no").alias("at"), F.explode(F.sequence(F.greatest(F.col("line_no") - context, F.lit(1)), F.col("line_no") + context)).alias("line_no"))
    return lines.join(wide, ["path", "line_no"]).select("path", "at", "line_no", "line")


def wording(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """Lines with a pattern that must not appear, per pattern and number of hits."""
    hits = F.array(*[F.struct(F.lit(p).alias("pattern"), F.regexp_count("line", F.lit(f"(?i){p}")).alias("hits")) for p in patterns])
    keys = [c for c in lines.columns if c != "line"]
    return lines.select(*keys, F.inline(hits)).where("hits > 0")


def dead_severity(dead: DataFrame) -> DataFrame:
    """Severity of dead objects. ``dead`` rows carry ``status`` under build files alone,
    ``limited`` with option types and absent options pinned, ``freed`` with absent options
    free, flags ``container`` and ``incomplete``."""
    cause = F.when(F.col("status") == "dead", "dead-everywhere").when(F.col("freed") != "dead", "arch-dead").otherwise("dead-everywhere")
    rows = dead.where("status = 'dead' OR limited = 'dead'").withColumn("cause", cause)
    level = F.when(F.col("incomplete") | (F.col("cause") == "arch-dead") | F.col("container"), "info").otherwise("error")
    return rows.withColumn("severity", F.when(F.col("status") == "dead", F.when(F.col("container"), "info").otherwise("error")).otherwise(level))
