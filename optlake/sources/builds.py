"""Build files, sources, patches, owner files and tool output to rows.

Texts are ``(path, text)`` rows with whatever other key columns the caller keeps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optlake.functions import paths as pt
from optlake.functions.globs import owner_regex
from optlake.session import cut_lineage
from optlake.sources.configs import text_lines

SYMBOL = r"(?<![A-Za-z0-9_])(CONFIG_[A-Z0-9_]+)(?![A-Za-z0-9_])"


def _keys(texts: DataFrame) -> list[str]:
    return [c for c in texts.columns if c != "text"]


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def listed_objects(lines: DataFrame, excluded: tuple[str, ...] = ("scripts", "tools", ".git", "Documentation")) -> DataFrame:
    """Objects of a build listing ``(…, path)`` without module stubs and excluded folders."""
    outside = F.split("path", "/")[0].isin(*excluded)
    return lines.where(F.col("path").endswith(".o") & ~F.col("path").endswith(".mod.o") & ~outside).withColumn("path", pt.fold(F.col("path")))


def declared_symbols(texts: DataFrame) -> DataFrame:
    """``config``/``menuconfig NAME`` declarations with the architecture of their file."""
    names = _all(F.col("text"), r"(?m)^\s*(?:config|menuconfig)\s+([A-Za-z0-9_]+)")
    keys = [c for c in _keys(texts) if c != "path"]
    return texts.select(*keys, pt.arch_of(F.col("path")).alias("arch"), F.explode(names).alias("name")).select(*keys, "arch", F.concat(F.lit("CONFIG_"), "name").alias("symbol")).distinct()


def _object_words(line: Column) -> Column:
    """Words of a build file's line that end in ``.o``; other marks than those of paths part
    words."""
    return F.filter(F.split(line, "[^A-Za-z0-9_./+-]+"), lambda w: w.endswith(".o") & (F.length(w) > 2))


def symbol_lines(texts: DataFrame) -> DataFrame:
    """Lines naming options: one row per (line, option), with the object names on it."""
    lines = text_lines(texts).where(F.col("line").contains("CONFIG_"))
    keys = [c for c in lines.columns if c not in ("line", "line_no")]
    return lines.select(
        *keys, "line_no", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"), _object_words(F.col("line")).alias("objects"),
        F.explode(F.array_distinct(_all(F.col("line"), SYMBOL))).alias("symbol"),
    )


def included_sources(texts: DataFrame) -> DataFrame:
    """Base names of .c and .S files that other sources include."""
    keys = [c for c in _keys(texts) if c != "path"]
    after = F.ltrim(F.expr("substr(ltrim(line), 2)"))
    quoted = F.split(F.ltrim(F.expr("substr(after, 8)")), '"', 3)
    lines = text_lines(texts).where(F.ltrim("line").startswith("#")).withColumn("after", after).where(F.col("after").startswith("include"))
    found = lines.select(*keys, quoted.alias("q")).where((F.size("q") == 3) & (F.col("q")[0] == "")).select(*keys, F.col("q")[1].alias("n"))
    return found.where(F.col("n").endswith(".c") | F.col("n").endswith(".S")).select(*keys, pt.base_name(F.col("n")).alias("name")).distinct()


def joined(text: Column) -> Column:
    """Backslash-continued lines as one line."""
    return F.replace(F.replace(text, F.lit("\\\r\n"), F.lit(" ")), F.lit("\\\n"), F.lit(" "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def make_assignments(texts: DataFrame) -> DataFrame:
    """Build files to their assignments ``(…, path, folder, line_no, variable, words)``:
    what stands before the first equals sign, without the operator's mark, and the words
    after it. Lines whose left side is no single word assign nothing."""
    lines = text_lines(texts.withColumn("text", joined(F.col("text")))).where(F.col("line").contains("="))
    head = F.trim(F.expr("rtrim(':+?', rtrim(substring_index(line, '=', 1)))"))
    value = F.expr("substr(line, instr(line, '=') + 1)")
    rows = lines.select(*_keys(texts), pt.directory(F.col("path")).alias("folder"), "line_no", head.alias("variable"), _words(value).alias("words"))
    return rows.where((F.col("variable") != "") & (F.size(F.split("variable", r"\s+")) == 1))


def _ends(word: Column, *extensions: str) -> Column:
    return reduce(lambda x, y: x | y, [word.endswith(e) for e in extensions])


def indirect_sources(texts: DataFrame) -> DataFrame:
    """Source paths a build file implies beyond plain object lists: intermediate targets,
    single-file host programs, option-conditional family members, and lists named by a
    variable. One row per path without extension, in column ``stem``.

    The assignments are stored once; each idiom is a filter of their words or a join of
    one file's assignments with each other."""
    keys = [c for c in _keys(texts) if c != "path"]
    file = [*keys, "path"]
    table = cut_lineage(make_assignments(texts))
    variable, word = F.col("variable"), F.col("word")
    words = table.select(*file, "folder", "variable", F.explode("words").alias("word"))

    targets = words.where((variable == "targets") & _ends(word, ".o", ".s", ".a"))
    families = words.where(variable.contains("-$(CONFIG_") & variable.endswith(")") & _ends(word, ".o", ".a"))

    # a program with an object list of its own is made of those objects
    listed = table.where(_ends(variable, "-objs", "-y")).select(*file, F.expr("substring_index(variable, '-', size(split(variable, '-')) - 1)").alias("word")).distinct()
    programs = words.where(variable.isin("hostprogs", "hostprogs-y", "userprogs") & ~word.startswith("$(")).join(listed, [*file, "word"], "left_anti")

    # lists that an object variable names, as they were last defined
    rules = reduce(lambda x, y: x | y, [variable.startswith(p) for p in ("obj-", "lib-", "extra-", "always-")])
    pieces = F.transform(F.filter(F.split("word", r"\$\("), lambda x, i: (i > 0) & x.contains(")")), lambda x: F.substring_index(x, ")", 1))
    named = words.where(rules & word.contains("$(")).select(*file, F.explode(pieces).alias("variable")).distinct()
    kind = lambda w: F.lower(F.substring_index(w, ".", -1))
    objects = F.filter("words", lambda w: w.contains(".") & kind(w).isin("o", "s", "a", "obj"))
    lists = table.where(F.translate("variable", "-./$(){}%", "") == variable).where(~variable.startswith("CONFIG_") & ~variable.isin("targets", "hostprogs", "userprogs"))
    lists = lists.withColumn("objects", objects).where((F.size("objects") > 0) & F.forall("objects", lambda w: _ends(w, ".o", ".a")))
    last = lists.groupBy(*file, "folder", "variable").agg(F.max_by("objects", "line_no").alias("objects"))
    members = last.join(named, [*file, "variable"], "left_semi").select(*keys, "folder", F.explode("objects").alias("word"))

    paths = reduce(DataFrame.unionByName, [x.select(*keys, "folder", "word") for x in (targets, families, members)])
    # words with variables that are not known here are left out
    known = paths.where(~word.contains("$(") | word.startswith("$(obj)/") | word.contains("$(SRCARCH)"))
    plain = F.replace(F.replace("word", F.lit("$(obj)/"), F.lit("")), F.lit("$(SRCARCH)"), F.lit("x86"))
    base = pt.base_name(F.col("word"))
    bare = known.withColumn("word", plain).withColumn("word", F.when(base.contains("."), F.expr("substr(word, 1, length(word) - length(substring_index(word, '.', -1)) - 1)")).otherwise(word))
    stems = bare.select(*keys, "folder", "word").unionByName(programs.select(*keys, "folder", "word"))
    return stems.select(*keys, pt.join_path(F.col("folder"), word).alias("stem")).distinct()


def wildcard_directories(texts: DataFrame) -> DataFrame:
    """Directories a build file takes whole with ``$(wildcard $(srctree)/$(src)/DIR/*…)``."""
    keys = [c for c in _keys(texts) if c != "path"]
    calls = F.filter(F.split(joined(F.col("text")), r"\$\(wildcard"), lambda x, i: i > 0)
    root = "$(srctree)/$(src)/"
    rows = texts.select(*keys, pt.directory(F.col("path")).alias("folder"), F.explode(calls).alias("call")).select(*keys, "folder", F.ltrim("call").alias("call"))
    inside = F.expr(f"substr(call, {len(root) + 1})")
    rows = rows.where(F.col("call").startswith(root) & inside.contains("/*") & F.substring_index(inside, "/*", -1).contains(")")).withColumn("d", F.substring_index(inside, "/*", 1))
    rows = rows.where((F.col("d") != "") & (F.translate("d", "$() \t\n*", "") == F.col("d")))
    return rows.select(*keys, pt.join_path(F.col("folder"), F.col("d")).alias("dir")).distinct()


def hard_coded_defines(texts: DataFrame) -> DataFrame:
    """``-DCONFIG_X`` flags written out in build files: ``(…, path, line_no, symbol)``."""
    lines = text_lines(texts).where(F.col("line").contains("-DCONFIG_"))
    keys = [c for c in lines.columns if c != "line"]
    return lines.select(*keys, F.explode(F.array_distinct(_all(F.col("line"), r"-D(CONFIG_[A-Za-z0-9_]+)"))).alias("symbol"))


def patched_paths(patches: DataFrame) -> DataFrame:
    """Paths a unified diff adds or changes with the position of first mention; deleted
    files are left out."""
    lines = text_lines(patches).where(F.col("line").startswith("+++ "))
    keys = [c for c in lines.columns if c not in ("line", "line_no")]
    first = F.split(F.expr("substr(line, 5)"), r"\s", 2)[0]
    path = F.when(first.startswith("b/"), F.expr("substr(split(substr(line, 5), '\\\\s', 2)[0], 3)")).otherwise(first)
    return lines.withColumn("path", path).where("path <> '' AND path <> '/dev/null'").groupBy(*keys, "path").agg(F.min("line_no").alias("position"))


def touched_files(patches: DataFrame) -> DataFrame:
    """Files a diff names: its git headers, or without any the new-file lines."""
    keys = _keys(patches)
    lines = F.split("text", "\n")
    after = lambda l, mark: F.substring(l, F.locate(mark, l) + len(mark), F.length(l))
    git = F.transform(F.filter(lines, lambda l: l.startswith("diff --git a/") & l.contains(" b/")), lambda l: after(l, " b/"))
    new = F.transform(F.filter(lines, lambda l: l.startswith("+++ ")), lambda l: F.trim(F.when(l.startswith("+++ b/"), after(l, "+++ b/")).otherwise(after(l, "+++ "))))
    plus = F.filter(new, lambda f: (f != "") & (f != "/dev/null"))
    name = pt.base_name(F.col("path"))
    return patches.select(*keys, F.explode(F.when(F.size(git) > 0, git).otherwise(plus)).alias("path")).withColumn("is_build_file", name.isin("Makefile", "Kbuild") | name.startswith("Kconfig"))


def owner_fields(texts: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Owner file to one row per field: ``(entry_id, title, field, raw, regex, is_dir,
    depth, slash_count)``. An entry is a block of lines whose first is its title.

    Patterns ending in a slash, and plain ones naming a folder of ``folders (dir)``, are
    directories.
    """
    keys = _keys(texts)
    form = r"^([A-Z]+):\s*(.*)$"
    block = texts.select(*keys, F.posexplode(F.split("text", r"\n\s*\n")).alias("entry_id", "block"))
    lines = F.filter(F.split("block", "\n"), lambda l: F.trim(l) != "")
    rows = block.withColumn("lines", lines).where((F.size("lines") >= 2) & ~F.try_element_at("lines", F.lit(1)).rlike(form))
    rows = rows.select(*keys, "entry_id", F.trim(F.col("lines")[0]).alias("title"), F.posexplode(F.filter(F.slice("lines", 2, F.size("lines")), lambda l: l.rlike(form))).alias("position", "line"))
    rows = rows.select(*keys, "entry_id", "title", "position", F.regexp_extract("line", form, 1).alias("field"), F.rtrim(F.regexp_extract("line", form, 2)).alias("raw"))
    wild = F.col("raw").rlike(r"[*?]")
    if folders is not None:
        rows = rows.join(folders.select(F.col("dir").alias("raw")).distinct().withColumn("real", F.lit(True)), "raw", "left")
    else:
        rows = rows.withColumn("real", F.lit(None).cast("boolean"))
    rows = rows.withColumn("is_dir", F.col("raw").endswith("/") | (~wild & F.coalesce("real", F.lit(False)))).drop("real")
    full = F.when(F.col("is_dir") & ~F.col("raw").endswith("/"), F.concat("raw", F.lit("/"))).otherwise(F.col("raw"))
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    return rows.withColumn("pattern", full).withColumn("regex", F.when(F.col("field") == "N", F.col("raw")).otherwise(owner_regex(F.col("pattern")))).withColumn(
        "slash_count", slashes(F.col("raw"))).withColumn("depth", F.when(F.col("is_dir"), slashes(F.col("pattern"))).otherwise(F.col("slash_count")))


def tool_conditions(texts: DataFrame) -> DataFrame:
    """``unit_pc PATH CONDITION`` lines of another tool; templates are dropped."""
    p = F.split("line", r"\s+", 3)
    return text_lines(texts).where(F.col("line").startswith("unit_pc ") & F.try_element_at(p, F.lit(2)).endswith(".o") & ~F.try_element_at(p, F.lit(2)).startswith("$(")).select(
        *_keys(texts), p[1].alias("object"), F.try_element_at(p, F.lit(3)).alias("condition"))


def dry_run_objects(texts: DataFrame) -> DataFrame:
    """Objects a saved dry run would build, scripts left out: the words of its lines, after
    an output flag that is written without a blank, that name an object or an archive."""
    word = lambda w: F.when(w.startswith("-o"), F.substr(w, F.lit(3))).otherwise(w)
    words = F.transform(F.split("line", r"\s+"), word)
    objects = F.filter(words, lambda w: w.endswith(".o") | w.endswith(".a"))
    return text_lines(texts).select(*_keys(texts), F.explode(objects).alias("object")).where("NOT startswith(object, 'scripts/')").distinct()
