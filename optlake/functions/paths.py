"""Paths of sources, objects and build files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: build stages whose objects live under build/<stage>/
STAGES = ("bootblock", "romstage", "ramstage", "postcar", "verstage", "smm", "decompressor")
# fixed values: directories that hold no kernel sources
NOT_KERNEL = ("tools", "scripts", "Documentation", "samples")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def fold(path: Column) -> Column:
    """Remove ``.`` and resolve ``..`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: (
        F.when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def join_path(folder: Column, name: Column) -> Column:
    return fold(F.concat_ws("/", F.nullif(folder, F.lit("")), name))


def target_path(word: Column, variable: Column, folder: Column) -> Column:
    """Object a build-file word stands for, relative to the tree; null for other words."""
    obj = F.when(word.rlike(r"\.[cCsS]$"), F.regexp_replace(word, r"\.[cCsS]$", ".o")).when(word.rlike(r"\.(o|a)$"), word)
    full = F.when(obj.isNotNull(), join_path(folder, obj))
    inside = F.when(full.startswith("../") | (full == ".."), obj).otherwise(full)
    stage = F.substring_index(variable, "-", 1)
    return F.when(stage.isin(*STAGES), F.concat_ws("/", F.lit("build"), stage, F.regexp_replace(inside, "^src/", ""))).otherwise(inside)


def with_suffix(path: Column, variable: Column, suffixes: dict[str, str]) -> Column:
    """Apply the object suffix of a variable's family."""
    family = F.regexp_replace(variable, "-[^-]*$", "")
    out = path
    for name, suffix in suffixes.items():
        out = F.when((family == name) & path.endswith(".o"), F.regexp_replace(path, r"\.o$", suffix)).otherwise(out)
    return out


def arch_of(path: Column) -> Column:
    """Architecture a declaration file belongs to; null for shared files."""
    parts = F.split(path, "/")
    second = F.try_element_at(parts, F.lit(2))
    return F.when((parts[0] == "arch") & second.isNotNull() & ~second.startswith("Kconfig"), second)


def in_scope(path: Column, arch: str) -> Column:
    """Is a source path one that an analysis of ``arch`` reaches?"""
    parts = F.split(path, "/")
    outside = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in NOT_KERNEL]))
    foreign = (parts[0] == "arch") & (F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")) != arch)
    overlay = path.startswith("arch/x86/um/") if arch == "x86" else F.lit(False)
    return ~(outside | foreign | overlay)


def is_source(path: Column) -> Column:
    """Sources a build file is expected to list: generated stubs, skeletons and linker
    scripts are not."""
    return path.rlike(r"\.[cS]$") & ~path.rlike(r"\.(mod|bpf)\.c$") & ~path.rlike(r"\.lds\.S$")
