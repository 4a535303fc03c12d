import random

from pyspark.sql import functions as F

from optlake.operators import assignments, fleet, graph, lint, rules
from optlake.operators import packages as pk
from optlake.sources import builds, configs, hosts


def waves_by_hand(deps):
    waves, cycle, left, wave = {}, set(), {n: set(d) for n, d in deps.items()}, 0
    while left:
        fewest = min(len(d) for d in left.values())
        ready = {n for n, d in left.items() if len(d) == fewest}
        if fewest:
            cycle |= ready
        for n in ready:
            waves[n] = wave
            del left[n]
        for d in left.values():
            d -= ready
        wave += 1
    return waves, cycle


def run_waves(spark, deps):
    nodes = spark.createDataFrame([(n,) for n in deps], "name string")
    edges = spark.createDataFrame([(s, d) for s, ds in deps.items() for d in ds], "src string, dst string")
    rows = graph.build_waves(nodes, edges).collect()
    return {r.name: r.wave for r in rows}, {r.name for r in rows if r.in_cycle}


def test_build_waves(spark):
    assert run_waves(spark, {}) == ({}, set())
    for deps in (
        {"a": set(), "b": {"a"}, "c": {"b"}},
        {"a": {"b"}, "b": {"a"}, "c": {"a"}, "d": set()},
        {"a": {"b", "c"}, "b": {"c", "a"}, "c": {"a", "b", "d"}, "d": set(), "e": {"a"}},
    ):
        assert run_waves(spark, deps) == waves_by_hand(deps)


def test_build_waves_of_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"n{i}" for i in range(40)]
        deps = {n: {d for d in rng.sample(names, rng.randrange(3)) if seed or d > n} for n in names}
        deps["hub"] = set(names[:20])
        deps["alone"] = {"alone"}
        assert run_waves(spark, deps) == waves_by_hand(deps)


def test_build_waves_reads_each_edge_once(spark, monkeypatch):
    chain = {f"c{i}": {f"c{i - 1}"} if i else set() for i in range(12)}
    wide = {f"w{i}": {"c0"} for i in range(200)}
    read, get = [], graph._Parts.get
    monkeypatch.setattr(graph._Parts, "get", lambda self, buckets=None: read.append((self.key, buckets)) or get(self, buckets))
    assert run_waves(spark, chain | wide) == waves_by_hand(chain | wide)
    asked = [b for key, b in read if key == "dst"]
    # the second wave is wide, but nothing depends on its leaves; every other one is a single node
    assert None not in asked and sum(len(b) <= 1 for b in asked) >= 11


def test_build_waves_odd_rows(spark):
    nodes = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "name string")
    edges = spark.createDataFrame([("a", "gone"), ("a", "gone"), ("b", "a"), ("x", "a"), (None, "b")], "src string, dst string")
    rows = sorted(((r.name or "", r.wave, r.in_cycle) for r in graph.build_waves(nodes, edges).collect()))
    # each waits for one other node, so all three are forced together
    assert rows == [("", 0, True), ("a", 0, True), ("b", 0, True)]


def test_reach_and_expand(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("c", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "name string")
    assert {r.name for r in graph.reach(seeds, edges).collect()} == {"a", "b", "c"}
    assert {r.name for r in graph.reach(seeds, edges, rounds=1).collect()} == {"a", "b"}
    members = spark.createDataFrame([("m", "p", True), ("p", "q", False), ("m", "q", True), ("q", "m", True)], "container string, member string, holds boolean")
    roots = spark.createDataFrame([("m", True)], "name string, holds boolean")
    assert {(r.name, r.holds) for r in graph.expand_composites(roots, members).collect()} == {("m", True), ("p", True), ("q", True)}


def test_aliases_against_every_pair(spark):
    import fnmatch

    rng = random.Random(4)
    pieces = ["pci:", "v00", "d1", "*", "?", "[0-4]", "[!a]", "sv", "usb:", "9", "."]
    patterns = {"pci:" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(60)} | {"usb:v*", "acpi*", "*"}
    raws = {rng.choice(["pci:", "usb:", "acpi"]) + "".join(rng.choice(["v00", "d1", "sv", "9", "3", ".", "a"]) for _ in range(rng.randint(0, 6))) for _ in range(80)}
    aliases = spark.createDataFrame([(p, f"m{i}", p.split(":")[0]) for i, p in enumerate(sorted(patterns))], "pattern string, module string, bus string")
    devices = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = {(r.raw, r.module) for r in fleet.match_aliases(devices, aliases).collect()}
    want = {(r, f"m{i}") for i, p in enumerate(sorted(patterns)) for r in raws if p.split(":")[0] == r.split(":")[0] and fnmatch.fnmatchcase(r, p)}
    assert got == want


def test_aliases_of_one_hot_head(spark, monkeypatch):
    """Nine of ten ids begin alike: all matches are found, and no task gets much more than others."""
    import fnmatch

    from optlake.operators import salting

    monkeypatch.setattr(salting, "PER_GROUP", 50)
    rng = random.Random(8)
    raws = [f"pci:v{8086 if i % 10 else i:08d}d{i:08d}sv{rng.randint(0, 3):04d}sd{rng.randint(0, 9):04d}bc{rng.randint(0, 20):02d}sc00i{i % 3:02d}" for i in range(3000)]
    patterns = ["pci:v00008086d*", "pci:v00008086*sv*[1-2]*i02", "pci:v0*", "pci:*bc03sc*", "pci:v00008086d*bc0[1-4]sc*i01", "pci:v*sv0001*bc07sc*", "pci:v*sd0003bc04sc00i00", "pci:v00008086d00000011sv*", "usb:*", "pci:v0000808?d*i00"]
    aliases = spark.createDataFrame([(p, f"m{i}", p.split(":")[0]) for i, p in enumerate(patterns)], "pattern string, module string, bus string")
    devices = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = {(r.raw, r.module) for r in fleet.match_aliases(devices, aliases).collect()}
    assert got == {(r, f"m{i}") for i, p in enumerate(patterns) for r in raws if fnmatch.fnmatchcase(r, p)}
    ids = devices.withColumn("bus", F.substring_index("raw", ":", 1))
    left, right = salting.dealt(*fleet._alias_sides(ids, aliases.select("bus", "pattern")), "key", "raw")
    met = left.repartition(8, "key", "part").withColumn("task", F.spark_partition_id()).join(F.broadcast(right), ["key", "part"])
    tasks = [r["count"] for r in met.groupBy("task").count().collect()]
    assert len(tasks) == 8 and max(tasks) < 2 * sum(tasks) / 8
    # two fixed fields leave hardly more pairs than matches
    assert left.join(right.where("pattern = 'pci:v*sd0003bc04sc00i00'"), ["key", "part"]).count() <= len(raws) // 10


def test_owners_against_every_pair(spark, monkeypatch):
    """Random patterns of both kinds, with pieces that most paths have, against every pair."""
    from optlake.operators import salting

    monkeypatch.setattr(salting, "PER_GROUP", 20)
    rng = random.Random(15)
    paths = {"/".join(rng.choice(["drivers", "net", "a.c", "x1", "é.b", "u2"]) for _ in range(rng.randint(1, 4))) for _ in range(150)}
    globs = {"".join(rng.choice(["drivers", "net/", "/", "*", "?", "a.c", "x1", "[", "u2/"]) for _ in range(rng.randint(1, 4))) for _ in range(80)}
    names = ["net|x1", "[^a-z]x1", "driver(s|x)", "u[0-9]/a\\.c", "ne?t", "driv+ers/", "x1$", "^net", "a{1}", "[]n]et", "nets*/", "rivers.*a.c", "\\bnet", ".", "[a[x]]1", "dri.ers", "é\\.b"]
    text = "\n\n".join(f"E{i}\n{k}:\t{p}" for i, (k, p) in enumerate([("F", g) for g in sorted(globs)] + [("N", n) for n in names]))
    fields = builds.owner_fields(spark.createDataFrame([(text,)], "text string"))
    rows = fields.select("entry_id", "field", "raw", "regex", "is_dir", "slash_count").collect()
    got = {(r.path, r.entry_id) for r in lint.pattern_matches(spark.createDataFrame([(p,) for p in paths], "path string"), fields).collect()}
    tested = spark.createDataFrame([(p,) for p in paths], "path string").crossJoin(fields.select("entry_id", "field", "regex", "is_dir", "slash_count"))
    want = {(r.path, r.entry_id) for r in tested.where("path RLIKE regex").collect() if r.field == "N" or r.is_dir or r.path.count("/") == r.slash_count}
    assert len(rows) == len(globs) + len(names) and got == want and want


def test_owners(spark):
    text = "\n\n".join([
        "EXT2\nM:\ta\nF:\tfs/ext2/\nX:\tfs/ext2/skip*", "FS\nF:\tfs/\nF:\tinclude/fs.h", "REST\nF:\t*\nF:\t*/", "NAMED\nN:\text2", "WILD\nF:\tfs/*/x?.c", "SAME\nF:\tfs/ext2/", "lonely title", "Q: not a title\nF:\tfs/",
    ])
    fields = builds.owner_fields(spark.createDataFrame([(text,)], "text string"))
    titles = {r.entry_id: r.title for r in fields.select("entry_id", "title").distinct().collect()}
    paths = spark.createDataFrame([("fs/ext2/a.c",), ("fs/ext2/skip1.c",), ("fs/nfs/x1.c",), ("fs/b.c",), ("lib/ext2.c",), ("top.c",), ("include/fs.h",)], "path string")
    got = {}
    for r in lint.owners(paths, fields).collect():
        got.setdefault(r.path, set()).add(titles[r.entry_id])
    assert got["fs/ext2/a.c"] == {"EXT2", "SAME", "WILD"} - {"WILD"}
    assert got["fs/ext2/skip1.c"] == {"SAME"}
    assert got["fs/nfs/x1.c"] == {"WILD"}
    assert got["fs/b.c"] == {"FS", "REST"}
    assert got["top.c"] == {"REST"}
    assert got["include/fs.h"] == {"FS", "REST"}
    assert got["lib/ext2.c"] == {"REST"}


def test_owners_by_class(spark, monkeypatch):
    """Hundreds of paths under a few patterns that many entries share are judged once a
    class; owners and blind counts equal those of every path by itself."""
    from optlake.operators import salting

    monkeypatch.setattr(salting, "PER_GROUP", 20)
    rng = random.Random(7)
    globs = ["net/", "net/a/", "drivers/*/x/", "drivers/a/*.c", "*/b/", "f1?.c"]
    # a name pattern is an expression of its own
    row = lambda k, glob: "N:\ta/f?2" if k == "N" else f"{k}:\t{glob}"
    blocks = ["\n".join([f"E{i}", *(row(rng.choice("FFXN"), p) for p in rng.sample(globs, rng.randint(1, 3)))]) for i in range(60)]
    fields = builds.owner_fields(spark.createDataFrame([("\n\n".join(blocks),)], "text string"))
    paths = [f"{rng.choice(['net', 'drivers', 'fs'])}/{rng.choice('abc')}/{rng.choice(['x/', ''])}f{i}.c" for i in range(300)]
    table = spark.createDataFrame([(p,) for p in [*paths, paths[0]]], "path string")
    claims = {}
    for r in lint.pattern_matches(table, fields).collect():
        claims.setdefault((r.path, r.entry_id), []).append((r.field, r.depth))
    depth = {}
    for (p, e), hits in claims.items():
        by = {k: max((d for f, d in hits if f == k), default=None) for k in "FNX"}
        if by["X"] is None:
            depth.setdefault(p, {})[e] = by["N"] if by["F"] is None else by["F"]
    titles = {r.entry_id: r.title for r in fields.select("entry_id", "title").distinct().collect()}
    want = {(p, e, d) for p, of in depth.items() for e, d in of.items() if d == max(of.values())}
    judged, judge = [], lint._claims

    def counted(*args):
        judged.append(judge(*args))
        return judged[-1]

    monkeypatch.setattr(lint, "_claims", counted)
    rows = [(r.path, r.title, r.depth) for r in lint.owners(table, fields, "title").collect()]
    assert want and len(rows) == len(want) and set(rows) == {(p, titles[e], d) for p, e, d in want}
    assert judged[0][1].count() < len(want) / 4
    objects = spark.createDataFrame([(1, p.replace(".c", ".o"), f"g{i % 2}") for i, p in enumerate(paths)], "tree long, path string, guard_id string")
    ever = spark.createDataFrame([(1, "g0", True), (1, "g1", False)], "tree long, guard_id string, ever boolean")
    blind = {r.title: (r.blind, r.objects) for r in lint.blind_spots(objects, ever, table.where("false").selectExpr("1L AS tree", "path"), fields).collect()}
    odd = {p: i % 2 for i, p in enumerate(paths)}
    owned = {p for p, _, _ in want}
    expected = {t: (sum(odd[p] for p, e, _ in want if titles[e] == t), sum(titles[e] == t for _, e, _ in want)) for t in {titles[e] for _, e, _ in want}}
    expected[None] = (sum(odd[p] for p in paths if p not in owned), sum(p not in owned for p in paths))
    assert blind == expected


def test_config_dialects(spark):
    text = 'CONFIG_A=y\n# CONFIG_B is not set\nCONFIG_A=m\n\n  CONFIG_C="x y"\n# note\nbroken\nOTHER=1\nCONFIG_D='
    t = spark.createDataFrame([(1, text)], "config_id long, text string")
    rows = [(r.line_no, r.symbol, r.value, r.kind) for r in configs.config_rows(t).orderBy("line_no").collect()]
    assert rows == [(1, "CONFIG_A", "y", "set"), (2, "CONFIG_B", "n", "unset"), (3, "CONFIG_A", "m", "set"), (5, "CONFIG_C", '"x y"', "set"), (7, None, "broken", "unparsed"), (8, None, "OTHER=1", "unparsed"), (9, "CONFIG_D", "", "set")]
    raw = {(r.symbol, r.value) for r in configs.config_rows(t, "raw").collect()}
    assert raw == {("CONFIG_A", "y"), ("CONFIG_A", "m"), ("CONFIG_D", "")}
    vals = {(r.symbol, r.value) for r in configs.config_rows(t, "values").collect()}
    assert ("CONFIG_C", "x y") in vals and ("OTHER", "1") in vals and ("CONFIG_B", "n") in vals
    last = {r.symbol: r.value for r in assignments.last_assignment(configs.config_rows(t, "values"), ["config_id"]).collect()}
    assert last["CONFIG_A"] == "m"


def test_text_files_round_trip(spark, tmp_path):
    (tmp_path / "one.config").write_text("CONFIG_A=y\n# CONFIG_B is not set\n")
    rows = configs.config_rows(configs.read_texts(spark, str(tmp_path))).collect()
    assert {(r.symbol, r.value) for r in rows} == {("CONFIG_A", "y"), ("CONFIG_B", "n")}
    assert rows[0].config_id.endswith("one.config")


def test_merge_and_policy(spark):
    base = spark.createDataFrame([(1, 1, "CONFIG_A", "y"), (1, 2, "CONFIG_B", "m"), (1, 3, "CONFIG_C", "7")], "merge_id long, line_no int, symbol string, value string")
    frag = spark.createDataFrame([(1, "CONFIG_A", "n"), (1, "CONFIG_B", "m"), (1, "CONFIG_Z", "text")], "merge_id long, symbol string, value string")
    rows = assignments.merge_fragment(base, frag).orderBy(F.col("line_no").asc_nulls_last()).collect()
    assert [(r.line, r.change) for r in rows] == [("# CONFIG_A is not set", "override"), ("CONFIG_B=m", "no-op"), ("CONFIG_C=7", "base only"), ('CONFIG_Z="text"', "fragment only")]
    p = spark.createDataFrame([("h", "CONFIG_A", "low", 0.95, "deterministic"), ("h", "CONFIG_B", "high", 0.99, "advice"), ("h", "CONFIG_C", "low", 0.5, "advice")], "host string, config string, risk string, confidence double, source string")
    lb = spark.createDataFrame([("h", "CONFIG_C", "root")], "host string, symbol string, reason string")
    outcome = lambda a: {r.config: r.outcome for r in rules.apply_policy(p, a, lb).collect()}
    assert outcome("advise") == {"CONFIG_A": "auto_applied", "CONFIG_B": "needs_review", "CONFIG_C": "blocked"}
    assert outcome("explain") == {"CONFIG_A": "annotation", "CONFIG_B": "annotation", "CONFIG_C": "blocked"}
    assert outcome("auto-bold")["CONFIG_B"] == "needs_review"


def test_orphans_and_scans(spark):
    make = "obj-$(CONFIG_A) += a.o \\\n  b.o\nLIST := l.o\nobj-y += $(LIST)\nhostprogs := tool comp\ncomp-objs := c.o\ntargets += off.s\n"
    t = spark.createDataFrame([(1, "d/Makefile", make)], "tree long, path string, text string")
    assert {r.stem for r in builds.indirect_sources(t).collect()} == {"d/a", "d/b", "d/l", "d/tool", "d/off"}
    lines = {(r.line_no, r.symbol, tuple(r.objects)) for r in builds.symbol_lines(t).collect()}
    assert lines == {(1, "CONFIG_A", ("a.o",))}


def test_cmdline(spark):
    df = spark.createDataFrame([("root=/dev/a quiet root=UUID=x=1 module_blacklist=a,b",)], "c string")
    params = df.select(hosts.cmdline_params(F.col("c")).alias("p")).first().p
    assert params == {"root": "UUID=x=1", "quiet": "", "module_blacklist": "a,b"}


def test_override_merge_reasons(spark):
    rows = [("s", 1, ["-a"], [], None, False, "one"), ("s", 2, ["-b", "-a"], ["-x"], "gcc", False, "two"), ("s", 3, [], [], None, True, "two")]
    df = spark.createDataFrame(rows, "source string, position long, strip_flags array<string>, add_flags array<string>, compiler string, use_stock boolean, reason string")
    r = pk.merge_overrides(df).first()
    assert (r.strip_flags, r.add_flags, r.compiler, r.use_stock, r.reason) == (["-a", "-b"], ["-x"], "gcc", True, "one + two + two")


def test_world_plan(spark):
    from optlake.plans.world import plan_world

    sources = spark.createDataFrame([
        ("gcc-14", "14", ["gcc", "libgcc"], ["libc"]), ("glibc", "2.40", ["libc"], ["gcc"]), ("zlib", "1.3", ["zlib1g"], ["libc", "nothere"]), ("app", "1", ["app", "app-x"], ["zlib1g", "app-x"]), ("alone", "1", ["al"], []),
    ], "source string, version string, binaries array<string>, build_depends array<string>")
    installed = spark.createDataFrame([("h", "gcc", "old-gcc", 900), ("h", "libc", "glibc", 900), ("h", "zlib1g", "zlib", 100), ("h", "app", "app", 500), ("h", "app-x", "app", 500), ("h", "stray", "gone", 5)], "host string, binary string, source string, installed_kb long")
    stock = spark.createDataFrame([("glibc", True)], "source string, use_stock boolean")
    got = {r.source: r for r in plan_world(installed, sources, stock).collect()}
    assert set(got) == {"gcc-14", "glibc", "zlib", "app"}
    waves, cycle = waves_by_hand({"gcc-14": {"glibc"}, "glibc": {"gcc-14"}, "zlib": {"glibc"}, "app": {"zlib"}})
    assert {s: r.wave for s, r in got.items()} == waves and {s for s, r in got.items() if r.in_cycle} == cycle
    assert {s: r.cost for s, r in got.items()} == {"gcc-14": "monster", "glibc": "heavy", "zlib": "tiny", "app": "normal"}
    assert [got["glibc"].use_stock, got["app"].use_stock, got["app"].binaries, got["app"].deps] == [True, False, 2, 1]


def test_choice_selection(spark):
    """The first member by position that is y, the group's first where none is, and nothing
    for a group that a configuration does not name."""
    from optlake.operators import lint

    choices = spark.createDataFrame([("A", "x", 3), ("A", "y", 1), ("A", "z", 2), ("B", "w", 1)], "choice string, member string, position int")
    values = spark.createDataFrame([(1, "x", "y"), (1, "z", "y"), (1, "y", "n"), (2, "x", "m"), (3, "w", None), (3, "other", "y")], "config_id long, symbol string, value string")
    got = {(r.config_id, r.choice): r.selected for r in lint.choice_selection(values, choices).collect()}
    assert got == {(1, "A"): "z", (2, "A"): "y", (3, "B"): "w"}


def test_list_files_of_globs(spark):
    import fnmatch

    paths = ["a/b.c", "a/b/c.h", "a/.git/x.c", "ab/c.c", "a", "z/[x].c", "a/b.c", None]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    listed = lambda **o: [r.path for r in lint.list_files(rows, **o).orderBy("path").collect()]
    named = sorted({p for p in paths if p})
    for globs in (["*.c"], ["a/?.c", "*[.]h"], ["[!a]*"], ["*"], ["none"]):
        assert listed(globs=globs) == [p for p in named if any(fnmatch.fnmatchcase(p, g) for g in globs)]
    assert listed(prefix="a/", skip=(".git",)) == ["a", "a/b.c", "a/b/c.h"]
    assert listed(prefix="ab/c.c") == ["ab/c.c"] and listed(limit=2) == named[:2]


def test_rejected_lines(spark):
    text = "# note\nCONFIG_A=y\n\nstray\nFOO=1\nCONFIG_B C=m\n# CONFIG_D is not set\n"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "config_id long, text string")
    got = [(r.config_id, r.line_no, r.line, r.reason) for r in configs.rejected_lines(rows).orderBy("config_id", "line_no").collect()]
    assert got == [(1, 4, "stray", "no assignment"), (1, 5, "FOO=1", "no option prefix"), (1, 6, "CONFIG_B C=m", "bad option name")]
