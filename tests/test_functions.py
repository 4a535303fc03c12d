import itertools
import random
import statistics

from pyspark.sql import functions as F

from optlake.functions import globs, paths, tristate, values
from optlake.functions.median import median, middle_values
from optlake.functions.versions import debian_key


def test_tristate_all_pairs(spark):
    pairs = list(itertools.product(range(3), range(3)))
    df = spark.createDataFrame(pairs, "a int, b int")
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        "a", "b", tristate.tri_and(a, b).alias("both"), tristate.tri_or(a, b).alias("either"), tristate.tri_not(a).alias("inv"),
        tristate.is_unmet(a, b).alias("unmet"), tristate.is_unmet_bool(a, F.lit(2), b).alias("unmet_bool"),
        tristate.from_dual(tristate.to_dual(a)).alias("back"), tristate.dual_ok(tristate.to_dual(a)).alias("ok"),
    ).collect()
    for r in rows:
        assert (r.both, r.either, r.inv, r.back, r.ok) == (min(r.a, r.b), max(r.a, r.b), 2 - r.a, r.a, True)
        assert r.unmet == (r.b < r.a)
        assert r.unmet_bool == (r.a >= 1 and r.b < 1)
    # a forced y over a limit of m is the case the Boolean form misses
    assert {(r.a, r.b) for r in rows if r.unmet and not r.unmet_bool} == {(2, 1)}


def test_debian_order(spark):
    order = ["0", "0.1~~", "0.1~", "0.1~rc1", "0.1", "0.1a", "0.1+b", "0.1.1", "0.9", "0.10", "1.0~rc1-1", "1.0-0.1", "1.0-1~bpo1", "1.0-1", "1.0-1ubuntu1", "1.0-10", "1.0+dfsg-1",
             "2", "10", "99999999999999999999", "100000000000000000000", "1:0.1", "2:0"]
    shuffled = order[:]
    random.Random(3).shuffle(shuffled)
    df = spark.createDataFrame([(v,) for v in shuffled], "v string")
    got = [r.v for r in df.orderBy(debian_key(F.col("v"))).collect()]
    assert got == order
    same = spark.createDataFrame([("1.0-0", "1.0"), ("0:1.0", "1.0"), ("1.01", "1.1"), ("1.00", "1.0")], "a string, b string")
    assert all(r[0] for r in same.select(debian_key(F.col("a")) == debian_key(F.col("b"))).collect())


def test_globs(spark):
    cases = [("pci:v*d?", "pci:v12d3", True), ("pci:v*d?", "pci:v12d", False), ("a[0-2]c", "a1c", True), ("a[!0-2]c", "a1c", False), ("a.c", "abc", False), ("a[b", "a[b", True), ("(x)+$", "(x)+$", True), ("*", "", True)]
    df = spark.createDataFrame(cases, "p string, s string, want boolean").withColumn("re", globs.shell_regex(F.col("p")))
    for r in df.select("p", "s", "want", F.expr("s RLIKE re").alias("got")).collect():
        assert r.got == r.want, r
    owner = spark.createDataFrame([("drivers/*/x?.c", "drivers/a/b/x1.c", True), ("a[b]", "a[b]c", True), ("a.c", "abc", False)], "p string, s string, want boolean")
    for r in owner.withColumn("re", globs.owner_regex(F.col("p"))).select("want", F.expr("s RLIKE re").alias("got")).collect():
        assert r.got == r.want


def test_values(spark):
    df = spark.createDataFrame([("0x10",), ("16",), ("-3",), ("y",), ("",), ('"a b"',), ('"',)], "v string")
    rows = df.select("v", values.as_number(F.col("v")).alias("n"), values.strip_quotes(F.col("v")).alias("s"), values.or_off(F.col("v")).alias("o"), values.switch(F.col("v")).alias("w")).collect()
    assert [r.n for r in rows] == [16, 16, -3, None, None, None, None]
    assert [r.s for r in rows][-2:] == ["a b", '"']
    assert [r.o for r in rows][4] == "n" and [r.w for r in rows] == ["n", "n", "n", "y", "n", "n", "n"]


def test_proposal_lines(spark):
    cases = [("CONFIG_HZ_1000", "HZ_1000", "CONFIG_HZ_1000=y"), ("CONFIG_HZ", "250", "CONFIG_HZ=250"), ("CONFIG_A", "0x1f", "CONFIG_A=0x1f"), ("CONFIG_A", "n", "# CONFIG_A is not set"), ("CONFIG_L", "-custom", 'CONFIG_L="-custom"')]
    df = spark.createDataFrame(cases, "s string, v string, want string")
    for r in df.select("want", values.proposal_line(F.col("s"), F.col("v")).alias("got")).collect():
        assert r.got == r.want


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../x",)], "p string")
    assert [r[0] for r in df.select(paths.fold(F.col("p"))).collect()] == ["a/c", "../x", "../x"]
    df = spark.createDataFrame([("arch/x86/um/a.c",), ("arch/x86/a.c",), ("tools/a.c",), ("mm/a.c",), ("arch/arm/a.c",)], "p string")
    assert [r[0] for r in df.select(paths.in_scope(F.col("p"), "x86")).collect()] == [False, True, False, True, False]
    df = spark.createDataFrame([("arch/Kconfig",), ("arch/arm/Kconfig",), ("drivers/Kconfig",), ("arch/Kconfig.debug",)], "p string")
    assert [r[0] for r in df.select(paths.arch_of(F.col("p"))).collect()] == [None, "arm", None, None]


def test_median_matches_python(spark):
    rng = random.Random(5)
    groups = {k: [rng.choice([rng.random() * 100, 7.0, -3.5]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 999), ("d", 1000), ("e", 5))}
    groups["e"] = [4.0] * 5
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r["median"] for r in median(df, ["k"], "v").collect()}
    for k, vs in groups.items():
        assert abs(got[k] - statistics.median(vs)) < 1e-12
    upper = {r.k: r.upper for r in middle_values(df, ["k"], "v").collect()}
    assert upper == {k: sorted(vs)[len(vs) // 2] for k, vs in groups.items()}
    assert median(df.where("k = 'zz'"), ["k"], "v").count() == 0
