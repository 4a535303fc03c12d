"""Tables stored by a key are joined and grouped where they lie."""

from pyspark.sql import functions as F

from optlake.catalog import registry, texts  # noqa: F401
from optlake.operators import assignments as a
from optlake.operators import covers, lint, scores
from optlake.operators import guards as g
from optlake.plans import scoreboard
from optlake.session import stored_by
from optlake.sources import store

KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_guards_of_stored_trees_are_judged_without_exchange(spark):
    before = {k: spark.conf.get(k) for k in KEYS}
    spark.conf.set(KEYS[0], "-1")
    try:
        trees = [None, *range(20)]
        nodes = [(t, n, op, s, w, lvl) for t in trees for n, op, s, w, lvl in (("A=y", "eq", "A", "y", 0), ("B=m", "eq", "B", "m", 0), ("g", "and", None, None, 1))]
        edges = [(t, "g", c) for t in trees for c in ("A=y", "B=m")]
        values = [(t, c, s, v) for t in trees for c in range(3) for s, v in (("A", "y"), ("B", "m" if c else "y"))]
        put = lambda rows, schema: stored_by(spark.createDataFrame(rows, schema), "tree")
        store = g.build_store(
            put(nodes, "tree long, node_id string, op string, symbol string, want string, level int"),
            put(edges, "tree long, parent string, child string"),
            put([(t, "g") for t in trees], "tree long, guard_id string"),
        )
        changed = g.changed_verdicts(put(values, "tree long, config_id int, symbol string, value string"), store)
        counts = changed.groupBy("tree", "config_id").agg(F.count_if("built").alias("n"))
        assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
        # a null tree meets none
        assert {tuple(r) for r in counts.collect()} == {(t, c, 1) for t in range(20) for c in (1, 2)}
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_stored_rows_are_the_rows(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (2, "b")]
    kept = stored_by(spark.createDataFrame(rows, "tree long, x string"), "tree")
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, rows))


def test_rounds_of_a_cover_move_no_rows(spark, monkeypatch):
    before, plans = {k: spark.conf.get(k) for k in KEYS}, []
    spark.conf.set(KEYS[0], "-1")

    def watched(df, key):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored_by(df, key)

    monkeypatch.setattr(covers, "stored_by", watched)
    try:
        put = lambda rows, schema: stored_by(spark.createDataFrame(rows, schema), "tree")
        holds = put([(t, c, x) for t in range(5) for c, x in ((1, "a"), (1, "b"), (2, "c"), (3, "c"))], "tree long, config_id long, guard_id string")
        weights = put([(t, x, 1) for t in range(5) for x in "abc"], "tree long, guard_id string, n long")
        picks = covers.greedy_cover(holds, weights)
        assert {tuple(r) for r in picks.collect()} == {(t, *p) for t in range(5) for p in ((1, 1, 2), (2, 2, 1))}
        assert len(plans) > 4 and not any("Exchange" in p for p in plans)
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_levels_read_what_lies_under_them_once(spark):
    nodes = [(1, n, op, s, w, lvl) for n, op, s, w, lvl in (("A=y", "eq", "A", "y", 0), ("B=m", "eq", "B", "m", 0), ("!B=m", "not", None, None, 1), ("sub", "or", None, None, 2), ("g", "and", None, None, 3))]
    edges = [(1, p, c) for p, c in (("!B=m", "B=m"), ("sub", "A=y"), ("sub", "B=m"), ("g", "sub"), ("g", "!B=m"), ("g", "A=y"))]
    n = spark.createDataFrame(nodes, "tree long, node_id string, op string, symbol string, want string, level int")
    e = spark.createDataFrame(edges, "tree long, parent string, child string")
    guards = spark.createDataFrame([(1, "g"), (1, "sub"), (1, "A=y")], "tree long, guard_id string")
    store = g.build_store(n, e, guards)
    # one row for each edge; nothing is lifted level by level
    assert [s.count() for s in store.steps] == [1, 2, 3]
    assert {(r.parent, r.node) for s in store.steps for r in s.collect()} == {(p, c) for _, p, c in edges}
    values = spark.createDataFrame([(1, 1, "A", "y"), (1, 2, "B", "m"), (1, 3, "A", "y"), (1, 3, "B", "m")], "tree long, config_id long, symbol string, value string")
    got = {(r.config_id, r.guard_id, r.built) for r in g.changed_verdicts(values, store).collect()}
    assert got == {(1, "g", True), (1, "sub", True), (1, "A=y", True), (2, "sub", True), (3, "sub", True), (3, "A=y", True)}
    sizes = {r.guard_id: (r.degree, r.height, r.nodes) for r in g.guard_metrics(n, e, guards).collect()}
    assert sizes == {"g": (2, 3, 7), "sub": (2, 2, 3), "A=y": (1, 1, 1)}


def test_views_of_a_tree_move_no_rows(spark, tmp_path):
    from optlake.catalog import guards as _  # noqa: F401
    from optlake.catalog.registry import VIEWS, with_views

    before = {k: spark.conf.get(k) for k in KEYS}
    spark.conf.set(KEYS[0], "-1")
    try:
        rows = [(t, f"net/d{p % 3}/f{p}.o", f"g{p % 97}", p % 97) for t in (None, 1, 2) for p in range(90, 110)]
        objects = stored_by(spark.createDataFrame(rows, "tree long, path string, guard_id string, gnum long"), "tree")
        objects.createOrReplaceTempView("v_objects")
        stored_by(spark.sql(VIEWS["v_guards"][0]), "tree").createOrReplaceTempView("v_guards")
        for name in ("v_guard_nodes", "v_dirs"):
            text = with_views(VIEWS[name][0], 0, ("v_objects", "v_guards"))
            assert "Exchange" not in spark.sql(text)._jdf.queryExecution().executedPlan().toString(), name
            # the checking text, where Spark can run it, has the same rows
            check = VIEWS[name][1].replace("v_literals", "(" + with_views(VIEWS["v_literals"][0], 0, ("v_objects", "v_guards")) + ")")
            assert sorted(map(repr, map(tuple, spark.sql(text).collect()))) == sorted(map(repr, map(tuple, spark.sql(check).collect()))), name
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
        for name in ("v_objects", "v_guards"):
            spark.catalog.dropTempView(name)


def test_sides_of_configurations_meet_where_their_trees_lie(spark):
    before = {k: spark.conf.get(k) for k in KEYS}
    spark.conf.set(KEYS[0], "-1")
    try:
        put = lambda rows, schema: stored_by(spark.createDataFrame(rows, schema), "tree")
        configs = [(t, 10 * t + c) for t in range(5) for c in range(3)]
        listed, rows = put(configs, "tree long, config_id long"), "tree long, config_id long, path string"
        objects = put([(t, f"{p}.o") for t in range(5) for p in range(4)] * 2, "tree long, path string")
        each = scores.sided(listed.join(objects.where("path < '3'"), "tree"), listed.join(objects.where("path > '0.o'"), "tree"), listed)
        assert "Exchange" not in each._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, each.collect())) == sorted((c, f"{p}.o", p < 3, p > 0) for _, c in configs for p in range(4))
        # an id under several trees, one of them null, is one configuration
        p, k = [(1, 7, "a"), (None, 7, "b"), (1, None, "c"), (1, 8, "a")], [(2, 7, "a"), (2, 7, "b"), (2, None, "c"), (None, 8, "d")]
        found = scoreboard.build_difference(put(p, rows), put(k, rows), put([r[:2] for r in p + k], "tree long, config_id long"))
        assert sorted(map(tuple, found.collect())) == [(8, "a", "prediction only"), (8, "d", "build only")]
        sizes = scores.set_sizes(put(p, rows), put(k, rows), put([r[:2] for r in p + k], "tree long, config_id long"))
        assert {tuple(r) for r in sizes.collect()} == {("both", 3), ("predicted only", 1), ("either", 5)}
    finally:
        for key, x in before.items():
            spark.conf.set(key, x)


def test_reports_are_packed_and_read_back(spark, tmp_path):
    rows = [(t, v, "x" * 50) for t in range(500) for v in "ab"]
    store.write_report(spark.createDataFrame(rows, "t long, view string, x string"), f"{tmp_path}/r", ["view"])
    assert not list(tmp_path.glob("r/view=*/*.json"))
    assert sum(f.stat().st_size for f in tmp_path.glob("r/view=*/*.json.gz")) < 20_000
    back = spark.read.schema("t long, view string, x string").json(f"{tmp_path}/r").select("t", "view", "x")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_build_files_are_put_together_where_their_lines_lie(spark):
    before = {k: spark.conf.get(k) for k in KEYS}
    try:
        lines = [(None if o == 3 else o % 2, o, 41, 1 if n % 2 else 6, n) for o in range(4) for n in (3, 1, 2)]
        stored_by(spark.createDataFrame(lines, "tree long, l_orderkey long, l_partkey long, l_linenumber int, line_no int"), "l_orderkey").createOrReplaceTempView("v_lines")
        files = spark.sql(registry.with_views(registry.VIEWS["v_make_text"][0], 0, {"v_lines"}))
        assert files.columns == ["tree", "path", "text"]
        assert "Exchange" not in files._jdf.queryExecution().executedPlan().toString()
        odd, even = "obj-$(CONFIG_S1) += f41.o sub41/g-x.o CONFIG_S1", "obj-y += $(LIST_A) $(NOPE)"
        want = {(None if o == 3 else o % 2, f"drivers/o{o}/Makefile", "\n".join((odd, even, odd))) for o in range(4)}
        assert {tuple(r) for r in files.collect()} == want
    finally:
        spark.catalog.dropTempView("v_lines")
        for k, x in before.items():
            spark.conf.set(k, x)


def test_small_files_of_many_rows_are_not_broadcast(spark):
    """A file of a few words is small, its rows are not (F2)."""
    rows = stored_by(spark.range(3_000_000).selectExpr("id % 50 AS tree", "concat('a word of a thousand, ', hash(id) % 1000) AS word"), "tree")
    plan = rows.join(rows.select("tree", F.col("word").alias("other")), "tree")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_lost_load_bearing_of_odd_pairs(spark):
    """Configurations that stand under several trees or twice, nulls, options that are off or missing."""
    pairs = spark.createDataFrame([(1, 10, 11), (1, 11, None), (2, 10, 12), (2, 10, 12), (None, 13, 14), (3, None, 15)], "tree long, merge_id long, next_id long").withColumn("base_id", F.col("merge_id"))
    literals = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "C"), (2, "D"), (None, "A"), (3, "A"), (1, None)], "tree long, symbol string")
    base = spark.createDataFrame([(10, "A", "y"), (10, "B", "n"), (10, "C", "m"), (10, "D", "y"), (10, "D", "y"), (10, "E", "y"), (13, "A", "y"), (10, None, "y")], "merge_id long, symbol string, value string")
    after = spark.createDataFrame([(10, "A", "m"), (10, "C", "n")], "merge_id long, symbol string, value string")
    bearing = a.bearing_symbols(pairs, literals, base)
    assert sorted(map(tuple, bearing.select("merge_id", "symbol").collect())) == [(10, "A"), (10, "C"), (10, "D")]
    assert sorted(map(tuple, a.lost_load_bearing(bearing, base, after).select("merge_id", "symbol", "actual").collect())) == [(10, "C", "n"), (10, "D", "missing")]


def test_sources_by_tree_stay_where_they_are(spark):
    """Only what reaches the sources of a tree is moved (F13, F16); null trees are reached by nothing."""
    before = {k: spark.conf.get(k) for k in KEYS}
    spark.conf.set(KEYS[0], "-1")
    try:
        trees = [None, *range(8)]
        put = lambda rows, schema: spark.createDataFrame(rows, schema)
        sources = stored_by(put([(t, f"drivers/{x}.c") for t in trees for x in ("a", "b", "c", "w/d", "e")], "tree long, path string"), "tree")
        left = lint.orphan_sources(
            sources, put([(t, "drivers/a.o") for t in trees], "tree long, path string"), put([(t, "b.c") for t in trees], "tree long, name string"),
            put([(t, "drivers/w") for t in trees], "tree long, dir string"), put([(1, "drivers/c"), (1, "drivers/c")], "tree long, stem string"), "x86")
        assert left._jdf.queryExecution().executedPlan().toString().count("Exchange") == 4
        want = [(t, f"drivers/{x}.c") for t in range(8) for x in ("c", "e") if (t, x) != (1, "c")] + [(None, f"drivers/{x}.c") for x in ("a", "b", "c", "w/d", "e")]
        assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, want))
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
