import itertools
import random

import numpy as np
import pytest

from optlake.operators import covers
from optlake.operators import guards as g
from optlake.plans import reports

NODES = "tree long, node_id string, op string, symbol string, want string, level int"
EDGES = "tree long, parent string, child string"


@pytest.fixture(scope="module")
def formulas():
    """Random formulas of depth up to 4 with shared nodes, as a node table and as Python."""
    rng = random.Random(11)
    nodes, edges, kids = {}, set(), {}
    for s in range(4):
        for w in ("y", "m", "undef"):
            nodes[f"S{s}={w}"] = ("eq", f"CONFIG_S{s}", w, 0)
    nodes["true"], nodes["false"] = ("true", None, None, 0), ("false", None, None, 0)
    for level in range(1, 5):
        for i in range(6):
            name, op = f"n{level}_{i}", rng.choice(["and", "or", "not"])
            below = [n for n, v in nodes.items() if v[3] < level]
            top = rng.choice([n for n, v in nodes.items() if v[3] == level - 1])
            mine = {top} if op == "not" else {top, *rng.sample(below, rng.randint(1, 3))}
            nodes[name], kids[name] = (op, None, None, level), mine
            edges |= {(name, k) for k in mine}

    def truth(name, values):
        op, symbol, want, _ = nodes[name]
        if op == "eq":
            v = values.get(symbol)
            return (v if v in ("y", "m") else "undef") == want
        if op in ("true", "false"):
            return op == "true"
        got = [truth(k, values) for k in kids[name]]
        return all(got) if op == "and" else any(got) if op == "or" else not got[0]

    return nodes, edges, truth


@pytest.fixture(scope="module")
def tables(spark, formulas):
    nodes, edges, _ = formulas
    n = spark.createDataFrame([(1, k, *v) for k, v in nodes.items()], NODES)
    e = spark.createDataFrame([(1, p, c) for p, c in edges], EDGES)
    return n, e, n.selectExpr("tree", "node_id AS guard_id")


def test_every_assignment(spark, formulas, tables):
    nodes, _, truth = formulas
    values, configs = [], []
    for i, combo in enumerate(itertools.product([None, "y", "m", "n", '"text"'], repeat=4)):
        assigned = {f"CONFIG_S{j}": v for j, v in enumerate(combo) if v is not None}
        configs.append((1, i, assigned))
        values += [(1, i, s, v) for s, v in assigned.items()]
    store = g.build_store(*tables)
    v = spark.createDataFrame(values, "tree long, config_id long, symbol string, value string")
    c = spark.createDataFrame([(t, i) for t, i, _ in configs], "tree long, config_id long")
    changed = g.changed_verdicts(v, store)
    on = {(r.config_id, r.guard_id) for r in g.guard_verdicts_on(c, changed, store).collect()}
    assert on == {(i, n) for _, i, assigned in configs for n in nodes if truth(n, assigned)}
    ever = {r.guard_id: r.ever for r in g.built_anywhere(c, changed, store).collect()}
    assert ever == {n: any((i, n) in on for _, i, _ in configs) for n in nodes}
    objects = spark.createDataFrame([(1, f"{n}/{k}.o", n) for n in nodes for k in range(2)], "tree long, path string, guard_id string")
    counts = {r.config_id: r.built for r in g.built_counts(c, objects, changed, store).collect()}
    for _, i, _ in configs:
        assert counts[i] == 2 * sum((i, n) in on for n in nodes)


def test_two_state_and_empty(spark, tables):
    store = g.build_store(*tables)
    v = spark.createDataFrame([(1, 1, "CONFIG_S0", "m")], "tree long, config_id long, symbol string, value string")
    on = lambda two: {r.guard_id for r in g.guard_verdicts_on(spark.createDataFrame([(1, 1)], "tree long, config_id long"), g.changed_verdicts(v, store, two), store).collect()}
    assert "S0=m" in on(False) and "S0=m" not in on(True) and "S0=undef" in on(True)
    assert g.changed_verdicts(v.where("value = 'x'"), store).count() == 0


def test_satisfiability_and_changes(spark, formulas, tables):
    nodes, _, truth = formulas
    every = [dict(zip([f"CONFIG_S{i}" for i in range(4)], c)) for c in itertools.product(["undef", "y", "m"], repeat=4)]
    got = {r.guard_id: r.status for r in g.satisfiability(*tables).collect()}
    for n in nodes:
        seen = {truth(n, a) for a in every}
        assert got[n] == ("mixed" if len(seen) == 2 else "always" if seen == {True} else "dead"), n
    names = [n for n, v in nodes.items() if v[3] >= 3]
    pairs = spark.createDataFrame([(1, a, b) for a, b in itertools.permutations(names[:4], 2)], "tree long, old string, new string")
    for r in g.condition_changes(tables[0], tables[1], pairs).collect():
        both = [(truth(r.old, a), truth(r.new, a)) for a in every]
        wider, tighter = all(b or not a for a, b in both), all(a or not b for a, b in both)
        want = "unchanged" if wider and tighter else "generalized" if wider else "restricted" if tighter else "diverged"
        assert r.change == want
        if want != "unchanged":
            a = dict(kv.split("=") for kv in r.witness.split())
            assert truth(r.old, a) != truth(r.new, a)


def test_formulas_of_many_options(spark):
    """Six levels over twelve options, with shared parts and forbidden values, against all
    531,441 assignments; witnesses are the first by number."""
    rng = random.Random(1)
    names = [f"CONFIG_S{i:02d}" for i in range(12)]
    grid = np.array(np.meshgrid(*[range(3)] * 12, indexing="ij")[::-1], dtype=np.int8).reshape(12, -1)
    nodes, edges, truth = {}, set(), {}
    for i, s in enumerate(names):
        for d, want in enumerate(("undef", "y", "m")):
            nodes[f"{s}={want}"], truth[f"{s}={want}"] = ("eq", s, want, 0), grid[i] == d
    for level in range(1, 7):
        for i in range(3):
            name, op = f"n{level}_{i}", rng.choice(["and", "or", "and", "or", "not"])
            top = rng.choice([n for n, v in nodes.items() if v[3] == level - 1])
            kids = {top} if op == "not" else {top, *rng.sample(sorted(k for k, v in nodes.items() if v[3] < level), rng.randint(1, 3))}
            nodes[name] = (op, None, None, level)
            edges |= {(name, k) for k in kids}
            got = np.array([truth[k] for k in kids])
            truth[name] = got.all(0) if op == "and" else got.any(0) if op == "or" else ~got[0]
    n = spark.createDataFrame([(1, k, *v) for k, v in nodes.items()], NODES)
    e = spark.createDataFrame([(1, p, c) for p, c in edges], EDGES)
    high = [k for k, v in nodes.items() if v[3] >= 5]
    guards = n.selectExpr("tree", "node_id AS guard_id").where("level >= 5")
    banned = [(s, v) for s in names[:6] for v in rng.sample(["y", "m"], rng.randint(0, 2))]
    free = np.ones(grid.shape[1], bool)
    for s, v in banned:
        free &= grid[names.index(s)] != ("undef", "y", "m").index(v)
    got = {(r.guard_id, r.domain): r.status for r in g.judged(n, e, guards, {"all": None, "some": spark.createDataFrame(banned, "symbol string, banned string")}).collect()}
    word = lambda x: "always" if x.all() else "mixed" if x.any() else "dead"
    assert got == {(k, d): word(truth[k][where]) for k in high for d, where in (("all", slice(None)), ("some", free))}
    pairs = spark.createDataFrame([(1, a, b) for a, b in itertools.permutations(high[:3], 2)], "tree long, old string, new string")
    for r in g.condition_changes(n, e, pairs).collect():
        a, b = truth[r.old], truth[r.new]
        lost, won = (a & ~b).any(), (b & ~a).any()
        assert r.change == {(True, True): "diverged", (True, False): "restricted", (False, True): "generalized", (False, False): "unchanged"}[bool(lost), bool(won)]
        first = np.flatnonzero(a != b)
        cells = [] if not len(first) else [f"{s}={('undef', 'y', 'm')[d]}" for s, d in zip(names, grid[:, first[0]]) if d]
        assert r.witness == (" ".join(cells) if len(first) else None)


def test_first_reviving_architecture(spark, tables):
    none = spark.createDataFrame([], "symbol string, banned string")
    no_s0 = spark.createDataFrame([("CONFIG_S0", "y"), ("CONFIG_S0", "m")], "symbol string, banned string")
    got = {r.guard_id: r.alive_on for r in reports.first_reviving(tables[0], tables[1], tables[2], {"arm": no_s0, "mips": none}).collect()}
    assert (got["S0=y"], got["S0=undef"], got["S1=m"], got["true"], got["false"]) == ("mips", "arm", "arm", "arm", None)


def test_pivotal(spark, formulas, tables):
    nodes, _, truth = formulas
    rng = random.Random(2)
    values = {i: {f"CONFIG_S{j}": rng.choice(["y", "m", "n"]) for j in range(4) if rng.random() < 0.7} for i in range(12)}
    asks = [(1, i, n) for i, a in values.items() for n in nodes if nodes[n][3] >= 2 and not truth(n, a)]
    rows = [(1, i, s, v) for i, a in values.items() for s, v in a.items()]
    got = {(r.config_id, r.guard_id, r.symbol): r.suggested_value for r in g.pivotal_options(
        spark.createDataFrame(asks, "tree long, config_id long, guard_id string"), spark.createDataFrame(rows, "tree long, config_id long, symbol string, value string"), tables[0], tables[1]).collect()}
    symbols = {r.guard_id: set() for r in tables[2].collect()}
    for r in g.guard_symbols(g.guard_leaves(*tables)).collect():
        symbols[r.guard_id].add(r.symbol)
    want = {}
    for _, i, n in asks:
        for s in symbols[n]:
            current = values[i].get(s, "n")
            for v in ("y", "m", "n"):
                if v != current and truth(n, {**values[i], s: v}):
                    want[(i, n, s)] = v
                    break
    assert got == want


def test_pivots_are_tried_once_a_case(spark, monkeypatch):
    """Equal formulas under equal values are one case, in whatever trees and configurations (F3, F5)."""
    seen, real = [], g._pivots
    monkeypatch.setattr(g, "_pivots", lambda cases, store: (seen.append(cases.count()), real(cases, store))[1])
    trees = range(20)
    nodes = [(t, *n) for t in trees for n in (("A=y", "eq", "A", "y", 0), ("B=m", "eq", "B", "m", 0), ("!B=m", "not", None, None, 1), (f"g{t}", "and", None, None, 2))]
    edges = [(t, p, c) for t in trees for p, c in (("!B=m", "B=m"), (f"g{t}", "A=y"), (f"g{t}", "!B=m"))]
    values = [(t, c, s, v) for t in trees for c, x in enumerate([{"A": "m"}, {"A": "y", "B": "m"}, {"B": "m"}]) for s, v in x.items()]
    asks = [(t, c, f"g{t}") for t in trees for c in range(3)] * 2
    got = g.pivotal_options(
        spark.createDataFrame(asks, "tree long, config_id int, guard_id string"), spark.createDataFrame(values, "tree long, config_id int, symbol string, value string"),
        spark.createDataFrame(nodes, "tree long, node_id string, op string, symbol string, want string, level int"), spark.createDataFrame(edges, "tree long, parent string, child string"))
    want = [(t, c, f"g{t}", *x) for t in trees for c, x in ((0, ("A", "m", "y")), (1, ("B", "m", "y")))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and seen == [3]


def test_greedy_cover(spark):
    rng = random.Random(9)
    holds = {(t, c): {f"g{i}" for i in range(12) if rng.random() < 0.35} for t in range(3) for c in range(6)}
    weight = {(t, f"g{i}"): rng.randint(1, 4) for t in range(3) for i in range(12)}
    h = spark.createDataFrame([(t, c, x) for (t, c), gs in holds.items() for x in gs], "tree long, config_id long, guard_id string")
    w = spark.createDataFrame([(t, x, n) for (t, x), n in weight.items()], "tree long, guard_id string, n long")
    picks = covers.greedy_cover(h, w)
    got = {(r.tree, r.round): (r.config_id, r.gain) for r in picks.collect()}
    want = {}
    for t in range(3):
        left, step = set().union(*[holds[t, c] for c in range(6)]), 0
        while left:
            step += 1
            gain = {c: sum(weight[t, x] for x in holds[t, c] & left) for c in range(6)}
            best = max(range(6), key=lambda c: (gain[c], -c))
            want[t, step] = (best, gain[best])
            left -= holds[t, best]
    assert got == want
    last = covers.progression(picks, w).orderBy("tree", "round").collect()
    assert all(a.covered <= b.covered for a, b in zip(last, last[1:]) if a.tree == b.tree)


def test_directory_conjunction(spark):
    nodes = spark.createDataFrame([(1, "a", "eq", "CONFIG_A", "y", 0), (1, "d", "eq", "CONFIG_D", "y", 0), (1, "e", "eq", "CONFIG_E", "y", 0)], NODES)
    edges = spark.createDataFrame([], EDGES)
    objects = spark.createDataFrame([(1, "fs/ext2/x.o", "a"), (1, "top.o", "a")], "tree long, path string, guard_id string")
    dirs = spark.createDataFrame([(1, "fs/", "d"), (1, "fs/ext2/", "e"), (1, "fs/ext20/", "a")], "tree long, dir string, guard_id string")
    o, n, e = g.conjoin_directories(objects, dirs, nodes, edges)
    store = g.build_store(n, e, o.select("tree", "guard_id").distinct())
    v = spark.createDataFrame([(1, 1, "CONFIG_A", "y"), (1, 1, "CONFIG_D", "y"), (1, 2, "CONFIG_A", "y"), (1, 2, "CONFIG_D", "y"), (1, 2, "CONFIG_E", "y")], "tree long, config_id long, symbol string, value string")
    c = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "tree long, config_id long")
    built = {(r.config_id, r.path) for r in g.built_objects(c, o, g.changed_verdicts(v, store), store).collect()}
    assert built == {(1, "top.o"), (2, "top.o"), (2, "fs/ext2/x.o")}


def test_negative_cover(spark):
    rng = random.Random(21)
    holds = {(t, c): {f"g{i}" for i in range(8) if rng.random() < 0.8} for t in range(4) for c in range(5)}
    weight = {(t, f"g{i}"): rng.randint(1, 3) for t in range(4) for i in range(8)}
    h = spark.createDataFrame([(t, c, x) for (t, c), gs in holds.items() for x in gs], "tree long, config_id long, guard_id string")
    w = spark.createDataFrame([(t, x, n) for (t, x), n in weight.items()], "tree long, guard_id string, n long")
    configs = spark.createDataFrame(list(holds), "tree long, config_id long")
    picks = covers.greedy_cover(h, w)
    chosen = {}
    for r in picks.collect():
        chosen.setdefault(r.tree, set()).add(r.config_id)
    want = set()
    for t in range(4):
        present = set.intersection(*[holds[t, c] for c in chosen[t]])
        want |= {(t, c, x) for c in range(5) for x in present - holds[t, c]}
    off = covers.negative_holds(picks, h, w, configs)
    assert {(r.tree, r.config_id, r.guard_id) for r in off.collect()} == want
    assert all(r.gain > 0 for r in covers.greedy_cover(off, w).collect())


def test_formulas_are_searched_once(spark, formulas, tables, monkeypatch):
    """The same formulas in five trees: metrics and dead findings look under one guard of
    each formula, and every tree gets the answer."""
    from optlake.plans.explain import dead_findings

    many = lambda df: df.selectExpr("explode(array(1L, 2L, 3L, 4L, 5L)) AS t", "*").drop("tree").withColumnRenamed("t", "tree").select(*df.columns)
    nodes, edges, guards = (many(x) for x in tables)
    formulas_here = g.condition_hashes(*tables).select("hash").distinct().count()
    seen, search = [], g.guard_leaves

    def counted(n, e, asked):
        seen.append(asked.count())
        return search(n, e, asked)

    monkeypatch.setattr(g, "guard_leaves", counted)
    each = lambda df, *cols: sorted((r.guard_id, *[r[c] for c in cols]) for r in df.collect())
    one = each(g.guard_metrics(*tables), "degree", "height", "nodes")
    assert each(g.guard_metrics(nodes, edges, guards), "degree", "height", "nodes") == sorted(one * 5)
    options = spark.createDataFrame([("CONFIG_S0", True, "bool"), ("CONFIG_S1", False, "bool")], "symbol string, absent boolean, type string")
    one = each(dead_findings(tables[2], tables[0], tables[1], options), "cause", "severity")
    assert one and each(dead_findings(guards, nodes, edges, options), "cause", "severity") == sorted(one * 5)
    assert seen == [formulas_here] * 4
    below = {n: set() for n in formulas[0]}
    for p, c in sorted(formulas[1], key=lambda x: formulas[0][x[0]][3]):
        below[p] |= below[c] | ({formulas[0][c][1]} - {None})
    for r in g.guard_metrics(*tables).collect():
        assert r.degree == len(below[r.guard_id] | ({formulas[0][r.guard_id][1]} - {None}))


def test_holding_counts(spark, tables):
    """Counts equal the listed verdicts, also for a configuration that stands twice, one
    without values and one that only values name."""
    store = g.build_store(*tables)
    values = [(1, i, f"CONFIG_S{j}", v) for i, given in enumerate(["ym", "my", "yy", "", "m"]) for j, v in enumerate(given)]
    changed = g.changed_verdicts(spark.createDataFrame(values, "tree long, config_id long, symbol string, value string"), store)
    configs = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 3), (1, 4)], "tree long, config_id long")
    listed = {r.config_id: r["count"] for r in g.guard_verdicts_on(configs, changed, store).groupBy("config_id").count().collect()}
    counted = g.holding_counts(configs, changed, store)
    assert listed == {r.config_id: r.holds for r in counted.collect() if r.holds} and set(listed) == {0, 1, 2, 3, 4}
