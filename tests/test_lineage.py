import random

import pytest

from starloom.operators import lineage as g


def graph(seed, n=60, m=70):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "source_id long, target_id long")


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    edges = graph(seed) + [(100, i) for i in range(101, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node_id: r.component for r in g.components(frame(spark, edges)).collect()}
    assert got == {x: find(x) for x in parent}


def test_cyclic_nodes(spark):
    edges = graph(5, n=40, m=45)
    rest = set(edges)
    while True:
        fed = {b for _, b in rest}
        kept = {(a, b) for a, b in rest if a in fed}
        if kept == rest:
            break
        rest = kept
    assert {r.node_id for r in g.cyclic_nodes(frame(spark, edges)).collect()} == {b for _, b in rest}


def test_no_cycle_gives_no_rows(spark):
    assert g.cyclic_nodes(frame(spark, [(1, 2), (2, 3), (1, 3)])).count() == 0


def test_closure_and_depth(spark):
    edges = [(1, 2), (2, 3), (3, 1), (1, 4), (9, 1)]
    got = {r.node_id: r.depth for r in g.closure(frame(spark, edges), spark.createDataFrame([(1,)], "n long")).collect()}
    assert got == {1: 0, 2: 1, 4: 1, 3: 2}


def test_prune_until_stable(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "item_id long")
    needs = spark.createDataFrame([(1, 99), (2, 1), (3, 2), (5, 4)], "item_id long, needs_id long")
    assert {r.item_id for r in g.prune_dependents(items, needs).collect()} == {4, 5}


def test_propagate_reaches_a_fixpoint_on_a_cycle(spark):
    nodes = spark.createDataFrame([(1, 3, 1), (2, 1, 2), (3, 2, 4)], "node_id long, level int, cats int")
    done = g.propagate(nodes, frame(spark, [(1, 2), (2, 3), (3, 2)]), {"level": "max", "cats": "bit_or"})
    assert {r.node_id: (r.level, r.cats) for r in done.collect()} == {1: (3, 1), 2: (3, 7), 3: (3, 7)}


def test_hub_edges_are_linear(spark):
    maps = spark.createDataFrame([("m", ["a", "b", "c"], ["x", "y"])], "m string, s array<string>, t array<string>")
    assert g.hub_edges(maps, "m", "s", "t").count() == 5


def test_tree_diagnostics_of_odd_trees(spark):
    nodes = [
        (1, "a", None, ["a"]), (1, "b", "a", ["a", "b"]), (1, "c", "b", ["a", "b", "c"]),  # complete
        (2, "a", None, ["a"]), (2, "b", "a", ["x", "b"]), (2, "b", "a", ["a", "b"]), (2, "c", "gone", ["a", "c"]),  # wrong path, repeat, no parent
        (3, "a", None, ["a"]), (3, "b", None, None), (3, "c", "a", None), (3, "d", "a", []), (3, None, "a", ["a", "n"]),  # nulls
        (None, "a", None, ["a"])]
    edges = [(t, p, n) for t, n, p, _ in nodes if p is not None] + [(3, None, "c"), (4, "a", "b")]
    made = g.tree_diagnostics(
        spark.createDataFrame(nodes, "tree_id int, node_id string, parent_id string, path array<string>"),
        spark.createDataFrame(edges, "tree_id int, from_id string, to_id string"))
    assert {r[0]: tuple(r[1:]) for r in made.collect()} == {
        1: (3, 1, 0, 0, 2, 0, "complete"), 2: (4, 1, 2, 1, 3, 1, "failed"), 3: (5, 2, 2, 0, 4, 1, "failed"),
        None: (1, 1, 0, 0, 0, 0, "complete"), 4: (0, 0, 0, 0, 1, 1, "failed")}


def test_tree_diagnostics_of_nothing(spark):
    nodes = spark.createDataFrame([], "tree_id int, node_id string, parent_id string, path array<string>")
    assert g.tree_diagnostics(nodes, spark.createDataFrame([], "tree_id int, from_id string, to_id string")).count() == 0


def test_tree_diagnostics_against_brute_force(spark):
    """A hot parent, wrong claims and repeats, counted one by one."""
    nodes = [(t, "r", None, ["r"]) for t in range(2)]
    for i in range(600):
        parent = "r" if i % 3 else f"n{i % 40}"
        path = ["r", f"n{i % 200}"] if parent == "r" else ["r", parent, f"n{i % 200}"]
        nodes.append((i % 2, f"n{i % 200}", parent, path if i % 17 else ["?", *path[1:]]))
    edges = [(t, p, n) for t, n, p, _ in nodes if p is not None]
    smallest = {}
    for t, n, _, path in nodes:
        smallest[t, n] = min(path, smallest.get((t, n), path))
    made = g.tree_diagnostics(
        spark.createDataFrame(nodes, "tree_id int, node_id string, parent_id string, path array<string>"),
        spark.createDataFrame(edges, "tree_id int, from_id string, to_id string"))
    for r in made.collect():
        mine = [x for x in nodes if x[0] == r["tree_id"]]
        assert r["nodes"] == len(mine) and r["roots"] == 1 and r["duplicate_nodes"] == len(mine) - len({x[1] for x in mine})
        assert r["path_mismatches"] == sum(p is not None and smallest.get((t, p)) != path[:-1] for t, _, p, path in mine)
        assert r["unresolved_edges"] == sum((t, p) not in smallest for t, p, _ in edges if t == r["tree_id"])
        assert r["edges"] == len(mine) - 1


def test_tree_diagnostics_read_their_inputs_once(spark):
    from starloom.registry.lineage import tree_integrity

    plan = tree_integrity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 8  # region, nation, customer and its nation, for nodes and for edges


@pytest.mark.parametrize("seed", [3, 4])
def test_propagated_values_against_brute_force(spark, seed):
    """Cycles, a chain, repeated nodes, nulls and edges to ids that are no nodes."""
    rng = random.Random(seed)
    edges = [*graph(seed, 40, 45), *[(i, i + 1) for i in range(100, 125)], (0, 999), (998, 1), (7, 7)]
    nodes = [(i, rng.randrange(5), 1 << rng.randrange(4) if i % 6 else None) for i in [*range(40), *range(100, 126), 3]]
    top, bits = {}, {}
    for i, level, mask in nodes:
        top[i], bits[i] = max(level, top.get(i, 0)), (mask or 0) | bits.get(i, 0)
    for _ in range(80):
        for a, b in edges:
            if a in top and b in top:
                top[b], bits[b] = max(top[a], top[b]), bits[a] | bits[b]
    made = g.propagate(spark.createDataFrame(nodes, "node_id long, level int, bits int"), frame(spark, edges), {"level": "max", "bits": "bit_or"})
    assert sorted(map(tuple, made.collect())) == sorted((i, top[i], bits[i]) for i in top)


def test_rounds_write_what_changed(spark, monkeypatch):
    """A value that runs down a chain of 30 among 20,000 nodes: the rounds' tables hold some rows, not the nodes."""
    held = []
    real = g.cut_lineage

    def counted(df):
        out = real(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(g, "cut_lineage", counted)
    nodes = spark.range(20_000).selectExpr("id AS node_id", "CAST(id = 0 AS int) AS level")
    made = g.propagate(nodes, frame(spark, [(i, i + 1) for i in range(30)]), {"level": "max"})
    assert made.where("level = 1").count() == 31
    assert sum(held[2:]) <= 30 * 6  # after edges and nodes: 30 changes, each rewritten a logarithm of times
