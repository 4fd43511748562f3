"""Reach and depth with contracted chains, against a plain breadth-first search."""

import random
from collections import deque

import pytest

from starloom.operators import lineage
from tests.conftest import rows


def plain(edges, seeds):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    depth, queue = {s: 0 for s in seeds}, deque(seeds)
    while queue:
        n = queue.popleft()
        for m in after.get(n, ()):
            if m not in depth:
                depth[m] = depth[n] + 1
                queue.append(m)
    return depth


def got(spark, edges, seeds):
    e = spark.createDataFrame(edges, "source_id long, target_id long")
    return {r.node_id: r.depth for r in lineage.closure(e, spark.createDataFrame([(s,) for s in seeds], "n long")).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_with_chains_and_rings(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(30)]
    for k in range(4):  # chains between nodes of the graph, one of them short-circuited, one a ring of its own
        path = [rng.randrange(25), *range(100 * (k + 1), 100 * (k + 1) + rng.randrange(2, 12)), rng.randrange(25)]
        edges += list(zip(path, path[1:]))
    ring = list(range(900, 907))
    edges += list(zip(ring, ring[1:] + ring[:1]))
    seeds = [rng.randrange(25), 102, 5000]
    assert got(spark, edges, seeds) == plain(edges, seeds)


def test_a_ring_with_a_seed_and_repeated_edges(spark):
    edges = [(i, (i + 1) % 9) for i in range(9)] * 2 + [(4, 4)]
    assert got(spark, edges, [3]) == plain(edges, [3])
    assert got(spark, [], [1, 2]) == {1: 0, 2: 0}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    real = lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: rounds.append(1) or real(df))
    e = spark.range(n).selectExpr("id AS source_id", "id + 1 AS target_id")
    out = lineage.closure(e, spark.createDataFrame([(0,)], "n long"))
    assert out.where("depth = node_id").count() == out.count() == n + 1
    assert len(rounds) <= 24  # 14 jumps and a few steps around them


def left_over(edges):
    """Nodes left when nodes without incoming edges are removed until there are none."""
    held = set(edges)
    while True:
        fed = {b for _, b in held}
        rest = {(a, b) for a, b in held if a in fed}
        if rest == held:
            return fed
        held = rest


@pytest.mark.parametrize("seed", range(4))
def test_cyclic_nodes_of_random_graphs(spark, seed):
    rng = random.Random(100 + seed)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(18)]
    for k in range(3):
        path = [rng.randrange(20), *range(100 * (k + 1), 100 * (k + 1) + rng.randrange(1, 9)), rng.randrange(20)]
        edges += list(zip(path, path[1:]))
    edges += [(900, 901), (901, 902), (902, 900), (950, 950), (902, 903), (903, 904)]
    e = spark.createDataFrame(edges, "source_id long, target_id long")
    assert {r.node_id for r in lineage.cyclic_nodes(e).collect()} == left_over(edges)


def test_no_cycles(spark, monkeypatch):
    assert lineage.cyclic_nodes(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "source_id long, target_id long")).collect() == []
    assert lineage.cyclic_nodes(spark.createDataFrame([], "source_id long, target_id long")).collect() == []
    rounds, real = [], lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: rounds.append(1) or real(df))
    assert lineage.cyclic_nodes(spark.range(5_000).selectExpr("id AS source_id", "id + 1 AS target_id")).collect() == []
    assert len(rounds) <= 26


def test_shallow_graph_is_searched_without_contracting(spark, monkeypatch):
    """Four levels, repeated edges, a ring, an edge to itself and null ends; contracting costs passes over all edges."""
    pairs = [(1, 2), (1, 2), (2, 3), (3, 1), (3, 4), (2, 4), (4, 4), (4, 5), (9, 8), (None, 5), (5, None)]
    edges = spark.createDataFrame(pairs, "source_id long, target_id long")
    seeds = spark.createDataFrame([(1,), (1,), (7,)], "node_id long")
    monkeypatch.setattr(lineage, "_contracted", None)
    assert rows(lineage.closure(edges, seeds)) == [(1, 0), (2, 1), (3, 2), (4, 2), (5, 3), (7, 0)]


def test_deep_graph_goes_on_where_the_plain_rounds_end(spark):
    """A long chain with short cuts and a branch that meets it again, against a plain search."""
    n = 60
    pairs = [(i, i + 1) for i in range(n)] + [(3, 20), (12, 40), (40, 2), (9, 100), (100, 101), (101, 30), (59, 0), (200, 5), (50, 50)]
    adjacent: dict[int, list[int]] = {}
    for a, b in pairs:
        adjacent.setdefault(a, []).append(b)
    depth, todo = {0: 0, 60: 0}, [0, 60]
    for a in todo:
        for b in adjacent.get(a, []):
            if b not in depth:
                depth[b] = depth[a] + 1
                todo.append(b)
    edges = spark.createDataFrame(pairs + pairs[:9], "source_id long, target_id long")
    found = lineage.closure(edges, spark.createDataFrame([(0,), (60,)], "node_id long"))
    assert found.schema["depth"].dataType.simpleString() == "int"
    assert max(depth.values()) > lineage.PLAIN_ROUNDS
    assert sorted(map(tuple, found.collect())) == sorted(depth.items())
