"""Centroid clustering against plain Python, and its plan."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from starloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def plain(rows, clusters, rounds, size):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) as sorted rows."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    best = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(best(q)[1], []).append(q)
        for k, held in groups.items():
            centres[k] = [sum(x) // len(held) for x in zip(*held)]
    found = [(i, *best(q)[::-1]) for i, q in kept]
    total = {}
    for _, k, d in found:
        total[k] = total.get(k, 0) + d
    name = lambda k: hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()
    return sorted(((i, k, d, total[k], sum(total.values()), name(k)) for i, k, d in found), key=str)


def vectors(n, size, seed):
    rng = random.Random(seed)
    near = lambda x: math.floor(x * 256) / 256  # noqa: E731  exact as a float
    return [(i, [near(rng.gauss(i % 3, 0.7)) for _ in range(size)]) for i in range(n)]


def test_equals_plain_python(spark):
    rows = vectors(120, 64, 1)
    rows += [rows[0], rows[0], (None, rows[5][1]), (200, [0.0] * 64), (201, [-0.5] * 64)]
    rows += [(300, None), (301, [0.5] * 63), (302, [0.5] * 65), (303, [None] + [0.5] * 63), (304, [float("nan")] + [0.5] * 63), (305, [float("inf")] * 64), (306, [])]
    df = spark.createDataFrame([(i, v, None, "x") for i, v in rows], SCHEMA)
    got = sorted((tuple(r) for r in clustering.centroid_clusters(df).collect()), key=str)
    assert got == plain(rows, 8, 10, 64)


def test_ties_and_empty_clusters(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(5)] + [(9, [4.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    got = sorted((tuple(r) for r in clustering.centroid_clusters(df, clusters=4, rounds=3, components=2).collect()), key=str)
    assert got == plain(rows, 4, 3, 2)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.25, -0.75])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    assert sorted((tuple(r) for r in clustering.centroid_clusters(df, components=2).collect()), key=str) == plain(rows, 8, 10, 2)
    assert clustering.centroid_clusters(df.limit(0)).collect() == []


def test_a_component_too_large_stops(spark):
    df = spark.createDataFrame([(1, [2.0**20, 0.0], 0, "x")], SCHEMA)
    with pytest.raises(Exception, match="in size"):
        clustering.centroid_clusters(df, components=2).collect()


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors(20, 64, 2)], SCHEMA)
    whole = clustering.integers(df)
    found = whole.select(clustering.nearest([[0] * 64, [9] * 64])["cluster"].alias("cluster"), "q").groupBy("cluster").agg(F.sum(F.col("q")[0]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))
