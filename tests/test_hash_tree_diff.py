"""Keyed diff by digests, exact tolerances, declared joins and unique sides."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from starloom.operators import joins as j
from starloom.operators import metadata as m
from starloom.operators import reconcile as r
from starloom.plans.semantic import Measure, Pivot, SemanticModel
from tests.conftest import rows

CONTRACT = r.ResultContract({"k": r.ColumnRule("integer", False), "v": r.ColumnRule("integer"), "s": r.ColumnRule("string")}, ["k"])


def plain(expected, actual):
    """(k, kind, column) by dictionaries of lists."""
    def held(side):
        out = {}
        for k, *values in side:
            out.setdefault(k, []).append(values)
        return out

    e, a, found = held(expected), held(actual), set()
    for k in e.keys() | a.keys():
        if k is None:
            found.add((k, "null_key", None))
        elif len(e.get(k, ())) > 1 or len(a.get(k, ())) > 1:
            found.add((k, "duplicate_key", None))
        elif k not in a:
            found.add((k, "missing_key", None))
        elif k not in e:
            found.add((k, "extra_key", None))
        else:
            found |= {(k, "value_mismatch", c) for c, x, y in zip(("v", "s"), e[k][0], a[k][0]) if x != y}
    return found


def frame(spark, side):
    return spark.createDataFrame(side, "k long, v long, s string")


@pytest.mark.parametrize("seed", range(3))
def test_same_findings_as_dictionaries(spark, seed):
    rng = random.Random(seed)
    expected = [(i, rng.randrange(9), rng.choice(["a", "", None])) for i in range(200)]
    actual = [row for row in expected if rng.random() > 0.03]
    actual += [(k, rng.randrange(9), "a") for k in rng.sample(range(400), 8)] + [(None, 1, "n")] * 2
    got = {(x.k, x.kind, x.column_name) for x in r.keyed_diff(frame(spark, expected), frame(spark, actual), CONTRACT).collect()}
    assert got == plain(expected, actual)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_equal_sides_shuffle_digests_only(spark, tmp_path):
    """The plan that ran holds no join of rows and no exchange that carries a value."""
    df = frame(spark, [(i, i % 7, "text") for i in range(500)])
    for name in "ea":
        df.write.parquet(str(tmp_path / name))
    e, a = (spark.read.parquet(str(tmp_path / n)) for n in "ea")
    plan = final_plan(r.keyed_diff(e, a, CONTRACT))
    assert "EmptyRelation" in plan and not any(x in plan for x in ("Exchange", "SortMergeJoin", "first("))
    changed = a.withColumn("v", F.when(F.col("k") == 77, 99).otherwise(F.col("v")))
    assert rows(r.keyed_diff(e, changed, CONTRACT)) == [(77, "value_mismatch", "v", "0", "99")]
    few = r.differing_leaves(e, changed, CONTRACT)
    assert few.count() == 1


def test_a_repeated_key_is_found_on_equal_sides(spark):
    df = frame(spark, [(1, 1, "a"), (2, 2, "b"), (2, 2, "b")])
    assert rows(r.keyed_diff(df, df, CONTRACT)) == [(2, "duplicate_key", None, "2", "2")]


def test_numbers_of_unlike_types_meet(spark):
    e = frame(spark, [(i, i, "a") for i in range(50)])
    a = e.select(F.col("k").cast("int").alias("k"), F.col("v").cast("decimal(12,2)").alias("v"), "s")
    assert r.differing_leaves(*r._aligned(e, a, CONTRACT), CONTRACT).count() == 0
    assert r.keyed_diff(e, a, CONTRACT).collect() == []


def test_tolerances_are_decimals(spark):
    rng = random.Random(5)
    cases = [(Decimal(rng.randrange(-10**6, 10**6)) / 100, Decimal(rng.randrange(1, 500)) / 1000, Decimal(rng.randrange(0, 300)) / 100) for _ in range(40)] + [(Decimal(100), Decimal("0.29"), Decimal(0))]
    for kind, scale in (("decimal(18,5)", 5), ("long", 0)):
        for x, rel, least in cases:
            x = x.quantize(Decimal(1)) if scale == 0 else x
            allowed = max(least, rel * abs(x))
            for gap in {allowed, allowed + Decimal(1).scaleb(-scale), allowed.quantize(Decimal(1)), Decimal(0)}:
                if gap != gap.quantize(Decimal(1).scaleb(-scale)):
                    continue
                rule = r.ColumnRule("integer" if scale == 0 else "decimal", abs_tolerance=float(least), rel_tolerance=str(rel))
                df = spark.range(1).select(F.lit(x).cast(kind).alias("x"), F.lit(x + gap).cast(kind).alias("y"))
                kinds = (df.schema["x"].dataType, df.schema["y"].dataType)
                # Folded by the optimiser: no job runs per case.
                got = df.select(r.within_tolerance(F.lit(x).cast(kind), F.lit(x + gap).cast(kind), rule, kinds).alias("t"))
                assert f"[{str(gap <= allowed).lower()} AS t" in got._jdf.queryExecution().optimizedPlan().toString(), (x, rel, least, gap)


def test_a_tolerance_beyond_exact_digits_is_refused(spark):
    e = spark.createDataFrame([(1, Decimal(1))], "k long, v decimal(38,10)")
    contract = r.ResultContract({"k": r.ColumnRule("integer", False), "v": r.ColumnRule("decimal", rel_tolerance=0.001)}, ["k"])
    with pytest.raises(ValueError, match="digits"):
        r.keyed_diff(e, e, contract)


@pytest.fixture(scope="module")
def family(spark):
    return {
        "o": spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, n string"),
        "l": spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "ok long, lid long"),
        "p": spark.createDataFrame([(1, 5), (1, 6), (3, 7)], "ok long, pid long"),
        "d": spark.createDataFrame([(10, 1), (10, 2), (12, 3)], "lid long, did long")}


EDGES = [j.Edge("o", "l", ("k",), ("ok",), relationship="one_to_many"), j.Edge("o", "p", ("k",), ("ok",), relationship="one_to_many"), j.Edge("l", "d", ("lid",), ("lid",), relationship="one_to_many")]


def test_several_one_to_many_edges(family):
    tree = j.join_tree(family, "o", EDGES, ["l", "p", "d"])
    got = rows(tree.select("o__k", "l__lid", "p__pid", "d__did"))
    lines, payments, details = {1: [10, 11], 2: [12]}, {1: [5, 6], 3: [7]}, {10: [1, 2], 12: [3]}
    want = [(k, x, y, z) for k in (1, 2, 3) for x in lines.get(k, [None]) for y in payments.get(k, [None]) for z in details.get(x, [None])]
    assert got == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("view, key", [("o", "k"), ("l", "lid")])
def test_each_parent_is_checked_on_its_own_rows(family, view, key):
    doubled = {**family, view: family[view].unionByName(family[view].limit(1))}
    with pytest.raises(Exception, match=f"{view} not unique"):
        j.join_tree(doubled, "o", EDGES, ["d"]).collect()


def test_null_keys_may_repeat_on_the_one_side(spark):
    right = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k long, v string")
    left = spark.createDataFrame([(1,), (None,)], "k long")
    df = j.join_many_to_one(left, right, ["k"])
    assert rows(df) == [(1, "a"), (None, None)]
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_reuse_needs_all_measures_and_dimensions(spark):
    assets = spark.createDataFrame([("a1", "day", ["x", "y"]), ("a2", "day", ["y", "x"]), ("a3", "week", ["x"]), ("a4", "TBD", ["x"]), ("a5", "week", [" Unknown"]), ("a6", "month", [])], "asset_id string, grain string, filters array<string>")
    sale = lambda a, e="sum(v)", i="m": (a, i, e, "sum", "additive")
    measures = spark.createDataFrame([sale("a1"), sale("a2", i="m2"), sale("a3"), sale("a4"), sale("a6", "tbd")], "asset_id string, measure_id string, expression string, aggregation string, additivity string")
    models = spark.createDataFrame([("M", "day", ["x", "y"]), ("N", "week", ["x"])], "model_id string, grain string, filters array<string>")
    assert rows(m.unknown_contracts(assets, measures)) == [("a4",), ("a5",), ("a6",)]

    def told(have, dims=()):
        held = spark.createDataFrame(have, "model_id string, measure_id string, expression string, aggregation string, additivity string")
        asked = spark.createDataFrame([("a1", "region"), ("a3", "region")], "asset_id string, dimension string")
        shown = spark.createDataFrame(list(dims), "model_id string, dimension string")
        return {x.n_measures: x.disposition for x in m.shared_contract_groups(assets, measures, models, held, asked, shown).collect()}

    both = [sale("M"), sale("M", i="m2"), sale("N")]
    dims = [("M", "region"), ("N", "region")]
    assert told(both, dims) == {2: "reuse_candidate", 1: "reuse_candidate"}
    assert told([sale("M"), sale("N", "avg(v)")], dims) == {2: "shared_aggregate_candidate", 1: "keep_separate"}
    assert told(both, [("N", "region")]) == {2: "shared_aggregate_candidate", 1: "reuse_candidate"}


def test_fill_keeps_rows_without_a_day_and_other_dimensions(spark):
    e = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-03", "a"), ("2024-01-03", None), (None, "a"), (None, None)], "d string, kind string").withColumn("d", F.col("d").cast("date"))
    model = SemanticModel(base="e", views={"e": e}, measures={"n": Measure("count")})
    one = model.query({"day": "e__d"}, {"n": "n"}, fill="day")
    assert rows(one.select(F.col("day").cast("string"), "n")) == [("2024-01-01", 1), ("2024-01-02", 0), ("2024-01-03", 2), (None, 2)]
    two = model.query({"kind": "e__kind", "day": "e__d"}, {"n": "n"}, fill="day")
    want = [("a", "2024-01-01", 1), ("a", "2024-01-02", 0), ("a", "2024-01-03", 1), ("a", None, 1), (None, "2024-01-01", 0), (None, "2024-01-02", 0), (None, "2024-01-03", 1), (None, None, 1)]
    assert rows(two.select("kind", F.col("day").cast("string"), "n")) == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_pivot_refuses_columns_that_collide_or_are_too_many(spark):
    e = spark.createDataFrame([("a", "x", 1)], "g string, s string, v long")
    model = SemanticModel(base="e", views={"e": e}, measures={"t": Measure("sum", "e__v")})
    ask = lambda p: model.query({"g": "e__g", "s": "e__s"}, {"t": "t"}, pivot=p)
    with pytest.raises(ValueError, match="differ"):
        ask(Pivot("s", ["x", "other"]))
    with pytest.raises(ValueError, match="allowed"):
        ask(Pivot("s", ["x", "y"], limit=2))
    assert rows(ask(Pivot("s", ["x", "y"], limit=3))) == [("a", 1, None, None)]
