import pytest
from pyspark.sql import functions as F

from starloom.operators import filters as f
from starloom.operators import reconcile as r
from starloom.plans import context as ctx
from starloom.plans.semantic import Calculation, Measure, Pivot, SemanticModel, Timed, select_fields
from tests.conftest import rows

CONTRACT = r.ResultContract({"k": r.ColumnRule("integer", False), "v": r.ColumnRule("decimal", abs_tolerance=1, rel_tolerance=0.1), "s": r.ColumnRule("string")}, ["k"])


def test_keyed_diff_tolerance_and_nulls(spark):
    e = spark.createDataFrame([(1, 100.0, "a"), (2, 100.0, None), (3, None, "c"), (4, 5.0, "d"), (None, 1.0, "n")], "k long, v double, s string")
    a = spark.createDataFrame([(1, 110.0, "a"), (2, 111.0, ""), (3, 0.0, "c"), (5, 5.0, "d"), (None, 1.0, "n")], "k long, v double, s string")
    got = {(x.k, x.kind, x.column_name) for x in r.keyed_diff(e, a, CONTRACT).collect()}
    assert got == {(2, "value_mismatch", "v"), (2, "value_mismatch", "s"), (3, "value_mismatch", "v"), (4, "missing_key", None), (5, "extra_key", None), (None, "null_key", None)}


def test_repeated_keys_are_refused_not_multiplied(spark):
    e = spark.createDataFrame([(1, 1.0, "a")] * 3 + [(2, 2.0, "b")], "k long, v double, s string")
    got = [tuple(x) for x in r.keyed_diff(e, e, CONTRACT).collect()]
    assert got == [(1, "duplicate_key", None, "3", "3")]
    assert r.diff_summary(r.keyed_diff(e, e, CONTRACT), "c", "correctness").first().refused_keys == 1


def test_empty_diff_still_reports(spark):
    e = spark.createDataFrame([(1, 1.0, "a")], "k long, v double, s string")
    assert r.diff_summary(r.keyed_diff(e, e, CONTRACT), "c", "correctness").first().passed


def test_missing_lane_is_pending(spark):
    e = spark.createDataFrame([(1, 1.0, "a")], "k long, v double, s string")
    lanes = r.parity_lanes(e, {"x": e, "y": None}, CONTRACT, "c")
    assert {x.lane: x.status for x in lanes.collect()} == {"x": "passed", "y": "pending"}
    assert r.parity_cases(lanes).first().status == "pending"


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("m1", "A", "posted", 10), ("m1", "B", "posted", 20), ("m1", "B", "draft", 5), ("m2", "A", "draft", 7), ("m2", "B", "posted", 30)],
        "month string, seg string, status string, c long")


def test_remove_keeps_visible_groups_only(sales):
    out = ctx.context_report(sales, ["month", "seg"], {"status": {"is": "posted"}, "seg": {"is": "A"}}, {
        "own": ctx.ContextMeasure("c"), "all_segs": ctx.ContextMeasure("c", (ctx.Change("remove", "seg"),))})
    assert rows(out) == [("m1", "A", 10, 30)]


def test_replace_on_a_grouped_field_repeats_the_value(sales):
    out = ctx.context_report(sales, ["status"], {}, {"own": ctx.ContextMeasure("c"), "posted": ctx.ContextMeasure("c", (ctx.Change("replace", "status", {"is": "posted"}),))})
    assert rows(out) == [("draft", 12, 60), ("posted", 60, 60)]


def test_intersect_with_nothing_is_blank(sales):
    out = ctx.context_report(sales, ["seg"], {"status": {"is": "posted"}}, {"d": ctx.ContextMeasure("c", (ctx.Change("intersect", "status", {"is": "draft"}),))})
    assert rows(out) == [("A", None), ("B", None)]


def test_population_cannot_be_changed_by_a_measure(sales):
    with pytest.raises(PermissionError):
        ctx.context_report(sales, ["seg"], {"month": {"is": "m1"}}, {"x": ctx.ContextMeasure("c", (ctx.Change("remove", "month"),))}, locked=["month"])


def test_unknown_role_sees_nothing(sales):
    with pytest.raises(PermissionError):
        ctx.secure(sales, "nobody", {"admin": {}})


def model(sales, **extra):
    return SemanticModel(base="s", views={"s": sales}, measures={
        "total": Measure("sum", "s__c"), "posted": Measure("sum", "s__c", filters={"s__status": {"is": "posted"}}),
        "rate": Measure(compose=lambda m: m("posted").cast("double") / m("total")), "loop": Measure(compose=lambda m: m("loop"))}, **extra)


def test_filtered_measure_leaves_other_measures_alone(sales):
    out = model(sales).query({"month": "s__month"}, {"t": "total", "p": "posted", "r": "rate"})
    assert rows(out) == [("m1", 35, 30, 30 / 35), ("m2", 37, 30, 30 / 37)]


def test_access_has_no_fallback_and_cannot_be_widened(sales):
    m = model(sales, access={"s__seg": "segment"})
    with pytest.raises(PermissionError):
        m.query({"month": "s__month"}, {"t": "total"})
    assert m.query({}, {"t": "total"}, filters={"s__seg": {"is": "B"}}, user={"segment": "A"}).first().t is None


def test_pivot_keeps_other_values(sales):
    out = model(sales).query({"month": "s__month", "seg": "s__seg"}, {"t": "total"}, pivot=Pivot("seg", ["A"]))
    assert out.columns == ["month", "A", "other"] and rows(out) == [("m1", 10, 25), ("m2", 7, 30)]


def test_totals_tell_a_null_from_a_total(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "g string, c long")
    out = SemanticModel(base="s", views={"s": df}, measures={"t": Measure("sum", "s__c")}).query({"g": "s__g"}, {"t": "t"}, totals=True)
    assert rows(out) == [("(all)", 3), ("a", 1), (None, 2)]


def test_calculations_and_time_zone(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 20:00:00', 1), (TIMESTAMP_NTZ '2024-01-03 01:00:00', 2) t(ts, c)")
    m = SemanticModel(base="s", views={"s": df}, measures={"t": Measure("sum", "s__c"), "n": Measure("count")}, dimensions={"day": F.col("s__ts").cast("date")})
    with pytest.raises(ValueError, match="time zone"):
        m.query({"d": Timed("s__ts", "date")}, {"t": "t"})
    local = m.query({"d": Timed("s__ts", "date")}, {"t": "t"}, time_zone="Asia/Tokyo")
    assert sorted(str(r.d)[:10] for r in local.collect()) == ["2024-01-02", "2024-01-03"]
    filled = m.query({"day": "day"}, {"n": "n", "t": "t"}, fill="day")
    assert [(str(r.day), r.n, r.t) for r in filled.orderBy("day").collect()] == [("2024-01-01", 1, 1), ("2024-01-02", 0, None), ("2024-01-03", 1, 2)]
    whole = lambda c: F.year(c)
    out = m.query({"day": "day"}, {"t": "t"}, sorts=["day"], calculations={"r": Calculation("running_sum", "t", whole), "d": Calculation("change", "t", whole)})
    assert [(r.t, r.r, r.d) for r in out.collect()] == [(1, 1, None), (2, 3, 1)]


def test_query_errors(sales):
    with pytest.raises(ValueError, match="cyclic"):
        model(sales).query({}, {"l": "loop"})
    with pytest.raises(ValueError, match="sort"):
        model(sales).query({"m": "s__month"}, {"t": "total"}, limit=3)


def test_lineage_names_value_and_population(sales):
    got = model(sales, always_where={"s__month": {"is": "m1"}}).lineage({}, {"rate": "rate"})
    assert got == {"rate": {"fields": ["s__c", "s__status"], "population": ["s__month"]}}


def test_field_selectors_apply_in_order():
    fields = [("o", "id", (), ()), ("o", "amt", ("money",), ()), ("c", "name", (), ("dim",))]
    assert select_fields(fields, ["*", "-tag:money", "o.amt"]) == ["o.id", "c.name", "o.amt"]
    assert select_fields(fields, ["view_tag:dim", "o.*", "-o.id"]) == ["c.name", "o.amt"]


def test_filter_rules(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "s string, n long")
    ids = lambda spec: [x.n for x in f.filter_by(df, {"s": spec}).orderBy("n").collect()]
    assert ids({"is": None}) == [3] and ids({"not": "a"}) == [2, 3] and ids({"is": ["a", None]}) == [1, 3] and ids({"not": ["a", None]}) == [2]
    assert df.where(f.in_set("s", [])).count() == 0
    with pytest.raises(ValueError):
        f.date_range("s", "2024-02-01", "2024-01-01")
    dates = spark.sql("SELECT DATE '2024-01-31' AS d")
    assert dates.where(f.date_range("d", "2024-01-01", "2024-01-31", inclusive_end=True)).count() == 1
    assert dates.where(f.date_range("d", "2024-01-31", "2024-01-31")).count() == 0


@pytest.mark.parametrize("spec, pushed", [
    ({"is": "a"}, "EqualTo(s,a)"), ({"is": ["a", "b"]}, "In(s, [a,b])"), ({"not": "a"}, "Or(IsNull(s),Not(EqualTo(s,a)))"), ({"not": ["a", "b"]}, "Or(IsNull(s),Not(In(s, [a,b])))"), ({"is": None}, "IsNull(s)")])
def test_value_filters_reach_the_scan(spark, tmp_path, spec, pushed):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), (None, 2)], "s string, n long").write.parquet(path)
    plan = f.filter_by(spark.read.parquet(path), {"s": spec})._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters: ")[1]


def test_scorecard_order(spark):
    items = spark.createDataFrame([("a", "mapped", False), ("b", "mapped", False), ("c", "pending", False), ("d", "mapped", True)], "id string, mapping_status string, is_stale boolean")
    checks = spark.createDataFrame([("a", "passed"), ("c", "passed"), ("d", "passed")], "id string, check_status string")
    card = r.parity_scorecard(items, checks, ["id"])
    assert {x.id: x.status for x in card.collect()} == {"a": "pass", "b": "unsupported", "c": "pending", "d": "fail"}
    assert r.scorecard_status(card).first().overall == "fail"
