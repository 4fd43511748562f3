"""Rows dealt out before a scan fans them out."""

import pytest

from starloom.operators.joins import duplicate_keys
from starloom.operators.sets import distinct_rows
from starloom.registry.base import dealt_out
from starloom.registry.derived import customer_history, customer_history_raw


def test_dealt_out_keeps_every_row_and_bounds_a_part(spark):
    df = spark.range(0, 1000, 1, 1).selectExpr("id % 700 AS k", "CASE WHEN id % 3 > 0 THEN 'x' END AS t")
    dealt = dealt_out(df, rows=100)
    assert dealt.rdd.getNumPartitions() == 10
    assert max(dealt.rdd.glom().map(len).collect()) < 300
    assert dealt.exceptAll(df).count() == df.exceptAll(dealt).count() == 0
    assert dealt_out(df, rows=1000).rdd.getNumPartitions() == 1


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """More customers than one part takes, in one file; one of them twice, one key null."""
    folder = str(tmp_path_factory.mktemp("customers"))
    rows = spark.range(0, 2**16 + 10, 1, 1).selectExpr(
        "CASE WHEN id > 0 THEN id - CAST(id = 2 AS INT) END AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "CASE WHEN id < 3 THEN 500.0D ELSE id % 11000 - 1000.0D END AS c_acctbal",
        "CASE WHEN id % 2 = 0 THEN 'HOUSEHOLD' ELSE 'BUILDING' END AS c_mktsegment")
    rows.write.parquet(folder + "/customer.parquet")
    return folder


def test_history_of_one_file_is_fanned_out_in_several_tasks(spark, one_file):
    raw = customer_history_raw(spark, one_file)
    assert raw.rdd.getNumPartitions() == 2
    assert sum(n > 0 for n in raw.rdd.glom().map(len).collect()) == 2
    plain = spark.read.parquet(one_file + "/customer.parquet")
    two, again = plain.where("c_acctbal >= 1000").count(), plain.where("c_acctbal < 1000 AND c_mktsegment = 'HOUSEHOLD'").count()
    assert raw.count() == 5 * (plain.count() + two + again)
    assert customer_history(spark, one_file).count() == distinct_rows(raw).count() == 5 * (plain.count() + two)
    assert duplicate_keys(raw, ["tenant_id", "customer_id", "valid_from"]).count() > 0
