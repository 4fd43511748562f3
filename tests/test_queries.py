"""Registered queries beside their SQL on the smallest data folder.

A selection runs by default; STARLOOM_ALL=1 runs every query.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from starloom.registry import load_all
from tools.check_queries import TABLES, rows_of

SF = "/root/testdata/sf0.001"
CHOSEN = """read_raw_strict decode_columnar_response dataset_digest filter_not filter_date_range join_asof_interval join_asof_sliced join_self_overlap join_strict_m1 join_topic_tree
agg_median agg_sum_distinct_on agg_totals_recomputed win_latest_version win_history_number order_sensitive_compare merge_no_conflict fn_timeframes fn_luhn cdc_incremental_apply
scd2_from_cdc fact_invoice_billing fact_rental_revenue legacy_defect_probe dq_required_values dq_exactly_one_match profile_columns semantic_query semantic_sql_view
query_fill ctx_exclude_lod ctx_visible_groups keyed_diff parity_scorecard schema_reconcile design_compare shared_contract_groups inventory_classify chain_verify
lineage_cycles context_closure scan_status pii_output_assessment label_propagation stream_cdc_upsert""".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(load_all()[0]) if os.environ.get("STARLOOM_ALL") else CHOSEN)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_query_has_sql():
    queries, sql = load_all()
    assert set(queries) == set(sql)
    assert set(queries) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
